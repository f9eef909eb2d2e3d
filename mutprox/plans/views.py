"""Domain tables derived from the driver's tables, in SQL that Spark and the checking engine both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "embeddings", "part", "orders", "customer", "supplier")

VIEWS = {
    "maf": """
SELECT 'G' || CAST(l_suppkey % 8 AS STRING) AS gene, CAST(l_suppkey % 8 + 1 AS STRING) AS chromosome,
       1000000 * (l_suppkey % 8 + 1) + 3 * (l_partkey % 25 + 1) + l_linenumber % 3 AS start_pos,
       1000000 * (l_suppkey % 8 + 1) + 3 * (l_partkey % 25 + 1) + l_linenumber % 3 AS stop_pos,
       CASE l_returnflag WHEN 'N' THEN 'Missense_Mutation' WHEN 'A' THEN 'In_Frame_Del' ELSE 'Silent' END AS classification,
       substr('ACGT', CAST(l_linenumber % 4 AS INT) + 1, 1) AS ref, substr('CGTA', CAST(l_linenumber % 4 AS INT) + 1, 1) AS alt,
       'TCGA-AA-' || lpad(CAST(l_orderkey % 400 AS STRING), 4, '0') AS sample,
       'ENST' || lpad(CAST(2 * (l_suppkey % 8) + l_linenumber % 2 AS STRING), 11, '0') AS transcript,
       'p.' || substr('ARNDCEQGHILKMFPSTWYV', CAST(l_partkey % 20 AS INT) + 1, 1) || CAST(l_partkey % 25 + 1 + 10 * (l_linenumber % 2) AS STRING)
            || substr('RNDCEQGHILKMFPSTWYVA', CAST(l_linenumber % 20 AS INT) + 1, 1) AS aa_change,
       CAST(l_quantity - 25 AS DOUBLE) AS weight, CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS line_no
FROM lineitem""",
    "segments": """
SELECT DISTINCT 'ENST' || lpad(CAST(2 * (l_suppkey % 8) + l_linenumber % 2 AS STRING), 11, '0') AS transcript, 'U' || CAST(l_suppkey % 8 AS STRING) AS uniprot,
       CAST(1 + 10 * (l_linenumber % 2) AS BIGINT) AS t_begin, CAST(30 + 10 * (l_linenumber % 2) AS BIGINT) AS t_end, CAST(1 AS BIGINT) AS u_begin, CAST(30 AS BIGINT) AS u_end
FROM lineitem""",
    "atoms": """
SELECT 'P' || lpad(CAST(CAST(floor(vec_id / 100) AS BIGINT) AS STRING), 4, '0') AS pdb, substr('ABCD', CAST(floor(vec_id / 25) AS INT) % 4 + 1, 1) AS chain,
       CAST(vec_id % 25 + 1 AS INT) AS residue_no,
       substr('ALAARGASNASPCYSGLUGLNGLYHISILELEULYSMETPHEPROSERTHRTRPTYRVAL', CAST(vec_id % 20 AS INT) * 3 + 1, 3) AS residue_name, a.atom_no AS atom_no,
       CAST(CASE a.atom_no WHEN 1 THEN e(1) WHEN 2 THEN e(4) WHEN 3 THEN e(7) END AS DOUBLE) * 120 AS x,
       CAST(CASE a.atom_no WHEN 1 THEN e(2) WHEN 2 THEN e(5) WHEN 3 THEN e(8) END AS DOUBLE) * 120 AS y,
       CAST(CASE a.atom_no WHEN 1 THEN e(3) WHEN 2 THEN e(6) WHEN 3 THEN e(9) END AS DOUBLE) * 120 AS z
FROM embeddings CROSS JOIN (SELECT 1 AS atom_no UNION ALL SELECT 2 UNION ALL SELECT 3) a""",
    "chains": """
SELECT DISTINCT pdb, chain, 'U' || CAST((CAST(substr(pdb, 2, 4) AS INT) + CASE WHEN chain IN ('A','B') THEN 0 ELSE 1 END) % 8 AS STRING) AS uniprot,
       1 AS p_start, 25 AS p_stop, 1 + CAST(substr(pdb, 2, 4) AS INT) % 3 AS u_start, 25 + CAST(substr(pdb, 2, 4) AS INT) % 3 AS u_stop,
       CAST(substr(pdb, 2, 4) AS INT) % 3 AS offset_no FROM atoms""",
    "features": """
SELECT 'U' || CAST(p_partkey % 8 AS STRING) AS uniprot, CAST(p_size % 20 + 1 AS INT) AS start_pos, CAST(p_size % 20 + 1 + CAST(p_partkey % 6 AS INT) AS INT) AS end_pos,
       CASE WHEN p_partkey % 5 = 0 THEN 'DISULFID' ELSE 'DOMAIN' END AS type, p_type || ' {ECO:' || p_brand || '}' AS description, p_partkey AS line_no FROM part""",
    "cosmic": """
SELECT 'G' || CAST(o_custkey % 8 AS STRING) AS gene, 'ENST' || lpad(CAST(2 * (o_custkey % 8) AS STRING), 11, '0') AS transcript, 'missense' AS type,
       'p.A' || CAST(o_orderkey % 35 + 1 AS STRING) || 'T' AS aa_change, o_orderstatus AS domain, lower(substr(o_orderpriority, 3)) AS tissue FROM orders""",
    "sites": """
SELECT 'G' || CAST(c_nationkey % 8 AS STRING) AS gene, 'ENST' || lpad(CAST(2 * (c_nationkey % 8) AS STRING), 11, '0') AS transcript,
       CAST(c_custkey % 30 + 1 AS INT) AS position, CASE WHEN c_custkey % 2 = 0 THEN 'Phosphorylation' ELSE c_mktsegment END AS feature,
       substr('STYDHAG', CAST(c_custkey % 7 AS INT) + 1, 1) AS letter FROM customer""",
    "drugs": """
SELECT s_name AS drug, 'DB' || lpad(CAST(s_suppkey AS STRING), 5, '0') AS drug_id, 'H' || CAST(s_suppkey % 10 AS STRING) AS het,
       'P' || lpad(CAST(s_suppkey % 5 AS STRING), 4, '0') AS pdb, substr('ABCD', CAST(s_suppkey % 4 AS INT) + 1, 1) AS chain,
       CAST(s_nationkey % 25 + 1 AS INT) AS residue_no, s_acctbal > 0 AS is_target FROM supplier""",
    "symbols": """
SELECT CAST(c_custkey AS BIGINT) AS k, 'S' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 9 = 0 THEN '~withdrawn' ELSE '' END AS symbol, c_name AS name, CAST(c_nationkey % 8 + 1 AS STRING) || 'q21' AS chromosome,
       'O' || CAST(c_custkey + 8 - c_custkey % 16 AS STRING) || ', O' || CAST(c_custkey % 7 AS STRING) AS previous, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'A' || CAST(c_custkey % 40 AS STRING) END AS aliases,
       CASE WHEN c_custkey % 4 > 0 THEN 'ENSG' || CAST(c_custkey % 100 AS STRING) END AS ensembl, 'U' || CAST(c_custkey % 30 AS STRING) AS uniprot FROM customer""",
}
#: Views that a view reads.
READS = {"chains": ("atoms",)}


def _element(sql: str, spark: bool) -> str:
    return re.sub(r"\be\((\d)\)", r"element_at(embedding, \1)" if spark else r"embedding[\1]", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain table as a DataFrame."""
    sql, given = _element(VIEWS[name], True).replace("{", "{{").replace("}", "}}"), {}
    for t in (*TABLES, *READS.get(name, ())):
        if re.search(rf"\b(FROM|JOIN) {t}\b", sql):
            given[t] = view(spark, sf_dir, t) if t in VIEWS else spark.read.parquet(f"{sf_dir}/{t}.parquet")
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **given)


#: Rounding to a thousandth as the jobs do it.
def thousandth(x: str) -> str:
    return f"(sign({x} + 0.0005) * floor(round(abs({x} + 0.0005) * 1000, 9)) / 1000)"


_CENTROID = ", ".join(f"{thousandth(f'avg({thousandth(k)})')} AS {k}" for k in "xyz")
_DISTANCE = thousandth("sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))")

#: Derived steps, for the checking engine only.
STEPS = {
    "residues": f"SELECT pdb, chain, residue_no, min(residue_name) AS residue_name, {_CENTROID} FROM atoms GROUP BY pdb, chain, residue_no",
    "placed": "SELECT r.*, c.uniprot, c.offset_no FROM residues r JOIN chains c ON r.pdb = c.pdb AND r.chain = c.chain AND r.residue_no BETWEEN c.p_start AND c.p_stop",
    "base": "SELECT pdb, uniprot, min(chain) AS chain FROM chains GROUP BY pdb, uniprot",
    "prox": f"""SELECT * FROM (SELECT a.uniprot AS uniprot1, a.chain AS chain1, a.residue_no AS pos1, a.offset_no AS off1, a.residue_name AS name1, b.uniprot AS uniprot2, b.chain AS chain2,
       b.residue_no AS pos2, b.offset_no AS off2, b.residue_name AS name2, {_DISTANCE} AS distance, a.pdb FROM placed a
       JOIN base ON base.pdb = a.pdb AND base.uniprot = a.uniprot AND base.chain = a.chain JOIN placed b ON a.pdb = b.pdb AND (a.chain <> b.chain OR a.residue_no <> b.residue_no)) WHERE distance <= 100""",
    "grid": "SELECT uniprot1, distance, round((row_number() OVER (PARTITION BY uniprot1 ORDER BY distance) - 1) / count(*) OVER (PARTITION BY uniprot1), 6) AS p_value FROM (SELECT DISTINCT uniprot1, distance FROM prox)",
    "prox_p": "SELECT prox.*, p_value FROM prox JOIN grid USING (uniprot1, distance)",
    "points": """SELECT uniprot, spot, arg_max(description, line_no) AS description FROM (
       SELECT uniprot, line_no, description, unnest(CASE WHEN type = 'DISULFID' THEN list_distinct([start_pos, end_pos]) ELSE range(start_pos, end_pos + 1) END) AS spot FROM features) GROUP BY uniprot, spot""",
    "known": """SELECT s.uniprot, CAST(c.pos - s.t_begin + s.u_begin AS BIGINT) AS u_pos, array_to_string(list_sort(list(DISTINCT c.aa_change || '|' || c.tissue)), ',') AS known
       FROM (SELECT *, CAST(regexp_extract(aa_change, 'p\\.\\D(\\d+)\\D', 1) AS BIGINT) AS pos FROM cosmic) c JOIN segments s ON c.transcript = s.transcript AND c.pos BETWEEN s.t_begin AND s.t_end GROUP BY 1, 2""",
    "noted": """SELECT p.*, coalesce(f1.description, 'N/A') AS feature1, coalesce(f2.description, 'N/A') AS feature2, coalesce(k1.known, 'N/A') AS cosmic1, coalesce(k2.known, 'N/A') AS cosmic2 FROM prox_p p
       LEFT JOIN points f1 ON f1.uniprot = p.uniprot1 AND f1.spot = p.pos1 + p.off1 LEFT JOIN points f2 ON f2.uniprot = p.uniprot1 AND f2.spot = p.pos2 + p.off2
       LEFT JOIN known k1 ON k1.uniprot = p.uniprot1 AND k1.u_pos = p.pos1 + p.off1 LEFT JOIN known k2 ON k2.uniprot = p.uniprot1 AND k2.u_pos = p.pos2 + p.off2""",
    "prior_rows": "SELECT * FROM noted WHERE (uniprot1 <> uniprot2 OR abs((pos1 + off1) - (pos2 + off2)) > 0) AND p_value <= 0.05 AND distance <= 20",
    "prior": """SELECT uniprot1, chain1, pos1, off1, name1, feature1, cosmic1, uniprot2, chain2, pos2, off2, name2, feature2, cosmic2, list_sort(list(DISTINCT {'distance': distance, 'pdb': pdb, 'p_value': p_value})) AS info FROM (
       SELECT * FROM prior_rows WHERE (uniprot1, chain1, pos1) <= (uniprot2, chain2, pos2) UNION ALL
       SELECT uniprot2, chain2, pos2, off2, name2, uniprot1, chain1, pos1, off1, name1, distance, pdb, p_value, feature2, feature1, cosmic2, cosmic1 FROM (
         SELECT uniprot1, uniprot2, chain1, chain2, pos1, pos2, off1, off2, name1, name2, distance, pdb, p_value, feature1, feature2, cosmic1, cosmic2 FROM prior_rows)
       WHERE (uniprot1, chain1, pos1) > (uniprot2, chain2, pos2)) GROUP BY ALL""",
    "near": "SELECT *, pos1 + off1 AS at1, pos2 + off2 AS at2, CASE WHEN uniprot1 = uniprot2 THEN abs((pos1 + off1) - (pos2 + off2)) END AS linear_distance FROM prior",
    "hits": "SELECT * FROM near WHERE info[1].distance <= 10 AND info[1].p_value <= 0.05 AND (linear_distance IS NULL OR linear_distance >= 0)",
    "mut": """SELECT DISTINCT m.gene, chromosome, start_pos, stop_pos, aa_change, m.transcript, s.uniprot, m.pos - s.t_begin + s.u_begin AS u_pos FROM (
       SELECT *, CAST(regexp_extract(aa_change, 'p\\.\\w\\D*(\\d+)', 1) AS BIGINT) AS pos FROM maf WHERE classification IN ('Missense_Mutation', 'In_Frame_Ins', 'In_Frame_Del')) m
       JOIN segments s ON m.transcript = s.transcript AND m.pos BETWEEN s.t_begin AND s.t_end""",
    "spots": "SELECT DISTINCT gene, x.transcript, position, feature, s.uniprot, x.position - s.t_begin + s.u_begin AS u_pos FROM sites x JOIN segments s ON x.transcript = s.transcript AND x.position BETWEEN s.t_begin AND s.t_end",
    "mm": """SELECT h.*, a.gene AS gene1, a.chromosome AS chromosome1, a.start_pos AS start_pos1, a.stop_pos AS stop_pos1, a.aa_change AS aa_change1, b.gene AS gene2, b.chromosome AS chromosome2,
       b.start_pos AS start_pos2, b.stop_pos AS stop_pos2, b.aa_change AS aa_change2 FROM hits h JOIN mut a ON a.uniprot = uniprot1 AND a.u_pos = at1 JOIN mut b ON b.uniprot = uniprot2 AND b.u_pos = at2""",
    "ends": """SELECT CASE WHEN x <= y THEN x ELSE y END AS a, CASE WHEN x <= y THEN y ELSE x END AS b, linear_distance, info FROM (
       SELECT {'gene': gene1, 'chromosome': chromosome1, 'start_pos': start_pos1, 'stop_pos': stop_pos1, 'aa_change': aa_change1} AS x,
              {'gene': gene2, 'chromosome': chromosome2, 'start_pos': start_pos2, 'stop_pos': stop_pos2, 'aa_change': aa_change2} AS y, linear_distance, info FROM mm)""",
    "pairs": """SELECT a, b, min(linear_distance) AS linear_distance, list_sort(list_distinct(flatten(list([{'p_value': i.p_value, 'distance': i.distance, 'pdb': i.pdb} FOR i IN info])))) AS info FROM ends GROUP BY a, b""",
    "links": """SELECT least(k1, k2) AS key1, greatest(k1, k2) AS key2, info FROM (
       SELECT a.gene || ':' || a.chromosome || ':' || a.start_pos || ':' || a.stop_pos AS k1, b.gene || ':' || b.chromosome || ':' || b.start_pos || ':' || b.stop_pos AS k2, info FROM pairs) WHERE k1 <> k2""",
    "edges": "SELECT 'any' AS structure, key1, key2, avg(i.distance) AS distance FROM (SELECT key1, key2, unnest(info) AS i FROM links) WHERE i.distance < 10 GROUP BY key1, key2",
    "weights": """SELECT gene || ':' || chromosome || ':' || start_pos || ':' || stop_pos AS mutation_key, ref || ':' || alt AS ref_alt, transcript || ':' || aa_change AS protein_key, gene, CAST(count(*) AS DOUBLE) AS weight
       FROM maf WHERE regexp_matches(classification, 'Missense|In_Frame') GROUP BY ALL""",
}
NEEDS = {
    "residues": ("atoms",), "placed": ("residues", "chains"), "base": ("chains",), "prox": ("placed", "base"), "grid": ("prox",), "prox_p": ("prox", "grid"), "points": ("features",),
    "known": ("cosmic", "segments"), "noted": ("prox_p", "points", "known"), "prior_rows": ("noted",), "prior": ("prior_rows",), "near": ("prior",), "hits": ("near",), "mut": ("maf", "segments"),
    "spots": ("sites", "segments"), "mm": ("hits", "mut"), "ends": ("mm",), "pairs": ("ends",), "links": ("pairs",), "edges": ("links",), "weights": ("maf",), **READS,
}


def oracle(body: str, *names: str) -> str:
    """``body`` behind the views and steps it names and all that these read."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS {'MATERIALIZED ' if n in STEPS else ''}({STEPS[n] if n in STEPS else _element(VIEWS[n], False)})" for n in order]
    if not parts:
        return body
    inner = re.match(r"\s*WITH (RECURSIVE )?", body)
    if inner:
        return f"WITH {'RECURSIVE ' if inner[1] else ''}" + ",\n".join(parts) + ",\n" + body[inner.end() :]
    return "WITH " + ",\n".join(parts) + "\n" + body
