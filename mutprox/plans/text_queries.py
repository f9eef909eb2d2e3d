"""Registered queries that write domain tables in the text formats, read them back and compare with SQL; and the gene and report steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mutprox.functions import columns as C
from mutprox.operators import annotate, density, filters, genes, graph, refresh, report, search, stats, structures
from mutprox.plans.queries import _MEMBERS, _PE, INFO, Steps, _drug, _gene_clusters, _located, info_text, job
from mutprox.plans.views import thousandth, view
from mutprox.session import new_path
from mutprox.sources import readers


def _text(df: DataFrame, name: str, **more: str) -> str:
    """Tab-separated text of ``df`` in the shared folder, without a header."""
    path = new_path(df.sparkSession, name)
    df.write.options(sep="\t", **more).csv(path)
    return path


def _named(df: DataFrame, name: str) -> str:
    """The same with a header, through the library's own writer."""
    path = new_path(df.sparkSession, name)
    readers.write_table(df, path, "tsv")
    return path


def _lines(c: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_list(c)), "\n")


# --- readers -----------------------------------------------------------------------------------------------------


@job("SELECT gene, chromosome, CAST(start_pos AS BIGINT) AS start_pos, CAST(stop_pos AS BIGINT) AS stop_pos, classification, ref, alt, sample, transcript, aa_change, weight FROM maf", "maf")
def maf_text(spark: SparkSession, d: str) -> DataFrame:
    names = {v: k for k, v in readers.MAF.items()} | {"transcript": "transcript_name", "aa_change": "amino_acid_change", "weight": "weight"}
    rows = view(spark, d, "maf").select(*[F.col(c).alias(n) for c, n in names.items()])
    return readers.read_maf(spark, _named(rows, "maf"), weight_col="weight").drop("line_no")


@job(f"SELECT a.gene AS gene1, a.aa_change AS mutation1, a.chromosome AS chromosome1, a.start_pos AS start1, b.gene AS gene2, b.aa_change AS mutation2, b.chromosome AS chromosome2, b.stop_pos AS stop2, 'A' AS chain1, linear_distance, {INFO} AS info FROM pairs", "pairs")
def pairs_text(spark: SparkSession, d: str) -> DataFrame:
    side = lambda n: [F.col(f"{c}{n}").alias(f"{k}{n}") for c, k in (("gene", "Gene"), ("chromosome", "Chromosome"), ("start_pos", "Start"), ("stop_pos", "Stop"), ("aa_change", "Mutation"))] + [F.lit(v).alias(f"{k}{n}") for k, v in (("Chain", "[A]"), ("Position", "1"), ("Feature", "N/A"), ("COSMIC", "N/A"))]
    path = _named(Steps(spark, d).pairs().select(*side(1), *side(2), F.col("linear_distance").alias("LinearDistance"), F.col("info").alias("DistanceInfo")), "pairs")
    found = readers.read_pairs(spark, path)
    return found.select("gene1", "mutation1", "chromosome1", F.col("start1").cast("long").alias("start1"), "gene2", "mutation2", "chromosome2", F.col("stop2").cast("long").alias("stop2"), "chain1", F.col("linear_distance").cast("long").alias("linear_distance"), info_text().alias("info"))


@job("SELECT gene, transcript, position, feature FROM sites", "sites")
def sites_text(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "sites").select(F.col("gene").alias("Hugo_Symbol"), F.col("transcript").alias("transcript_name"), F.col("position").alias("Position"), F.col("feature").alias("Feature"))
    return readers.read_sites(spark, _named(rows, "sites"))


def _gene_map_text(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "chains").select(F.concat(F.lit("G"), F.substring("uniprot", 2, 9)).alias("gene"), "uniprot", "pdb")
    known = view(spark, d, "maf").select("gene", F.array(F.concat(F.lit("L"), "gene"), F.concat(F.lit("K"), "gene")).alias("aliases")).distinct()
    piece = F.concat_ws("-", F.concat_ws("|", "u_begin", "t_begin"), F.concat_ws("|", "u_end", "t_end"))
    parts = view(spark, d, "segments").groupBy("uniprot", "transcript").agg(F.array_join(F.array_sort(F.collect_list(piece)), ":").alias("s"))
    parts = parts.groupBy("uniprot").agg(F.array_join(F.array_sort(F.collect_list(F.concat("transcript", F.lit("["), "s", F.lit("]")))), ",").alias("segments_text"))
    rows = genes.gene_map(known, c).join(parts, "uniprot", "left").select("gene", "uniprot", "pdbs", "aliases", "segments_text")
    return readers.read_gene_map(spark, _text(rows, "genes"))


@job("""WITH g AS (SELECT DISTINCT gene FROM maf), p AS (SELECT 'G' || substr(uniprot, 2) AS gene, uniprot, array_to_string(list_sort(list(DISTINCT pdb)), ' ') AS pdbs FROM chains GROUP BY 1, 2)
SELECT gene, uniprot, pdbs, 'K' || gene || ' L' || gene AS aliases FROM g JOIN p USING (gene)""", "maf", "chains")
def gene_map_text(spark: SparkSession, d: str) -> DataFrame:
    return _gene_map_text(spark, d).select("gene", "uniprot", F.array_join("pdbs", " ").alias("pdbs"), F.array_join("aliases", " ").alias("aliases"))


@job("SELECT DISTINCT 'G' || substr(uniprot, 2) AS gene, uniprot, pdb FROM chains WHERE 'G' || substr(uniprot, 2) IN (SELECT gene FROM maf)", "maf", "chains")
def gene_structures(spark: SparkSession, d: str) -> DataFrame:
    return readers.gene_structures(_gene_map_text(spark, d))


@job("SELECT * FROM segments WHERE uniprot IN (SELECT uniprot FROM chains)", "segments", "chains")
def segments_text(spark: SparkSession, d: str) -> DataFrame:
    return readers.parse_segments(_gene_map_text(spark, d))


def _proximity_text(spark: SparkSession, d: str) -> str:
    """Residue pairs as text, some of them damaged: no protein name, no chain, no distance."""
    k = F.col("pos1") % 7
    rows = Steps(spark, d).prox().select(
        F.when(k == 0, F.concat(F.lit("-"), "uniprot1")).otherwise(F.col("uniprot1")).alias("uniprot1"), F.when(k == 1, F.lit("?")).otherwise(F.concat(F.lit("["), "chain1", F.lit("]"))).alias("chain1"), "pos1", "off1", "name1",
        "uniprot2", F.concat(F.lit("["), "chain2", F.lit("]")).alias("chain2"), "pos2", "off2", "name2", F.when(k == 2, F.lit("none")).otherwise(F.col("distance").cast("string")).alias("distance"), "pdb",
    )
    return _text(rows, "proximity")


@job("SELECT uniprot1, chain1, pos1, off1, name1, uniprot2, chain2, pos2, off2, name2, distance, pdb FROM prox WHERE pos1 % 7 > 2", "prox")
def proximity_rows(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_proximity(spark, _proximity_text(spark, d))[0]


@job("SELECT pdb, pos1, uniprot2, pos2, CASE pos1 % 7 WHEN 0 THEN 'protein' WHEN 1 THEN 'coordinate' ELSE 'proximity' END AS reason FROM prox WHERE pos1 % 7 <= 2", "prox")
def proximity_rejects(spark: SparkSession, d: str) -> DataFrame:
    bad = readers.read_proximity(spark, _proximity_text(spark, d))[1]
    return bad.select("pdb", F.col("pos1").cast("int").alias("pos1"), "uniprot2", F.col("pos2").cast("int").alias("pos2"), "reason")


@job("SELECT gene, transcript, type, aa_change, domain, tissue FROM cosmic", "cosmic")
def cosmic_text(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_cosmic(spark, _text(view(spark, d, "cosmic").select("gene", "transcript", "type", "aa_change", "domain", "tissue"), "cosmic"))


@job("SELECT uniprot, start_pos, end_pos, type, description FROM features", "features")
def features_text(spark: SparkSession, d: str) -> DataFrame:
    path, out = new_path(spark, "features"), None
    quoted = view(spark, d, "features").select("uniprot", "start_pos", "end_pos", "type", F.concat(F.lit('"'), "description", F.lit('"')).alias("description"))
    quoted.write.partitionBy("uniprot").options(sep="\t", quote="").csv(path)
    for k in range(8):  # one file for each protein, as the format has it
        one = readers.read_features(spark, f"{path}/uniprot=U{k}", f"U{k}").drop("line_no")
        out = one if out is None else out.unionByName(one)
    return out


@job("SELECT DISTINCT gene AS name FROM maf", "maf")
def name_list_text(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "names")
    view(spark, d, "maf").select(F.concat(F.lit(" "), "gene", F.lit(" ")).alias("value")).write.text(path)
    return readers.read_name_list(spark, path)


@job("SELECT gene AS cluster, gene, aa_change AS mutation, CAST(2 AS DOUBLE) AS degree, 0.5 AS score, CAST(0 AS DOUBLE) AS geodesic, CAST(count(*) AS DOUBLE) AS weight, true AS weight_is_recurrence FROM maf WHERE classification <> 'Silent' GROUP BY gene, aa_change", "maf")
def clusters_text(spark: SparkSession, d: str) -> DataFrame:
    fixed = {"Degree_Connectivity": "2", "Geodesic_From_Centroid": "0", "Chromosome": "1", "Start": "1", "Stop": "1", "Reference": "A", "Alternate": "C", "Transcript": "T", "Alternative_Transcripts": "", "Closeness_Centrality": "0.5"}
    rows = _gene_clusters(Steps(spark, d)).select(F.col("cluster").alias("Cluster"), F.col("gene").alias("Gene/Drug"), F.col("mutation").alias("Mutation/Gene"), F.col("weight").alias("Recurrence"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    return readers.read_clusters(spark, _named(rows, "clusters")).select("cluster", "gene", "mutation", "degree", "score", "geodesic", "weight", "weight_is_recurrence")


@job("SELECT 'edge' AS kind, key1 AS a, key2 AS b, round(distance, 6) AS value FROM edges UNION ALL SELECT 'vertex', mutation_key, ref_alt || protein_key, weight FROM weights", "edges", "weights")
def saved_graph(spark: SparkSession, d: str) -> DataFrame:
    s, path = Steps(spark, d), new_path(spark, "graph")
    w = s.weights()
    readers.save_graph(w, s.edges(), graph.same_site_pairs(w), path)
    vertices, edges, _ = readers.load_graph(spark, path)
    return edges.select(F.lit("edge").alias("kind"), F.col("key1").alias("a"), F.col("key2").alias("b"), F.round("distance", 6).alias("value")).unionByName(vertices.select(F.lit("vertex").alias("kind"), F.col("mutation_key").alias("a"), F.concat("ref_alt", "protein_key").alias("b"), F.col("weight").alias("value")))


# --- record texts ------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    ft = view(spark, d, "features").select("uniprot", F.format_string("FT   %-12s%6d %6d       %s", "type", "start_pos", "end_pos", "description").alias("line"))
    dr = view(spark, d, "chains").select("uniprot", F.format_string("DR   PDB; %s; X-ray; 2.00 A; %s=%d-%d.", "pdb", "chain", "u_start", "u_stop").alias("line"))
    tr = view(spark, d, "segments").select("uniprot", F.format_string("DR   Ensembl; %s; ENSP%s; ENSG%s.", "transcript", F.substring("transcript", 5, 11), F.substring("uniprot", 2, 9)).alias("line"))
    sq = view(spark, d, "segments").select("uniprot", F.lit("     ACDEF GHIKL").alias("line")).distinct()
    return readers.parse_protein_records(ft.unionByName(dr).unionByName(tr).unionByName(sq).groupBy("uniprot").agg(_lines(F.col("line")).alias("text")))


@job("SELECT uniprot, type, start_pos, end_pos, description FROM features", "features")
def record_features(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d)["features"].select("uniprot", "type", "start_pos", "end_pos", "description")


@job("SELECT uniprot, pdb, 'X-ray' AS method, '2.00 A' AS resolution, chain || '=' || u_start || '-' || u_stop AS chains FROM chains", "chains")
def record_structures(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d)["structures"]


@job("SELECT s.uniprot, transcript, 'ENSP' || substr(transcript, 5) AS protein, 'ENSG' || substr(s.uniprot, 2) AS gene, 'ACDEFGHIKL' AS sequence FROM segments s", "segments")
def record_transcripts(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return r["transcripts"].join(r["sequences"], "uniprot")


@job("SELECT drug, '1_2' AS slot, CASE WHEN is_target THEN pdb END AS target_pdb, CASE WHEN is_target THEN chain END AS target_chain, CASE WHEN NOT is_target THEN pdb END AS nontarget_pdb, CASE WHEN NOT is_target THEN chain END AS nontarget_chain FROM drugs", "drugs")
def drug_records(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("is_target"), "TARGET").otherwise("NONTARGET")
    text = F.concat(side, F.lit("_PDB[1][2] "), "pdb", F.lit("\n"), side, F.lit("_CHAIN[1][2]  "), "chain", F.lit(" \nOTHER [x] y"))
    return readers.parse_drug_records(view(spark, d, "drugs").select("drug", text.alias("text"))).drop("unassigned_pdb", "unassigned_chain")


@job("SELECT drug, drug_id, is_target, pdb, chain, CAST(residue_no AS VARCHAR) AS location, het FROM drugs UNION ALL SELECT drug, drug_id, NOT is_target, 'X' || pdb, chain, '', '' FROM drugs WHERE residue_no > 12", "drugs")
def drug_table(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat_ws("|", F.lower("pdb"), "chain", F.col("residue_no").cast("string"), "het")
    other = F.when(F.col("residue_no") > 12, F.concat(F.lit("x"), F.lower("pdb"), F.lit("|"), "chain", F.lit("|"))).otherwise("NULL")
    both = view(spark, d, "drugs").select("drug", "drug_id", F.when(F.col("is_target"), own).otherwise(other).alias("targets"), F.when(F.col("is_target"), other).otherwise(own).alias("nontargets"))
    return readers.parse_drug_table(both)


@job("SELECT gene, transcript, CAST(start_pos % 100 AS INT) AS exon_no, CAST(stop_pos - start_pos + 1 + line_no % 9 AS BIGINT) AS length FROM maf WHERE classification <> 'Silent'", "maf")
def gtf_cds(spark: SparkSession, d: str) -> DataFrame:
    attributes = F.format_string('gene_id "x"; gene_name "%s"; transcript_id "%s"; exon_number "%d";', "gene", "transcript", F.col("start_pos") % 100)
    rows = view(spark, d, "maf").select(F.when(F.col("classification") == "Silent", "UTR").otherwise("CDS").alias("feature"), F.col("start_pos").alias("start"), (F.col("stop_pos") + F.col("line_no") % 9).alias("stop"), attributes.alias("attributes"))
    return readers.parse_gtf_cds(rows)


def _structure_texts(spark: SparkSession, d: str) -> DataFrame:
    """Structure files of two models, the second one moved away."""
    a = view(spark, d, "atoms").withColumn("k", F.struct("chain", "residue_no", "atom_no"))
    line = lambda far: F.format_string("ATOM  %5d  CA  %3s %s%4d    %8.3f%8.3f%8.3f", "atom_no", "residue_name", "chain", "residue_no", F.round("x", 3) + far, F.round("y", 3), F.round("z", 3))
    text = lambda far: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line(far).alias("v")))), lambda x: x["v"]), "\n")
    return a.groupBy("pdb").agg(F.concat(text(0.0), F.lit("\nENDMDL\n"), text(50.0), F.lit("\nENDMDL\n")).alias("text"))


@job(f"SELECT pdb, chain, CAST(residue_no AS VARCHAR) AS residue_no, residue_name, round({thousandth('round(x, 3)')}, 3) AS x, round({thousandth('round(y, 3)')}, 3) AS y, round({thousandth('round(z, 3)')}, 3) AS z, false AS hetero FROM atoms", "atoms")
def atoms_of_text(spark: SparkSession, d: str) -> DataFrame:
    return structures.parse_atoms(_structure_texts(spark, d)).drop("line_no").select("pdb", "chain", "residue_no", "residue_name", *[F.round(k, 3).alias(k) for k in "xyz"], "hetero")


@job("SELECT pdb, chain, uniprot, p_start, p_stop, u_start, u_stop FROM chains WHERE chain <> 'D'", "chains")
def dbref_of_text(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "chains")
    line = lambda u: F.format_string("DBREF  %s %s %4d  %4d  UNP    %s %s_HUMAN %5d  %5d", "pdb", "chain", "p_start", "p_stop", u, u, "u_start", "u_stop")
    twice = c.filter("chain = 'D'").select("pdb", line(F.lit("X1")).alias("line"))  # a chain of two proteins goes
    return structures.parse_dbref(c.select("pdb", line(F.col("uniprot")).alias("line")).unionByName(twice).groupBy("pdb").agg(_lines(F.col("line")).alias("text")))


@job("SELECT pdb, chain, CASE WHEN residue_no % 4 > 0 THEN residue_no END AS position, residue_no + 100 AS u_position, CASE WHEN residue_no % 4 > 0 THEN 'CONFLICT' ELSE 'DELETION' END AS comment FROM residues", "residues")
def seqadv_of_text(spark: SparkSession, d: str) -> DataFrame:
    r = Steps(spark, d).residues()
    gone, kept = (F.format_string(f"SEQADV %s {p} UNP  U1 {{}} %d %s".format("ALA"), *c) for p, c in (("    %s     ", ("pdb", "chain", F.col("residue_no") + 100, F.lit("DELETION"))), ("%s %s %d ", ("pdb", "residue_name", "chain", "residue_no", F.col("residue_no") + 100, F.lit("CONFLICT")))))
    lines = r.select("pdb", F.when(F.col("residue_no") % 4 > 0, kept).otherwise(gone).alias("line"))
    return structures.parse_seqadv(lines.groupBy("pdb").agg(_lines(F.col("line")).alias("text")))


@job("""WITH r AS (SELECT pdb, chain, uniprot, p_start, p_stop, offset_no, CAST(substr(pdb, 2, 4) AS INT) % 9 + 5 AS k FROM chains WHERE NOT (chain = 'D' AND CAST(substr(pdb, 2, 4) AS INT) % 3 = 0) AND NOT (chain = 'B' AND CAST(substr(pdb, 2, 4) AS INT) % 2 = 0))
SELECT pdb, chain, uniprot, p_start, p_stop, offset_no FROM r WHERE chain = 'D'
UNION ALL SELECT pdb, chain, uniprot, p_start, k - 1, offset_no FROM r WHERE chain <> 'D'
UNION ALL SELECT pdb, chain, uniprot, CASE WHEN chain = 'B' THEN k + 1 ELSE k END, p_stop, CASE WHEN chain = 'B' THEN offset_no - 1 ELSE offset_no + 1 END FROM r WHERE chain <> 'D'""", "chains")
def adjusted_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Deletions on chains A and C, insertions on B (of equal length in every second structure, where the chain goes), remarks on D of every third."""
    k = F.substring("pdb", 2, 4).cast("int")
    c = view(spark, d, "chains")
    kind = F.when(F.col("chain") == "B", "INSERTION").when(F.col("chain") == "D", "REMARK").otherwise("DELETION")
    events = c.select("pdb", "chain", (k % 9 + 5).alias("position"), kind.alias("kind")).filter((F.col("kind") != "REMARK") | (k % 3 == 0))
    longer = F.when((F.col("chain") == "B") & (k % 2 == 0), 0).otherwise(1)
    return structures.adjust_ranges(c.withColumn("u_stop", F.col("u_start") + F.col("p_stop") - F.col("p_start") + longer), events)


@job("""SELECT transcript, uniprot, t_begin + a AS t_begin, t_begin + a + 9 AS t_end, u_begin + b AS u_begin, u_begin + b + 9 AS u_end FROM segments, (VALUES (0, 0), (12, 10)) x(a, b) WHERE CAST(substr(uniprot, 2) AS INT) % 2 = 0""", "segments")
def aligned_segments(spark: SparkSession, d: str) -> DataFrame:
    """Two blocks of ten about a gap of two; where the gap is four the identity is too low."""
    even = F.substring("uniprot", 2, 9).cast("int") % 2 == 0
    gapped = lambda letter: F.concat(F.lit("A" * 10), F.when(even, letter * 2).otherwise(letter * 4), F.lit("C" * 10))
    rows = view(spark, d, "segments").select("uniprot", "transcript", F.col("u_begin").alias("u_start"), F.col("t_begin").alias("t_start"), gapped("-").alias("u_gapped"), gapped("G").alias("t_gapped"))
    return annotate.aligned_segments(rows)


# --- names -------------------------------------------------------------------------------------------------------


@job("SELECT symbol, name, chromosome, replace(previous, ', ', '|') AS previous, aliases FROM symbols WHERE symbol NOT LIKE '%withdrawn'", "symbols")
def gene_table(spark: SparkSession, d: str) -> DataFrame:
    return readers.parse_gene_table(view(spark, d, "symbols").drop("ensembl", "uniprot", "k")).select("symbol", "name", "chromosome", F.array_join("previous", "|").alias("previous"), F.array_join("aliases", "|").alias("aliases"))


@job("SELECT name, array_to_string(list_sort(list(DISTINCT symbol)), '|') AS symbols FROM (SELECT symbol, unnest(string_split(previous, ', ')) AS name FROM symbols WHERE symbol NOT LIKE '%withdrawn') GROUP BY name", "symbols")
def symbol_index(spark: SparkSession, d: str) -> DataFrame:
    return genes.symbol_index(readers.parse_gene_table(view(spark, d, "symbols").drop("ensembl", "uniprot", "k")), "previous").select("name", F.array_join("symbols", "|").alias("symbols"))


@job("SELECT ensembl, array_to_string(list_sort(list(DISTINCT symbol)), '|') AS symbols FROM symbols WHERE ensembl IS NOT NULL GROUP BY 1", "symbols")
def ensembl_to_gene(spark: SparkSession, d: str) -> DataFrame:
    return genes.ensembl_to_gene(view(spark, d, "symbols")).select("ensembl", F.array_join("symbols", "|").alias("symbols"))


@job("SELECT symbol, uniprot AS proteins FROM symbols", "symbols")
def gene_to_protein(spark: SparkSession, d: str) -> DataFrame:
    return genes.gene_to_protein(view(spark, d, "symbols")).select("symbol", F.array_join("proteins", "|").alias("proteins"))


@job("""WITH i AS (SELECT 'O' || k AS symbol, CAST(k % 8 + 1 AS BIGINT) AS chr, k * 1000 AS start, k % 60 AS entrez, k % 30 AS omim, uniprot FROM symbols WHERE k % 2 = 0),
c AS (SELECT 'S' || k AS candidate, CAST(k % 8 + 1 AS BIGINT) AS chr, k * 1000 AS start, k % 90 AS entrez, k % 45 AS omim, uniprot, string_split(previous, ', ') AS previous FROM symbols),
m AS (SELECT i.symbol, candidate, list_contains(previous, i.symbol) AS named, CAST(i.entrez = c.entrez AS INT) + 2 * CAST(i.omim = c.omim AS INT) + CAST(i.uniprot = c.uniprot AS INT) AS hit,
  CAST(i.entrez <> c.entrez AS INT) + CAST(i.omim <> c.omim AS INT) + CAST(i.uniprot <> c.uniprot AS INT) AS miss FROM i JOIN c ON i.chr = c.chr AND c.start + 500 + 100000 > i.start AND c.start - 100000 < i.start + 500),
r AS (SELECT symbol, candidate, CASE WHEN named AND (miss <= 1 OR hit > 0) THEN 'name' WHEN hit > 1 AND miss = 0 THEN 'ids' WHEN hit > 0 AND hit <= 1 AND miss <= 1 THEN 'id' END AS reason FROM m WHERE named OR hit > 0)
SELECT * FROM r WHERE reason IS NOT NULL""", "symbols")
def reconciled_symbols(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    none = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    at = [(k * 1000).alias("start"), (k * 1000 + 500).alias("stop"), *none("refseq", "vega", "ensembl", "ucsc"), "uniprot"]
    s = view(spark, d, "symbols")
    invalid = s.filter("k % 2 = 0").select(F.concat(F.lit("O"), k.cast("string")).alias("symbol"), F.concat(F.lit("chr"), (k % 8 + 1).cast("string")).alias("chromosome"), (k % 60).alias("entrez"), (k % 30).alias("omim"), *at)
    current = s.select(F.concat(F.lit("S"), k.cast("string")).alias("symbol"), F.concat((k % 8 + 1).cast("string"), F.lit("q21")).alias("chromosome"), (k % 90).alias("entrez"), (k % 45).alias("omim"), *at, F.split("previous", ", ").alias("previous"), F.array("aliases").alias("aliases"))
    return genes.reconcile_symbols(invalid, current)


@job("SELECT k, CAST(k % 8 + 1 AS VARCHAR) AS chr, k % 8 = k % 5 AS same, k % 8 = k % 5 AND k % 3 > 0 AND abs(k % 30 - k % 29) <= 1 AS band, CASE WHEN k % 5 = 0 THEN '0' ELSE CAST(-k AS VARCHAR) END AS number, CASE WHEN k % 5 = 0 THEN '0' ELSE 'a' || -k || 'b' END AS filled FROM symbols", "symbols")
def name_columns(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("k"), lambda c: c.cast("string")
    a = F.concat(text(k % 8 + 1), F.lit("q"), text(k % 30))
    b = F.concat(F.lit("Chr_"), text(k % 5 + 1), F.when(k % 3 == 0, "p").otherwise("q"), text(k % 29))
    v = F.when(k % 5 == 0, "N/A").otherwise(F.concat(F.lit("a"), text(-k), F.lit("b")))
    return view(spark, d, "symbols").select("k", C.normalize_chr(a).alias("chr"), C.same_chr(a, b).alias("same"), C.same_major_band(a, b).alias("band"), C.num_only(v).alias("number"), C.null_is_zero(v).alias("filled"))


# --- sites, pairs and reports ------------------------------------------------------------------------------------


@job("SELECT DISTINCT gene || ':' || transcript || ':' || position || ':-' AS mutation_key, '-:ptm' AS ref_alt, transcript || ':p.' || position AS protein_key, gene, CAST(1 AS DOUBLE) AS weight FROM sites", "sites")
def site_weights(spark: SparkSession, d: str) -> DataFrame:
    return graph.site_weights(view(spark, d, "sites"))


@job("SELECT DISTINCT pdb FROM sites s JOIN chains c ON c.uniprot = 'U' || substr(s.gene, 2) WHERE contains(feature, 'Phospho') AND letter NOT IN ('S', 'T', 'Y', 'D', 'H') AND position BETWEEN u_start AND u_stop", "sites", "chains")
def bad_phospho_structures(spark: SparkSession, d: str) -> DataFrame:
    s, c = view(spark, d, "sites"), view(spark, d, "chains")
    met = s.join(c, (c["uniprot"] == F.concat(F.lit("U"), F.substring(s["gene"], 2, 9))) & s["position"].between(c["u_start"], c["u_stop"]))
    return filters.bad_phospho_structures(met.select("feature", "letter", F.array(F.struct("pdb")).alias("info")))


@job(f"SELECT uniprot1 AS key1, chain1, uniprot2 AS key2, chain2, {INFO} AS info FROM near", "near")
def edge_union(spark: SparkSession, d: str) -> DataFrame:
    rows = Steps(spark, d).prior().withColumn("key1", F.col("uniprot1")).withColumn("key2", F.col("uniprot2"))
    return graph.edge_union(rows.filter("uniprot1 = uniprot2"), rows.filter("uniprot1 <> uniprot2")).withColumn("info", info_text())


_ENDS = ", ".join(f"{e}.{c}" for e in "ab" for c in ("gene", "chromosome", "start_pos", "stop_pos", "aa_change"))


@job(f"SELECT a.gene AS gene1, a.aa_change AS mutation1, b.gene AS gene2, b.aa_change AS mutation2, a.start_pos AS start1, b.start_pos AS start2, {INFO} AS info, row_number() OVER (ORDER BY info[1].p_value, {_ENDS}) AS line FROM pairs", "pairs")
def pairs_by_p(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with their line in the written order."""
    rows = readers.line_numbers(search.sort_pairs_by_p(Steps(spark, d).pairs()))
    return rows.select("gene1", F.col("aa_change1").alias("mutation1"), "gene2", F.col("aa_change2").alias("mutation2"), F.col("start_pos1").alias("start1"), F.col("start_pos2").alias("start2"), info_text().alias("info"), "line")


_BEST = """best AS (SELECT * FROM (SELECT a.gene AS gene1, a.aa_change AS mutation1, b.gene AS gene2, b.aa_change AS mutation2, linear_distance, info, a.start_pos AS s1, b.start_pos AS s2,
row_number() OVER (PARTITION BY least(a.gene || ':' || a.aa_change, b.gene || ':' || b.aa_change), greatest(a.gene || ':' || a.aa_change, b.gene || ':' || b.aa_change) ORDER BY info[1].p_value, a.start_pos, a.aa_change, b.start_pos, b.aa_change) AS k FROM pairs) WHERE k = 1)"""


def _best(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct("start_pos1", "aa_change1", "start_pos2", "aa_change2")
    return report.best_pair_info(Steps(spark, d).pairs().select("gene1", F.col("aa_change1").alias("mutation1"), "gene2", F.col("aa_change2").alias("mutation2"), "linear_distance", "info", line.alias("line_no")))


@job(f"WITH {_BEST} SELECT gene1, mutation1, gene2, mutation2, linear_distance, s1, s2, {INFO} AS info FROM best", "pairs")
def most_unlikely_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("gene1", "mutation1", "gene2", "mutation2", "linear_distance", F.col("line_no.start_pos1").alias("s1"), F.col("line_no.start_pos2").alias("s2"), info_text().alias("info"))


@job(f"WITH {_BEST} SELECT info[1].pdb AS pdb, gene1, gene2, 'f' AS feature1, 'g' AS feature2, string_agg(mutation1 || ':' || mutation2, '|' ORDER BY s1, mutation1, s2, mutation2) AS mutations, string_agg(CAST(linear_distance AS VARCHAR), '|' ORDER BY s1, mutation1, s2, mutation2) AS linear_distances FROM best WHERE linear_distance IS NOT NULL GROUP BY ALL", "pairs")
def pairs_by_structure(spark: SparkSession, d: str) -> DataFrame:
    return report.collapse_by_structure(_best(spark, d).withColumn("feature1", F.lit("f")).withColumn("feature2", F.lit("g")), True)


@job(f"WITH {_MEMBERS}, {_PE} SELECT m.cluster, pdb, m.gene, m.mutation, 'A' AS chain, c AS pos, weight > 100 AS is_centroid, false AS is_site FROM e JOIN m ON m.gene = g AND m.mutation = mu", "maf", "pairs")
def structure_locations(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    members = _gene_clusters(s).withColumn("geodesic", F.when(F.col("weight") > 100, 0.0).otherwise(1.0)).withColumn("alt", F.lit("A"))
    return report.structure_locations(members, _located(s))


@job("""WITH s AS (SELECT transcript, count(DISTINCT aa_change) AS positions, count(*) AS variants FROM maf GROUP BY 1 UNION ALL SELECT transcript, count(DISTINCT position), count(*) FROM sites GROUP BY 1),
c AS (SELECT 'positions' AS measure, positions AS size FROM s UNION ALL SELECT 'variants', variants FROM s), n AS (SELECT measure, size, count(*) AS n FROM c GROUP BY 1, 2)
SELECT measure, size, n, round(n / sum(n) OVER (PARTITION BY measure), 6) AS probability FROM n""", "maf", "sites")
def merged_histograms(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, place: stats.cluster_size_histogram(view(spark, d, name).select(F.col("transcript").alias("trial"), F.col("gene").alias("cluster"), F.col(place).alias("position")))
    return stats.merge_histograms(part("maf", "aa_change"), part("sites", "position")).withColumn("probability", F.round("probability", 6))


@job("""WITH o AS (SELECT pdb, row_number() OVER (PARTITION BY pdb ORDER BY chain, residue_no) - 1 AS ord, abs(x) AS rd FROM residues), i AS (SELECT *, sum(CASE WHEN rd >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY pdb ORDER BY ord) AS island FROM o)
SELECT pdb AS structure, CAST(0 AS INT) AS run, CAST(island AS BIGINT) AS island, min(ord) AS first, max(ord) AS last, count(*) AS n, CAST(count(*) AS DOUBLE) AS weight FROM i GROUP BY pdb, island HAVING count(*) >= 4""", "residues")
def islands_along_chains(spark: SparkSession, d: str) -> DataFrame:
    """Residues in the order of their chains, with the first coordinate as reachability."""
    at = (F.ascii("chain") - F.ascii(F.lit("A"))) * 25 + F.col("residue_no") - 1
    order = Steps(spark, d).residues().select(F.col("pdb").alias("structure"), F.lit(0).alias("run"), at.cast("long").alias("ord"), F.abs("x").alias("rd"), F.lit(1.0).alias("weight"))
    return density.reachability_islands(order, 15.0)


@job("SELECT uniprot1, chain1, pos1, uniprot2, chain2, pos2, pdb, round(distance, 6) AS distance, round(p_value, 6) AS p_value FROM prox_p", "prox_p")
def refreshed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All structures but two are stored, the two are added, and only the proteins that have them are worked out again."""
    s = Steps(spark, d)
    chains, residues = s.view("chains"), s.residues()
    late = F.col("pdb").isin("P0001", "P0003")
    path = new_path(spark, "pairs")
    refresh.store(refresh.pairs_of(residues.filter(~late), chains.filter(~late)), path)
    current, previous = chains.select("uniprot", "pdb").distinct(), chains.filter(~late).select("uniprot", "pdb").distinct()
    changed = genes.proteins_to_refresh(current, previous, previous.select("uniprot"))
    found = refresh.refresh(path, residues, chains, changed)
    return found.select("uniprot1", "chain1", "pos1", "uniprot2", "chain2", "pos2", "pdb", F.round("distance", 6).alias("distance"), F.round("p_value", 6).alias("p_value"))


@job("SELECT gene, aa_change, start_pos, count(*) AS n_pairs, count(DISTINCT {'u': uniprot2, 'c': chain2, 'p': pos2}) AS n_others FROM near JOIN mut ON mut.uniprot = uniprot1 AND mut.u_pos = at1 GROUP BY ALL", "near", "mut")
def bucketed_hits(spark: SparkSession, d: str) -> DataFrame:
    """Mutations joined to prioritised pairs that are stored in buckets by the place of their first end."""
    s = Steps(spark, d)
    stored = readers.write_bucketed(search.ready(s.prior()), ("uniprot1", "at1"))
    return search.hits_at(s.mutations(), stored).groupBy("gene", "aa_change", "start_pos").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("uniprot2", "chain2", "pos2").alias("n_others"))


_HOLE = "CASE WHEN chain2 = 'A' AND pos1 < 6 THEN 'coordinate' WHEN chain2 = 'B' AND pos1 < 6 THEN 'protein' WHEN chain2 = 'C' AND pos1 < 6 THEN 'proximity' WHEN chain2 = 'D' AND pos1 < 6 THEN 'annotation' END"


def _prioritised_text(spark: SparkSession, d: str) -> str:
    """Prioritised pairs as text; those of the first five residues lack something, by the chain of their second end."""
    keep = lambda c, chain: F.when((F.col("chain2") == chain) & (F.col("pos1") < 6), F.lit(None)).otherwise(F.col(c)).alias(c)
    p = Steps(spark, d).prior()
    rows = p.select(*[keep(c, {"off2": "A", "name1": "B", "cosmic2": "D"}[c]) if c in ("off2", "name1", "cosmic2") else F.col(c) for c in readers.PRIORITISED], F.when((F.col("chain2") == "C") & (F.col("pos1") < 6), F.lit(None)).otherwise(C.encode_info(F.col("info"))).alias("info"))
    return _text(rows, "prioritised")


@job(f"SELECT uniprot1, chain1, pos1, off1, name1, feature1, cosmic1, uniprot2, chain2, pos2, feature2, cosmic2, {INFO} AS info FROM prior WHERE {_HOLE} IS NULL", "prior")
def prioritised_text(spark: SparkSession, d: str) -> DataFrame:
    found = readers.read_prioritised(spark, _prioritised_text(spark, d))[0]
    return found.select("uniprot1", "chain1", "pos1", "off1", "name1", "feature1", "cosmic1", "uniprot2", "chain2", "pos2", "feature2", "cosmic2", info_text().alias("info"))


@job(f"SELECT uniprot1, pos1, uniprot2, chain2, pos2, {_HOLE} AS reason FROM prior WHERE {_HOLE} IS NOT NULL", "prior")
def prioritised_rejects(spark: SparkSession, d: str) -> DataFrame:
    bad = readers.read_prioritised(spark, _prioritised_text(spark, d))[1]
    return bad.select("uniprot1", F.col("pos1").cast("int").alias("pos1"), "uniprot2", "chain2", F.col("pos2").cast("int").alias("pos2"), "reason")


def _pair_text(df: DataFrame, kind: str, **cols: Column) -> DataFrame:
    """Rows written with the given headers and read back as a kind of pairs."""
    return readers.read_pairs(df.sparkSession, _named(df.select(*[c.alias(n) for n, c in cols.items()]), kind), kind)


def _plain(n: int) -> dict[str, Column]:
    return {f"{k}{n}": F.lit(v) for k, v in (("Chain", "[A]"), ("Position", "1"), ("Feature", "N/A"), ("COSMIC", "N/A"))}


def _spot(n: int, gene: str, transcript: str, position: str, feature: str) -> dict[str, Column]:
    return {f"Gene{n}": F.col(gene), f"Transcript{n}": F.col(transcript), f"TranscriptPosition{n}": F.col(position), f"Site{n}": F.col(feature), **_plain(n)}


def _lists() -> dict[str, Column]:
    return {"LinearDistance": F.col("linear_distance"), "DistanceInfo": F.col("info")}


_MUSITE = f"m.gene AS gene1, m.chromosome AS chromosome1, m.start_pos AS start1, m.stop_pos AS stop1, m.aa_change AS mutation1, s.gene AS gene2, s.transcript AS transcript2, s.position AS position2, s.feature AS site2, linear_distance, {INFO} AS info"


@job(f"""SELECT gene1, start1, mutation1, gene2, transcript2, position2, site2, linear_distance, info FROM (SELECT DISTINCT * FROM (
 SELECT {_MUSITE} FROM near n JOIN spots s ON s.uniprot = uniprot1 AND s.u_pos = at1 JOIN mut m ON m.uniprot = uniprot2 AND m.u_pos = at2
 UNION ALL SELECT {_MUSITE} FROM near n JOIN spots s ON s.uniprot = uniprot2 AND s.u_pos = at2 JOIN mut m ON m.uniprot = uniprot1 AND m.u_pos = at1 WHERE NOT EXISTS (SELECT 1 FROM spots x WHERE x.uniprot = n.uniprot1 AND x.u_pos = n.at1)))""", "near", "spots", "mut")
def mutation_site_text(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    met = search.mutation_site_pairs(s.mutations(), s.placed_sites(), s.prior().drop("feature1", "feature2"))
    one = {f"{k}1": F.col(f"mutation_{c}") for k, c in (("Gene", "gene"), ("Chromosome", "chromosome"), ("Start", "start_pos"), ("Stop", "stop_pos"), ("Mutation", "aa_change"))}
    found = _pair_text(met, "musites", **one, **_plain(1), **_spot(2, "site_gene", "site_transcript", "site_position", "site_feature"), **_lists())
    return found.select("gene1", F.col("start1").cast("long").alias("start1"), "mutation1", "gene2", "transcript2", F.col("transcript_position2").cast("int").alias("position2"), "site2", F.col("linear_distance").cast("long").alias("linear_distance"), info_text().alias("info"))


@job(f"SELECT a.gene AS gene1, a.transcript AS transcript1, a.position AS position1, a.feature AS site1, b.gene AS gene2, b.position AS position2, b.feature AS site2, linear_distance, {INFO} AS info FROM (SELECT * RENAME (feature1 AS f1, feature2 AS f2) FROM near) n JOIN spots a ON a.uniprot = uniprot1 AND a.u_pos = at1 JOIN spots b ON b.uniprot = uniprot2 AND b.u_pos = at2", "near", "spots")
def site_pair_text(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    met = search.site_pairs(s.placed_sites(), s.prior().drop("feature1", "feature2"))
    found = _pair_text(met, "sites", **_spot(1, "gene1", "transcript1", "position1", "feature1"), **_spot(2, "gene2", "transcript2", "position2", "feature2"), **_lists())
    return found.select("gene1", "transcript1", F.col("transcript_position1").cast("int").alias("position1"), "site1", "gene2", F.col("transcript_position2").cast("int").alias("position2"), "site2", F.col("linear_distance").cast("long").alias("linear_distance"), info_text().alias("info"))


@job(_drug("true"), "near", "drugs", "mut")
def drug_pair_text(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    met = search.drug_pairs(s.mutations(), s.prior(), s.view("drugs"), True)
    names = {"Drug": "drug", "Drugport_ID": "drug_id", "PDB_ID": "pdb", "Compound_Location": "location", "Gene": "gene", "Chromosome": "chromosome", "Start": "start_pos", "Stop": "stop_pos", "Amino_Acid_Change": "aa_change", "Mutation_Location_In_PDB": "pos"}
    chains = {k: F.concat(F.lit("["), c, F.lit("]")) for k, c in (("Drug_Chain", "drug_chain"), ("Res_Chain", "chain"))}
    found = _pair_text(met, "drugs", **{k: F.col(c) for k, c in names.items()}, **chains, **{"3D_Distance_Information": F.array("info")})
    number = lambda c, kind: F.col(c).cast(kind)
    return found.filter("size(info) = 1").select(
        "drug", "drug_id", "pdb", F.col("chain1").alias("drug_chain"), number("location", "int").alias("location"), "gene", "chromosome", number("start", "long").alias("start_pos"), number("stop", "long").alias("stop_pos"),
        F.col("mutation").alias("aa_change"), F.col("chain2").alias("chain"), number("position", "int").alias("pos"),
    ).distinct()


@job("SELECT gene AS cluster, gene, aa_change AS mutation, 2.0 AS degree, 0.5 AS score, 0.0 AS geodesic, CAST(count(*) AS DOUBLE) AS weight, false AS weight_is_recurrence FROM maf WHERE classification <> 'Silent' GROUP BY gene, aa_change", "maf")
def weighted_clusters_text(spark: SparkSession, d: str) -> DataFrame:
    """Cluster rows under the other two headers: an exponential score and a weight."""
    fixed = {"Degree_Connectivity": "2", "Geodesic_From_Centroid": "0", "Chromosome": "1", "Start": "1", "Stop": "1", "Reference": "A", "Alternate": "C", "Transcript": "T", "Alternative_Transcripts": "", "Exponentials_Score": "0.5"}
    rows = _gene_clusters(Steps(spark, d)).select(F.col("cluster").alias("Cluster"), F.col("gene").alias("Gene/Drug"), F.col("mutation").alias("Mutation/Gene"), F.col("weight").alias("Weight"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    return readers.read_clusters(spark, _named(rows, "clusters")).select("cluster", "gene", "mutation", "degree", "score", "geodesic", "weight", "weight_is_recurrence")
