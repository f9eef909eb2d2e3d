"""Registered queries over the domain tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mutprox.functions import columns as C
from mutprox.operators import annotate, density, filters, genes, graph, report, search, stats, structures
from mutprox.plans.views import oracle, view
from mutprox.session import cut
from mutprox.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def job(body: str | None = None, *names: str) -> Callable:
    """Register the function under its name, with the checking SQL behind the views and steps it needs."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if body is not None:
            ORACLE_SQL[f.__name__] = oracle(body, *names)
        return f

    return put


class Steps:
    """The chain from views to pairs; what several later steps read (residue pairs, prioritised pairs, counted calls, segments, placed mutations and sites) is written once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.view = lambda name: view(spark, sf_dir, name)
        self._written: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._written:
            self._written[name] = cut(make())
        return self._written[name]

    def calls(self) -> DataFrame:
        """Calls that agree in all but sample, weight and line, with their number ``n``; lineitem is read for this once."""
        alike = ["gene", "chromosome", "start_pos", "stop_pos", "classification", "ref", "alt", "transcript", "aa_change"]
        return self.once("calls", lambda: self.view("maf").groupBy(*alike).agg(F.count(F.lit(1)).alias("n")))

    def segments(self) -> DataFrame:
        return self.once("segments", lambda: self.view("segments"))

    def residues(self) -> DataFrame:
        return structures.residue_centroids(self.view("atoms"))

    def prox(self) -> DataFrame:
        return structures.residue_distances(self.residues(), self.view("chains"))

    def prox_p(self) -> DataFrame:
        return annotate.empirical_p_values(self.once("prox", self.prox))

    def noted(self, rows: DataFrame | None = None) -> DataFrame:
        rows = annotate.annotate_features(self.prox_p() if rows is None else rows, self.view("features"))
        return annotate.annotate_cosmic(rows, self.view("cosmic"), self.segments())

    def prior(self) -> DataFrame:
        # the filter reads no annotation, so it goes first
        return self.once("prior", lambda: annotate.collapse_pairs(self.noted(filters.prioritise_filter(self.prox_p())), ("feature", "cosmic")))

    def mutations(self) -> DataFrame:
        return self.once("mutations", lambda: search.place_mutations(filters.search_mutations(self.calls()), self.segments()))

    def placed_sites(self) -> DataFrame:
        return self.once("sites", lambda: search.place_sites(self.view("sites"), self.segments()))

    def pairs(self) -> DataFrame:
        return search.gather_pairwise(search.mutation_pairs(self.mutations(), self.prior()))

    def links(self, pairs: DataFrame | None = None, *more: str) -> DataFrame:
        key = lambda n: C.mutation_key(*[F.col(f"{c}{n}") for c in ("gene", "chromosome", "start_pos", "stop_pos")])
        return (self.pairs() if pairs is None else pairs).select(key(1).alias("key1"), key(2).alias("key2"), F.lit("A").alias("chain1"), F.lit("A").alias("chain2"), "info", *more)

    def edges(self) -> DataFrame:
        """Edges of the graph; pairs whose mutations differ in the change only are counted, not multiplied out."""
        return graph.pair_distance(self.links(search.vertex_pairs(self.mutations(), self.prior()), "n"), max_distance=10.0, n="n")

    def weights(self) -> DataFrame:
        return graph.mutation_weights(filters.cluster_mutations(self.calls()), n="n")


def info_text(c: str = "info"):  # noqa: ANN201
    """Info lists as sorted text, for comparing."""
    return F.array_join(F.array_sort(F.transform(c, lambda x: F.concat_ws(" ", F.format_number(x["distance"], 3), x["pdb"], F.format_number(x["p_value"], 6)))), "|")


INFO = "array_to_string(list_sort([printf('%.3f', i.distance) || ' ' || i.pdb || ' ' || printf('%.6f', i.p_value) FOR i IN info]), '|')"
MUT = "gene, chromosome, start_pos, stop_pos, aa_change"


# --- sources and columns -----------------------------------------------------------------------------------------


@job("SELECT gene, aa_change, CAST(regexp_extract(aa_change, '(\\d+)', 1) AS INT) AS pos, substr(aa_change, 3, 1) AS ref_aa, right(aa_change, 1) AS alt_aa, gene || ':' || chromosome || ':' || start_pos || ':' || stop_pos AS mutation_key, ref || ':' || alt AS ref_alt, transcript || ':' || aa_change AS protein_key, sample AS sample_id, chromosome || ':g.' || start_pos || ref || '>' || alt AS hgvs FROM maf", "maf")
def maf_columns(spark: SparkSession, d: str) -> DataFrame:
    m, a = view(spark, d, "maf"), C.aa_parts(F.col("aa_change"))
    return m.select("gene", "aa_change", C.aa_position(F.col("aa_change")).alias("pos"), a["ref"].alias("ref_aa"), a["alt"].alias("alt_aa"), C.mutation_key(F.col("gene"), F.col("chromosome"), F.col("start_pos"), F.col("stop_pos")).alias("mutation_key"), C.ref_alt_key(F.col("ref"), F.col("alt")).alias("ref_alt"), C.protein_key(F.col("transcript"), F.col("aa_change")).alias("protein_key"), C.sample_id(F.col("sample")).alias("sample_id"), C.hgvs_g(F.col("chromosome"), F.col("start_pos"), F.col("stop_pos"), F.col("ref"), F.col("alt")).alias("hgvs"))


@job("SELECT line_no, CASE WHEN contains(description, ' {ECO') THEN split_part(description, ' {ECO', 1) ELSE description END AS domain, end_pos + 3 > least(5, 9) AND start_pos - 3 < 9 AS overlaps FROM features", "features")
def feature_columns(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "features").select("line_no", C.clean_domain(F.col("description")).alias("domain"), C.ranges_overlap(F.lit(5), F.lit(9), F.col("start_pos"), F.col("end_pos"), 3).alias("overlaps"))


@job("SELECT gene AS value, count(*) AS n FROM maf GROUP BY gene", "maf")
def gene_counts(spark: SparkSession, d: str) -> DataFrame:
    return readers.distinct_counts(view(spark, d, "maf"), "gene")


# --- filters -----------------------------------------------------------------------------------------------------


@job("SELECT line_no, gene, aa_change, classification FROM maf WHERE classification <> 'Silent'", "maf")
def cluster_mutation_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.cluster_mutations(view(spark, d, "maf")).select("line_no", "gene", "aa_change", "classification")


@job("SELECT line_no, gene, aa_change, classification FROM maf WHERE classification = 'Missense_Mutation'", "maf")
def search_mutation_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.search_mutations(view(spark, d, "maf"), missense_only=True).select("line_no", "gene", "aa_change", "classification")


def _kind(sql: str) -> str:
    return f"SELECT pdb, uniprot1, chain1, pos1, uniprot2, chain2, pos2, distance FROM prox WHERE {sql}"


def _meric(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = Steps(spark, d).prox().withColumn("gene1", F.col("uniprot1")).withColumn("gene2", F.col("uniprot2"))
        return filters.meric_filter(rows, kind).select("pdb", "uniprot1", "chain1", "pos1", "uniprot2", "chain2", "pos2", "distance")

    run.__name__ = f"meric_{kind}"
    return run


for _name, _sql in (("intra", "uniprot1 = uniprot2"), ("heteromer", "chain1 <> chain2 AND uniprot1 <> uniprot2"), ("homomer", "chain1 <> chain2 AND uniprot1 = uniprot2"), ("monomer", "chain1 = chain2 AND uniprot1 = uniprot2"), ("multimer", "chain1 <> chain2")):
    job(_kind(_sql), "prox")(_meric(_name))


@job("SELECT gene, position, feature, letter FROM sites WHERE NOT contains(feature, 'Phospho') OR letter IN ('S','T','Y','D','H')", "sites")
def phospho_sites(spark: SparkSession, d: str) -> DataFrame:
    return filters.valid_phospho_sites(view(spark, d, "sites")).select("gene", "position", "feature", "letter")


@job("SELECT uniprot1, chain1, pos1, uniprot2, chain2, pos2, distance, pdb, round(p_value, 6) AS p_value FROM prior_rows", "prior_rows")
def prioritised_rows(spark: SparkSession, d: str) -> DataFrame:
    return filters.prioritise_filter(Steps(spark, d).prox_p()).select("uniprot1", "chain1", "pos1", "uniprot2", "chain2", "pos2", "distance", "pdb", F.round("p_value", 6).alias("p_value"))


@job("SELECT uniprot1, chain1, pos1, uniprot2, chain2, pos2, n FROM (SELECT *, len([i FOR i IN info IF i.pdb IN ('P0000', 'P0002')]) AS n FROM prior WHERE uniprot1 IN ('U0','U1','U2') AND uniprot2 IN ('U0','U1','U2')) WHERE n > 0", "prior")
def listed_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = Steps(spark, d).prior().withColumn("gene1", F.col("uniprot1")).withColumn("gene2", F.col("uniprot2"))
    names = p.select(F.explode(F.array("uniprot1", "uniprot2")).alias("name")).filter(F.col("name").isin("U0", "U1", "U2"))
    pdbs = p.select(F.explode("info.pdb").alias("name")).filter(F.col("name").isin("P0000", "P0002"))
    return filters.restrict_to_lists(p, names, pdbs).select("uniprot1", "chain1", "pos1", "uniprot2", "chain2", "pos2", F.size("info").cast("long").alias("n"))


@job("SELECT uniprot1, chain1, pos1, uniprot2, chain2, pos2 FROM prior, (SELECT list(DISTINCT pdb) AS ok FROM drugs) WHERE len([i FOR i IN info IF NOT list_contains(ok, i.pdb)]) = 0", "prior", "drugs")
def pairs_in_drug_structures(spark: SparkSession, d: str) -> DataFrame:
    return filters.pass_structures(Steps(spark, d).prior(), view(spark, d, "drugs").select(F.col("pdb").alias("name"))).select("uniprot1", "chain1", "pos1", "uniprot2", "chain2", "pos2")


@job("SELECT a.* FROM atoms a JOIN (SELECT pdb, chain, residue_no FROM atoms GROUP BY 1, 2, 3 HAVING count(DISTINCT residue_name) = 1) USING (pdb, chain, residue_no)", "atoms")
def unambiguous_atoms(spark: SparkSession, d: str) -> DataFrame:
    return filters.drop_ambiguous_residues(view(spark, d, "atoms"))


# --- structures --------------------------------------------------------------------------------------------------


@job("SELECT pdb, chain, residue_no, residue_name, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM residues", "residues")
def residue_centroids(spark: SparkSession, d: str) -> DataFrame:
    return Steps(spark, d).residues().select("pdb", "chain", "residue_no", "residue_name", *[F.round(k, 6).alias(k) for k in "xyz"])


@job("SELECT pdb, uniprot, chain, CAST(25 AS INT) AS span FROM base", "base")
def longest_chain(spark: SparkSession, d: str) -> DataFrame:
    return structures.longest_chain(view(spark, d, "chains")).select("pdb", "uniprot", "chain", F.col("span").cast("int").alias("span"))


@job("""WITH c AS (SELECT pdb, uniprot, chain, min(p_start) AS a, max(p_stop + (ascii(chain) * 7 + CAST(substr(pdb, 2, 4) AS INT)) % 5) AS b FROM chains GROUP BY 1, 2, 3)
SELECT pdb, uniprot, arg_min(chain, {'s': -(b - a + 1), 'c': chain}) AS chain, max(b - a + 1) AS span FROM c GROUP BY 1, 2""", "chains")
def longest_chain_of_many(spark: SparkSession, d: str) -> DataFrame:
    """Chains whose spans differ, so that length decides before the name does."""
    longer = F.col("p_stop") + F.pmod(F.ascii("chain") * 7 + F.substring("pdb", 2, 4).cast("int"), F.lit(5))
    return structures.longest_chain(view(spark, d, "chains").withColumn("p_stop", longer))


@job("SELECT pdb, chain, residue_no, uniprot, offset_no FROM placed", "placed")
def residue_offsets(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    return structures.residue_offsets(s.residues(), s.view("chains")).select("pdb", "chain", "residue_no", "uniprot", "offset_no")


@job("SELECT uniprot1, chain1, pos1, off1, name1, uniprot2, chain2, pos2, off2, name2, round(distance, 6) AS distance, pdb FROM prox", "prox")
def residue_distances(spark: SparkSession, d: str) -> DataFrame:
    return Steps(spark, d).prox().withColumn("distance", F.round("distance", 6))


_ATOM = "(sign(q + 0.0005) * floor(round(abs(q + 0.0005) * 1000, 9)) / 1000)"


@job("SELECT pdb, chain1, residue_no1, chain2, residue_no2, round(min((sign(q + 0.0005) * floor(round(abs(q + 0.0005) * 1000, 9)) / 1000)), 6) AS distance FROM (SELECT a.pdb, a.chain AS chain1, a.residue_no AS residue_no1, b.chain AS chain2, b.residue_no AS residue_no2, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS q FROM atoms a JOIN atoms b ON a.pdb = b.pdb AND (a.chain < b.chain OR (a.chain = b.chain AND a.residue_no < b.residue_no))) GROUP BY 1,2,3,4,5 HAVING min((sign(q + 0.0005) * floor(round(abs(q + 0.0005) * 1000, 9)) / 1000)) <= 8", "atoms")
def shortest_residue_distances(spark: SparkSession, d: str) -> DataFrame:
    return structures.shortest_residue_distances(view(spark, d, "atoms"), 8.0).withColumn("distance", F.round("distance", 6))


@job("SELECT pdb, chain, string_agg(l, '' ORDER BY residue_no) AS sequence FROM (SELECT *, substr('ARNDCQEGHILKMFPSTWYV', CAST((position(residue_name IN 'ALAARGASNASPCYSGLNGLUGLYHISILELEULYSMETPHEPROSERTHRTRPTYRVAL') + 2) / 3 AS INT), 1) AS l FROM residues) GROUP BY pdb, chain", "residues")
def chain_sequences(spark: SparkSession, d: str) -> DataFrame:
    return structures.chain_sequence(Steps(spark, d).residues())


@job("SELECT uniprot, spot AS \"at\", count(DISTINCT residue_name) AS n_letters FROM (SELECT uniprot, residue_no + offset_no AS spot, residue_name FROM placed) GROUP BY 1, 2 HAVING count(DISTINCT residue_name) > 1", "placed")
def inconsistent_letters(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    return structures.inconsistent_letters(structures.residue_offsets(s.residues(), s.view("chains"))).select("uniprot", "at", "n_letters")


# --- annotation --------------------------------------------------------------------------------------------------


@job("SELECT uniprot1, chain1, pos1, uniprot2, chain2, pos2, pdb, round(distance, 6) AS distance, round(p_value, 6) AS p_value FROM prox_p", "prox_p")
def empirical_p_values(spark: SparkSession, d: str) -> DataFrame:
    return Steps(spark, d).prox_p().select("uniprot1", "chain1", "pos1", "uniprot2", "chain2", "pos2", "pdb", F.round("distance", 6).alias("distance"), F.round("p_value", 6).alias("p_value"))


@job("SELECT uniprot1, chain1, pos1, uniprot2, chain2, pos2, pdb, feature1, feature2, cosmic1, cosmic2 FROM noted", "noted")
def annotated_pairs(spark: SparkSession, d: str) -> DataFrame:
    return Steps(spark, d).noted().select("uniprot1", "chain1", "pos1", "uniprot2", "chain2", "pos2", "pdb", "feature1", "feature2", "cosmic1", "cosmic2")


@job(f"SELECT uniprot1, chain1, pos1, name1, uniprot2, chain2, pos2, name2, feature1, cosmic2, {INFO} AS info FROM prior", "prior")
def prioritised_pairs(spark: SparkSession, d: str) -> DataFrame:
    return Steps(spark, d).prior().select("uniprot1", "chain1", "pos1", "name1", "uniprot2", "chain2", "pos2", "name2", "feature1", "cosmic2", info_text().alias("info"))


# --- search ------------------------------------------------------------------------------------------------------


@job("SELECT * FROM mut", "mut")
def placed_mutations(spark: SparkSession, d: str) -> DataFrame:
    return Steps(spark, d).mutations().select(*MUT.split(", "), "transcript", "uniprot", "u_pos")


@job(f"SELECT a.gene AS gene1, a.start_pos AS start_pos1, a.aa_change AS aa_change1, b.gene AS gene2, b.start_pos AS start_pos2, b.aa_change AS aa_change2, linear_distance, {INFO} AS info FROM pairs", "pairs")
def mutation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return Steps(spark, d).pairs().select("gene1", "start_pos1", "aa_change1", "gene2", "start_pos2", "aa_change2", "linear_distance", info_text().alias("info"))


def _one_end(what: str) -> str:
    part = lambda n, o: f"SELECT {MUT}, m.uniprot, m.u_pos, h.uniprot{o} AS other_uniprot, h.at{o} AS other_pos, h.{what}{o} AS {what}, linear_distance, {INFO} AS info FROM hits h JOIN mut m ON m.uniprot = uniprot{n} AND m.u_pos = at{n} WHERE {what}{o} <> 'N/A' AND NOT EXISTS (SELECT 1 FROM mut x WHERE x.uniprot = h.uniprot{o} AND x.u_pos = h.at{o})"
    return f"SELECT DISTINCT * FROM ({part(1, 2)} UNION ALL {part(2, 1)})"


@job(_one_end("feature"), "hits", "mut")
def mutation_features(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    return search.mutation_features(s.mutations(), s.prior(), "feature").withColumn("info", info_text())


_OFTEN = """often AS (SELECT gene, chromosome, start_pos, stop_pos, aa_change, transcript FROM maf WHERE regexp_matches(classification, 'Missense|In_Frame') GROUP BY ALL HAVING count(*) >= 10),
kept AS (SELECT mut.* FROM mut JOIN often USING (gene, chromosome, start_pos, stop_pos, aa_change, transcript))"""


@job("WITH " + _OFTEN + ", " + "found AS (" + _one_end("feature").replace("JOIN mut m", "JOIN kept m").replace("FROM mut ", "FROM kept ") + ") SELECT * FROM found", "hits", "mut", "maf")
def recurrent_mutation_features(spark: SparkSession, d: str) -> DataFrame:
    """Calls that recur ten times, next to features at places without such calls."""
    s = Steps(spark, d)
    key = ["gene", "chromosome", "start_pos", "stop_pos", "aa_change", "transcript"]
    often = filters.search_mutations(s.calls()).groupBy(*key).agg(F.sum("n").alias("n")).filter("n >= 10").select(*key)
    return search.mutation_features(s.mutations().join(often, key, "left_semi"), s.prior(), "feature").withColumn("info", info_text())


@job(_one_end("cosmic"), "hits", "mut")
def mutation_cosmic(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    return search.mutation_features(s.mutations(), s.prior(), "cosmic").withColumn("info", info_text())


@job(f"SELECT a.gene AS gene1, a.position AS position1, a.feature AS feature_1, b.gene AS gene2, b.position AS position2, b.feature AS feature_2, chain1, pos1, chain2, pos2, {INFO} AS info FROM (SELECT * RENAME (feature1 AS f1, feature2 AS f2) FROM near) n JOIN spots a ON a.uniprot = uniprot1 AND a.u_pos = at1 JOIN spots b ON b.uniprot = uniprot2 AND b.u_pos = at2", "near", "spots")
def site_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    met = search.site_pairs(s.placed_sites(), s.prior().drop("feature1", "feature2"))
    return met.select("gene1", "position1", F.col("feature1").alias("feature_1"), "gene2", "position2", F.col("feature2").alias("feature_2"), "chain1", "pos1", "chain2", "pos2", info_text().alias("info"))


@job(f"""SELECT DISTINCT * FROM (
 SELECT m.aa_change, m.start_pos, s.gene, s.position, s.feature, {INFO} AS info FROM near n JOIN spots s ON s.uniprot = uniprot1 AND s.u_pos = at1 JOIN mut m ON m.uniprot = uniprot2 AND m.u_pos = at2
 UNION ALL SELECT m.aa_change, m.start_pos, s.gene, s.position, s.feature, {INFO} AS info FROM near n JOIN spots s ON s.uniprot = uniprot2 AND s.u_pos = at2 JOIN mut m ON m.uniprot = uniprot1 AND m.u_pos = at1
 WHERE NOT EXISTS (SELECT 1 FROM spots x WHERE x.uniprot = n.uniprot1 AND x.u_pos = n.at1))""", "near", "spots", "mut")
def mutation_site_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    met = search.mutation_site_pairs(s.mutations(), s.placed_sites(), s.prior().drop("feature1", "feature2"))
    return met.select(F.col("mutation_aa_change").alias("aa_change"), F.col("mutation_start_pos").alias("start_pos"), F.col("site_gene").alias("gene"), F.col("site_position").alias("position"), F.col("site_feature").alias("feature"), info_text().alias("info")).distinct()


@job(f"""SELECT DISTINCT * FROM (
 SELECT s.gene, s.position, uniprot2 AS other_uniprot, at2 AS other_pos, cosmic2 AS cosmic, {INFO} AS info FROM near n JOIN spots s ON s.uniprot = uniprot1 AND s.u_pos = at1 WHERE cosmic2 <> 'N/A'
 UNION ALL SELECT s.gene, s.position, uniprot1, at1, cosmic1, {INFO} AS info FROM near n JOIN spots s ON s.uniprot = uniprot2 AND s.u_pos = at2
 WHERE cosmic1 <> 'N/A' AND NOT EXISTS (SELECT 1 FROM spots x WHERE x.uniprot = n.uniprot1 AND x.u_pos = n.at1))""", "near", "spots")
def site_cosmic(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    met = search.site_features(s.placed_sites(), s.prior().drop("feature1", "feature2"), "cosmic")
    return met.select("gene", "position", "other_uniprot", "other_pos", "cosmic", info_text().alias("info")).distinct()


def _drug(target: str) -> str:
    part = lambda a, b: f"SELECT d.drug, d.drug_id, d.pdb, d.chain AS drug_chain, d.residue_no AS location, {MUT}, chain{b} AS chain, pos{b} AS pos FROM each_info n JOIN drugs d ON n.i.pdb = d.pdb AND d.chain = n.chain{a} AND d.residue_no = n.pos{a} AND d.is_target = {target} JOIN mut m ON m.uniprot = uniprot{b} AND m.u_pos = at{b}"
    return f"WITH each_info AS (SELECT *, unnest(info) AS i FROM near) SELECT DISTINCT * FROM ({part(1, 2)} UNION ALL {part(2, 1)})"


@job(_drug("true"), "near", "drugs", "mut")
def drug_target_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    return search.drug_pairs(s.mutations(), s.prior(), s.view("drugs"), True).drop("info", "linear_distance").distinct()


@job(_drug("false"), "near", "drugs", "mut")
def drug_nontarget_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    return search.drug_pairs(s.mutations(), s.prior(), s.view("drugs"), False).drop("info", "linear_distance").distinct()


@job(_drug("true").replace("SELECT DISTINCT * FROM", "SELECT pdb, drug_chain, location, start_pos, aa_change, chain, pos, array_to_string(list_sort(list(DISTINCT drug)), '|') AS drugs, array_to_string(list_sort(list(DISTINCT drug_id)), '|') AS drug_ids FROM") + " GROUP BY ALL", "near", "drugs", "mut")
def drug_clean(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    return search.drug_clean(search.drug_pairs(s.mutations(), s.prior(), s.view("drugs"), True)).select("pdb", "drug_chain", "location", "start_pos", "aa_change", "chain", "pos", "drugs", "drug_ids")


@job("""WITH e AS (SELECT *, CAST(regexp_extract(aa_change, '(\\d+)', 1) AS BIGINT) AS pos FROM maf WHERE classification IN ('Missense_Mutation', 'In_Frame_Ins', 'In_Frame_Del')), h AS (SELECT s.uniprot FROM e JOIN segments s ON e.transcript = s.transcript AND pos BETWEEN t_begin AND t_end)
SELECT (SELECT count(*) FROM maf) AS n_calls, (SELECT count(*) FROM e) AS n_expected, CAST(0 AS BIGINT) AS n_unexpected_format, (SELECT count(DISTINCT transcript) FROM e) AS n_transcripts, (SELECT count(*) FROM h) AS n_mapped, (SELECT count(DISTINCT uniprot) FROM h) AS n_proteins""", "maf", "segments")
def search_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.search_stats(view(spark, d, "maf"), view(spark, d, "segments"))


# --- graph -------------------------------------------------------------------------------------------------------


@job("SELECT * FROM weights", "weights")
def mutation_weights(spark: SparkSession, d: str) -> DataFrame:
    return Steps(spark, d).weights()


@job("SELECT gene || ':' || chromosome || ':' || start_pos || ':' || stop_pos AS mutation_key, ref || ':' || alt AS ref_alt, transcript || ':' || aa_change AS protein_key, gene, arg_max(weight, {'n': line_no, 'w': weight}) AS weight FROM maf WHERE classification <> 'Silent' GROUP BY ALL", "maf")
def last_weights(spark: SparkSession, d: str) -> DataFrame:
    return graph.mutation_weights(filters.cluster_mutations(view(spark, d, "maf")), "weight")


@job("SELECT structure, key1, key2, round(distance, 6) AS distance FROM edges", "edges")
def pair_average_distance(spark: SparkSession, d: str) -> DataFrame:
    return Steps(spark, d).edges().withColumn("distance", F.round("distance", 6))


@job("SELECT i.pdb AS structure, key1, key2, round(min(i.distance), 6) AS distance FROM (SELECT key1, key2, unnest(info) AS i FROM links) WHERE i.distance < 10 AND i.p_value < 0.04 GROUP BY ALL", "links")
def pair_shortest_distance(spark: SparkSession, d: str) -> DataFrame:
    return graph.pair_distance(Steps(spark, d).links(), "shortest", structure_dependent=True, max_distance=10.0, max_p=0.04).withColumn("distance", F.round("distance", 6))


@job("SELECT 'any' AS structure, key1, key2, round(min(info[1].distance), 6) AS distance FROM links WHERE info[1].distance < 10 GROUP BY key1, key2", "links")
def pair_first_distance(spark: SparkSession, d: str) -> DataFrame:
    """Shortest distances where structures do not matter: the first info of a row alone counts."""
    return graph.pair_distance(Steps(spark, d).links(), "shortest", max_distance=10.0).withColumn("distance", F.round("distance", 6))


@job("WITH p AS (SELECT DISTINCT mutation_key, split_part(protein_key, ':', 1) AS t, regexp_extract(protein_key, 'p\\.\\D\\D*(\\d+)', 1) AS pos FROM weights) SELECT DISTINCT a.mutation_key AS key1, b.mutation_key AS key2 FROM p a JOIN p b ON a.t = b.t AND a.pos = b.pos AND a.mutation_key < b.mutation_key", "weights")
def same_site_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.same_site_pairs(Steps(spark, d).weights())


@job("""WITH RECURSIVE place AS (SELECT DISTINCT gene, mutation_key AS key, split_part(protein_key, ':', 1) AS t, regexp_extract(protein_key, 'p\\.\\D\\D*(\\d+)', 1) AS pos FROM weights), site AS (SELECT DISTINCT gene, key FROM place),
twin AS (SELECT DISTINCT p.gene, p.key, q.key AS other FROM place p JOIN place q ON p.gene = q.gene AND p.t = q.t AND p.pos = q.pos AND p.pos <> '' UNION SELECT gene, key, key FROM site),
hold AS MATERIALIZED (SELECT gene, key, list(other) AS keys FROM twin GROUP BY 1, 2),
walk(gene, step, head, members, rest) AS (SELECT gene, 0, CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]), list(key ORDER BY key) FROM site GROUP BY gene UNION ALL
  SELECT walk.gene, step + 1, rest[1], list_filter(rest, lambda x: list_contains(keys, x)), list_filter(rest, lambda x: NOT list_contains(keys, x)) FROM walk JOIN hold ON hold.gene = walk.gene AND hold.key = rest[1]),
onto AS (SELECT gene, head AS survivor, unnest(members) AS mutation_key FROM walk WHERE step > 0), met AS (SELECT * FROM weights JOIN onto USING (gene, mutation_key)),
own AS (SELECT gene, survivor, max({'w': weight, 'r': ref_alt, 'p': protein_key}) AS m FROM met WHERE mutation_key = survivor GROUP BY 1, 2),
one AS (SELECT gene, survivor, sum(w) AS weight FROM (SELECT gene, survivor, mutation_key, ref_alt, max(weight) AS w FROM met GROUP BY ALL) GROUP BY 1, 2)
SELECT gene, survivor AS mutation_key, m.r AS ref_alt, m.p AS protein_key, weight FROM own JOIN one USING (gene, survivor)""", "weights")
def representative_sites(spark: SparkSession, d: str) -> DataFrame:
    return graph.representative_sites(Steps(spark, d).weights(), "density")


@job("""WITH RECURSIVE b AS (SELECT key1 AS x, key2 AS y FROM edges UNION SELECT key2, key1 FROM edges), r(x, y) AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x), low AS (SELECT x AS key, least(x, min(y)) AS low FROM r GROUP BY x)
SELECT 'any' AS structure, key, CAST(dense_rank() OVER (ORDER BY low) - 1 AS INT) AS super_id FROM low""", "edges")
def super_clusters(spark: SparkSession, d: str) -> DataFrame:
    return graph.super_clusters(Steps(spark, d).edges())


#: Paths this long add less than the last bit of a double to a closeness score that a weight of one is part of.
FADED = 60.0


class Network:
    """Clusters of the whole chain; edges are cut once because four steps read them. ``reach``: longest path, none for all."""

    def __init__(self, spark: SparkSession, d: str, reach: float | None = None) -> None:
        s = Steps(spark, d)
        self.edges, self.weights = cut(s.edges()), cut(s.weights())
        self.components = cut(graph.super_clusters(self.edges))
        self.verts = graph.vertices(self.weights)
        self.geo = cut(graph.geodesics(self.edges, graph.same_site_pairs(self.weights), self.components, reach))

    @cached_property
    def scores(self) -> DataFrame:
        """Closeness; read more than once, and not at all by what scores otherwise."""
        return cut(graph.vertex_scores(self.geo, self.verts))

    def rows(self) -> DataFrame:
        return graph.cluster_rows(graph.radius_clusters(self.scores, self.geo), self.scores, graph.degree(self.geo, self.verts), self.verts)


#: Shortest paths by recursion: a pair is bettered as long as a further edge makes it shorter.
_GEO = """WITH RECURSIVE link AS (SELECT key1 AS x, key2 AS y, distance AS w FROM edges), b AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(x, y) AS (SELECT x, y FROM b UNION SELECT reach.x, b.y FROM reach JOIN b ON reach.y = b.x), low AS (SELECT x AS key, least(x, min(y)) AS low FROM reach GROUP BY x),
comp AS MATERIALIZED (SELECT key, CAST(dense_rank() OVER (ORDER BY low) - 1 AS INT) AS super_id FROM low),
place AS (SELECT DISTINCT mutation_key AS key, split_part(protein_key, ':', 1) AS t, regexp_extract(protein_key, 'p\\.\\D\\D*(\\d+)', 1) AS pos FROM weights),
zero AS (SELECT DISTINCT p.key AS x, q.key AS y, 0.0 AS w FROM place p JOIN place q ON p.t = q.t AND p.pos = q.pos AND p.key <> q.key JOIN comp c ON c.key = p.key JOIN comp e ON e.key = q.key AND e.super_id = c.super_id WHERE p.pos <> ''),
arc AS MATERIALIZED (SELECT x, y, min(w) AS w FROM (SELECT x, y, w FROM link UNION ALL SELECT y, x, w FROM link UNION ALL SELECT x, y, w FROM zero) GROUP BY x, y),
path(a, b, d) USING KEY (a, b) AS (SELECT key, key, CAST(0 AS DOUBLE) FROM comp UNION
  SELECT p.a, arc.y, min(p.d + arc.w) FROM path p JOIN arc ON p.b = arc.x LEFT JOIN recurring.path o ON o.a = p.a AND o.b = arc.y WHERE o.d IS NULL OR p.d + arc.w < o.d GROUP BY p.a, arc.y),
geo AS MATERIALIZED (SELECT super_id, a AS key1, b AS key2, d AS geodesic FROM path JOIN comp ON key = a),
vert AS MATERIALIZED (SELECT mutation_key AS key, ref_alt, arg_min(weight, protein_key) AS weight, arg_min(gene, protein_key) AS gene, min(protein_key) AS protein_key, array_to_string(list_sort(list(DISTINCT protein_key))[2:], '|') AS alternatives FROM weights GROUP BY 1, 2)"""
_SCORE = """score AS MATERIALIZED (SELECT super_id, key1 AS key, a.ref_alt, sum(CASE WHEN key1 <> key2 THEN b.weight / pow(2, geodesic) WHEN a.ref_alt = b.ref_alt THEN b.weight - 1 ELSE b.weight END) AS score
FROM geo JOIN vert a ON a.key = key1 JOIN vert b ON b.key = key2 GROUP BY ALL),
degree AS (SELECT key1 AS key, count(*) AS degree FROM geo JOIN vert b ON b.key = key2 WHERE geodesic < 10 GROUP BY 1)"""
#: The best vertex left takes all that are left within 10, until one finds none.
_SEARCH = """best AS (SELECT super_id, key, -round(max(abs(score)), 9) AS r FROM score GROUP BY 1, 2),
ball AS MATERIALIZED (SELECT key1 AS key, list(key2) AS keys FROM geo JOIN best ON best.key = key2 WHERE geodesic <= 10 GROUP BY 1),
search(super_id, step, centroid, members, rest) AS (SELECT super_id, 0, CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]), list(key ORDER BY r, key) FROM best GROUP BY super_id UNION ALL
  SELECT super_id, step + 1, rest[1], list_filter(rest, lambda x: list_contains(keys, x)), list_filter(rest, lambda x: NOT list_contains(keys, x)) FROM search JOIN ball ON ball.key = rest[1] WHERE step = 0 OR len(members) > 1),
found AS (SELECT super_id, CAST(step - 1 AS INT) AS sub_id, centroid, unnest(members) AS key FROM search WHERE step > 0)"""


@job(f"{_GEO} SELECT 'any' AS structure, super_id, key1, key2, round(geodesic, 6) AS geodesic FROM geo", "edges", "weights")
def geodesics(spark: SparkSession, d: str) -> DataFrame:
    return Network(spark, d).geo.withColumn("geodesic", F.round("geodesic", 6))


@job(f"{_GEO} SELECT 'any' AS structure, super_id, key1, key2, round(geodesic, 6) AS geodesic FROM geo WHERE geodesic <= 12", "edges", "weights")
def near_geodesics(spark: SparkSession, d: str) -> DataFrame:
    """Paths up to 12, relaxed in stretches of 6: what radius clusters and degrees of a large component need."""
    s = Steps(spark, d)
    edges, weights = cut(s.edges()), cut(s.weights())
    found = graph.geodesics(edges, graph.same_site_pairs(weights), graph.super_clusters(edges), 12.0, 6.0)
    return found.withColumn("geodesic", F.round("geodesic", 6))


@job(f"{_GEO}, {_SCORE} SELECT 'any' AS structure, super_id, key, ref_alt, round(score, 6) AS score FROM score", "edges", "weights")
def vertex_scores(spark: SparkSession, d: str) -> DataFrame:
    return Network(spark, d, FADED).scores.withColumn("score", F.round("score", 6))


@job(f"{_GEO} SELECT 'any' AS structure, super_id, key1 AS key, a.ref_alt, round(sum(b.weight * exp(abs(b.weight / 20) - geodesic / 10)), 6) AS score FROM geo JOIN vert a ON a.key = key1 JOIN vert b ON b.key = key2 GROUP BY ALL", "edges", "weights")
def exponential_scores(spark: SparkSession, d: str) -> DataFrame:
    n = Network(spark, d)
    return graph.vertex_scores(n.geo, n.verts, score="exponentials").withColumn("score", F.round("score", 6))


@job(f"""{_GEO}, {_SCORE}, {_SEARCH} SELECT f.super_id || '.' || sub_id AS cluster, 'any' AS structure, f.super_id, sub_id, v.gene, split_part(v.protein_key, ':', 2) AS mutation, degree, round(score, 6) AS score, round(geodesic, 6) AS geodesic, v.weight,
split_part(f.key, ':', 2) AS chromosome, split_part(f.key, ':', 3) AS start, split_part(f.key, ':', 4) AS stop, split_part(v.ref_alt, ':', 1) AS ref, split_part(v.ref_alt, ':', 2) AS alt, split_part(v.protein_key, ':', 1) AS transcript, alternatives, f.key
FROM found f JOIN geo ON key1 = centroid AND key2 = f.key JOIN vert v ON v.key = f.key JOIN score s ON s.key = f.key AND s.ref_alt = v.ref_alt JOIN degree g ON g.key = f.key""", "edges", "weights")
def network_clusters(spark: SparkSession, d: str) -> DataFrame:
    return Network(spark, d, FADED).rows().withColumn("score", F.round("score", 6)).withColumn("geodesic", F.round("geodesic", 6))


@job(f"""{_GEO}, {_SCORE}, {_SEARCH}, line AS (SELECT f.super_id, sub_id, v.gene, split_part(v.protein_key, ':', 2) AS mutation, v.ref_alt, f.key FROM found f JOIN vert v ON v.key = f.key)
SELECT CAST(row_number() OVER (ORDER BY super_id, sub_id, gene, mutation, split_part(ref_alt, ':', 1), split_part(ref_alt, ':', 2), key) AS BIGINT) AS line, super_id, sub_id, gene, mutation, ref_alt, key FROM line""", "edges", "weights")
def sorted_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The written order of cluster rows: numbers are taken from the sorted rows as they come, file by file and line by line."""
    rows = graph.sort_clusters(Network(spark, d, FADED).rows())
    return readers.line_numbers(rows).select("line", "super_id", "sub_id", "gene", "mutation", F.concat_ws(":", "ref", "alt").alias("ref_alt"), "key")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return cut(Network(spark, d, FADED).rows()).withColumn("weight_is_recurrence", F.lit(True)).withColumn("line_no", F.xxhash64("cluster", "key", "ref", "alt"))


@job()
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.cluster_summary(_clusters(spark, d))


@job("""WITH r AS (SELECT gene AS cluster, gene, aa_change AS mutation, start_pos % 7 + 1 AS degree, 1.0 / (1 + start_pos % 11) AS score, start_pos % 13 AS geodesic, CAST(count(*) AS DOUBLE) AS weight, chromosome, start_pos AS start, stop_pos AS stop, ref, alt, transcript FROM maf WHERE classification <> 'Silent' GROUP BY ALL
UNION ALL SELECT gene, gene, 'p.' || letter || position, 2, 0.25, 3, 1, NULL, position, position, '-', 'ptm', transcript FROM sites WHERE letter IS NOT NULL
UNION ALL SELECT 'G' || residue_no % 10, drug, 'G' || residue_no % 10, 3, 0.5, 5, 1, NULL, residue_no, residue_no, NULL, NULL, NULL FROM drugs),
k AS (SELECT *, CASE WHEN mutation NOT LIKE '%p.%' THEN 'drug' WHEN alt = 'ptm' THEN 'site' ELSE 'mutation' END AS kind FROM r),
c AS (SELECT *, gene || ':' || mutation AS protein, concat_ws(':', gene, chromosome, start, stop, ref, alt) AS genomic, regexp_extract(mutation, 'p\\.\\D*(\\d+)', 1) AS place, concat_ws(':', gene, mutation, transcript) AS line_no FROM k),
g AS (SELECT cluster, string_agg(gene || '(' || n || ')', ',' ORDER BY gene) AS genes FROM (SELECT cluster, gene, count(*) AS n FROM c WHERE kind <> 'drug' GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT cluster, string_agg(transcript || '(' || n || ')', ',' ORDER BY transcript) AS transcripts FROM (SELECT cluster, transcript, count(*) AS n FROM c WHERE transcript IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT cluster, arg_max(CASE kind WHEN 'drug' THEN gene ELSE protein END, line_no) FILTER (geodesic = 0) AS centroid, round(sum(score), 6) AS score_sum, sum(weight) FILTER (kind = 'mutation') AS recurrence_mass, round(sum(score) / sum(weight), 6) AS score_mean,
round(avg(weight) FILTER (kind = 'mutation'), 6) AS mean_recurrence, round(sum(degree) / sum(weight), 6) AS mean_degree, round(sum(geodesic) / sum(weight), 6) AS mean_geodesic, nullif(count(DISTINCT gene) FILTER (kind <> 'drug'), 0) AS n_genes, sum(weight) AS n_vertices,
nullif(count(DISTINCT genomic) FILTER (kind = 'mutation'), 0) AS n_genomic, nullif(count(DISTINCT protein) FILTER (kind = 'mutation'), 0) AS n_protein, nullif(count(DISTINCT protein) FILTER (kind = 'site'), 0) AS n_sites, nullif(count(DISTINCT place) FILTER (kind <> 'drug'), 0) AS n_positions, nullif(count(DISTINCT gene) FILTER (kind = 'drug'), 0) AS n_drugs,
string_agg(DISTINCT genomic, ',' ORDER BY genomic) FILTER (kind = 'mutation') AS genomic_mutations, string_agg(DISTINCT protein, ',' ORDER BY protein) FILTER (kind = 'mutation') AS protein_mutations, string_agg(DISTINCT protein, ',' ORDER BY protein) FILTER (kind = 'site') AS protein_sites,
string_agg(DISTINCT place, ',' ORDER BY place) FILTER (kind <> 'drug') AS positions, string_agg(DISTINCT gene, ',' ORDER BY gene) FILTER (kind = 'drug') AS drugs FROM c GROUP BY cluster)
SELECT s.*, genes, transcripts FROM s LEFT JOIN g USING (cluster) LEFT JOIN t USING (cluster)""", "maf", "sites", "drugs")
def gene_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary over genes as clusters, with mutations, sites and drugs in them, so that SQL can build its rows too."""
    s, none = Steps(spark, d), F.lit(None).cast("string")
    cols = "cluster gene mutation degree score geodesic weight chromosome start stop ref alt transcript".split()
    at = lambda m: F.pmod("start_pos", F.lit(m))
    calls = s.view("maf").filter("classification <> 'Silent'").groupBy("gene", "aa_change", "chromosome", "start_pos", "stop_pos", "ref", "alt", "transcript").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    calls = calls.select("gene", "gene", "aa_change", at(7) + 1, 1.0 / (1 + at(11)), at(13), "weight", "chromosome", "start_pos", "stop_pos", "ref", "alt", "transcript").toDF(*cols)
    spot, one = F.col("position").cast("long"), F.lit(1.0)
    sites = s.view("sites").filter("letter is not null").select("gene", "gene", F.concat(F.lit("p."), "letter", "position"), F.lit(2).cast("long"), F.lit(0.25), F.lit(3).cast("long"), one, none, spot, spot, F.lit("-"), F.lit("ptm"), "transcript").toDF(*cols)
    of, spot = F.concat(F.lit("G"), F.pmod("residue_no", F.lit(10)).cast("string")), F.col("residue_no").cast("long")
    drugs = s.view("drugs").select(of, "drug", of, F.lit(3).cast("long"), F.lit(0.5), F.lit(5).cast("long"), one, none, spot, spot, none, none, none).toDF(*cols)
    rows = calls.unionByName(sites).unionByName(drugs).withColumn("weight_is_recurrence", F.lit(True)).withColumn("line_no", F.concat_ws(":", "gene", "mutation", "transcript"))
    out = report.cluster_summary(rows)
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("mean_") or c.startswith("score_") else F.col(c) for c in out.columns])


# --- density -----------------------------------------------------------------------------------------------------


class Density:
    def __init__(self, spark: SparkSession, d: str, runs: int = 1) -> None:
        s = Steps(spark, d)
        self.edges = cut(s.edges())
        self.weights = graph.vertices(s.weights()).groupBy(F.col("mutation_key").alias("key")).agg(F.sum("weight").alias("weight"))
        self.order = cut(density.optics_order(self.edges, self.weights, runs=runs, same_site=graph.same_site_pairs(s.weights())))


@job("""WITH v AS (SELECT mutation_key, ref_alt, arg_min(weight, protein_key) AS weight FROM weights GROUP BY 1, 2), w AS (SELECT mutation_key AS key, sum(weight) AS weight FROM v GROUP BY 1), b AS (SELECT key1, key2, distance FROM edges UNION ALL SELECT key2, key1, distance FROM edges), s AS (SELECT * FROM b UNION ALL SELECT DISTINCT key1, key1, 0.0 FROM b),
c AS (SELECT key1, distance, sum(weight) OVER (PARTITION BY key1 ORDER BY distance RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM s JOIN w ON w.key = s.key2)
SELECT 'any' AS structure, key1 AS key, round(min(distance), 6) AS core_distance FROM c WHERE total >= 40 GROUP BY key1""", "weights", "edges")
def core_vertices(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    w = graph.vertices(s.weights()).groupBy(F.col("mutation_key").alias("key")).agg(F.sum("weight").alias("weight"))
    return density.core_vertices(s.edges(), w, min_pts=40.0).withColumn("core_distance", F.round("core_distance", 6))


@job()
def optics_order(spark: SparkSession, d: str) -> DataFrame:
    return Density(spark, d).order.withColumn("rd", F.round("rd", 6))


@job()
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return density.density_clusters(Density(spark, d).order).withColumn("density", F.round("density", 6))


@job()
def reachability_islands(spark: SparkSession, d: str) -> DataFrame:
    return density.reachability_islands(Density(spark, d).order, 3.0)


@job()
def membership_probability(spark: SparkSession, d: str) -> DataFrame:
    n = Density(spark, d, runs=10)
    return density.membership_probability(n.order, density.density_clusters(n.order.filter("run = 0")))


@job()
def probable_clusters(spark: SparkSession, d: str) -> DataFrame:
    n = Density(spark, d, runs=10)
    found = density.membership_probability(n.order, density.density_clusters(n.order.filter("run = 0")))
    return density.probable_clusters(found, graph.same_site_pairs(Steps(spark, d).weights()), 70.0)


@job("""WITH p AS (SELECT gene AS component, CAST(position % 3 AS INT) AS super_id, CAST(position % 2 AS INT) AS level, CAST(1 AS INT) AS sub_id, gene || ':' || position AS key, count(*) AS hits, CAST(20 AS BIGINT) AS runs FROM sites GROUP BY gene, position),
kept AS (SELECT * FROM p WHERE hits * 100 >= runs * 60), twin AS (SELECT DISTINCT gene || ':' || position AS key, gene || ':' || (position + 1) AS other FROM sites), pairs2 AS (SELECT key, other FROM twin UNION SELECT other, key FROM twin)
SELECT component, super_id, level, sub_id, key FROM kept UNION SELECT component, super_id, level, sub_id, other FROM kept JOIN pairs2 USING (key)""", "sites")
def probable_members(spark: SparkSession, d: str) -> DataFrame:
    """The cut at a probability over counts that SQL can build: places listed often enough, and the place behind or before each."""
    s = view(spark, d, "sites")
    at = F.col("position")
    p = s.groupBy("gene", "position").agg(F.count(F.lit(1)).alias("hits")).select(
        F.col("gene").alias("component"), F.pmod(at, F.lit(3)).alias("super_id"), F.pmod(at, F.lit(2)).alias("level"), F.lit(1).alias("sub_id"),
        F.concat_ws(":", "gene", "position").alias("key"), "hits", F.lit(20).cast("long").alias("runs"),
    )
    twin = s.select(F.concat_ws(":", "gene", "position").alias("key1"), F.concat_ws(":", F.col("gene"), at + 1).alias("key2")).distinct()
    return density.probable_clusters(p, twin, 60.0)


_BARS = """bars AS (SELECT structure, n - 1 AS ord, CASE WHEN n = 1 OR k % 23 = 0 THEN CAST(10 AS DOUBLE) ELSE 7 + CAST(CAST(floor(price) AS BIGINT) % 25 AS DOUBLE) / 10 END AS rd, CAST(CASE WHEN k % 5 = 0 THEN 4 ELSE 1 END AS DOUBLE) AS weight
FROM (SELECT 's' || CAST(o_custkey % 40 AS STRING) AS structure, o_orderkey AS k, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS n FROM {orders}))"""


@job(f"""WITH RECURSIVE {_BARS.format(orders="orders")}, parted AS (SELECT *, sum(CASE WHEN rd >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY structure ORDER BY ord) AS part FROM bars),
sup AS (SELECT *, CAST(row_number() OVER (PARTITION BY structure ORDER BY s) - 1 AS INT) AS super_id FROM (SELECT structure, part, min(ord) AS s, max(ord) AS e, count(*) AS n, coalesce(min(rd) FILTER (rd < 10), 10) AS low,
  arg_max(rd, ord) AS top, sum(weight) AS total, coalesce(sum(rd) FILTER (rd < 10), 0) AS total_rd FROM parted GROUP BY structure, part HAVING sum(weight) >= 4)),
cuts AS (SELECT sup.*, i, low + i * CAST(0.1 AS DOUBLE) AS cut_at FROM sup, range(0, 60) r(i) WHERE low + i * CAST(0.1 AS DOUBLE) <= (CASE WHEN n >= 3 THEN top ELSE 10 END) + 0.5),
below AS (SELECT structure, super_id, i, cut_at, ord, rd, weight, sum(CASE WHEN rd >= cut_at OR ord = s THEN 1 ELSE 0 END) OVER (PARTITION BY structure, super_id, i ORDER BY ord) AS k FROM cuts JOIN parted USING (structure, part)),
t AS MATERIALIZED (SELECT structure, super_id, i, cut_at, min(ord) AS first, max(ord) AS last, CASE WHEN count(*) = 1 THEN 0.1 ELSE (sum(rd * weight) - arg_min(rd * weight, ord)) / (sum(weight) - arg_min(weight, ord)) END AS density
  FROM below GROUP BY structure, super_id, i, cut_at, k HAVING sum(weight) >= 4 AND (count(*) > 1 OR i = 0)),
n AS MATERIALIZED (SELECT structure, super_id, i, count(*) AS n, count(*) FILTER (last > first) AS wide FROM t GROUP BY ALL),
held AS (SELECT x.structure, x.super_id, y.i AS cur, x.i AS nxt, x.first, any_value(x.last - x.first) AS len, min(y.last - y.first) AS inner_len FROM t x JOIN t y ON x.structure = y.structure AND x.super_id = y.super_id AND y.i < x.i
  AND y.last > y.first AND x.last > x.first AND y.first >= x.first AND y.last <= x.last GROUP BY ALL),
h AS (SELECT structure, super_id, cur, nxt, count(*) AS holding, bool_or(len >= 2 * inner_len) AS grown FROM held GROUP BY ALL),
nxt AS MATERIALIZED (SELECT a.structure, a.super_id, a.i AS cur, min(b.i) AS i FROM n a JOIN n b ON a.structure = b.structure AND a.super_id = b.super_id AND b.i > a.i LEFT JOIN h ON h.structure = a.structure AND h.super_id = a.super_id AND h.cur = a.i AND h.nxt = b.i
  WHERE a.n <> b.n OR (a.wide > 0 AND (coalesce(h.grown, false) OR b.wide > coalesce(h.holding, 0))) GROUP BY ALL),
lev(structure, super_id, i, level) AS (SELECT structure, super_id, min(i), 1 FROM n GROUP BY 1, 2 UNION ALL SELECT lev.structure, lev.super_id, nxt.i, level + 1 FROM lev JOIN nxt ON nxt.structure = lev.structure AND nxt.super_id = lev.super_id AND nxt.cur = lev.i),
found AS MATERIALIZED (SELECT t.*, level, CAST(row_number() OVER (PARTITION BY structure, super_id, level ORDER BY first) AS INT) AS sub_id FROM t JOIN lev USING (structure, super_id, i)),
under AS (SELECT f.structure, f.super_id, f.level, f.sub_id, string_agg(g.super_id || '.' || g.level || '.' || g.sub_id, ':' ORDER BY g.sub_id) AS ids FROM found f JOIN found g ON g.structure = f.structure AND g.super_id = f.super_id AND g.level = f.level - 1
  AND g.first >= f.first AND g.last <= f.last GROUP BY ALL)
SELECT structure, super_id, level, sub_id, first, last, round(cut_at, 6) AS cut, round(density, 9) AS density, CASE WHEN level = 1 THEN '1' ELSE coalesce(ids, '2') END AS covering FROM found LEFT JOIN under USING (structure, super_id, level, sub_id)
UNION ALL SELECT structure, super_id, 0, 0, s, e, 9.9, round(CASE WHEN total_rd = 0 THEN 0.1 ELSE total_rd / total END, 9), '0' FROM sup""")
def density_levels(spark: SparkSession, d: str) -> DataFrame:
    """Nested levels of orders that SQL can build and cut: prices as bars."""
    bars = spark.sql(f"WITH {_BARS} SELECT * FROM bars", orders=spark.read.parquet(f"{d}/orders.parquet"))
    order = bars.select("structure", F.lit(0).alias("run"), F.lit("c").alias("component"), F.col("ord").cast("long").alias("ord"), F.col("ord").cast("string").alias("key"), "rd", F.col("rd").alias("cd"), "weight")
    found = density.density_clusters(order)
    return found.select("structure", "super_id", "level", "sub_id", "first", "last", F.round("cut", 6).alias("cut"), F.round("density", 9).alias("density"), "covering")


# --- statistics --------------------------------------------------------------------------------------------------


def _pair_rows(s: Steps) -> DataFrame:
    return s.pairs().select("gene1", F.col("aa_change1").alias("mutation1"), "gene2", F.col("aa_change2").alias("mutation2"), "linear_distance", "info", F.xxhash64("start_pos1", "aa_change1", "start_pos2", "aa_change2").alias("line_no"))


def _gene_clusters(s: Steps) -> DataFrame:
    """Genes as clusters: gives the statistics steps a cluster table that SQL can build too."""
    return s.calls().filter("classification <> 'Silent'").groupBy(F.col("gene").alias("cluster"), "gene", F.col("aa_change").alias("mutation")).agg(F.sum("n").cast("double").alias("weight"))


_MEMBERS = "m AS (SELECT gene AS cluster, gene, aa_change AS mutation, CAST(count(*) AS DOUBLE) AS weight FROM maf WHERE classification <> 'Silent' GROUP BY gene, aa_change), p AS (SELECT a.gene AS gene1, a.aa_change AS mutation1, b.gene AS gene2, b.aa_change AS mutation2, unnest(info) AS i FROM pairs)"


@job(f"""WITH {_MEMBERS}, best AS (SELECT gene1 AS cluster, min(i.pdb) AS pdb FROM p GROUP BY 1), t AS (SELECT cluster, CAST(sum(floor(weight)) AS BIGINT) AS mass FROM m GROUP BY 1),
s AS (SELECT m1.cluster, sum(m1.weight * m2.weight * i.distance) AS d, round(min({{'d': i.distance, 'p': i.p_value}}).p, 6) AS pair_p FROM p JOIN m m1 ON m1.gene = gene1 AND m1.mutation = mutation1 JOIN m m2 ON m2.gene = gene2 AND m2.mutation = mutation2 AND m1.cluster = m2.cluster JOIN best b ON b.cluster = m1.cluster AND b.pdb = i.pdb GROUP BY 1)
SELECT cluster, round(coalesce(d, 0), 4) AS distance_sum, mass, mass * (mass - 1) / 2 AS n_pairs, pair_p FROM t LEFT JOIN s USING (cluster)""", "maf", "pairs")
def within_cluster_distance(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    m = _gene_clusters(s)
    pairs = cut(_pair_rows(s))
    best = pairs.select(F.col("gene1").alias("cluster"), F.explode("info.pdb").alias("pdb")).groupBy("cluster").agg(F.min("pdb").alias("pdb"))
    return stats.within_cluster_distance(m, pairs, best).withColumn("distance_sum", F.round("distance_sum", 4)).withColumn("pair_p", F.round("pair_p", 6))


@job("""WITH r AS (SELECT uniprot1 AS cluster, CASE WHEN (chain1, pos1) <= (chain2, pos2) THEN chain1 || ':' || pos1 || '/' || chain2 || ':' || pos2 ELSE chain2 || ':' || pos2 || '/' || chain1 || ':' || pos1 END AS k, chain1, pos1, distance FROM prox p WHERE uniprot1 = uniprot2 AND pdb = (SELECT min(pdb) FROM prox q WHERE q.uniprot1 = p.uniprot1))
SELECT cluster, count(*) AS n, round(sum(distance), 4) AS total FROM (SELECT DISTINCT cluster, k, distance FROM r UNION ALL SELECT cluster, chain1 || ':' || pos1, 0.0 FROM (SELECT DISTINCT cluster, chain1, pos1 FROM r)) GROUP BY cluster""", "prox")
def background_distances(spark: SparkSession, d: str) -> DataFrame:
    prox = cut(Steps(spark, d).prox())
    proteins = prox.select(F.col("uniprot1").alias("cluster"), F.col("uniprot1").alias("uniprot"), F.lit(True).alias("is_first")).distinct()
    best = prox.groupBy(F.col("uniprot1").alias("cluster")).agg(F.min("pdb").alias("pdb"))
    return stats.background_distances(prox, proteins, best).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 4).alias("total"))


def _tested(s: Steps) -> tuple[DataFrame, DataFrame]:
    """Observed and background distances of genes as clusters."""
    prox = s.once("prox", s.prox)
    of = F.concat(F.lit("G"), F.substring("uniprot1", 2, 9)).alias("cluster")
    proteins = prox.select(of, F.col("uniprot1").alias("uniprot"), F.lit(True).alias("is_first")).distinct()
    best = prox.groupBy(of).agg(F.min("pdb").alias("pdb"))
    return stats.within_cluster_distance(_gene_clusters(s), _pair_rows(s), best), stats.background_distances(prox, proteins, best)


@job()
def cluster_significance(spark: SparkSession, d: str) -> DataFrame:
    return stats.cluster_significance(*_tested(Steps(spark, d)))


@job()
def site_significance(spark: SparkSession, d: str) -> DataFrame:
    """Simulated and exact p-values of six pairs a gene against all pairs within their reach: none lies so far out that nothing is drawn."""
    s = Steps(spark, d)
    _, background = _tested(s)
    background = cut(background.filter("distance <= 20"))
    pairs = _pair_rows(s).filter("gene1 = gene2").select(F.col("gene1").alias("cluster"), "mutation1", "mutation2", F.explode("info").alias("x"))
    nth = F.row_number().over(W.partitionBy("cluster").orderBy("x.pdb", "mutation1", "mutation2", "x.distance"))
    six = pairs.withColumn("k", nth).filter("k <= 6").groupBy("cluster").agg(F.sum("x.distance").alias("distance_sum"), F.count(F.lit(1)).cast("double").alias("n_pairs"))
    observed = cut(six.withColumn("mass", F.lit(4)))
    exact = stats.exact_significance(observed, background).withColumnRenamed("p_value", "exact_p")
    return stats.cluster_significance(observed, background, 100_000).join(exact, "cluster").select("cluster", "n_sims", F.round("exact_p", 6).alias("exact_p"), F.abs(F.col("p_value") - F.col("exact_p")).alias("apart"))


@job()
def random_sites(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "sites").select("gene", "position")
    return stats.random_sites(p, p.groupBy("gene").agg((F.countDistinct("position") / 2).cast("int").alias("n")), 5)


@job()
def simulated_mafs(spark: SparkSession, d: str) -> DataFrame:
    return stats.simulated_mafs(view(spark, d, "maf"), random_sites(spark, d))


@job("SELECT count(*) AS n, CAST(-20 AS INT) AS lo, CAST(19 AS INT) AS hi FROM maf", "maf")
def random_weights(spark: SparkSession, d: str) -> DataFrame:
    return stats.random_weights(view(spark, d, "maf")).agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("lo"), F.max("weight").alias("hi"))


@job("""WITH p AS (SELECT DISTINCT uniprot, unnest(range(u_start, u_stop + 1)) AS position FROM chains), n AS (SELECT uniprot, count(*) AS n FROM p GROUP BY 1), l AS (SELECT uniprot, CAST(max(u_end) + 10 AS INT) AS length FROM segments GROUP BY 1)
SELECT uniprot, length, coalesce(n, 0) AS n_covered, round(coalesce(n, 0) / length, 6) AS fraction FROM l LEFT JOIN n USING (uniprot)""", "chains", "segments")
def protein_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of each protein that structures cover."""
    s = Steps(spark, d)
    proteins = s.view("segments").groupBy("uniprot").agg((F.max("u_end") + 10).cast("int").alias("length"))
    return stats.structure_coverage(s.view("chains"), proteins, s.mutations().select("uniprot", F.col("u_pos").alias("position")))[0].withColumn("fraction", F.round("fraction", 6))


@job("WITH p AS (SELECT DISTINCT uniprot, pdb, unnest(range(u_start, u_stop + 1)) AS position FROM chains), n AS (SELECT uniprot, position, count(DISTINCT pdb) AS n FROM p GROUP BY 1, 2) SELECT DISTINCT m.uniprot, CAST(m.u_pos AS BIGINT) AS position, coalesce(n, 0) AS depth, coalesce(n, 0) > 0 AS covered FROM mut m LEFT JOIN n ON n.uniprot = m.uniprot AND n.position = m.u_pos", "chains", "mut")
def variant_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    proteins = s.view("segments").select("uniprot", F.lit(40).alias("length")).distinct()
    return stats.structure_coverage(s.view("chains"), proteins, s.mutations().select("uniprot", F.col("u_pos").alias("position")))[1]


@job("WITH s AS (SELECT transcript, gene, count(DISTINCT aa_change) AS positions, count(*) AS variants FROM maf GROUP BY 1, 2), c AS (SELECT 'positions' AS measure, positions AS size FROM s UNION ALL SELECT 'variants', variants FROM s), n AS (SELECT measure, size, count(*) AS n FROM c GROUP BY 1, 2) SELECT measure, size, n, round(n / sum(n) OVER (PARTITION BY measure), 6) AS probability FROM n", "maf")
def cluster_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "maf").select(F.col("transcript").alias("trial"), F.col("gene").alias("cluster"), F.col("aa_change").alias("position"))
    return stats.cluster_size_histogram(rows).withColumn("probability", F.round("probability", 6))


# --- reports -----------------------------------------------------------------------------------------------------

_PE = """e AS (SELECT DISTINCT i.pdb, g, mu, c FROM (SELECT a.gene AS g, a.aa_change AS mu, a.start_pos AS c, unnest(info) AS i FROM pairs UNION ALL SELECT b.gene, b.aa_change, b.start_pos, unnest(info) FROM pairs))"""


def _located(s: Steps) -> DataFrame:
    """Pairs with a chain and residue at both ends; the place on the chromosome stands for the residue."""
    return s.pairs().select("gene1", F.col("aa_change1").alias("mutation1"), F.lit("A").alias("chain1"), F.col("start_pos1").alias("pos1"), "gene2", F.col("aa_change2").alias("mutation2"), F.lit("A").alias("chain2"), F.col("start_pos2").alias("pos2"), "info")


@job(f"WITH {_PE} SELECT pdb, g AS gene, 'A' AS chain, min(c) AS first, max(c) AS last, count(DISTINCT mu) AS n_mutations, count(DISTINCT c) AS n_residues FROM e GROUP BY pdb, g", "pairs")
def gene_structure_presence(spark: SparkSession, d: str) -> DataFrame:
    return report.gene_structure_presence(_located(Steps(spark, d)))


@job(f"WITH {_MEMBERS}, {_PE} SELECT m.cluster, pdb, m.gene, 'A' AS chain, min(c) AS first, max(c) AS last, count(DISTINCT mu) AS n_mutations, count(DISTINCT c) AS n_residues, sum(weight) AS recurrence, array_to_string(list_sort(list(DISTINCT mu)), '|') AS mutations FROM e JOIN m ON m.gene = g AND m.mutation = mu GROUP BY 1, 2, 3", "maf", "pairs")
def structure_presence(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    return report.structure_presence(_gene_clusters(s), _located(s))


@job(f"WITH {_MEMBERS}, {_PE}, t AS (SELECT m.cluster, pdb, sum(weight) AS recurrence FROM e JOIN m ON m.gene = g AND m.mutation = mu GROUP BY 1, 2) SELECT cluster, arg_min(pdb, printf('%020d', CAST(1000000000 - recurrence AS BIGINT)) || pdb) AS pdb, max(recurrence) AS recurrence FROM t GROUP BY cluster", "maf", "pairs")
def best_structure(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    return stats.best_structure(report.structure_presence(_gene_clusters(s), _located(s)))


@job("SELECT uniprot AS gene, count(DISTINCT pdb) AS n_structures FROM chains GROUP BY 1", "chains")
def structures_per_gene(spark: SparkSession, d: str) -> DataFrame:
    return report.structures_per_gene(view(spark, d, "chains").withColumnRenamed("uniprot", "gene"))


@job("SELECT sum(n) AS total, count(*) AS genes, round(avg(n), 6) AS mean FROM (SELECT uniprot, count(DISTINCT pdb) AS n FROM chains GROUP BY 1)", "chains")
def structure_totals(spark: SparkSession, d: str) -> DataFrame:
    return report.structure_totals(structures_per_gene(spark, d)).withColumn("mean", F.round("mean", 6))


@job("SELECT pdb, count(DISTINCT uniprot) AS n, array_to_string(list_sort(list(DISTINCT uniprot)), ' ') AS proteins FROM chains GROUP BY 1 HAVING count(DISTINCT uniprot) > 1", "chains")
def protein_linkage(spark: SparkSession, d: str) -> DataFrame:
    return genes.protein_linkage(view(spark, d, "chains"))


@job("SELECT DISTINCT uniprot FROM chains c WHERE (uniprot, pdb) NOT IN (SELECT uniprot, pdb FROM chains x WHERE chain >= 'C') OR uniprot IN ('U2', 'U7')", "chains")
def proteins_to_refresh(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "chains").select("uniprot", "pdb").distinct()
    known = view(spark, d, "chains").filter("chain >= 'C'").select("uniprot", "pdb").distinct()
    return genes.proteins_to_refresh(c, known, c.select("uniprot").distinct().filter("uniprot not in ('U2', 'U7')"))


@job("SELECT gene1, mutation1, gene2, mutation2, samples1, samples2, \"both\" FROM (WITH n AS (SELECT gene, aa_change AS mutation, sample AS s, count(*) AS n FROM maf GROUP BY 1, 2, 3), l AS (SELECT gene, mutation, list_sort(list(s)) AS names, array_to_string(list_sort(list(s || ':' || n)), '|') AS samples FROM n GROUP BY 1, 2), p AS (SELECT DISTINCT a.gene AS gene1, a.aa_change AS mutation1, b.gene AS gene2, b.aa_change AS mutation2 FROM pairs) SELECT p.*, x.samples AS samples1, y.samples AS samples2, array_to_string(list_sort(list_intersect(x.names, y.names)), '|') AS \"both\" FROM p LEFT JOIN l x ON x.gene = gene1 AND x.mutation = mutation1 LEFT JOIN l y ON y.gene = gene2 AND y.mutation = mutation2)", "maf", "pairs")
def cooccurring_samples(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    return report.cooccurring_samples(_pair_rows(s), s.view("maf"))


@job()
def best_pair_info(spark: SparkSession, d: str) -> DataFrame:
    return report.best_pair_info(_pair_rows(Steps(spark, d))).withColumn("info", info_text())


@job("SELECT gene, count(*) AS frequency_rows, sum(f) AS frequency FROM (SELECT gene, start_pos, ref, alt, count(DISTINCT sample) AS f FROM maf GROUP BY 1, 2, 3, 4) GROUP BY 1", "maf")
def mutation_frequencies(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "maf")
    rows = m.select("gene", F.col("start_pos").cast("string").alias("start"), "ref", "alt").distinct()
    lengths = m.select("gene", "transcript", F.lit(1).alias("length")).distinct()
    return report.annotate_mutations(rows, m, lengths).groupBy("gene").agg(F.count(F.lit(1)).alias("frequency_rows"), F.sum("frequency").alias("frequency"))


@job(f"WITH {_MEMBERS}, {_PE}, t AS (SELECT m.cluster, pdb, m.gene, count(DISTINCT mu) AS nm, count(DISTINCT c) AS nr, sum(weight) AS rec FROM e JOIN m ON m.gene = g AND m.mutation = mu GROUP BY 1, 2, 3) SELECT cluster, pdb, count(*) AS n_chains, count(DISTINCT gene) AS n_genes, sum(nm) AS n_mutations, sum(nr) AS n_residues, sum(rec) AS recurrence, array_to_string(list_sort(list(DISTINCT 'A:' || gene)), '|') AS chains FROM t GROUP BY 1, 2", "maf", "pairs")
def complex_presence(spark: SparkSession, d: str) -> DataFrame:
    return report.complex_presence(structure_presence(spark, d))


@job("SELECT c.* FROM features c WHERE EXISTS (SELECT 1 FROM spots s WHERE s.uniprot = c.uniprot AND s.u_pos BETWEEN c.start_pos AND c.end_pos)", "features", "spots")
def features_at_sites(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    return annotate.features_at(s.view("features"), s.placed_sites().select("uniprot", F.col("u_pos").alias("position")))


@job("SELECT * FROM features WHERE start_pos <= 9 AND end_pos >= 5", "features")
def features_between(spark: SparkSession, d: str) -> DataFrame:
    return annotate.features_between(view(spark, d, "features"), 5, 9)


@job("SELECT * FROM features WHERE end_pos > 15", "features")
def features_after(spark: SparkSession, d: str) -> DataFrame:
    return annotate.features_after(view(spark, d, "features"), 15)


@job("SELECT uniprot, spot AS \"at\", description FROM points", "points")
def feature_points(spark: SparkSession, d: str) -> DataFrame:
    return annotate.feature_points(view(spark, d, "features"))


@job("SELECT uniprot, u_pos, known FROM known", "known")
def cosmic_points(spark: SparkSession, d: str) -> DataFrame:
    return annotate.cosmic_points(view(spark, d, "cosmic"), view(spark, d, "segments"))


_FEATS = "c AS (SELECT DISTINCT gene, aa_change AS mutation, CAST(regexp_extract(aa_change, '(\\d+)', 1) AS INT) AS pos FROM maf), f AS (SELECT gene, mutation, description FROM c JOIN features x ON x.uniprot = 'U' || substr(gene, 2) AND x.start_pos = pos)"


@job(f"WITH {_FEATS}, l AS (SELECT gene, mutation, array_to_string(list_sort(list(DISTINCT split_part(description, ' {{ECO', 1))), '|') AS domains FROM f GROUP BY 1, 2) SELECT c.gene, c.mutation, coalesce(domains, 'NULL') AS domains FROM c LEFT JOIN l ON l.gene = c.gene AND l.mutation = c.mutation", "maf", "features")
def annotate_domains(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "maf").select("gene", F.col("aa_change").alias("mutation"), C.aa_position(F.col("aa_change")).alias("start_pos"), F.concat(F.lit("U"), F.substring("gene", 2, 9)).alias("uniprot")).distinct()
    f = c.join(view(spark, d, "features"), ["uniprot", "start_pos"]).select("gene", "mutation", F.col("description").alias("feature"))
    return report.annotate_domains(c.select("gene", "mutation"), f)


@job("WITH c AS (SELECT DISTINCT gene FROM maf UNION ALL SELECT DISTINCT drug FROM drugs), l AS (SELECT drug, array_to_string(list_sort(list(DISTINCT het)), '|') AS k FROM drugs WHERE is_target GROUP BY 1) SELECT c.gene, CASE WHEN c.gene LIKE 'G_' THEN 'NA' ELSE coalesce(k, 'Unclassified') END AS drug_class FROM c LEFT JOIN l ON l.drug = c.gene", "maf", "drugs")
def annotate_drug_class(spark: SparkSession, d: str) -> DataFrame:
    drugs = view(spark, d, "drugs")
    rows = view(spark, d, "maf").select("gene", F.lit(False).alias("is_drug")).distinct().unionByName(drugs.select(F.col("drug").alias("gene"), F.lit(True).alias("is_drug")).distinct())
    return report.annotate_drug_class(rows, drugs.filter("is_target").select("drug", F.col("het").alias("class"))).select("gene", "drug_class")


@job("WITH c AS (SELECT DISTINCT gene, false AS is_drug FROM maf UNION ALL SELECT DISTINCT drug, is_target FROM drugs), l AS (SELECT 'G' || substr(uniprot, 2) AS gene, array_to_string(list_sort(list(DISTINCT type)), '|') AS families FROM features GROUP BY 1) SELECT c.gene, CASE WHEN is_drug THEN 'NA' ELSE coalesce(families, 'Unclassified') END AS families FROM c LEFT JOIN l USING (gene)", "maf", "features", "drugs")
def annotate_families(spark: SparkSession, d: str) -> DataFrame:
    fam = view(spark, d, "features").select(F.concat(F.lit("G"), F.substring("uniprot", 2, 9)).alias("gene"), F.col("type").alias("family"))
    rows = view(spark, d, "maf").select("gene", F.lit(False).alias("is_drug")).distinct().unionByName(view(spark, d, "drugs").select(F.col("drug").alias("gene"), F.col("is_target").alias("is_drug")).distinct())
    return report.annotate_families(rows, fam).select("gene", "families")


@job("WITH a AS (SELECT 'G' || substr(uniprot, 2) AS gene, list_distinct(list(type)) AS f FROM features GROUP BY 1), e AS (SELECT unnest(f) AS family FROM a) SELECT family, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM a), 6) AS percent FROM e GROUP BY 1", "features")
def family_totals(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "features").groupBy("uniprot").agg(F.collect_set("type").alias("families"))
    return report.family_totals(a).withColumn("percent", F.round("percent", 6))


@job("SELECT gene, chromosome, arg_min(transcript, printf('%012d', 1000000000 - n) || transcript) AS transcript, max(n) AS length FROM (SELECT gene, chromosome, transcript, count(DISTINCT start_pos) AS n FROM maf GROUP BY 1, 2, 3) GROUP BY 1, 2", "maf")
def longest_transcript(spark: SparkSession, d: str) -> DataFrame:
    exons = view(spark, d, "maf").select("gene", "chromosome", "transcript", F.col("start_pos").alias("exon_no"), F.lit(1).alias("length"))
    long = report.longest_transcript(report.transcript_lengths(exons))
    return long.join(exons.select("gene", "chromosome").distinct(), "gene").select("gene", "chromosome", "transcript", "length")


@job("WITH s AS (SELECT transcript, uniprot, repeat(substr('ACDEFGHIKL', CAST(substr(uniprot, 2) AS INT) + 1, 1), CAST(t_end AS INT)) AS q FROM segments) SELECT transcript, uniprot, CAST(1 AS BIGINT) AS t_begin, CAST(length(q) AS BIGINT) AS t_end, CAST(1 AS BIGINT) AS u_begin, CAST(length(q) AS BIGINT) AS u_end FROM s WHERE length(q) = 30", "segments")
def exact_transcript_map(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "segments").withColumn("sequence", F.expr("repeat(substr('ACDEFGHIKL', cast(substr(uniprot, 2) as int) + 1, 1), cast(t_end as int))"))
    return annotate.exact_transcript_map(s.select("uniprot", "transcript", F.rpad(F.substring("sequence", 1, 30), 30, "X").alias("sequence")), s.select(F.concat("transcript", F.lit(".2")).alias("transcript"), "sequence"))


@job("SELECT pdb, uniprot, count(*) FILTER (WHERE residue_name <> 'ALA') AS n_wrong, count(*) AS n_residues, round(count(*) FILTER (WHERE residue_name <> 'ALA') / count(*), 6) AS fraction FROM placed GROUP BY 1, 2", "placed")
def offset_errors(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    sequences = s.view("chains").select("uniprot", F.lit("A" * 30).alias("sequence")).distinct()
    return structures.offset_errors(structures.residue_offsets(s.residues(), s.view("chains")), sequences).withColumn("fraction", F.round("fraction", 6))


@job(f"WITH w AS (SELECT * FROM atoms WHERE chain = 'B' AND residue_no = 3) SELECT pdb, chain1, residue_no1, chain2, residue_no2, round(min({_ATOM}), 6) AS distance FROM (SELECT a.pdb, a.chain AS chain1, a.residue_no AS residue_no1, b.chain AS chain2, b.residue_no AS residue_no2, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS q FROM w a JOIN atoms b ON a.pdb = b.pdb AND NOT (a.chain = b.chain AND a.residue_no = b.residue_no)) GROUP BY 1,2,3,4,5 HAVING min({_ATOM}) <= 12", "atoms")
def residues_near(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "atoms")
    return structures.residues_near(a.filter("chain = 'B' and residue_no = 3"), a, 12.0).withColumn("distance", F.round("distance", 6))


@job("SELECT d.drug, d.pdb, d.chain, d.residue_name AS het, h.location FROM (SELECT drug, pdb, chain, substr('ALAARGASNASPCYSGLUGLNGLYHISILE', (residue_no % 10) * 3 + 1, 3) AS residue_name FROM drugs) d LEFT JOIN (SELECT pdb, chain, residue_name, min(residue_no) AS location FROM atoms GROUP BY 1, 2, 3) h ON h.pdb = d.pdb AND h.chain = d.chain AND h.residue_name = d.residue_name", "drugs", "atoms")
def drug_locations(spark: SparkSession, d: str) -> DataFrame:
    targets = view(spark, d, "drugs").select("drug", "pdb", "chain", F.expr("substr('ALAARGASNASPCYSGLUGLNGLYHISILE', (residue_no % 10) * 3 + 1, 3)").alias("het"))
    return genes.drug_locations(targets, view(spark, d, "atoms").withColumn("line_no", F.col("residue_no"))).select("drug", "pdb", "chain", "het", "location")


@job(f"WITH {_MEMBERS}, x AS ({_drug('true').replace('WITH each_info', 'WITH each_info')}) SELECT m.cluster, x.pdb, x.drug, count(DISTINCT (x.gene, x.aa_change)) AS n_mutations, count(DISTINCT (x.chain, x.pos)) AS n_residues, array_to_string(list_sort(list(DISTINCT x.gene || ':' || x.aa_change)), '|') AS mutations FROM x JOIN m ON m.gene = x.gene AND m.mutation = x.aa_change GROUP BY 1, 2, 3", "maf", "pairs", "near", "drugs", "mut")
def drug_structure_presence(spark: SparkSession, d: str) -> DataFrame:
    s = Steps(spark, d)
    pairs = search.drug_pairs(s.mutations(), s.prior(), s.view("drugs"), True).withColumnRenamed("aa_change", "mutation")
    return report.drug_structure_presence(_gene_clusters(s), pairs)
