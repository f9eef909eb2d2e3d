"""Summaries of clusters and pairs, and columns added to cluster rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mutprox.functions import columns as C
from mutprox.session import cut

#: Bytes of all lists of samples up to which they are broadcast.
LISTS = 256 << 20


def _names(c: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(c)), "|")


def _tally(df: DataFrame, by: str, column: str, out: str) -> DataFrame:
    """``name(rows)`` lists, sorted by name."""
    each = df.filter(F.col(column).isNotNull()).groupBy(by, column).agg(F.count(F.lit(1)).alias("n"))
    item = F.concat(F.col(column).cast("string"), F.lit("("), F.col("n").cast("string"), F.lit(")"))
    return each.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), item.alias("v")))), lambda x: x["v"]), ",").alias(out))


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """One row for each cluster, from its rows (cluster, gene, mutation, degree, score, geodesic, weight, chromosome, start, stop, ref, alt, transcript, weight_is_recurrence, line_no).

    22 columns: the centroid (the last row at geodesic 0), the sum of scores, mass and mean mass of the mutations, means of
    score, degree and geodesic over the vertices, numbers and lists of genes, mutations, sites, positions and drugs. A row
    whose ``mutation`` holds no ``p.`` is a drug (its name in ``gene``); one whose ``alt`` is ``ptm`` is a site. A vertex
    counts as its weight where that is a recurrence, else and for drugs as one. What a cluster lacks is null.
    """
    protein_row = F.coalesce(F.col("mutation").contains("p."), F.lit(False))
    site = F.col("alt").eqNullSafe("ptm")
    rows = clusters.withColumn("kind", F.when(~protein_row, "drug").when(site, "site").otherwise("mutation"))
    only = lambda c, *kinds: F.when(F.col("kind").isin(*kinds), c)
    protein = F.concat_ws(":", "gene", "mutation")
    rows = rows.select(
        "cluster", "transcript", "degree", "score", "geodesic", "line_no", "kind", only(F.col("gene"), "mutation", "site").alias("own_gene"), only(F.col("gene"), "drug").alias("drug"),
        only(F.concat_ws(":", "gene", "chromosome", "start", "stop", "ref", "alt"), "mutation").alias("genomic"), only(protein, "mutation").alias("protein"), only(protein, "site").alias("site"),
        only(F.nullif(F.regexp_extract("mutation", r"p\.\D*(\d+)", 1), F.lit("")), "mutation", "site").alias("place"), F.coalesce(only(protein, "mutation", "site"), F.col("gene")).alias("name"),
        F.when(F.col("weight_is_recurrence") & (F.col("kind") != "drug"), F.col("weight")).otherwise(1.0).alias("mass"),
    )
    n = lambda c: F.nullif(F.countDistinct(c), F.lit(0))
    names = lambda c: F.nullif(F.array_join(F.sort_array(F.collect_set(c)), ","), F.lit(""))
    mutation_mass = F.sum(only(F.col("mass"), "mutation"))
    mean = lambda c: F.sum(c) / F.sum("mass")
    one = rows.groupBy("cluster").agg(
        F.max_by("name", F.when(F.col("geodesic") == 0, F.col("line_no"))).alias("centroid"), F.sum("score").alias("score_sum"), mutation_mass.alias("recurrence_mass"), mean("score").alias("score_mean"),
        (mutation_mass / F.count(only(F.lit(1), "mutation"))).alias("mean_recurrence"), mean("degree").alias("mean_degree"), mean("geodesic").alias("mean_geodesic"), n("own_gene").alias("n_genes"),
        F.sum("mass").alias("n_vertices"), n("genomic").alias("n_genomic"), n("protein").alias("n_protein"), n("site").alias("n_sites"), n("place").alias("n_positions"), n("drug").alias("n_drugs"),
        names("genomic").alias("genomic_mutations"), names("protein").alias("protein_mutations"), names("site").alias("protein_sites"), names("place").alias("positions"), names("drug").alias("drugs"),
    )
    return one.join(_tally(rows, "cluster", "own_gene", "genes"), "cluster", "left").join(_tally(rows, "cluster", "transcript", "transcripts"), "cluster", "left")


def _ends(pairs: DataFrame) -> DataFrame:
    """Both ends of each pair in each of its structures. ``pairs``: gene, mutation, chain, pos with 1 and 2, info."""
    each = pairs.withColumn("pdb", F.explode(F.array_distinct("info.pdb")))
    side = lambda n: each.select("pdb", *[F.col(f"{c}{n}").alias(c) for c in ("gene", "mutation", "chain", "pos")])
    return side(1).unionByName(side(2)).distinct()


def structure_presence(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (cluster, pdb, gene, chain): first and last residue, mutations, residues, recurrence and the mutations' list."""
    m = clusters.groupBy("cluster", "gene", "mutation").agg(F.max("weight").alias("weight"))
    met = _ends(pairs).join(m, ["gene", "mutation"])
    return met.groupBy("cluster", "pdb", "gene", "chain").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.countDistinct("mutation").alias("n_mutations"), F.countDistinct("pos").alias("n_residues"), F.sum("weight").alias("recurrence"), _names(F.col("mutation")).alias("mutations"),
    )


def complex_presence(presence: DataFrame) -> DataFrame:
    """The same per (cluster, pdb): chains with their genes, and sums."""
    chain = F.concat_ws(":", "chain", "gene")
    return presence.groupBy("cluster", "pdb").agg(F.count(F.lit(1)).alias("n_chains"), F.countDistinct("gene").alias("n_genes"), F.sum("n_mutations").alias("n_mutations"), F.sum("n_residues").alias("n_residues"), F.sum("recurrence").alias("recurrence"), _names(chain).alias("chains"))


def gene_structure_presence(pairs: DataFrame) -> DataFrame:
    """Per (pdb, gene, chain): first and last residue, mutations and residues of all pairs."""
    return _ends(pairs).groupBy("pdb", "gene", "chain").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.countDistinct("mutation").alias("n_mutations"), F.countDistinct("pos").alias("n_residues"))


def drug_structure_presence(clusters: DataFrame, drug_pairs: DataFrame) -> DataFrame:
    """Per (cluster, pdb, drug): mutated residues near the drug. ``drug_pairs``: drug, pdb, gene, mutation, chain, pos."""
    m = clusters.select("cluster", "gene", "mutation").distinct()
    met = drug_pairs.join(m, ["gene", "mutation"])
    return met.groupBy("cluster", "pdb", "drug").agg(F.countDistinct("gene", "mutation").alias("n_mutations"), F.countDistinct("chain", "pos").alias("n_residues"), _names(F.concat_ws(":", "gene", "mutation")).alias("mutations"))


def structures_per_gene(gene_map: DataFrame) -> DataFrame:
    return gene_map.groupBy("gene").agg(F.countDistinct("pdb").alias("n_structures"))


def structure_totals(per_gene: DataFrame) -> DataFrame:
    return per_gene.agg(F.sum("n_structures").alias("total"), F.count(F.lit(1)).alias("genes"), F.avg("n_structures").alias("mean"))


def transcript_lengths(cds: DataFrame) -> DataFrame:
    """Sum of exon lengths; an exon listed twice counts once."""
    one = cds.groupBy("gene", "transcript", "exon_no").agg(F.max("length").alias("length"))
    return one.groupBy("gene", "transcript").agg(F.sum("length").alias("length"))


def longest_transcript(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("gene").agg(F.min_by("transcript", F.struct(-F.col("length"), "transcript")).alias("transcript"), F.max("length").alias("length"))


def family_totals(annotated: DataFrame) -> DataFrame:
    """``family, n, percent`` of all gene rows. ``annotated``: gene, families (array)."""
    total = annotated.agg(F.count(F.lit(1)).alias("total"))
    each = annotated.select(F.explode("families").alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return each.crossJoin(F.broadcast(total)).select("family", "n", (F.col("n") * 100 / F.col("total")).alias("percent"))


def best_pair_info(pairs: DataFrame) -> DataFrame:
    """For each unordered pair of (gene, mutation) the row whose first info is most unlikely; ties go to the first line."""
    p = F.concat_ws(":", "gene1", "mutation1"), F.concat_ws(":", "gene2", "mutation2")
    keyed = pairs.withColumn("__a", F.least(*p)).withColumn("__b", F.greatest(*p)).withColumn("__p", F.get("info", F.lit(0))["p_value"])
    return keyed.withColumn("__k", F.row_number().over(W.partitionBy("__a", "__b").orderBy("__p", "line_no"))).filter("__k = 1").drop("__a", "__b", "__p", "__k")


def cooccurring_samples(pairs: DataFrame, maf: DataFrame) -> DataFrame:
    """Per pair the samples with their counts on either side, and those on both.

    Lists of samples up to a measured ``LISTS`` bytes are broadcast; beyond that pairs meet them by joins, one side after the other.
    """
    n = maf.withColumn("s", C.sample_id(F.col("sample"))).filter("s is not null").groupBy("gene", F.col("aa_change").alias("mutation"), "s").agg(F.count(F.lit(1)).alias("n"))
    lists = cut(n.groupBy("gene", "mutation").agg(F.sort_array(F.collect_list("s")).alias("names"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "s", F.col("n").cast("string")))), "|").alias("samples")))
    # many pairs share a mutation: where the lists are small, these travel and not the pairs with a list in each
    small = (lists.agg(F.sum(F.octet_length("samples") * 2)).head()[0] or 0) <= LISTS
    side = lambda k: (F.broadcast(lists) if small else lists).toDF(f"gene{k}", f"mutation{k}", f"names{k}", f"samples{k}")
    met = pairs.select("gene1", "mutation1", "gene2", "mutation2").distinct().join(side(1), ["gene1", "mutation1"], "left").join(side(2), ["gene2", "mutation2"], "left")
    both = F.array_join(F.sort_array(F.array_intersect("names1", "names2")), "|")
    return met.select("gene1", "mutation1", "gene2", "mutation2", "samples1", "samples2", both.alias("both"))


def collapse_by_structure(best: DataFrame, within: bool) -> DataFrame:
    """Best pairs grouped by structure and annotation: ``within`` one protein (linear distance known) or complexes (null).

    ``best``: gene1, mutation1, feature1, gene2, mutation2, feature2, linear_distance, info, line_no.
    """
    part = best.filter(F.col("linear_distance").isNotNull() if within else F.col("linear_distance").isNull()).withColumn("pdb", F.get("info", F.lit(0))["pdb"])
    row = F.struct("line_no", F.concat_ws(":", "mutation1", "mutation2").alias("m"), F.coalesce(F.col("linear_distance").cast("string"), F.lit("N/A")).alias("l"))
    grouped = part.groupBy("pdb", "gene1", "feature1", "gene2", "feature2").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return grouped.select("pdb", "gene1", "feature1", "gene2", "feature2", F.array_join("r.m", "|").alias("mutations"), F.array_join("r.l", "|").alias("linear_distances"))


def annotate_domains(clusters: DataFrame, features: DataFrame) -> DataFrame:
    """``domains``: cleaned descriptions of a (gene, mutation), ``NULL`` without one. ``features``: gene, mutation, feature."""
    lists = features.groupBy("gene", "mutation").agg(_names(C.clean_domain(F.col("feature"))).alias("domains"))
    return clusters.join(lists, ["gene", "mutation"], "left").fillna("NULL", ["domains"])


def annotate_families(clusters: DataFrame, families: DataFrame, kinases: DataFrame | None = None) -> DataFrame:
    """``families``: a gene's families; drug rows ``NA``, none ``Unclassified``; a kinase list adds ``Protein Kinase``. ``families``: gene, family."""
    rows = families.select("gene", "family")
    if kinases is not None:
        rows = rows.unionByName(kinases.select("gene", F.lit("Protein Kinase").alias("family")))
    lists = rows.groupBy("gene").agg(_names(F.col("family")).alias("families"))
    return clusters.join(lists, "gene", "left").withColumn("families", F.when(F.col("is_drug"), "NA").otherwise(F.coalesce("families", F.lit("Unclassified"))))


def annotate_drug_class(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """``drug_class``: a drug's classes (``;`` lists become ``|``); gene rows ``NA``, none ``Unclassified``. ``classes``: drug, class."""
    lists = classes.groupBy(F.col("drug").alias("gene")).agg(_names(F.replace("class", F.lit(";"), F.lit("|"))).alias("drug_class"))
    return clusters.join(lists, "gene", "left").withColumn("drug_class", F.when(~F.col("is_drug"), "NA").otherwise(F.coalesce("drug_class", F.lit("Unclassified"))))


def annotate_mutations(clusters: DataFrame, maf: DataFrame, lengths: DataFrame) -> DataFrame:
    """Frequency by distinct samples, and the change on the gene's longest transcript."""
    n = maf.groupBy("gene", F.col("start_pos").cast("string").alias("start"), "ref", "alt").agg(F.countDistinct("sample").alias("frequency"))
    long = longest_transcript(lengths).select("gene", "transcript")
    on = maf.join(long, ["gene", "transcript"]).groupBy("gene", F.col("start_pos").cast("string").alias("start"), "ref", "alt").agg(F.min("transcript").alias("longest"), F.min("aa_change").alias("longest_change"))
    at = ["gene", "start", "ref", "alt"]
    return clusters.join(n, at, "left").join(on, at, "left")


def structure_locations(clusters: DataFrame, pairs: DataFrame, pdb: str | None = None) -> DataFrame:
    """``cluster, pdb, gene, mutation, chain, pos, is_centroid, is_site``, for one or all structures."""
    m = clusters.groupBy("cluster", "gene", "mutation").agg(F.min("geodesic").alias("g"), F.max(F.col("alt") == "ptm").alias("is_site"))
    ends = _ends(pairs)
    ends = ends if pdb is None else ends.filter(F.col("pdb") == pdb)
    return ends.join(m, ["gene", "mutation"]).select("cluster", "pdb", "gene", "mutation", "chain", "pos", (F.col("g") == 0).alias("is_centroid"), "is_site")
