"""Filters on mutations, residue pairs and structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutprox.functions import columns as C
from mutprox.session import cut


def cluster_mutations(maf: DataFrame) -> DataFrame:
    """Calls that clustering uses: the classification contains Missense or In_Frame."""
    return maf.filter(F.col("classification").rlike("Missense|In_Frame"))


def search_mutations(maf: DataFrame, missense_only: bool = False, skip_silent: bool = True) -> DataFrame:
    """Calls that the search uses, by exact classification."""
    kinds = ["Missense_Mutation"] + ["In_Frame_Ins", "In_Frame_Del"] * (not missense_only) + ["Silent"] * (not skip_silent)
    return maf.filter(F.col("classification").isin(kinds))


def within_cutoff(distance: Column, p: Column, max_distance: float | None = None, max_p: float | None = None) -> Column:
    """Strictly below what was given; with neither, a p-value below 1."""
    if max_distance is None:
        return p < (1.0 if max_p is None else max_p)
    near = distance < max_distance
    return near if max_p is None else near & (p < max_p)


def search_cutoff(info: Column, linear: Column, max_distance: float = 10.0, max_p: float = 0.05, min_linear: int = 0) -> Column:
    """Inclusive, on the first entry of the list; pairs within one protein must be far enough apart along it."""
    first = F.get(info, F.lit(0))
    return (first["distance"] <= max_distance) & (first["p_value"] <= max_p) & (linear.isNull() | (linear >= min_linear))


def meric_filter(pairs: DataFrame, kind: str = "unspecified") -> DataFrame:
    """Pairs by whether they lie on one chain and in one gene. ``pairs``: gene1, chain1, gene2, chain2."""
    genes, chains = F.col("gene1") == F.col("gene2"), F.col("chain1") == F.col("chain2")
    rules = {
        "unspecified": F.lit(True), "intra": genes, "inter": ~chains & ~genes, "heteromer": ~chains & ~genes,
        "monomer": chains & genes, "homomer": ~chains & genes, "multimer": ~chains,
    }
    return pairs.filter(rules[kind])


def restrict_to_lists(pairs: DataFrame, genes: DataFrame | None = None, structures: DataFrame | None = None) -> DataFrame:
    """Pairs with both genes in ``genes`` (name), and only infos whose pdb is in ``structures`` (name); pairs left without info go."""
    if genes is not None:
        for k in ("gene1", "gene2"):
            pairs = pairs.join(genes.select(F.col("name").alias(k)).distinct(), k, "left_semi")
    if structures is not None:
        keyed = cut(pairs.withColumn("__row", F.monotonically_increasing_id()))  # row ids must not change between the two reads
        each = keyed.select("__row", F.posexplode("info").alias("k", "x")).join(structures.select(F.col("name").alias("pdb")).distinct(), F.col("x.pdb") == F.col("pdb"), "left_semi")
        kept = each.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("info"))
        pairs = keyed.drop("info").join(kept, "__row").select(*pairs.columns)
    return pairs


def pass_structures(pairs: DataFrame, ok: DataFrame) -> DataFrame:
    """Rows all of whose structures are in ``ok`` (name), each judged by its own ``info``: rows that agree in their ends may differ in offsets and so in structures."""
    own = pairs.withColumn("__pdbs", F.array_sort(F.array_distinct("info.pdb")))
    each = own.select("__pdbs").distinct().select("__pdbs", F.explode("__pdbs").alias("name"))
    bad = each.join(ok.select("name").distinct(), "name", "left_anti").select("__pdbs").distinct()
    return own.join(bad, "__pdbs", "left_anti").select(*pairs.columns)


def _phospho_ok() -> Column:
    return ~F.col("feature").contains("Phospho") | F.col("letter").isin("S", "T", "Y", "D", "H")


def valid_phospho_sites(sites: DataFrame) -> DataFrame:
    """Phosphorylation sites must lie on a residue that can carry one. ``sites``: feature, letter."""
    return sites.filter(_phospho_ok())


def bad_phospho_structures(sites: DataFrame) -> DataFrame:
    """Distinct structures of the rejected sites. ``sites``: feature, letter, info."""
    return sites.filter(~_phospho_ok()).select(F.explode("info.pdb").alias("pdb")).distinct()


def prioritise_filter(prox: DataFrame, max_p: float = 0.05, max_distance: float = 20.0, min_linear: int = 0) -> DataFrame:
    """Residue pairs worth keeping: numeric places, not neighbours along one protein, near and unlikely."""
    lin = C.linear_distance(F.col("uniprot1"), F.col("pos1"), F.col("off1"), F.col("uniprot2"), F.col("pos2"), F.col("off2"))
    known = F.col("pos1").isNotNull() & F.col("pos2").isNotNull() & F.col("off1").isNotNull() & F.col("off2").isNotNull()
    return prox.filter(known & (lin.isNull() | (lin > min_linear)) & (F.col("p_value") <= max_p) & (F.col("distance") <= max_distance))


def drop_ambiguous_residues(atoms: DataFrame) -> DataFrame:
    """Residue places that carry more than one residue name go."""
    at = ["pdb", "chain", "residue_no"]
    good = atoms.groupBy(*at).agg(F.min("residue_name").alias("lo"), F.max("residue_name").alias("hi")).filter("lo = hi").select(*at)
    return atoms.join(good, at, "left_semi")
