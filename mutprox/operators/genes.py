"""Genes, proteins, structures and drug places: maps between their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutprox.functions import columns as C
from mutprox.operators.ranges import join_overlaps

#: External id types that two gene records may share; one of them counts twice.
IDS = ("entrez", "refseq", "vega", "omim", "uniprot", "ensembl", "ucsc")
TWICE = "omim"


def proteins_to_refresh(current: DataFrame, previous: DataFrame, done: DataFrame) -> DataFrame:
    """``uniprot`` that has a structure it did not have, or no result yet. ``current``, ``previous``: uniprot, pdb; ``done``: uniprot."""
    new = current.join(previous, ["uniprot", "pdb"], "left_anti").select("uniprot")
    missing = current.join(done, "uniprot", "left_anti").select("uniprot")
    return new.unionByName(missing).distinct()


def gene_map(genes: DataFrame, records: DataFrame) -> DataFrame:
    """``gene, uniprot, pdbs, aliases`` with ``N/A`` for none. ``genes``: gene, aliases (array); ``records``: gene, uniprot, pdb."""
    lists = records.groupBy("gene", "uniprot").agg(F.array_join(F.sort_array(F.collect_set("pdb")), " ").alias("pdbs"))
    fill = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "N/A").otherwise(F.col(c)).alias(c)
    met = genes.select("gene", F.array_join(F.sort_array("aliases"), " ").alias("aliases")).join(lists, "gene", "left")
    return met.select("gene", *[fill(c) for c in ("uniprot", "pdbs", "aliases")])


def drug_locations(targets: DataFrame, hetatm: DataFrame) -> DataFrame:
    """Each drug target with the first HETATM residue of its compound, without one that has a ``-``. ``targets``: pdb, chain, het, ...; ``hetatm``: pdb, chain, residue_name, residue_no, line_no."""
    first = hetatm.filter(~F.col("residue_no").cast("string").contains("-")).groupBy("pdb", "chain", F.col("residue_name").alias("het")).agg(F.min_by("residue_no", "line_no").alias("location"))
    return targets.join(first, ["pdb", "chain", "het"], "left")


def symbol_index(genes: DataFrame, which: str) -> DataFrame:
    """``name, symbols``: for each previous symbol or alias the current symbols that had it."""
    return genes.select("symbol", F.explode(which).alias("name")).groupBy("name").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))


def ensembl_to_gene(genes: DataFrame) -> DataFrame:
    return genes.filter("ensembl is not null").groupBy("ensembl").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))


def gene_to_protein(genes: DataFrame) -> DataFrame:
    return genes.filter("uniprot is not null").groupBy("symbol").agg(F.sort_array(F.collect_set("uniprot")).alias("proteins"))


def protein_linkage(structures: DataFrame) -> DataFrame:
    """Structures of more than one protein, with these. ``structures``: uniprot, pdb."""
    return structures.groupBy("pdb").agg(F.countDistinct("uniprot").alias("n"), F.array_join(F.sort_array(F.collect_set("uniprot")), " ").alias("proteins")).filter("n > 1")


def reconcile_symbols(invalid: DataFrame, current: DataFrame, max_mismatch: int = 1, min_match: int = 1, tolerance: int = 100_000) -> DataFrame:
    """``symbol, candidate, reason``: current records for symbols that are none.

    Candidates share a previous symbol, an alias or an external id, and lie on the same chromosome with overlapping
    ranges. Both: symbol, chromosome, start, stop and the id columns; ``current`` also previous and aliases (arrays).
    Records meet on chromosome, shared thing and cell of their ranges, so an id that very many share pairs only neighbours.
    """
    kind = dict(invalid.select(*IDS).union(current.select(*IDS)).dtypes)  # both sides' ids in one type
    share = lambda k: F.col(k).cast(kind[k]).cast("string")

    def keyed(rows: DataFrame, names: Column, p: str) -> DataFrame:
        """A row for each name and id that a record may share, with its chromosome and the ends of its range; the record is kept whole."""
        ids = F.array(*[F.struct(F.lit(n).alias("__kind"), share(k).alias("__share")) for n, k in enumerate(IDS, 1)])
        all_ = F.concat(F.transform(names, lambda x: F.struct(F.lit(0).alias("__kind"), x.alias("__share"))), ids)
        near = F.when(F.col("start").isNotNull() & F.col("stop").isNotNull(), F.struct(F.least("start", "stop").alias("lo"), F.greatest("start", "stop").alias("hi")))
        own = rows.filter("symbol is not null").select(F.struct(*rows.columns).alias(p), C.normalize_chr(F.col("chromosome")).alias("__chr"), near.alias("__at"), F.explode(all_).alias("__k"))
        return own.select("__chr", "__k.*", F.col("__at.lo").alias(f"{p}lo"), F.col("__at.hi").alias(f"{p}hi"), p).filter("__chr is not null and __share is not null")

    on = ["__chr", "__kind", "__share"]
    a = keyed(invalid, F.array("symbol"), "__i")
    b = keyed(current, F.array_union(F.coalesce("previous", F.array().cast("array<string>")), F.coalesce("aliases", F.array().cast("array<string>"))), "__c")
    b = b.withColumn("__clo", F.col("__clo") - tolerance).withColumn("__chi", F.col("__chi") + tolerance)
    # only records that share something on one chromosome, near each other or of unknown place, are ever paired
    near = join_overlaps(a.filter("__ilo is not null"), b.filter("__clo is not null"), on, ("__ilo", "__ihi"), ("__clo", "__chi"))
    loose = lambda x, y: x.join(y.hint("merge"), on).select(*near.columns)
    found = near.unionByName(loose(a.filter("__ilo is null"), b)).unionByName(loose(a.filter("__ilo is not null"), b.filter("__clo is null")))
    met = found.select("__kind", "__i.*", *[F.col(f"__c.{c}").alias(f"c_{c}") for c in current.columns])
    met = met.withColumn("candidate", F.col("c_symbol")).filter(F.coalesce(C.ranges_overlap(F.col("start"), F.col("stop"), F.col("c_start"), F.col("c_stop"), tolerance), F.lit(True)))
    count = lambda same: sum(F.when(F.col(k) == F.col(f"c_{k}"), 1 + (k == TWICE)).otherwise(0) if same else F.when(F.col(k) != F.col(f"c_{k}"), 1).otherwise(0) for k in IDS)
    named = F.coalesce(F.array_contains("c_previous", F.col("symbol")), F.lit(False)) | F.coalesce(F.array_contains("c_aliases", F.col("symbol")), F.lit(False))
    # a pair that shares several things meets under each of them, and counts under the first
    meets = F.when(named, 0)
    for n, k in enumerate(IDS, 1):
        meets = meets.when(F.col(k) == F.col(f"c_{k}"), n)
    met = met.filter(F.col("__kind") == meets)
    scored = met.withColumn("n_match", count(True)).withColumn("n_mismatch", count(False)).withColumn("named", named)
    reason = (
        F.when(F.col("named") & ((F.col("n_mismatch") <= max_mismatch) | (F.col("n_match") > 0)), "name")
        .when((F.col("n_match") > min_match) & (F.col("n_mismatch") == 0), "ids")
        .when((F.col("n_match") > 0) & (F.col("n_match") <= min_match) & (F.col("n_mismatch") <= max_mismatch), "id")
    )
    return scored.withColumn("reason", reason).filter("reason is not null").select("symbol", "candidate", "reason")
