"""Bringing stored residue pairs up to date: only proteins that changed are worked out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mutprox.operators.annotate import empirical_p_values
from mutprox.operators.structures import residue_distances


def pairs_of(residues: DataFrame, ranges: DataFrame, proteins: DataFrame | None = None, max_distance: float = 100.0) -> DataFrame:
    """Residue pairs with p-values, of the given proteins (``uniprot``) or of all as the first end.

    Both need nothing but the structures of the protein itself, so only these are read on.
    """
    if proteins is None:
        return empirical_p_values(residue_distances(residues, ranges, max_distance))
    wanted = proteins.select("uniprot").distinct()
    met = ranges.join(wanted, "uniprot", "left_semi").select("pdb").distinct()
    rows = residue_distances(residues.join(met, "pdb", "left_semi"), ranges.join(met, "pdb", "left_semi"), max_distance)
    return empirical_p_values(rows.join(wanted.withColumnRenamed("uniprot", "uniprot1"), "uniprot1", "left_semi"))


def store(pairs: DataFrame, path: str) -> DataFrame:
    """Write pairs with one folder a first protein; folders of other proteins stay as they are. An empty table changes nothing."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a protein with very many pairs is written by several tasks
    dealt = pairs.repartition(n, "uniprot1", F.pmod(F.xxhash64("pdb", "chain1", "pos1"), F.lit(4)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("uniprot1").parquet(path)
    return load(pairs.sparkSession, path, pairs.schema)


def load(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def refresh(path: str, residues: DataFrame, ranges: DataFrame, changed: DataFrame) -> DataFrame:
    """Replace the stored pairs and p-values of the ``changed`` proteins (``uniprot``) and return all.

    A protein that is not stored yet is added; one that has no structure any more keeps its last rows, as it is not among those
    that ``proteins_to_refresh`` names. A run that is repeated gives the same table.
    """
    return store(pairs_of(residues, ranges, changed), path)
