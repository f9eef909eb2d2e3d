"""Residue pairs within reach, against all pairs of a structure."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mutprox.operators import structures

POINTS = "pdb string, chain string, residue_no long, x double, y double, z double"


def points(seed, wide, n=60):
    """Three structures of unlike size and place, one far from the origin, one with all residues in one spot."""
    rng = random.Random(seed)
    rows = []
    for pdb, at, w in (("A", -500.0, wide), ("B", 1e6, wide / 20), ("C", 3.0, 0.0)):
        rows += [(pdb, "A", k, *(at + rng.random() * w for _ in "xyz")) for k in range(n)]
    return rows + [("A", "B", 1, None, 0.0, 0.0), ("A", "B", 2, math.nan, -499.0, -499.0), ("B", "B", 3, math.inf, 1e6, 1e6)]


def within(rows, reach):
    sound = [r for r in rows if r[3] is not None and math.isfinite(r[3])]
    return sorted((p[0], p[1], p[2], q[1], q[2]) for p in sound for q in sound if p[0] == q[0] and math.dist(p[3:], q[3:]) <= reach)


@pytest.mark.parametrize("wide, reach", [(100.0, 7.0), (100.0, 60.0), (100.0, 1000.0), (40.0, 10.0)])
def test_near_pairs(spark, wide, reach):
    rows = points(3, wide)
    df = spark.createDataFrame(rows, POINTS)
    met = structures._near(df, df, reach)
    d = F.sqrt(sum(((F.col(f"{k}1") - F.col(f"{k}2")) ** 2 for k in "xyz"), F.lit(0.0)))
    got = met.filter(d <= reach).select("pdb1", "chain1", "residue_no1", "chain2", "residue_no2").collect()
    assert sorted(tuple(r) for r in got) == within(rows, reach)


def test_pairs_at_the_very_reach(spark):
    rows = [("A", "A", k, 10.0 * k, 0.0, 0.0) for k in range(20)]
    df = spark.createDataFrame(rows, POINTS)
    met = structures._near(df, df, 10.0).filter(F.abs(F.col("x1") - F.col("x2")) <= 10.0)
    assert met.count() == 20 + 2 * 19


def test_a_structure_within_reach_repeats_no_row(spark):
    """Rows in the join: every pair of a structure is met once, with no copy for cells that it does not have."""
    df = spark.createDataFrame([r for r in points(4, 50.0) if r[1] == "A"], POINTS)
    assert structures._near(df, df, 100.0).count() == 3 * 60 * 60
    assert structures._near(df.limit(0), df.limit(0), 100.0).count() == 0
    assert structures._near(df.filter("pdb = 'A'"), df.filter("pdb <> 'A'"), 100.0).count() == 0
