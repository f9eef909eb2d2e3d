"""Connected components by alternating large-star and small-star steps; no vertex list ever meets in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutprox.session import cut, drop_cut


def _star(edges: DataFrame, centre_smallest: bool) -> DataFrame:
    """Link each vertex's neighbours to the smallest vertex around it.

    Large star: neighbours larger than the vertex, seen from both ends. Small star: its smaller neighbours and itself.
    The minimum is combined on the map side, so a vertex with very many edges is no hot spot there; the join back
    has the edges on its left, where adaptive execution splits a skewed key.
    """
    both = edges if centre_smallest else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    met = both.join(low, "u")
    if centre_smallest:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    else:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Order-free fingerprint of an edge table: equal before and after a round that changed nothing."""
    h: Column = F.xxhash64("u", "v").cast("decimal(38,0)")
    row = edges.agg(F.count(F.lit(1)), F.sum(h), F.bit_xor(F.xxhash64("v", "u"))).head()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every vertex of an undirected edge table; the component is its smallest vertex.

    Self-loops, repeated and reversed edges are harmless; edges with a null end are ignored. A vertex that only has a
    self-loop is returned as its own component. Each round is written to the shared folder, which cuts the lineage.
    """
    sound = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    now = cut(sound.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    nodes = now.select(F.col("u").alias("node")).unionByName(now.select(F.col("v").alias("node"))).distinct()
    links = now.filter("u <> v")
    before, kept, last = _mark(links), now, None
    for _ in range(max_rounds):
        if not before[0]:
            break
        step = cut(_star(_star(links, False), True))
        after = _mark(step)
        if last is not None:
            drop_cut(last)
        last, links = step, step
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no stable components after {max_rounds} rounds")
    # every vertex now points at the smallest one of its component
    low = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(low, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
