"""Joins of places with ranges over power-of-two cells.

A range is cut into the few aligned cells that make it up exactly (two a level at most), and a place lies in one cell of each
level; so both meet by equality on (key, level, cell), once for each range that holds the place, and a key with very many
ranges is as many keys of the join as it has cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mutprox.session import cut

#: Levels of cells: ranges may be 2^40 long.
LEVELS = 40
_CELL = "array<struct<level:int,cell:bigint>>"


def cells(start: Column, stop: Column) -> Column:
    """The aligned cells, as (level, cell), that make up the whole numbers from ``start`` to ``stop``; none if a bound is null or they cross."""
    first = F.struct(start.cast("long").alias("l"), (stop.cast("long") + 1).alias("r"), F.array().cast(_CELL).alias("out"))

    def climb(acc: Column, level: Column) -> Column:
        left, right = acc["l"], acc["r"]
        low = (left < right) & (F.pmod(left, F.lit(2)) == 1)
        l2 = F.when(low, left + 1).otherwise(left)
        high = (l2 < right) & (F.pmod(right, F.lit(2)) == 1)
        cell = lambda c, x: F.when(c, F.array(F.struct(level.cast("int").alias("level"), x.alias("cell")))).otherwise(F.array().cast(_CELL))
        done = F.concat(acc["out"], cell(low, left), cell(high, right - 1))
        return F.struct(F.shiftright(l2, 1).alias("l"), F.shiftright(F.when(high, right - 1).otherwise(right), 1).alias("r"), done.alias("out"))

    size = F.greatest(F.lit(0), stop.cast("long") - start.cast("long")) + 1
    top = F.least(F.lit(LEVELS), F.length(F.bin(size)))  # no cell is longer than its range
    made = F.aggregate(F.sequence(F.lit(0), top), first, climb)["out"]
    return F.coalesce(made, F.array().cast(_CELL))


def _above(at: Column, levels: Sequence[int]) -> Column:
    """The cell of a place at each of the levels."""
    return F.array(*[F.struct(F.lit(k).cast("int").alias("__level"), F.shiftright(at.cast("long"), k).alias("__cell")) for k in levels])


def _celled(ranges: DataFrame, start: str, stop: str) -> DataFrame:
    return ranges.select("*", F.explode(cells(F.col(start), F.col(stop))).alias("__c")).select("*", F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell")).drop("__c")


def join_ranges(places: DataFrame, ranges: DataFrame, on: Sequence[str], at: str, start: str, stop: str) -> DataFrame:
    """Each place with each range of its key that holds it: columns of ``places``, then those of ``ranges`` but the key.

    Null keys, places and bounds meet nothing; repeated rows of either side meet as often as they are there. The levels in
    use (41 at most) come to the driver, so that a place is looked up on these only.
    """
    cut_up = _celled(ranges, start, stop)
    levels = sorted(r["__level"] for r in cut_up.select("__level").distinct().collect())
    spread = places.select("*", F.explode(_above(F.col(at), levels)).alias("__p")).select("*", "__p.*").drop("__p") if levels else places.limit(0).select("*", F.lit(0).alias("__level"), F.lit(0).cast("long").alias("__cell"))
    return spread.join(cut_up, [*on, "__level", "__cell"]).drop("__level", "__cell")


def join_overlaps(left: DataFrame, right: DataFrame, on: Sequence[str], bounds1: tuple[str, str], bounds2: tuple[str, str]) -> DataFrame:
    """Each row of ``left`` with each row of ``right`` of its key whose range it touches, once; columns of both, the key once.

    Of two ranges that touch one holds the start of the other, so starts are looked up in ranges from either side. A range is
    covered by the one or two cells of the first level that is as long as it; null keys and bounds meet nothing. The joins
    are by sorting, as the planner takes a table that was small before it was repeated for one to broadcast.
    """
    kept = [*[F.col(c) for c in on], *[F.col(f"l.{c}") for c in left.columns if c not in on], *[F.col(f"r.{c}") for c in right.columns if c not in on]]
    (a1, b1), (a2, b2) = bounds1, bounds2

    def celled(places: DataFrame, at: str, ranges: DataFrame, start: str, stop: str) -> tuple[DataFrame, DataFrame]:
        size = F.col(stop).cast("long") - F.col(start).cast("long")
        wide = ranges.filter(size >= 0).withColumn("__level", F.least(F.lit(LEVELS), F.length(F.bin(size))).cast("int"))
        levels = sorted(r["__level"] for r in wide.select("__level").distinct().collect()) or [0]
        end = lambda c: F.expr(f"shiftright(cast({c} as bigint), __level)")
        wide = wide.withColumn("__cell", F.explode(F.sequence(end(start), end(stop))))
        spread = places.select("*", F.explode(_above(F.col(at), levels)).alias("__p")).select("*", "__p.*").drop("__p")
        return spread, wide

    holds = lambda at, start, stop: F.col(at).between(F.col(start), F.col(stop))
    key = [*on, "__level", "__cell"]
    places, wide = celled(left, a1, right, a2, b2)
    first = places.alias("l").join(wide.hint("merge").alias("r"), key).filter(holds(f"l.{a1}", f"r.{a2}", f"r.{b2}"))
    places, wide = celled(right, a2, left, a1, b1)
    second = wide.alias("l").join(places.hint("merge").alias("r"), key).filter(holds(f"r.{a2}", f"l.{a1}", f"l.{b1}") & (F.col(f"r.{a2}") > F.col(f"l.{a1}")))
    return first.select(*kept).unionByName(second.select(*kept))


def top_stretches(ranges: DataFrame, on: Sequence[str], start: str, stop: str, rank: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Disjoint stretches ``*on, start, stop, *keep``: where ranges overlap, the largest by ``rank`` lies on top.

    Of ranges with the same bounds only the largest counts, so they are cut to one first and written, as three steps read them.
    Only the largest range of a cell counts, and places are looked up only where a range begins or has ended; so deep piles of
    ranges cost no more than flat ones, and no row is made for a place.
    """
    ranges = cut(ranges.groupBy(*on, start, stop).agg(F.max(F.struct(*rank, *keep)).alias("__top")))
    best = _celled(ranges, start, stop).groupBy(*on, "__level", "__cell").agg(F.max("__top").alias("__top"))
    levels = sorted(r["__level"] for r in best.select("__level").distinct().collect())
    sound = ranges.filter(F.col(start) <= F.col(stop))
    ends = sound.select(*on, F.explode(F.array(F.col(start).cast("long"), F.col(stop).cast("long") + 1)).alias("__at")).distinct()
    if not levels:
        levels = [0]
    seen = ends.select("*", F.explode(_above(F.col("__at"), levels)).alias("__p")).select("*", "__p.*").join(best, [*on, "__level", "__cell"], "left")
    tops = seen.groupBy(*on, "__at").agg(F.max("__top").alias("__top"))
    along = W.partitionBy(*on).orderBy("__at")
    turns = tops.withColumn("__was", F.lag("__top").over(along)).filter(~F.col("__top").eqNullSafe(F.col("__was")))
    found = turns.withColumn("__next", F.lead("__at").over(along)).filter("__top is not null")
    return found.select(*on, F.col("__at").alias(start), (F.col("__next") - 1).alias(stop), *[F.col(f"__top.{c}").alias(c) for c in keep])
