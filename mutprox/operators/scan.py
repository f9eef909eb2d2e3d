"""Numbers and running sums over ordered groups of any size: a prefix scan in two passes.

Rows are dealt to ranges of (group, order), sorted and written with the number of their range; totals of a range give what
stands before it, and only inside a range does a window add up. A group that holds most rows is many ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mutprox.session import cut


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], number: str | None = None, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` with ``number`` (place in its group, from 0) and a running sum, own row included, for each of ``sums``.

    ``order`` (ascending values) should tell all rows of a group apart: rows that tie lie in one range, in any order. Groups
    with a null in ``by`` are groups like any other. An empty table gives an empty result.
    """
    sums = dict(sums or {})
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.select("*", *[c.alias(f"__o{k}") for k, c in enumerate(cols)], *[c.alias(f"__s{k}") for k, c in enumerate(sums.values())])
    along = [*by, *[f"__o{k}" for k in range(len(cols))]]
    ranges = cut(keyed.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("__range", F.spark_partition_id()))
    whole = ranges.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__s{k}").alias(f"__t{k}") for k in range(len(sums))])
    ahead = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before")
    marks = [c.alias(f"__by{k}") for k, c in enumerate(map(F.col, by))]
    starts = whole.select(*marks, F.col("__range").alias("__at"), before("__n"), *[before(f"__t{k}") for k in range(len(sums))])
    same = F.col("__range") == F.col("__at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    inside = W.partitionBy(*by, "__range").orderBy(*along[len(by) :])
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    out = ranges.join(starts, same)
    made = [F.col(c) for c in df.columns]
    if number is not None:
        made.append((F.row_number().over(inside) - 1 + F.col("__n_before")).alias(number))
    made += [(F.coalesce(F.sum(f"__s{k}").over(upto), F.lit(0)) + F.col(f"__t{k}_before")).alias(name) for k, name in enumerate(sums)]
    return out.select(*made)
