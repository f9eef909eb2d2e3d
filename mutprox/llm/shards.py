"""Sharding along a Hilbert curve over metadata, so that a file's rows lie close together in every dimension at once.

Each dimension is cut into 2^BITS classes of about equal row counts (from a histogram of at most 2^16 bins over all rows),
the classes of a row give the index of its cell on the curve, and rows are ordered by that index and then by a hash. Shards are
consecutive runs of that order with row counts at most one apart. The order is numbered by a two-pass prefix scan: cells
are cut into hash ranges of bounded size, counts of these give offsets, and only rows inside a range are numbered by a
window; values that alone exceed a range (many equal rows) are spread over ranges of their own. DataFrame functions only.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from mutprox.session import cut

BITS, SHARDS = 5, 40
#: The most rows that one window numbers, where a quarter of a task's share is not less.
RANGE = 50_000
#: Bits of the hash that orders rows inside a cell.
HASH_BITS = 60


@lru_cache(maxsize=4)
def curve(dims: int) -> tuple[int, ...]:
    """``entry[state * 2^dims + corner] = place * states + next state``: one level of the Hilbert curve.

    A state is the corner at which the curve enters a cube and the axis along which it leaves; places go through the
    corners in Gray order, turned by the state.
    """
    n, size = dims, 1 << dims
    turn = lambda x, k: (x >> k % n | x << n - k % n) & size - 1  # noqa: E731  to the right
    gray = lambda i: i ^ i >> 1
    enter = lambda w: gray(2 * ((w - 1) // 2)) if w else 0
    trail = lambda x: (~x & x + 1).bit_length() - 1  # noqa: E731  ones at the end
    along = lambda w: 0 if w == 0 else trail(w - 1) % n if w % 2 == 0 else trail(w) % n
    place = {gray(i): i for i in range(size)}
    table = []
    for state in range(size * n):
        e, d = divmod(state, n)
        for corner in range(size):
            w = place[turn(corner ^ e, d + 1)]
            to = e ^ turn(enter(w), n - (d + 1) % n), (d + along(w) + 1) % n
            table.append(w * size * n + to[0] * n + to[1])
    return tuple(table)


def hilbert(codes: list[Column], bits: int = BITS) -> Column:
    """Index on the curve of a cell with these coordinates (whole numbers under 2^bits)."""
    n = len(codes)
    size, states = 1 << n, n << n
    entry = F.array(*[F.lit(x).cast("long") for x in curve(n)])

    def level(acc: Column, bit: Column) -> Column:
        corner = sum(((c.cast("long") / F.pow(F.lit(2), bit)).cast("long") % 2 * (1 << k) for k, c in enumerate(codes)), F.lit(0).cast("long"))
        return (F.floor(acc / states) * size * states + F.element_at(entry, (acc % states * size + corner + 1).cast("int"))).cast("long")

    return F.floor(F.aggregate(F.array(*[F.lit(b) for b in reversed(range(bits))]), F.lit(0).cast("long"), level) / states)


def _shared(low: str | None, high: str | None) -> int:
    """Leading bytes that the smallest and the largest string, and so all between them, have in common."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _bin(df: DataFrame, dim: str, skip: int) -> Column:
    """A dimension as a bin under 2^16, in the order of its values; null comes first.

    Strings: the two bytes behind those that all have in common. Numbers: whole, at least zero, as length and first six
    bits after the leading one.
    """
    if isinstance(df.schema[dim].dataType, NumericType):
        bits = F.bin(F.greatest(F.lit(0), F.col(dim)).cast("long"))
        found = F.length(bits) * 64 + F.conv(F.rpad(F.substring(bits, 2, 6), 6, "0"), 2, 10).cast("int")
    else:
        found = F.conv(F.rpad(F.substring(F.hex(F.col(dim).cast("string")), 2 * skip + 1, 4), 4, "0"), 16, 10).cast("int")
    return F.coalesce(found, F.lit(-1))


def _cells(df: DataFrame, dims: list[str], bits: int) -> Column:
    """The curve index of a row. What reaches the driver is a minimum, a maximum and 2^bits thresholds a dimension."""
    texts = [d for d in dims if not isinstance(df.schema[d].dataType, NumericType)]
    ends = df.agg(F.count(F.lit(1)), *[f(F.col(d).cast("string")).alias(f"{f.__name__}_{d}") for d in texts for f in (F.min, F.max)]).first()
    bins = [_bin(df, d, _shared(ends[f"min_{d}"], ends[f"max_{d}"]) if d in texts else 0) for d in dims]
    each = df.select(F.posexplode(F.array(*bins)).alias("dim", "bin")).groupBy("dim", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("dim").orderBy("bin")
    code = F.floor(F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * (1 << bits) / F.sum("n").over(Window.partitionBy("dim")))
    starts: list[list[int]] = [[] for _ in dims]
    for row in each.select("dim", "bin", code.alias("code")).groupBy("dim", "code").agg(F.min("bin").alias("bin")).filter("code > 0").collect():
        starts[row["dim"]].append((row["code"], row["bin"]))
    step = lambda b, s: F.coalesce(*[F.when(b >= at, F.lit(c)) for c, at in sorted(s, reverse=True)], F.lit(0))
    return hilbert([step(b, s) for b, s in zip(bins, starts)], bits)


def place(rows: DataFrame, dims: list[str], key: Column, shards: int = SHARDS, bits: int = BITS, most: int | None = None) -> DataFrame:
    """``rows`` with ``cell``, ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    Rows are ordered by cell and then by the first 60 bits of the MD5 of ``key``, a string; rows with an equal key are taken
    to be alike. Nulls in a dimension are a class of their own below all others. Every row is placed, repeated ones
    too; an empty table gives an empty result. Columns of ``rows`` must not be called cell, shard or slot. ``most`` bounds the
    rows of a window and does not change the result.
    """
    h = F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")
    # numbered once and written, so that a task that runs again sees the same rows under the same numbers
    own = cut(rows.select(F.struct(*rows.columns).alias("r"), h.alias("h"), _cells(rows, dims, bits).alias("cell"), F.monotonically_increasing_id().alias("row")))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most 2^(bits * dims) rows, whatever the table holds: one window, and a broadcast of bounded size
    cells = cut(own.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("cell_start", before(F.lit(0), "cell")))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if most is None:
        most = min(RANGE, total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1)
    pieces = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / most)))).cast("long")
    own = own.join(F.broadcast(cells.select("cell", "cell_start", pieces.alias("pieces"))), "cell")
    piece = F.floor(F.col("h") / ((1 << HASH_BITS) / F.col("pieces"))).cast("long")
    own = own.withColumn("piece", piece)
    # a value of the hash with more rows than a window may number gets ranges of its own
    large = cut(own.groupBy("cell", "piece").count().filter(F.col("count") > 2 * most).select("cell", "piece"))
    alike = own.join(large, ["cell", "piece"], "left_semi").groupBy("cell", "piece", "h").count().filter(F.col("count") > most)
    hot = cut(alike.groupBy("cell", "piece").agg(F.sort_array(F.collect_list(F.struct("h", "count"))).alias("hot")))
    below = F.size(F.filter("hot", lambda x: x["h"] < F.col("h")))
    mine = F.filter("hot", lambda x: x["h"] == F.col("h"))[0]["count"]
    spread = F.when(mine.isNull(), 2 * below).otherwise(2 * below + 1).cast("long")
    own = own.join(hot, ["cell", "piece"], "left").select(
        "r", "h", "row", "cell", "cell_start", "piece",
        F.coalesce(F.when(F.col("hot").isNotNull(), spread), F.lit(0)).alias("part"),
        F.coalesce(F.when(F.col("hot").isNotNull(), F.pmod("row", F.ceil(mine / most))), F.lit(0)).alias("deal"),
    )
    at = ["cell", "piece", "part", "deal"]
    groups = own.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    groups = cut(groups.withColumn("start", before("cell", F.struct("piece", "part", "deal"))).select(*at, "start"))
    inside = F.row_number().over(Window.partitionBy(*at).orderBy("h", "row")) - 1
    ranked = own.join(groups, at).withColumn("rank", F.col("cell_start") + F.col("start") + inside)
    shard = F.expr(f"rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select("r.*", "cell", F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text and 16) and ``text_crc32``; a null text has no bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"size": (F.octet_length(text) + 16).cast("long"), "text_crc32": F.crc32(text)})


def _key(id_col: str) -> Column:
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), "size", "text_crc32")


def shard_table(docs: DataFrame, id_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` for every row: runs of the curve over source, language and size.

    The law is ``rows``: counts of shards are at most one apart; ``grown_shard`` is null. Null ids, texts and metadata are
    placed like any other, repeated rows get slots of their own, an empty table gives an empty result, and other columns
    of ``docs`` play no part. Texts are read once and never shuffled.
    """
    slim = measures(docs).select(F.col(id_col).alias("id"), "size", "text_crc32", "source", "lang")
    placed = place(slim, ["source", "lang", "size"], _key("id"), shards)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, dims: list[str], id_col: str = "doc_id", shards: int = SHARDS, files: int | None = None) -> DataFrame:
    """Write ``docs`` as one folder a shard, in files that follow the curve, and read them back with ``shard`` and ``slot``.

    A file is a run of the order, so its footer's minima and maxima prune scans by any of ``dims`` (columns of ``docs``, or
    "size"). ``files`` is the number of runs that are written (the session's shuffle partitions unless given). A column of
    ``docs`` that is called shard or slot already is written with an underscore behind its name.
    """
    spark = docs.sparkSession
    own = docs.select(*[F.col(c).alias(f"{c}_" if c in ("shard", "slot") else c) for c in docs.columns])
    wide = measures(own.select(F.struct(*own.columns).alias("doc"), F.col(id_col).alias("id"), "text", *[F.col(d).alias(f"dim_{d}") for d in dims if d != "size"])).drop("text")
    placed = place(wide, ["size" if d == "size" else f"dim_{d}" for d in dims], _key("id"), shards).select("doc.*", "shard", "slot")
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.parquet(path)


def _oracle(bits: int = BITS, shards: int = SHARDS) -> str:
    text_bin = lambda c: f"coalesce(CAST('0x' || rpad(substr(hex({c}), 2 * (SELECT skip_{c} FROM skip) + 1, 4), 4, '0') AS BIGINT), -1)"
    shared = lambda c: f"(SELECT coalesce(max(k), 0) FROM range(1, 200) t(k) WHERE k <= least(length(hex(a_{c})), length(hex(b_{c}))) // 2 AND substr(hex(a_{c}), 1, 2 * k) = substr(hex(b_{c}), 1, 2 * k))"
    mant = "CASE WHEN length(bin(size)) > 7 THEN (size >> CAST(length(bin(size)) - 7 AS BIGINT)) & 63 ELSE (size << CAST(7 - length(bin(size)) AS BIGINT)) & 63 END"
    states = 3 << 3
    corner = "((x >> i) & 1) + ((y >> i) & 1) * 2 + ((z >> i) & 1) * 4"
    walk = f"list_reduce([0, {', '.join(str(b) for b in reversed(range(bits)))}], lambda acc, i: acc // {states} * {8 * states} + t[acc % {states} * 8 + {corner} + 1])"
    folded = [reduce(lambda v, _: v >> 1 ^ (0xEDB88320 if v & 1 else 0), range(8), i) for i in range(256)]
    octets = "[CAST('0x' || o AS BIGINT) FOR o IN regexp_extract_all(hex(body), '..')]"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(a >> 8, ({folded})[(xor(a, b) & 255) + 1])))"
    return f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, coalesce(text, '') AS body, source, lang FROM documents
), ends AS (
  SELECT min(source) AS a_source, max(source) AS b_source, min(lang) AS a_lang, max(lang) AS b_lang FROM d
), skip AS (
  SELECT {shared('source')} AS skip_source, {shared('lang')} AS skip_lang FROM ends
), bins AS (
  SELECT doc_id, size, {crc} AS crc, {text_bin('source')} AS b0, {text_bin('lang')} AS b1, length(bin(size)) * 64 + {mant} AS b2 FROM d
), step AS (
  SELECT dim, b, CAST(coalesce(sum(n) OVER (PARTITION BY dim ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << bits} // sum(n) OVER (PARTITION BY dim) AS BIGINT) AS code
  FROM (SELECT 0 AS dim, b0 AS b, count(*) AS n FROM bins GROUP BY b0 UNION ALL SELECT 1, b1, count(*) FROM bins GROUP BY b1 UNION ALL SELECT 2, b2, count(*) FROM bins GROUP BY b2)
), coded AS (
  SELECT bins.*, s0.code AS x, s1.code AS y, s2.code AS z, {list(curve(3))} AS t
  FROM bins JOIN step s0 ON s0.dim = 0 AND s0.b = b0 JOIN step s1 ON s1.dim = 1 AND s1.b = b1 JOIN step s2 ON s2.dim = 2 AND s2.b = b2
), ranked AS (
  SELECT doc_id, size, crc, row_number() OVER (ORDER BY cell, CAST('0x' || h AS BIGINT)) - 1 AS k, count(*) OVER () AS n FROM (
    SELECT doc_id, size, crc, {walk} // {states} AS cell, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || crc), 1, {HASH_BITS // 4}) AS h
    FROM coded
  )
)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(k * {shards} // n AS INTEGER) AS shard, k - (k * {shards} // n * n + {shards - 1}) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM ranked
"""


ORACLE = _oracle()
