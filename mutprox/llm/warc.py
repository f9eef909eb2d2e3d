"""WARC archives with a Merkle fixity audit.

Pages are written as WARC files of neighbouring ids, and read back record by record with their offsets. Every record is
hashed; records in file and offset order are the leaves of a tree, each node covers an ordered range of offsets and
hashes the hashes below it. Two replicas are compared from their roots down: only the children of nodes that differ are
looked at again, level by level, until the damaged records are found.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mutprox.session import cut, drop_cut, new_path, remove, ship

#: Page ids of one file; children of one node, as a power of two.
FILE_IDS, FAN_BITS = 512, 4
CRLF = "\r\n"
_LENGTH = re.compile(rb"(?im)^Content-Length:\s*(\d+)\s*$")
_ID = re.compile(rb"(?im)^WARC-Record-ID:\s*<urn:page:(-?\d*)>\s*$")


def record(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC record without the two line ends that close it. Nulls are empty; line ends in a URL become spaces."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", " "),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF), body,
    )


def _filed(pages: DataFrame) -> DataFrame:
    """``pages`` with ``file``: the range of their ids, or a number below zero for rows that a range cannot hold.

    Rows without an id, and ranges of more than two files' worth (ids repeat), are dealt to files of their own by a hash of the
    whole row; of rows that are alike in everything each block of half a file is dealt apart.
    """
    ranged = pages.select(F.floor(F.col("page_id") / FILE_IDS).cast("long").alias("range"), "page_id", "url", "html")
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).filter(F.col("range").isNull() | (F.col("n") > 2 * FILE_IDS))
    parts = F.ceil(F.col("n") / FILE_IDS)
    spread = cut(sizes.select("range", parts.alias("parts"), F.coalesce(F.sum(parts).over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start")))
    if spread.isEmpty():
        return ranged.select(F.col("range").alias("file"), "page_id", "url", "html")
    wide = spread.withColumnRenamed("range", "wide")
    met = ranged.join(wide, F.col("range").eqNullSafe(F.col("wide")))
    alike = met.groupBy("range", "parts", "start", "page_id", "url", "html").agg(F.count(F.lit(1)).alias("n"))
    block = FILE_IDS // 2
    blocks = alike.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1) - F.pmod(F.col("n") - 1, F.lit(block)), F.lit(block).cast("long"))))
    part = F.pmod(F.pmod(F.xxhash64("page_id", "url", "html"), F.col("parts")) + F.floor(F.col("k") / block), F.col("parts")).cast("long")
    copies = F.sequence(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.col("n") - F.col("k")))
    dealt = blocks.select((-1 - F.col("start") - part).alias("file"), "page_id", "url", "html", F.explode(copies).alias("copy")).drop("copy")
    rest = ranged.join(wide, F.col("range").eqNullSafe(F.col("wide")), "left_anti").select(F.col("range").alias("file"), "page_id", "url", "html")
    return rest.unionByName(dealt)


def write_archive(pages: DataFrame, path: str) -> str:
    """Write ``pages`` (page_id, url, html) as gzip-compressed WARC files, one for each range of ids; ties go by url and html.

    No file has many more than two ranges' worth of records: pages without an id, and those of a range whose ids repeat, are
    dealt to files -1, -2, ... of about as many pages as a range has ids, whether or not they are alike. An empty table
    makes no file.
    """
    return _written(_filed(pages), path)


def _written(rows: DataFrame, path: str) -> str:
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(n, "file").sortWithinPartitions("file", "page_id", "url", "html")
    rows.select("file", record(F.col("page_id"), F.col("url"), F.col("html")).alias("value")).write.partitionBy("file").option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
    return path


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content")):
            raw = content.as_py()
            raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            file = int(re.search(r"/file=(-?\d+)/", path)[1])
            rows, at = [], 0
            while at < len(raw):
                head = raw.index(b"\r\n\r\n", at) + 4
                size = int(_LENGTH.search(raw, at, head)[1])
                page = _ID.search(raw, at, head)[1]
                rows.append((file, len(rows), at, head - at + size, int(page) if page else None, hashlib.sha256(raw[at : head + size]).hexdigest()))
                at = head + size + 4
            kinds = [pa.int64()] * 5 + [pa.string()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "seq", "offset", "length", "page_id", "digest"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``file, seq, offset, length, page_id, digest`` of every record.

    A file is one cell, whatever it holds; null ids read as null, records that repeat an id are rows of their own, and a
    folder without files gives an empty table.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")
    return cut(files.mapInArrow(_parse, "file long, seq long, offset long, length long, page_id long, digest string"))


def _leaf(records: DataFrame) -> DataFrame:
    """Leaves: file and place in it, both counted from 0 (files that are no range lie between the others), with the range covered."""
    number = F.when(F.col("file") >= 0, F.col("file") * 2).otherwise(F.col("file") * -2 - 1)
    spot = F.struct("file", "offset")
    return records.select(number.alias("f"), F.col("seq").alias("n"), spot.alias("first"), spot.alias("last"), "digest")


def heights(*archives: DataFrame) -> tuple[int, int]:
    """Levels that bring the longest file of the archives to one node, and the files to one root."""
    tops = [_leaf(records).agg(F.max("n"), F.max("f")).head() for records in archives]
    return tuple(-(-max((t[k] or 0).bit_length() for t in tops) // FAN_BITS) for k in (0, 1))


def _up(level: int, inside: int) -> list[Column]:
    """The parent of a node of ``level``: first inside its file, then over the files."""
    if level < inside:
        return [F.col("f"), F.shiftright("n", FAN_BITS).alias("n")]
    return [F.shiftright("f", FAN_BITS).alias("f"), F.col("n")]


def merkle_tree(records: DataFrame, high: tuple[int, int] | None = None) -> list[DataFrame]:
    """Levels of the tree, leaves first: ``f, n, first, last, digest``; first and last are the (file, offset) range covered.

    A file may have any number of records, an archive any number of files; records that repeat are leaves of their own, and an
    empty archive has empty levels. ``high``: as from :func:`heights`.
    """
    inside, above = high or heights(records)
    levels = [_leaf(records)]
    for k in range(inside + above):
        below = F.array_sort(F.collect_list(F.struct("cf", "cn", "digest")))
        line = F.array_join(F.transform(below, lambda x: F.concat_ws(":", x["cf"], x["cn"], x["digest"])), ",")
        child = levels[-1].select(*_up(k, inside), F.col("f").alias("cf"), F.col("n").alias("cn"), "first", "last", "digest")
        up = child.groupBy("f", "n").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(line, 256).alias("digest"))
        levels.append(cut(up))
    return levels


def differing(ours: list[DataFrame], theirs: list[DataFrame], inside: int) -> DataFrame:
    """``f, n, ours, theirs``: leaves whose digests differ or that one side lacks, found from the roots down. Both trees are equally high."""
    suspects = None
    for k in range(len(ours) - 1, -1, -1):
        a, b = ours[k], theirs[k]
        if suspects is not None:
            up = suspects.select(F.col("f").alias("uf"), F.col("n").alias("un"))
            pf, pn = _up(k, inside)
            a, b = (x.join(up, (pf == F.col("uf")) & (pn == F.col("un")), "left_semi") for x in (a, b))
        met = a.select("f", "n", F.col("digest").alias("ours")).join(b.select("f", "n", F.col("digest").alias("theirs")), ["f", "n"], "full")
        last, suspects = suspects, cut(met.filter(~F.col("ours").eqNullSafe(F.col("theirs"))))
        if last is not None:
            drop_cut(last)
    return suspects


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every record of ``ours`` with ``status``: ``ok``, ``damaged`` (the replica has other bytes there) or ``missing``.

    Both as from :func:`read_archive`; records only the replica has come last, as ``extra``. Records without an id and
    repeated ids are told apart by their place; two empty archives give an empty result.
    """
    high = heights(ours, theirs)
    trees = [merkle_tree(x, high) for x in (ours, theirs)]
    bad = differing(*trees, high[0]).withColumnsRenamed({"f": "__f", "n": "__n"})
    drop_cut(*(level for tree in trees for level in tree[1:]))
    number = F.when(F.col("file") >= 0, F.col("file") * 2).otherwise(F.col("file") * -2 - 1)
    here = (number == F.col("__f")) & (F.col("seq") == F.col("__n"))
    status = F.when(F.col("__n").isNull(), "ok").when(F.col("theirs").isNull(), "missing").otherwise("damaged")
    own = ours.join(bad, here, "left").select(*ours.columns, status.alias("status"))
    more = theirs.join(bad.filter("ours is null"), here).select(*theirs.columns, F.lit("extra").alias("status"))
    return own.unionByName(more)


def drill(pages: DataFrame, every: int = 500, at: int = 7) -> DataFrame:
    """Fixity drill: archive ``pages`` twice, the second time with the last byte of each page whose id leaves ``at`` changed, and audit.

    ``page_id, file, offset, length, digest, status`` for every page. Repeated pages are records of their own; null pages have
    an empty body; an empty table gives none.
    """
    spark = pages.sparkSession
    base = new_path(spark, "warc")
    worn = F.when(F.pmod("page_id", F.lit(every)) == at, F.concat(F.substring("html", F.lit(1), F.length("html") - 1), F.lit("~"))).otherwise(F.col("html"))
    filed = _filed(pages.select("page_id", "url", "html"))
    first = read_archive(spark, _written(filed, f"{base}/a"))
    second = read_archive(spark, _written(filed.withColumn("html", worn), f"{base}/b"))
    remove(spark, base)  # both were read to the end
    return audit(first, second).select("page_id", "file", "offset", "length", "digest", "status")


ORACLE = rf"""
WITH r AS (
  SELECT page_id, url, html, CAST(floor(page_id / {FILE_IDS}) AS BIGINT) AS file, chr(13) || chr(10) AS n FROM pages
), w AS (
  SELECT *, 'WARC/1.0' || n || 'WARC-Type: resource' || n || 'WARC-Target-URI: ' || coalesce(url, '') || n || 'WARC-Record-ID: <urn:page:'
       || page_id || '>' || n || 'Content-Type: text/html; charset=utf-8' || n || 'Content-Length: ' || strlen(coalesce(html, '')) || n || n || coalesce(html, '') AS rec FROM r
)
SELECT page_id, file, CAST(coalesce(sum(strlen(rec) + 4) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest,
       CASE WHEN page_id % 500 = 7 AND html <> '' AND right(html, 1) <> '~' THEN 'damaged' ELSE 'ok' END AS status
FROM w
"""
