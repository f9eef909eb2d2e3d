"""Line dedup by site-relative frequency.

A line is boilerplate of a site when the pages of the site that contain it, divided by the site's pages, exceed a ratio.
Lines are counted by a 128-bit hash, each once per page, and summed before they are shuffled; lines on too few pages
drop out before site totals are joined. A site keeps at most (lines per page / ratio) boilerplate lines, so its list
stays small however many pages it has. The lists of all sites are written and measured: up to ``BROADCAST`` bytes they are
broadcast, and pages are not shuffled at all; beyond that pages meet them by site, and sites that hold more than a
fraction of a partition's share of all pages (of which there are only so many) are dealt over ``SALTS`` places.
Documents of a source are counted once for each distinct text, so that copies of a whole document do not make its lines
boilerplate; pages of a site are counted as they stand, as the checking SQL does. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutprox.session import cut

RATIO, MIN_PAGES = 0.05, 5
#: Bytes of all boilerplate lists up to which they are broadcast; places that a heavy site's pages are dealt over.
BROADCAST, SALTS = 16 << 20, 32


def host(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return F.when(found != "", found)


def html_lines(html: Column) -> Column:
    """Visible lines of a page: one for each block of text, markup and surrounding blanks gone, empty ones left out."""
    x = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|li|ul|ol|nav|article|header|footer|section|h[1-6]|table|tr|td|title|head|body|html)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.filter(F.transform(F.split(x, "[\r\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def text_lines(text: Column) -> Column:
    """Lines of a plain text as they stand."""
    return F.split(text, "\n")


def line_keys(lines: Column) -> Column:
    """A 128-bit key for each line, surrounding blanks aside; null for a blank line."""
    key = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"))
    return F.transform(F.transform(lines, lambda x: F.trim(x)), lambda x: F.when(x != "", key(x)))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """``site, n_pages, common``: the keys of each site's boilerplate lines. ``pages``: site, keys as from :func:`line_keys`.

    Null sites have none; a page without a line counts in its site's total; pages that repeat an id or a text count each. An
    empty table gives an empty result. Without ``copies`` pages of a site with equal lines are one page, in the counts of lines and in the total.
    """
    sound = pages.filter(F.col("site").isNotNull()).select("site", "keys")
    if not copies:
        page = F.struct(F.xxhash64("keys").alias("a"), F.xxhash64(F.lit("page"), "keys").alias("b"), F.size("keys").alias("n"))
        sound = sound.groupBy("site", page.alias("page")).agg(F.first("keys").alias("keys"))
    totals = sound.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    each = sound.select("site", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("line"))
    counts = each.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    common = counts.join(totals, "site").filter(F.col("n") > F.col("n_pages") * F.lit(ratio))
    return common.groupBy("site").agg(F.first("n_pages").alias("n_pages"), F.collect_set("line").alias("common"))


def beside_lists(pages: DataFrame, lists: DataFrame, broadcast: int = BROADCAST, salts: int = SALTS) -> DataFrame:
    """``pages`` left-joined to ``lists`` (``__site, n_pages, common``; one row a site) by ``site``, as the size of the lists asks for."""
    size = lists.agg(F.sum(F.size("common") * F.lit(16) + F.length("__site") + F.lit(64))).head()[0] or 0
    if size <= broadcast:
        return pages.join(F.broadcast(lists), pages["site"] == lists["__site"], "left").drop("__site", "n_pages")
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    total = lists.agg(F.sum("n_pages")).head()[0]
    # fewer than 4 n sites can be above this share, whatever the data: that bounds the broadcast
    heavy = lists.filter(F.col("n_pages") > F.lit(total / (4 * n))).select(F.col("__site").alias("__heavy"))
    places = F.when(F.col("__heavy").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))
    spread = lists.join(F.broadcast(heavy), lists["__site"] == heavy["__heavy"], "left").select("__site", "common", F.explode(places).alias("__place"))
    row = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns]), F.lit(salts)).cast("int")
    dealt = pages.join(F.broadcast(heavy), pages["site"] == heavy["__heavy"], "left").withColumn("__salt", F.when(F.col("__heavy").isNull(), 0).otherwise(row)).drop("__heavy")
    return dealt.join(spread, (dealt["site"] == spread["__site"]) & (dealt["__salt"] == spread["__place"]), "left").drop("__site", "__place", "__salt")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True, broadcast: int = BROADCAST) -> DataFrame:
    """``pages`` (with ``site``, ``lines`` and their ``keys``) and ``kept_lines``: the lines that are not boilerplate of their site.

    Pages without a site, or whose lines are null, keep what they have. Blank lines stay. A repeated page counts as a page
    with ``copies`` only. An empty table gives an empty result.
    """
    lists = cut(boilerplate(pages, ratio, min_pages, copies).withColumnRenamed("site", "__site"))
    met = beside_lists(pages, lists, broadcast)
    rest = F.filter("lines", lambda x, i: F.col("keys")[i].isNull() | ~F.array_contains(F.col("common"), F.col("keys")[i]))
    return met.withColumn("kept_lines", F.when(F.col("common").isNull(), F.col("lines")).otherwise(rest)).drop("common")


def page_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast: int = BROADCAST) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text`` for every page; a null page has no lines and an empty text.

    Pages are taken apart once and written with the keys of their lines. Null and repeated ids are rows like any other;
    pages without a host lose nothing.
    """
    own = pages.select("page_id", host(F.col("url")).alias("site"), F.coalesce(html_lines(F.col("html")), F.array().cast("array<string>")).alias("lines"))
    own = cut(own.withColumn("keys", line_keys(F.col("lines"))))
    return drop_boilerplate(own, ratio, min_pages, broadcast=broadcast).select(
        "page_id", F.col("site").alias("host"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"), F.array_join("kept_lines", "\n").alias("text"),
    )


def drop_site_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` without the boilerplate lines of their source; columns as given, ``n_chars`` (if there) counted again where lines went.

    A text that a source repeats counts once: which of the copies stays is for the near-duplicate stage to say. A null text
    stays null; a null source has no lines in common with any.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(site_col).cast("string").alias("site"), text_lines(F.col(text_col)).alias("lines"))
    own = own.withColumn("keys", line_keys(F.col("lines")))
    rest = drop_boilerplate(own, ratio, min_pages, copies=False, broadcast=broadcast).withColumn("text", F.when(F.size("kept_lines") < F.size("lines"), F.array_join("kept_lines", "\n")))
    cols = [F.coalesce("text", f"row.{c}").alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        k = docs.columns.index("n_chars")
        cols[k] = F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(kind)).alias("n_chars")
    return rest.select(*cols)


ORACLE = rf"""
WITH a AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS h,
         regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
           '(?i)</?(p|div|br|li|ul|ol|nav|article|header|footer|section|h[1-6]|table|tr|td|title|head|body|html)\b[^>]*>', chr(10), 'g'),
           '<[^>]*>', '', 'g') AS x FROM pages
), b AS (
  SELECT page_id, CASE WHEN h <> '' THEN h END AS host,
         replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&') AS x FROM a
), c AS (
  SELECT page_id, host, coalesce([trim(s) FOR s IN regexp_split_to_array(x, '[\r\n]+') IF trim(s) <> ''], []) AS lines FROM b
), totals AS (
  SELECT host, count(*) AS n_pages FROM c WHERE host IS NOT NULL GROUP BY host
), each_line AS (
  SELECT host, unnest(list_distinct(lines)) AS line FROM c WHERE host IS NOT NULL
), common AS (
  SELECT host, list(line) AS common FROM (SELECT host, line, count(*) AS n FROM each_line GROUP BY host, line) JOIN totals USING (host)
  WHERE n >= {MIN_PAGES} AND n > n_pages * {RATIO} GROUP BY host
), d AS (
  SELECT page_id, c.host, lines, [s FOR s IN lines IF common IS NULL OR NOT list_contains(common, s)] AS kept
  FROM c LEFT JOIN common ON c.host = common.host
)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text FROM d
"""
