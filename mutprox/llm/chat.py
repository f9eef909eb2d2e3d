"""Chat formatting with cumulative-snapshot collapse.

A logged conversation is often a prefix of a longer one: each request logs all turns so far. Every turn gets a rolling
hash of its conversation's prefix that ends there; a conversation whose last hash also stands inside another one is a
snapshot and goes (anti-join), of equal conversations the one with the smallest id stays. What is left is rendered.

Turns are placed in blocks of neighbouring turn numbers: places and hashes are summed up inside blocks and carried over
from block to block, so a conversation of any length never meets in one task as a whole, and rendering gives one row
for each block. Texts are read twice: once to place and hash the turns of each block, which are written as 128 bits a turn, and
once to render what stays; everything between works on the written hashes. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mutprox.session import cut

#: Turn numbers of one block; the block of turns without a number, before all others.
BLOCK, UNNUMBERED = 64, -(1 << 63)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_BLOCK = ["conv", "block"]


def in_blocks(turns: DataFrame) -> DataFrame:
    """``conv, block, turn, role, text``: turns with the block they are in.

    ``conv`` holds the id in a struct, so that a null id is a key like any other. A null role is ``unknown``, a null text empty.
    """
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(UNNUMBERED))
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    return turns.select(F.struct("conv_id").alias("conv"), block.alias("block"), "turn", role.alias("role"), text.alias("text"))


def digests(blocks: DataFrame) -> DataFrame:
    """``conv, block, k, g, h``: each turn's number in its block, from 1, and two 64-bit hashes of role and text, written.

    A turn logged twice (same conversation, number, role and text) counts once. Ties of number go by role, then text.
    """
    inside = W.partitionBy(*_BLOCK).orderBy("turn", "role", "text")
    here = F.struct("turn", "role", "text")
    once = blocks.withColumn("again", F.lag(here).over(inside).eqNullSafe(here)).filter(~F.col("again"))
    return cut(once.select(*_BLOCK, F.row_number().over(inside).alias("k"), F.xxhash64("role", "text").alias("g"), F.xxhash64(F.lit("turn"), "text", "role").alias("h")))


def placed(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From :func:`digests`: turns ``conv, place, n_turns, a, b`` with the two rolling hashes of the prefix that ends there, and
    blocks ``conv, block, last, a, b`` with the last place of each and the hashes up to it."""
    order = W.partitionBy("conv").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    base = own.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("n")).select(*_BLOCK, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    at = own.join(base, _BLOCK).withColumn("place", F.col("base") + F.col("k"))
    # rolling hash: exclusive-or over hashes of (place, turn); the place makes it one of the sequence
    at = at.select(*_BLOCK, "place", F.xxhash64("place", "g", "h").alias("ha"), F.xxhash64("h", "place", "g").alias("hb"))
    sums = at.groupBy(*_BLOCK).agg(F.max("place").alias("last"), F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    carry = [F.coalesce(F.bit_xor(x).over(before), F.lit(0).cast("long")).alias(c) for x, c in (("xa", "ca"), ("xb", "cb"))]
    sums = sums.select(*_BLOCK, "last", "xa", "xb", *carry, F.max("last").over(W.partitionBy("conv")).alias("n_turns"))
    upto = W.partitionBy(*_BLOCK).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    rolled = at.select(*_BLOCK, "place", F.bit_xor("ha").over(upto).alias("ra"), F.bit_xor("hb").over(upto).alias("rb")).join(sums, _BLOCK)
    turns = rolled.select("conv", "place", "n_turns", F.col("ra").bitwiseXOR(F.col("ca")).alias("a"), F.col("rb").bitwiseXOR(F.col("cb")).alias("b"))
    return turns, sums.select(*_BLOCK, "last", F.col("xa").bitwiseXOR(F.col("ca")).alias("a"), F.col("xb").bitwiseXOR(F.col("cb")).alias("b"))


def maximal(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    """``conv, n_turns`` of the conversations that stay. Both as from :func:`placed`."""
    whole = blocks.groupBy("conv").agg(F.max(F.struct("block", "last", "a", "b")).alias("x"))
    first = whole.groupBy(F.col("x.last").alias("n_turns"), F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.struct(F.min("conv.conv_id").alias("conv_id")).alias("conv"))
    # one row for each prefix that goes on: all its conversations share it, so it is summed up before it is shuffled
    going_on = turns.filter("place < n_turns").select(F.col("place").alias("n_turns"), "a", "b").distinct()
    return first.join(going_on, ["n_turns", "a", "b"], "left_anti").select("conv", "n_turns")


def render_turn(role: Column, text: Column) -> Column:
    """One turn; the template's own marks inside a text are broken up so that they cannot open or close a turn."""
    safe = F.replace(F.replace(text, F.lit(OPEN), F.lit("<|im_start |>")), F.lit(CLOSE), F.lit("<|im_end |>"))
    return F.concat(F.lit(OPEN), role, F.lit("\n"), safe, F.lit(CLOSE), F.lit("\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, segment, n_turns, text``: the rendered maximal conversations, one row for each block of turn numbers.

    Segments of a conversation are numbered from 0; their texts put together are its rendering. Null roles and null texts are as in
    :func:`in_blocks`, repeated turns and ties as in :func:`digests`; turns without a conversation id are one conversation, turns
    without a number are a block of their own. Equal conversations stay once, under the smallest id. An empty table gives none.
    """
    own = in_blocks(conversations)
    turns, blocks = placed(digests(own))
    order = W.partitionBy("conv").orderBy("block")
    numbered = blocks.select(*_BLOCK, (F.row_number().over(order) - 1).cast("long").alias("segment"))
    kept = numbered.join(maximal(turns, blocks), "conv")
    parts = own.join(kept, _BLOCK).groupBy(*_BLOCK, "segment", "n_turns").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: render_turn(x["role"], x["text"])), "")
    return parts.select("conv.conv_id", "segment", "n_turns", text.alias("text"))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT *, row_number() OVER w AS place, string_agg(md5(role || chr(0) || text), ',') OVER w AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), whole AS (
  SELECT conv_id, max(place) AS n_turns, arg_max(prefix, place) AS prefix FROM p GROUP BY conv_id
), first AS (
  SELECT min(conv_id) AS conv_id, n_turns, prefix FROM whole GROUP BY n_turns, prefix
), inner_prefix AS (
  SELECT DISTINCT p.prefix FROM p JOIN whole USING (conv_id) WHERE place < n_turns
), stay AS (
  SELECT conv_id, n_turns FROM first WHERE prefix NOT IN (SELECT prefix FROM inner_prefix)
), parts AS (
  SELECT conv_id, floor(turn / 64) AS block, n_turns, string_agg('<|im_start|>' || role || chr(10)
         || replace(replace(text, '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
  FROM p JOIN stay USING (conv_id) GROUP BY conv_id, floor(turn / 64), n_turns
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY block NULLS FIRST) - 1 AS segment, n_turns, text FROM parts
"""
