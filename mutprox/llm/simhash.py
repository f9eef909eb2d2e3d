"""SimHash near-dedup: a Gray-order hierarchical index over 64-bit fingerprints.

Every text gets a fingerprint of its word shingles. Equal fingerprints are collapsed before anything is compared.
Distinct fingerprints are dealt to groups that agree on one quarter of the bits (one of four quarters must agree
within three differing bits), groups that come out too large are dealt again on a quarter of their free bits. Inside
a group, fingerprints are sorted by Gray rank and packed into a tree: a node keeps the bits on which all its members
agree and which its parent did not yet hold, a search adds up the differing bits on the way down and drops the whole
node once the sum passes the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutprox.operators.components import connected_components
from mutprox.session import cut, ship

SEED = 42
FAN_OUT = 8
#: Pairs of a search and a node that one step may hold.
FRONTIER = 2_000_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the words of ``text``; 0 without a word."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1]]
    stops = [e - 1 for e in ends[shingle - 1 :]] if len(words) >= shingle else [len(line)]
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.array([h(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], ">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long. Null and wordless texts get 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"id": b["id"], "fp": fp.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fp long")


def quarter_masks(free: int, parts: int) -> list[int]:
    """Cut the set bits of ``free`` into ``parts`` masks of nearly equal size."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << b for b in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(df: DataFrame, parts: int, depth: int) -> DataFrame:
    """One row for each way to hold one more part of the free bits fixed; ``mask`` has the fixed bits so far."""
    held = [0]
    for _ in range(depth):
        held = list(dict.fromkeys(m | q for m in held for q in quarter_masks(~m & (1 << 64) - 1, parts)))
    more = F.create_map(*[x for m in held for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(m | q)) for q in quarter_masks(~m & (1 << 64) - 1, parts)]))])
    wide = df.withColumn("mask", F.explode(more[F.col("mask")]))
    return wide.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of a code word in the reflected Gray sequence."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayTree:
    """Trees over groups of Gray-sorted fingerprints, all in flat arrays; level 0 holds the fingerprints themselves."""

    def __init__(self, group: np.ndarray, fp: np.ndarray) -> None:
        self.bits, self.mask, self.first, self.last = [fp], [np.full(len(fp), ~np.uint64(0))], [], []
        low = high = fp
        while True:
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
            heads = np.flatnonzero(place % FAN_OUT == 0)
            low, high = np.bitwise_and.reduceat(low, heads), np.bitwise_or.reduceat(high, heads)
            self.first.append(heads)
            self.last.append(np.r_[heads[1:], len(group)])
            self.bits.append(low)
            self.mask.append(~(low ^ high))
            group = group[heads]
            if not (group[1:] == group[:-1]).any():
                break
        self.root = np.searchsorted(group, np.arange(group[-1] + 1))
        # a node keeps the shared bits that its parent does not hold
        for level in range(len(self.first)):
            up = np.repeat(np.arange(len(self.first[level])), self.last[level] - self.first[level])
            self.mask[level] = self.mask[level] & ~self.mask[level + 1][up]

    def search(self, group: np.ndarray, query: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query's own place, later place) at ``most`` or fewer differing bits."""
        top = len(self.first)
        node = self.root[group]
        who = np.arange(len(query))
        sums = np.bitwise_count((query ^ self.bits[top][node]) & self.mask[top][node]).astype(np.int64)
        for level in range(top - 1, -1, -1):
            ok = sums <= most
            who, node, sums = who[ok], node[ok], sums[ok]
            n = self.last[level][node] - self.first[level][node]
            child = np.repeat(self.first[level][node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            who, sums = np.repeat(who, n), np.repeat(sums, n)
            sums = sums + np.bitwise_count((query[who] ^ self.bits[level][child]) & self.mask[level][child])
            node = child
        ok = (sums <= most) & (node > own[who])
        return own[who[ok]], node[ok]


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the pairs into ``parent`` (each place points at a smaller or equal one; roots point at themselves)."""
    while len(a):
        ra, rb = parent[a], parent[b]
        while (ra != parent[ra]).any():
            ra = parent[ra]
        while (rb != parent[rb]).any():
            rb = parent[rb]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent != parent[parent]).any():
            parent[:] = parent[parent]


def _linked(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Links inside the groups of one partition, as a forest: at most one row for each place."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    fp, rep = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["rep"].to_numpy()
    mask, key = rows["mask"].to_numpy(np.int64), rows["key"].to_numpy(np.int64)
    order = np.lexsort((gray_rank(fp), key, mask))
    fp, rep, mask, key = fp[order], rep[order], mask[order], key[order]
    group = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
    tree, parent = GrayTree(group, fp), np.arange(len(fp))
    at, reach = 0, np.cumsum(np.bincount(group)[group])  # a search meets no more nodes of a level than its group has rows
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + FRONTIER, "right")))
        merge(parent, *tree.search(group[at:to], fp[at:to], np.arange(at, min(to, len(fp))), most))
        at = to
    moved = np.flatnonzero(parent != np.arange(len(fp)))
    yield pd.DataFrame({"a": rep[moved], "b": rep[parent[moved]]})


def fingerprint_links(distinct: DataFrame, most: int = 3, group_rows: int = 50_000, max_depth: int = 4) -> DataFrame:
    """Edges ``(a, b)`` between ``rep`` ids whose fingerprints (column ``fp``, distinct) differ in ``most`` bits or fewer.

    The edges of one task are a forest of the links found there, so that together they join exactly what links join.
    Groups above ``group_rows`` are dealt again on more fixed bits; after ``max_depth`` deals at least 44 bits are fixed
    for ``most`` = 3 and a group has at most 2^20 distinct members.
    """
    spark = ship(distinct.sparkSession)
    kind = distinct.schema["rep"].dataType.simpleString()
    todo = _deal(distinct.select("fp", "rep", F.lit(0).cast("long").alias("mask")), most + 1, 0)
    ready = None
    for depth in range(1, max_depth):
        big = todo.groupBy("mask", "key").count().filter(F.col("count") > group_rows).select("mask", "key")
        if big.isEmpty():
            break
        big = cut(big)
        fits = todo.join(big, ["mask", "key"], "left_anti")
        ready = fits if ready is None else ready.unionByName(fits)
        todo = cut(_deal(todo.join(big, ["mask", "key"], "left_semi"), most + 1, depth))
    dealt = todo if ready is None else ready.unionByName(todo)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return dealt.repartition(n, "mask", "key").mapInPandas(lambda it: _linked(it, most), f"a {kind}, b {kind}")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """``(id, fingerprint, component_id)``: near-duplicate classes of all texts.

    Nulls and texts without a word share fingerprint zero and link like any other. Fingerprints link whatever their rows'
    ids are: a row without an id joins others as any row does and gets the component of its class, which is the least id
    that is not null (null where a class has none). Repeated ids and rows keep a row each. An empty table gives an empty
    result.
    """
    own = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(own.groupBy("fp").agg(F.min("id").alias("least")))
    classes = connected_components(fingerprint_links(distinct.select("fp", F.col("fp").alias("rep")), most))
    linked = cut(distinct.join(classes, distinct["fp"] == classes["node"]).select("fp", "least", "component"))
    named = linked.select("fp", "component").join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    alone = distinct.join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(named.unionByName(alone), "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, most: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate class; columns as given.

    Rows with a null id stay (they cannot be told apart); of rows that repeat the kept id, all stay.
    """
    gone = simhash_components(docs, id_col, text_col, shingle, most).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
