"""Near-duplicate classes by exact Jaccard similarity of word-shingle sets.

Texts with equal sets are one vertex from the start. SimHash fingerprints of the sets are searched first, in the Gray-order
index of :mod:`simhash`, at three differing bits. A pair at similarity 0.8 differs in about ten of 64 bits, though, where the
pigeonhole rule has no parts left that select anything; so what is not one class by then also meets by min-hash bands (24
bands of 5: a pair at 0.8 shares one with probability 0.99993). Every candidate pair of either search is checked on its whole
shingle sets.

Members of a band are first compared with one centre, the text that shares the most bands, so that a large group of near
copies is linked by as many checks as it has members. What then still has different labels in a band is compared pair
by pair: the members of a band are cut into tiles, pairs of tiles are the unit of work, and a task returns a forest of the
links it found, never pairs. A pair is compared in the first band that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutprox.llm.simhash import SEED, fingerprint_links, merge
from mutprox.operators.components import connected_components
from mutprox.session import cut, drop_cut, ship

SIMILAR = 0.8
BANDS, BAND_ROWS = 24, 5
#: Shingles that one step of the min-hash holds against all permutations.
STEP = 4096
#: Star rounds at most, and open pairs for each member of a band up to which they are compared as they are; rows of a tile.
STARS, OPEN, TILE = 2, 4, 512

_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2)
_ODD = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one without a word none."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[: max(1, len(words) - shingle + 1) - 1]]
    stops = [e - 1 for e in ends[shingle - 1 :]] if len(words) >= shingle else [len(line)]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band; none for an empty set."""
    if not len(hashes):
        return []
    low = np.full(len(_ODD), ~np.uint64(0))
    for at in range(0, len(hashes), STEP):
        low = np.minimum(low, ((hashes[at : at + STEP, None] ^ _FLIP) * _ODD).min(axis=0))
    raw = low.tobytes()
    width = BAND_ROWS * 8
    keys = np.array([xxhash.xxh64_intdigest(raw[k * width : (k + 1) * width], k) for k in range(BANDS)], np.uint64)
    return keys.view(np.int64).tolist()


def set_fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of shingles: a bit is 1 if it is set in over half of them; 0 for an empty set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        counts += np.unpackbits(hashes[at : at + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets, given as the bytes of their sorted hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "node": [_digest(s) for s in sets], "n": [len(s) for s in sets], "fp": [set_fingerprint(s) for s in sets], "keys": [band_keys(s) for s in sets]})

    return docs.mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, node binary, n long, fp long, keys array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b["text"]]
            yield pd.DataFrame({"node": [_digest(s) for s in sets], "hashes": [s.tobytes() for s in sets]})

    return docs.mapInPandas(run, "node binary, hashes binary")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are at ``least`` similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [similarity(x, y) >= least for x, y in zip(b["x"], b["y"])]
            yield b.loc[ok, ["a", "b", "l", "m"]]

    side = lambda c, s: sets.select(F.col("node").alias(c), F.col("hashes").alias(s))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInPandas(run, "a binary, b binary, l binary, m binary")


def _close_prints(nodes: DataFrame) -> DataFrame:
    """Candidate pairs ``(a, b)``: texts of one fingerprint with the first of them, and what the Gray-order index joins."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    same = nodes.select("node", "fp").join(prints, "fp").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return same.unionByName(fingerprint_links(prints))


def _mixed(each: DataFrame) -> DataFrame:
    """``key, size, cross``: keys with more than one label and their pairs of different labels."""
    kinds = each.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    sums = kinds.groupBy("key").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count(F.lit(1)).alias("k"))
    return sums.filter("k > 1").select("key", "size", ((F.col("size") * F.col("size") - F.col("same")) / 2).alias("cross"))


def _tile_links(table: pa.Table, least: float) -> pa.Table:
    """A forest ``(a, b, l, m)`` of the links between two tiles of one band, or inside one."""
    node, label, n = (table.column(c).to_pylist() for c in ("node", "label", "n"))
    side, n = table.column("side").to_numpy(), np.array(n)
    alone = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    keys, band = np.array(table.column("bands").to_pylist(), np.int64), table.column("band")[0].as_py()
    kind = np.unique(np.array(label, object), return_inverse=True)[1]
    left, right = np.flatnonzero(side == 0), np.arange(len(n)) if alone else np.flatnonzero(side == 1)
    flat = np.concatenate([sets[i] for i in right]) if len(right) else np.zeros(0, np.uint64)
    ends = np.cumsum([len(sets[i]) for i in right])
    parent = np.arange(len(n))
    for i in left.tolist():
        ask = (kind[right] != kind[i]) & (np.minimum(n[right], n[i]) >= np.maximum(n[right], n[i]) * least - 1e-9)
        if alone:
            ask &= right > i
        ask &= ~(keys[right, :band] == keys[i, :band]).any(axis=1)
        if not ask.any():
            continue
        at = np.searchsorted(sets[i], flat)
        hit = sets[i][np.minimum(at, len(sets[i]) - 1)] == flat
        both = np.diff(np.r_[0, np.cumsum(hit)[ends - 1]])
        near = right[ask & (both >= least * (n[right] + n[i] - both))]
        merge(parent, np.full(len(near), i), near)
    moved = np.flatnonzero(parent != np.arange(len(n)))
    pairs = [(node[i], node[parent[i]], label[i], label[parent[i]]) for i in moved.tolist()]
    return pa.table([pa.array(x, pa.binary()) for x in (zip(*pairs) if pairs else [[]] * 4)], ["a", "b", "l", "m"])


def _dense_links(each: DataFrame, mixed: DataFrame, sets: DataFrame, least: float, tile: int) -> DataFrame:
    """Links between different labels of one band, as forests. ``each``: key, band, bands, node, n, label."""
    own = each.join(mixed.select("key", F.ceil(F.col("size") / tile).cast("int").alias("g")), "key").withColumn("t", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    t = F.col("t")
    place = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least(t, j).alias("i"), F.greatest(t, j).alias("j"), F.when(t <= j, 0).otherwise(1).alias("side")))
    dealt = own.withColumn("x", F.explode(place)).select("key", "band", "bands", "node", "n", "label", "x.*").join(sets, "node")
    return dealt.groupBy("key", "i", "j").applyInArrow(lambda rows: _tile_links(rows, least), "a binary, b binary, l binary, m binary")


def _relabelled(open_: DataFrame, found: DataFrame) -> DataFrame:
    """Texts with the labels that the links found join; the table before goes."""
    joined = connected_components(found, "l", "m").withColumnsRenamed({"node": "label", "component": "to"})
    now = cut(open_.join(joined, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to"))
    drop_cut(open_)
    return now


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """``(id, keep)`` for every row with an id: the smallest id of its class, which links at ``least`` Jaccard join.

    Texts without a word (and nulls) are one class. Repeated ids, ties and empty tables need no care; a text of any length
    is one cell.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    rows = cut(_sketches(own, shingle))
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("bands")))
    close = cut(_close_prints(nodes))
    shared = nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # one row for each text that shares a band; ``label`` is one text of its class, as far as that is known
    met = nodes.select("node", F.explode("bands").alias("key")).join(shared, "key")
    open_ = met.groupBy("node").agg(F.sum("size").alias("score"), F.collect_list("key").alias("keys"))
    open_ = cut(open_.join(nodes.drop("fp"), "node").withColumn("label", F.col("node")))
    ends = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    wanted = open_.select(F.col("rep").alias("id")).unionByName(nodes.join(ends, "node").select(F.col("rep").alias("id"))).distinct()
    sets = cut(_sets(own.join(wanted, "id", "left_semi"), shingle).dropDuplicates(["node"]))

    # sizes alone may rule a pair out: the smaller set cannot be less than ``least`` of the larger one
    may = F.least("n1", "n2") >= F.greatest("n1", "n2") * F.lit(least) - F.lit(1e-9)
    links = cut(_alike(close.select("a", "b", F.col("a").alias("l"), F.col("b").alias("m")), sets, least))
    open_ = _relabelled(open_, links)
    for star in range(STARS + 1):
        each = open_.select("node", "n", "score", "label", "bands", F.explode("keys").alias("key"))
        mixed = cut(_mixed(each))  # only bands with more than one label have pairs to compare
        members, pairs_left = mixed.agg(F.sum("size"), F.sum("cross")).head()
        if not members:
            break
        whole = star == STARS or pairs_left <= OPEN * members
        if whole:
            placed = each.withColumn("band", (F.array_position("bands", F.col("key")) - 1).cast("int"))
            found = cut(_dense_links(placed, mixed, sets, least, tile))
        else:
            # the text with the most company first: what the copies were made from is nearer to each of them than they are
            each = each.join(mixed.select("key"), "key", "left_semi")
            order = F.struct((-F.col("score") if star == 0 else F.xxhash64(F.lit(star), "node")).alias("r"), "node", "n", "label")
            centre = each.groupBy("key").agg(F.min(order).alias("m")).select("key", F.col("m.node").alias("u"), F.col("m.n").alias("n1"), F.col("m.label").alias("l1"))
            pairs = each.select("key", F.col("node").alias("v"), F.col("n").alias("n2"), F.col("label").alias("l2")).join(centre, "key").filter("l1 <> l2").filter(may)
            pairs = pairs.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.first(F.least("l1", "l2")).alias("l"), F.first(F.greatest("l1", "l2")).alias("m"))
            found = cut(_alike(pairs, sets, least))
        links = links.unionByName(found)
        if whole:
            break
        drop_cut(mixed)
        open_ = _relabelled(open_, found)
    drop_cut(sets, open_, close)
    classes = cut(connected_components(links))
    named = nodes.select("node", "rep").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keep = named.groupBy("component").agg(F.min("rep").alias("keep"))
    return rows.join(named.join(keep, "component").select("node", "keep"), "node").select("id", "keep")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate class; columns as given.

    Rows with a null id stay (they cannot be told apart); an id that repeats goes only where all its texts would go.
    """
    classes = near_classes(docs, id_col, text_col, shingle, least)
    gone = classes.groupBy("id").agg(F.bool_and(F.col("id") != F.col("keep")).alias("gone")).filter("gone").select(F.col("id").alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
