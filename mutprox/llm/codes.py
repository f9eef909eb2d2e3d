"""Vector code compression: product codes learnt and assigned over tries of distinct parts.

Vectors become integers, integers are cut into equal consecutive parts, and every part position has a codebook of a few
entries. Equal parts are one weighted row, in lexicographic order, so that neighbours share their first dimensions. A trie
over them is walked depth first by blocks of siblings: a node's vector of distances to all entries is its parent's plus one
dimension's squares, computed once however many parts share that prefix. Leaves take the nearest entry and add to that
entry's weighted sums. A task returns one row an entry; only codebooks (parts x entries rows) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutprox.llm.tokens import slices
from mutprox.session import cut, ship

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Nodes that are expanded at once; a walk holds one such block a dimension.
SPAN = 4096


def bound(width: int, parts: int) -> int:
    """The largest size of a component for which the squared distance of two vectors fits a long."""
    return 1 << (60 - (width * parts - 1).bit_length()) // 2


def nearest(pos: np.ndarray, parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every row of ``parts`` in the codebook ``books[pos]`` (position, entry, dimension).

    Rows may come in any order; sorted ones are sorted again quickly. Ties go to the lower entry.
    """
    n, width = parts.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((*parts.T[::-1], pos))
    p, x = pos[order], parts[order]
    fresh = np.r_[True, p[1:] != p[:-1]]
    heads = [np.flatnonzero(fresh)]  # heads[d]: the first row of every node that has d dimensions behind it
    for d in range(width):
        fresh = fresh | np.r_[True, x[1:, d] != x[:-1, d]]
        heads.append(np.flatnonzero(fresh))
    kids = [np.searchsorted(low, np.r_[high, n]) for high, low in zip(heads, heads[1:])]  # where a node's children begin
    leaves = len(heads[-1])
    entry, far = np.empty(leaves, np.int64), np.empty(leaves, np.int64)
    stack = [(0, 0, np.zeros((len(heads[0]), books.shape[1]), np.int64))]
    while stack:
        depth, at, sums = stack.pop()
        if depth == width:
            entry[at : at + len(sums)] = best = sums.argmin(axis=1)
            far[at : at + len(sums)] = sums[np.arange(len(sums)), best]
            continue
        span = np.diff(kids[depth][at : at + len(sums) + 1])
        first, last = kids[depth][at], kids[depth][at + len(sums)]
        parent = np.repeat(np.arange(len(sums)), span)
        for lo in reversed(range(first, last, SPAN)):
            hi = min(lo + SPAN, last)
            row = heads[depth + 1][lo:hi]
            step = x[row, depth][:, None] - books[p[row], :, depth]
            stack.append((depth + 1, lo, sums[parent[lo - first : hi - first]] + step * step))
    leaf = np.cumsum(fresh) - 1
    out = np.empty((2, n), np.int64)
    out[0, order], out[1, order] = entry[leaf], far[leaf]
    return out[0], out[1]


def _longs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each entry that a task used: how many parts it got and their sum."""
    parts, entries, width = books.shape
    count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
    for b in batches:
        pos, n = b.column("pos").to_numpy(), b.column("n").to_numpy()
        x = _longs(b.column("part")).reshape(-1, width)
        slot = pos * entries + nearest(pos, x, books)[0]
        np.add.at(count, slot, n)
        np.add.at(total, slot, x * n[:, None])
    used = np.flatnonzero(count)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["slot", "n", "total"])


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Code and error of every vector of ``q``, over the distinct parts of a slice of rows; null where ``q`` is null."""
    parts, _, width = books.shape
    for b in slices(batches, 4096):
        q = b.column("q")
        has = np.flatnonzero(q.is_valid().to_numpy(zero_copy_only=False))
        x = _longs(q.take(pa.array(has))).reshape(-1, width)
        entry, far = nearest(np.tile(np.arange(parts), len(has)), x, books)
        text = entry.astype(np.uint8).tobytes().hex()
        code, error = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
        code[has] = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
        error[has] = far.reshape(-1, parts).sum(axis=1)
        keep = [b.column(k) for k, name in enumerate(b.schema.names) if name != "q"]
        names = [name for name in b.schema.names if name != "q"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(code, pa.string()), pa.array(error, pa.int64())], [*names, "code", "error"])


def quantised(vec: Column, scale: int, most: int) -> Column:
    """Components as whole numbers, floor(scale * x), held within +-``most``."""
    return F.transform(vec, lambda x: F.floor(F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), x.cast("double") * scale))))


def _finite(vec: Column) -> Column:
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def learn(parts: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """``parts``: ``pos, part, n``, distinct. After each round an entry is the floored mean of its parts; unused ones stay."""
    ship(parts.sparkSession)
    count, entries, width = books.shape
    for _ in range(rounds):
        now = books
        sums = parts.mapInArrow(lambda it: _sums(it, now), "slot long, n long, total array<long>")
        # positional sums are made by columns; at most parts x entries rows come to the driver
        cols = [F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)]
        flat = now.reshape(-1, width).tolist()
        for row in sums.groupBy("slot").agg(F.sum("n").alias("n"), *cols).collect():
            flat[row["slot"]] = [row[f"t{k}"] // row["n"] for k in range(width)]
        books = np.array(flat, np.int64).reshape(count, entries, width)
    return books


def codebook_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.reshape(-1).tolist()))


def compress(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, error`` of every vector without null or non-finite components, and the final codebooks.

    Rows whose vector is null or broken go; null ids and labels, repeated ids and repeated rows stay, each as a row of its
    own. Codebooks begin with the smallest ids (nulls last; of equal ids the lexicographically smaller vector first); with
    fewer vectors than entries there are as many entries as vectors. The length is that of the smallest id whose length is
    a positive multiple of ``parts``; vectors of another length come back with null code and error. Components are held
    within :func:`bound` / ``scale`` (+-32768 for 64 components), so that every distance fits a long. An empty table gives an empty
    result and no codebooks. ``entries`` is at most 256.
    """
    spark = ship(df.sparkSession)
    own = df.filter(_finite(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    fits = own.filter((F.size("vec") > 0) & (F.size("vec") % parts == 0))
    lead = fits.orderBy(F.col("id").asc_nulls_last(), "vec").select(F.size("vec").alias("dim")).first()
    if lead is None:
        none = own.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return none, np.zeros((parts, 0, 0), np.int64)
    dim = lead["dim"]
    width = dim // parts
    whole = own.select("id", "label", F.when(F.size("vec") == dim, quantised(F.col("vec"), scale, bound(width, parts))).alias("q"))
    seeds = whole.filter("q is not null").orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    books = np.array([r["q"] for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    each = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice("q", k * width + 1, width))
    distinct = whole.filter("q is not null").select(F.posexplode(each).alias("pos", "part")).groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n"))
    sorted_parts = cut(distinct.select(F.col("pos").cast("long").alias("pos"), "part", "n").repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"))
    books = learn(sorted_parts, books, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema.fields}
    return whole.mapInArrow(lambda it: _coded(it, books), f"id {kinds['id']}, label {kinds['label']}, code string, error long"), books


def decompress(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``coded`` with column ``vec``: the entries that its code names, as components again."""
    parts, entries, width = books.shape
    table = F.array(*[F.array(*[F.lit(x / scale) for x in books[p, e].tolist()]) for p in range(parts) for e in range(entries)])
    digit = lambda k: F.conv(F.substr(F.col("code"), k * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return coded.withColumn("vec", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.element_at(table, k * entries + digit(k) + 1))))


def code_digest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256``; rows as in :func:`compress`, null labels are one label.

    Errors of a label that do not fit a long together give null. Labels are summed in the tasks first, so a hot one is no
    more than a row a task.
    """
    coded, books = compress(df, id_col, vec_col, label_col)
    coded = cut(coded)
    total = cut(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")))
    sha = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    both = coded.join(total, coded["label"].eqNullSafe(total["label"]), "left")
    return both.select(coded["id"].alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _oracle(dim: int = 64) -> str:
    """The contract with one table expression a round; distances are written out, as they are between integers."""
    w = dim // PARTS
    far = " + ".join(f"(a.part[{k}] - c.part[{k}]) * (a.part[{k}] - c.part[{k}])" for k in range(1, w + 1))
    mean = ", ".join(f"CAST((sum(part[{k}]) - ((sum(part[{k}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for k in range(1, w + 1))
    assign = f"(SELECT a.vec_id, a.p, any_value(a.part) AS part, min(({far}) * {ENTRIES} + c.e) AS de FROM parts a JOIN c{{r}} c ON a.p = c.p GROUP BY a.vec_id, a.p)"
    steps = [
        f"a{r} AS MATERIALIZED {assign.format(r=r)}, m{r} AS (SELECT p, de % {ENTRIES} AS e, [{mean}] AS part FROM a{r} GROUP BY p, de % {ENTRIES}), "
        f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.part, c.part) AS part FROM c{r} c LEFT JOIN m{r} m ON c.p = m.p AND c.e = m.e)"
        for r in range(ROUNDS)
    ]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, q[p * {w} + 1 : p * {w} + {w}] AS part FROM kept, range({PARTS}) t(p)
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}
), c0 AS MATERIALIZED (
  SELECT p, e, part FROM parts JOIN first USING (vec_id)
), {", ".join(steps)}, last AS MATERIALIZED {assign.format(r=ROUNDS)}, books AS (
  SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS sha FROM c{ROUNDS}
), coded AS (
  SELECT vec_id, string_agg(lpad(to_hex(de % {ENTRIES}), 2, '0'), '' ORDER BY p) AS code, CAST(sum(de // {ENTRIES}) AS BIGINT) AS error FROM last GROUP BY vec_id
)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN books
"""


ORACLE = _oracle()
