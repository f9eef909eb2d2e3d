"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= t have a squared distance of at most 2 - 2t. A fixed rotation spreads every vector over all
axes, the axes are cut into ``blocks`` low-dimensional blocks, and of a close pair at least one block keeps within its
proportional share of the budget. Each block is a range join: rows are cut into slabs along the block's first axis, as
wide as the block's radius, and a slab meets itself and the next one; large slabs are cut into tiles, and pairs of tiles
are the unit of work. What keeps within the block's share is verified exactly in double precision on the full vectors,
and counted in the first block that admits it, so that no pair counts twice. Equal vectors are one row of the join, and
a task returns link counts and a forest of its links, never all pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutprox.llm.simhash import merge
from mutprox.llm.tokens import slices
from mutprox.operators.components import connected_components
from mutprox.session import cut, ship

#: Fewer blocks mean fewer copies of a row and fewer comparisons: a slab is hardly narrower than the spread of an axis in any case.
BLOCKS, TILE, STEP = 4, 4096, 512
SLACK = 1e-9
#: Far above the error of a single-precision product of two parts of unit vectors.
LOOSE = np.float32(1e-5)
#: Candidates verified at once.
CHUNK = 1 << 17


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to one or a little less: squares neither overflow nor vanish, and no bit changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None]) if vectors.size else vectors


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; ``vectors`` are :func:`scaled`. Element by element, so that a row gives the same bits in whatever company it comes."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    q, out = rotation(vectors.shape[1]), np.zeros_like(unit)
    for j in range(vectors.shape[1]):
        out += unit[:, j : j + 1] * q[j]
    return out


def axes(dim: int, blocks: int) -> list[np.ndarray]:
    return [x for x in np.array_split(np.arange(dim), blocks) if len(x)]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _slabs(batches, least: float, blocks: int):  # noqa: ANN001, ANN202
    """The slab of each row in each block; rows of one batch may differ in length."""
    for b in slices(batches, 4096):
        sizes = b.column("dim").to_numpy()
        out: list[list[int]] = [[]] * b.num_rows
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            r = rotated(scaled(_matrix(b.column("vec").take(pa.array(at)))))
            parts = axes(int(dim), blocks)
            width = np.sqrt((2 - 2 * least) / len(parts) + SLACK)
            found = np.stack([np.floor(r[:, p[0]] / width) for p in parts], axis=1).astype(np.int64)
            for i, row in zip(at, found.tolist()):
                out[i] = row
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], [*b.schema.names, "slabs"])


def _tile_links(table: pa.Table, least: float, blocks: int) -> pa.Table:
    """Links of one pair of tiles: rows ``(h1, h2, a, null, links)`` and forest edges ``(h1, h2, a, b, 0)``; h1, h2 name the vector, a its id."""
    side, block = table.column("side").to_numpy(), table.column("block")[0].as_py()
    alone = table.column("kind")[0].as_py() == 0 and table.column("i")[0].as_py() == table.column("j")[0].as_py()
    rep, weight, raw = table.column("rep").to_numpy(), table.column("cnt").to_numpy(), scaled(_matrix(table.column("vec")))
    keys = [table.column(c).to_numpy() for c in ("h1", "h2")]
    left = np.flatnonzero(side == 0)
    right = left if alone else np.flatnonzero(side == 1)
    links, parent = np.zeros(len(rep), np.int64), np.arange(len(rep))
    if len(left) and len(right):
        r, norm = rotated(raw), np.sqrt((raw * raw).sum(axis=1))
        parts = axes(raw.shape[1], blocks)
        share = (2 - 2 * least) / len(parts) + SLACK
        own = r[:, parts[block]]
        # in single precision and loosely; what passes is checked again in double precision
        half, single = ((own * own).sum(axis=1) / 2 - share / 4).astype(np.float32), own.astype(np.float32)
        for at in range(0, len(left), STEP):
            rows = left[at : at + STEP]
            near = single[rows] @ single[right].T >= (half[rows] - LOOSE)[:, None] + half[right][None, :]
            if alone:
                near &= rows[:, None] < right[None, :]
            u, v = np.nonzero(near)
            u, v = rows[u], right[v]
            for k in range(0, len(u), CHUNK):
                a, b = u[k : k + CHUNK], v[k : k + CHUNK]
                for p, cols in enumerate(parts[: block + 1]):
                    d = r[a][:, cols] - r[b][:, cols]
                    within = (d * d).sum(axis=1) <= share
                    keep = within if p == block else ~within  # an earlier block that admits the pair counts it
                    a, b = a[keep], b[keep]
                ok = (raw[a] * raw[b]).sum(axis=1) / (norm[a] * norm[b]) >= least
                a, b = a[ok], b[ok]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                merge(parent, a, b)
    hit, moved = np.flatnonzero(links), np.flatnonzero(parent != np.arange(len(rep)))
    a, both = np.r_[rep[hit], rep[moved]], np.r_[hit, moved]
    b = pa.array([None] * len(hit) + rep[parent[moved]].tolist(), pa.int64())
    counts = pa.array(np.r_[links[hit], np.zeros(len(moved), np.int64)])
    return pa.table([*(pa.array(k[both]) for k in keys), pa.array(a, pa.int64()), b, counts], ["h1", "h2", "a", "b", "n"])


def sound(vec: Column) -> Column:
    """Vectors that can link: no null or non-finite component, and not zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def links(reps: DataFrame, least: float, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """``reps``: h1, h2, rep, grp, vec, dim, cnt with distinct vectors. Rows as from :func:`_tile_links`."""
    ship(reps.sparkSession)
    kind = reps.schema["vec"].dataType.simpleString()
    cols = f"h1 long, h2 long, rep long, grp {reps.schema['grp'].dataType.simpleString()}, vec {kind}, dim int, cnt long"
    placed = cut(reps.select("h1", "h2", "rep", "grp", "vec", "dim", "cnt").mapInArrow(lambda it: _slabs(it, least, blocks), f"{cols}, slabs array<long>"))
    wide = placed.select("h1", "h2", "rep", "grp", "vec", "dim", "cnt", F.posexplode("slabs").alias("block", "slab"))
    tiles = wide.groupBy("grp", "dim", "block", "slab").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("g"))
    at = ["grp", "dim", "block", "slab"]
    around = (
        tiles.join(tiles.withColumn("slab", F.col("slab") - 1).withColumnRenamed("g", "g_next"), at, "left")
        .join(tiles.withColumn("slab", F.col("slab") + 1).withColumnRenamed("g", "g_prev"), at, "left")
    )
    own = wide.join(around, at).withColumn("t", F.pmod(F.xxhash64("h1", "h2"), F.col("g")).cast("int"))
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    zero, one = F.lit(0), F.lit(1)
    place = lambda slab, kind, i, j, side: F.struct(slab.alias("slab"), kind.alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    t, s = F.col("t"), F.col("slab")
    inside = F.transform(upto(F.col("g")), lambda j: place(s, zero, F.least(t, j), F.greatest(t, j), F.when(t <= j, zero).otherwise(one)))
    ahead = F.transform(upto(F.col("g_next")), lambda j: place(s, one, t, j, zero))
    behind = F.transform(upto(F.col("g_prev")), lambda j: place(s - 1, one, j, t, one))
    dealt = own.select("h1", "h2", "rep", "grp", "vec", "dim", "cnt", "block", F.explode(F.concat(inside, ahead, behind)).alias("x")).select("h1", "h2", "rep", "grp", "vec", "dim", "cnt", "block", "x.*")
    return dealt.groupBy("grp", "dim", "block", "slab", "kind", "i", "j").applyInArrow(lambda t: _tile_links(t, least, blocks), "h1 long, h2 long, a long, b long, n long")


def near_vectors(df: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row.

    Vectors link when their labels are equal and not null and their cosine is ``least`` or more. Null, zero and broken
    vectors, and rows without an id, link with nothing; vectors of different length do not link. Rows that repeat an id
    count as vectors of their own (they share a component, as their id is one vertex). An empty table gives an empty result.
    """
    vec = F.col(vec_col)
    own = df.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("grp"), vec.alias("vec"), F.xxhash64(label_col, vec_col).alias("h1"), F.xxhash64(F.lit("vec"), vec, F.col(label_col)).alias("h2"),
        (sound(vec) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).alias("ok"),
    )
    reps = own.filter("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("cnt"), F.first("grp").alias("grp"), F.first("vec").alias("vec"))
    reps = cut(reps.withColumn("dim", F.size("vec")))
    found = cut(links(reps, least, tile=tile))
    counts = found.filter("b is null").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    classes = connected_components(found.filter("b is not null").select("a", "b"))
    named = reps.join(counts, ["h1", "h2"], "left").join(classes, reps["rep"] == classes["node"], "left")
    named = named.select("h1", "h2", (F.col("cnt") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = own.filter("ok").select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "n_links", "component_id")
    rest = own.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    both = out.unionByName(rest)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), low AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN low ON v.vec_id = low.a LEFT JOIN n ON v.vec_id = n.a
"""
