"""Edges of components of any size that a reachability order may go along; an order over them is the order over all edges.

The walk of ``density`` leaves a core p for its neighbour o at the larger of p's core distance and their own distance. Once p
is done, all that p reaches by nearer steps is done before that step is looked at. So an edge longer than the core distances of both its ends is
never taken where cores that are nearer join these ends, and it has no say in a core distance or a tie. All other
edges stay: those within the core distance of an end, those to a vertex that is no core, and of the longer ones those of any
minimum spanning tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutprox.session import cut, drop_cut, ship

#: Edges that one task looks through at once.
BLOCK = 500_000


def _spanned(a: np.ndarray, b: np.ndarray, w: np.ndarray, loose: np.ndarray) -> np.ndarray:
    """Which of the ``loose`` edges join ends that edges of less ``w`` join already."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    by = np.argsort(w, kind="stable")
    ends, near, open_ = np.stack([code[: len(a)], code[len(a) :]], 1)[by].tolist(), w[by], loose[by].tolist()
    starts = np.flatnonzero(np.diff(near, prepend=-np.inf)).tolist()
    out = np.zeros(len(w), bool)
    for s, e in zip(starts, [*starts[1:], len(by)]):
        # edges of one length are judged before any of them joins its ends
        for k in range(s, e):
            out[by[k]] = open_[k] and find(ends[k][0]) == find(ends[k][1])
        for k in range(s, e):
            x, y = find(ends[k][0]), find(ends[k][1])
            parent[max(x, y)] = min(x, y)
    return out


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        rows = pa.Table.from_batches(held)
        gone = _spanned(*(rows[c].to_numpy() for c in ("v1", "v2", "w", "loose")))
        yield from rows.filter(pa.array(~gone)).to_batches()


def walkable(edges: DataFrame, cores: DataFrame, block: int = BLOCK) -> DataFrame:
    """``edges`` (v1, v2, distance and others) without those that no order goes along.

    ``cores``: v, core_distance, not less than what the walk finds; a vertex that lacks there keeps its edges. Edges are dealt to
    tasks by ranges of their ends, and what is left to fewer tasks, as long as that thins them out. A task drops only what
    its own edges span, so what is dropped may differ with the dealing, but no order does.
    """
    ship(edges.sparkSession)
    end = lambda n: cores.select(F.col("v").alias(f"v{n}"), F.col("core_distance").alias(f"cd{n}"))
    met = cut(edges.join(end(1), "v1", "left").join(end(2), "v2", "left"))
    inner = F.col("cd1").isNotNull() & F.col("cd2").isNotNull()
    now = cut(met.filter(inner).select(*edges.columns, F.greatest("distance", "cd1", "cd2").alias("w"), (F.col("distance") > F.greatest("cd1", "cd2")).alias("loose")))
    n, along = now.count(), ["v1", "v2"]
    while True:
        tasks = max(1, -(-n // block))
        last, now = now, cut(now.repartitionByRange(tasks, *along).mapInArrow(_thin, now.schema))
        drop_cut(last)
        left = now.count()
        if tasks == 1 or left > 0.9 * n:
            break
        n, along = left, along[::-1]
    return met.filter(~inner).select(*edges.columns).unionByName(now.select(*edges.columns))
