"""Density clusters: ordering by reachability, nested levels and membership probabilities."""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mutprox.operators.components import connected_components
from mutprox.operators.forest import walkable
from mutprox.operators.scan import running
from mutprox.session import cut, ship

PARTS = ["structure", "run", "component"]
#: Vertices of a component that are walked by their keys and all edges; more are numbered and their edges thinned out before.
FITS = 20_000


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("structure", F.col("key2").alias("key1"), F.col("key1").alias("key2"), "distance"))


def core_vertices(edges: DataFrame, weights: DataFrame, eps: float = 10.0, min_pts: float = 4.0) -> DataFrame:
    """``structure, key, core_distance``: vertices whose neighbours within ``eps``, themselves included, weigh ``min_pts``; the distance at which they do.

    ``weights``: key, weight. The running sum is kept inside each vertex's neighbourhood.
    """
    both = symmetric(edges).filter(F.col("distance") <= eps)
    self_ = both.select("structure", "key1", F.col("key1").alias("key2"), F.lit(0.0).alias("distance")).distinct()
    met = both.unionByName(self_).join(weights.select(F.col("key").alias("key2"), "weight"), "key2")
    summed = running(met, ["structure", "key1"], ["distance", "key2"], sums={"sum": F.col("weight")})
    # of equal distances the last one has the whole sum, and the first that reaches the mark is as far away as it
    return summed.filter(F.col("sum") >= min_pts).groupBy("structure", F.col("key1").alias("key")).agg(F.min("distance").alias("core_distance"))


def _walk(a: np.ndarray, b: np.ndarray, d: np.ndarray, weight: list[float], site: dict[int, set[int]], eps: float, min_pts: float, rng: random.Random) -> tuple[list[int], list[float], list[float | None]]:
    """Vertices of one component in order, their bars, and the core distance of every vertex that is a core.

    Vertices are numbered as their keys are sorted; ``a``, ``b``, ``d``: edges. Cores in shuffled order are expanded by reachability,
    then what is left follows. Of equal reachabilities a vertex at the last one's site comes first, then a core, then the smallest.
    """
    n = len(weight)
    one, other, far = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
    by = np.lexsort((other, far, one))
    at = np.searchsorted(one[by], np.arange(n + 1)).tolist()
    other, far = other[by], far[by]
    del one, by
    near = lambda k: zip(other[at[k] : at[k + 1]].tolist(), far[at[k] : at[k + 1]].tolist())
    core: list[float | None] = [None] * n
    for k in range(n):
        total = weight[k]
        if total >= min_pts:
            core[k] = 0.0
            continue
        for o, x in near(k):
            total += weight[o]
            if total >= min_pts:
                core[k] = x
                break
    heads, rest = [k for k in range(n) if core[k] is not None], [k for k in range(n) if core[k] is None]
    rng.shuffle(heads)
    rng.shuffle(rest)
    order: list[int] = []
    bars: list[float] = []
    done, reach = bytearray(n), [np.inf] * n
    for start in [*heads, *rest]:
        if done[start]:
            continue
        reach[start], heap, last = eps, [(eps, False, start)], None
        while heap:
            r, edge, k = heapq.heappop(heap)
            if done[k] or r > reach[k]:
                continue
            same = min(((core[o] is None, o) for o in site.get(last, ()) if not done[o] and reach[o] == r), default=None)
            if same is not None and same[1] != k:
                heapq.heappush(heap, (r, edge, k))
                k = same[1]
            done[k], last = 1, k
            order.append(k)
            bars.append(r)
            if core[k] is not None:
                for o, x in near(k):
                    x = max(core[k], x)
                    if not done[o] and x < reach[o]:
                        reach[o] = x
                        heapq.heappush(heap, (x, core[o] is None, o))
    return order, bars, core


def _order(key: tuple[str, str, int], a: np.ndarray, b: np.ndarray, d: np.ndarray, weight: np.ndarray, sites: Iterator[tuple[int, int]], eps: float, min_pts: float, seed: int) -> tuple[np.ndarray, dict]:
    """The walk of one run over one component (``key``: structure, component, run), and its columns from ``ord`` on but for the key."""
    site: dict[int, set[int]] = {}
    for x, y in sites:
        site.setdefault(x, set()).add(y)
        site.setdefault(y, set()).add(x)
    structure, component, run = key
    order, rd, core = _walk(a, b, d, weight.tolist(), site, eps, min_pts, random.Random(f"{seed}/{structure}/{component}/{run}"))
    up, until = tree_of(rd)
    at = np.array(order, np.int64)
    return at, {"ord": np.arange(len(at)), "rd": rd, "cd": [eps if core[k] is None else core[k] for k in order], "weight": weight[at], "up": pd.array(up, "Int64"), "until": until}


def _optics(rows: pd.DataFrame, eps: float, min_pts: float, seed: int) -> pd.DataFrame:
    """One run over one component, its vertices named by their keys."""
    run, structure, component = int(rows["run"].iloc[0]), rows["structure"].iloc[0], rows["component"].iloc[0]
    ends, edges, twins = (rows[f] for f in (rows["kind"] != "site", rows["kind"] == "edge", rows["kind"] == "site"))
    keys = pd.Index(np.unique(np.concatenate([ends["key1"], edges["key2"]])))
    weight = np.zeros(len(keys))
    weight[keys.get_indexer(ends["key1"])] = ends["w1"]
    a, b = keys.get_indexer(edges["key1"]), keys.get_indexer(edges["key2"])
    weight[b] = edges["w2"]
    sites = zip(keys.get_indexer(twins["key1"]).tolist(), keys.get_indexer(twins["key2"]).tolist())
    at, cols = _order((structure, component, run), a, b, edges["distance"].to_numpy(np.float64), weight, ((x, y) for x, y in sites if x >= 0 and y >= 0), eps, min_pts, seed)
    return pd.DataFrame({"structure": structure, "run": run, "component": component, "key": keys.to_numpy()[at], **cols})


#: Kinds of the rows that a numbered component comes in.
VERTEX, EDGE, SITE = 0, 1, 2


def _numbered(key: tuple[str, str, int], batches: Iterator[pa.RecordBatch], eps: float, min_pts: float, seed: int) -> Iterator[pa.RecordBatch]:
    """One run over one component, its vertices named by numbers in the order of their keys; only the numbers of its rows are held."""
    held = [[x[c].to_numpy(zero_copy_only=False) for c in ("kind", "v1", "v2", "x")] for x in batches]
    kind, v1, v2, x = (np.concatenate(c) for c in zip(*held))
    del held
    at = np.flatnonzero(kind == VERTEX)
    at = at[np.argsort(v1[at])]
    ids, weight = v1[at], x[at]
    code = lambda of, v: np.searchsorted(ids, v[kind == of]).astype(np.int32)
    a, b, d = code(EDGE, v1), code(EDGE, v2), x[kind == EDGE]
    sites = zip(code(SITE, v1).tolist(), code(SITE, v2).tolist())
    del kind, v1, v2, x
    at, cols = _order(key, a, b, d, weight, sites, eps, min_pts, seed)
    found = pa.Table.from_pandas(pd.DataFrame({"v": ids[at], **cols}), preserve_index=False)
    for name, value in zip(("component", "run", "structure"), (key[1], key[2], key[0])):
        found = found.add_column(0, name, pa.repeat(pa.scalar(value, pa.int32() if name == "run" else pa.string()), len(found)))
    yield from found.to_batches(max_chunksize=50_000)


def tree_of(rd: list[float]) -> tuple[list[int | None], list[int]]:
    """The merge tree of an order of bars: the last bar before each that is higher, and the last place before the next one as high."""
    up: list[int | None] = [None] * len(rd)
    until, open_ = [len(rd) - 1] * len(rd), []
    for k, r in enumerate(rd):
        while open_ and rd[open_[-1]] <= r:
            until[open_.pop()] = k - 1
        up[k] = open_[-1] if open_ else None
        open_.append(k)
    return up, until


ORDER = "structure string, run int, component string, ord long, key string, rd double, cd double, weight double, up long, until long"
NUMBERED = "structure string, run int, component string, v long, ord long, rd double, cd double, weight double, up long, until long"


#: Super clusters of one order that a group function gets at once: enough of them to make up for its call.
BATCH = 256


def with_tree(rows: DataFrame) -> DataFrame:
    """An order numbered by ``part`` that lacks them gets ``up`` and ``until`` inside each part, a batch of parts a group."""
    if {"up", "until"} <= set(rows.columns):
        return rows
    ship(rows.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        at, rd = rows["ord"].to_numpy(), rows["rd"].to_numpy()
        starts = np.flatnonzero(np.diff(rows["part"].to_numpy(), prepend=-1))
        up, until = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            u, z = tree_of(rd[a:b].tolist())
            up[a:b], until[a:b] = [-1 if x is None else at[a + x] for x in u], at[a + np.array(z)]
        return rows.assign(up=pd.Series(up, rows.index).astype("Int64").mask(up < 0), until=until)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(*_parts(rows), F.floor(F.col("part") / BATCH)).applyInPandas(run, f"{schema}, up long, until long")


def neighbourhoods(edges: DataFrame) -> DataFrame:
    """``structure, key, component``: what edges join, named by its smallest key. No order goes from one to another."""
    node = lambda k: F.struct(F.col("structure").alias("s"), F.col(k).alias("k"))
    found = connected_components(edges.select(node("key1").alias("a"), node("key2").alias("b")))
    return found.select(F.col("node.s").alias("structure"), F.col("node.k").alias("key"), F.col("component.k").alias("component"))


def optics_order(edges: DataFrame, weights: DataFrame, eps: float = 10.0, min_pts: float = 4.0, runs: int = 1, seed: int = 1, same_site: DataFrame | None = None, fits: int = FITS) -> DataFrame:
    """``structure, run, component, ord, key, rd, cd, weight, up, until``: reachability order of each component, once for each run with its own shuffle.

    Components are what edges of ``eps`` or less join; ``ord`` counts from 0 in each, and each starts at ``eps``, so that an
    order of all of them is any sequence of theirs. A vertex with longer edges only is a component of its own. Vertices
    without a weight are left out. ``same_site``: key1, key2 of vertices at one protein place, which decide ties.

    Each component is walked in a task. Those of more than ``fits`` vertices go there as numbers, and without the edges that
    no order goes along (:mod:`forest`); their order is the same as with all edges.
    """
    spark = ship(edges.sparkSession)
    w = lambda n: weights.select(F.col("key").alias(f"key{n}"), F.col("weight").alias(f"w{n}"))
    met = cut(edges.join(w(1), "key1").join(w(2), "key2").select("structure", "key1", "key2", "distance", "w1", "w2"))
    close = met.filter(F.col("distance") <= eps)
    every = neighbourhoods(close)
    sizes = every.groupBy("structure", "component").agg(F.count(F.lit(1)).alias("n"))
    every = cut(every.join(sizes, ["structure", "component"]).select("structure", "key", "component", (F.col("n") > fits).alias("large")))
    wide, own = every.filter("large").drop("large"), every.filter("not large").drop("large")
    shuffles = F.broadcast(spark.range(runs).select(F.col("id").cast("int").alias("run")))
    one = own.withColumnRenamed("key", "key1")
    none = F.lit(None)
    cols = ["structure", "component", "kind", "key1", "key2", "distance", "w1", "w2"]
    rows = close.join(one, ["structure", "key1"]).withColumn("kind", F.lit("edge")).select(*cols)
    ends = met.select("structure", "key1", "w1").unionByName(met.select("structure", F.col("key2").alias("key1"), F.col("w2").alias("w1"))).distinct()
    alone = ends.join(every, [ends["structure"] == every["structure"], ends["key1"] == every["key"]], "left_anti").select("structure", F.col("key1").alias("component"), F.lit("alone").alias("kind"), "key1", none.cast("string").alias("key2"), none.cast("double").alias("distance"), "w1", none.cast("double").alias("w2"))
    rows = rows.unionByName(alone)
    if same_site is not None:
        two = own.withColumnRenamed("key", "key2")
        pairs = same_site.select("key1", "key2").join(one, "key1").join(two, ["structure", "component", "key2"])
        rows = rows.unionByName(pairs.select("structure", "component", F.lit("site").alias("kind"), "key1", "key2", *[none.cast("double").alias(c) for c in ("distance", "w1", "w2")]))
    walked = rows.crossJoin(shuffles).groupBy("structure", "component", "run").applyInPandas(lambda rows: _optics(rows, eps, min_pts, seed), ORDER)
    if wide.isEmpty():
        return walked
    ids = cut(running(wide.join(weights.select("key", "weight"), "key"), [], ["structure", "component", "key"], number="v"))
    name = lambda n: ids.select("structure", "component", F.col("key").alias(f"key{n}"), F.col("v").alias(f"v{n}"))
    inside = close.join(name(1), ["structure", "key1"]).join(name(2), ["structure", "component", "key2"])
    inside = cut(inside.select("structure", "component", "key1", "key2", "v1", "v2", "distance"))
    # sums are rounded as they are added up: a mark that is a trifle higher makes no core distance less than the walk's
    cores = core_vertices(inside.select("structure", "key1", "key2", "distance"), weights, eps, min_pts * (1 + 1e-9)).join(ids, ["structure", "key"]).select("v", "core_distance")
    paths = walkable(inside.select("structure", "component", "v1", "v2", "distance"), cut(cores))
    row = lambda kind, v1, v2, x: [F.lit(kind).alias("kind"), v1.alias("v1"), v2.alias("v2"), x.cast("double").alias("x")]
    v1, v2, nil = F.col("v1"), F.col("v2"), F.lit(0).cast("long")
    rows = ids.select("structure", "component", *row(VERTEX, F.col("v"), nil, F.col("weight"))).unionByName(paths.select("structure", "component", *row(EDGE, v1, v2, F.col("distance"))))
    if same_site is not None:
        pairs = same_site.select("key1", "key2").join(name(1), "key1").join(name(2), ["structure", "component", "key2"])
        rows = rows.unionByName(pairs.select("structure", "component", *row(SITE, v1, v2, F.lit(0.0))))

    def walk(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _numbered(tuple(x.as_py() for x in key), batches, eps, min_pts, seed)

    found = rows.crossJoin(shuffles).groupBy("structure", "component", "run").applyInArrow(walk, NUMBERED)
    found = found.join(ids.select("v", "key"), "v").select(*walked.columns)
    return walked.unionByName(found)


def _parts(order: DataFrame) -> list[str]:
    """What an order is counted in; one without components is one stretch a structure and run."""
    return [c for c in PARTS if c in order.columns]


def reachability_islands(order: DataFrame, cut_at: float, min_pts: float = 4.0) -> DataFrame:
    """``structure, run, component, island, first, last, n, weight``: stretches below the cut with the bar before them, heavy enough to stay."""
    by = _parts(order)
    rows = running(order, by, ["ord"], sums={"island": F.when(F.col("rd") >= cut_at, 1).otherwise(0)})
    found = rows.groupBy(*by, "island").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return found.filter((F.col("n") > 1) & (F.col("weight") >= min_pts))


STEP = 0.1


def _first_above(low: Column, x: Column) -> Column:
    """The smallest i >= 0 for which low + i * STEP is above x."""
    near = F.greatest(F.floor((x - low) / STEP).cast("int") - 1, F.lit(0))
    return F.filter(F.sequence(near, near + 3), lambda i: low + i * F.lit(STEP) > x)[0]


def _levels(first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of one super cluster from its merge tree: (cut, stretches that stand there, those of the level before, first and last place of what each holds among these).

    ``lo`` to ``hi`` are the cuts at which a stretch stands; stretches come in order, and those of one cut lie apart. Between
    cuts at which one begins or ends nothing changes.
    """
    known = np.zeros(0, np.int64)
    for i in np.unique(np.r_[lo, hi + 1]).tolist():
        now = np.flatnonzero((lo <= i) & (i <= hi))
        if not len(now):
            continue
        new = len(now) != len(known)
        if not new:
            old, wide = known[last[known] > first[known]], now[last[now] > first[now]]
            if len(old) and len(wide):
                a, z = np.searchsorted(first[old], first[wide]), np.searchsorted(last[old], last[wide], "right")
                least = np.minimum.reduceat(np.r_[last[old] - first[old], 0], np.stack([a, np.maximum(a, z)], 1).ravel())[::2]
                new = ((a >= z) | (last[wide] - first[wide] >= 2 * least)).any()
        if new:
            yield i, now, known, np.searchsorted(first[known], first[now]), np.searchsorted(last[known], last[now], "right")
            known = now


def _all_levels(rows: pd.DataFrame) -> pd.DataFrame:
    """Levels of each super cluster of a batch."""
    rows = rows.sort_values(["super_id", "first", "last"])
    sups, first, last, lo, hi, density, low = (rows[c].to_numpy() for c in ("super_id", "first", "last", "lo", "hi", "density", "low"))
    starts, out = np.flatnonzero(np.diff(sups, prepend=-1)), []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
        sup = int(sups[s])
        for level, (i, now, known, a, z) in enumerate(_levels(first[s:e], last[s:e], lo[s:e], hi[s:e]), 1):
            at = float(low[s] + STEP * i)
            for sub, (x, p, q) in enumerate(zip((now + s).tolist(), a.tolist(), z.tolist()), 1):
                covers = "1" if level == 1 else ":".join(f"{sup}.{level - 1}.{k}" for k in range(p + 1, q + 1)) or "2"
                out.append((sup, level, sub, first[x], last[x], at, density[x], covers))
    found = pd.DataFrame(out, columns=["super_id", "level", "sub_id", "first", "last", "cut", "density", "covering"])
    for k, c in enumerate(PARTS):
        found.insert(k, c, rows[c].iloc[0])
    return found


CLUSTERS = "structure string, run int, component string, super_id int, level int, sub_id int, first long, last long, cut double, density double, covering string"


def density_clusters(order: DataFrame, eps: float = 10.0, min_pts: float = 4.0) -> DataFrame:
    """``structure, run, component, super_id, level, sub_id, first, last, cut, density, covering``: nested clusters of a reachability order.

    Super clusters (level 0, sub 0, cut ``eps`` - 0.1) are the stretches between bars of ``eps`` that weigh ``min_pts``, numbered in
    their component; their density is the sum of their bars but the first over their weight (0.1 where that sum is 0). Inside
    one, cuts rise in steps of 0.1 from its lowest bar to half above its last (above ``eps`` if it has fewer than three): a
    stretch below the cut, the bar before it included, is a cluster when it weighs ``min_pts``; at the lowest cut heavy
    single vertices are. A level is given out when the number of clusters differs from the level before, or a cluster holds none of
    that level's or is twice as long as one it holds (single vertices apart). Density is the weighted mean of the bars behind the
    first (0.1 for single vertices); ``covering`` names the clusters of the level before inside ("0" for super
    clusters, "1" on the first level, "2" for none). Cuts come from an integer index, so that steps do not drift. The
    last stretch of an order is closed like any other.

    Stretches of all cuts are read from the merge tree that the order carries (one that does not gets it, super cluster by
    super cluster); what one task gets of some super clusters are the heavy stretches that stand at some cut, never their vertices.
    """
    ship(order.sparkSession)
    by = [*PARTS, "part"]
    rows = order.select(*PARTS, "ord", "rd", "weight", *[c for c in ("up", "until") if c in order.columns])
    rows = running(rows, PARTS, ["ord"], sums={"part": F.when(F.col("rd") >= eps, 1).otherwise(0), "ws": F.col("weight"), "rws": F.col("rd") * F.col("weight")})
    rows = cut(with_tree(rows))
    head = F.col("rd") >= eps
    found = rows.groupBy(*by).agg(
        F.min("ord").alias("s"), F.max("ord").alias("e"), F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.when(~head, F.col("rd"))), F.lit(eps)).alias("low"), F.max_by("rd", "ord").alias("end_rd"),
        F.sum("weight").alias("total"), F.coalesce(F.sum(F.when(~head, F.col("rd"))), F.lit(0.0)).alias("bars"),
    ).filter(F.col("total") >= min_pts)
    found = running(found, PARTS, ["s"], number="super_id").withColumn("super_id", F.col("super_id").cast("int"))
    top = F.when(F.col("n") >= 3, F.col("end_rd")).otherwise(F.lit(eps)) + 0.5
    found = cut(found.withColumn("most", _first_above(F.col("low"), top) - 1))
    supers = found.select(
        *PARTS, "super_id", F.lit(0).alias("level"), F.lit(0).alias("sub_id"), F.col("s").alias("first"), F.col("e").alias("last"), F.lit(eps - STEP).alias("cut"),
        F.when(F.col("bars") == 0, 0.1).otherwise(F.col("bars") / F.col("total")).alias("density"), F.lit("0").alias("covering"),
    )
    one = found.select(*by, "super_id", "s", "low", "most")
    inner = rows.join(one, by)
    singles = inner.filter(F.col("weight") >= min_pts).select(*PARTS, "super_id", "low", F.col("ord").alias("first"), F.col("ord").alias("last"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0.1).alias("density"))
    # merges under one head within one step stand at no cut but for the last of them
    merges = inner.filter(~head).groupBy(*by, "super_id", "s", "low", "most", F.col("up").alias("first"), _first_above(F.col("low"), F.col("rd")).alias("lo")).agg(F.max("until").alias("last"))
    later = F.lead("lo").over(W.partitionBy(*PARTS, "first").orderBy("lo"))  # at most a row a step
    at = lambda name, *cols: rows.select(*PARTS, F.col("ord").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])
    merges = merges.withColumn("later", later).join(at("first", "rd", "ws", "rws", "weight"), [*PARTS, "first"]).join(at("last", "ws", "rws"), [*PARTS, "last"])
    own = F.when(F.col("first") == F.col("s"), F.col("most")).otherwise(_first_above(F.col("low"), F.col("first_rd")) - 1)
    behind = F.col("last_ws") - F.col("first_ws")
    merges = merges.withColumn("hi", F.least("most", own, F.col("later") - 1)).filter((F.col("hi") >= F.col("lo")) & (behind + F.col("first_weight") >= min_pts))
    stretches = merges.select(*PARTS, "super_id", "low", "first", "last", "lo", "hi", ((F.col("last_rws") - F.col("first_rws")) / behind).alias("density"))
    batch = F.floor(F.col("super_id") / BATCH)
    return supers.unionByName(singles.unionByName(stretches).groupBy(*PARTS, batch).applyInPandas(_all_levels, CLUSTERS))


def _stretches(order: DataFrame, cuts: DataFrame, ids: list[str], min_pts: float) -> DataFrame:
    """``*ids, run, stretch, ord, key``: members of the heavy stretches of an order (run, component, super cluster) at the cut of each level.

    ``order`` has the columns of ``ids`` but the level; single vertices make a stretch on level 1 only.
    """
    rows = order.join(cuts, [c for c in ids if c in order.columns])
    rows = running(rows, [*ids, "run"], ["ord"], sums={"stretch": F.when(F.col("rd") >= F.col("cut"), 1).otherwise(0)})
    rows = cut(rows.select(*ids, "run", "stretch", "ord", "key", "weight"))
    by = [*ids, "run", "stretch"]
    heavy = rows.groupBy(*by).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).filter((F.col("w") >= min_pts) & ((F.col("n") > 1) | (F.col("level") == 1)))
    return rows.join(heavy.select(*by), by).select(*by, "ord", "key")


def _best(hits: DataFrame, by: list[str], pick: str, order: str) -> DataFrame:
    """Of each group the ``pick`` with most rows in common; of equals the smallest by ``order``."""
    return hits.groupBy(*by).agg(F.max_by(pick, F.struct(F.col("n"), -F.col(order))).alias(pick))


def membership_probability(order: DataFrame, clusters: DataFrame, min_pts: float = 4.0, eps: float = 10.0) -> DataFrame:
    """``structure, component, super_id, level, sub_id, key, hits, runs, probability``: how often a vertex falls into each cluster of run 0.

    Run 0 itself counts. Every other run is parted at ``eps``; its super clusters go to the one of run 0 with which they share
    most vertices, and of several the one that shares most stands for it. That one is cut where the levels of run 0 were; its
    stretches go to the cluster of the level with which they share most, of several again the one that shares most, and all
    its members score. Ties go to the smallest id or the first stretch.
    """
    order, part = cut(order.select("structure", "run", "component", "ord", "key", "rd", "weight")), ["structure", "component"]
    base = cut(clusters.filter("run = 0").select(*part, "super_id", "level", "sub_id", "cut", "first", "last"))
    # members of run 0: the last cluster of the level that begins at or before a place, if it reaches it
    own = order.filter("run = 0")
    levels = base.select(*part, "super_id", "level").distinct()
    place = own.select(*part, "ord", "key").join(levels, part)
    start = base.select(*part, "super_id", "level", F.col("first").alias("ord"), F.lit(None).cast("string").alias("key"), "sub_id", "last")
    events = place.withColumn("sub_id", F.lit(None).cast("int")).withColumn("last", F.lit(None).cast("long")).unionByName(start)
    ids = [*part, "super_id", "level"]
    begun = running(events, ids, ["ord", F.col("key").isNotNull()], sums={"nth": F.when(F.col("key").isNull(), 1).otherwise(0)})
    begun = cut(begun)
    opened = begun.filter("key is null").select(*ids, "nth", F.col("sub_id").alias("sub"), F.col("last").alias("till"))
    own = cut(begun.filter("key is not null").join(opened, [*ids, "nth"]).filter("ord <= till").select(*ids, F.col("sub").alias("sub_id"), "key"))
    # super clusters of the other runs and what they stand for
    others = running(order.filter("run > 0"), ["structure", "run", "component"], ["ord"], sums={"part": F.when(F.col("rd") >= eps, 1).otherwise(0)})
    others = cut(others)
    whole = [*part, "run", "part"]
    heavy = others.groupBy(*whole).agg(F.sum("weight").alias("w")).filter(F.col("w") >= min_pts).select(*whole)
    shared = others.join(heavy, whole).join(own.filter("level = 0").select(*part, "super_id", "key"), [*part, "key"]).groupBy(*whole, "super_id").agg(F.count(F.lit(1)).alias("n"))
    goes = _best(shared, whole, "super_id", "super_id").join(shared, [*whole, "super_id"])
    stands = _best(goes, [*part, "run", "super_id"], "part", "part")
    inside = others.join(stands, whole).select(*part, "run", "super_id", "ord", "key", "rd", "weight")
    cuts = base.select(*ids, F.when(F.col("level") == 0, F.lit(eps)).otherwise(F.col("cut")).alias("cut")).distinct()
    members = cut(_stretches(inside, cuts, ids, min_pts))
    by = [*ids, "run", "stretch"]
    shared = members.join(own, [*ids, "key"]).groupBy(*by, "sub_id").agg(F.count(F.lit(1)).alias("n"))
    goes = _best(shared, by, "sub_id", "sub_id").join(shared, [*by, "sub_id"])
    match = _best(goes, [*ids, "run", "sub_id"], "stretch", "stretch")
    scored = match.join(members, by).select(*ids, "sub_id", "key").unionByName(own)
    runs = order.agg(F.countDistinct("run").alias("runs"))
    hits = scored.groupBy(*ids, "sub_id", "key").agg(F.count(F.lit(1)).alias("hits"))
    return hits.crossJoin(F.broadcast(runs)).withColumn("probability", F.col("hits") / F.col("runs"))


def probable_clusters(probabilities: DataFrame, same_site: DataFrame, percent: float = 50.0) -> DataFrame:
    """Members that fall in often enough, widened to all members of their site."""
    ids = [c for c in ("structure", "component", "super_id", "level", "sub_id") if c in probabilities.columns]
    kept = probabilities.filter(F.col("hits") * 100 >= F.col("runs") * percent).select(*ids, "key")
    both = same_site.select(F.col("key1").alias("key"), F.col("key2").alias("other")).unionByName(same_site.select(F.col("key2").alias("key"), F.col("key1").alias("other")))
    return kept.unionByName(kept.join(both, "key").select(*ids, F.col("other").alias("key"))).distinct()
