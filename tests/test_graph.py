import random
from functools import reduce
from operator import add

import numpy as np
import pytest

from mutprox.operators import graph
from mutprox.operators.scan import running

EDGES = "structure string, key1 string, key2 string, distance double"


def brute_paths(n, edges):
    m = np.full((n, n), np.inf)
    np.fill_diagonal(m, 0)
    for a, b, d in edges:
        m[a, b] = m[b, a] = min(m[a, b], d)
    for k in range(n):
        np.minimum(m, m[:, k : k + 1] + m[k : k + 1, :], out=m)
    return m


def random_graph(rng, n):
    return [(int(a), int(b), float(rng.uniform(0.5, 9))) for a, b in rng.integers(0, n, (2 * n, 2)) if a != b]


def tables(spark, n, edges, site):
    """Two structures with one graph each (the second with distances doubled), and pairs at one site."""
    key = lambda i: f"k{i:03d}"
    rows = [(s, *sorted((key(a), key(b))), d * f) for s, f in (("s", 1), ("t", 2)) for a, b, d in edges]
    pairs = spark.createDataFrame([tuple(sorted((key(a), key(b)))) for a, b in site], "key1 string, key2 string")
    return spark.createDataFrame(rows, EDGES), pairs


@pytest.mark.parametrize("n,bound,step", [(50, None, None), (120, 9.0, None), (120, 12.0, 3.0), (60, None, 4.0)])
def test_paths_equal_the_matrix(spark, n, bound, step):
    rng = np.random.default_rng(n)
    edges = random_graph(rng, n)
    site = [(int(a), int(b)) for a, b in rng.integers(0, n, (6, 2)) if a != b]
    df, pairs = tables(spark, n, edges, site)
    components = graph.super_clusters(df)
    label = {(r["structure"], r["key"]): r["super_id"] for r in components.collect()}
    linked = {k for e in edges for k in e[:2]}
    inside = [(a, b, 0.0) for a, b in site if a in linked and b in linked and label["s", f"k{a:03d}"] == label["s", f"k{b:03d}"]]
    want = {}
    for s, f in (("s", 1), ("t", 2)):
        m = brute_paths(n, [(a, b, d * f) for a, b, d in edges] + inside)
        want |= {(s, f"k{i:03d}", f"k{j:03d}"): m[i, j] for i in linked for j in linked if np.isfinite(m[i, j]) and (bound is None or m[i, j] <= bound)}
    got = {(r["structure"], r["key1"], r["key2"]): r["geodesic"] for r in graph.geodesics(df, pairs, components, bound, step).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_paths_of_an_empty_graph(spark):
    none = spark.createDataFrame([], EDGES)
    pairs = spark.createDataFrame([], "key1 string, key2 string")
    components = graph.super_clusters(none)
    assert graph.geodesics(none, pairs, components).count() == 0
    scores = spark.createDataFrame([], "structure string, super_id int, key string, ref_alt string, score double")
    assert graph.radius_clusters(scores, graph.geodesics(none, pairs, components)).count() == 0


def brute_clusters(keys, score, dist, radius):
    left, out = set(keys), []
    while left:
        c = min(left, key=lambda k: (-abs(score[k]), k))
        members = {k for k in left if k == c or dist[c, k] <= radius}
        out.append((c, members))
        left -= members
        if len(members) < 2:
            break
    return out


@pytest.mark.parametrize("n", [5, 50, 120, 200])
def test_radius_clusters_stop_at_the_first_single_vertex(spark, n):
    rng = np.random.default_rng(n)
    m = brute_paths(n, random_graph(rng, n))
    keys = [f"k{i:03d}" for i in range(n)]
    score = {k: float(np.round(rng.normal(), 1)) for k in keys}  # with ties
    dist = {(keys[i], keys[j]): float(m[i, j]) for i in range(n) for j in range(n)}
    geo = spark.createDataFrame([("any", s, a, b, d) for s in (0, 1) for (a, b), d in dist.items() if d <= 6], "structure string, super_id int, key1 string, key2 string, geodesic double")
    scores = spark.createDataFrame([("any", s, k, r, x) for s in (0, 1) for k in keys for r, x in (("A:C", score[k]), ("A:G", score[k] / 2))], "structure string, super_id int, key string, ref_alt string, score double")
    got = graph.radius_clusters(scores, geo, 4.0).collect()
    want = brute_clusters(keys, score, dist, 4.0)
    for s in (0, 1):
        found = {}
        for r in got:
            if r["super_id"] == s:
                found.setdefault((r["sub_id"], r["centroid"]), set()).add(r["key"])
                assert r["geodesic"] == dist[r["centroid"], r["key"]]
        assert [(c, found[k, c]) for k, c in sorted(found)] == want
        assert [k for k, _ in sorted(found)] == list(range(len(want)))


def test_running_sums_over_one_large_group(spark):
    rng = random.Random(2)
    rows = [("hot", k, float(rng.randrange(9))) for k in range(3000)] + [(None, k, 1.0) for k in range(40)] + [("b", 5, 2.0)]
    rng.shuffle(rows)
    from pyspark.sql import functions as F

    got = running(spark.createDataFrame(rows, "g string, k int, w double").repartition(7), ["g"], [-F.col("k")], number="n", sums={"total": F.col("w")}).collect()
    for g in ("hot", None, "b"):
        total = 0.0
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: -r["k"])
        for at, r in enumerate(mine):
            total += r["w"]
            assert (r["n"], r["total"]) == (at, total)
        assert len(mine) == sum(x[0] == g for x in rows)
    assert running(spark.createDataFrame([], "g string, k int"), ["g"], ["k"], number="n").count() == 0


def test_rounds_of_paths_are_dealt_and_added_up_by_hash(spark, monkeypatch):
    """Few bytes make many rows in a round: they are dealt to tasks first, and no round sorts what it adds up."""
    edges = [(a, a + 1, 1.0) for a in range(6)] + [(0, 6, 9.0)]
    df, pairs = tables(spark, 7, edges, [])
    components, rounds, cut = graph.super_clusters(df), [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda d: (rounds.append(d._jdf.queryExecution().executedPlan().toString()), cut(d))[1])
    got = {(r["key1"], r["key2"]): r["geodesic"] for r in graph.geodesics(df, pairs, components).collect() if r["structure"] == "s"}
    assert got["k000", "k006"] == 6.0 and len(got) == 49
    rounds = rounds[2:]  # the first two are the arcs and the start
    assert rounds and all("SortAggregate" not in p and "REPARTITION_BY_NUM" in p for p in rounds)


def test_rounds_of_paths_read_nothing_to_go_on(spark, monkeypatch):
    """What the next round starts from is seen while a round is written, not by reading it again."""
    df, pairs = tables(spark, 4, [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 3.0)], [])
    components = graph.super_clusters(df)
    monkeypatch.setattr(type(df), "head", lambda *_: pytest.fail("a round was read"))
    got = {(r["key1"], r["key2"]): r["geodesic"] for r in graph.geodesics(df, pairs, components, 5.0, 2.0).collect() if r["structure"] == "s"}
    assert got["k000", "k002"] == 3.0 and got["k001", "k003"] == 5.0 and ("k000", "k003") not in got


def test_exponential_scores_make_no_other_scores(spark, monkeypatch):
    from mutprox.plans import queries

    class Small:
        def __init__(self, *_):
            self.edges = lambda: spark.createDataFrame([("any", "a", "b", 2.0)], EDGES)
            self.weights = lambda: spark.createDataFrame([(k, "A:C", f"T:p.A{n}C", "G", float(n)) for n, k in enumerate("ab", 1)], "mutation_key string, ref_alt string, protein_key string, gene string, weight double")

    made, real = [], graph.vertex_scores
    monkeypatch.setattr(queries, "Steps", Small)
    monkeypatch.setattr(graph, "vertex_scores", lambda *a, **k: (made.append(k), real(*a, **k))[1])
    got = {r["key"]: r["score"] for r in queries.exponential_scores(spark, "").collect()}
    want = lambda d1, d2: round(np.exp(1 / 20 - d1 / 10) + 2 * np.exp(2 / 20 - d2 / 10), 6)
    assert got == {"a": want(0, 2), "b": want(2, 0)} and made == [{"score": "exponentials"}]


def test_counted_pairs_are_rounded_like_pairs(spark):
    """Ten pairs at 0.1 have the mean of ten additions, not 0.1: a path that ends at a cutoff falls on the same side."""
    cols = "key1 string, key2 string, chain1 string, chain2 string, info array<struct<distance:double,pdb:string,p_value:double>>"
    row = ("a", "b", "A", "A", [(0.1, "P", 0.01)])
    counted = graph.pair_distance(spark.createDataFrame([(*row, 10)], f"{cols}, n long").coalesce(1), max_distance=10.0, n="n")
    singly = graph.pair_distance(spark.createDataFrame([row] * 10, cols).coalesce(1), max_distance=10.0)
    assert counted.head()["distance"] == singly.head()["distance"] == reduce(add, [0.1] * 10) / 10 != 0.1
