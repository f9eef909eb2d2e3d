import random
from itertools import product
from math import erf, sqrt

import pytest

from mutprox.operators import stats
from mutprox.plans import queries

SMALL = "/root/testdata/sf0.001"


def test_many_draws_follow_the_law(spark):
    n, gone = 400, 10**12
    obs = spark.createDataFrame([("c", 4.4 * n, 1.0, float(n)), ("far", 4.4 * gone, 1.0, float(gone)), ("near", 4.6 * gone, 1.0, float(gone))], "cluster string, distance_sum double, mass double, n_pairs double")
    back = spark.createDataFrame([(c, float(x)) for c in ("c", "far", "near") for x in range(10)], "cluster string, distance double")
    got = {r["cluster"]: (r["p_value"], r["n_sims"]) for r in stats.cluster_significance(obs, back, 40_000, 10_000).collect()}
    want = (1 + erf((4.4 - 4.5) / (sqrt(8.25 / n) * sqrt(2)))) / 2
    assert got["c"][0] == pytest.approx(want, abs=0.02) and got["far"][0] == 0.0 and got["near"][0] == 1.0
    assert {x[1] for x in got.values()} == {40_000}


def test_query_keeps_weights_and_simulations(spark, monkeypatch):
    seen, plain = {}, stats.cluster_significance

    def watch(observed, background, *args, **kwargs):
        seen["mass"] = observed.select("cluster", "mass").collect()
        seen["far"] = background.filter("distance > 20").count()
        return plain(observed, background, *args, **kwargs)

    monkeypatch.setattr(stats, "cluster_significance", watch)
    found = queries.QUERIES["cluster_significance"](spark, SMALL).collect()
    calls = queries.view(spark, SMALL, "maf").filter("classification <> 'Silent'").groupBy("gene").count().collect()
    assert {r["cluster"]: r["mass"] for r in seen["mass"]} == {r["gene"]: r["count"] for r in calls}
    assert seen["far"] > 0  # the background holds all distances of the structure
    assert {r["n_sims"] for r in found if r["p_value"] is not None} == {1_000_000}


def test_query_makes_ten_runs(spark):
    rows = queries.QUERIES["membership_probability"](spark, SMALL).collect()
    assert rows and {r["runs"] for r in rows} == {10} and {r["hits"] for r in rows} <= set(range(1, 11))  # the run whose clusters are looked for counts


def test_simulation_agrees_with_the_exact_law(spark):
    rng = random.Random(3)
    obs, back = [], []
    for k in range(10):
        values = [round(rng.uniform(0, rng.choice([5, 60])), 3) for _ in range(rng.choice([7, 200]))]
        n = float(rng.choice([3, 6, 15, 45]))
        mean = sum(values) / len(values) * rng.uniform(0.6, 1.1)
        obs.append((f"c{k}", mean * n, 9, n))
        back += [(f"c{k}", v) for v in values]
    obs = spark.createDataFrame(obs, "cluster string, distance_sum double, mass long, n_pairs double")
    back = spark.createDataFrame(back, "cluster string, distance double")
    exact = {r["cluster"]: r["p_value"] for r in stats.exact_significance(obs, back).collect()}
    found = {r["cluster"]: r["p_value"] for r in stats.cluster_significance(obs, back, 40_000, 10_000).collect()}
    assert len(exact) == 10 and sum(0.01 < p < 0.99 for p in exact.values()) >= 5
    assert all(abs(found[c] - p) < 5 * sqrt(max(p * (1 - p), 1e-4) / 40_000) for c, p in exact.items())


def test_exact_law_by_counting(spark):
    values, n = [0.0, 0.5, 1.25, 4.0], 4
    obs = spark.createDataFrame([("c", 5.25, 3, float(n)), ("large", 1.0, 3, 1e9), ("none", 1.0, 3, 3.0)], "cluster string, distance_sum double, mass long, n_pairs double")
    back = spark.createDataFrame([(c, v) for c in ("c", "large") for v in values], "cluster string, distance double")
    got = {r["cluster"]: r["p_value"] for r in stats.exact_significance(obs, back).collect()}
    assert got["c"] == pytest.approx(sum(sum(x) < 5.25 for x in product(values, repeat=n)) / 4**n, abs=1e-9)
    assert got["large"] is None and got["none"] is None


def test_small_masses(spark):
    """One mutation seen once has no p-value; two have that of their pair in the best structure."""
    info = "array<struct<distance:double,pdb:string,p_value:double>>"
    members = spark.createDataFrame([("one", "g", "p.A1C", 1.0), ("two", "g", "p.A2C", 1.0), ("two", "h", "p.A3C", 1.0), ("twice", "g", "p.A4C", 2.0), ("more", "g", "p.A5C", 2.0), ("more", "h", "p.A6C", 1.0)], "cluster string, gene string, mutation string, weight double")
    pairs = spark.createDataFrame([("g", "p.A2C", "h", "p.A3C", [(7.0, "X", 0.03), (3.0, "Y", 0.01), (5.0, "X", 0.02)]), ("g", "p.A5C", "h", "p.A6C", [(4.0, "X", 0.01)])], f"gene1 string, mutation1 string, gene2 string, mutation2 string, info {info}")
    best = spark.createDataFrame([(c, "X") for c in ("one", "two", "twice", "more")], "cluster string, pdb string")
    observed = stats.within_cluster_distance(members, pairs, best)
    back = spark.createDataFrame([(c, float(x)) for c in ("one", "two", "twice", "more") for x in range(9)], "cluster string, distance double")
    got = {r["cluster"]: (r["p_value"], r["n_sims"]) for r in stats.cluster_significance(observed, back, 2000, 1000).collect()}
    assert got["one"] == (None, None) and got["two"] == (0.02, 0) and got["twice"] == (None, 0) and got["more"][1] == 2000
    exact = {r["cluster"]: r["p_value"] for r in stats.exact_significance(observed, back).collect()}
    assert exact["one"] is None and exact["two"] == 0.02 and 0 < exact["more"] < 1
