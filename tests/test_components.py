import random

from mutprox.operators.components import connected_components


def test_random_graphs_and_chains(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (2000, 2000), (None, 3)]
    low = {}

    def root(x):
        low.setdefault(x, x)
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            low[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in low}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
