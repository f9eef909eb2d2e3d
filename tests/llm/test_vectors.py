import numpy as np

from mutprox.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def plain(rows, least=0.93):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    low, n = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    p, q = sorted((root(a[0]), root(b[0])))
                    low[q] = p
    return {i: (n[i], root(i), root(i) == i) for i in n}


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = []
    for k in range(220):
        v = base[k % 40] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2, 0.3])
        rows.append((k, (v * rng.choice([1, 3])).astype(np.float32).tolist(), int(k % 40 % 3), "clash"))
    rows += [(300, None, 1, ""), (301, [0.0] * 16, 1, ""), (302, [float("nan")] * 16, 1, ""), (303, [None] + [1.0] * 15, 1, ""), (304, [float("inf")] * 16, 1, "")]
    rows += [(305, rows[0][1], None, ""), (306, [1.0, 2.0], 0, ""), (307, [1.0, 2.0], 0, ""), (308, [5.0], 0, ""), (309, [], 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    for tile in (4096, 7):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df, tile=tile).collect()}
        assert got == want
    assert sum(n for n, _, _ in want.values()) > 300
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_different_vectors_under_one_id(spark):
    near = [(i, [1.0, 0.01 * i, 0.0], 0, "") for i in (7, 8, 9)]
    df = spark.createDataFrame([*near, (7, [0.0, 0.0, 1.0], 0, "")], SCHEMA)
    assert sorted((r["vec_id"], r["n_links"]) for r in vectors.near_vectors(df).collect()) == [(7, 0), (7, 2), (8, 2), (9, 2)]


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0], 0, ""), (1, [1.0, 1.0], 0, ""), (None, [1.0, 1.0], 0, ""), (5, [2.0, 2.0], 0, "")], SCHEMA)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.near_vectors(df).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("5", 2, "1", False), ("None", 0, "None", True)]


def test_vectors_of_extreme_length(spark):
    """Squares of these overflow or vanish; their directions do not."""
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal(8), rng.standard_normal(8)
    sizes = [1.0, 1e200, 1e-200, 1e308 / 9, 1e-300]
    rows = [(10 * k + j, (v * s).tolist(), 0) for k, s in enumerate(sizes) for j, v in ((0, a), (1, b))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    assert got == {i: (len(sizes) - 1, i % 10) for i, _, _ in rows}


def test_scaling_changes_no_bit():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 6)) * 10.0 ** rng.integers(-9, 9, (50, 1))
    y = vectors.scaled(x)
    assert (np.abs(y).max(axis=1) <= 1).all() and (np.abs(y).max(axis=1) >= 0.5).all()
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    assert (y / np.sqrt((y * y).sum(axis=1))[:, None] == unit).all()
