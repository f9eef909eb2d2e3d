import numpy as np
import pytest

from mutprox.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def plain(rows, parts, entries, rounds, scale=4096):
    """The contract by loops; rows of (id, vector, label) with distinct ids and one length."""
    kept = sorted((r for r in rows if r[1] is not None and None not in r[1] and np.isfinite(r[1]).all()), key=lambda r: r[0])
    q = [np.floor(np.float32(r[1]).astype(float) * scale).astype(np.int64) for r in kept]
    cutup = [x.reshape(parts, -1) for x in q]
    books = [[cutup[e][p] for e in range(min(entries, len(q)))] for p in range(parts)]

    def best(p, x):
        return min((int(((x - c) ** 2).sum()), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        got = [[best(p, x[p])[1] for x in cutup] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[p] for x, g in zip(cutup, got[p]) if g == e]
                if mine:
                    books[p][e] = np.array([sum(int(m[k]) for m in mine) // len(mine) for k in range(len(mine[0]))])
    last = [[best(p, x[p]) for p in range(parts)] for x in cutup]
    return {r[0]: ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)) for r, found in zip(kept, last)}, books


@pytest.mark.parametrize("span", [1, 3, 4096])
def test_trie_finds_the_nearest_entry(monkeypatch, span):
    monkeypatch.setattr(codes, "SPAN", span)
    rng = np.random.default_rng(span)
    books = rng.integers(-3, 4, (3, 5, 4))
    pos, parts = rng.integers(0, 3, 400), rng.integers(-3, 4, (400, 4))
    entry, far = codes.nearest(pos, parts, books)
    d = ((parts[:, None, :] - books[pos]) ** 2).sum(axis=2)
    assert (entry == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    assert codes.nearest(pos[:0], parts[:0], books)[0].size == 0


def test_prefixes_are_shared(monkeypatch):
    """Equal parts and equal leading dimensions are worked out once."""
    made = []
    real = np.repeat
    monkeypatch.setattr(codes.np, "repeat", lambda a, n, **k: made.append(int(np.sum(n))) or real(a, n, **k))
    parts = np.array([[1, 2, k % 3] for k in range(900)])
    codes.nearest(np.zeros(900, np.int64), parts, np.zeros((1, 2, 3), np.int64))
    assert made == [1, 1, 3]


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    base = np.round(rng.standard_normal((9, 16)), 1)
    rows = [(int(k), base[k % 9].astype(np.float32).tolist() if k % 4 else (base[k % 9] + rng.standard_normal(16) * 0.1).astype(np.float32).tolist(), [0, 0, 1, None][k % 4], "x", 1) for k in rng.permutation(150)]
    rows += [(500, None, 0, "", 0), (501, [float("nan")] * 16, 0, "", 0), (502, [None] + [1.0] * 15, 1, "", 0), (503, [float("inf")] * 16, 1, "", 0)]
    want, books = plain(rows, 4, 6, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    coded, found = codes.compress(df, parts=4, entries=6, rounds=3)
    assert {r["id"]: (r["code"], r["error"]) for r in coded.collect()} == want
    assert found.tolist() == [[c.tolist() for c in b] for b in books]
    back = {r["id"]: r["vec"] for r in codes.decompress(coded, found).collect()}
    whole = {r[0]: np.floor(np.float32(r[1]).astype(float) * 4096) for r in rows if r[0] in want}
    assert all(((np.array(back[i]) * 4096 - whole[i]) ** 2).sum() == want[i][1] for i in want)


def test_errors_are_summed_by_label(spark):
    rows = [(k, [float(k % 7), float(k % 3), 0.5, 1.0] * 4, [None, 3, 3][k % 3], "", 0) for k in range(60)]
    got = codes.code_digest(spark.createDataFrame(rows, SCHEMA)).collect()
    total = {}
    for r in got:
        label = rows[r["vec_id"]][2]
        total[label] = total.get(label, 0) + r["error"]
    assert len(got) == 60 and all(r["label_error"] == total[rows[r["vec_id"]][2]] for r in got)
    assert len({r["codebooks_sha256"] for r in got}) == 1


def test_odd_rows(spark):
    vec = [0.25, -0.25] * 8
    rows = [(None, vec, None, "", 0), (4, vec, 1, "", 0), (4, vec, 1, "", 0), (7, [1.0, 2.0], 1, "", 0), (1, [], 1, "", 0), (9, [3e38] * 16, 2, "", 0)]
    got = sorted((str(r["vec_id"]), r["code"], r["error"]) for r in codes.code_digest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [g[0] for g in got] == ["1", "4", "4", "7", "9", "None"]
    assert got[0][1:] == (None, None) and got[3][1:] == (None, None)
    assert got[1] == got[2] and got[1][1:] == ("00" * 8, 0) and got[5][1:] == ("00" * 8, 0)
    few, books = codes.compress(spark.createDataFrame(rows[1:2], SCHEMA))
    assert books.shape == (8, 1, 2) and few.collect()[0]["error"] == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert codes.code_digest(empty).count() == 0
    assert codes.code_digest(spark.createDataFrame([(1, None, 1, "", 0), (2, [1.0], 1, "", 0)], SCHEMA)).collect()[0]["code"] is None


def test_distances_fit_a_long():
    for width, parts in ((8, 8), (2, 8), (512, 8), (1, 1)):
        assert 4 * codes.bound(width, parts) ** 2 * width * parts < 1 << 63
