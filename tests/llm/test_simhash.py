import random
import re

import numpy as np
import xxhash

from mutprox.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, most=3):
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                x, y = sorted((root(a), root(ids[j])))
                low[y] = x
    return {i: root(i) for i in ids}


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(rng.choice(["The", "ÀB", "x y", "dog.\n", "\tZ", "ß"]) for _ in range(n))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_tree_finds_every_close_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]))
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    group = np.sort(rng.integers(0, 3, len(fp)))
    _, group = np.unique(group, return_inverse=True)
    tree = simhash.GrayTree(group, fp)
    a, b = tree.search(group, fp, np.arange(len(fp)), 3)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    want = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j and group[i] == group[j]}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_groups_dealt_again_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    near = [base]
    for k in (1, 2, 3, 4):
        x = base.copy()
        for _ in range(k):
            x ^= np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)
        near.append(x)
    fp = np.unique(np.concatenate(near))
    rows = [(int(f), i) for i, f in enumerate(fp.view(np.int64))]
    from mutprox.operators.components import connected_components

    df = spark.createDataFrame(rows, "fp long, rep long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(df, 3, group_rows=2)).collect()}
    want = plain_components([r[1] for r in rows], [int(f) for f in fp])
    assert {i: got.get(i, i) for i in want} == want


def test_documents(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(12)]
    near = [t + " tail" for t in texts[:6]]
    all_texts = [*texts, *near, *texts[:3], None, "", " \n ", "one", "one two", "x" * 5000, "Long tale of ÄB words " * 20_000]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(all_texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.simhash_components(df).collect()}
    fps = [plain_fingerprint(t) for t in all_texts]
    want = plain_components(list(range(len(rows))), fps)
    assert got == {i: (fps[i], want[i]) for i in want}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_empty_table_and_null_ids(spark):
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c", "en", "s", 1), (4, "a b c", "en", "s", 1), (4, "a b c", "en", "s", 1)], SCHEMA)
    got = sorted((r["doc_id"] is None, r["component_id"]) for r in simhash.simhash_components(df).collect())
    assert got == [(False, 4), (False, 4), (True, 4)]  # a row without an id belongs to the class of its text
    none = spark.createDataFrame([(None, "a b c", "en", "s", 1), (None, "x y z", "en", "s", 1), (None, None, "en", "s", 1)], SCHEMA)
    assert [r["component_id"] for r in simhash.simhash_components(none).collect()] == [None] * 3


def test_a_row_without_an_id_joins_its_neighbours(spark):
    """Of a chain of three texts the middle one has no id; the ends are too far apart to link without it."""
    rng = random.Random(4)
    apart = lambda a, b: bin(simhash.fingerprint(a) ^ simhash.fingerprint(b)).count("1")

    def moved(text):
        while True:
            words = text.split()
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            if 2 <= apart(text, out := " ".join(words)) <= 3:
                return out

    first = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    while True:
        middle = moved(first)
        last = moved(middle)
        if apart(first, last) > 3:
            break
    rows = [(1, first, "en", "s", 1), (None, middle, "en", "s", 1), (2, last, "en", "s", 1), (3, "quite another text", "en", "s", 1)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, None: 1, 2: 1, 3: 3}
