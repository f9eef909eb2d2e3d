import random

from mutprox.llm import nearsets, simhash


def brute(rows, least=0.8):
    """rows: (id, text) -> id: smallest id of the class that links at ``least`` join."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    top = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            x, y = sets[i], sets[j]
            if i < j and (x == y or len(x & y) / len(x | y) >= least):
                a, b = sorted((top[i], top[j]))
                top = {k: a if v == b else v for k, v in top.items()}
    return top


def planted(seed=3, n=60):
    """Texts of 300 words and copies at similarity of about 0.75 to 0.95: the words of one stretch replaced."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(n):
        base = [word() for _ in range(300)]
        copy = list(base)
        gone = rng.randint(4, 40)
        at = rng.randint(0, 300 - gone)
        copy[at : at + gone] = [word() for _ in range(gone)]
        rows += [(i, " ".join(base)), (1000 + i, " ".join(copy))]
    return rows


def test_near_copies_go(spark):
    rows = planted()
    want = brute(rows)
    near = sum(want[i] != i for i, _ in rows)
    assert near > 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in nearsets.keep_one(docs).collect()} == {i for i in want if want[i] == i}
    assert len(rows) - simhash.keep_one(docs).count() < near / 2  # three differing bits miss most of them


def test_one_large_group_and_odd_rows(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(80):  # similar to the first text at about 0.9, to one another at about 0.82 and less
        copy = list(base)
        at = rng.randrange(190)
        copy[at : at + 5] = [f"x{rng.randrange(10**6)}" for _ in range(5)]
        rows.append((i, " ".join(copy)))
    line = " ".join(f"c{k}" for k in range(30))  # a line that many texts share makes no copies of them
    rows += [(100 + i, line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))) for i in range(40)]
    rows += [(200, ""), (201, None), (202, "one two"), (203, "One  two"), (204, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {r["id"]: r["keep"] for r in nearsets.near_classes(docs).collect()} == want
    assert {r["id"]: r["keep"] for r in nearsets.near_classes(docs, tile=7).collect()} == want
    more = docs.unionByName(spark.createDataFrame([(None, "one two"), (100, "one two")], docs.schema))
    kept = [r["doc_id"] for r in nearsets.keep_one(more).collect()]
    assert kept.count(None) == 1 and kept.count(100) == 2  # the other text of id 100 is no copy


def test_empty(spark):
    assert nearsets.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_outlive_line_dedup(spark):
    from mutprox.llm import lines

    text = "first line of the copy\nsecond line of the copy"
    rows = [(i, text, "s") for i in range(30)] + [(100 + i, f"foot\nown line {i}", "s") for i in range(60)]
    out = lines.drop_site_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all(got[i] == text for i in range(30)) and all(got[100 + i] == f"own line {i}" for i in range(60))
    assert {r["text"] for r in nearsets.keep_one(out).collect() if r["doc_id"] < 100} == {text}


def test_very_long_texts_and_clashing_names(spark):
    """Texts of 60,000 words, one a near copy of the other and one half as long; columns called like those of the joins."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    copy = list(base)
    for _ in range(400):
        copy[rng.randrange(60_000)] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(base[:30_000])), (4, "x" * 200_000), (5, "x" * 200_000), (6, " " * 100_000)]
    docs = spark.createDataFrame([(*r, "n", "k", "l", "b") for r in rows], "doc_id long, text string, node string, key string, label string, band string")
    kept = nearsets.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6]


def test_fingerprints_are_searched_in_the_gray_order_index(spark, monkeypatch):
    """The index meets near copies, bands what it cannot; a pair that only looks alike by its fingerprint is no link."""
    rows = planted(seed=5, n=40)
    words = rows[0][1].split()
    assert nearsets.set_fingerprint(nearsets.shingle_set(rows[0][1])) & (1 << 64) - 1 == simhash.fingerprint(rows[0][1], 5)
    rows += [(500, " ".join([*words[:-1], "other"])), (501, "one two"), (502, "")]
    found = []
    monkeypatch.setattr(nearsets, "fingerprint_links", lambda prints: found.append(simhash.fingerprint_links(prints)) or found[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["keep"] for r in nearsets.near_classes(docs).collect()} == brute(rows)
    assert len(found) == 1 and found[0].count() > 0
    # far apart in truth, one fingerprint: kept apart by the check on whole sets
    monkeypatch.setattr(nearsets, "fingerprint_links", lambda prints: prints.crossJoin(prints.select(prints["rep"].alias("b"))).select(prints["rep"].alias("a"), "b").filter("a < b"))
    assert {r["id"]: r["keep"] for r in nearsets.near_classes(docs).collect()} == brute(rows)
