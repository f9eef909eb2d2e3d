import hashlib
import random

import numpy as np

from mutprox.llm import suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, window=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            s = raw[p : p + window]
            if s in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(s)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (not p or not gone[p - 1]))
        rest = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß\n ") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(60, 250)], " ".join(word() for _ in range(rng.randint(0, 30)))]
        texts.append("".join(parts))
    return texts + [texts[3], texts[5] + "x", "a" * 1000, "ab" * 400, "a" * 150, None, "", "short", "z" * 99, "z" * 100, "z" * 100]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = suffix.repeat_digest(df).collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got}, df


def test_matches_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        ids = list(range(len(texts)))
        random.Random(seed).shuffle(ids)
        rows = list(zip(ids, texts))
        got, df = run(spark, rows)
        assert got == plain(rows)
    kept = suffix.remove_repeats(df)
    assert kept.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert len(left) == len(rows)
    for i, t in rows:
        if plain(rows)[i][1] == 0:
            assert left[i] == t


def test_blocks_and_rows_do_not_hide_windows(monkeypatch):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 100, 199, 2000, 2000, 5000])
    want = {(r, p) for r in range(6) for p in range(offsets[r + 1] - offsets[r] - 99)}
    for block in (1 << 19, 700):
        monkeypatch.setattr(suffix, "BLOCK", block)
        _, row, first, count, _ = suffix.anchors(text, offsets)
        got = [(int(r), int(f + k)) for r, f, c in zip(row, first, count) for k in range(c)]
        assert len(got) == len(set(got)) and set(got) == want


def test_repeated_rows_empty_table_null_ids(spark):
    t = " ".join(str(i) for i in range(100))
    assert suffix.repeat_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, t, None, None, None), (1, t, "a", "b", 1), (None, t, "a", "b", 1), (2, "x" + t, "a", "b", 1)], SCHEMA)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in suffix.repeat_digest(df).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, len(t)), (True, 0, len(t))]


def test_many_rows_without_an_id_and_clashing_names(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 130))) for _ in range(5000)]
    texts[17] = texts[4000] = "q" * 60 + "shared by two rows " * 6
    df = spark.createDataFrame([(None, t, "x", "y") for t in texts], "doc_id long, text string, kept_text string, mark string")
    out = suffix.remove_repeats(df)
    assert out.columns == df.columns and out.count() == 5000
    got = suffix.repeat_digest(df)
    assert got.count() == 5000
    key = lambda t: hashlib.sha256(t.encode()).hexdigest()
    left = sorted(r["kept_sha256"] for r in got.collect())
    # equal texts without an id are one document; inside a text of a short period later windows still go
    want = suffix.repeat_digest(spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i != 4000], "doc_id long, text string"))
    want = {r["doc_id"]: r["kept_sha256"] for r in want.collect()}
    assert left == sorted([*want.values(), want[17]])
    assert sum(v == key(t) for v, t in ((want[i], texts[i]) for i in want)) >= 4990


def test_long_text(spark):
    rng = random.Random(13)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(100_000))
    df = spark.createDataFrame([(1, long), (2, "x" * 300), (3, long[5000:5400] + "tail")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.repeat_digest(df).collect()}
    assert got == {1: (0, 0), 2: (299, 1), 3: (400, 1)}


def _distinct_texts(rng):
    alphabet = rng.choice([b"ab", b"a", b"abcdefgh", bytes(range(4)), b"\xff\x00a"])
    draw = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    base = draw(40)
    texts = sorted({draw(rng.randint(1, 12)) + base[rng.randint(0, 20) : rng.randint(20, 40)] + draw(rng.randint(0, 12)) for _ in range(rng.randint(1, 12))})
    rng.shuffle(texts)
    return texts


def _common(a, b):
    return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_matching_statistics_by_brute_force():
    """Rows and lengths of every place, from the runs alone, are those of the suffixes in order."""
    rng = random.Random(1)
    for _ in range(150):
        texts = _distinct_texts(rng)
        index = suffix.RunIndex(texts)
        row, above, below = index.statistics()
        rest = {(i, p): t[p:] for i, t in enumerate(texts) for p in range(len(t) + 1)}
        order = sorted(rest, key=lambda k: ([x + 1 for x in rest[k]] + [0], k[0]))
        for k, (i, p) in enumerate(order):
            at = index.start[i] + p
            before = _common(rest[order[k - 1]], rest[i, p]) if k else 0
            behind = _common(rest[order[k + 1]], rest[i, p]) if k + 1 < len(order) else 0
            assert (row[at], above[at], below[at]) == (k, before, behind)


def test_repeats_by_the_lengths():
    rng = random.Random(2)
    for _ in range(150):
        texts, window = _distinct_texts(rng), rng.choice([1, 3, 10])
        seen, want = set(), []
        for i, t in enumerate(texts):
            for p in range(len(t) - window + 1):
                if t[p : p + window] in seen:
                    want.append((i, p))
                seen.add(t[p : p + window])
        index = suffix.RunIndex(texts)
        hit = index.repeated(window)
        assert [(int(index.text_of[x]), int(x - index.start[index.text_of[x]])) for x in hit] == want


def test_index_keeps_runs_only():
    """Of the order nothing as long as the text is kept but the text's own bytes; a repetitive text has few runs."""
    rng = random.Random(3)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(4000))
    texts = [base[:k] + b"!" + base[k:] for k in range(1, 60)]
    index = suffix.RunIndex(texts)
    assert len(index.row) < sum(map(len, texts)) / 20 and len(index.first) == len(index.last) == len(index.row)
    index.last = np.zeros_like(index.last)  # the statistics stand on the sampled run ends
    assert (index.statistics()[1] != suffix.RunIndex(texts).statistics()[1]).any()


def test_index_size_changes_nothing(spark, monkeypatch):
    rng = random.Random(4)
    part = ["".join(rng.choice("abcd") for _ in range(150)) for _ in range(5)]
    rows = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(0, 50))) + rng.choice(part) + rng.choice(part)) for i in range(120)]
    want = plain(rows)
    for size in (1, 1 << 19):
        monkeypatch.setattr(suffix, "INDEX_BYTES", size)
        got = suffix.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == want
