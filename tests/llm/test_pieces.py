import hashlib
import random

import pytest

from mutprox.llm import pieces

public = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public.path("piece_bpe_32k.model")
PARTS = ["a", "e", " ", "  ", "▁", "\n", "é", "漢", "字", "😀", "\x00", "́", "th", "ing", "\t", "\r", "ﬁ", "1", "$", "<s>", "<0x41>", "　", "\xa0", "the ", "and"]


def texts():
    rng = random.Random(7)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return [*made, "", " ", "     ", "▁", "\n\n", " " * 40 + "x", "a" * 3000, "b " * 3000]


def test_same_ids_and_text_as_the_library():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.PieceTable(PATH)
    for t in texts():
        want = lib.encode(t)
        assert own.encode(t) == want, repr(t[:60])
        assert own.decode(want) == lib.decode(want)


def test_pair_test_equals_full_merges():
    own = pieces.PieceTable(PATH)
    rng = random.Random(3)
    names = sorted(own.id)
    runs = [p for p in names if set(p) == {pieces.SPACE}]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(4000)] + [(rng.choice(runs), rng.choice(runs)) for _ in range(200)]
    for s, t in pairs:
        if all(len(x) == 1 or x in own.fits for x in (s, t)):
            assert own.compatible(s, t) == (own.merge(s + t) == [s, t]), (s, t)


def test_decode_of_broken_bytes():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.PieceTable(PATH)
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.choice([3 + 0xE6, 3 + 0xBC, 3 + 0xA2, 3 + 0x41, 3 + 0xFF, 263, 1000, 29871]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_operator(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [*enumerate(texts()[-120:]), (500, None), (None, "the end"), (3, "twice")]
    df = spark.createDataFrame([(i, t, "kept out") for i, t in rows], "doc_id long, text string, ids string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((str(i), len(e := lib.encode(t or "")), sha(",".join(map(str, e))), sha(lib.decode(e) if e else "")) for i, t in rows)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.piece_digest(df, PATH).collect())
    assert got == want
    back = pieces.decode(pieces.encode(df, PATH), PATH)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(i), (t or "").replace("▁", " ")) for i, t in rows)
    assert pieces.piece_digest(df.limit(0), PATH).count() == 0


def test_memory_does_not_change_ids(monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 7)
    monkeypatch.setattr(pieces, "MEMO_UNITS", 3)
    own = pieces.PieceTable(PATH)
    for t in texts()[:300]:
        found = [own.units[u] for u in own.cut(t)]
        assert ",".join(x[0] for x in found) == ",".join(map(str, lib.encode(t)))
        assert "".join(x[2] for x in found)[1:] == lib.decode(lib.encode(t))
    assert len(own.units) <= 3 and all(len(u) <= pieces.UNIT_CHARS for u in own.units)


def test_long_texts_and_clashing_names(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(9)
    long = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(100_000)), "x" * 200_000, "漢" * 50_000]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(long)], "doc_id long, text string, id long, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in pieces.piece_digest(df, PATH).collect()}
    assert got == {i: len(lib.encode(t)) for i, t in enumerate(long)}
