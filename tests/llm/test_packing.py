import random
import zlib

import numpy as np
import pytest

from mutprox.llm import packing

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("word_bpe_49k.json")
PARTS = ["It's", "don't", " ", "  ", "\n", "É", "é", "́", "漢字", "1234", "...", "\t", "\x1c", " ", "İ", "Σ", "ΑΣ", "<|endoftext|>", "the", "THE ", "\r\n", "ﬁ", "&&&", "word.", "Word,", "'S", "end's.", "x$$$", "<|endoftext|>."]


def texts():
    rng = random.Random(9)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "word " * 9000]


def test_words_give_the_ids_of_the_whole_text():
    lib = tokenizers.Tokenizer.from_file(PATH)
    own = packing.WordTokenizer(PATH).encode(texts())
    for t, raw in zip(texts(), own):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_best_fit_is_the_tightest_window():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 65, 400))[::-1]
    sequence, offset = packing.best_fit(sizes, 64)
    room = []
    for n, s, o in zip(sizes, sequence, offset):
        fits = [r for r in room if r >= n]
        if s == len(room):
            assert not fits and o == 0
            room.append(64)
        assert room[s] == (min(fits) if fits else 64) and o == 64 - room[s]
        room[s] -= n


def test_every_id_lies_in_one_place(spark):
    lib = tokenizers.Tokenizer.from_file(PATH)
    rows = [*enumerate(texts()[-200:]), (900, None), (None, "no id"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body")
    got = packing.pack(df, PATH, window=256, with_ids=True, text_col="body").toPandas()
    want = sorted([*lib.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows)
    assert (got["length"] <= 256).all() and (got["length"] == got["ids"].map(len)).all()
    crc = got["ids"].map(lambda x: zlib.crc32(np.array(x, "<u4").tobytes()))
    assert (crc == got["ids_crc32"]).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 256
    whole = got[~got["doc_id"].isin([5]) & got["doc_id"].notna()].sort_values(["doc_id", "start"]).groupby("doc_id")["ids"].agg(lambda x: [i for y in x for i in y])
    one = {i: t for i, t in rows if i is not None and i != 5}
    assert all(whole[i] == [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t in one.items())
    assert got.groupby(["doc_id", "doc_tokens"], dropna=False)["length"].sum().sum() == sum(map(len, want))
    assert 1 - got["length"].sum() / (got["sequence_id"].nunique() * 256) < 0.02
    assert packing.pack(df.limit(0), PATH, text_col="body").count() == 0


def test_long_texts_and_clashing_names(spark):
    """A text of 300,000 tokens fills windows of its own; columns called like those of the result play no part."""
    rows = [(1, "word " * 300_000), (2, None), (3, ""), (3, "a few words"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 7, "s", 9, "p") for r in rows], "doc_id long, text string, start long, sequence_id string, length long, piece string")
    got = packing.pack(docs, PATH).collect()
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    assert sorted(n for _, n in by) == sorted([300_001, 1, 1, 4, 3])
    for (_, n), parts in by.items():
        parts = sorted(set(parts))
        assert parts[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) == n
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(x)[0][0] == 0 and sum(k for _, k in x) <= 4096 for x in used.values())


def test_known_words_are_looked_up_once():
    from mutprox.llm.queries import tokenizer_path

    class Counted(dict):
        asked = 0

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    made = packing.WordTokenizer(tokenizer_path("word_bpe_49k.json"))
    texts = ["one two  three\none", None, "", "two new words"]
    want = made.encode(texts)
    made.words = Counted(made.words)
    assert made.encode(texts[:3]) == want[:3] and Counted.asked == 7  # five, one blank for the null and one for the empty text
