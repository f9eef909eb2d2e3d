import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from mutprox.llm import langid

WORDS = {"en": ["the", "and", "thing", "with", "of"], "fr": ["été", "où", "le", "çais", "ê"], "de": ["über", "schön", "und", "ß", "der"]}


def rows(n=240):
    rng = random.Random(3)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 120))), lang))
    return out


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], 4, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, target = rng.integers(97, 105, (9, 3)), np.array([0, 1, 2])
    _, grads = net.gradients(codes, target)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[k][at] += 1e-3
        up, _ = net.gradients(codes, target)
        net.p[k][at] -= 2e-3
        down, _ = net.gradients(codes, target)
        net.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[at]) < 1e-2 * abs(g[at]) + 1e-6, k


def test_pooling_equals_one_text_at_a_time():
    net = langid.Network(["a", "b"], 5, 2)
    texts = [b"", b"x", b"y" * 128, b"hello " * 70, b"z" * 129]
    offsets = np.cumsum([0, *map(len, texts)])
    got = langid.pooled(net, np.frombuffer(b"".join(texts), np.uint8), offsets)
    for raw, p in zip(texts, got):
        parts = [net.probabilities(np.frombuffer(raw[a : a + 128], np.uint8)[:, None])[:, 0] for a in range(0, len(raw), 128)]
        want = np.concatenate(parts).mean(axis=0) if parts else np.zeros(2)
        assert np.allclose(p, want, atol=1e-5)


def test_held_out_accuracy_and_edge_cases(spark):
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 456", "fr"), (1003, "the thing with the", None), (None, "über schön der", None)]
    df = spark.createDataFrame(rows() + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as held_out", "'x' as score")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len(got) == 245
    for i, _, lang in rows():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    fold = [(i, lang) for i, _, lang in rows() if got[i]["held_out"]]
    assert len(fold) > 50 and sum(got[i]["lang_pred"] == lang for i, lang in fold) / len(fold) > 0.98
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).count() == 0


def test_letters_are_category_l(spark):
    known = [(10 + i, f"the and of {i} " * 30, "en") for i in range(9)] + [(30 + i, f"der die und {i} " * 30, "de") for i in range(9)]
    df = spark.createDataFrame([(1, "½ ² Ⅷ ①", None), (2, "é", None), *known], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, langid.Training(steps=2)).collect()}
    assert got[1] == "und" and got[2] != "und"


def test_sample_is_bounded_by_language_not_by_order(spark):
    """Copies of one text and the order of the table do not push the other language out."""
    rows = [(i, "one and the same text " * 5, "en") for i in range(400)] + [(1000 + i, f"zeile {i} und mehr " * 5, "de") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keyed = df.select("lang", F.struct(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("draw"), "text").alias("x"))
    for parts in (1, 7):
        found = langid._first_rows(keyed.repartition(parts), 20)
        assert {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()} == {"en": 20, "de": 20}
