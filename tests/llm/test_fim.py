import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from mutprox.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, form string, output string, n long"


@given(st.text(alphabet=st.sampled_from("a é\n \U0001f600 \t€"), max_size=60))
def test_index_converts_cuts_both_ways(text):
    data = text.encode()
    index = fim.ByteIndex(np.frombuffer(data, np.uint8))
    chars = np.arange(len(text) + 1)
    places = np.array([len(text[:k].encode()) for k in chars])
    assert index.chars == len(text)
    assert (index.to_byte(chars) == places).all() and (index.to_char(places) == chars).all()
    assert len(index.byte) == sum(c > "\x7f" for c in text)


@given(st.text(alphabet=st.sampled_from("ab é\n\x0b\x1f \t€"), max_size=60))
def test_words_end_where_the_pattern_says(text):
    ends = [len(text[: m.end()].encode()) for m in TOKEN.finditer(text)]
    assert fim.word_ends(np.frombuffer(text.encode(), np.uint8)).tolist() == ends


def plain(doc_id, text, unit="word", rate=50, spm_rate=80):
    text = text or ""
    units = TOKEN.findall(text) if unit == "word" else list(text)
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm_rate else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < spm_rate else "psm", len(p), len(m), out


def rows():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  é\n€\U0001f600<P") for _ in range(rng.randrange(80))) for _ in range(150)]
    texts += [None, "", " ", "\n\t ", "one", "a<P>b c", "<S>", "x<M", "   ", "word " * 40_000, "é" * 100_000, " " * 50_000]
    return [(k, t, "clash", "clash", 7) for k, t in enumerate(texts)] + [(None, "a b c d", "", "", 0), (3, texts[3], "", "", 0), (3, texts[3], "", "", 0)]


@pytest.mark.parametrize("unit,rate", [("word", 50), ("char", 50), ("word", 100)])
def test_matches_brute_force(spark, unit, rate):
    df = spark.createDataFrame(rows(), SCHEMA)
    made = fim.transform(df, unit=unit, rate=rate)
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect())
    want = sorted((str(r[0]), *plain(r[0], r[1], unit, rate)) for r in rows())
    assert got == want
    assert {"plain", "spm", "psm"} == {g[2] for g in got}


def test_outputs_give_the_text_back(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = sorted((str(r["doc_id"]), r["output_sha256"], r["restored_sha256"]) for r in fim.transform_digest(df).collect())
    assert got == sorted((str(r[0]), sha(plain(r[0], r[1])[4]), sha(r[1])) for r in rows())
    assert fim.transform_digest(df.limit(0)).count() == 0
