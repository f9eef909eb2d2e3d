import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from tests.llm.test_suffix import plain as plain_repeats


def brute_lines(rows, ratio=0.05, least=5):
    """rows: (id, source, text) -> id: text without lines of more than ``ratio`` of the source's documents."""
    count, total = {}, {}
    for _, s, t in rows:
        total[s] = total.get(s, 0) + 1
        for x in {y.strip(" ") for y in t.split("\n")} - {""}:
            count[s, x] = count.get((s, x), 0) + 1
    common = {k for k, n in count.items() if n >= least and n > ratio * total[k[0]]}
    return {i: "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in common) for i, s, t in rows}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(30)) for _ in range(rng.randint(2, 5))) for _ in range(150)]
    shared = " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, f"All rights reserved.\n{t}" if i % 4 == 0 else f"{t}\n{shared}" if i % 50 == 1 else t, "en", f"s{i % 2}", len(t)))
    rows += [(200, texts[3], "en", "s0", 1), (201, "too short", "en", "s0", 1), (202, None, None, None, None), (203, "", "en", "s1", 0)]
    rows += [(204, "### $$$ %%% " * 40, "en", "s1", 1), (205, "word " * 200, "en", "s0", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    now, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        now = spark.createDataFrame(stage(spark, now, "").collect(), stage(spark, now, "").schema)
        seen[name] = (before, now)
        if name != "packing":
            assert now.columns == columns
    before, after = seen["quality_rules"]
    assert {i for i in before if i < 200} | {200} == {r["doc_id"] for r in after.collect()}
    before, after = seen["line_dedup"]
    want = brute_lines([(i, r["source"], r["text"]) for i, r in before.items()])
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert any("reserved" in r["text"] for r in before.values()), [r["text"][:50] for r in before.values()][:5]
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["doc_id"] % 4 == 0 and r["doc_id"] < 200)
    before, after = seen["near_dedup"]
    assert set(before) - {r["doc_id"] for r in after.collect()} == {200}
    before, after = seen["passage_dedup"]
    left = {r["doc_id"]: r["text"] for r in after.collect()}
    sizes = plain_repeats([(i, r["text"]) for i, r in before.items()])
    assert set(left) == set(before) and any(x[1] for x in sizes.values())
    assert all(len(left[i].encode()) == n - gone for i, (n, gone, _, _) in sizes.items())
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after.collect()} == set(before)


def test_empty_table(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0
