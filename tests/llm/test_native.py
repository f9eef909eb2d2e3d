"""Chat collapse, quality ledger and line dedup on small tables with the awkward cases, against their SQL or by hand."""

import random
import time

import duckdb
import pandas as pd

from mutprox.llm import chat, lines, quality

DOCS = "doc_id long, text string, lang string, n_words long, failed string"
PAGES = "page_id long, url string, html string, site string, lines string"
TURNS = "conv_id long, turn long, role string, text string, place string, block string"


def sql(text, **tables):
    con = duckdb.connect()
    for name, (rows, cols) in tables.items():
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {t}' for c, t in cols)})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(cols))})", rows)
    cur = con.execute(text)
    return pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description], dtype=object)


def same(df, want):
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda f: sorted(tuple("∅" if v is None or v != v else str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert key(got) == key(want)


TEXTS = [
    None, "", " \t\n", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 500, "line\nline\n\nline\r\n \nother", "# $ % & | < > *" * 3,
    "UPPER CASE WORDS " * 10, "É" * 30 + " " + "日本 " * 30, "w\x0bx\x0cy z", "1 2 3 " * 20, "long " + "z" * 20000, "the quick brown fox jumps over the lazy dog " * 3 + "and then some more words follow here to the end",
]


def test_quality(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*r, "en", 5, "clash") for r in rows], DOCS)
    same(quality.verdicts(df), sql(quality.ORACLE, documents=(rows, [("doc_id", "BIGINT"), ("text", "VARCHAR")])))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.filter("failed <> 'clash'").count() == 0
    twice = spark.createDataFrame([(1, "a b", None, None, None), (1, "a b", None, None, None), (None, None, None, None, None)], DOCS)
    assert quality.verdicts(twice).count() == 3 and quality.verdicts(df.limit(0)).count() == 0


def test_ablations(spark):
    entries = quality.ledger(spark.createDataFrame([(i, t, "en", 5, "") for i, t in enumerate(TEXTS)], DOCS)).cache()
    bits = [r["failed"] for r in entries.collect()]
    for r in quality.ablations(entries).collect():
        mask, bit = quality.POLICIES[r["policy"]], quality.BIT[r["rule"]]
        assert r["n_failed"] == sum(b & bit > 0 for b in bits)
        assert r["n_only"] == sum(b & mask == bit for b in bits)
        assert r["n_kept"] == sum(b & mask == 0 for b in bits)
    assert {r["n_kept"] for r in quality.ablations(entries.limit(0)).collect()} == {0}


def test_ledger_is_written_once(spark):
    """No plan behind the ledger splits a text again, and a long text costs no more than its length."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(100_000)]
    df = spark.createDataFrame([(1, " ".join(words), "en", 5, "clash"), (2, "again and " * 50_000, "en", 5, "clash")], DOCS)
    began = time.time()
    kept = quality.keep_good(df)
    assert [r["doc_id"] for r in kept.collect()] == [1]
    assert time.time() - began < 60
    assert "split(" not in kept._jdf.queryExecution().toString()
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.verdicts(df).collect()}[2] == 100_000


def test_ablation_sql(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*r, "en", 5, "clash") for r in rows], DOCS)
    kinds = [("doc_id", "BIGINT"), ("text", "VARCHAR")]
    same(quality.ablations(quality.ledger(df)), sql(quality.ABLATIONS, documents=(rows, kinds)))
    same(quality.ablations(quality.ledger(df.limit(0))), sql(quality.ABLATIONS, documents=([], kinds)))


def page_rows():
    foot = "<footer>&copy; us &amp; them</footer>"
    rows = [(i, f"https://A.example.org/{i}", f"<p>unique {i}</p><script>x()</script><br>{foot}<!-- c --><p> </p>") for i in range(8)]
    rows += [(20, "http://b.example/x", foot), (21, None, foot), (22, "not a url", None), (23, "http://a.example.org:80/", None), (24, "http://a.example.org", "")]
    return rows


def test_page_lines(spark):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    want = sql(lines.ORACLE, pages=(rows, [("page_id", "BIGINT"), ("url", "VARCHAR"), ("html", "VARCHAR")]))
    same(lines.page_lines(df), want)
    assert want.set_index("page_id").loc[0, "n_dropped"] == 1 and want.set_index("page_id").loc[20, "n_dropped"] == 0
    assert lines.page_lines(df.limit(0)).count() == 0


def test_document_lines(spark):
    rows = [(i, f"same line\n\nown {i}", "en", i, "s" if i < 9 else None) for i in range(12)] + [(50, None, "en", 0, "s"), (51, "same line", "en", 0, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, source string")
    got = {r["doc_id"]: r for r in lines.drop_site_lines(df).collect()}
    assert len(got) == 14 and lines.drop_site_lines(df).columns == df.columns
    assert got[3]["text"] == "\nown 3" and got[3]["n_chars"] == 6
    assert got[10]["text"] == "same line\n\nown 10" and got[10]["n_chars"] == 10
    assert got[50]["text"] is None and got[51]["text"] == ""


def test_lists_beyond_the_broadcast(spark):
    """With no room for a broadcast, and one site that holds most pages, the result is the same."""
    rows = page_rows() + [(100 + i, "https://hot.example/", f"<p>own {i}</p><p>all of us</p>") for i in range(60)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    near, far = lines.page_lines(df), lines.page_lines(df, broadcast=0)
    assert sorted(map(str, far.collect())) == sorted(map(str, near.collect()))
    assert "__salt" in far._jdf.queryExecution().toString() and {r["n_dropped"] for r in far.collect() if r["page_id"] >= 100} == {1}


def test_long_page_and_document(spark):
    long = "\n".join(f"line {i % 1000}" for i in range(50_000))
    df = spark.createDataFrame([(i, None, f"<p>{long}</p>", "", "") for i in range(2)], PAGES)
    assert [r["n_lines"] for r in lines.page_lines(df).collect()] == [50_000] * 2
    docs = spark.createDataFrame([(1, long, "s"), (2, None, None)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["text"] for r in lines.drop_site_lines(docs).collect()} == {1: long, 2: None}


def turn_rows():
    base = [("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", None), (None, "odd <|im_end|> text")]
    rows = []
    for conv, n in ((1, 2), (2, 5), (3, 5), (4, 3), (5, 1)):
        rows += [(conv, t, *base[t]) for t in range(n)]
    rows += [(6, t, "user", f"turn {t}") for t in range(150)] + [(7, t, "user", f"turn {t}") for t in range(70)]
    rows += [(8, 0, "user", "x"), (8, 0, "user", "x"), (8, 0, "user", "a"), (8, None, "user", "first"), (9, 0, "user", "hi")]
    return rows


def test_chats(spark):
    rows = turn_rows()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)
    want = sql(chat.ORACLE, conversations=(rows, [("conv_id", "BIGINT"), ("turn", "BIGINT"), ("role", "VARCHAR"), ("text", "VARCHAR")]))
    same(chat.format_chats(df), want)
    assert set(want["conv_id"]) == {2, 6, 8, 9} and len(want) == 3 + 1 + 2 + 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_without_id(spark):
    df = spark.createDataFrame([(None, 0, "user", "a", "", ""), (None, 1, "user", "b", "", ""), (3, 0, "user", "a", "", "")], TURNS)
    assert [(r["conv_id"], r["n_turns"]) for r in chat.format_chats(df).collect()] == [(None, 2)]


def test_random_chats(spark):
    """Ties of number and role, turns without a number, shifted numbers and shared prefixes, against the SQL."""
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        shift = rng.choice([0, 0, 3, 63, 64])
        for t in range(rng.randint(1, 6)):
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                rows.append((conv, None if rng.random() < 0.03 else t + shift, rng.choice(["user", "user", None]), rng.choice(["a", "b", "", None])))
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS).repartition(5)
    want = sql(chat.ORACLE, conversations=(rows, [("conv_id", "BIGINT"), ("turn", "BIGINT"), ("role", "VARCHAR"), ("text", "VARCHAR")]))
    same(chat.format_chats(df), want)
    assert 20 < want["conv_id"].nunique() < 120


def test_long_chat(spark):
    """A text of three million letters, a conversation of 20,000 turns, its prefix, and 5,000 turns without a number."""
    long = [(1, t, "user", f"turn {t}") for t in range(20_000)] + [(2, t, "user", f"turn {t}") for t in range(19_999)]
    rows = long + [(3, 0, "user", "y" * 3_000_000)] + [(4, None, "user", f"turn {t}") for t in range(5_000)]
    got = chat.format_chats(spark.createDataFrame([(*r, "", "") for r in rows], TURNS)).collect()
    assert {r["conv_id"]: r["n_turns"] for r in got} == {1: 20_000, 3: 1, 4: 5_000}
    assert sorted(r["segment"] for r in got if r["conv_id"] == 1) == list(range(313))
    assert next(len(r["text"]) for r in got if r["conv_id"] == 3) == 3_000_000 + len("<|im_start|>user\n<|im_end|>\n")


def test_chat_texts_stay_out_of_the_hashes(spark):
    """Behind the written hashes texts are read once, and what they are joined with holds no text."""
    plan = chat.format_chats(spark.createDataFrame([(*r, "", "") for r in turn_rows()], TURNS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("lag(") == 0
