import hashlib

from pyspark.sql import functions as F

from mutprox.llm import warc

PAGES = "page_id long, url string, html string, digest string"


def rows():
    out = [(i, f"http://h/{i}", f"<p>päge {i}\r\n\r\nWARC/1.0\r\n\r\n{'x' * (i % 50)}</p>", "clash") for i in range(0, 1600, 3)]
    return out + [(5000, None, None, ""), (5001, "http://a\r\nb", "", ""), (None, "http://null", "no id", ""), (9, "http://h/9", "again", "")]


def test_round_trip_and_audit(spark, tmp_path):
    df = spark.createDataFrame(rows(), PAGES)
    first = warc.read_archive(spark, warc.write_archive(df, f"{tmp_path}/a"))
    got = first.collect()
    want = {r["digest"] for r in df.select(F.sha2(warc.record(F.col("page_id"), F.col("url"), F.col("html")), 256).alias("digest")).collect()}
    assert len(got) == len(rows()) and {r["digest"] for r in got} == want
    for file in {r["file"] for r in got}:
        own = sorted((r for r in got if r["file"] == file), key=lambda r: r["seq"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"] + 4
    worn = df.withColumn("html", F.when(F.col("page_id") == 300, F.lit("other")).otherwise(F.col("html"))).filter("page_id is null or page_id <> 5001")
    second = warc.read_archive(spark, warc.write_archive(worn, f"{tmp_path}/b"))
    status = {r["page_id"]: r["status"] for r in warc.audit(first, second).filter("status <> 'ok'").collect()}
    assert status == {300: "damaged", 5001: "missing"}
    assert [r["status"] for r in warc.audit(second, first).filter("page_id = 5001").collect()] == ["extra"]
    assert warc.audit(first, first).filter("status <> 'ok'").count() == 0


def test_tree_by_hand(spark):
    digests = [hashlib.sha256(bytes([k])).hexdigest() for k in range(20)]
    records = spark.createDataFrame([(0, k, 10 * k, 6, k, d) for k, d in enumerate(digests)], "file long, seq long, offset long, length long, page_id long, digest string")
    levels = warc.merkle_tree(records)
    up = {r["n"]: (r["first"]["offset"], r["last"]["offset"], r["digest"]) for r in levels[1].collect()}
    node = lambda ks: hashlib.sha256(",".join(f"0:{k}:{digests[k]}" for k in ks).encode()).hexdigest()
    assert up == {0: (0, 150, node(range(16))), 1: (160, 190, node(range(16, 20)))}
    assert levels[-1].count() == 1


def test_any_number_of_records_and_files(spark):
    """Places beyond 2^20 in one file, and files far apart or without ids, stay apart."""
    kinds = "file long, seq long, offset long, length long, page_id long, digest string"
    places = [(0, 5), (0, (1 << 20) + 5), (1, 5), (-1, 5), (-3, 0), (10**9, 2)]
    ours = spark.createDataFrame([(f, q, q, 1, None, "a") for f, q in places], kinds)
    for hit in places:
        theirs = spark.createDataFrame([(f, q, q, 1, None, "b" if (f, q) == hit else "a") for f, q in places], kinds)
        assert [(r["file"], r["seq"]) for r in warc.audit(ours, theirs).filter("status = 'damaged'").collect()] == [hit]
    assert warc.merkle_tree(ours)[-1].count() == 1


def test_pages_without_an_id_and_a_long_page(spark, tmp_path):
    df = spark.createDataFrame([(None, f"http://n/{i}", "x", "") for i in range(1500)] + [(1, "u", "y" * 3_000_000, "")], PAGES)
    got = warc.read_archive(spark, warc.write_archive(df, f"{tmp_path}/n"))
    assert {r["file"] for r in got.select("file").distinct().collect()} == {-3, -2, -1, 0} and got.count() == 1501
    assert warc.audit(got, got).filter("status <> 'ok'").count() == 0 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_drill(spark):
    got = warc.drill(spark.createDataFrame(rows(), PAGES)).filter("status = 'damaged'").collect()
    assert {r["page_id"] for r in got} == {i for i in range(0, 1600, 3) if i % 500 == 7}


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], PAGES)
    assert warc.drill(df).count() == 0


def test_no_file_takes_all_pages_without_a_name(spark, tmp_path):
    """Pages without id and URL, pages under one id, and pages alike in everything are dealt to files of bounded size."""
    out = [(None, None, f"page {i % 1500}", "") for i in range(3000)] + [(77, "http://a", f"text {i}", "") for i in range(3000)]
    out += [(900, "http://b", "same", "")] * 2500 + [(i, f"http://h/{i}", f"p{i}", "") for i in range(5000, 5600)]
    df = spark.createDataFrame(out, PAGES)
    first = warc.read_archive(spark, warc.write_archive(df, f"{tmp_path}/a"))
    sizes = {r["file"]: r["count"] for r in first.groupBy("file").count().collect()}
    assert sum(sizes.values()) == len(out) and max(sizes.values()) < 1200
    assert all(n > 0 for n in sizes.values()) and sum(f < 0 for f in sizes) >= 12 and {9, 10} <= set(sizes)
    want = {r["digest"]: r["n"] for r in df.select(F.sha2(warc.record(F.col("page_id"), F.col("url"), F.col("html")), 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).collect()}
    assert {r["digest"]: r["n"] for r in first.groupBy("digest").agg(F.count("*").alias("n")).collect()} == want
    second = warc.read_archive(spark, warc.write_archive(df.repartition(7), f"{tmp_path}/b"))
    assert warc.audit(first, second).filter("status <> 'ok'").count() == 0
    found = warc.drill(df).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in found} == {"ok": len(out) - 2, "damaged": 2}  # pages 5007 and 5507
