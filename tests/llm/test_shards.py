import hashlib
import itertools
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mutprox.llm import shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cell string, shard string, slot long, size string"


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 2), (4, 2)])
def test_curve_visits_every_cell_and_moves_one_step(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"x{k} int" for k in range(dims)))
    found = {r["h"]: tuple(r[:dims]) for r in df.withColumn("h", shards.hilbert([F.col(f"x{k}") for k in range(dims)], bits)).collect()}
    assert sorted(found) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(found[k], found[k + 1])) == 1 for k in range(len(cells) - 1))


def documents():
    rng = random.Random(8)
    rows = [(k, rng.choice(["", None, "a b", "é" * 9, "x " * rng.randrange(300)]), rng.choice(["en", "de", "fr", None]), rng.choice(["s1", "s1", "s1", "s10", "s2", "é", "", None])) for k in range(300)]
    rows += [(None, "same", "en", "s1")] * 150 + [(7, "twice", "de", "s2")] * 2 + [(900, "long " * 50_000, "de", "s2")]
    rng.shuffle(rows)
    return [(*r, 1, "clash", "clash", 5, "clash") for r in rows]


def check(got, count):
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(k, [])) for k in range(40)]
    assert len(got) == count == sum(sizes) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_law_holds_and_nothing_is_lost(spark):
    rows = documents()
    got = shards.shard_table(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    check(got, len(rows))
    measured = sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got)
    assert measured == sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    few = shards.shard_table(spark.createDataFrame(rows[:3], SCHEMA)).collect()
    check(few, 3)
    assert shards.shard_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_is_the_same_for_any_window_and_any_split(spark):
    """Ranges of seven rows, with a value of 150 equal rows, number the rows as a single sort does."""
    df = spark.createDataFrame(documents(), SCHEMA)
    slim = shards.measures(df.drop("size")).select("doc_id", "size", "text_crc32", "source", "lang")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    found = []
    for most, parts in ((7, 3), (None, 1), (10**6, 8)):
        placed = shards.place(slim.repartition(parts), ["source", "lang", "size"], key, most=most).collect()
        found.append(sorted((r["shard"], r["slot"], r["cell"], str(r["doc_id"]), r["size"]) for r in placed))
    assert found[0] == found[1] == found[2]
    ranked = [(c, hashlib.md5(f"{'' if i == 'None' else i}:{s}:".encode()).hexdigest()) for _, _, c, i, s in found[0]]
    assert [c for c, _ in ranked] == sorted(c for c, _ in ranked)


def test_files_prune_in_every_dimension(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, "w " * rng.choice([1, 3, 9, 30, 100, 300]), rng.choice(["de", "en", "es", "fr"]), f"s{rng.randrange(30):02d}", 1, "c", "clash", 5, "c") for k in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).drop("size").repartition(4)
    back = shards.write_shards(docs, f"{tmp_path}/hilbert", ["source", "lang", "size"], files=40)
    docs.repartition(40).write.parquet(f"{tmp_path}/plain")
    assert back.count() == 3000 and set(back.columns) == {"doc_id", "text", "lang", "source", "n_chars", "cell", "shard_", "slot_", "shard", "slot"}

    def met(folder, column, value):
        files = [pq.ParquetFile(f).metadata for f in (tmp_path / folder).rglob("*.parquet")]
        ends = [next(g.column(k).statistics for k in range(g.num_columns) if g.column(k).path_in_schema == column) for m in files if m.num_row_groups for g in [m.row_group(0)]]
        return sum(s.min <= value <= s.max for s in ends) / len(ends)

    assert met("plain", "source", "s07") > 0.9 and met("plain", "lang", "en") > 0.9
    share = [met("hilbert", "source", "s07"), met("hilbert", "lang", "en")]
    assert max(share) < 0.75 and share[0] * share[1] < 0.3, share
