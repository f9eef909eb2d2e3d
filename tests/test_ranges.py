import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutprox.operators import annotate, refresh, search, structures
from mutprox.operators.ranges import cells, join_ranges, top_stretches
from mutprox.plans.views import view
from mutprox.sources import readers


def test_cells_make_up_the_range_exactly(spark):
    rng = random.Random(1)
    rows = [(a, a + rng.choice([-1, 0, 1, 7, 8, 100, 1000])) for a in [rng.randrange(-500, 500) for _ in range(200)]] + [(None, 3), (3, None), (0, 2**35), (-(2**33), 5)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", cells(F.col("a"), F.col("b")).alias("c")).collect()
    for r in got:
        if r["a"] is None or r["b"] is None or r["b"] < r["a"]:
            assert r["c"] == []
            continue
        own = sorted((c["cell"] << c["level"], (c["cell"] + 1 << c["level"]) - 1) for c in r["c"])
        assert own[0][0] == r["a"] and own[-1][1] == r["b"]
        assert all(x[1] + 1 == y[0] for x, y in zip(own, own[1:])) and len(own) <= 2 * 41


def test_a_hundred_thousand_ranges_on_one_key(spark):
    rng = np.random.default_rng(3)
    start = rng.integers(0, 10**6, 100_000)
    stop = start + rng.choice([0, 3, 50, 400], 100_000)
    at = rng.integers(0, 10**6, 2000)
    ranges = spark.createDataFrame([("hot", int(a), int(b), int(k)) for k, (a, b) in enumerate(zip(start, stop))] + [("other", 0, 10**6, -1)], "key string, a long, b long, k long")
    places = spark.createDataFrame([("hot", int(x), k) for k, x in enumerate(at)] + [("hot", int(at[0]), 5000), (None, 5, 6000), ("none", 5, 6001)], "key string, at long, n long")
    got = sorted((r["n"], r["k"]) for r in join_ranges(places, ranges, ["key"], "at", "a", "b").select("n", "k").collect())
    want = [(n, int(k)) for n, x in [*enumerate(at), (5000, at[0])] for k in np.flatnonzero((start <= x) & (x <= stop))]
    assert got == sorted(want) and len(want) > 1000
    assert join_ranges(places, ranges.limit(0), ["key"], "at", "a", "b").count() == 0 and join_ranges(places.limit(0), ranges, ["key"], "at", "a", "b").count() == 0


def test_stretches_show_the_top_range(spark):
    rng = random.Random(5)
    rows = [(rng.choice("uv"), a, a + rng.choice([-2, 0, 4, 30, 200]), f"d{k}", k) for k, a in enumerate(rng.randrange(300) for _ in range(120))]
    df = spark.createDataFrame(rows, "u string, a int, b int, name string, line int")
    got = top_stretches(df, ["u"], "a", "b", ["line"], ["name"]).collect()
    for u in "uv":
        want = {}
        for key, a, b, name, _ in rows:
            if key == u:
                want |= dict.fromkeys(range(a, b + 1), name)
        found = [x for r in got if r["u"] == u for x in [(p, r["name"]) for p in range(r["a"], r["b"] + 1)]]
        assert dict(found) == want and len(found) == len(want)
    own = sorted((r["u"], r["a"], r["b"], r["name"]) for r in got)
    assert all(x[0] != y[0] or x[2] + 1 < y[1] or x[3] != y[3] for x, y in zip(own, own[1:]))  # none could be longer
    assert top_stretches(df.limit(0), ["u"], "a", "b", ["line"], ["name"]).count() == 0


def test_features_of_long_ranges_make_no_row_a_residue(spark):
    rows = [("u", 1, 10**9, "DOMAIN", "long", 1), ("u", 5, 10**8, "DISULFID", "bond", 2), ("u", 7, 3, "DOMAIN", "none", 3)]
    f = spark.createDataFrame(rows, "uniprot string, start_pos int, end_pos int, type string, description string, line_no long")
    prox = spark.createDataFrame([("u", 3, 2, "u", 100_000_000, 0), ("u", 4, 0, "w", 999_999_999, 1), ("w", 4, 0, "u", 5, 0)], "uniprot1 string, pos1 int, off1 int, uniprot2 string, pos2 int, off2 int")
    got = sorted((r["pos1"], r["feature1"], r["feature2"]) for r in annotate.annotate_features(prox, f).collect())
    assert got == [(3, "bond", "bond"), (4, "N/A", "N/A"), (4, "long", "long")]
    assert sorted((r["pos1"], r["feature2"]) for r in annotate.annotate_features(prox, f, partner_protein=True).collect()) == [(3, "bond"), (4, "N/A"), (4, "bond")]


def atoms(spark, n=60):
    rng = np.random.default_rng(8)
    centre = rng.uniform(0, 60, (n, 3))
    rows = [("p", "AB"[k % 2], k, "ALA", *map(float, np.round(centre[k] + rng.normal(0, 1.2, 3), 3))) for k in range(n) for _ in range(8)]
    return rows, spark.createDataFrame(rows, "pdb string, chain string, residue_no int, residue_name string, x double, y double, z double")


def test_boxes_rule_pairs_of_residues_out(spark):
    rows, df = atoms(spark)
    reach = 8.0
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if (a[1], a[2]) != (b[1], b[2]):
                key = (*sorted([(a[1], a[2]), (b[1], b[2])]),)
                want[key] = min(want.get(key, 1e9), float(np.linalg.norm(np.array(a[4:]) - np.array(b[4:]))))
    want = {k: d for k, d in want.items() if d <= reach - 0.001}
    got = {((r["chain1"], r["residue_no1"]), (r["chain2"], r["residue_no2"])): r["distance"] for r in structures.shortest_residue_distances(df, reach).collect()}
    assert want.keys() <= got.keys() and all(abs(got[k] - d) < 0.002 for k, d in want.items()) and all(d <= reach for d in got.values())
    def pairs(table, at):
        made = structures.near_boxes(table, at).agg(F.sum(F.size("pts1") * F.size("pts2"))).head()[0]
        return made, structures._near(table, table, at).count()

    made, before = pairs(df, reach)
    assert made * 4 <= before, (made, before)
    made, before = pairs(view(spark, "/root/testdata/sf0.001", "atoms"), reach)  # scattered residues: an atom is a box of its own
    assert made * 4 <= before, (made, before)
    one = structures.residues_near(df.filter("residue_no = 4"), df, reach).collect()
    assert {(r["chain2"], r["residue_no2"]) for r in one} == {b if a == ("A", 4) else a for a, b in got if ("A", 4) in (a, b)}
    assert structures.shortest_residue_distances(df.limit(0), reach).count() == 0


def test_pairs_in_buckets_are_not_dealt_again(spark, monkeypatch):
    rng = random.Random(2)
    near = spark.createDataFrame([(f"U{rng.randrange(9)}", rng.randrange(40), k) for k in range(800)], "uniprot1 string, at1 long, k long")
    m = spark.createDataFrame([(f"U{rng.randrange(9)}", rng.randrange(40), "g", "1", k, k, "p.A1C") for k in range(50)], "uniprot string, u_pos long, gene string, chromosome string, start_pos long, stop_pos long, aa_change string")
    want = sorted(tuple(r) for r in search.hits_at(m, near).select("k", "start_pos").collect())
    stored = readers.write_bucketed(near, ("uniprot1", "at1"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = search.hits_at(m, stored)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in met.select("k", "start_pos").collect()) == want and len(want) > 50
        grouped = stored.groupBy("uniprot1", "at1").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Bucketed: true" in plan and "Exchange" not in grouped


def test_refresh_touches_only_what_changed(spark, tmp_path):
    rng = np.random.default_rng(4)
    residues, ranges = [], []
    for p in range(6):
        for c in "AB":
            protein = f"U{(p + (c == 'B')) % 5}"
            ranges.append((f"p{p}", c, protein, 1, 12, 1, 12, 0))
            residues += [(f"p{p}", c, k, "ALA", *map(float, np.round(rng.uniform(0, 30, 3), 3))) for k in range(1, 13)]
    residues = spark.createDataFrame(residues, "pdb string, chain string, residue_no int, residue_name string, x double, y double, z double")
    ranges = spark.createDataFrame(ranges, "pdb string, chain string, uniprot string, p_start int, p_stop int, u_start int, u_stop int, offset_no int")
    path = f"{tmp_path}/pairs"
    old = F.col("pdb") != "p1"
    refresh.store(refresh.pairs_of(residues.filter(old), ranges.filter(old)), path)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "pairs").rglob("*.parquet")}
    from mutprox.operators.genes import proteins_to_refresh

    now, before = ranges.select("uniprot", "pdb").distinct(), ranges.filter(old).select("uniprot", "pdb").distinct()
    changed = proteins_to_refresh(now, before, before.select("uniprot"))
    assert {r["uniprot"] for r in changed.collect()} == {"U1", "U2"}
    full = refresh.pairs_of(residues, ranges)
    for _ in range(2):  # a repeated run changes nothing
        got = refresh.refresh(path, residues, ranges, changed).select(full.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "pairs").rglob("*.parquet")}
    same = {f for f in files if after.get(f) == files[f]}
    assert {re.search("uniprot1=(U.)", str(f))[1] for f in same} == {"U0", "U3", "U4"}
    assert {re.search("uniprot1=(U.)", str(f))[1] for f in set(files) - same} == {"U1", "U2"}
    assert refresh.refresh(path, residues, ranges, changed.limit(0)).count() == full.count()


def test_ranges_with_the_same_bounds_are_cut_to_the_top_one(spark, monkeypatch):
    """A table that repeats its ranges is read once and no row of it is taken apart into cells again and again."""
    from mutprox.operators import ranges

    df, sizes, cut = spark.range(4000).selectExpr("'u' AS u", "cast(id % 4 AS int) AS a", "cast(id % 4 + 2 AS int) AS b", "concat('d', id) AS name", "id AS line"), [], ranges.cut
    monkeypatch.setattr(ranges, "cut", lambda d: (out := cut(d), sizes.append(out.count()))[0])
    got = sorted(tuple(r) for r in ranges.top_stretches(df, ["u"], "a", "b", ["line"], ["name"]).collect())
    assert got == [("u", 0, 0, "d3996"), ("u", 1, 1, "d3997"), ("u", 2, 2, "d3998"), ("u", 3, 5, "d3999")]
    assert sizes == [4]
