from mutprox.operators import report


def test_lists_of_samples_travel_and_not_the_pairs(spark, monkeypatch):
    """Small lists are broadcast whatever the planner's own limit is; beyond ``LISTS`` the joins give the same."""
    calls = [("G1", "p.A1C", "TCGA-AA-0001"), ("G1", "p.A1C", "TCGA-AA-0001"), ("G1", "p.A1C", "TCGA-AA-0002"), ("G2", "p.A2C", "TCGA-AA-0002"), ("G2", "p.A2C", "other"), ("G3", "p.A3C", None)]
    maf = spark.createDataFrame(calls, "gene string, aa_change string, sample string")
    pairs = spark.createDataFrame([("G1", "p.A1C", "G2", "p.A2C"), ("G1", "p.A1C", "G2", "p.A2C"), ("G2", "p.A2C", "G3", "p.A3C")], "gene1 string, mutation1 string, gene2 string, mutation2 string")
    want = [("G1", "p.A1C", "G2", "p.A2C", "TCGA-AA-0001:2|TCGA-AA-0002:1", "TCGA-AA-0002:1", "TCGA-AA-0002"), ("G2", "p.A2C", "G3", "p.A3C", "TCGA-AA-0002:1", None, None)]
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in was:
            spark.conf.set(k, "-1")
        found = report.cooccurring_samples(pairs, maf)
        assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
        assert sorted(tuple(r) for r in found.collect()) == want
        monkeypatch.setattr(report, "LISTS", 1)
        joined = report.cooccurring_samples(pairs, maf)
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in joined.collect()) == want
        assert report.cooccurring_samples(pairs.limit(0), maf.limit(0)).count() == 0
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
