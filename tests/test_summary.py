from mutprox.operators import report

COLS = "cluster string, gene string, mutation string, degree long, score double, geodesic double, weight double, chromosome string, start string, stop string, ref string, alt string, transcript string, weight_is_recurrence boolean, line_no long"
#: Rows of one known cluster.
KNOWN = [
    ("0.1", "SMAD3", "p.M255I", 5, 0.0268, 8.197, 1.0, "15", "67473685", "67473685", "G", "A", "T3"),
    ("0.1", "SMAD3", "p.R268C", 7, 2.021, 0.0, 1.0, "15", "67473722", "67473722", "C", "T", "T3"),
    ("0.1", "SMAD3", "p.R268H", 7, 2.021, 0.0, 2.0, "15", "67473723", "67473723", "G", "A", "T3"),
]


def summary(spark, rows, recurrence):
    return {r["cluster"]: r for r in report.cluster_summary(spark.createDataFrame([(*r, recurrence, i) for i, r in enumerate(rows)], COLS)).collect()}


def test_known_cluster(spark):
    r = summary(spark, KNOWN, False)["0.1"]
    assert len(r) == 22 and r["centroid"] == "SMAD3:p.R268H"
    assert [round(r[c], 3) for c in ("score_sum", "score_mean", "mean_recurrence", "mean_degree", "mean_geodesic")] == [4.069, 1.356, 1.0, 6.333, 2.732]
    assert (r["recurrence_mass"], r["n_genes"], r["n_vertices"], r["n_genomic"], r["n_protein"], r["n_sites"], r["n_positions"], r["n_drugs"]) == (3, 1, 3, 3, 3, None, 2, None)
    assert (r["genes"], r["transcripts"], r["positions"], r["protein_mutations"]) == ("SMAD3(3)", "T3(3)", "255,268", "SMAD3:p.M255I,SMAD3:p.R268C,SMAD3:p.R268H")
    assert r["protein_sites"] is r["drugs"] is None


def test_recurrence_sites_and_drugs(spark):
    rows = [*KNOWN, ("0.1", "SMAD3", "p.S300", 2, 1.0, 3.0, 4.0, None, "300", "300", "-", "ptm", "T3"), ("0.1", "aspirin", "SMAD3", 1, 1.0, 0.0, 9.0, None, None, None, None, None, None), ("d", "aspirin", None, 1, 1.0, 0.0, 9.0, *[None] * 6)]
    got = summary(spark, rows, True)
    r = got["0.1"]
    assert r["centroid"] == "aspirin"  # the last row at distance 0
    assert (r["recurrence_mass"], r["n_vertices"], r["n_sites"], r["n_drugs"], r["n_positions"], r["n_genomic"]) == (4, 9, 1, 1, 3, 3)
    assert r["mean_recurrence"] == 4 / 3 and r["mean_degree"] == 22 / 9
    assert (r["protein_sites"], r["drugs"], r["genes"], r["transcripts"]) == ("SMAD3:p.S300", "aspirin", "SMAD3(4)", "T3(4)")
    d = got["d"]
    assert (d["centroid"], d["drugs"], d["n_vertices"], d["genes"], d["recurrence_mass"], d["n_genomic"]) == ("aspirin", "aspirin", 1, None, None, None)
    assert summary(spark, [], True) == {}
