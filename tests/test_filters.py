from pyspark.sql import functions as F

from mutprox.operators import filters


def test_rows_of_the_same_ends_are_judged_by_their_own_structures(spark):
    """Two rows that agree in all ends but the offset: one has a structure that is not listed."""
    info = "array<struct<distance:double,pdb:string,p_value:double>>"
    row = lambda off, *pdbs: ("U1", "A", 3, off, "U2", "B", 4, off, [(1.0, p, 0.01) for p in pdbs])
    pairs = spark.createDataFrame([row(0, "P1", "P2"), row(1, "P1", "P9"), row(2)], f"uniprot1 string, chain1 string, pos1 int, off1 int, uniprot2 string, chain2 string, pos2 int, off2 int, info {info}")
    ok = spark.createDataFrame([("P1",), ("P2",), ("P2",)], "name string")
    # a caller that names pairs by their ends alone
    named = pairs.withColumn("pair_id", F.concat_ws("/", "uniprot1", "chain1", "pos1", "uniprot2", "chain2", "pos2"))
    out = filters.pass_structures(named, ok)
    assert out.columns == named.columns and sorted(r["off1"] for r in out.collect()) == [0, 2]
