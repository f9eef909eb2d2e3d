"""Column functions, filters and readers on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from mutprox.functions import columns as C
from mutprox.operators import annotate, density, filters, genes, graph, report, stats, structures
from mutprox.sources import readers


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).head().asDict()


def test_protein_changes(spark):
    s = lambda x: F.lit(x)
    got = one(
        spark, a=C.aa_position(s("p.R273C")), b=C.aa_position(s("NULL")), c=C.aa_parts(s("p.R273C")), d=C.search_aa_position(s("p.*277in_frame_ins")),
        e=C.search_aa_position(s("p.K10fs")), f=C.search_aa_position(s("e12+1")), g=C.aa_parts(s("x")),
    )
    assert (got["a"], got["b"], tuple(got["c"]), got["d"], got["e"], got["f"], got["g"]) == (273, None, ("R", 273, "C"), 277, 10, None, None)


def test_info_lists(spark):
    got = one(spark, a=C.decode_info(F.lit("2.561 1U7V 0.004409|8.2 2XYZ 0.5|")), b=C.encode_info(C.decode_info(F.lit("2.561 1U7V 0.004409|"))), c=C.decode_info(F.lit("")))
    assert [tuple(x) for x in got["a"]] == [(2.561, "1U7V", 0.004409), (8.2, "2XYZ", 0.5)] and got["b"] == "2.561 1U7V 0.004409" and got["c"] == []


def test_numbers(spark):
    got = one(
        spark, a=C.round_thousandth(F.lit(1.2345)), b=C.round_thousandth(F.lit(-1.2345)), c=C.null_is_zero(F.lit("N/A")), d=C.num_only(F.lit("x-12.5y")), e=C.num_only(F.lit("x12")),
        f=C.euclidean(*[F.lit(float(x)) for x in (0, 0, 0, 1, 2, 2)]), g=C.linear_distance(F.lit("U"), F.lit(3), F.lit(1), F.lit("U"), F.lit(9), F.lit(0)), h=C.linear_distance(F.lit("U"), F.lit(3), F.lit(1), F.lit("V"), F.lit(9), F.lit(0)),
    )
    assert got["a"] == 1.235 and got["b"] == -1.234 and got["c"] == "0" and got["d"] == "-12.5" and got["e"] == "x12" and got["f"] == 3.0 and got["g"] == 5 and got["h"] is None


def test_names(spark):
    got = one(
        spark, a=C.residue_letter(F.lit("TRP")), b=C.residue_letter(F.lit("HOH")), c=C.residue_code(F.lit("K")), d=C.is_aa(F.lit("ala")), e=C.is_aa(F.lit("HOH")), f=C.strip_chain(F.lit("[A]")), g=C.clean_domain(F.lit("SH2 {ECO:1}")), h=C.clean_domain(F.lit("N/A")),
        i=C.sample_id(F.lit("TCGA-AB-1234-01A")), j=C.normalize_chr(F.lit("chr 7q31")), k=C.hgvs_g(F.lit("7"), F.lit(5), F.lit(8), F.lit("A"), F.lit("T")), l=C.structure_key(F.lit("1ABC"), F.lit("B"), F.lit("A"), True, True), m=C.structure_key(F.lit("1ABC"), F.lit("B"), F.lit("A"), False, False),
        n=C.same_major_band(F.lit("7q31.2"), F.lit("7q32")), o=C.same_major_band(F.lit("7q31"), F.lit("7p31")), p=C.same_major_band(F.lit("7qter"), F.lit("7q12")), q=C.ranges_overlap(F.lit(9), F.lit(5), F.lit(10), F.lit(12), 2), r=C.ranges_overlap(F.lit(1), F.lit(2), F.lit(None).cast("int"), F.lit(4)),
    )
    assert [got[k] for k in "abcdefgh"] == ["W", "HOH", "LYS", True, False, "A", "SH2", "NULL"]
    assert [got[k] for k in "ijklmnopqr"] == ["TCGA-AB-1234", "7", "7:g.5-8A>T", "1ABC:A:B", "any", True, False, True, True, None]


def test_score_terms(spark):
    got = one(spark, a=C.closeness_term(F.lit(1.0), F.lit(8.746)), b=C.exponential_term(F.lit(2.0), F.lit(10.0)))
    assert got["a"] == pytest.approx(0.0023291188, abs=1e-9) and got["b"] == pytest.approx(2 * 2.718281828 ** (0.1 - 1), abs=1e-6)


def test_maf_reader(spark, tmp_path):
    head = "Hugo_Symbol\tChromosome\tStart_Position\tEnd_Position\tVariant_Classification\tReference_Allele\tTumor_Seq_Allele1\tTumor_Seq_Allele2\tTumor_Sample_Barcode\ttranscript_name\tamino_acid_change\tw"
    (tmp_path / "a.maf").write_text(f"{head}\nTP53\t17\t5\t6\tMissense_Mutation\tA\tA\tT\tS1\tENST1\tp.R1C\t3\nTP53\t17\t5\t6\tSilent\tA\tA\tT\tS1\n")
    rows = readers.read_maf(spark, f"{tmp_path}/a.maf", weight_col="w").collect()
    assert len(rows) == 1 and rows[0]["start_pos"] == 5 and rows[0]["weight"] == 3.0
    with pytest.raises(ValueError, match="nope"):
        readers.read_maf(spark, f"{tmp_path}/a.maf", aa_col="nope")


def test_gene_map_reader(spark, tmp_path):
    (tmp_path / "hupt").write_text("TP53\tP04637\t1ABC 2DEF\tp53\tENST1[1|1-30|30:40|35-50|45]\nX\tN/A\tN/A\tN/A\t\n")
    m = readers.read_gene_map(spark, f"{tmp_path}/hupt")
    assert sorted(r["pdb"] for r in readers.gene_structures(m).collect()) == ["1ABC", "2DEF"]
    seg = sorted(tuple(r) for r in readers.parse_segments(m).collect())
    assert seg == [("ENST1", "P04637", 1, 30, 1, 30), ("ENST1", "P04637", 35, 45, 40, 50)]


def test_proximity_reader(spark, tmp_path):
    rows = ["P1\t[A]\t1\t0\tALA\tP2\t[B]\t2\t0\tGLY\t3.5\t1ABC", "WARNING: x", "P1\tA\t1\t0\tALA\tP2\t[B]\t2\t0\tGLY\t3.5\t1ABC", "P1\t[A]\t1\t0\tALA\tP2\t[B]\t2\t0\tGLY\tfar\t1ABC", "P-1\t[A]\t1\t0\tALA\tP2\t[B]\t2\t0\tGLY\t3.5\t1ABC"]
    (tmp_path / "p.csv").write_text("\n".join(rows))
    good, bad = readers.read_proximity(spark, f"{tmp_path}/p.csv")
    assert [r["chain1"] for r in good.collect()] == ["A"] and sorted(r["reason"] for r in bad.collect()) == ["coordinate", "protein", "proximity"]


def test_structure_text(spark):
    atom = "ATOM      1  CA  ALA A  10      11.104   6.134  -6.504"
    het = "HETATM    2  O   HOH    11A     1.000   2.000   3.000"
    text = "\n".join([atom, het, "ENDMDL", atom.replace(" 10 ", " 99 "), "DBREF  1ABC A    1    25  UNP    P04637   P53_HUMAN      94    118", "DBREF  1ABC B    1    25  UNP    P1   X      94    118", "DBREF  1ABC B    1    25  UNP    P2   X      94    118"])
    df = spark.createDataFrame([("1ABC", text)], "pdb string, text string")
    rows = structures.parse_atoms(df).orderBy("line_no").collect()
    assert [(r["chain"], r["residue_no"], r["residue_name"]) for r in rows] == [("A", "10", "ALA"), ("Z", "11A", "HOH")] and rows[0]["x"] == 11.104
    assert [tuple(r) for r in structures.parse_dbref(df).collect()] == [("1ABC", "A", "P04637", 1, 25, 94, 118)]


def test_adjusted_ranges(spark):
    ranges = spark.createDataFrame([("p", "A", "U", 1, 20, 1, 21, 0), ("p", "B", "U", 1, 20, 1, 20, 0), ("p", "C", "U", 1, 20, 1, 22, 5)], "pdb string, chain string, uniprot string, p_start int, p_stop int, u_start int, u_stop int, offset_no int")
    adv = spark.createDataFrame([("p", "A", 10, "DELETION"), ("p", "B", 5, "INSERTION"), ("p", "C", 7, "INSERTION"), ("p", "C", 12, "DELETION")], "pdb string, chain string, position int, kind string")
    got = sorted((r["chain"], r["p_start"], r["p_stop"], r["offset_no"]) for r in structures.adjust_ranges(ranges, adv).collect())
    assert got == [("A", 1, 9, 0), ("A", 10, 20, 1), ("C", 1, 6, 5), ("C", 8, 11, 4), ("C", 12, 20, 5)]


def test_alignment_blocks(spark):
    df = spark.createDataFrame([("U", "T", 5, 1, "ABC-DEF", "ABCXD-F")], "uniprot string, transcript string, u_start int, t_start int, u_gapped string, t_gapped string")
    got = sorted((r["t_begin"], r["t_end"], r["u_begin"], r["u_end"]) for r in annotate.aligned_segments(df, 0.5).collect())
    assert got == [(1, 3, 5, 7), (5, 5, 8, 8), (6, 6, 10, 10)]
    assert annotate.aligned_segments(df, 0.99).count() == 0


def test_cutoffs(spark):
    df = spark.createDataFrame([(1.0, 0.5), (10.0, 0.01), (5.0, 1.0)], "d double, p double")
    n = lambda **k: df.filter(filters.within_cutoff(F.col("d"), F.col("p"), **k)).count()
    assert (n(), n(max_distance=10.0), n(max_p=0.5), n(max_distance=10.0, max_p=0.6)) == (2, 2, 1, 1)


def test_same_site_greedy(spark):
    rows = [("a", "A:T", "T1:p.R1C", "G", 1.0), ("b", "A:T", "T1:p.R1C", "G", 2.0), ("b", "A:T", "T2:p.R9C", "G", 2.0), ("c", "A:G", "T2:p.R9C", "G", 3.0)]
    w = spark.createDataFrame(rows, "mutation_key string, ref_alt string, protein_key string, gene string, weight double")
    got = {r["mutation_key"]: r["survivor"] for r in graph.site_survivors(w).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}
    assert sorted((r["mutation_key"], r["weight"]) for r in graph.representative_sites(w, "density").collect()) == [("a", 3.0), ("c", 3.0)]


def test_network_clusters_by_hand(spark):
    edges = spark.createDataFrame([("any", "a", "b", 8.746), ("any", "c", "d", 7.11)], "structure string, key1 string, key2 string, distance double")
    verts = spark.createDataFrame([("a", "A:T", "G", "T:p.A1B", 1.0, ""), ("b", "A:T", "G", "T:p.A2B", 1.0, ""), ("c", "A:T", "G", "T:p.S3I", 1.0, ""), ("c", "A:G", "G", "T:p.S3N", 1.0, ""), ("d", "A:T", "G", "T:p.A4B", 1.0, "")], "mutation_key string, ref_alt string, gene string, protein_key string, weight double, alternatives string")
    comp = graph.super_clusters(edges)
    geo = graph.geodesics(edges, spark.createDataFrame([], "key1 string, key2 string"), comp)
    scores = graph.vertex_scores(geo, verts)
    got = {(r["key"], r["ref_alt"]): r["score"] for r in scores.collect()}
    assert got["a", "A:T"] == pytest.approx(2**-8.746) and got["c", "A:T"] == pytest.approx(1 + 2**-7.11)
    rows = graph.radius_clusters(scores, geo, 10.0).collect()
    assert {(r["key"], r["sub_id"]) for r in rows} == {("a", 0), ("b", 0), ("c", 0), ("d", 0)} and {r["super_id"] for r in rows} == {0, 1}
    assert {r["key"]: r["degree"] for r in graph.degree(geo, verts).collect()} == {"a": 2, "b": 2, "c": 3, "d": 3}


def test_density_order(spark):
    edges = spark.createDataFrame([("s", f"k{i}", f"k{j}", float(j - i)) for i in range(6) for j in range(i + 1, 6)], "structure string, key1 string, key2 string, distance double")
    w = spark.createDataFrame([(f"k{i}", 1.0) for i in range(6)], "key string, weight double")
    order = density.optics_order(edges, w, eps=10.0, min_pts=3.0, runs=3)
    rows = order.collect()
    assert len(rows) == 18 and all({r["key"] for r in rows if r["run"] == k} == {f"k{i}" for i in range(6)} for k in range(3))
    assert {r["key"]: r["core_distance"] for r in density.core_vertices(edges, w, 10.0, 3.0).collect()} == {"k0": 2.0, "k1": 1.0, "k2": 1.0, "k3": 1.0, "k4": 1.0, "k5": 2.0}
    found = density.density_clusters(order.filter("run = 0"), 10.0, 3.0)
    p = density.membership_probability(order, found, 3.0).collect()
    assert p and all(0 < r["probability"] <= 1 for r in p)


def test_significance(spark):
    obs = spark.createDataFrame([("c", 1.0, 2.0, 1.0), ("d", 0.0, 1.0, 0.0)], "cluster string, distance_sum double, mass double, n_pairs double")
    back = spark.createDataFrame([("c", float(x)) for x in range(10)], "cluster string, distance double")
    a, b = ({r["cluster"]: r["p_value"] for r in stats.cluster_significance(obs, back, 5000, 1000).collect()} for _ in range(2))
    assert a == b and a["d"] is None and 0.07 < a["c"] < 0.13


def test_reports(spark):
    cds = spark.createDataFrame([("CDS", 1, 10, 'gene_name "G"; transcript_id "T1"; exon_number "1"'), ("CDS", 1, 10, 'gene_name "G"; transcript_id "T1"; exon_number "1"'), ("exon", 1, 99, "x"), ("CDS", 5, 30, 'gene_name "G"; transcript_id "T2"; exon_number "1"')], "feature string, start int, stop int, attributes string")
    lengths = report.transcript_lengths(readers.parse_gtf_cds(cds))
    assert {r["transcript"]: r["length"] for r in lengths.collect()} == {"T1": 10, "T2": 26}
    assert report.longest_transcript(lengths).head()["transcript"] == "T2"
    cl = spark.createDataFrame([("G", False), ("D", True), ("H", False)], "gene string, is_drug boolean")
    fam = spark.createDataFrame([("G", "F1"), ("G", "F0")], "gene string, family string")
    assert {r["gene"]: r["families"] for r in report.annotate_families(cl, fam, spark.createDataFrame([("G",)], "gene string")).collect()} == {"G": "F0|F1|Protein Kinase", "D": "NA", "H": "Unclassified"}
    tot = report.family_totals(spark.createDataFrame([("G", ["a", "b"]), ("H", ["a"])], "gene string, families array<string>"))
    assert {r["family"]: r["percent"] for r in tot.collect()} == {"a": 100.0, "b": 50.0}


def test_symbols(spark):
    ids = ", ".join(f"{k} string" for k in genes.IDS)
    none = [None] * len(genes.IDS)
    cur = spark.createDataFrame([("NEW", "7", 100, 200, ["OLD"], ["AKA"], *none), ("IDS", "7", 100, 200, [], [], "e1", "r1", *none[2:])], f"symbol string, chromosome string, start int, stop int, previous array<string>, aliases array<string>, {ids}")
    bad = spark.createDataFrame([("OLD", "chr7", 150, 160, *none), ("QQ", "7", 150, 160, "e1", "r1", *none[2:]), ("AKA", "8", 150, 160, *none)], f"symbol string, chromosome string, start int, stop int, {ids}")
    assert sorted(tuple(r) for r in genes.reconcile_symbols(bad, cur).collect()) == [("OLD", "NEW", "name"), ("QQ", "IDS", "ids")]
