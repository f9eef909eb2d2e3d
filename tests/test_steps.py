import random

import pytest

from mutprox.operators import annotate, filters, graph, search
from mutprox.plans.queries import Steps
from mutprox.session import cut


def test_large_tables_are_read_once(spark, monkeypatch):
    """Calls, known changes and sites are cut to distinct rows and written; what is joined then no longer holds their tables."""
    segments = spark.createDataFrame([("T1", "U1", 1, 30, 11, 40)], "transcript string, uniprot string, t_begin long, t_end long, u_begin long, u_end long")
    maf = spark.createDataFrame([("G", "1", 5, 5, "p.A3C", "T1", k) for k in range(9)], "gene string, chromosome string, start_pos long, stop_pos long, aa_change string, transcript string, given int")
    cosmic = spark.createDataFrame([("T1", "p.A3C", t, k) for t in ("lung", "skin") for k in range(9)], "transcript string, aa_change string, tissue string, given int")
    sites = spark.createDataFrame([("G", "T1", 3, "x", k) for k in range(9)], "gene string, transcript string, position int, feature string, given int")
    found = [search.place_mutations(maf, segments), annotate.cosmic_points(cosmic, segments), search.place_sites(sites, segments)]
    for df in found:
        assert "given" not in df._jdf.queryExecution().logical().toString()
    assert [tuple(r) for r in found[0].select("aa_change", "uniprot", "u_pos").collect()] == [("p.A3C", "U1", 13)]
    assert [tuple(r) for r in found[1].collect()] == [("U1", 13, "p.A3C|lung,p.A3C|skin")]
    assert [tuple(r) for r in found[2].select("feature", "uniprot", "u_pos").collect()] == [("x", "U1", 13)]
    s, seen = Steps(spark, ""), []
    monkeypatch.setattr(s, "view", lambda name: (seen.append(name), segments)[1])
    assert s.segments() is s.segments() and seen == ["segments"]


def _calls(spark, many):
    """A call of each kind of ``many``, as often as it says, with samples, weights and lines of their own."""
    cols = "gene string, chromosome string, start_pos long, stop_pos long, classification string, ref string, alt string, sample string, transcript string, aa_change string, weight double, line_no long"
    rows = [("G", "1", s, s, kind, "A", "C", f"S{k}", "T1", change, float(k), k) for (s, kind, change), n in many.items() for k in range(n)]
    return spark.createDataFrame(rows, cols)


def test_calls_are_counted_in_one_scan(spark, monkeypatch):
    """Mutations, weights and recurrence stand on one reading of the calls, and count what the calls themselves count."""
    many = {(5, "Missense_Mutation", "p.A3C"): 7, (5, "In_Frame_Del", "p.A3C"): 4, (8, "Silent", "p.A4C"): 3, (9, None, "p.A5C"): 2, (11, "Missense_Mutation", None): 2}
    maf, segments = _calls(spark, many), spark.createDataFrame([("T1", "U1", 1, 30, 11, 40)], "transcript string, uniprot string, t_begin long, t_end long, u_begin long, u_end long")
    s, seen = Steps(spark, ""), []
    monkeypatch.setattr(s, "view", lambda name: (seen.append(name), {"maf": maf, "segments": segments}[name])[1])
    assert [tuple(r) for r in s.mutations().select("aa_change", "u_pos").collect()] == [("p.A3C", 13)]
    got = sorted(tuple(r) for r in s.weights().select("mutation_key", "protein_key", "weight").collect())
    assert got == sorted(tuple(r) for r in graph.mutation_weights(filters.cluster_mutations(maf)).select("mutation_key", "protein_key", "weight").collect())
    assert got == [("G:1:11:11", "T1", 2.0), ("G:1:5:5", "T1:p.A3C", 11.0)]
    assert seen.count("maf") == 1


def test_no_call_is_parsed_before_calls_are_distinct(spark):
    """The filters on positions stay behind the cut to distinct rows, so that the pattern is not run over every call."""
    segments = spark.createDataFrame([("T1", "U1", 1, 30, 11, 40)], "transcript string, uniprot string, t_begin long, t_end long, u_begin long, u_end long")
    cosmic = spark.createDataFrame([("T1", "p.A3C", "lung")] * 9, "transcript string, aa_change string, tissue string")
    ran = []
    for made in (lambda: search.place_mutations(_calls(spark, {(5, "Missense_Mutation", "p.A3C"): 9}), segments), lambda: annotate.cosmic_points(cosmic, segments)):
        written = []
        with pytest.MonkeyPatch.context() as m:
            for module in (search, annotate):
                m.setattr(module, "cut", lambda df: (written.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
            assert made().count() == 1
        assert written and not any("regexp" in plan for plan in written)
        ran.append(written)
    assert len(ran) == 2


def test_residue_pairs_are_dealt_before_mutations_multiply_them(spark):
    """A few pairs that many mutations share would be read, and multiplied out, by one task."""
    mutations = spark.createDataFrame([("G", "1", p, p, f"p.A{p}{x}", "U", p) for p in (3, 9) for x in "CDEF"], "gene string, chromosome string, start_pos long, stop_pos long, aa_change string, uniprot string, u_pos long")
    info = "info array<struct<distance:double,pdb:string,p_value:double>>"
    prox = spark.createDataFrame([("U", "A", 3, 0, "ALA", "U", "A", 9, 0, "GLY", [(4.0, "P", 0.01)])], f"uniprot1 string, chain1 string, pos1 int, off1 int, name1 string, uniprot2 string, chain2 string, pos2 int, off2 int, name2 string, {info}")
    met = search.mutation_pairs(mutations, prox)
    assert met.count() == 16 and search.gather_pairwise(met).count() == 16
    assert "REPARTITION_BY_NUM" in met._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_vertex_are_counted_and_not_multiplied_out(spark):
    """Edges from counted pairs are the edges of all pairs: several places a mutation, several rows a place, both directions, ends that share a vertex."""
    rng = random.Random(5)
    mutations = [(f"G{p % 2}", "1", p + s, p + s, f"p.A{p}{x}", t, f"U{(p + t) % 2}", p + 3 * t) for p in (3, 4, 9) for s in (0, 1) for x in "CDEF"[: 1 + rng.randrange(4)] for t in range(1 + (x == "C"))]
    mutations = spark.createDataFrame(mutations, "gene string, chromosome string, start_pos long, stop_pos long, aa_change string, transcript int, uniprot string, u_pos long")
    spots = [(f"U{u}", p) for u in (0, 1) for p in range(3, 13)]
    rows = []
    for _ in range(300):
        (u1, p1), (u2, p2) = rng.choice(spots), rng.choice(spots)
        infos = sorted((float(rng.randrange(4, 14)), rng.choice("PQ"), 0.01) for _ in range(1 + rng.randrange(3)))
        rows.append((u1, rng.choice("AB"), p1, 0, "ALA", u2, rng.choice("AB"), p2, 0, rng.choice(("GLY", "GLY", "HOH")), infos))
    prox = spark.createDataFrame(rows, "uniprot1 string, chain1 string, pos1 int, off1 int, name1 string, uniprot2 string, chain2 string, pos2 int, off2 int, name2 string, info array<struct<distance:double,pdb:string,p_value:double>>")
    s, got = Steps(spark, ""), search.vertex_pairs(mutations, prox)
    edges = lambda df: {(r["key1"], r["key2"]): r["distance"] for r in df.collect()}
    all_pairs = search.gather_pairwise(search.mutation_pairs(mutations, prox))
    want = edges(graph.pair_distance(s.links(all_pairs), max_distance=10.0))
    found = edges(graph.pair_distance(s.links(got, "n"), max_distance=10.0, n="n"))
    assert want and found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    different = all_pairs.filter("not (gene1 <=> gene2 and start_pos1 <=> start_pos2)")
    assert got.agg({"n": "sum"}).head()[0] == different.count() > got.count()


def test_edges_do_not_read_all_pairs(spark, monkeypatch):
    s = Steps(spark, "")
    monkeypatch.setattr(s, "pairs", lambda: pytest.fail("pairs were multiplied out"))
    mutations = spark.createDataFrame([("G", "1", p, p, f"p.A{p}{x}", "U", p) for p in (3, 9) for x in "CDEF"], "gene string, chromosome string, start_pos long, stop_pos long, aa_change string, uniprot string, u_pos long")
    info = "info array<struct<distance:double,pdb:string,p_value:double>>"
    prox = spark.createDataFrame([("U", "A", 3, 0, "ALA", "U", "A", 9, 0, "GLY", [(4.0, "P", 0.01)])], f"uniprot1 string, chain1 string, pos1 int, off1 int, name1 string, uniprot2 string, chain2 string, pos2 int, off2 int, name2 string, {info}")
    monkeypatch.setattr(s, "mutations", lambda: mutations)
    monkeypatch.setattr(s, "prior", lambda: prox)
    assert [tuple(r) for r in s.edges().collect()] == [("any", "G:1:3:3", "G:1:9:9", 4.0)]
