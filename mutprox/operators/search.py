"""Joins of mutations, sites, features and drugs to residue pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutprox.functions import columns as C
from mutprox.operators.filters import search_cutoff
from mutprox.operators.ranges import join_ranges
from mutprox.session import cut


def map_to_protein(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows (transcript, position) whose position lies in a segment of its transcript, with ``uniprot`` and ``u_pos``.

    Of several segments the one that begins first counts. Positions are mapped once each, however many rows share them.
    """
    s = segments.select("transcript", "uniprot", "t_begin", "t_end", "u_begin")
    places = rows.select("transcript", "position").distinct()
    hit = join_ranges(places, s, ["transcript"], "position", "t_begin", "t_end")
    best = hit.groupBy("transcript", "position").agg(F.min(F.struct("t_begin", "uniprot", "u_begin")).alias("m"))
    best = best.select("transcript", "position", "m.uniprot", (F.col("position") - F.col("m.t_begin") + F.col("m.u_begin")).cast("long").alias("u_pos"))
    return rows.join(best, ["transcript", "position"])


def place_mutations(maf: DataFrame, segments: DataFrame) -> DataFrame:
    """Distinct mutations at their protein places: gene, chromosome, start_pos, stop_pos, aa_change, transcript, uniprot, u_pos."""
    # far fewer than calls; written first, as a filter on the position would else be moved ahead and parse every call
    distinct = cut(maf.select("gene", "chromosome", "start_pos", "stop_pos", "aa_change", "transcript").distinct())
    return map_to_protein(distinct.withColumn("position", C.search_aa_position(F.col("aa_change"))).filter("position is not null"), segments)


def place_sites(sites: DataFrame, segments: DataFrame) -> DataFrame:
    return map_to_protein(cut(sites.select("gene", "transcript", "position", "feature").distinct()), segments)


def _at(n: int) -> Column:
    return (F.col(f"pos{n}") + F.col(f"off{n}")).cast("long")


def ready(prox: DataFrame) -> DataFrame:
    """Collapsed residue pairs with the protein place of both ends and the distance along the protein."""
    lin = C.linear_distance(F.col("uniprot1"), F.col("pos1"), F.col("off1"), F.col("uniprot2"), F.col("pos2"), F.col("off2"))
    return prox.withColumn("at1", _at(1)).withColumn("at2", _at(2)).withColumn("linear_distance", lin)


def _side(rows: DataFrame, n: int, cols: tuple[str, ...]) -> DataFrame:
    return rows.select(F.col("uniprot").alias(f"uniprot{n}"), F.col("u_pos").alias(f"at{n}"), *[F.col(c).alias(f"{c}{n}") for c in cols])


def _places(rows: DataFrame, n: int) -> DataFrame:
    return rows.select(F.col("uniprot").alias(f"uniprot{n}"), F.col("u_pos").alias(f"at{n}")).distinct()


MUTATION = ("gene", "chromosome", "start_pos", "stop_pos", "aa_change")
SITE = ("gene", "transcript", "position", "feature")


def _mutated(mutations: DataFrame, prox: DataFrame, **cutoff: float) -> DataFrame:
    """Residue pairs (as from :func:`ready`) that pass the cutoff and have both residues mutated, both amino acids."""
    near = ready(prox).filter(C.is_aa(F.col("name1")) & C.is_aa(F.col("name2"))).filter(search_cutoff(F.col("info"), F.col("linear_distance"), **cutoff))
    for n in (1, 2):
        near = near.join(_places(mutations, n), [f"uniprot{n}", f"at{n}"], "left_semi")
    return near


def mutation_pairs(mutations: DataFrame, prox: DataFrame, **cutoff: float) -> DataFrame:
    """Both residues mutated, both amino acids. Residue pairs are first cut to mutated places, so only hits are multiplied out.

    They are few bytes, which would be read by one task, but make many rows; so they are dealt to tasks by their places first.
    """
    near = _mutated(mutations, prox, **cutoff).repartition(_parts(prox), "uniprot1", "at1", "uniprot2", "at2")
    for n in (1, 2):
        near = near.join(_side(mutations, n, MUTATION), [f"uniprot{n}", f"at{n}"])
    return near


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


#: What tells mutations apart as vertices of the graph.
VERTEX = ("gene", "chromosome", "start_pos", "stop_pos")


def vertex_pairs(mutations: DataFrame, prox: DataFrame, **cutoff: float) -> DataFrame:
    """The pairs of :func:`gather_pairwise` as the graph needs them: ``gene, chromosome, start_pos, stop_pos`` of both ends, ``info`` and ``n``, the number of pairs.

    Mutations of a vertex that lie at the same places have the same pairs, whatever their changes; they are one row with their
    number, and are not multiplied out. Infos of two places are put together before mutations meet them. Pairs within a vertex
    are left out, as they are no edges.
    """
    infos = F.array_distinct(F.flatten(F.collect_list("info"))).alias("info")
    places = mutations.groupBy(*MUTATION).agg(F.array_sort(F.collect_set(F.struct("uniprot", "u_pos"))).alias("places"))
    alike = places.groupBy(*VERTEX, "places").agg(F.count(F.lit(1)).alias("n"))
    each = alike.select(*VERTEX, "places", "n", F.inline("places"))
    one, two = (F.struct(F.col(f"uniprot{n}").alias("u"), F.col(f"at{n}").alias("at")) for n in (1, 2))
    spots = _mutated(mutations, prox, **cutoff).select(F.least(one, two).alias("s"), F.greatest(one, two).alias("t"), "info").repartition(_parts(prox), "s", "t").groupBy("s", "t").agg(infos)
    met = spots.select(F.col("s.u").alias("uniprot1"), F.col("s.at").alias("at1"), F.col("t.u").alias("uniprot2"), F.col("t.at").alias("at2"), "info")
    for n in (1, 2):
        met = met.join(_side(each, n, (*VERTEX, "places", "n")), [f"uniprot{n}", f"at{n}"])
    one, two = (F.struct(*[F.col(f"{c}{n}").alias(c) for c in (*VERTEX, "places")]) for n in (1, 2))
    own = [F.col(f"{c}1").eqNullSafe(F.col(f"{c}2")) for c in VERTEX]
    ends = met.filter(~(own[0] & own[1] & own[2] & own[3])).select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), (F.col("n1") * F.col("n2")).alias("n"), "info")
    out = ends.groupBy("a", "b", "n").agg(infos)
    return out.select(*[F.col(f"{s}.{c}").alias(f"{c}{n}") for s, n in (("a", 1), ("b", 2)) for c in VERTEX], "info", "n")


def hits_at(mutations: DataFrame, near: DataFrame) -> DataFrame:
    """Mutations with the pairs (as from :func:`ready`) whose first end is their place; pairs in buckets by (uniprot1, at1) are not dealt again."""
    m = mutations.select("uniprot", "u_pos", *MUTATION).withColumnsRenamed({"uniprot": "uniprot1", "u_pos": "at1"})
    return near.join(m, ["uniprot1", "at1"])


def mutation_features(mutations: DataFrame, prox: DataFrame, what: str, **cutoff: float) -> DataFrame:
    """Exactly one end mutated, the other annotated: ``what`` is ``feature`` or ``cosmic``. The mutated end comes first."""
    near = ready(prox).filter(search_cutoff(F.col("info"), F.col("linear_distance"), **cutoff))
    out = []
    for n, o in ((1, 2), (2, 1)):
        hit = near.filter(F.col(f"{what}{o}") != "N/A").join(_places(mutations, o), [f"uniprot{o}", f"at{o}"], "left_anti").join(_side(mutations, n, MUTATION), [f"uniprot{n}", f"at{n}"])
        out.append(hit.select(*[F.col(f"{c}{n}").alias(c) for c in MUTATION], F.col(f"uniprot{n}").alias("uniprot"), F.col(f"at{n}").alias("u_pos"), F.col(f"uniprot{o}").alias("other_uniprot"), F.col(f"at{o}").alias("other_pos"), F.col(f"{what}{o}").alias(what), "linear_distance", "info"))
    return out[0].unionByName(out[1]).distinct()


def site_pairs(sites: DataFrame, prox: DataFrame) -> DataFrame:
    """Both ends annotated sites; water is left out and no cutoff holds."""
    near = ready(prox).filter(~C.is_water(F.col("name1")) & ~C.is_water(F.col("name2")))
    for n in (1, 2):
        near = near.join(_side(sites, n, SITE), [f"uniprot{n}", f"at{n}"])
    return near


def mutation_site_pairs(mutations: DataFrame, sites: DataFrame, prox: DataFrame) -> DataFrame:
    """One end mutated, the other a site; where both ends are sites, only the first one's site counts."""
    near = ready(prox).filter(~C.is_water(F.col("name1")) & ~C.is_water(F.col("name2")))
    first = near.join(_side(sites, 1, SITE), ["uniprot1", "at1"]).join(_side(mutations, 2, MUTATION), ["uniprot2", "at2"])
    second = near.join(_places(sites, 1), ["uniprot1", "at1"], "left_anti").join(_side(sites, 2, SITE), ["uniprot2", "at2"]).join(_side(mutations, 1, MUTATION), ["uniprot1", "at1"])
    turn = lambda df, s, m: df.select(*[F.col(f"{c}{m}").alias(f"mutation_{c}") for c in MUTATION], *[F.col(f"{c}{s}").alias(f"site_{c}") for c in SITE], "linear_distance", "info")
    return turn(first, 1, 2).unionByName(turn(second, 2, 1)).distinct()


def site_features(sites: DataFrame, prox: DataFrame, what: str) -> DataFrame:
    """Sites near an annotated residue: the first end always, the second only where the first is no site."""
    near = ready(prox).filter(~C.is_water(F.col("name1")) & ~C.is_water(F.col("name2")))
    first = near.filter(F.col(f"{what}2") != "N/A").join(_side(sites, 1, SITE), ["uniprot1", "at1"])
    second = near.filter(F.col(f"{what}1") != "N/A").join(_places(sites, 1), ["uniprot1", "at1"], "left_anti").join(_side(sites, 2, SITE), ["uniprot2", "at2"])
    turn = lambda df, s, o: df.select(*[F.col(f"{c}{s}").alias(c) for c in SITE], F.col(f"uniprot{o}").alias("other_uniprot"), F.col(f"at{o}").alias("other_pos"), F.col(f"{what}{o}").alias(what), "info")
    return turn(first, 1, 2).unionByName(turn(second, 2, 1)).distinct()


def drug_pairs(mutations: DataFrame, prox: DataFrame, drugs: DataFrame, target: bool = True) -> DataFrame:
    """One residue is a place where a drug sits in a structure of the pair, the other is mutated. ``drugs``: drug, drug_id, pdb, chain, residue_no, is_target."""
    near = ready(prox).filter(~C.is_water(F.col("name1")) & ~C.is_water(F.col("name2"))).withColumn("x", F.explode("info"))
    spots = drugs.filter(F.col("is_target") == target).select("drug", "drug_id", F.col("pdb").alias("dp"), F.col("chain").alias("dc"), F.col("residue_no").alias("dr")).distinct()
    out = []
    for d, m in ((1, 2), (2, 1)):
        hit = near.join(spots, (F.col("x.pdb") == F.col("dp")) & (F.col(f"chain{d}") == F.col("dc")) & (F.col(f"pos{d}") == F.col("dr"))).join(_side(mutations, m, MUTATION), [f"uniprot{m}", f"at{m}"])
        out.append(hit.select("drug", "drug_id", F.col("dp").alias("pdb"), F.col("dc").alias("drug_chain"), F.col("dr").alias("location"), *[F.col(f"{c}{m}").alias(c) for c in MUTATION], F.col(f"chain{m}").alias("chain"), F.col(f"pos{m}").alias("pos"), "linear_distance", F.col("x").alias("info")))
    return out[0].unionByName(out[1]).distinct()


def drug_clean(pairs: DataFrame) -> DataFrame:
    """One row for each structure, drug place and mutation, its drugs and ids joined by ``|`` and the last info of the structure."""
    key = ["pdb", "drug_chain", "location", *MUTATION, "chain", "pos", "linear_distance"]
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "|")
    return pairs.groupBy(*key).agg(names("drug").alias("drugs"), names("drug_id").alias("drug_ids"), F.max("info").alias("info"))


def gather_pairwise(pairs: DataFrame) -> DataFrame:
    """One row for each unordered pair of mutations with all its distinct infos by p-value."""
    one, two = (F.struct(*[F.col(f"{c}{n}").alias(c) for c in MUTATION]) for n in (1, 2))
    ends = pairs.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), "linear_distance", "info")
    by_p = F.transform(F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("info"))), lambda x: F.struct(x["p_value"], x["distance"], x["pdb"]))), lambda x: F.struct(x["distance"].alias("distance"), x["pdb"].alias("pdb"), x["p_value"].alias("p_value")))
    out = ends.groupBy("a", "b").agg(F.min("linear_distance").alias("linear_distance"), by_p.alias("info"))
    return out.select(*[F.col(f"{s}.{c}").alias(f"{c}{n}") for s, n in (("a", 1), ("b", 2)) for c in MUTATION], "linear_distance", "info")


def sort_pairs_by_p(pairs: DataFrame) -> DataFrame:
    """Most unlikely pairs first, of equals by both mutations; for writing."""
    return pairs.orderBy(F.array_min(F.transform("info", lambda x: x["p_value"])), *[f"{c}{n}" for n in (1, 2) for c in MUTATION])


def search_stats(maf: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: calls, calls of an expected kind, unexpected formats, mapped calls, transcripts and proteins."""
    from mutprox.operators.filters import search_mutations

    expected = search_mutations(maf).withColumn("position", C.search_aa_position(F.col("aa_change")))
    mapped = map_to_protein(expected.filter("position is not null"), segments).agg(F.count(F.lit(1)).alias("n_mapped"), F.countDistinct("uniprot").alias("n_proteins"))
    own = expected.agg(F.count(F.lit(1)).alias("n_expected"), F.sum(F.when(F.col("position").isNull(), 1).otherwise(0)).alias("n_unexpected_format"), F.countDistinct("transcript").alias("n_transcripts"))
    return maf.agg(F.count(F.lit(1)).alias("n_calls")).join(own).join(mapped)
