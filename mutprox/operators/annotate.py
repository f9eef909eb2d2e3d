"""P-values, features and known mutations for residue pairs, and their collapse to one row a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mutprox.operators.ranges import join_ranges, top_stretches
from mutprox.operators.search import map_to_protein
from mutprox.session import cut


def empirical_p_values(prox: DataFrame) -> DataFrame:
    """``p_value``: rank of the distance among the distinct distances of the first protein, from 0, over their number.

    Only distinct distances (a grid of thousandths) are ranked, so a protein with very many pairs costs no large window.
    """
    grid = prox.select("uniprot1", "distance").distinct()
    p = F.round((F.row_number().over(W.partitionBy("uniprot1").orderBy("distance")) - 1) / F.count(F.lit(1)).over(W.partitionBy("uniprot1")), 6)
    return prox.join(grid.select("uniprot1", "distance", p.alias("p_value")), ["uniprot1", "distance"])


def feature_stretches(features: DataFrame) -> DataFrame:
    """``uniprot, start_pos, end_pos, description``: disjoint stretches with the description that holds there.

    Disulfide bonds hold at their two ends, all else over its range; later lines win. No row is made for a place.
    """
    ends = F.array(F.struct(F.col("start_pos").alias("a"), F.col("start_pos").alias("b")), F.struct(F.col("end_pos").alias("a"), F.col("end_pos").alias("b")))
    whole = F.array(F.struct(F.col("start_pos").alias("a"), F.col("end_pos").alias("b")))
    each = features.select("uniprot", F.explode(F.when(F.col("type") == "DISULFID", ends).otherwise(whole)).alias("x"), "description", "line_no")
    each = each.select("uniprot", F.col("x.a").alias("start_pos"), F.col("x.b").alias("end_pos"), "description", "line_no")
    return top_stretches(each, ["uniprot"], "start_pos", "end_pos", ["line_no"], ["description"])


def feature_points(features: DataFrame) -> DataFrame:
    """``uniprot, at, description`` for every protein place that :func:`feature_stretches` covers; joins take the stretches themselves."""
    return feature_stretches(features).select("uniprot", F.explode(F.sequence(F.col("start_pos").cast("int"), F.col("end_pos").cast("int"))).alias("at"), "description")


def annotate_features(prox: DataFrame, features: DataFrame, partner_protein: bool = False) -> DataFrame:
    """``feature1`` and ``feature2`` (``N/A`` without one). The second end is looked up under the first protein unless told otherwise.

    Each distinct place of the pairs is looked up once in the stretches.
    """
    second = "uniprot2" if partner_protein else "uniprot1"
    out = prox.withColumn("__at1", (F.col("pos1") + F.col("off1")).cast("long")).withColumn("__at2", (F.col("pos2") + F.col("off2")).cast("long"))
    end = lambda key, n: out.select(F.col(key).alias("uniprot"), F.col(f"__at{n}").alias("__at"))
    places = end("uniprot1", 1).unionByName(end(second, 2)).distinct()
    points = cut(join_ranges(places, feature_stretches(features), ["uniprot"], "__at", "start_pos", "end_pos").select("uniprot", "__at", "description"))
    side = lambda n, key: points.select(F.col("uniprot").alias(key), F.col("__at").alias(f"__at{n}"), F.col("description").alias(f"feature{n}"))
    out = out.join(side(1, "uniprot1"), ["uniprot1", "__at1"], "left").join(side(2, second), [second, "__at2"], "left")
    return out.fillna("N/A", ["feature1", "feature2"]).drop("__at1", "__at2")


def cosmic_points(cosmic: DataFrame, segments: DataFrame) -> DataFrame:
    """Known changes at each protein place, as a sorted comma list of ``change|tissue``."""
    at = F.regexp_extract("aa_change", r"p\.\D(\d+)\D", 1)
    known = cut(cosmic.select("transcript", "aa_change", "tissue").distinct())  # the same change is listed very often; written, so that it is parsed once
    placed = known.withColumn("position", F.when(at != "", at.cast("int"))).filter("position is not null")
    mapped = map_to_protein(placed, segments)
    return mapped.groupBy("uniprot", "u_pos").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("|", "aa_change", "tissue"))), ",").alias("known"))


def annotate_cosmic(prox: DataFrame, cosmic: DataFrame, segments: DataFrame) -> DataFrame:
    """``cosmic1`` and ``cosmic2`` (``N/A`` without one); both ends are looked up under the first protein."""
    points = cosmic_points(cosmic, segments)
    side = lambda n: points.select(F.col("uniprot").alias("uniprot1"), F.col("u_pos").alias(f"__at{n}"), F.col("known").alias(f"cosmic{n}"))
    out = prox.withColumn("__at1", (F.col("pos1") + F.col("off1")).cast("long")).withColumn("__at2", (F.col("pos2") + F.col("off2")).cast("long"))
    out = out.join(side(1), ["uniprot1", "__at1"], "left").join(side(2), ["uniprot1", "__at2"], "left")
    return out.fillna("N/A", ["cosmic1", "cosmic2"]).drop("__at1", "__at2")


ENDS = ("uniprot", "chain", "pos", "off", "name")


def unordered(prox: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Both ends of each pair in one order, so that (a, b) and (b, a) are the same row."""
    names = (*ENDS, *more)
    first, second = (F.struct(*[F.col(f"{k}{n}").alias(k) for k in names]) for n in (1, 2))
    key = lambda n: F.struct(*[F.col(f"{k}{n}").alias(k) for k in ("uniprot", "chain", "pos")])
    swap = key(1) > key(2)
    rest = [c for c in prox.columns if c not in {f"{k}{n}" for k in names for n in (1, 2)}]
    both = prox.select(*rest, F.when(swap, second).otherwise(first).alias("a"), F.when(swap, first).otherwise(second).alias("b"))
    return both.select(*[F.col(f"{s}.{k}").alias(f"{k}{n}") for s, n in (("a", 1), ("b", 2)) for k in names], *rest)


def collapse_pairs(prox: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each unordered residue pair with its distinct (distance, pdb, p_value), sorted."""
    ends = [f"{k}{n}" for n in (1, 2) for k in (*ENDS, *more)]
    return unordered(prox, more).groupBy(*ends).agg(F.sort_array(F.collect_set(F.struct("distance", "pdb", "p_value"))).alias("info"))


def exact_transcript_map(proteins: DataFrame, peptides: DataFrame) -> DataFrame:
    """Whole-length segments where a transcript's peptide equals the protein. ``proteins``: uniprot, transcript, sequence; ``peptides``: transcript, sequence."""
    bare = lambda c: F.regexp_replace(c, r"\.\d+$", "")
    a = proteins.select("uniprot", bare("transcript").alias("transcript"), "sequence")
    b = peptides.select(bare("transcript").alias("transcript"), "sequence").distinct()
    n = F.length("sequence").cast("long")
    one = F.lit(1).cast("long")
    return a.join(b, ["transcript", "sequence"]).select("transcript", "uniprot", one.alias("t_begin"), n.alias("t_end"), one.alias("u_begin"), n.alias("u_end"))


def aligned_segments(alignments: DataFrame, min_identity: float = 0.9) -> DataFrame:
    """Blocks without gaps of precomputed alignments (uniprot, transcript, u_start, t_start, u_gapped, t_gapped) above an identity."""
    each = alignments.withColumn("row", F.monotonically_increasing_id()).withColumn("t_letters", F.split("t_gapped", ""))
    each = each.select("row", "uniprot", "transcript", "u_start", "t_start", F.posexplode(F.split("u_gapped", "")).alias("k", "u"), "t_letters").withColumn("t", F.get("t_letters", F.col("k"))).drop("t_letters")
    each = each.filter("u <> '' and t is not null and t <> ''")
    upto = W.partitionBy("row").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    share = n(F.col("u") == F.col("t")).over(W.partitionBy("row")) / F.count(F.lit(1)).over(W.partitionBy("row"))
    gap = (F.col("u") == "-") | (F.col("t") == "-")
    placed = each.select("*", (F.col("u_start") + n(F.col("u") != "-").over(upto) - 1).alias("ua"), (F.col("t_start") + n(F.col("t") != "-").over(upto) - 1).alias("ta"), n(gap).over(upto).alias("island"), share.alias("identity"), gap.alias("gap"))
    sound = placed.filter(~F.col("gap") & (F.col("identity") >= min_identity))
    return sound.groupBy("row", "transcript", "uniprot", "island").agg(F.min("ta").alias("t_begin"), F.max("ta").alias("t_end"), F.min("ua").alias("u_begin"), F.max("ua").alias("u_end")).drop("row", "island")


def features_at(features: DataFrame, positions: DataFrame) -> DataFrame:
    """Features that hold any of the given places. ``positions``: uniprot, position."""
    p = positions.select(F.col("uniprot").alias("__u"), "position").distinct()
    return features.join(p, (features["uniprot"] == p["__u"]) & p["position"].between(features["start_pos"], features["end_pos"]), "left_semi")


def features_between(features: DataFrame, start: int, stop: int) -> DataFrame:
    """Features that overlap a range."""
    return features.filter((F.col("start_pos") <= stop) & (F.col("end_pos") >= start))


def features_after(features: DataFrame, position: int) -> DataFrame:
    """Features that end after a place."""
    return features.filter(F.col("end_pos") > position)
