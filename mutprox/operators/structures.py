"""From structure text to residue-residue distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mutprox.functions import columns as C
from mutprox.operators.ranges import join_ranges
from mutprox.session import cut

AT = ["pdb", "chain", "residue_no"]


def _lines(text_df: DataFrame) -> DataFrame:
    return text_df.select("pdb", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def parse_atoms(text_df: DataFrame) -> DataFrame:
    """Atoms of the first model. ``text_df``: pdb, text (a whole file each). Residue numbers keep an insertion code."""
    lines = _lines(text_df)
    ends = lines.filter(F.col("line").startswith("ENDMDL")).groupBy("pdb").agg(F.min("line_no").alias("stop"))
    cell = lambda at, n: F.trim(F.substring("line", at + 1, n))
    return (
        lines.filter(F.col("line").rlike("^(ATOM|HETATM)")).join(ends, "pdb", "left").filter("stop is null or line_no < stop")
        .select(
            "pdb", "line_no", F.when(cell(21, 1) == "", "Z").otherwise(cell(21, 1)).alias("chain"), cell(22, 8).alias("residue_no"), cell(17, 3).alias("residue_name"),
            *[C.round_thousandth(cell(at, 8).try_cast("double")).alias(k) for k, at in (("x", 30), ("y", 38), ("z", 46))], F.col("line").startswith("HETATM").alias("hetero"),
        )
    )


def parse_dbref(text_df: DataFrame) -> DataFrame:
    """Chain to protein ranges; chains that map to more than one protein go."""
    p = r"^DBREF\s+\S+\s+(\S)\s+(-?\d+)\w?\s+(-?\d+)\w?\s+UNP\s+(\S+)\s+\S+\s+(\d+)\w?\s+(\d+)"
    names = ("chain", "p_start", "p_stop", "uniprot", "u_start", "u_stop")
    rows = _lines(text_df).filter(F.col("line").rlike(p)).select("pdb", *[F.regexp_extract("line", p, k + 1).alias(n) for k, n in enumerate(names)])
    rows = rows.select("pdb", "chain", "uniprot", *[F.col(n).cast("int") for n in ("p_start", "p_stop", "u_start", "u_stop")])
    one = rows.groupBy("pdb", "chain").agg(F.countDistinct("uniprot").alias("n")).filter("n = 1").select("pdb", "chain")
    return rows.join(one, ["pdb", "chain"], "left_semi")


def parse_seqadv(text_df: DataFrame) -> DataFrame:
    """Sequence advisories: pdb, chain, position (null where none is given), comment."""
    p = r"^SEQADV\s+\S+\s+(?:[A-Z]{3}\s+)?(\S)\s+(-?\d+)?\w?\s+UNP\s+\S+\s+(?:[A-Z]{3}\s+)?(\d+)?\s*(.*?)\s*$"
    return _lines(text_df).filter(F.col("line").rlike(p)).select(
        "pdb", F.regexp_extract("line", p, 1).alias("chain"), F.regexp_extract("line", p, 2).try_cast("int").alias("position"),
        F.regexp_extract("line", p, 3).try_cast("int").alias("u_position"), F.regexp_extract("line", p, 4).alias("comment"),
    )


def residue_centroids(atoms: DataFrame) -> DataFrame:
    """Mean place of each residue's atoms; atoms and means are rounded to a thousandth."""
    means = [C.round_thousandth(F.avg(C.round_thousandth(F.col(k)))).alias(k) for k in "xyz"]
    return atoms.groupBy(*AT).agg(F.min("residue_name").alias("residue_name"), *means)


def longest_chain(ranges: DataFrame) -> DataFrame:
    """Per structure and protein the chain that spans most residues; of equals the first by name."""
    span = ranges.groupBy("pdb", "uniprot", "chain").agg((F.max("p_stop") - F.min("p_start") + 1).alias("span"))
    return span.groupBy("pdb", "uniprot").agg(F.min_by("chain", F.struct(-F.col("span"), "chain")).alias("chain"), F.max("span").alias("span"))


def residue_offsets(residues: DataFrame, ranges: DataFrame) -> DataFrame:
    """The protein and offset of each residue, from the first range that holds it; null without one."""
    r = ranges.select("pdb", "chain", "uniprot", "p_start", "p_stop", "offset_no")
    places = residues.select(*AT).distinct()
    first = join_ranges(places, r, ["pdb", "chain"], "residue_no", "p_start", "p_stop").groupBy(*AT).agg(F.min(F.struct("p_start", "p_stop", "uniprot", "offset_no")).alias("m"))
    return residues.join(first, AT, "left").select(*residues.columns, "m.uniprot", "m.offset_no")


def _near(left: DataFrame, right: DataFrame, reach: float | Column) -> DataFrame:
    """Pairs (columns suffixed 1 and 2) of one structure whose cells touch: the grid keeps work local in large structures.

    Cells are counted from the structure's own corner, and only one side is repeated, into those of its neighbouring cells that
    the structure has: a structure no wider than the reach is one cell and repeats nothing. The join is on (pdb, cell). Rows without three finite coordinates pair with nothing.
    """
    finite = lambda k: F.when(F.abs(F.col(k)) < float("inf"), F.col(k))
    ends = right.groupBy(F.col("pdb").alias("__pdb")).agg(*[f(finite(k)).alias(f"__{n}{k}") for k in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    width = F.lit(reach) * (1 + 1e-9)  # what is just within reach is never two cells away
    cell = lambda c, k: F.floor((c - F.col(f"__lo{k}")) / width)
    a = left.join(ends, F.col("pdb") == F.col("__pdb"))
    for k in "xyz":
        own, top = cell(finite(k), k), cell(F.col(f"__hi{k}"), k)
        there = [F.when((own + step).between(0, top), own + step) for step in (-1, 0, 1)]
        a = a.withColumn(f"__c{k}", F.explode(F.array_compact(F.array(*there))))
    a = a.select(*[F.col(c).alias(f"{c}1") for c in left.columns], *[F.col(f"__c{k}").alias(f"__{k}") for k in "xyz"])
    b = right.join(ends, F.col("pdb") == F.col("__pdb")).select(*[F.col(c).alias(f"{c}2") for c in right.columns], *[cell(finite(k), k).alias(f"__{k}r") for k in "xyz"])
    on = (F.col("pdb1") == F.col("pdb2")) & (F.col("__x") == F.col("__xr")) & (F.col("__y") == F.col("__yr")) & (F.col("__z") == F.col("__zr"))
    return a.join(b, on).drop(*[f"__{k}" for k in "xyz"], *[f"__{k}r" for k in "xyz"])


def residue_distances(residues: DataFrame, ranges: DataFrame, max_distance: float = 100.0, min_separation: int = 0) -> DataFrame:
    """Centroid distances between the residues of each protein's longest chain and all residues of the structure.

    ``uniprot1, chain1, pos1, off1, name1, uniprot2, chain2, pos2, off2, name2, distance, pdb``; water is left out, as
    are pairs on one chain whose numbers are ``min_separation`` or less apart.
    """
    own = cut(residue_offsets(residues.filter(~C.is_water(F.col("residue_name"))), ranges).filter("uniprot is not null"))  # read three times below
    base = own.join(longest_chain(ranges).select("pdb", "uniprot", "chain"), ["pdb", "uniprot", "chain"], "left_semi")
    met = _near(base, own, max_distance)
    d = C.euclidean(*[F.col(f"{k}{n}") for n in (1, 2) for k in "xyz"])
    apart = (F.col("chain1") != F.col("chain2")) | (F.abs(F.col("residue_no1") - F.col("residue_no2")) > min_separation)
    side = lambda n: [F.col(f"uniprot{n}"), F.col(f"chain{n}"), F.col(f"residue_no{n}").alias(f"pos{n}"), F.col(f"offset_no{n}").alias(f"off{n}"), F.col(f"residue_name{n}").alias(f"name{n}")]
    return met.filter(apart).select(*side(1), *side(2), d.alias("distance"), F.col("pdb1").alias("pdb")).filter(F.col("distance") <= max_distance)


def residue_boxes(atoms: DataFrame, width: float) -> DataFrame:
    """Boxes around the atoms that a residue has in one cell of a grid: centre ``x, y, z``, half sides ``hx, hy, hz``, half diagonal ``r`` and the atoms, ``pts``.

    A compact residue has a box or a few, a scattered one as many as it has atoms; no box is wider than a cell.
    """
    cell = [F.floor(F.col(k) / width).alias(f"__{k}") for k in "xyz"]
    point = F.struct(*[F.col(k) for k in "xyz"])
    ends = atoms.groupBy(*AT, *cell).agg(*[f(k).alias(f"{n}{k}") for k in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))], F.collect_list(point).alias("pts"))
    half = lambda k: (F.col(f"hi{k}") - F.col(f"lo{k}")) / 2
    diagonal = F.sqrt(sum((half(k) * half(k) for k in "xyz"), F.lit(0.0)))
    return ends.select(*AT, *[((F.col(f"lo{k}") + F.col(f"hi{k}")) / 2).alias(k) for k in "xyz"], *[half(k).alias(f"h{k}") for k in "xyz"], diagonal.alias("r"), "pts")


def near_boxes(atoms: DataFrame, max_distance: float, left: DataFrame | None = None) -> DataFrame:
    """``pdb, chain1, residue_no1, pts1, chain2, residue_no2, pts2``: boxes of two residues within reach of each other, with their atoms.

    Boxes meet in a grid as wide as the reach and the structure's longest diagonal.
    """
    boxes = residue_boxes(atoms, max_distance)
    wide = boxes.groupBy("pdb").agg((F.max("r") * 2 + max_distance + 1e-6).alias("__reach"))
    boxes = boxes.join(wide, "pdb")
    one = boxes if left is None else boxes.join(left.select(*AT).distinct(), AT, "left_semi")
    met = _near(one, boxes, F.col("__reach"))
    gap = lambda k: F.greatest(F.lit(0.0), F.abs(F.col(f"{k}1") - F.col(f"{k}2")) - F.col(f"h{k}1") - F.col(f"h{k}2"))
    end = lambda n: F.struct(F.col(f"chain{n}").alias("c"), F.col(f"residue_no{n}").alias("r"))
    met = met.filter(end(1) < end(2) if left is None else end(1) != end(2)).filter(sum((gap(k) * gap(k) for k in "xyz"), F.lit(0.0)) <= (max_distance + 1e-3) ** 2)
    return met.select(F.col("pdb1").alias("pdb"), "chain1", "residue_no1", "pts1", "chain2", "residue_no2", "pts2")


def shortest_residue_distances(atoms: DataFrame, max_distance: float = 10.0, left: DataFrame | None = None) -> DataFrame:
    """Smallest atom-to-atom distance of each pair of residues within reach, once for each unordered pair unless ``left`` names one side.

    Atoms are paired only where the boxes around them are within reach, inside the row of the two boxes.
    """
    d = lambda p, q: C.euclidean(*[p[k] for k in "xyz"], *[q[k] for k in "xyz"])
    nearest = F.array_min(F.transform("pts1", lambda p: F.array_min(F.transform("pts2", lambda q: d(p, q)))))
    met = near_boxes(atoms, max_distance, left).select("pdb", "chain1", "residue_no1", "chain2", "residue_no2", nearest.alias("d")).filter(F.col("d") <= max_distance)
    return met.groupBy("pdb", "chain1", "residue_no1", "chain2", "residue_no2").agg(F.min("d").alias("distance"))


def residues_near(wanted: DataFrame, atoms: DataFrame, distance: float) -> DataFrame:
    """Residues of the same structure whose closest atom lies within ``distance`` of the wanted residues."""
    return shortest_residue_distances(atoms, distance, left=wanted)


def adjust_ranges(ranges: DataFrame, advisories: DataFrame) -> DataFrame:
    """Ranges cut at deletions (offset + 1 from the place on) and insertions (the place goes, offset - 1 after it).

    ``advisories``: pdb, chain, position, kind (DELETION, INSERTION or REMARK). Chains with a remark go, as do chains
    with events although structure and protein range are equally long.
    """
    key = ["pdb", "chain"]
    events = advisories.filter(F.col("kind").isin("DELETION", "INSERTION") & F.col("position").isNotNull())
    sizes = ranges.groupBy(*key).agg(F.sum(F.col("p_stop") - F.col("p_start")).alias("np"), F.sum(F.col("u_stop") - F.col("u_start")).alias("nu"))
    odd = sizes.filter("np = nu").join(events.select(*key).distinct(), key, "left_semi").select(*key)
    bad = odd.unionByName(advisories.filter("kind = 'REMARK'").select(*key)).distinct()
    sound = ranges.join(bad, key, "left_anti")
    hits = sound.join(events, key).filter(F.col("position").between(F.col("p_start"), F.col("p_stop")))
    at = ["pdb", "chain", "uniprot", "p_start", "p_stop", "offset_no"]
    cuts = sound.select(*at, F.col("p_start").alias("start"), F.lit(0).alias("step"), F.lit(0).alias("skip")).unionByName(
        hits.select(*at, F.col("position").alias("start"), F.when(F.col("kind") == "DELETION", 1).otherwise(-1).alias("step"), F.when(F.col("kind") == "DELETION", 0).otherwise(1).alias("skip"))
    )
    order = W.partitionBy(*at).orderBy("start", "step")
    steps = F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0))
    out = cuts.select("pdb", "chain", "uniprot", (F.col("start") + F.col("skip")).alias("p_start2"), (F.coalesce(F.lead("start").over(order) - 1, F.col("p_stop"))).alias("p_stop2"), (F.col("offset_no") + steps).alias("offset2"))
    return out.filter("p_start2 <= p_stop2").toDF("pdb", "chain", "uniprot", "p_start", "p_stop", "offset_no")


def chain_sequence(residues: DataFrame) -> DataFrame:
    """Residue letters of each chain in order, from number 1 on."""
    rows = residues.filter("residue_no > 0").groupBy("pdb", "chain").agg(F.array_sort(F.collect_set(F.struct("residue_no", C.residue_letter(F.col("residue_name")).alias("letter")))).alias("s"))
    return rows.select("pdb", "chain", F.array_join("s.letter", "").alias("sequence"))


def offset_errors(residues: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per structure and protein: residues whose letter differs from the protein's, all residues, and the share.

    ``residues``: pdb, uniprot, residue_no, offset_no, residue_name; ``sequences``: uniprot, sequence.
    """
    letters = sequences.select("uniprot", F.posexplode(F.split("sequence", "")).alias("k", "want")).filter("want <> ''").withColumn("at", F.col("k") + 1)
    met = residues.withColumn("at", F.col("residue_no") + F.col("offset_no")).join(letters, ["uniprot", "at"])
    wrong = F.sum(F.when(C.residue_letter(F.col("residue_name")) != F.col("want"), 1).otherwise(0))
    return met.groupBy("pdb", "uniprot").agg(wrong.alias("n_wrong"), F.count(F.lit(1)).alias("n_residues"), (wrong / F.count(F.lit(1))).alias("fraction"))


def inconsistent_letters(residues: DataFrame) -> DataFrame:
    """Protein places to which structures give more than one letter."""
    at = residues.withColumn("at", F.col("residue_no") + F.col("offset_no")).withColumn("letter", C.residue_letter(F.col("residue_name")))
    return at.groupBy("uniprot", "at").agg(F.countDistinct("letter").alias("n_letters"), F.array_join(F.sort_array(F.collect_set("letter")), ",").alias("letters")).filter("n_letters > 1")
