"""The weighted graph of mutations and its network clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mutprox.functions import columns as C
from mutprox.operators.components import connected_components
from mutprox.operators.filters import within_cutoff
from mutprox.operators.scan import running
from mutprox.session import cut, drop_cut


def mutation_weights(maf: DataFrame, vertex_type: str = "recurrence", n: str | None = None) -> DataFrame:
    """``mutation_key, ref_alt, protein_key, gene, weight``: rows counted, or the last weight by ``line_no`` (of equals the largest) for type ``weight``.

    ``n`` names the column with the number of calls that a row stands for, where calls have been counted before (recurrence only).
    """
    own = ["weight", "line_no"] if vertex_type == "weight" else [F.lit(1).alias("n") if n is None else F.col(n).alias("n")]
    keyed = maf.select(
        C.mutation_key(F.col("gene"), F.col("chromosome"), F.col("start_pos"), F.col("stop_pos")).alias("mutation_key"), C.ref_alt_key(F.col("ref"), F.col("alt")).alias("ref_alt"),
        C.protein_key(F.col("transcript"), F.col("aa_change")).alias("protein_key"), "gene", *own,
    )
    w = F.max_by("weight", F.struct("line_no", "weight")) if vertex_type == "weight" else F.sum("n").cast("double")
    return keyed.groupBy("mutation_key", "ref_alt", "protein_key", "gene").agg(w.alias("weight"))


def site_weights(sites: DataFrame) -> DataFrame:
    """Sites as vertices: each counts once, however often it is listed."""
    key = F.concat_ws(":", "gene", "transcript", F.col("position").cast("string"), F.lit("-"))
    return sites.select(key.alias("mutation_key"), F.lit("-:ptm").alias("ref_alt"), F.concat_ws(":", "transcript", F.concat(F.lit("p."), F.col("position").cast("string"))).alias("protein_key"), "gene", F.lit(1.0).alias("weight")).distinct()


def edge_union(*kinds: DataFrame) -> DataFrame:
    """Pairs of all kinds (key1, chain1, key2, chain2, info) in one table."""
    out = None
    for k in kinds:
        part = k.select("key1", "chain1", "key2", "chain2", "info")
        out = part if out is None else out.unionByName(part)
    return out


def pair_distance(pairs: DataFrame, measure: str = "average", structure_dependent: bool = False, subunit_dependent: bool = False, max_distance: float | None = None, max_p: float | None = None, n: str | None = None) -> DataFrame:
    """``structure, key1, key2, distance`` with key1 < key2, over the infos below the cutoffs.

    ``average``: their mean. ``shortest``: their smallest; where structures do not matter only the first info of a row counts.
    ``n`` names the column with the number of pairs that a row stands for, where pairs with the same infos have been put together.
    """
    a, b = F.least("key1", "key2"), F.greatest("key1", "key2")
    keyed = pairs.filter(F.col("key1") != F.col("key2")).select(a.alias("key1"), b.alias("key2"), "chain1", "chain2", "info", (F.lit(1) if n is None else F.col(n)).alias("n"))
    first = measure == "shortest" and not (structure_dependent or subunit_dependent)
    x = keyed.select("key1", "key2", "chain1", "chain2", "n", F.get("info", F.lit(0)).alias("x") if first else F.explode("info").alias("x"))
    x = x.filter(within_cutoff(F.col("x.distance"), F.col("x.p_value"), max_distance, max_p))
    x = x.withColumn("structure", C.structure_key(F.col("x.pdb"), F.col("chain1"), F.col("chain2"), structure_dependent, subunit_dependent))
    x = x.select("structure", "key1", "key2", "n", F.col("x.distance").alias("distance"))
    if n is not None and measure == "average":
        # each is added on its own, so that the mean is rounded as that of all pairs is: paths that end at a cutoff depend on it
        x = x.select("structure", "key1", "key2", F.explode(F.array_repeat("distance", F.col("n").cast("int"))).alias("distance"))
    return x.groupBy("structure", "key1", "key2").agg((F.avg if measure == "average" else F.min)("distance").alias("distance"))


def same_site_pairs(weights: DataFrame) -> DataFrame:
    """Pairs of different mutation keys that share a transcript and protein position (an equi-join, never all by all)."""
    at = weights.select("mutation_key", F.split("protein_key", ":")[0].alias("transcript"), C.aa_position(F.split("protein_key", ":")[1]).alias("pos")).filter("pos is not null").distinct()
    b = at.withColumnRenamed("mutation_key", "key2")
    return at.withColumnRenamed("mutation_key", "key1").join(b, ["transcript", "pos"]).filter("key1 < key2").select("key1", "key2").distinct()


def greedy_cover(ranks: DataFrame, near: DataFrame, by: list[str]) -> DataFrame:
    """``*by, head, key``: in order of rank each vertex not yet taken is a head and takes all that are near it and left, itself too.

    ``ranks``: by, key, rank (smallest first, no two alike in a group); ``near``: by, better, rank1, key, both ways or with the better
    end first. The search is done in rounds: a vertex is a head once none of the better ones near it is left to decide and none
    is a head; it is taken as soon as one of them is. The best of these has it, whatever the order of the rounds.
    """
    at = [*by, "key"]
    mine = ranks.select(*at, F.col("rank").alias("rank2"))
    near = cut(near.select(*by, "better", "rank1", "key").join(mine, at).filter("rank1 < rank2").drop("rank2"))
    state = cut(ranks.select(*at, F.lit(None).cast("boolean").alias("head")))  # null: to be decided
    while not state.filter("head is null").isEmpty():
        seen = state.select(*by, F.col("key").alias("better"), F.col("head").alias("h"))
        todo = near.join(state.filter("head is null").select(*at), at, "left_semi").join(seen, [*by, "better"])
        told = todo.groupBy(*at).agg(F.bool_or(F.coalesce("h", F.lit(False))).alias("taken"), F.bool_or(F.col("h").isNull()).alias("waits"))
        now = F.when(F.col("head").isNotNull(), F.col("head")).when(F.col("taken"), False).when(F.col("waits"), F.lit(None)).otherwise(True)
        last, state = state, cut(state.join(told, at, "left").select(*at, now.alias("head")))
        drop_cut(last)
    heads = state.filter("head").select(*at)
    taken = near.join(heads.withColumnRenamed("key", "better"), [*by, "better"]).groupBy(*at).agg(F.min_by("better", "rank1").alias("head"))
    return cut(heads.select(*by, F.col("key").alias("head"), "key").unionByName(taken.select(*by, "head", "key")))


def site_survivors(weights: DataFrame) -> DataFrame:
    """``gene, mutation_key, survivor``: keys of a gene in order, each not yet taken takes all keys of its site. Same site is not transitive."""
    keys = cut(weights.select("gene", F.col("mutation_key").alias("key")).distinct())
    pairs = same_site_pairs(weights)  # key1 < key2
    near = pairs.join(keys.select("gene", F.col("key").alias("key1")), "key1").join(keys.select("gene", F.col("key").alias("key2")), ["gene", "key2"])
    near = near.select("gene", F.col("key1").alias("better"), F.col("key1").alias("rank1"), F.col("key2").alias("key"))
    return greedy_cover(keys.withColumn("rank", F.col("key")), near, ["gene"]).select("gene", F.col("key").alias("mutation_key"), F.col("head").alias("survivor"))


def representative_sites(weights: DataFrame, vertex_type: str = "site") -> DataFrame:
    """Sites collapsed onto their survivor with its heaviest (ref_alt, protein_key); weight 1, or the sum of one weight for each member."""
    met = weights.join(site_survivors(weights), ["gene", "mutation_key"])
    own = met.filter("mutation_key = survivor").groupBy("gene", "survivor").agg(F.max_by(F.struct("ref_alt", "protein_key"), F.struct("weight", "ref_alt", "protein_key")).alias("r"))
    one = met.groupBy("gene", "survivor", "mutation_key", "ref_alt").agg(F.max("weight").alias("weight")).groupBy("gene", "survivor").agg(F.sum("weight").alias("total"))
    return own.join(one, ["gene", "survivor"]).select("gene", F.col("survivor").alias("mutation_key"), "r.ref_alt", "r.protein_key", F.lit(1.0).alias("weight") if vertex_type == "site" else F.col("total").alias("weight"))


def super_clusters(edges: DataFrame) -> DataFrame:
    """``structure, key, super_id``: connected components of each structure, numbered from 0 in order of their smallest key."""
    node = lambda k: F.struct(F.col("structure").alias("s"), F.col(k).alias("k"))
    found = connected_components(edges.select(node("key1").alias("a"), node("key2").alias("b")))
    found = found.select(F.col("node.s").alias("structure"), F.col("node.k").alias("key"), F.col("component.k").alias("low"))
    found = cut(found)
    ids = running(found.select("structure", "low").distinct(), ["structure"], ["low"], number="super_id")
    return found.join(ids, ["structure", "low"]).select("structure", "key", F.col("super_id").cast("int").alias("super_id"))


def _written_with_nearest(paths: DataFrame) -> tuple[DataFrame, float | None]:
    """``paths`` written, and the least open ``d`` seen on the way (null: none), which saves a reading of what was written."""
    seen = Observation()
    return cut(paths.observe(seen, F.min(F.when(F.col("open"), F.col("d"))).alias("near"))), seen.get.get("near")


def geodesics(edges: DataFrame, same_site: DataFrame, components: DataFrame, max_distance: float | None = None, step: float | None = None) -> DataFrame:
    """``structure, super_id, key1, key2, geodesic``: shortest paths between the vertices of a component, both ways, each vertex to itself included.

    Same-site pairs are 0 apart. Paths above ``max_distance`` are left out; without it all pairs of a component are in
    reach. Distances are relaxed in rounds of joins from all vertices at once, nearest first: a round goes on from what
    was bettered below the end of the nearest open stretch of ``step`` (default: all that was bettered). Each
    round is written, so nothing is worked out twice and no component meets in one place. What a round goes on from is
    dealt to tasks by its start first: it is few bytes, which would be read by one task, but makes many rows.
    """
    n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    one = components.select("structure", "super_id", F.col("key").alias("key1"))
    two = components.select("structure", F.col("super_id").alias("other"), F.col("key").alias("key2"))
    zero = same_site.select("key1", "key2").join(one, "key1").join(two, ["structure", "key2"]).filter("super_id = other")
    links = edges.select("structure", "key1", "key2", "distance").unionByName(zero.select("structure", "key1", "key2", F.lit(0.0).alias("distance")))
    if max_distance is not None:
        links = links.filter(F.col("distance") <= max_distance)
    both = links.unionByName(links.select("structure", F.col("key2").alias("key1"), F.col("key1").alias("key2"), "distance")).filter("key1 <> key2")
    arcs = cut(both.groupBy("structure", F.col("key1").alias("mid"), F.col("key2").alias("next")).agg(F.min("distance").alias("w")))
    start = components.select("structure", "super_id", F.col("key").alias("key1"), F.col("key").alias("key2"), F.lit(0.0).alias("d"), F.lit(True).alias("open"))
    known, near = _written_with_nearest(start)
    while near is not None:
        due = F.col("open") if step is None else F.col("open") & (F.col("d") < (near // step + 1) * step)
        ends = known.filter(due).repartition(n, "structure", "key1").alias("p")
        met = ends.join(arcs.alias("a"), (F.col("p.structure") == F.col("a.structure")) & (F.col("p.key2") == F.col("a.mid")))
        far = met.select("p.structure", "super_id", "key1", F.col("next").alias("key2"), (F.col("d") + F.col("w")).alias("d"), F.lit(True).alias("open"))
        if max_distance is not None:
            far = far.filter(F.col("d") <= max_distance)
        # of equal distances the one that has been gone on from stays; least doubles, and not least rows, let the planner add up by hash
        every = known.withColumn("open", F.col("open") & ~due).unionByName(far)
        best = every.groupBy("structure", "super_id", "key1", "key2").agg(F.min("d").alias("d"), F.min(F.when(~F.col("open"), F.col("d"))).alias("done"))
        last = known
        known, near = _written_with_nearest(best.select("structure", "super_id", "key1", "key2", "d", (F.col("done").isNull() | (F.col("d") < F.col("done"))).alias("open")))
        drop_cut(last)
    drop_cut(arcs)
    return known.select("structure", "super_id", "key1", "key2", F.col("d").alias("geodesic"))


def vertices(weights: DataFrame) -> DataFrame:
    """One row for each (mutation_key, ref_alt): its smallest protein key with that weight, the other ones joined by ``|``."""
    return weights.groupBy("mutation_key", "ref_alt").agg(F.min(F.struct("protein_key", "weight", "gene")).alias("m"), F.sort_array(F.collect_set("protein_key")).alias("all")).select(
        "mutation_key", "ref_alt", "m.gene", "m.protein_key", "m.weight", F.array_join(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), "|").alias("alternatives")
    )


def vertex_scores(geo: DataFrame, verts: DataFrame, vertex_type: str = "recurrence", score: str = "closeness", max_distance: float | None = None) -> DataFrame:
    """``structure, super_id, key, ref_alt, score``: all vertices of the component weigh in, fading with their distance."""
    w = F.lit(1.0) if vertex_type == "unique" else F.col("w2")
    a = verts.select(F.col("mutation_key").alias("key1"), F.col("ref_alt").alias("ra1"))
    b = verts.select(F.col("mutation_key").alias("key2"), F.col("ref_alt").alias("ra2"), F.col("weight").alias("w2"))
    met = geo.join(a, "key1").join(b, "key2")
    if score == "exponentials":
        term = C.exponential_term(w, F.col("geodesic"))
    else:
        own = w if vertex_type == "weight" else F.when(F.col("ra1") == F.col("ra2"), w - 1).otherwise(w)
        term = F.when(F.col("key1") == F.col("key2"), own).otherwise(C.closeness_term(w, F.col("geodesic")))
    return met.groupBy("structure", "super_id", F.col("key1").alias("key"), F.col("ra1").alias("ref_alt")).agg(F.sum(term).alias("score"))


def radius_clusters(scores: DataFrame, geo: DataFrame, max_radius: float = 10.0) -> DataFrame:
    """``structure, super_id, sub_id, centroid, key, geodesic``: again and again the best-scored vertex left takes all that are left within the radius.

    Ties of score go to the smallest key. The first centroid that finds no other vertex is given out as a cluster of its
    own and ends the search: what is left behind it belongs to no cluster. ``geo`` needs the paths up to the radius.

    The search itself is :func:`greedy_cover`.
    """
    by = ["structure", "super_id"]
    # rank: best first, so the smallest
    ranks = cut(scores.groupBy(*by, "key").agg(F.struct((-F.round(F.max(F.abs("score")), 9)).alias("s"), F.col("key").alias("k")).alias("rank")))
    ball = cut(geo.filter((F.col("geodesic") <= max_radius) & (F.col("key1") != F.col("key2"))).select(*by, F.col("key1").alias("better"), F.col("key2").alias("key"), "geodesic"))
    near = ball.join(ranks.select(*by, F.col("key").alias("better"), F.col("rank").alias("rank1")), [*by, "better"])
    members = greedy_cover(ranks, near, by).withColumnRenamed("head", "centroid")
    found = members.groupBy(*by, "centroid").agg(F.count(F.lit(1)).alias("n")).join(ranks.withColumnRenamed("key", "centroid"), [*by, "centroid"])
    ends = found.filter("n = 1").groupBy(*by).agg(F.min("rank").alias("end"))
    kept = found.join(ends, by, "left").filter("end is null or rank <= end").select(*by, "centroid", "rank")
    numbered = running(kept, by, ["rank"], number="sub_id").select(*by, F.col("sub_id").cast("int").alias("sub_id"), "centroid")
    far = members.join(ball.withColumnRenamed("better", "centroid"), [*by, "centroid", "key"], "left").select(*by, "centroid", "key", F.coalesce("geodesic", F.lit(0.0)).alias("geodesic"))
    return numbered.join(far, [*by, "centroid"]).select(*by, "sub_id", "centroid", "key", "geodesic")


def degree(geo: DataFrame, verts: DataFrame, cutoff: float = 10.0) -> DataFrame:
    """``structure, key, degree``: vertices, itself included, nearer than the cutoff."""
    b = verts.select(F.col("mutation_key").alias("key2"))
    return geo.filter(F.col("geodesic") < cutoff).join(b, "key2").groupBy("structure", F.col("key1").alias("key")).agg(F.count(F.lit(1)).alias("degree"))


def cluster_rows(clusters: DataFrame, scores: DataFrame, degrees: DataFrame, verts: DataFrame) -> DataFrame:
    """One row for each (vertex, ref_alt) of each cluster, with its id, score, degree, distance from the centroid and protein keys."""
    v = verts.withColumnRenamed("mutation_key", "key")
    met = clusters.join(scores.drop("super_id"), ["structure", "key"]).join(degrees, ["structure", "key"], "left").join(v, ["key", "ref_alt"])
    p = F.split("key", ":")
    cid = F.concat_ws(".", F.col("super_id").cast("string"), F.col("sub_id").cast("string"), F.when(F.col("structure") != "any", F.col("structure")))
    return met.select(
        cid.alias("cluster"), "structure", "super_id", "sub_id", "gene", F.split("protein_key", ":")[1].alias("mutation"), "degree", "score", "geodesic", "weight",
        p[1].alias("chromosome"), p[2].alias("start"), p[3].alias("stop"), F.split("ref_alt", ":")[0].alias("ref"), F.split("ref_alt", ":")[1].alias("alt"),
        F.split("protein_key", ":")[0].alias("transcript"), "alternatives", "key",
    )


def sort_clusters(rows: DataFrame) -> DataFrame:
    """Rows in the order in which they are written: by cluster, then by what a line holds; rows that agree in that go by key."""
    return rows.orderBy("super_id", "sub_id", "structure", "gene", "mutation", "ref", "alt", "key")
