"""Significance of clusters, and null tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mutprox.functions import columns as C
from mutprox.session import ship

#: Draws that one step of the simulation may hold.
DRAWS = 2_000_000
#: Exponent of Hoeffding's bound at which one simulated mean falls on the other side of the observed one with a chance under 1e-18.
CERTAIN = 41.5
#: Places of the grid on which the law of a sum is worked out.
GRID = 1 << 23


def best_structure(presence: DataFrame) -> DataFrame:
    """``cluster, pdb``: the structure with most recurrence in the cluster; of equals the smallest id. ``presence``: cluster, pdb, recurrence."""
    total = presence.groupBy("cluster", "pdb").agg(F.sum("recurrence").alias("recurrence"))
    return total.groupBy("cluster").agg(F.min_by("pdb", F.struct(-F.col("recurrence"), "pdb")).alias("pdb"), F.max("recurrence").alias("recurrence"))


def within_cluster_distance(members: DataFrame, pairs: DataFrame, best: DataFrame) -> DataFrame:
    """``cluster, distance_sum, mass, n_pairs, pair_p``: weighted distances inside each cluster in its best structure, and the p-value of its nearest pair there.

    ``members``: cluster, gene, mutation, weight; ``pairs``: gene1, mutation1, gene2, mutation2, info.
    """
    m = lambda n: members.select("cluster", *[F.col(c).alias(f"{c}{n}") for c in ("gene", "mutation", "weight")])
    each = pairs.select("gene1", "mutation1", "gene2", "mutation2", F.explode("info").alias("x"))
    met = each.join(m(1), ["gene1", "mutation1"]).join(m(2), ["cluster", "gene2", "mutation2"]).join(best.select("cluster", "pdb"), "cluster").filter(F.col("x.pdb") == F.col("pdb"))
    d = met.groupBy("cluster").agg(F.sum(F.col("weight1") * F.col("weight2") * F.col("x.distance")).alias("distance_sum"), F.min(F.struct("x.distance", "x.p_value"))["p_value"].alias("pair_p"))
    mass = members.groupBy("cluster").agg(F.sum(F.floor("weight")).alias("mass"))
    return mass.join(d, "cluster", "left").select("cluster", F.coalesce("distance_sum", F.lit(0.0)).alias("distance_sum"), "mass", (F.col("mass") * (F.col("mass") - 1) / 2).alias("n_pairs"), "pair_p")


def background_distances(prox: DataFrame, proteins: DataFrame, best: DataFrame) -> DataFrame:
    """``cluster, distance``: residue pairs of the cluster's first protein in its best structure whose other end is in one of its proteins.

    ``proteins``: cluster, uniprot, is_first. Unordered pairs count once; a cluster of one protein also gets a zero for each residue.
    """
    first = proteins.filter("is_first").select("cluster", F.col("uniprot").alias("uniprot1"))
    rows = prox.filter(C.is_aa(F.col("name1")) & C.is_aa(F.col("name2"))).join(best.select("cluster", "pdb"), "pdb").join(first, ["cluster", "uniprot1"])
    rows = rows.join(proteins.select("cluster", F.col("uniprot").alias("uniprot2")), ["cluster", "uniprot2"])
    end = lambda n: F.struct(*[F.col(f"{c}{n}").alias(c) for c in ("uniprot", "chain", "pos")])
    pairs = rows.select("cluster", F.least(end(1), end(2)).alias("a"), F.greatest(end(1), end(2)).alias("b"), "distance").dropDuplicates(["cluster", "a", "b"])
    single = proteins.groupBy("cluster").agg(F.countDistinct("uniprot").alias("n")).filter("n = 1").select("cluster")
    zero = rows.join(single, "cluster").select("cluster", end(1).alias("a")).distinct().select("cluster", F.lit(0.0).alias("distance"))
    return pairs.select("cluster", "distance").unionByName(zero)


def _below(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    r = rows.iloc[0]
    values, n = np.asarray(r["background"], float), int(r["n_pairs"])
    rng = np.random.default_rng([seed, int(r["batch"]), abs(hash_text(r["cluster"]))])
    sims = int(r["sims"])
    gap, width = r["observed"] - values.mean(), values.max() - values.min()
    if 2.0 * n * gap * gap > CERTAIN * width * width:  # no draw could tell otherwise
        below, left = sims if gap > 0 else 0, 0
    else:
        below, left = 0, sims
    distinct, times = np.unique(values, return_counts=True)
    while left:
        if n > len(distinct):  # how often each distance comes up follows the multinomial law, and that is all the sum needs
            take = max(1, min(left, DRAWS // len(distinct)))
            sums = rng.multinomial(n, times / len(values), size=take) @ distinct
        else:
            take = max(1, min(left, DRAWS // max(1, n)))
            sums = np.zeros(take)
            for at in range(0, n, max(1, DRAWS // take)):
                part = min(n - at, max(1, DRAWS // take))
                sums += values[rng.integers(len(values), size=(take, part))].sum(axis=1)
        below += int((sums / n < r["observed"]).sum())
        left -= take
    return pd.DataFrame({"cluster": [r["cluster"]], "below": [below], "sims": [int(r["sims"])]})


def hash_text(s: str) -> int:
    import zlib

    return zlib.crc32(str(s).encode())


def cluster_significance(observed: DataFrame, background: DataFrame, n_sims: int = 1_000_000, batch: int = 20_000, seed: int = 1) -> DataFrame:
    """``cluster, p_value, n_sims``: share of simulated means of ``n_pairs`` draws below the observed mean; null for a cluster without a pair.

    A cluster of mass 2 is one pair and has that pair's own p-value (``pair_p`` of ``observed``, where that is given), without simulations.
    Batches of simulations are spread over tasks; a cluster's background is one sorted array, bounded by its structure's residue pairs.
    Many draws with replacement are made as one multinomial draw over the distinct distances; where Hoeffding's bound leaves
    a chance under 1e-12 that any of a million simulations falls on the other side of the observed mean, none is drawn.
    """
    spark = ship(observed.sparkSession)
    arrays = background.groupBy("cluster").agg(F.sort_array(F.collect_list("distance")).alias("background"))
    n = max(1, -(-n_sims // batch))
    steps = spark.range(n).select(F.col("id").alias("batch"), F.least(F.lit(batch), F.lit(n_sims) - F.col("id") * batch).alias("sims"))
    own = observed.filter("mass = 2").select("cluster", F.col("pair_p").alias("p_value"), F.lit(0).cast("long").alias("n_sims")) if "pair_p" in observed.columns else None
    obs = (observed if own is None else observed.filter("mass <> 2")).filter("n_pairs >= 1").select("cluster", "n_pairs", (F.col("distance_sum") / F.col("n_pairs")).alias("observed"))
    rows = obs.join(arrays, "cluster").crossJoin(F.broadcast(steps))
    found = rows.groupBy("cluster", "batch").applyInPandas(lambda x: _below(x, seed), f"cluster {observed.schema['cluster'].dataType.simpleString()}, below long, sims long")
    p = found.groupBy("cluster").agg((F.sum("below") / F.sum("sims")).alias("p_value"), F.sum("sims").alias("n_sims"))
    return observed.select("cluster").distinct().join(p if own is None else p.unionByName(own), "cluster", "left")


def _exact(rows: pd.DataFrame) -> pd.DataFrame:
    r = rows.iloc[0]
    values, n = np.rint(np.asarray(r["background"], float) * 1000).astype(np.int64), int(r["n_pairs"])
    low, width, p = int(values.min()), int(values.max() - values.min()), None
    if n * width < GRID:
        size = 1 << (n * width + 1).bit_length()
        law = np.bincount(values - low, minlength=width + 1) / len(values)
        # the law of a sum of n draws is the n-fold convolution of the law of one
        total = np.fft.irfft(np.fft.rfft(law, size) ** n, size)[: n * width + 1]
        below = int(np.ceil(r["distance_sum"] * 1000 - 1e-6)) - n * low
        p = float(min(1.0, max(0.0, total[: max(0, below)].sum())))
    return pd.DataFrame({"cluster": [r["cluster"]], "p_value": [p]})


def exact_significance(observed: DataFrame, background: DataFrame) -> DataFrame:
    """``cluster, p_value``: the chance that the mean of ``n_pairs`` draws lies below the observed mean, worked out instead of simulated.

    Distances count in thousandths, as they are kept. Null for a cluster without a pair or a background, and where pairs times
    the spread of the background exceed the grid of 2^23 places. Mass 2 has its pair's own p-value, as in :func:`cluster_significance`.
    """
    ship(observed.sparkSession)
    arrays = background.groupBy("cluster").agg(F.collect_list("distance").alias("background"))
    rows = observed.filter("n_pairs >= 1").select("cluster", "n_pairs", "distance_sum").join(arrays, "cluster")
    p = rows.groupBy("cluster").applyInPandas(_exact, f"cluster {observed.schema['cluster'].dataType.simpleString()}, p_value double")
    if "pair_p" not in observed.columns:
        return observed.select("cluster").join(p, "cluster", "left")
    met = observed.select("cluster", "mass", "pair_p").join(p, "cluster", "left")
    return met.select("cluster", F.when(F.col("mass") == 2, F.col("pair_p")).otherwise(F.col("p_value")).alias("p_value"))


def random_sites(sites: DataFrame, n_per_gene: DataFrame, n_shuffles: int, unique: bool = True, seed: int = 1) -> DataFrame:
    """``gene, shuffle, positions``: as many places of a gene as it has covered variants, drawn again for each shuffle, sorted.

    ``sites``: gene, position; ``n_per_gene``: gene, n. With ``unique`` places are drawn without replacement, else with.
    """
    spark = sites.sparkSession
    shuffles = F.broadcast(spark.range(n_shuffles).select(F.col("id").alias("shuffle")))
    ranked = sites.select("gene", "position").distinct()
    if unique:
        dealt = ranked.crossJoin(shuffles).withColumn("r", F.xxhash64(F.lit(seed), "shuffle", "gene", "position"))
        dealt = dealt.withColumn("k", F.row_number().over(W.partitionBy("gene", "shuffle").orderBy("r", "position")))
        drawn = dealt.join(n_per_gene, "gene").filter("k <= n").select("gene", "shuffle", "position")
    else:
        w = W.partitionBy("gene")
        ranked = ranked.withColumn("k", F.row_number().over(w.orderBy("position"))).withColumn("total", F.count(F.lit(1)).over(w))
        totals = ranked.select("gene", "total").distinct()
        draws = n_per_gene.filter("n > 0").join(totals, "gene").crossJoin(shuffles).withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        draws = draws.withColumn("k", (F.pmod(F.xxhash64(F.lit(seed), "shuffle", "gene", "draw"), F.col("total")) + 1).cast("int"))
        drawn = draws.join(ranked.select("gene", "k", "position"), ["gene", "k"]).select("gene", "shuffle", "position")
    return drawn.groupBy("gene", "shuffle").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def simulated_mafs(template: DataFrame, trials: DataFrame) -> DataFrame:
    """Rows of simulated tables: each gene's first call with its position replaced. ``trials``: gene, shuffle, positions."""
    first = template.groupBy("gene").agg(F.min_by(F.struct(*[F.col(c) for c in template.columns]), "line_no").alias("t"))
    rows = trials.select("gene", "shuffle", F.explode("positions").alias("position")).join(first, "gene")
    keep = [F.col(f"t.{c}").alias(c) for c in template.columns if c not in ("aa_change", "line_no", "gene")]
    return rows.select("gene", "shuffle", "position", *keep, F.concat(F.regexp_extract("t.aa_change", r"^(p\.\D*)\d+", 1), F.col("position").cast("string"), F.regexp_extract("t.aa_change", r"^p\.\D*\d+(.*)$", 1)).alias("aa_change"))


def random_weights(maf: DataFrame, lo: int = -20, hi: int = 19, seed: int = 1) -> DataFrame:
    """An integer ``weight`` for each row, even over [lo, hi]; it hangs on the row and seed only, not on partitions."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in maf.columns if c != "weight"])
    return maf.drop("weight").withColumn("weight", (F.pmod(h, F.lit(hi - lo + 1)) + lo).cast("int"))


def structure_coverage(ranges: DataFrame, proteins: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Share of residues in any structure for each protein, and structures over each variant's place.

    ``ranges``: uniprot, pdb, u_start, u_stop; ``proteins``: uniprot, length; ``variants``: uniprot, position.
    """
    each = ranges.filter("u_start <= u_stop").select("uniprot", "pdb", F.explode(F.sequence("u_start", "u_stop")).alias("position")).distinct()
    covered = each.groupBy("uniprot").agg(F.countDistinct("position").alias("n_covered"))
    share = proteins.join(covered, "uniprot", "left").select("uniprot", "length", F.coalesce("n_covered", F.lit(0)).alias("n_covered"), (F.coalesce("n_covered", F.lit(0)) / F.col("length")).alias("fraction"))
    depth = each.groupBy("uniprot", "position").agg(F.countDistinct("pdb").alias("depth"))
    at = variants.select("uniprot", "position").distinct().join(depth, ["uniprot", "position"], "left").fillna(0, ["depth"])
    return share, at.withColumn("covered", F.col("depth") > 0)


def cluster_size_histogram(clusters: DataFrame) -> DataFrame:
    """``measure, size, n, probability``: how many clusters have so many places, and so many variants. ``clusters``: trial, cluster, position."""
    sizes = clusters.groupBy("trial", "cluster").agg(F.countDistinct("position").alias("positions"), F.count(F.lit(1)).alias("variants"))
    long = sizes.select(F.explode(F.map_from_arrays(F.array(F.lit("positions"), F.lit("variants")), F.array("positions", "variants"))).alias("measure", "size"))
    return with_probability(long.groupBy("measure", "size").agg(F.count(F.lit(1)).alias("n")))


def with_probability(counts: DataFrame) -> DataFrame:
    return counts.select("measure", "size", "n", (F.col("n") / F.sum("n").over(W.partitionBy("measure"))).alias("probability"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("measure", "size", "n")
    for p in parts[1:]:
        out = out.unionByName(p.select("measure", "size", "n"))
    return with_probability(out.groupBy("measure", "size").agg(F.sum("n").alias("n")))
