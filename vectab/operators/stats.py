"""Aggregations over vectors, clusters and cluster counts."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_2d
from ..functions.quant import sbq_bytes, sbq_code, sbq_words
from ..functions.vector import dot, nonzero, unit
from ..plans.scaling import null_safe_join, running, salted_join

# Fixed value: where the running minimum of a cluster's distances starts.
FAR_AWAY = 0xFFFF


def _ml(vector) -> F.Column:
    return array_to_vector(vector)


def dim_stats(table: DataFrame, vector: str) -> DataFrame:
    """One row: mean and population standard deviation per dimension.

    The summarizer adds up whole vectors per task, so only one small buffer per
    task is shuffled, not one row per value.
    """
    stats = (
        table.filter(F.col(vector).isNotNull())
        .select(_ml(F.col(vector).cast("array<double>")).alias("_v"))
        .agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s"))
    )
    n = F.col("s.count")
    # the summarizer divides by n - 1
    shrink = F.when(n > 1, (n - 1) / n).otherwise(F.lit(0.0))
    return stats.select(
        vector_to_array("s.mean").alias("mean"),
        F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * shrink)).alias("std"),
    )


def sbq_fit(table: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Means and spreads as two lists, one number per dimension."""
    row = dim_stats(table, vector).first()
    return list(row["mean"]), list(row["std"])


def sbq_encode(table: DataFrame, vector: str, mean: list[float], std: list[float]) -> DataFrame:
    """Replace the vector by its code: ``code`` words for distances, ``packed`` bytes as hex."""
    dims = len(mean)
    return (
        table.filter(F.size(vector) == dims)
        .withColumn("_codes", sbq_code(vector, mean, std))
        .withColumn("code", sbq_words("_codes", dims))
        .withColumn("packed", sbq_bytes("_codes", dims))
        .drop("_codes", vector)
    )


def cluster_sizes(table: DataFrame, cluster: str) -> DataFrame:
    return table.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))


def singletons_to_noise(table: DataFrame, key: str, cluster: str) -> DataFrame:
    """Label -1 where a cluster has one row.

    Lone rows are found by aggregation and joined back on their own key, so a
    cluster that holds a third of the table is never gathered.
    """
    lone = (
        table.filter(F.col(cluster).isNotNull()).groupBy(cluster)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(key))
        .filter("_n = 1").select(key, F.lit(True).alias("_lone"))
    )
    return (
        table.join(lone, key, "left")
        .withColumn(cluster, F.when(F.col("_lone"), F.lit(-1)).otherwise(F.col(cluster)))
        .drop("_lone")
    )


def usable(vector: str, scaled: bool) -> F.Column:
    """A vector that can be scaled, or just one that is there."""
    return nonzero(vector) if scaled else F.col(vector).isNotNull()


def vector_sums(table: DataFrame, vector: str, by: str, scaled: bool = True) -> DataFrame:
    """Per group the number of rows and the sum of their vectors, scaled to length one or not."""
    v = unit(vector) if scaled else F.col(vector).cast("array<double>")
    return (
        table.filter(usable(vector, scaled)).select(by, v.alias("_u"))
        .groupBy(by)
        .agg(Summarizer.metrics("sum", "count").summary(_ml(F.col("_u"))).alias("s"))
        .select(by, F.col("s.count").alias("n"), vector_to_array("s.sum").alias("total"))
    )


def cluster_spread(table: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Mean pair distance 1 - cosine inside each cluster, 0 for a single row.

    The pair cosines of n unit vectors add up to (|sum|^2 - n) / 2, so no pair
    is ever formed.
    """
    sums = vector_sums(table, vector, cluster)
    pairs = F.col("n") * (F.col("n") - 1)
    spread = 1 - (dot("total", "total") - F.col("n")) / F.when(F.col("n") > 1, pairs)
    return sums.select(cluster, "n", F.coalesce(spread, F.lit(0.0)).alias("spread"))


def linkage_average(table: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Mean distance 1 - cosine between every two clusters a < b.

    It is 1 minus the dot product of the clusters' mean unit vectors. The rows
    are cluster pairs, which is the result itself.
    """
    from .blocks import threshold_join

    sums = vector_sums(table, vector, cluster).select(
        cluster, F.transform("total", lambda t: t / F.col("n")).alias("m")
    )
    left = sums.select(F.col(cluster).alias("l_key"), F.col("m").alias("l_vec"))
    right = sums.select(F.col(cluster).alias("r_key"), F.col("m").alias("r_vec"))
    pairs = threshold_join(left, right, -2.0, metric="dot", exclude_same=True)
    return pairs.filter("l_key < r_key").select(
        F.col("l_key").alias("a"), F.col("r_key").alias("b"), (1 - F.col("score")).alias("dist")
    )


def medoid(table: DataFrame, key: str, vector: str, cluster: str, metric: str = "cosine") -> DataFrame:
    """Flag, per cluster, the row with the largest similarity to the others in sum.

    A row's similarities add up to its vector (scaled to length one for
    ``cosine``, as it is for ``dot``) times the cluster's sum, less its share
    with itself. Ties go to the smaller key.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric!r}, known are cosine and dot")
    scaled = metric == "cosine"
    sums = vector_sums(table, vector, cluster, scaled).select(cluster, "total")
    rows = table.filter(usable(vector, scaled)).select(
        key, cluster, (unit(vector) if scaled else F.col(vector)).alias("_u")
    )
    scored = salted_join(rows, sums, [cluster], spread=key).select(
        cluster, key, F.round(dot("_u", "total") - dot("_u", "_u"), 9).alias("similarity")
    )
    best = scored.groupBy(cluster).agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), F.col(key).alias("k"))).alias("b")
    )
    flags = best.select(F.col("b.k").alias(key), (-F.col("b.s")).alias("similarity"), F.lit(True).alias("central"))
    return table.join(flags, key, "left").withColumn("central", F.coalesce("central", F.lit(False)))


def centroids(members: DataFrame, cluster: str = "cluster", x: str = "x", y: str = "y") -> DataFrame:
    """Mean point and size per cluster, over the full member list."""
    return members.groupBy(cluster).agg(
        F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count(F.lit(1)).alias("size")
    )


def member_distances(members: DataFrame, key: str, cluster: str, x: str, y: str) -> DataFrame:
    """Members with the distance to their cluster's centroid, for hot clusters too."""
    means = centroids(members, cluster, x, y).select(cluster, "cx", "cy")
    joined = salted_join(members, means, [cluster], spread=key)
    # rounded, so that the order of a distributed sum never decides a comparison
    return joined.withColumn("dist", F.round(distance_2d("cx", "cy", x, y), 9)).drop("cx", "cy")


def record_lows(
    members: DataFrame, key: str, pos: str, cluster: str = "cluster", x: str = "x", y: str = "y"
) -> DataFrame:
    """Members with ``center`` true where they beat every earlier member's distance."""
    far = member_distances(members, key, cluster, x, y)
    ran = running(far, [pos], "dist", "min", "_low", group=[cluster], inclusive=False)
    return ran.withColumn(
        "center", F.col("dist") < F.coalesce(F.least("_low", F.lit(float(FAR_AWAY))), F.lit(float(FAR_AWAY)))
    ).drop("_low")


def nearest_to_centroid(
    members: DataFrame, key: str, pos: str, cluster: str = "cluster", x: str = "x", y: str = "y"
) -> DataFrame:
    """Members with ``center`` true on the nearest one only; the earlier wins a tie."""
    far = member_distances(members, key, cluster, x, y)
    nearest = far.groupBy(cluster).agg(F.min(F.struct("dist", pos, key)).alias("b"))
    flags = nearest.select(cluster, F.col(f"b.{key}").alias(key), F.lit(True).alias("center"))
    return null_safe_join(far, flags, [cluster, key]).withColumn(
        "center", F.coalesce("center", F.lit(False))
    )


def spread_by_k(merges: DataFrame, rows: int) -> DataFrame:
    """Sum of cluster spreads for each K in 1..N-1, from the merge table.

    Undoing the merge of rank r leads from K = N - r to K + 1 clusters and
    changes the sum by spread(left) + spread(right) - spread(node); the sum over
    all earlier merges is one running total.
    """
    delta = merges.select(
        "rank", (F.col("spread") - F.col("left_spread") - F.col("right_spread")).alias("_delta")
    )
    total = running(delta, ["rank"], "_delta", "sum", "spread")
    return total.select((F.lit(rows) - F.col("rank")).cast("long").alias("k"), "spread")


def pick_k_peak(curve: DataFrame, compat: bool = False) -> DataFrame:
    """K = (place of the highest spread) - 1, the first maximum wins.

    A peak at K = 1 would leave no cluster; it is raised to 1 unless ``compat``.
    """
    best = curve.filter(F.col("spread").isNotNull()).agg(
        F.min(F.struct((-F.round("spread", 12)).alias("s"), F.col("k").alias("k"))).alias("b")
    )
    k = F.col("b.k") - 1
    return best.select((k if compat else F.greatest(k, F.lit(1))).cast("long").alias("k"))


def pick_k_elbow(curve: DataFrame) -> DataFrame:
    """The K farthest from the chord between the first and the last point."""
    ends = curve.agg(
        F.min(F.struct("k", "spread")).alias("a"), F.max(F.struct("k", "spread")).alias("z")
    ).first()
    if ends.a is None:
        return curve.select("k").limit(0)
    # the two end points are fitted constants of the expression
    (ak, asp), (zk, zsp) = ends.a, ends.z
    chord = math.hypot(zk - ak, zsp - asp) or 1.0
    gap = F.abs((zsp - asp) * F.col("k") - (zk - ak) * F.col("spread") + (zk * asp - zsp * ak)) / chord
    best = curve.select("k", F.round(gap, 12).alias("gap")).agg(
        F.min(F.struct((-F.col("gap")).alias("g"), F.col("k").alias("k"))).alias("b")
    )
    # with no point off the chord the first K stands
    return best.select(F.col("b.k").cast("long").alias("k"))
