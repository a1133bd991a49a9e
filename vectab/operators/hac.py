"""Agglomerative clustering by rounds of mutual nearest neighbours, cuts, leaf order.

With distance 1 - cosine and average linkage, the distance of two clusters is
1 minus the dot product of their mean unit vectors. So a cluster is one row
(size and vector sum), and the table of pair distances, which would be the
square of the input, is never built. Average linkage is reducible: all mutual
nearest neighbours may merge in one round, and a cluster whose nearest
neighbour did not merge keeps it, so later rounds only ask for the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot, nonzero, unit
from ..plans.graph import climb_to_roots
from ..plans.scaling import cut_lineage, global_row_number, salted_join
from .blocks import OFF, matrix, nearest, nearest_join, nearest_others, screen_rows
from .stats import pick_k_peak, spread_by_k
from .table import scan_many

FINISH = 1 << 36  # multiplications of a round that are not worth jobs: one task goes on from there, for minutes at most,
HELD = 1 << 24  # as soon as it can hold the numbers of all vectors: 128 MB
CLUSTER = "struct(id, rep, size, h, spread, nn, dist)"
ODD = "vectors with values that are no finite numbers"
MERGE_SCHEMA = (
    "rank long, node long, left long, right long, height double, size long, "
    "spread double, left_spread double, right_spread double"
)


def number_rows(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(idx, key, u): rows in key order with their unit vectors; zero vectors left out."""
    usable = table.filter(nonzero(vector)).select(F.col(key).alias("key"), unit(vector).alias("u"))
    return cut_lineage(global_row_number(usable, ["key"], "idx"))


def _merge_mutual(state: DataFrame, stride: int) -> DataFrame:
    """One row per cluster after a round: mutual nearest neighbours made one.

    A cluster and its nearest neighbour form a sorted pair of ids. Two rows with
    the same pair are each other's nearest and merge (``l``, ``r`` are set); a
    single row stays as it is. No group has more than two rows. The spread of a merged
    cluster is left open, it needs the vectors.
    """
    grouped = (
        state.groupBy(F.expr("least(id, nn) AS l"), F.expr("greatest(id, nn) AS r"))
        .agg(F.expr(f"min({CLUSTER}) AS a"), F.expr(f"max({CLUSTER}) AS b"), F.expr("count(1) = 2 AS both"))
    )
    return grouped.selectExpr(
        f"if(both, {stride}L + least(a.rep, b.rep), a.id) AS id", "least(a.rep, b.rep) AS rep",
        "if(both, a.size + b.size, a.size) AS size",
        # a merge is never lower than its parts; this also holds against rounding
        "if(both, greatest(a.dist, a.h, b.h), a.h) AS h",
        "if(both, NULL, a.spread) AS spread",
        "if(both, NULL, a.nn) AS nn", "if(both, NULL, a.dist) AS dist",
        "if(both, l, NULL) AS l", "if(both, r, NULL) AS r",
        "if(both, a.spread, NULL) AS left_spread", "if(both, b.spread, NULL) AS right_spread",
    )


def _merge_vectors(vectors: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged clusters with size, sum and spread, all clusters with size and sum) after a round."""
    moves = pool.filter("l IS NOT NULL").selectExpr("id AS new", "explode(array(l, r)) AS id")
    pairs = vectors.join(moves, "id").groupBy("new").agg(F.sum("size").alias("size"), F.collect_list("s").alias("p"))
    born = pairs.selectExpr("new AS id", "size", "zip_with(p[0], p[1], (x, y) -> x + y) AS s")
    born = cut_lineage(born.withColumn("spread", spread_of(F.col("size"), F.col("s"))))
    return born, cut_lineage(vectors.join(moves, "id", "left_anti").unionByName(born.drop("spread")))


def _forget_merged(pool: DataFrame) -> DataFrame:
    """Clear the nearest neighbour of clusters whose neighbour has merged.

    A neighbour may be shared by many clusters: a hot key, so the join is salted.
    """
    gone = pool.filter("l IS NOT NULL").selectExpr("explode(array(l, r)) AS nn", "true AS _gone")
    known = salted_join(pool, gone, ["nn"], spread="id", how="left")
    return known.selectExpr(
        "id", "rep", "size", "h", "spread",
        "if(_gone IS NULL, nn, NULL) AS nn", "if(_gone IS NULL, dist, NULL) AS dist",
    )


def spread_of(size: Column, total: Column) -> Column:
    """Mean pair distance inside a cluster, from its size and vector sum."""
    pairs = F.when(size > 1, size * (size - 1))
    return F.coalesce(1 - (dot(total, total) - size) / pairs, F.lit(0.0))


def hac_rows(rows: DataFrame) -> DataFrame:
    """Merge table of numbered unit vectors (``idx``, ``u``).

    One row per merge: rank (1 is the lowest), node (N + rank - 1; leaves are
    0..N-1), left, right, height, size, spread and the children's spreads.
    ``left`` is the child that is older in list order, ``right`` the younger.
    """
    n = rows.count()
    if n < 2:
        return rows.sparkSession.createDataFrame([], MERGE_SCHEMA)
    # the vectors lie apart, so that what a round shuffles by neighbours is a few numbers per cluster
    vectors = rows.select(F.col("idx").alias("id"), F.lit(1).cast("long").alias("size"), F.col("u").alias("s"))
    state = rows.select(
        F.col("idx").alias("id"), F.col("idx").alias("rep"), F.lit(1).cast("long").alias("size"),
        F.lit(0.0).alias("h"), F.lit(0.0).alias("spread"),
        F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("dist"),
    )
    steps: list[DataFrame] = []
    live = asking = n
    dims = rows.select(F.size("u").alias("d")).first()["d"]
    while live > 1 and (asking * live * dims > FINISH or live * dims > HELD):
        pool = cut_lineage(_merge_mutual(_with_neighbours(state, vectors, asking, live), (len(steps) + 1) * n))
        born, vectors = _merge_vectors(vectors, pool)
        spreads = born.select("id", F.col("spread").alias("_spread"))
        pool = pool.join(spreads, "id", "left").withColumn("spread", F.coalesce("spread", "_spread")).drop("_spread")
        steps.append(pool.filter("l IS NOT NULL").select(
            "id", "l", "r", F.col("h").alias("height"), "size", "spread", "left_spread", "right_spread"))
        state = cut_lineage(_forget_merged(pool))
        counts = state.agg(F.count(F.lit(1)).alias("live"), F.count_if(F.col("nn").isNull()).alias("asking")).first()
        if counts["live"] == live:
            raise ValueError(ODD)
        live, asking = counts["live"], counts["asking"]
    if live > 1:
        steps.append(cut_lineage(_finish(state.join(vectors.select("id", "s"), "id"), n, len(steps))))
    return _number_merges(scan_many(steps), n)


def _finish(state: DataFrame, n: int, turn: int) -> DataFrame:
    """The merges of the last clusters, ``HELD`` numbers at most whatever the table: the same rounds, without a job for each."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        names = ("id", "rep", "size", "h", "spread", "dist")
        # clusters stand in the order of their ids: a new one behind all others, merged ones stay as dead rows for a while
        c = {name: group[name].to_numpy().copy() for name in names} | {"nn": group["nn"].fill_null(-1).to_numpy().copy(), "s": matrix(group["s"])}
        del group
        if not np.isfinite(c["s"]).all():
            raise ValueError(ODD)
        c["mean"] = c["s"] / c["size"][:, None]
        c["mean32"], c["alive"] = screen_rows(c["mean"]), np.ones(len(c["id"]), dtype=bool)
        used = live = len(c["id"])
        number, out = turn, []
        while live > 1:
            number += 1
            alive = c["alive"][:used]
            ask = np.flatnonzero(alive & (c["nn"][:used] < 0))
            at, best = nearest(c["mean"][ask], c["mean"][:used], ask, np.flatnonzero(~alive), c["mean32"][:used])
            c["nn"][ask], c["dist"][ask] = c["id"][at], 1 - best
            to, here = np.searchsorted(c["id"][:used], c["nn"][:used]), np.arange(used)
            a = np.flatnonzero(alive & (to[to] == here) & (here < to))
            a = a[np.argsort(np.minimum(c["rep"][a], c["rep"][to[a]]))]
            b = to[a]
            if not len(a):
                raise ValueError(ODD)
            both, total = c["size"][a] + c["size"][b], c["s"][a] + c["s"][b]
            born = {
                "rep": np.minimum(c["rep"][a], c["rep"][b]), "size": both, "s": total, "mean": total / both[:, None], "nn": -1, "dist": 0.0,
                "h": np.maximum(c["dist"][a], np.maximum(c["h"][a], c["h"][b])), "alive": True,
                "spread": 1 - ((total * total).sum(axis=1) - both) / (both * (both - 1)),
            }
            born |= {"id": number * n + born["rep"], "mean32": screen_rows(born["mean"])}
            out.append((born["id"], c["id"][a], c["id"][b], born["h"], both, born["spread"], c["spread"][a], c["spread"][b]))
            alive[a] = alive[b] = False
            c["mean32"][a, -1] = c["mean32"][b, -1] = OFF
            c["nn"][:used][alive & ~alive[to]] = -1
            if used + len(a) > len(c["id"]):
                kept, used = np.flatnonzero(alive), live - 2 * len(a)
                for name, column in c.items():
                    c[name] = np.empty((used + len(a) + live // 8, *column.shape[1:]), dtype=column.dtype)
                    c[name][:used] = column[kept]
            for name, values in born.items():
                c[name][used:used + len(a)] = values
            used, live = used + len(a), live - len(a)
        return pa.table([np.concatenate(x) for x in zip(*out)], names=["id", "l", "r", "height", "size", "spread", "left_spread", "right_spread"])

    return state.groupBy(F.lit(0).alias("all")).applyInArrow(
        run, "id long, l long, r long, height double, size long, spread double, left_spread double, right_spread double")


def _with_neighbours(state: DataFrame, vectors: DataFrame, asking: int, live: int) -> DataFrame:
    """Fill in the nearest other cluster where it is unknown: for ``asking`` of ``live`` clusters."""
    mean = "transform(s, x -> x / size)"
    if asking == live:
        hits = nearest_others(vectors.selectExpr("id AS l_key", f"{mean} AS l_vec"), live)
    else:
        left = vectors.join(state.filter("nn IS NULL").select("id"), "id", "left_semi")
        hits = nearest_join(
            left.selectExpr("id AS l_key", f"{mean} AS l_vec"), vectors.selectExpr("id AS r_key", f"{mean} AS r_vec"), (asking, live))
    found = hits.selectExpr("l_key AS id", "r_key AS _nn", "1 - score AS _dist")
    return state.join(found, "id", "left").selectExpr(
        "id", "rep", "size", "h", "spread", "coalesce(nn, _nn) AS nn", "coalesce(dist, _dist) AS dist",
    )


def _number_merges(merges: DataFrame, n: int) -> DataFrame:
    """Give merges their final node numbers in order of height."""
    ranked = cut_lineage(global_row_number(merges, ["height", "id"], "rank", start=1))
    numbers = ranked.select(F.col("id").alias("_id"), (F.col("rank") + n - 1).alias("_node"))

    def final(frame: DataFrame, side: str) -> DataFrame:
        # every cluster is the child of one merge, so these keys are unique
        named = numbers.select(F.col("_id").alias(side), F.col("_node").alias(f"_{side}"))
        return frame.join(named, side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")

    out = final(final(ranked, "l"), "r").withColumn("node", F.col("rank") + n - 1)
    swap = F.col("l") > F.col("r")
    return cut_lineage(out.select(
        "rank", "node",
        F.least("l", "r").alias("left"), F.greatest("l", "r").alias("right"), "height", "size", "spread",
        F.when(swap, F.col("right_spread")).otherwise(F.col("left_spread")).alias("left_spread"),
        F.when(swap, F.col("left_spread")).otherwise(F.col("right_spread")).alias("right_spread"),
    ))


def hac(table: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rows with idx and key, merge table) under 1 - cosine and average linkage."""
    rows = number_rows(table, key, vector)
    return rows.select("idx", "key"), hac_rows(rows)


def hac_edges(edges: DataFrame, n: int, linkage: str = "average") -> DataFrame:
    """Merge table from given distances: ``a`` < ``b`` (0..n-1) and ``dist``.

    For any other distance, and for single or complete linkage. Linkage runs over
    the known edges only: with a neighbour graph instead of all pairs the result
    is a forest. The spread columns hold 0, they need all pairs.
    """
    fold = {
        "average": (F.sum("s"), F.sum("n")),
        "single": (F.min("s"), F.lit(1).cast("long")),
        "complete": (F.max("s"), F.lit(1).cast("long")),
    }[linkage]
    links = cut_lineage(edges.select(
        F.col("a").cast("long"), F.col("b").cast("long"), F.col("dist").cast("double").alias("s"),
        F.lit(1).cast("long").alias("n"),
    ))
    steps: list[DataFrame] = []
    turn = 0
    spark = edges.sparkSession
    sizes = cut_lineage(spark.range(n).select(
        "id", F.col("id").alias("rep"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("h")))
    while not links.isEmpty():
        turn += 1
        d = F.round(F.col("s") / F.col("n"), 12)
        both = links.select(F.col("a").alias("id"), F.col("b").alias("o"), d.alias("d")).unionByName(
            links.select(F.col("b").alias("id"), F.col("a").alias("o"), d.alias("d")))
        nearest = both.groupBy("id").agg(F.min(F.struct("d", "o")).alias("m")).select(
            "id", F.col("m.o").alias("nn"), F.col("m.d").alias("dist"))
        state = nearest.join(sizes, "id").select(
            "id", "rep", "size", "h", F.lit(0.0).alias("spread"), "nn", "dist")
        new = cut_lineage(_merge_mutual(state, turn * n).filter("l IS NOT NULL"))
        renamed = new.select(F.explode(F.array("l", "r")).alias("old"), F.col("id").alias("new"))

        def follow(frame: DataFrame, side: str, other: str) -> DataFrame:
            return salted_join(
                frame, renamed.select(F.col("old").alias(side), F.col("new").alias("_new")), [side],
                spread=other, how="left",
            ).withColumn(side, F.coalesce("_new", side)).drop("_new")

        moved = follow(follow(links, "a", "b"), "b", "a").filter("a <> b")
        links = cut_lineage(
            moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", "n")
            .groupBy("a", "b").agg(fold[0].alias("s"), fold[1].alias("n"))
        )
        born = new.select("id", "rep", "size", "h")
        sizes = cut_lineage(sizes.join(renamed.select(F.col("old").alias("id")), "id", "left_anti").unionByName(born))
        steps.append(new.select("id", "l", "r", F.col("h").alias("height"), "size", F.lit(0.0).alias("spread"),
                                F.lit(0.0).alias("left_spread"), F.lit(0.0).alias("right_spread")))
    if not steps:
        return spark.createDataFrame([], MERGE_SCHEMA)
    return _number_merges(scan_many(steps), n)


def cut_tree(rows: DataFrame, merges: DataFrame, k: int) -> DataFrame:
    """(idx, key, cluster) at ``k`` clusters.

    Clusters are numbered in list order: single rows first, then merged ones by
    the time they were made. k = 0 gives NULL labels.
    """
    if k < 1:
        return rows.withColumn("cluster", F.lit(None).cast("int"))
    last = merges.count() + 1 - k
    done = merges.filter(F.col("rank") <= last)
    up = done.select(F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent"))
    everyone = rows.select(F.col("idx").alias("node")).unionByName(done.select("node"))
    tree = everyone.join(up, "node", "left").select(
        "node", F.coalesce("parent", "node").alias("parent"), F.lit(0).alias("step"))
    leaves = climb_to_roots(tree).join(rows.select(F.col("idx").alias("node"), "key"), "node")
    numbers = global_row_number(leaves.select("root").distinct(), ["root"], "cluster")
    return salted_join(leaves, numbers, ["root"], spread="node").select(
        F.col("node").alias("idx"), "key", F.col("cluster").cast("int").alias("cluster")
    )


def leaf_order(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """(idx, key, place): each leaf's place when the tree is walked left before right.

    A right child starts after its left sibling's rows; a leaf's place is the
    sum of such steps on its way up.
    """
    c = F.col
    sizes = merges.select(c("node").alias("left"), c("size").alias("left_size"))
    sized = merges.join(sizes, "left", "left").withColumn("left_size", F.coalesce("left_size", F.lit(1)))
    ups = sized.select(F.explode(F.array(
        F.struct(c("left").alias("node"), c("node").alias("parent"), F.lit(0).cast("long").alias("step")),
        F.struct(c("right").alias("node"), c("node").alias("parent"), c("left_size").cast("long").alias("step")),
    )).alias("e")).select("e.*")
    everyone = rows.select(c("idx").alias("node")).unionByName(merges.select("node"))
    tree = everyone.join(ups, "node", "left").select(
        "node", F.coalesce("parent", "node").alias("parent"), F.coalesce("step", F.lit(0)).alias("step"))
    return climb_to_roots(tree).join(rows.select(c("idx").alias("node"), "key"), "node").select(
        c("node").alias("idx"), "key", c("total").alias("place"))


def auto_cluster(
    table: DataFrame, key: str, vector: str, compat: bool = False
) -> DataFrame:
    """(key, clusterNumber) with K chosen just before the peak of the spread curve.

    ``compat`` keeps the unraised K: a peak at K = 1 then leaves no labels.
    """
    rows, merges = hac(table, key, vector)
    n = rows.count()
    if n < 2:
        k = n
    else:
        # the curve has N - 1 points; its peak is one number
        k = pick_k_peak(spread_by_k(merges, n), compat).first()["k"]
    return cut_tree(rows, merges, int(k)).select(
        F.col("key").alias(key), F.col("cluster").alias("clusterNumber")
    )
