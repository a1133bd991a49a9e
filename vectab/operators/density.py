"""Density clustering in the plane, as one-hop balls and with full expansion.

Identical points are first merged into one location with a weight. Locations
fall into grid cells so small that all points of a cell are within eps of each
other. A full cell (weight >= min_pts) is core without counting, and only
points of the other cells, of which there are fewer than min_pts per cell, look
at their surroundings. Nothing here forms all pairs of a crowded spot, and a
crowded cell is cut into parts for the joins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_2d
from ..plans.graph import connected_components, greedy_independent_set, greedy_rounds
from ..plans.scaling import cut_lineage, global_row_number, salted_join
from .spatial import around, cell_of

PART_ROWS = 4096  # locations of one cell that one join key may hold
DIRECT_PAIRS = 4096  # location pairs of two boxes that are compared one by one


@dataclass
class Ground:
    """Points with their location, the locations, and the cells with their part counts."""

    points: DataFrame  # key, pos, x, y, loc
    locs: DataFrame  # pos (first point there), x, y, w, cx, cy, part, core
    cells: DataFrame  # cx, cy, parts
    eps: float
    side: float


def near(probes: DataFrame, targets: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """(probe, pos, w) for each target location closer than ``eps`` to a probe."""
    looked = (
        probes.selectExpr("pos AS probe", "x AS px", "y AS py", "cx", "cy", "explode(sequence(-2, 2)) AS dx")
        .selectExpr("probe", "px", "py", "cx + dx AS cx", "cy", "explode(sequence(-2, 2)) AS dy")
        .selectExpr("probe", "px", "py", "cx", "cy + dy AS cy")
        .join(cells, ["cx", "cy"])
        .selectExpr("probe", "px", "py", "cx", "cy", "explode(sequence(0, parts - 1)) AS part")
    )
    met = looked.join(targets.select("pos", "w", "x", "y", "cx", "cy", "part"), ["cx", "cy", "part"])
    return met.where(f"hypot(x - px, y - py) < {float(eps)!r}D").select("probe", "pos", "w")


def lay_out(points: DataFrame, key: str, pos: str, eps: float, min_pts: int, x: str, y: str) -> Ground:
    side = eps / math.sqrt(2) * (1 - 1e-6)  # a shade smaller, so that rounding cannot matter
    plain = points.select(
        F.col(key).alias("key"), F.col(pos).alias("pos"),
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
    ).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    places = cut_lineage(
        plain.groupBy("x", "y").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("w"))
        .withColumn("cx", cell_of("x", side)).withColumn("cy", cell_of("y", side))
    )
    cells = cut_lineage(
        places.groupBy("cx", "cy").agg(
            F.sum("w").alias("cell_w"), F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")
        )
    )
    placed = cut_lineage(
        salted_join(places, cells, ["cx", "cy"], spread="pos")
        .withColumn("part", F.pmod(F.xxhash64("pos"), F.col("parts")).cast("int"))
        .withColumn("full", F.col("cell_w") >= min_pts).drop("parts", "cell_w")
    )
    cells = cells.select("cx", "cy", "parts")
    counted = (
        near(placed.filter("NOT full"), placed, cells, eps)
        .groupBy(F.col("probe").alias("pos")).agg(F.sum("w").alias("n"))
        .filter(F.col("n") >= min_pts).select("pos", F.lit(True).alias("_core"))
    )
    locs = cut_lineage(
        placed.join(counted, "pos", "left")
        .withColumn("core", F.col("full") | F.coalesce("_core", F.lit(False))).drop("_core", "full")
    )
    located = cut_lineage(
        salted_join(plain, locs.select("x", "y", F.col("pos").alias("loc")), ["x", "y"], spread="pos")
    )
    return Ground(located, locs, cells, eps, side)


def density_ball(
    points: DataFrame, key: str, pos: str, eps: float = 0.3, min_pts: int = 3, x: str = "x", y: str = "y"
) -> tuple[DataFrame, DataFrame]:
    """One-hop density clusters: (labels, members).

    A core point founds a cluster unless an earlier founder is within eps. A
    cluster's members are all points within eps of its founder, the founder
    first; a point's label is the latest such cluster, NULL if none. ``pos`` is
    unique and gives the order of the walk. ``labels``
    has key, pos, x, y, cluster; ``members`` has cluster, list_pos, key, pos, x, y.
    """
    ground = lay_out(points, key, pos, eps, min_pts, x, y)
    core = ground.locs.filter("core").select("pos", "x", "y", "w", "cx", "cy", "part")

    def conflicts(probes: DataFrame, undecided: DataFrame) -> DataFrame:
        return near(probes, undecided, ground.cells, eps)

    founders = global_row_number(greedy_rounds(core, conflicts, ["cx", "cy"]), ["pos"], "cluster")
    reach = cut_lineage(
        near(founders, ground.locs, ground.cells, eps)
        .join(founders.select(F.col("pos").alias("probe"), "cluster"), "probe")
        .select("cluster", F.col("probe").alias("founder"), F.col("pos").alias("loc"))
    )
    # founders lie at least eps apart, so few reach the same location
    members = salted_join(ground.points, reach, ["loc"], spread="pos").select(
        F.col("cluster").cast("int").alias("cluster"),
        F.when(F.col("pos") == F.col("founder"), F.lit(-1)).otherwise(F.col("pos")).alias("list_pos"),
        F.col("key").alias(key), "pos", "x", "y",
    )
    last = reach.groupBy("loc").agg(F.max("cluster").cast("int").alias("cluster"))
    labels = salted_join(ground.points, last, ["loc"], spread="pos", how="left").select(
        F.col("key").alias(key), "pos", "x", "y", "cluster"
    )
    return labels, members


def density_ball_edges(
    items: DataFrame, edges: DataFrame, min_pts: int = 3
) -> tuple[DataFrame, DataFrame]:
    """One-hop density clusters under any distance: (labels, members).

    ``items`` has ``pos``; ``edges`` has ``i``, ``j``: every pair the distance
    calls close, both ways and each item with itself.
    """
    close = cut_lineage(edges.select("i", "j"))
    core = close.groupBy(F.col("i").alias("pos")).agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_pts).select("pos")
    links = close.filter("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    founders = global_row_number(greedy_independent_set(core, links), ["pos"], "cluster")
    members = salted_join(close, founders.select(F.col("pos").alias("i"), "cluster"), ["i"], spread="j").select(
        F.col("cluster").cast("int").alias("cluster"),
        F.when(F.col("i") == F.col("j"), F.lit(-1)).otherwise(F.col("j")).alias("list_pos"),
        F.col("j").alias("pos"),
    )
    last = members.groupBy("pos").agg(F.max("cluster").alias("cluster"))
    return items.join(last, "pos", "left").select("pos", "cluster"), members


def _touching(cells_a: DataFrame, cells_b: DataFrame) -> DataFrame:
    """Pairs of different core cells at most two steps apart, each pair once."""
    a = (
        cells_a.select(*[F.col(c).alias(f"a_{c}") for c in cells_a.columns])
        .withColumn("dx", F.explode(around(2))).withColumn("dy", F.explode(around(2)))
        .filter("dx > 0 OR (dx = 0 AND dy > 0)")
        .withColumn("b_cx", F.col("a_cx") + F.col("dx")).withColumn("b_cy", F.col("a_cy") + F.col("dy"))
        .drop("dx", "dy")
    )
    b = cells_b.select(*[F.col(c).alias(f"b_{c}") for c in cells_b.columns])
    return a.join(b, ["b_cx", "b_cy"])


def _boxes(core: DataFrame, level: int, side: float) -> DataFrame:
    """Bounding boxes of the core locations in 4^level x 4^level parts of each cell."""
    parts = 4 ** level
    step = side / parts

    def sub(v: str, c: str):
        inside = F.floor((F.col(v) - F.col(c) * F.lit(side)) / F.lit(step))
        return F.greatest(F.lit(0), F.least(F.lit(parts - 1), inside)).cast("long")

    return (
        core.withColumn("bx", sub("x", "cx")).withColumn("by", sub("y", "cy"))
        .groupBy("cx", "cy", "bx", "by")
        .agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def cell_links(core: DataFrame, eps: float, side: float) -> DataFrame:
    """Pairs of core cells that hold two core points closer than ``eps``.

    Bounding boxes decide most pairs: linked when even the farthest corners are
    closer than eps, apart when even the nearest sides are not. Undecided boxes with
    few points are compared point by point, the others are cut finer. Only boxes
    along the border at distance eps stay undecided, so this does not grow with
    the square of a cell's points.
    """
    c = F.col
    ids = ["a_cx", "a_cy", "b_cx", "b_cy"]
    links = []
    level, open_pairs = 0, None
    while True:
        boxes = _boxes(core, level, side)
        if open_pairs is None:
            met = _touching(boxes, boxes)
        else:
            # children of the undecided parents
            def kids(s: str) -> DataFrame:
                named = boxes.select(*[c(n).alias(f"{s}_{n}") for n in boxes.columns])
                return named.withColumn(f"{s}_px", F.floor(c(f"{s}_bx") / 4).cast("long")).withColumn(
                    f"{s}_py", F.floor(c(f"{s}_by") / 4).cast("long"))
            met = open_pairs.join(kids("a"), ["a_cx", "a_cy", "a_px", "a_py"]).join(
                kids("b"), ["b_cx", "b_cy", "b_px", "b_py"])
        gap_x = F.greatest(F.lit(0.0), c("b_x0") - c("a_x1"), c("a_x0") - c("b_x1"))
        gap_y = F.greatest(F.lit(0.0), c("b_y0") - c("a_y1"), c("a_y0") - c("b_y1"))
        far_x = F.greatest(c("b_x1") - c("a_x0"), c("a_x1") - c("b_x0"))
        far_y = F.greatest(c("b_y1") - c("a_y0"), c("a_y1") - c("b_y0"))
        judged = cut_lineage(
            met.withColumn("near", F.hypot(gap_x, gap_y)).withColumn("far", F.hypot(far_x, far_y))
            .filter(c("near") < float(eps))
            .select(*ids, "a_bx", "a_by", "b_bx", "b_by", (c("far") < float(eps)).alias("sure"),
                    (c("a_n") * c("b_n") <= DIRECT_PAIRS).alias("small"))
        )
        sure = judged.filter("sure").select(*ids).distinct()
        links.append(sure)
        unsure = judged.filter("NOT sure").join(sure, ids, "left_anti")
        direct = _compare_points(unsure.filter("small"), core, level, eps, side)
        direct = cut_lineage(direct)
        links.append(direct)
        open_pairs = cut_lineage(
            unsure.filter("NOT small").join(direct, ids, "left_anti").select(
                *ids, c("a_bx").alias("a_px"), c("a_by").alias("a_py"),
                c("b_bx").alias("b_px"), c("b_by").alias("b_py"))
        )
        if open_pairs.isEmpty():
            break
        level += 1
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _compare_points(pairs: DataFrame, core: DataFrame, level: int, eps: float, side: float) -> DataFrame:
    """The cell pairs among ``pairs`` (small boxes) with two points closer than ``eps``."""
    parts, step = 4 ** level, side / 4 ** level

    def points(s: str) -> DataFrame:
        def sub(v: str, cell: str):
            inside = F.floor((F.col(v) - F.col(cell) * F.lit(side)) / F.lit(step))
            return F.greatest(F.lit(0), F.least(F.lit(parts - 1), inside)).cast("long")

        return core.select(
            F.col("cx").alias(f"{s}_cx"), F.col("cy").alias(f"{s}_cy"), sub("x", "cx").alias(f"{s}_bx"),
            sub("y", "cy").alias(f"{s}_by"), F.col("x").alias(f"{s}_x"), F.col("y").alias(f"{s}_y"),
        )

    met = pairs.join(points("a"), ["a_cx", "a_cy", "a_bx", "a_by"]).join(
        points("b"), ["b_cx", "b_cy", "b_bx", "b_by"])
    return met.filter(distance_2d("a_x", "a_y", "b_x", "b_y") < float(eps)).select(
        "a_cx", "a_cy", "b_cx", "b_cy").distinct()


def dbscan(
    points: DataFrame, key: str, pos: str, eps: float = 0.3, min_pts: int = 3,
    x: str = "x", y: str = "y", border: str = "first",
) -> DataFrame:
    """Density clusters with full expansion: key, pos, x, y, cluster (NULL is noise).

    Clusters are numbered by their first core point. A border point within
    reach of several clusters goes to the first of them, or with
    ``border='last'`` to the last.
    """
    ground = lay_out(points, key, pos, eps, min_pts, x, y)
    core = ground.locs.filter("core").select("pos", "x", "y", "w", "cx", "cy", "part")
    homes = cut_lineage(core.groupBy("cx", "cy").agg(F.min("pos").alias("node")))
    pairs = cell_links(core, eps, ground.side)
    a = homes.select(F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy"), F.col("node").alias("u"))
    b = homes.select(F.col("cx").alias("b_cx"), F.col("cy").alias("b_cy"), F.col("node").alias("v"))
    one_way = pairs.join(a, ["a_cx", "a_cy"]).join(b, ["b_cx", "b_cy"]).select("u", "v")
    edges = one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v")))
    comps = connected_components(homes.select("node"), edges)
    ranks = global_row_number(comps.select("component").distinct(), ["component"], "cluster")
    cell_cluster = cut_lineage(
        salted_join(homes.join(comps, "node"), ranks, ["component"], spread="node")
        .select("cx", "cy", F.col("cluster").cast("int").alias("cluster"))
    )
    core_label = salted_join(core, cell_cluster, ["cx", "cy"], spread="pos").select(
        F.col("pos").alias("loc"), "cluster", "cx", "cy"
    )
    pick = F.min if border == "first" else F.max
    rim = ground.locs.filter("NOT core")
    rim_label = (
        salted_join(
            near(rim, core, ground.cells, eps).select(F.col("probe"), F.col("pos").alias("loc")),
            core_label.select("loc", "cluster"), ["loc"], spread="probe",
        )
        .groupBy(F.col("probe").alias("loc")).agg(pick("cluster").alias("cluster"))
    )
    labels = core_label.select("loc", "cluster").unionByName(rim_label)
    return salted_join(ground.points, labels, ["loc"], spread="pos", how="left").select(
        F.col("key").alias(key), "pos", "x", "y", "cluster"
    )
