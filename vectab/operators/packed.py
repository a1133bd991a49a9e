"""Points packed along a Hilbert curve, with a box per file: windows and neighbours read few files."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import axis_distance
from ..sources.segments import SegmentLog
from .spatial import hilbert_value, knn_2d, point_boxes, window_query

FILE_ROWS = 1 << 18
MAX_FILES = 1 << 16  # files of a very large table hold more rows, so that a list of files stays small
NODES = "file int, min_x double, min_y double, max_x double, max_y double, n bigint"
BOX = ["min_x", "min_y", "max_x", "max_y"]


@dataclass
class Packed:
    """``points``: the saved columns and ``file``. ``nodes``: the box and the rows of every file."""

    points: DataFrame
    nodes: DataFrame
    x: str
    y: str


def save_packed(points: DataFrame, key: str, path: str, x: str = "x", y: str = "y", file_rows: int = FILE_ROWS) -> int:
    """Write the points in curve order, cut into files of about ``file_rows``, as a new version; its number.

    Points without a coordinate are in no window and near nothing: they are left out. Many points at one place
    are told apart by ``key``.
    """
    log = SegmentLog(points.sparkSession, path)
    there = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    rows = there.count()
    files = max(1, min(MAX_FILES, -(-rows // file_rows)))
    placed = hilbert_value(point_boxes(there, x, y)).drop(*BOX)
    cut = placed.repartitionByRange(files, "h", key).sortWithinPartitions("h", key).drop("h")
    folder = log.write(cut.withColumn("file", F.spark_partition_id()), "file")
    held = log.data(folder, T.StructType([*there.schema.fields, T.StructField("file", T.IntegerType())]))
    nodes = held.groupBy("file").agg(
        *[f(F.col(c).cast("double")).alias(f"{name}_{axis}") for name, f in (("min", F.min), ("max", F.max)) for c, axis in ((x, "x"), (y, "y"))],
        F.count(F.lit(1)).alias("n"))
    return log.commit({
        "points": folder, "nodes": log.write(nodes.select("file", *BOX, "n").coalesce(1)),
        "schema": held.schema.json(), "x": x, "y": y, "rows": rows,
    })


def open_packed(spark: SparkSession, path: str, version: int | None = None) -> Packed:
    log = SegmentLog(spark, path)
    state = log.read(version)
    if state is None:
        raise ValueError(f"no packed points at {path}")
    schema = T.StructType.fromJson(json.loads(state["schema"]))
    return Packed(log.data(state["points"], schema), log.data(state["nodes"], NODES), state["x"], state["y"])


def _files(packed: Packed, nodes: DataFrame) -> DataFrame:
    """The points of some files; a list of file numbers prunes the scan when it is planned."""
    wanted = [r["file"] for r in nodes.select("file").collect()]  # ``MAX_FILES`` at most
    return packed.points.filter(F.col("file").isin(wanted)).drop("file")


def window_packed(packed: Packed, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points inside a rectangle, bounds included: only files whose box meets it are read."""
    meet = (F.col("min_x") <= float(x1)) & (F.col("max_x") >= float(x0)) & (F.col("min_y") <= float(y1)) & (F.col("max_y") >= float(y0))
    return window_query(_files(packed, packed.nodes.filter(meet)), x0, y0, x1, y1, packed.x, packed.y)


def knn_packed(packed: Packed, qx: float, qy: float, key: str, limit: int, max_dist: float | None = None) -> DataFrame:
    """The ``limit`` points nearest to (qx, qy), with ``d2``, ties by key; optionally within ``max_dist``.

    Files are taken in the order of the distance to their boxes: the nearest ones that hold ``limit`` points give a
    bound, and only files whose box is within it can hold nearer points.
    """
    dx, dy = axis_distance(F.lit(float(qx)), "min_x", "max_x"), axis_distance(F.lit(float(qy)), "min_y", "max_y")
    nodes = packed.nodes.withColumn("away", dx * dx + dy * dy)
    if max_dist is not None:
        nodes = nodes.filter(F.col("away") <= float(max_dist) ** 2 * (1 + 1e-12))
    first, held = [], 0
    for r in nodes.orderBy("away", "file").limit(max(1, limit)).collect():  # a file holds one point at least
        first.append(r["file"])
        held += r["n"]
        if held >= limit:
            break
    found = knn_2d(_files(packed, nodes.filter(F.col("file").isin(first))), qx, qy, key, limit, max_dist, packed.x, packed.y)
    far = [r["d2"] for r in found.select("d2").collect()]  # ``limit`` at most
    if len(far) == limit:
        nodes = nodes.filter(F.col("away") <= max(far, default=0.0) * (1 + 1e-12))
    return knn_2d(_files(packed, nodes), qx, qy, key, limit, max_dist, packed.x, packed.y)
