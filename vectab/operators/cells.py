"""Cells in two levels: a coarse centre, and below each coarse centre its own fine centres.

A row belongs to its nearest coarse centre and, below it, to the nearest fine centre, so it is compared
with about twice the root of the number of cells. No task and no driver step holds the fine
centres of more than one coarse one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.scaling import cut_lineage, salted_join
from .blocks import TILE, matrix

PART_ROWS = 16384
FIT_ROWS = 256  # rows per centre that a fit looks at: centres only steer, every row is placed and measured after
MAX_COARSE_VALUES = 8_000_000  # numbers in the coarse centres, which every task holds
FIT_ROUNDS = 10
SLACK = 1e-6  # widens angle bounds, so that rounding never hides a row


@dataclass
class Centres:
    """``coarse``: unit rows, parent number by place. ``fine``: parent, cell (unique), centre (unit)."""

    coarse: np.ndarray
    fine: DataFrame


def nearest(u: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the nearest centre and the angle to it, some millions of scores at a time."""
    step = max(1, TILE // max(1, len(centres)))
    place, best = np.empty(len(u), dtype=np.int64), np.empty(len(u))
    for low in range(0, len(u), step):
        scores = u[low:low + step] @ centres.T
        place[low:low + step] = at = scores.argmax(axis=1)
        best[low:low + step] = scores[np.arange(len(at)), at]
    return place, np.arccos(np.clip(best, -1, 1))


def k_means(u: np.ndarray, k: int) -> np.ndarray:
    """Unit centres of unit rows by spherical k-means; the first different rows are the start."""
    _, first = np.unique(u, axis=0, return_index=True)
    centres = u[np.sort(first)[:k]]
    for _ in range(FIT_ROUNDS):
        place, _ = nearest(u, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, place, u)
        size = np.sqrt((sums * sums).sum(axis=1))
        new = centres.copy()
        new[size > 0] = sums[size > 0] / size[size > 0, None]
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def picked(rows: DataFrame, wanted: int, total: int, seed: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, those with the smallest hashes: the same whatever the partitions."""
    draw = F.xxhash64(F.lit(seed), "key")
    share = min(1.0, wanted / max(1, total))
    rows = rows.withColumn("draw", draw)
    return rows if share >= 1 else rows.filter(F.col("draw") <= F.lit(int(-(2**63) + share * (2**64 - 1))))


def fit_centres(rows: DataFrame, total: int, dims: int, n_cells: int, seed: int) -> Centres:
    """Centres for ``rows`` (key, u): the coarse ones in one task, the fine ones in a task per coarse one.

    A fit sees ``FIT_ROWS`` rows per centre, chosen by key hash. Coarse cells that the sample leaves empty get their
    own centre as the only fine one.
    """
    coarse = max(1, min(round(math.sqrt(n_cells)), MAX_COARSE_VALUES // max(1, dims)))
    below = -(-n_cells // coarse)

    def fit(k: int, first: int | None, schema: T.StructType) -> Callable[[pa.Table], pa.Table]:
        arrow = to_arrow_schema(schema)

        def run(group: pa.Table) -> pa.Table:
            u = matrix(group.sort_by("draw")["u"])
            parent = group["parent"][0].as_py()
            found = k_means(u, k)
            return pa.table([
                pa.array([parent] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()),
                pa.array(found.tolist(), pa.list_(pa.float64())),
            ], schema=arrow)

        return run

    schema = T.StructType.fromDDL("parent int, place int, centre array<double>")
    sample = picked(rows, FIT_ROWS * coarse, total, seed).select(F.lit(0).alias("parent"), "draw", "u")
    top = sample.groupBy("parent").applyInArrow(fit(coarse, None, schema), schema).orderBy("place").collect()  # bounded, see above
    centres = np.array([r["centre"] for r in top]).reshape(len(top), dims)
    order = Window.partitionBy("parent").orderBy("draw")
    near = with_parent(picked(rows, FIT_ROWS * n_cells, total, seed + 1).select("draw", "u"), centres)
    # a crowd below one coarse centre is fitted on as many rows as any other
    bounded = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= FIT_ROWS * below)
    fine = cut_lineage(bounded.select("parent", "draw", "u").groupBy("parent").applyInArrow(fit(below, None, schema), schema))
    filled = {r["parent"] for r in fine.select("parent").distinct().collect()}  # one number per coarse centre
    bare = [(p, 0, centres[p].tolist()) for p in range(len(centres)) if p not in filled]
    if bare:
        fine = fine.unionByName(rows.sparkSession.createDataFrame(bare, schema))
    return Centres(centres, fine.select("parent", (F.col("parent") * below + F.col("place")).alias("cell"), "centre"))


def with_parent(rows: DataFrame, coarse: np.ndarray, vector: str = "u") -> DataFrame:
    """``rows`` with ``parent``, the nearest coarse centre, and ``wide``, the angle to it."""
    shared = rows.sparkSession.sparkContext.broadcast(coarse)
    out = T.StructType([*rows.schema.fields, T.StructField("parent", T.IntegerType()), T.StructField("wide", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parent, angle = nearest(matrix(pa.Table.from_batches([batch])[vector]), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parent, pa.int32()), pa.array(angle)], schema=arrow)

    return rows.mapInArrow(run, out)


def place_rows(rows: DataFrame, centres: Centres) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, cells, parents) of ``rows`` that have a unit vector ``u`` and a ``key``.

    Entries get ``parent`` and ``cell``; a cell has its parent, number of rows n and reach, the largest angle of its
    rows to its centre; a parent has its reach to the coarse centre. Rows meet the fine centres of their own
    parent only, a crowded parent in several tasks.
    """
    near = cut_lineage(with_parent(rows, centres.coarse))
    parents = cut_lineage(near.groupBy("parent").agg(
        F.count(F.lit(1)).alias("n"), (F.max("wide") + F.lit(SLACK)).alias("reach")))
    shares = parents.select("parent", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("shares"))
    lefts = salted_join(near.drop("wide"), shares, ["parent"], spread="key").withColumn(
        "share", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int")).drop("shares")
    rights = centres.fine.join(shares, "parent").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    out = T.StructType([*lefts.drop("share").schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return arrow.empty_table()
        right = right.sort_by("cell")
        place, angle = nearest(matrix(left["u"]), matrix(right["centre"]))
        cell = right["cell"].combine_chunks().take(pa.array(place))
        return pa.table([*left.drop(["share"]).columns, cell, pa.array(angle)], schema=arrow)

    placed = cut_lineage(
        lefts.groupBy("parent", "share").cogroup(rights.select("parent", "share", "cell", "centre").groupBy("parent", "share"))
        .applyInArrow(run, out))
    cells = cut_lineage(placed.groupBy("parent", "cell").agg(
        F.count(F.lit(1)).alias("n"), (F.max("angle") + F.lit(SLACK)).alias("reach")))
    return placed.drop("angle"), cells, parents.drop("n")


def crowd(cell_rows: Column | str) -> Column:
    """Parts of a cell: one per ``PART_ROWS`` rows begun."""
    return F.greatest(F.lit(1), F.ceil((F.col(cell_rows) if isinstance(cell_rows, str) else cell_rows) / PART_ROWS)).cast("int")


def side_by_side(coarse: np.ndarray, rows: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(parent, first, parts): coarse cells that lie side by side share a group of up to ``most`` rows, a larger one is cut into parts.

    ``rows`` has the number of rows of each filled parent; groups are numbered from 0, parts from ``first`` on.
    """
    left, at, group, held, plan = sorted(rows), min(rows, default=0), 0, 0, []
    while left:
        left.remove(at)
        parts = max(1, -(-rows[at] // most))
        if held and held + rows[at] > most:
            group, held = group + 1, 0
        plan.append((at, group, parts))
        group, held = group + parts - 1, most if parts > 1 else held + rows[at]
        at = left[int((coarse[left] @ coarse[at]).argmax())] if left else at
    return plan
