"""Cell index over unit vectors: build, keep in step with its table, search and batch matching.

Rows belong to cells (see ``cells``). Each cell keeps the largest angle of its rows to the centre, so the
triangle inequality on angles bounds what a cell can still offer to a query: the exact search visits the cells that
can beat the current k-th score and no others. With ``n_probe`` only the nearest cells are visited, and
batch matching then compares two-bit codes first and vectors of a short list after.

A saved index is a log of immutable segments. Opening it compares the table's fingerprint with the saved one; rows that
came, changed or went since become a new segment and a list of removed rows, and many of these are merged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.quant import sbq_code, sbq_words
from ..functions.vector import dot, lit_vector, nonzero, unit
from ..plans.scaling import cut_lineage, salted_join
from ..sources.segments import SegmentLog
from .blocks import BLOCK_VALUES, SCORE_DIGITS, TILE, best_k, best_one, emit, matrix, rank_best, run_blocks
from .cells import PART_ROWS, SLACK, Centres, crowd, fit_centres, place_rows, side_by_side
from .search import attach_matches
from .stats import sbq_fit

MAX_SEGMENTS = 8  # more are merged into one
REMOVED_SHARE = 0.25  # so are segments of which a larger share has been removed
REFIT_GROWTH = 4  # centres are fitted anew for a table that has grown this much since
BROADCAST_VALUES = 1 << 21  # numbers of an indexed side that every task may hold: 16 MB
SHORTLIST = 64  # rows per left row whose vectors are compared after the codes


@dataclass
class CellIndex:
    """``entries``: key, h (hash of key and vector), u (unit vector), code, parent, cell. ``cells``: parent, cell, n,
    reach. ``parents``: parent, reach. ``mean`` and ``std`` are those of the codes, ``state`` what is saved."""

    entries: DataFrame
    cells: DataFrame
    parents: DataFrame
    centres: Centres
    mean: list[float]
    std: list[float]
    state: dict


def keyed_rows(table: DataFrame, key: str, vector: str) -> DataFrame:
    """The rows an index holds: key, h, u. Rows without a direction are left out."""
    wide = F.col(vector).cast("array<double>")
    return table.filter(nonzero(vector)).select(F.col(key).alias("key"), F.xxhash64(key, wide).alias("h"), unit(vector).alias("u"))


def fingerprint(rows: DataFrame) -> tuple[int, str]:
    """Row count and sum of the row hashes: equal for equal rows in any order, one pass without a shuffle."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s")).first()
    return found["n"], str(found["s"] or 0)


def coded(rows: DataFrame, mean: list[float], std: list[float], vector: str = "u", name: str = "code") -> DataFrame:
    return rows.withColumn(name, sbq_words(sbq_code(vector, mean, std), len(mean)))


def ann_build(
    table: DataFrame, key: str, vector: str, n_cells: int | None = None, seed: int = 42, centres: Centres | None = None,
) -> CellIndex:
    """Fit centres unless given, place every row, measure each cell's reach.

    The number of cells is sqrt(rows) unless given; a few more or less come out, as every coarse centre
    gets equally many. The fit looks at a bounded number of rows per centre.
    """
    rows = cut_lineage(keyed_rows(table, key, vector))
    n, total = fingerprint(rows)
    if n == 0:
        raise ValueError("no rows with a vector to index")
    dims = rows.select(F.size("u").alias("d")).first()["d"]
    if centres is None:
        centres = fit_centres(rows, n, dims, min(n, n_cells or max(1, round(math.sqrt(n)))), seed)
    mean, std = sbq_fit(rows, "u")
    entries, cells, parents = place_rows(coded(rows, mean, std), centres)
    state = {"rows": n, "hashes": total, "fit_rows": n, "dims": dims, "source": None, "key": rows.schema["key"].dataType.simpleString()}
    return CellIndex(entries, cells, parents, centres, mean, std, state)


def _segment(log: SegmentLog, entries: DataFrame, cells: DataFrame, parents: DataFrame) -> dict:
    """Write the folders of a segment; the rows lie by parent, in the order of their cells."""
    laid = entries.select("key", "h", "u", "code", "cell", "parent")
    laid = laid.repartition("parent", F.pmod(F.col("cell"), F.lit(8))).sortWithinPartitions("parent", "cell")
    return {
        "entries": log.write(laid, "parent"), "cells": log.write(cells.select("parent", "cell", "n", "reach").coalesce(1)),
        "parents": log.write(parents.select("parent", "reach").coalesce(1)), "rows": cells.agg(F.sum("n")).first()[0] or 0,
    }


def ann_save(index: CellIndex, path: str) -> int:
    """Write the index as a new version of the log at ``path``; its number."""
    spark = index.entries.sparkSession
    log = SegmentLog(spark, path)
    coarse = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centres.coarse)], "parent int, centre array<double>")
    return log.commit({
        **index.state, "mean": index.mean, "std": index.std, "coarse": log.write(coarse.coalesce(1)),
        "fine": log.write(index.centres.fine.select("parent", "cell", "centre")),
        "segments": [_segment(log, index.entries, index.cells, index.parents)], "removed": [],
    })


def ann_exists(spark: SparkSession, path: str) -> bool:
    return bool(SegmentLog(spark, path).versions())


def ann_load(spark: SparkSession, path: str, version: int | None = None) -> CellIndex:
    """A saved index as it was at a version, by default the last one: all segments less the rows removed after them."""
    log = SegmentLog(spark, path)
    state = log.read(version)
    if state is None:
        raise ValueError(f"no index at {path}")
    kind, live, removed = state["key"], [], state["removed"]
    for number, segment in enumerate(state["segments"]):
        part = log.data(segment["entries"], f"key {kind}, h bigint, u array<double>, code array<bigint>, cell int, parent int")
        later = [log.data(r["keys"], f"key {kind}, h bigint").select(F.col("key").alias("gone"), F.col("h").alias("gone_h"))
                 for r in removed if r["before"] > number]
        if later:
            gone = reduce(DataFrame.union, later)
            part = part.join(gone, F.col("key").eqNullSafe(F.col("gone")) & (F.col("h") == F.col("gone_h")), "left_anti")
        live.append(part)

    def measured(name: str, by: list[str], schema: str, *sums: Column) -> DataFrame:
        parts = [log.data(s[name], schema) for s in state["segments"]]
        if len(parts) == 1:
            return parts[0]
        # removed rows are still counted: a reach may be too wide, never too narrow
        return cut_lineage(reduce(DataFrame.union, parts).groupBy(*by).agg(*sums, F.max("reach").alias("reach")))

    top = log.data(state["coarse"], "parent int, centre array<double>").orderBy("parent").collect()  # bounded by the fit
    return CellIndex(
        reduce(DataFrame.union, live),
        measured("cells", ["parent", "cell"], "parent int, cell int, n bigint, reach double", F.sum("n").alias("n")),
        measured("parents", ["parent"], "parent int, reach double"),
        Centres(np.array([r["centre"] for r in top]), log.data(state["fine"], "parent int, cell int, centre array<double>")),
        state["mean"], state["std"], state,
    )


def ann_open(table: DataFrame, key: str, vector: str, path: str, source: str | None = None, n_cells: int | None = None) -> CellIndex:
    """The saved index, brought in step with the table first; built when there is none.

    ``source`` may name the table's state, such as its folder and version; an index saved under the same name is
    taken without a look at the table. Otherwise one pass takes the table's fingerprint, and only if it differs keys and hashes
    of both sides are compared: new and changed rows are placed into the existing cells as a
    new segment, changed and deleted ones are listed as removed. A table that has grown ``REFIT_GROWTH`` times
    since its centres were fitted, or whose vectors have another dimension, is indexed anew.
    """
    spark = table.sparkSession
    log = SegmentLog(spark, path)
    state = log.read()
    if state is not None and source is not None and state["source"] == source:
        return ann_load(spark, path)
    rows = keyed_rows(table, key, vector)
    n, total = fingerprint(rows)
    kind = rows.schema["key"].dataType.simpleString()
    if state is not None and (state["rows"], state["hashes"], state["key"]) == (n, total, kind):
        if state["source"] != source:
            log.commit({**state, "source": source})
        return ann_load(spark, path)
    if n == 0 and state is None:
        raise ValueError("no rows with a vector to index")
    widths = rows.agg(F.max(F.size("u")).alias("w")).first()["w"]
    stale = state is None or state["key"] != kind or n > REFIT_GROWTH * state["fit_rows"] or (n and widths != state["dims"])
    if stale:
        index = ann_build(table, key, vector, n_cells)
        index.state["source"] = source
        ann_save(index, path)
        return ann_load(spark, path)
    state = {**state, **_changes(log, ann_load(spark, path), rows), "rows": n, "hashes": total, "source": source}
    log.commit(state)
    held, gone = (sum(x["rows"] for x in state[name]) for name in ("segments", "removed"))
    if len(state["segments"]) > MAX_SEGMENTS or gone > REMOVED_SHARE * held:
        ann_compact(spark, path)
    return ann_load(spark, path)


def _changes(log: SegmentLog, index: CellIndex, rows: DataFrame) -> dict:
    """Segments and removals of the state that follows: keys and hashes alone tell what has changed."""
    state = index.state
    now = rows.groupBy("key", "h").agg(F.count(F.lit(1)).alias("now"))
    was = index.entries.groupBy("key", "h").agg(F.count(F.lit(1)).alias("was")).withColumnsRenamed({"key": "old", "h": "old_h"})
    both = now.join(was, F.col("key").eqNullSafe(F.col("old")) & (F.col("h") == F.col("old_h")), "full_outer")
    diff = cut_lineage(both.filter(~F.col("now").eqNullSafe(F.col("was"))))
    gone = diff.filter("was IS NOT NULL").select(F.col("old").alias("key"), F.col("old_h").alias("h"), "was")
    wanted = diff.filter("now IS NOT NULL").select(F.col("key").alias("new"), F.col("h").alias("new_h"))
    fresh = rows.join(wanted, F.col("key").eqNullSafe(F.col("new")) & (F.col("h") == F.col("new_h")), "left_semi")
    segments, removed = list(state["segments"]), list(state["removed"])
    n_gone = gone.agg(F.sum("was")).first()[0]
    if n_gone:
        removed.append({"keys": log.write(gone.select("key", "h")), "before": len(segments), "rows": n_gone})
    if not wanted.isEmpty():
        segments.append(_segment(log, *place_rows(coded(fresh, index.mean, index.std), index.centres)))
    return {"segments": segments, "removed": removed}


def ann_compact(spark: SparkSession, path: str) -> int:
    """Merge all live rows into one segment, under the same centres, as a new version; its number."""
    log, index = SegmentLog(spark, path), ann_load(spark, path)
    placed = place_rows(index.entries.select("key", "h", "u", "code"), index.centres)
    return log.commit({**index.state, "segments": [_segment(log, *placed)], "removed": []})


def search_ann(
    index: CellIndex, query: Sequence[float], k: int = 10, n_probe: int = 4, exact: bool = True
) -> DataFrame:
    """(key, score) of the k rows most similar to the query.

    The nearest cells give a first k-th score; then only cells that can beat it
    are read. The cells' parents prune the folders of a saved index.
    """
    q = np.asarray(query, dtype=np.float64)
    size = np.linalg.norm(q)
    if size == 0:
        raise ValueError("the query vector has length zero")
    direction = lit_vector(q / size)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("centre", direction))))
    cells = index.cells.join(index.centres.fine, ["parent", "cell"]).select("parent", "cell", "reach", angle.alias("angle"))
    score = F.round(dot("u", direction), SCORE_DIGITS)

    def best(entries: DataFrame) -> DataFrame:
        return entries.select("key", score.alias("score")).orderBy(F.col("score").desc(), "key").limit(k)

    near = cells.orderBy("angle", "cell").limit(n_probe).collect()
    first = best(index.entries.filter(
        F.col("parent").isin([r["parent"] for r in near]) & F.col("cell").isin([r["cell"] for r in near])))
    if not exact:
        return first
    found = first.collect()  # at most k rows
    if len(found) < k:
        return best(index.entries)
    bound = math.acos(max(-1.0, min(1.0, found[-1]["score"]))) + SLACK
    open_cells = cells.filter(F.col("angle") - F.col("reach") <= bound).select("parent", "cell")
    return best(index.entries.join(open_cells, ["parent", "cell"], "left_semi"))


def _doors(index: CellIndex, rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest parents of each row (l_key, l_vec)."""

    def pick(table: pa.Table, angles: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return best_k(-angles, most)

    return _picked_by_angle(index, rows, "parent", pick)


def _block_doors(index: CellIndex, rows: DataFrame, plan: list[tuple[int, int, int]], scored: bool) -> DataFrame:
    """Blocks that each row has to enter: those of its nearest parent, or with ``scored`` rows all others that can beat their score."""
    first, parts = np.zeros((2, len(index.centres.coarse)), dtype=np.int64)
    for parent, at, n in plan:
        first[parent], parts[parent] = at, n
    n_blocks = max(1, int((first + parts).max()))

    def blocks(i: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Row and block as one number; a row enters a block once, however many parents it has there."""
        n = parts[parent]
        along = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(np.repeat(i * n_blocks + first[parent], n) + along)

    def pick(table: pa.Table, angles: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        into = blocks(np.arange(len(angles)), angles.argmin(axis=1))
        if scored:
            bound = np.arccos(np.clip(table["score"].fill_null(-1.0).to_numpy(), -1, 1)) + SLACK
            into = np.setdiff1d(blocks(*np.nonzero(angles - reach <= bound[:, None])), into, assume_unique=True)
        return np.divmod(into, n_blocks)

    return _picked_by_angle(index, rows, "block", pick)


def _picked_by_angle(index: CellIndex, rows: DataFrame, name: str, pick: Callable) -> DataFrame:
    """Rows as often as ``pick`` has them, with the numbers it gives them; it sees their angles to the coarse centres and the reaches."""
    reach = np.full(len(index.centres.coarse), -np.inf)
    for r in index.parents.collect():  # one row per coarse centre, bounded by the fit
        reach[r["parent"]] = r["reach"]
    shared = rows.sparkSession.sparkContext.broadcast((index.centres.coarse, reach))
    out = T.StructType([*rows.schema.fields, T.StructField(name, T.IntegerType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, reach = shared.value
        for batch in batches:
            step = max(1, TILE // len(coarse))
            for part in (batch.slice(low, step) for low in range(0, batch.num_rows, step)):
                table = pa.Table.from_batches([part])
                angles = np.arccos(np.clip(matrix(table["l_vec"]) @ coarse.T, -1, 1))
                angles[:, np.isinf(reach)] = np.inf
                i, number = pick(table, angles, reach)
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns), pa.array(number, pa.int32())], schema=arrow)

    return rows.mapInArrow(run, out)


def nearest_cells(index: CellIndex, rows: DataFrame, most: int, with_vector: bool = True) -> DataFrame:
    """The ``most`` nearest cells of each row. Adds parent, cell, away.

    Every visit carries the row's vector, unless ``with_vector`` is false.
    """
    at_doors = cut_lineage(_doors(index, rows, most))
    load = at_doors.groupBy("parent").agg(crowd(F.count(F.lit(1))).alias("shares"))
    lefts = salted_join(at_doors, load, ["parent"], spread="l_key").withColumn(
        "share", F.pmod(F.xxhash64("l_key"), F.col("shares")).cast("int")).drop("shares")
    cells = index.cells.join(index.centres.fine, ["parent", "cell"]).join(load, "parent")
    rights = cells.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("parent", "share", "cell", "centre")
    left_out = ["share"] if with_vector else ["share", "l_vec"]
    out = T.StructType([*lefts.drop(*left_out).schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return arrow.empty_table()
        right = right.sort_by("cell")
        centres, vectors = matrix(right["centre"]), matrix(left["l_vec"])
        step, parts = max(1, TILE // len(centres)), []
        for low in range(0, len(vectors), step):
            angles = np.arccos(np.clip(vectors[low:low + step] @ centres.T, -1, 1))
            i, j = best_k(-angles, most)
            parts.append((i + low, j, angles[i, j]))
        i, j, away = (np.concatenate(p) for p in zip(*parts))
        kept = left.drop(left_out).take(pa.array(i))
        return pa.table([*kept.columns, right["cell"].combine_chunks().take(pa.array(j)), pa.array(away)], schema=arrow)

    found = lefts.groupBy("parent", "share").cogroup(rights.groupBy("parent", "share")).applyInArrow(run, out)
    nearest = Window.partitionBy("l_key").orderBy("away", "cell")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= most).drop("rank")


def _against(index: CellIndex, visits: DataFrame, left: str, right: str, run: Callable, out: T.StructType) -> DataFrame:
    """``run`` on the visitors and rows of each cell. Both sides of a cell are cut: rows into parts, visitors into shares."""
    load = visits.groupBy("cell").agg(crowd(F.count(F.lit(1))).alias("shares"))
    plan = index.cells.select("cell", crowd("n").alias("parts")).join(load, "cell")
    lefts = (
        salted_join(visits.select("l_key", left, "cell"), plan, ["cell"], spread="l_key")
        .withColumn("share", F.pmod(F.xxhash64("l_key"), F.col("shares")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("l_key", left, "cell", "part", "share")
    )
    rows = index.entries.select(F.col("key").alias("r_key"), F.col(right).alias(f"r{left[1:]}"), "cell")
    rights = (
        salted_join(rows, plan, ["cell"], spread="r_key")
        .withColumn("part", F.pmod(F.xxhash64("r_key"), F.col("parts")).cast("int"))
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .select("r_key", f"r{left[1:]}", "cell", "part", "share")
    )
    return run_blocks(lefts, rights, ["cell", "part", "share"], run, out)


def _in_blocks(index: CellIndex, visits: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """The best row for each visitor (l_key, l_vec, score or null) in a block: (l_key, r_key, score).

    A block holds whole coarse cells, or part of a crowded one. The visitor goes there once; the cells that can beat its score are
    found and compared inside. Many visitors come in shares, as large as the block, so that it is not copied more than they are.
    """
    blocks = F.broadcast(visits.sparkSession.createDataFrame(plan, "parent int, first int, parts int"))
    places = F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)
    rows = index.entries.join(blocks, "parent").select(
        (F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int").alias("block"),
        F.col("key").alias("r_key"), F.col("u").alias("r_vec"), "cell", F.lit(None).cast("double").alias("reach"))
    cells = index.cells.join(index.centres.fine, ["parent", "cell"]).join(blocks, "parent").select(
        F.explode(places).alias("block"), F.lit(None).cast(rows.schema["r_key"].dataType).alias("r_key"),
        F.col("centre").alias("r_vec"), "cell", "reach")
    size = rows.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    load = F.broadcast(cut_lineage(visits.groupBy("block").agg(F.count(F.lit(1)).alias("n")).join(size, "block").select(
        "block", F.ceil(F.col("n") / F.greatest(F.lit(PART_ROWS), "size")).cast("int").alias("shares"))))
    lefts = visits.join(load, "block").withColumn("share", F.pmod(F.xxhash64("l_key"), F.col("shares")).cast("int")).drop("shares")
    rights = rows.unionByName(cells).join(load, "block").withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return run_blocks(lefts, rights, ["block", "share"], *block_kernel(lefts.schema["l_key"].dataType, rows.schema["r_key"].dataType))


def block_kernel(l_type: T.DataType, r_type: T.DataType) -> tuple[Callable, T.StructType]:
    """The best row of a block for each left one, ties by smaller key. Right rows with a reach are the cells, with their centres."""
    out = T.StructType([
        T.StructField("l_key", l_type), T.StructField("r_key", r_type), T.StructField("score", T.DoubleType()),
    ])
    arrow = to_arrow_schema(out)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cells = right.filter(pc.is_valid(right["reach"])).sort_by("cell")
        right = right.filter(pc.is_null(right["reach"])).sort_by("r_key")
        if not len(left) or not len(right):
            return arrow.empty_table()
        a, b, centres = matrix(left["l_vec"]), matrix(right["r_vec"]), matrix(cells["r_vec"])
        reach, numbers = cells["reach"].to_numpy(), cells["cell"].to_numpy()
        place = np.searchsorted(numbers, right["cell"].to_numpy())
        order = np.argsort(place, kind="stable")
        members = np.split(order, np.searchsorted(place[order], np.arange(1, len(numbers))))
        filled = [c for c, own in enumerate(members) if len(own)]
        known = left["score"].fill_null(-1.0).to_numpy()
        best, hit = np.full(len(a), -np.inf), np.full(len(a), len(b))

        def visit(cell: int, rows: np.ndarray) -> None:
            own = members[cell]
            step = max(1, TILE // len(own))
            for some in (rows[low:low + step] for low in range(0, len(rows), step)):
                scores = a[some] @ b[own].T
                i, j = best_one(scores)
                score, at, to = np.round(scores[i, j], SCORE_DIGITS), some[i], own[j]
                won = (score > best[at]) | ((score == best[at]) & (to < hit[at]))
                best[at[won]], hit[at[won]] = score[won], to[won]

        step = max(1, TILE // len(centres))
        for low in range(0, len(a), step):
            angles = np.full((len(a[low:low + step]), len(centres)), np.inf)
            angles[:, filled] = np.arccos(np.clip(a[low:low + step] @ centres[filled].T, -1, 1))
            near = angles.argmin(axis=1)
            bound = np.arccos(np.clip(known[low:low + step], -1, 1)) + SLACK
            open_ = angles - reach <= bound[:, None]
            for cell in filled:
                visit(cell, low + np.flatnonzero((near == cell) & open_[:, cell]))
            bound = np.minimum(bound, np.arccos(np.clip(best[low:low + step], -1, 1)) + SLACK)
            open_ = angles - reach <= bound[:, None]
            for cell in filled:
                visit(cell, low + np.flatnonzero((near != cell) & open_[:, cell]))
        found = np.flatnonzero(hit < len(b))
        return emit(left, right, [(found, hit[found], best[found])], arrow)

    return run, out


def code_kernel(l_type: T.DataType, r_type: T.DataType, k: int) -> tuple[Callable, T.StructType]:
    """The k rows of a block whose codes differ least from each left code; score = -distance, ties by smaller key."""
    out = T.StructType([
        T.StructField("l_key", l_type), T.StructField("r_key", r_type), T.StructField("score", T.DoubleType()),
    ])
    arrow = to_arrow_schema(out)

    def words(column: pa.ChunkedArray) -> np.ndarray:
        lists = column.combine_chunks()
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return arrow.empty_table()
        right = right.sort_by("r_key")
        a, b = words(left["l_code"]), words(right["r_code"])
        step, pieces = max(1, TILE // len(b)), []
        for low in range(0, len(a), step):
            part = a[low:low + step]
            far = sum(np.bitwise_count(part[:, w, None] ^ b[None, :, w]).astype(np.float32) for w in range(a.shape[1]))
            i, j = best_k(-far, k)
            pieces.append((i + low, j, -far[i, j].astype(np.float64)))
        return emit(left, right, pieces, arrow)

    return run, out


def match_ann(
    left: DataFrame, index: CellIndex, key: str, vector: str, n_probe: int | None = None, shortlist: int = SHORTLIST
) -> DataFrame:
    """For each left row its most similar indexed row: (key, hit_key, _raw).

    Exact without ``n_probe``: round one compares a row with what can win in the block of its nearest coarse cell;
    round two visits the other blocks that can still beat it, each once. With ``n_probe`` each row visits that many cells; there
    only keys and codes are read, and the vectors of its ``shortlist`` best codes are compared after, so
    the work per row is bounded and a better row elsewhere may be missed.
    """
    rows = cut_lineage(
        left.filter(nonzero(vector)).select(F.col(key).alias("l_key"), unit(vector).alias("l_vec"))
    )
    key_type, hit_type = rows.schema["l_key"].dataType, index.entries.schema["key"].dataType
    if n_probe is None:
        filled = {r["parent"]: r["n"] for r in index.cells.groupBy("parent").agg(F.sum("n").alias("n")).collect()}  # per coarse centre
        plan = side_by_side(index.centres.coarse, filled, max(1, BLOCK_VALUES // index.state["dims"]))
        first = cut_lineage(_block_doors(index, rows.withColumn("score", F.lit(None).cast("double")), plan, False))
        known = hits = cut_lineage(rank_best(_in_blocks(index, first, plan), 1).drop("rank"))
        if any(at + parts > 1 for _, at, parts in plan):
            # a block whose rows were all removed gives no score
            more = cut_lineage(_block_doors(index, rows.join(known.select("l_key", "score"), "l_key", "left"), plan, True))
            hits = known.unionByName(_in_blocks(index, more, plan)) if not more.isEmpty() else known
    else:
        asked = coded(rows, index.mean, index.std, "l_vec", "l_code")
        visits = cut_lineage(nearest_cells(index, asked, n_probe, with_vector=False))
        codes = _against(index, visits, "l_code", "code", *code_kernel(key_type, hit_type, shortlist))
        vectors = index.entries.select(F.col("key").alias("r_key"), F.col("u").alias("r_vec"))
        if index.state["rows"] * index.state["dims"] <= BROADCAST_VALUES:
            vectors = F.broadcast(vectors)
        # the short lists lie by left key already: no pair is shuffled with a vector, if the right side is small
        listed = rank_best(codes, shortlist).select("l_key", "r_key").join(rows, "l_key")
        hits = listed.join(vectors, "r_key").select(
            "l_key", "r_key", F.round(dot("l_vec", "r_vec"), SCORE_DIGITS).alias("score"))
    return rank_best(hits, 1).select(
        F.col("l_key").alias(key), F.col("r_key").alias("hit_key"), F.col("score").alias("_raw")
    )


def compare_ann(
    left: DataFrame, right: DataFrame, key: str, vector: str, right_key: str, path: str,
    n_probe: int | None = None, source: str | None = None,
) -> DataFrame:
    """Best-match table through the index of the right side, built or brought in step first.

    An empty side gives an empty result, checked before the index is touched.
    """
    if left.isEmpty() or right.isEmpty():
        hits = left.limit(0).select(
            key, F.lit(None).cast(right.schema[right_key].dataType).alias("hit_key"),
            F.lit(None).cast("double").alias("_raw"),
        )
    else:
        hits = match_ann(left, ann_open(right, right_key, vector, path, source), key, vector, n_probe)
    return attach_matches(hits, left, right, key, vector, right_key)
