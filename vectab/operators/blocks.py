"""Exact similarity joins of two vector tables, block by block.

Both sides are cut into blocks of bounded size by a hash of the key (so no
block grows with a hot value), every row is copied to the block pairs it takes
part in, and one task multiplies one block pair and keeps only what the result
needs: the k best per left row, or the pairs above a bound. Pairs that are not
in the result never leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import nonzero

BLOCK_ROWS = 98304
BLOCK_VALUES = 64 * BLOCK_ROWS  # numbers in a block of wider vectors: 48 MB
TASK_PAIRS = 1 << 22  # fewer are not worth a task
TILE = 1 << 22  # scores held at once inside a task
HIT_TILE = 1 << 20  # the same where all of them may be hits
SLAB, STRIP = 512, 1024  # rows and columns of a float32 tile that stays in a core's cache
OFF = -4.0
SLICE = 512  # rows of a block that meet its rest, where it meets itself
GROUP = 64  # columns whose best score stands for them while the k best are looked for
# Scores are rounded before ranking, so the order in which a sum of floats ran
# never decides a rank.
SCORE_DIGITS = 12
METRICS = ("cosine", "dot", "euclidean")


def keyed_vectors(df: DataFrame, key: str, vector: str, side: str) -> DataFrame:
    """(key, vector) under the names the kernels read; missing and zero vectors left out."""
    return df.filter(nonzero(vector)).select(F.col(key).alias(f"{side}_key"), F.col(vector).alias(f"{side}_vec"))


def row_bound(table: DataFrame) -> int:
    """Rows before missing vectors are left out: block planning needs no more, and no vector is read for it."""
    return table.count()


def raw_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix of its own number type."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):  # older Arrow keeps one chunk wrapped
        lists = lists.chunk(0)
    sizes = pc.unique(pc.list_value_length(lists)).to_pylist()
    if len(sizes) != 1:
        raise ValueError(f"vectors of different dimensions in one comparison: {sizes}")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), sizes[0])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    return raw_matrix(column).astype(np.float64)


def score_tiles(left: pa.Table, right: pa.Table, metric: str, exclude_same: bool, tile: int = TILE, rounded: bool = True):
    """Yield (first left row, score matrix); right rows are sorted by key."""
    a, b = matrix(left["l_vec"]), matrix(right["r_vec"])
    if a.shape[1] != b.shape[1]:
        raise ValueError(f"vectors of different dimensions: {a.shape[1]} and {b.shape[1]}")
    if metric != "dot":
        norm_a, norm_b = (np.concatenate([np.sqrt((part * part).sum(axis=1)) for part in np.array_split(v, 16)]) for v in (a, b))
    same = None
    if exclude_same:
        same = pc.index_in(left["l_key"].combine_chunks(), right["r_key"].combine_chunks())
        same = pc.fill_null(same, -1).to_numpy(zero_copy_only=False)
    step = max(1, tile // len(b))
    for start in range(0, len(a), step):
        scores = a[start:start + step] @ b.T
        if metric == "cosine":
            scores /= norm_a[start:start + step, None] * norm_b[None, :]
        elif metric == "euclidean":  # similarity 1 / (1 + distance)
            squares = norm_a[start:start + step, None] ** 2 + norm_b[None, :] ** 2 - 2 * scores
            scores = 1 / (1 + np.sqrt(np.maximum(squares, 0)))
        if rounded:
            np.round(scores, SCORE_DIGITS, out=scores)
        if same is not None:
            rows = np.flatnonzero(same[start:start + step] >= 0)
            scores[rows, same[start:start + step][rows]] = -np.inf
        yield start, scores


def best_k(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best per row, the earlier column on ties.

    A score that is no finite number never wins a place.
    """
    scores = np.where(np.isfinite(scores), scores, -np.inf)
    if k == 1:
        columns = scores.argmax(axis=1)
        rows = np.arange(len(scores))
    elif k >= scores.shape[1]:
        rows, columns = np.indices(scores.shape).reshape(2, -1)
    else:
        bound = np.partition(scores, -k, axis=1)[:, -k][:, None]
        above, level = scores > bound, scores == bound
        room = k - above.sum(axis=1, keepdims=True)
        rows, columns = np.nonzero(above | (level & (np.cumsum(level, axis=1) <= room)))
    keep = np.isfinite(scores[rows, columns])
    return rows[keep], columns[keep]


def best_one(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_k`` with k = 1 of scores that are yet to be rounded: only rows with close rivals are."""
    columns, rows = scores.argmax(axis=1), np.arange(len(scores))
    most = scores[rows, columns]
    close = ~np.isfinite(most)
    close[~close] = np.count_nonzero(scores[~close] >= (most[~close] - 2 * 10.0**-SCORE_DIGITS)[:, None], axis=1) > 1
    if not close.any():
        return rows, columns
    again = np.flatnonzero(close)
    i, j = best_k(np.round(scores[again], SCORE_DIGITS), 1)
    rows = np.concatenate([rows[~close], again[i]])
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate([columns[~close], j])[order]


def best_few(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``best_k`` of scores that are yet to be rounded: only those that can be among the k best are, and are ranked.

    The columns are dealt to groups of at most ``GROUP``. The k-th largest of the groups' best is reached by k scores, so
    nothing clearly below it wins a place. Rows with odd scores, or too many close ones, go through ``best_k``.
    """
    n = scores.shape[1]
    groups = -(-n // GROUP)
    if groups < 4 * k:
        return best_k(np.round(scores, SCORE_DIGITS), k)
    most = scores[:, :groups].copy()
    for start in range(groups, n, groups):
        part = scores[:, start:start + groups]
        np.maximum(most[:, :part.shape[1]], part, out=most[:, :part.shape[1]])
    usual = (np.abs(most) < 1e200).all(axis=1)  # neither missing nor infinite, before or after rounding
    bound = np.partition(most, -k, axis=1)[:, -k]
    bound[~usual] = 0
    bound -= 2 * 10.0**-SCORE_DIGITS + 1e-14 * np.abs(bound)  # what rounding may move
    near = scores >= bound[:, None]
    usual &= np.count_nonzero(near, axis=1) <= max(n // 16, k)
    near[~usual] = False
    rows, columns = np.divmod(np.flatnonzero(near), n)
    order = np.lexsort((columns, -np.round(scores[rows, columns], SCORE_DIGITS), rows))
    rows, columns = rows[order], columns[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    rows, columns = rows[first], columns[first]
    if not usual.all():
        again = np.flatnonzero(~usual)
        i, j = best_k(np.round(scores[again], SCORE_DIGITS), k)
        rows, columns = np.concatenate([rows, again[i]]), np.concatenate([columns, j])
    order = np.lexsort((columns, rows))
    return rows[order], columns[order]


def emit(left: pa.Table, right: pa.Table, pieces, schema: pa.Schema) -> pa.Table:
    """Build (l_key, r_key, score) rows from index arrays."""
    if not pieces:
        return schema.empty_table()
    rows, columns, values = (np.concatenate(p) for p in zip(*pieces))
    return pa.table(
        [
            left["l_key"].combine_chunks().take(pa.array(rows)),
            right["r_key"].combine_chunks().take(pa.array(columns)),
            pa.array(values),
        ],
        schema=schema,
    )


def kernel(
    l_type: T.DataType, r_type: T.DataType, pick: Callable, metric: str, exclude_same: bool, rounded: bool = True
) -> tuple[Callable, T.StructType]:
    """The function one task runs on one block pair, and its output schema.

    ``pick`` sees rounded scores, or raw ones when ``rounded`` is false; those that come out are always rounded.
    """
    out, arrow = _hits(l_type, r_type, metric)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return arrow.empty_table()
        right = right.sort_by("r_key")
        pieces = []
        for start, scores in score_tiles(left, right, metric, exclude_same, rounded=rounded):
            rows, columns = pick(scores)
            pieces.append((rows + start, columns, np.round(scores[rows, columns], SCORE_DIGITS)))
        return emit(left, right, pieces, arrow)

    return run, out


def _hits(l_type: T.DataType, r_type: T.DataType, metric: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, known are {METRICS}")
    out = T.StructType([
        T.StructField("l_key", l_type), T.StructField("r_key", r_type), T.StructField("score", T.DoubleType()),
    ])
    return out, to_arrow_schema(out)


def plan_blocks(rows_left: int, rows_right: int, block_rows: int, cores: int) -> tuple[int, int]:
    """Blocks of either side: as few copied rows as blocks of that size and work for all cores allow."""
    least_left, least_right = max(1, -(-rows_left // block_rows)), max(1, -(-rows_right // block_rows))
    tasks = max(1, min(cores, -(-rows_left * rows_right // TASK_PAIRS)))
    plans = [(n, max(least_right, -(-tasks // n))) for n in range(least_left, max(least_left, tasks) + 1)]
    return min(plans, key=lambda p: rows_left * p[1] + rows_right * p[0])


def spread_pairs(
    left: DataFrame, right: DataFrame, block_rows: int, sizes: tuple[int, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Copy rows to all block pairs: each left block meets each right block once.

    ``sizes`` are row counts, or upper bounds of them, when the caller knows them. Blocks of wide vectors hold fewer rows.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    rows_left, rows_right = sizes or (left.count(), right.count())
    if rows_right > 4096:
        first = right.select(F.size("r_vec").alias("d")).first()
        block_rows = min(block_rows, max(1, BLOCK_VALUES // max(1, first["d"] if first else 1)))
    n_left, n_right = plan_blocks(rows_left, rows_right, block_rows, cores)

    def copies(frame: DataFrame, side: str, own: int, across: str, others: int) -> DataFrame:
        return frame.selectExpr(
            "*", f"cast(pmod(xxhash64({side}_key), {own}) AS int) AS {side}_block",
            f"explode(sequence(0, {others - 1})) AS {across}_block",
        )

    return copies(left, "l", n_left, "r", n_right), copies(right, "r", n_right, "l", n_left)


def run_blocks(lefts: DataFrame, rights: DataFrame, pair: list[str], run: Callable, out: T.StructType) -> DataFrame:
    return lefts.groupBy(*pair).cogroup(rights.groupBy(*pair)).applyInArrow(run, out)


def rank_best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits per left row over all blocks; ties go to the smaller key."""
    if k == 1:
        best = hits.groupBy("l_key").agg(F.expr("min(struct(-score AS s, r_key AS r)) AS b"))
        return best.selectExpr("l_key", "b.r AS r_key", "-b.s AS score", "1 AS rank")
    window = Window.partitionBy("l_key").orderBy(F.col("score").desc(), "r_key")
    return hits.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def topk_join(
    left: DataFrame, right: DataFrame, k: int, metric: str = "cosine",
    exclude_same: bool = False, block_rows: int = BLOCK_ROWS, sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """k best right rows per left row: (l_key, r_key, score, rank)."""
    run, out = kernel(
        left.schema["l_key"].dataType, right.schema["r_key"].dataType,
        best_one if k == 1 else lambda s: best_few(s, k), metric, exclude_same, rounded=False,
    )
    lefts, rights = spread_pairs(left, right, block_rows, sizes)
    return rank_best(run_blocks(lefts, rights, ["l_block", "r_block"], run, out), k)


def threshold_join(
    left: DataFrame, right: DataFrame, min_score: float, metric: str = "cosine",
    exclude_same: bool = False, block_rows: int = BLOCK_ROWS, sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """All pairs that score at least ``min_score``: (l_key, r_key, score).

    A block pair may hold very many: they leave the task tile by tile, so it holds its two blocks and one tile.
    """
    out, arrow = _hits(left.schema["l_key"].dataType, right.schema["r_key"].dataType, metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = {True: [], False: []}
        for batch in batches:
            for side, held in both.items():
                part = batch.filter(pc.equal(batch["is_left"], side))
                if part.num_rows:
                    held.append(part.select(["l_key", "l_vec"] if side else ["r_key", "r_vec"]))
        if not both[True] or not both[False]:
            return
        left, right = (pa.Table.from_batches(both.pop(side)) for side in (True, False))
        right = right.sort_by("r_key")
        for start, scores in score_tiles(left, right, metric, exclude_same, HIT_TILE):
            rows, columns = np.nonzero(scores >= min_score)
            if len(rows):
                found = emit(left, right, [(rows + start, columns, scores[rows, columns])], arrow)
                yield from found.combine_chunks().to_batches()

    lefts, rights = spread_pairs(left, right, block_rows, sizes)
    sides = lefts.withColumn("is_left", F.lit(True)).unionByName(
        rights.withColumn("is_left", F.lit(False)), allowMissingColumns=True)
    return sides.groupBy("l_block", "r_block").applyInArrow(run, out)


def plan_triangle(rows: int, block_rows: int, cores: int) -> int:
    """Blocks of a table that meets itself: n of them make n (n + 1) / 2 pairs, enough for all cores."""
    tasks = max(1, min(cores, -(-rows * rows // (2 * TASK_PAIRS))))
    n = max(1, -(-rows // block_rows))
    while n * (n + 1) // 2 < tasks:
        n += 1
    return n


def _meet_itself(table: DataFrame, block_rows: int, rows: int) -> DataFrame:
    """Rows (``l_key``, ``l_vec``) copied to all pairs ``l_block`` <= ``r_block`` of a triangle; ``is_left`` tells the side."""
    if rows > 4096:
        first = table.select(F.size("l_vec").alias("d")).first()
        block_rows = min(block_rows, max(1, BLOCK_VALUES // max(1, first["d"] if first else 1)))
    n = plan_triangle(rows, block_rows, table.sparkSession.sparkContext.defaultParallelism)
    return table.filter("l_key IS NOT NULL").selectExpr(
        "l_key", "l_vec", f"cast(pmod(xxhash64(l_key), {n}) AS int) AS _own", f"explode(sequence(0, {n - 1})) AS _other",
    ).selectExpr("l_key", "l_vec", "_own <= _other AS is_left", "least(_own, _other) AS l_block", "greatest(_own, _other) AS r_block")


def _two_blocks(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table | None] | None:
    """The two blocks of a pair in key order, the second one missing where a block meets itself; nothing for one without rows."""
    held, alone = {True: [], False: []}, True
    for batch in batches:
        for side in held:
            part = batch.filter(pc.equal(batch["is_left"], side))
            if part.num_rows:
                held[side].append(part.select(["l_key", "l_vec"]))
                alone = alone and part["l_block"][0] == part["r_block"][0]
    if not held[True] or not (alone or held[False]):
        return None
    left = pa.Table.from_batches(held.pop(True)).sort_by("l_key")
    return left, None if alone else pa.Table.from_batches(held.pop(False)).sort_by("l_key")


def self_join(table: DataFrame, min_score: float, metric: str = "cosine", block_rows: int = BLOCK_ROWS, rows: int | None = None) -> DataFrame:
    """All pairs of two rows (``l_key``, ``l_vec``) that score at least ``min_score``: (l_key, r_key, score), l_key < r_key.

    Every pair is scored once, a row is copied once for each block, and hits leave tile by tile as in ``threshold_join``.
    """
    key = table.schema["l_key"].dataType
    out, arrow = _hits(key, key, metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _two_blocks(batches)) is None:
            return
        left, right = found
        alone = right is None
        keys = pa.concat_arrays([t["l_key"].combine_chunks() for t in ([left] if alone else [left, right])])
        right = (left if alone else right).rename_columns(["r_key", "r_vec"])
        place = pc.rank(keys, tiebreaker="min").to_numpy()
        first = 0 if alone else len(left)  # where the right keys begin
        for begin in range(0, len(left), SLICE):
            skip = begin if alone else 0  # of a block with itself, the pairs above the diagonal
            for start, scores in score_tiles(left.slice(begin, SLICE), right.slice(skip), metric, False, HIT_TILE):
                i, j = np.nonzero(scores >= min_score)
                score = scores[i, j]
                i, j = i + start + begin, j + skip + first
                keep = place[i] < place[j] if alone else place[i] != place[j]
                i, j, score = i[keep], j[keep], score[keep]
                low, high = np.where(place[i] < place[j], [i, j], [j, i])
                if len(low):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(low)), keys.take(pa.array(high)), pa.array(score)], schema=arrow)

    sides = _meet_itself(table, block_rows, table.count() if rows is None else rows)
    return sides.groupBy("l_block", "r_block").applyInArrow(run, out)


def _decide(a: np.ndarray, b: np.ndarray, most: np.ndarray, width: int, same: np.ndarray, off: np.ndarray, length: float):
    """``nearest`` from the float32 maxima of each row over strips of ``width`` columns: only strips that can hold the best are scored."""
    top = most.max(axis=1, initial=-np.inf)
    # what float32 may be off: both numbers are rounded, then each product and sum
    slack = (a.shape[1] + 8) * 2.0**-22 * np.sqrt((a * a).sum(axis=1)) * length + 4 * 10.0**-SCORE_DIGITS
    rows, strips = np.nonzero((most >= (top - slack)[:, None]) & (top > OFF / 2)[:, None])
    at, best = np.full(len(a), -1), np.full(len(a), -np.inf)
    order = np.argsort(strips, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(strips[order])) + 1) if len(order) else []:
        row, begin = rows[part], strips[part[0]] * width
        scores = np.round(a[row] @ b[begin:begin + width].T, SCORE_DIGITS)
        _strike(scores, same[row], begin)
        low, high = np.searchsorted(off, (begin, begin + width))
        scores[:, off[low:high] - begin] = -np.inf
        column = scores.argmax(axis=1)
        score = scores[np.arange(len(row)), column]
        more = score > best[row]  # strips come in order, so the earlier column wins a tie
        best[row[more]], at[row[more]] = score[more], begin + column[more]
    return at, best


def _strike(scores: np.ndarray, same: np.ndarray, begin: int) -> None:
    own = np.flatnonzero((same >= begin) & (same < begin + scores.shape[1]))
    scores[own, same[own] - begin] = -np.inf


def screen_rows(v: np.ndarray, last: float = 0.0) -> np.ndarray:
    """float32 rows with one more number: 1 on the asking side, 0 or ``OFF`` on the other, so that a column that is off scores low."""
    return np.concatenate([v, np.full((len(v), 1), last)], axis=1, dtype=np.float32)


def nearest(
    a: np.ndarray, b: np.ndarray, same: np.ndarray | None = None, off: np.ndarray | None = None, b32: np.ndarray | None = None,
    both: bool = False,
):
    """Per row of ``a`` the row of ``b`` with the largest dot product (the earlier on ties; -1: none) and that score, rounded.

    For vectors of length 1 at most. float32 products tell which strips of columns can hold the best; there float64 decides, so the
    result is that of ``best_k``. ``same`` and ``off`` (sorted) are columns not to be taken, by one row and by any; ``b32`` is what
    ``screen_rows`` makes of ``b``, with ``OFF`` in the last place of those that are off. ``both`` adds the same for each row of ``b`` from the same products; ``same`` and ``off`` are not for it.
    """
    same = np.full(len(a), -1) if same is None else same
    off = np.zeros(0, dtype=np.int64) if off is None else off
    a32 = screen_rows(a, 1.0)
    if b32 is None:
        b32 = screen_rows(b)
        b32[off, -1] = OFF
    at, best = np.full(len(a), -1), np.full(len(a), -np.inf)
    long = lambda v: np.sqrt(max(((part * part).sum(axis=1).max(initial=0.0) for part in np.array_split(v, 1 + len(v) // SLAB)), default=0.0))
    far = long(b)
    tile, strips = np.empty((SLAB, STRIP), dtype=np.float32), range(0, len(b), STRIP)
    down = np.empty((-(-len(a) // SLAB), len(b)), dtype=np.float32) if both else None
    for turn, begin in enumerate(range(0, len(a), SLAB)):
        rows = slice(begin, begin + SLAB)
        slab, own = a32[rows], same[rows]
        most = np.empty((len(slab), len(strips)), dtype=np.float32)
        for strip, first in enumerate(strips):
            part = b32[first:first + STRIP]
            scores = np.matmul(slab, part.T, out=tile if (len(slab), len(part)) == tile.shape else None)
            _strike(scores, own, first)
            scores.max(axis=1, out=most[:, strip])
            if both:
                scores.max(axis=0, out=down[turn, first:first + STRIP])
        at[rows], best[rows] = _decide(a[rows], b, most, STRIP, own, off, far)
    if not both:
        return at, best
    up, best_up, far = np.full(len(b), -1), np.full(len(b), -np.inf), long(a)
    for begin in range(0, len(b), STRIP):
        rows = slice(begin, begin + STRIP)
        up[rows], best_up[rows] = _decide(b[rows], a, down[:, rows].T, SLAB, np.full(len(b[rows]), -1), off[:0], far)
    return at, best, up, best_up


def _finite(block: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Keys and vectors of a block without odd numbers: those never win a place."""
    v = matrix(block.column(1))
    fine = np.isfinite(v).all(axis=1)
    keys = block.column(0).combine_chunks()
    return (keys, v) if fine.all() else (keys.filter(pa.array(fine)), v[fine])


def nearest_join(left: DataFrame, right: DataFrame, sizes: tuple[int, int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``topk_join`` with k = 1 by dot product for vectors of length 1 at most; a row never finds its own key: (l_key, r_key, score)."""
    out, arrow = _hits(left.schema["l_key"].dataType, right.schema["r_key"].dataType, "dot")

    def run(lefts: pa.Table, rights: pa.Table) -> pa.Table:
        if not len(lefts) or not len(rights):
            return arrow.empty_table()
        (l_key, a), (r_key, b) = _finite(lefts.select(["l_key", "l_vec"])), _finite(rights.sort_by("r_key").select(["r_key", "r_vec"]))
        same = pc.fill_null(pc.index_in(l_key, r_key), -1).to_numpy(zero_copy_only=False)
        at, best = nearest(a, b, same)
        rows = np.flatnonzero(at >= 0)
        return pa.table([l_key.take(pa.array(rows)), r_key.take(pa.array(at[rows])), pa.array(best[rows])], schema=arrow)

    lefts, rights = spread_pairs(left, right, block_rows, sizes)
    return rank_best(run_blocks(lefts, rights, ["l_block", "r_block"], run, out), 1).drop("rank")


def nearest_others(table: DataFrame, rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``nearest_join`` of a table (``l_key``, ``l_vec``) with itself: two blocks meet once, for the rows of both."""
    key = table.schema["l_key"].dataType
    out, arrow = _hits(key, key, "dot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _two_blocks(batches)) is None:
            return
        left, right = found
        keys, a = _finite(left)
        if right is None:
            sides = [(keys, keys, *nearest(a, a, np.arange(len(a))))]
        else:
            others, b = _finite(right)
            at, best, up, best_up = nearest(a, b, both=True)
            sides = [(keys, others, at, best), (others, keys, up, best_up)]
        for mine, theirs, at, best in sides:
            hit = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([mine.take(pa.array(hit)), theirs.take(pa.array(at[hit])), pa.array(best[hit])], schema=arrow)

    hits = _meet_itself(table, block_rows, rows).groupBy("l_block", "r_block").applyInArrow(run, out)
    return rank_best(hits, 1).drop("rank")
