"""Hard negatives: for each positive of an anchor, the best other-label rows in a score window below it.

The windows of one anchor overlap: each reaches from its positive's score down to a share of it.
The positives' scores, as upper limits, split the score line into disjoint slots, so a row falls into
one slot only, and blocks of rows keep the best few per slot. The best of any window are then among the
slots from its own downwards: merging the slots from the lowest up answers all windows in turn.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.blocks import best_k
from ..plans.scaling import cut_lineage

ANCHOR_BYTES = 32 << 20  # vectors of one anchor block
ROW_BLOCK = 1 << 17  # rows of one row block, at most
TASK_SCORES = 1 << 26  # scores worth a task of their own
TILE = 1 << 21  # scores held at once
LONG = 2**63 - 1


def scaled(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """floor(scale * component) as whole numbers in doubles, one row per vector."""
    lists = column.combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -np.finfo(float).max, np.finfo(float).max)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 2**53 by Python's integers, held inside a long."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return a @ b.T
    whole = [np.array([int(v) for v in m.ravel()], dtype=object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -LONG, LONG)


def highest(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k highest allowed scores per row, the earlier column first on ties."""
    if scores.dtype != object:
        return best_k(np.where(allowed, scores, -np.inf), k)
    pairs = [(i, j) for i in range(len(scores)) for j in sorted(np.flatnonzero(allowed[i]), key=lambda j: (-scores[i, j], j))[:k]]
    rows, columns = zip(*pairs) if pairs else ((), ())
    return np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64)


def same_label(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides as numbers that are equal where the labels are."""
    both = pa.chunked_array([left["label"].combine_chunks(), right["r_label"].combine_chunks()])
    codes = both.combine_chunks().dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
    return codes[: len(left)], codes[len(left):]


def positives_of(k: int, scale: int, key_type: T.DataType) -> tuple[Callable, T.StructType]:
    """The k best rows of an anchor's own label in one block, and their schema."""
    out = T.StructType([
        T.StructField("a", T.LongType()), T.StructField("r_key", key_type), T.StructField("score", T.LongType()),
    ])
    arrow = to_arrow_schema(out)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return arrow.empty_table()
        right = right.sort_by("r_key")
        a, b = scaled(left["v"], scale), scaled(right["r_v"], scale)
        la, lb = same_label(left, right)
        own = pc.index_in(left["key"].combine_chunks(), pc.unique(right["r_key"])).fill_null(-1).to_numpy()
        theirs = pc.index_in(right["r_key"].combine_chunks(), pc.unique(right["r_key"])).to_numpy()
        parts = []
        for low in range(0, len(a), step := max(1, TILE // len(b))):
            part = slice(low, low + step)
            scores = products(a[part], b)
            i, j = highest(scores, (la[part, None] == lb) & (own[part, None] != theirs), k)
            parts.append((i + low, j, scores[i, j].astype(np.int64)))
        i, j, s = (np.concatenate(p) for p in zip(*parts))
        return pa.table([left["a"].combine_chunks().take(pa.array(i)), right["r_key"].combine_chunks().take(pa.array(j)), pa.array(s)], schema=arrow)

    return run, out


def slots_of(k: int, scale: int, share: tuple[int, int], key_type: T.DataType) -> tuple[Callable, T.StructType]:
    """The k best rows of other labels in each slot of an anchor, out of one block, and their schema.

    ``limits`` are the positives' scores, falling: slot j holds the scores up to limit j and above
    limit j + 1. Nothing below the share of the last limit is in any window.
    """
    out = T.StructType([
        T.StructField("a", T.LongType()), T.StructField("slot", T.IntegerType()),
        T.StructField("r_key", key_type), T.StructField("score", T.LongType()),
    ])
    arrow = to_arrow_schema(out)
    up, down = share

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return arrow.empty_table()
        right = right.sort_by("r_key")
        a, b = scaled(left["v"], scale), scaled(right["r_v"], scale)
        la, lb = same_label(left, right)
        limits = left["limits"].to_pylist()
        most = max(map(len, limits))
        # limit j + 1 of an anchor's last slot: one below the smallest score that its window takes
        edges = np.array([[*u, *[-(-u[-1] * up // down) - 1] * (most + 1 - len(u))] for u in limits], dtype=object)
        parts = []
        for low in range(0, len(a), step := max(1, TILE // len(b))):
            part = slice(low, low + step)
            scores = products(a[part], b)
            bound = edges[part] if scores.dtype == object else edges[part].astype(np.float64)
            other = la[part, None] != lb
            for slot in range(most):
                allowed = other & (scores <= bound[:, slot, None]) & (scores > bound[:, slot + 1, None])
                i, j = highest(scores, allowed.astype(bool), k)
                parts.append((i + low, np.full(len(i), slot, dtype=np.int32), j, scores[i, j].astype(np.int64)))
        i, slot, j, s = (np.concatenate(p) for p in zip(*parts))
        return pa.table([
            left["a"].combine_chunks().take(pa.array(i)), pa.array(slot),
            right["r_key"].combine_chunks().take(pa.array(j)), pa.array(s)], schema=arrow)

    return run, out


def best_rows(hits: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows per group; Spark limits each task's groups before the shuffle."""
    window = Window.partitionBy(*by).orderBy(F.col("score").desc(), "r_key")
    return hits.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    A score is the integer inner product of floor(``scale`` * component). An anchor's positives are its
    ``positives`` best rows of the same label; each gets the ``negatives`` best rows of other labels whose
    score is at most the positive's and at least ``share`` of it (none, where the positive's score is below
    0). Higher scores come first, ties by smaller key.

    Rows without key or label, and those whose vector is null, empty or holds a null or non-finite
    component, take no part. Rows with the anchor's own key are never its positives. Repeated rows count
    each, as candidates and as anchors. An anchor without positives, or a positive without
    negatives, gives no row; an empty table gives an empty one. A product beyond a long counts as the
    nearest long. Vectors of different widths raise an error. Other columns are not read.

    Anchors in blocks of a bounded size meet all rows in blocks; a hot label is spread like any other.
    """
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0)
    rows = vectors.filter(fit).select(
        F.col(key).alias("r_key"), F.col(label).alias("r_label"), F.col(vector).alias("r_v"), anchor.alias("anchor"))
    # numbered after they are written, so that repeated rows stay apart
    anchors = cut_lineage(rows.filter("anchor").selectExpr("r_key AS key", "r_label AS label", "r_v AS v"))
    anchors = cut_lineage(anchors.withColumn("a", F.monotonically_increasing_id()))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("r_v")).alias("w"), F.min(F.size("r_v")).alias("least")).first()
    if size["w"] != size["least"]:
        raise ValueError(f"vectors of different widths: {size['least']} and {size['w']}")
    n_anchors, n_rows, width = anchors.count(), size["n"], size["w"] or 1
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    a_blocks = max(1, -(-n_anchors * width * 8 // ANCHOR_BYTES))
    r_blocks = max(1, -(-n_rows // ROW_BLOCK), min(cores, n_anchors * n_rows // TASK_SCORES))

    def placed(frame: DataFrame, name: str, blocks: int, other: str, others: int) -> DataFrame:
        """Rows dealt in turn, so that copies of one row spread too, and copied to the blocks of the other side."""
        return frame.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    rights = placed(rows.drop("anchor"), "rb", r_blocks, "ab", a_blocks)

    def against(lefts: DataFrame, run: Callable, out: T.StructType) -> DataFrame:
        lefts = placed(lefts, "ab", a_blocks, "rb", r_blocks)
        return lefts.groupBy("ab", "rb").cogroup(rights.groupBy("ab", "rb")).applyInArrow(run, out)

    key_type = rows.schema["r_key"].dataType
    good = cut_lineage(best_rows(against(anchors, *positives_of(positives, scale, key_type)), ["a"], positives))
    limits = good.groupBy("a").agg(F.sort_array(F.collect_list("score"), asc=False).alias("limits"))  # ``positives`` at most
    found = best_rows(
        against(anchors.join(limits, "a"), *slots_of(negatives, scale, share, key_type)), ["a", "slot"], negatives
    ).groupBy("a").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "r_key", "slot")).alias("kept"))

    def suffix(merged: Column, slot: Column) -> Column:
        """The best of this slot and of all below it, put before what is known of those."""
        mine = F.filter(F.col("kept"), lambda x: x["slot"] == slot).cast(entry)
        below = F.coalesce(F.try_element_at(merged, F.lit(1)), F.array().cast(entry))
        return F.concat(F.array(F.slice(F.array_sort(F.concat(mine, below)), 1, negatives)), merged)

    # ``slot`` comes last in the entry and never decides: a row lies in one slot
    entry = T.ArrayType(T.StructType([
        T.StructField("s", T.LongType()), T.StructField("r_key", key_type), T.StructField("slot", T.IntegerType())]))
    merged = found.withColumn("best", F.aggregate(
        F.sequence(F.lit(positives - 1), F.lit(0)), F.array().cast(T.ArrayType(entry)), suffix)).select("a", "best")
    picked = good.join(merged, "a").join(anchors.select("a", "key"), "a").select(
        F.col("key").alias("anchor_id"), F.col("r_key").alias("positive_id"), F.col("score").alias("positive_score"),
        F.posexplode(F.filter(
            F.element_at("best", F.col("place")),
            lambda x: -x["s"].cast("decimal(20,0)") * share[1] >= F.col("score").cast("decimal(20,0)") * share[0])),
    )
    return picked.select(
        "anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.r_key").alias("negative_id"),
        "positive_score", (-F.col("col.s")).alias("negative_score"),
    )
