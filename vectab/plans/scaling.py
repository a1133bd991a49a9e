"""Helpers that keep plans distributed: lineage cuts, global order, salted joins.

A window without PARTITION BY, and a window over a group that holds a third of
the table, both end in one task. The helpers here cut the ordered data into
range pieces, work inside each piece, and carry only one summary row per piece
(and group) from piece to piece.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE = "_piece"
SKEW_BYTES = 256 << 20  # below this a whole table fits one task
HOT_SHARE = 0.001
SALTS = 64


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="vectab-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables that must be written."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Lost executors then cost no replay of earlier rounds, and the next plan
    knows the true size: a small table is broadcast, a large one shuffled.
    The folder is removed when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def range_pieces(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition by ``order`` and number the pieces in that order.

    ``order`` must end in a unique key, otherwise equal values cannot be split.
    The pieces are written out: range bounds come from sampling, and a second
    run could choose others.
    """
    cut = df.repartitionByRange(*_columns(order)).withColumn(PIECE, F.spark_partition_id())
    return cut_lineage(cut)


def global_row_number(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Row numbers over the whole table without a single-task sort."""
    pieces = range_pieces(df, order)
    before = Window.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(PIECE).agg(F.count(F.lit(1)).alias("_n"))
        # one row per shuffle partition, so this unpartitioned window is bounded
        .select(PIECE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(PIECE).orderBy(*_columns(order)))
    return (
        pieces.join(F.broadcast(offsets), PIECE)
        .withColumn(name, (inside - 1 + F.col("_offset") + start).cast("long"))
        .drop(PIECE, "_offset")
    )


def running(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    how: str,
    name: str,
    group: Sequence[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum`` or ``min`` of ``value``, optionally inside groups.

    The range cut runs over (group, order), so a hot group is spread over many
    tasks. Between pieces only one row per (group, piece) travels.
    """
    agg = {"sum": F.sum, "min": F.min}[how]
    join = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "min": lambda a, b: F.least(a, b),
    }[how]
    pieces = range_pieces(df, [*group, *order])
    carry_window = Window.partitionBy(*group) if group else Window.partitionBy()
    carries = (
        pieces.groupBy(*group, PIECE).agg(agg(value).alias("_total"))
        .withColumn(
            "_carry",
            agg("_total").over(
                carry_window.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_total")
    )
    local = (
        Window.partitionBy(*group, PIECE).orderBy(*_columns(order))
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    out = pieces.withColumn("_local", agg(value).over(local))
    return (
        null_safe_join(out, carries, [*group, PIECE])
        .withColumn(name, join(F.col("_local"), F.col("_carry")))
        .drop("_local", "_carry", PIECE)
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which NULL keys match each other."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"_r_{k}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size estimate: exact for written tables, high rather than low after joins."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def hot_keys(df: DataFrame, on: Sequence[str]) -> list[int]:
    """Hashes of the keys that may fill more than ``HOT_SHARE`` of the rows.

    One pass with bounded counters and no shuffle; the list has at most
    1 / HOT_SHARE entries. A key listed without need only costs copies.
    """
    found = df.select(F.xxhash64(*on).alias("h")).freqItems(["h"], HOT_SHARE).first()
    return list(found[0]) if found and found[0] else []


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: str,
    how: str = "inner",
) -> DataFrame:
    """Equi join whose ``big`` side may hold one key in a third of its rows.

    Rows of a hot key in ``big`` go to ``SALTS`` tasks, picked by a hash of
    ``spread``; only for hot keys is ``small`` copied to all of them. A side
    that fits one task is joined plainly: a hot key in it does no harm.
    """
    hot = hot_keys(big, on) if estimated_bytes(big) > SKEW_BYTES else []
    if not hot:
        return big.join(small, list(on), how)
    is_hot = F.xxhash64(*on).isin(hot)
    spots = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = small.withColumn("_salt", F.explode(spots))
    salt = F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    return big.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")
