"""Keyed tables: upsert, insert-only and strict append, and a versioned Parquet folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY_META = "vectab.key"


def last_per_key(batch: DataFrame, key: str, order_by: Sequence[str | Column]) -> DataFrame:
    """One row per key, the last in ``order_by``.

    The filter on ``row_number`` becomes a group limit before the shuffle, so a
    key that fills a third of the batch leaves one row per input task.
    """
    last_first = [(F.col(c) if isinstance(c, str) else c).desc() for c in order_by]
    window = Window.partitionBy(key).orderBy(*last_first)
    return batch.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def upsert(
    target: DataFrame,
    batch: DataFrame,
    key: str,
    order_by: Sequence[str | Column],
    skip_keys: DataFrame | None = None,
) -> DataFrame:
    """Replace or insert the batch rows; of equal keys in the batch the last wins.

    A row is replaced as a whole: columns that only the target has are null in batch rows, columns that only the
    batch has are added and null in the others, but for columns that are named to order the batch. The target is only probed on its key (anti join), never sorted or regrouped.
    """
    if skip_keys is not None:
        batch = batch.join(skip_keys.select(key), key, "left_anti")
    helpers = [c for c in order_by if isinstance(c, str) and c not in target.columns]
    newest = last_per_key(batch, key, order_by).drop(*helpers)
    changed = batch.select(key).distinct()  # keys alone: the ranking need not run twice
    return target.join(changed, key, "left_anti").select(*target.columns).unionByName(newest, allowMissingColumns=True)


def new_rows(
    target: DataFrame, batch: DataFrame, key: str, order_by: Sequence[str | Column]
) -> DataFrame:
    """The batch rows whose key the target lacks; of equal keys the last.

    The target's keys are first cut down to those in the batch: a small batch is
    broadcast for that, and the target is scanned on its key column only.
    """
    present = target.select(key).join(batch.select(key).distinct(), key, "left_semi")
    return last_per_key(batch.join(present, key, "left_anti"), key, order_by)


def insert_new(
    target: DataFrame, batch: DataFrame, key: str, order_by: Sequence[str | Column]
) -> DataFrame:
    """The target plus the new rows; existing rows stay untouched."""
    return target.unionByName(new_rows(target, batch, key, order_by), allowMissingColumns=True)


def duplicate_keys(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Batch keys that the target holds already or that occur twice in the batch."""
    present = target.select(key).join(batch.select(key).distinct(), key, "left_semi")
    twice = batch.groupBy(key).count().filter("count > 1").select(key)
    return present.union(twice).distinct()


def check_keys(target: DataFrame, batch: DataFrame, key: str) -> None:
    """Raise when a key would occur twice; nothing is written before this check."""
    clash = duplicate_keys(target, batch, key).head(1)
    if clash:
        raise ValueError(f"key exists already: {clash[0][0]!r}")


def append_strict(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The target plus the batch; raises when a key would occur twice."""
    check_keys(target, batch, key)
    return target.unionByName(batch)


def union_last_wins(tables: Sequence[DataFrame], key: str, order_by: str) -> DataFrame:
    """Tables one after another; of equal keys the row of the last table wins."""
    tagged = None
    for position, table in enumerate(tables):
        part = table.withColumn("_source", F.lit(position))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return last_per_key(tagged, key, ["_source", order_by]).drop("_source")


class Store:
    """Keyed Parquet tables below one folder.

    Changes to existing rows write a new version, which counts once Spark has
    written its ``_SUCCESS`` file, so a lost job leaves the previous one in
    place. New rows are appended to the current version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _children(self, path: str) -> list[str]:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(jpath):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(jpath))

    def names(self) -> list[str]:
        return [n for n in self._children(self.root) if self._current(n) is not None]

    def _current(self, name: str) -> int | None:
        done = [
            int(v[1:]) for v in self._children(f"{self.root}/{name}")
            if v[:1] == "v" and "_SUCCESS" in self._children(f"{self.root}/{name}/{v}")
        ]
        return max(done, default=None)

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def read(self, name: str) -> DataFrame:
        version = self._current(name)
        if version is None:
            raise ValueError(f"no table {name!r} below {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}/v{version:08d}")

    def key(self, name: str) -> str:
        for field in self.read(name).schema.fields:
            if field.metadata.get(KEY_META):
                return field.name
        raise ValueError(f"table {name!r} has no key column")

    def write(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """Write a new version of the whole table."""
        marked = df.withColumn(key, F.col(key).alias(key, metadata={KEY_META: True}))
        version = (self._current(name) or 0) + 1
        marked.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version:08d}")
        return self.read(name)

    def upsert(self, name: str, batch: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
        key = self.key(name)
        return self.write(name, upsert(self.read(name), batch, key, order_by), key)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Add rows to the current version; nothing that is there is rewritten unless the rows bring new columns."""
        known = self.read(name)
        if set(rows.columns) - set(known.columns):
            return self.write(name, known.unionByName(rows, allowMissingColumns=True), self.key(name))
        rows = known.limit(0).unionByName(rows, allowMissingColumns=True)
        path = f"{self.root}/{name}/v{self._current(name):08d}"
        rows.select(*known.columns).write.mode("append").parquet(path)
        return self.read(name)

    def insert_new(self, name: str, batch: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
        """Append the new rows. A repeated run finds their keys and adds nothing."""
        return self.append(name, new_rows(self.read(name), batch, self.key(name), order_by))

    def append_strict(self, name: str, batch: DataFrame) -> DataFrame:
        check_keys(self.read(name), batch, self.key(name))
        return self.append(name, batch)

    def catalog(self) -> DataFrame:
        """Table name, row count and key column of every table."""
        return catalog({n: (self.read(n), self.key(n)) for n in self.names()})


def catalog(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count per named table; each count reads no data column."""
    tagged = None
    for name, (df, key) in tables.items():
        part = df.select(F.lit(name).alias("table_name"), F.lit(key).alias("key_column"))
        tagged = part if tagged is None else tagged.union(part)
    return tagged.groupBy("table_name", "key_column").agg(F.count(F.lit(1)).alias("n_rows"))


def models(table: DataFrame, embeddings: str = "embeddings") -> DataFrame:
    """Models present, rows that have them, smallest and largest dimension."""
    return (
        table.select(F.explode(embeddings).alias("model", "vector"))
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min(F.size("vector")).alias("min_dim"),
            F.max(F.size("vector")).alias("max_dim"),
        )
    )
