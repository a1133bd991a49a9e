"""A log of immutable folders: each version names the folders it consists of."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class SegmentLog:
    """Versions below ``path``/log, data below ``path``/data.

    A version counts once Spark has written its ``_SUCCESS`` file, and folders are never changed after: a job that
    dies leaves the version before it, and readers of an older version are not disturbed. Two writers of the same
    version cannot both succeed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []

    def versions(self) -> list[int]:
        """Finished versions, rising."""
        log = f"{self.path}/log"
        return [int(v[1:]) for v in self._names(log) if v.startswith("v") and "_SUCCESS" in self._names(f"{log}/{v}")]

    def read(self, version: int | None = None) -> dict | None:
        """What a version, by default the last one, consists of; None when there is none."""
        known = self.versions()
        if version is None and not known:
            return None
        row = self.spark.read.schema("state string").parquet(f"{self.path}/log/v{version or known[-1]:08d}").first()
        return json.loads(row["state"])

    def commit(self, state: dict) -> int:
        """Write the next version; numbers that a dead job has begun are left alone."""
        begun = [int(v[1:]) for v in self._names(f"{self.path}/log") if v.startswith("v")]
        version = max(begun, default=0) + 1
        frame = self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1)
        frame.write.mode("error").parquet(f"{self.path}/log/v{version:08d}")
        return version

    def write(self, df: DataFrame, *partition: str) -> str:
        """A new folder with the rows of ``df``; its name, for a later commit."""
        name = uuid.uuid4().hex
        df.write.partitionBy(*partition).parquet(f"{self.path}/data/{name}")
        return name

    def data(self, name: str, schema: str) -> DataFrame:
        """The rows of a folder. The schema is given, so that a folder without rows can be read too."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/data/{name}")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders that none of the last ``keep`` versions names; their names.

        Call it when no reader is left on an older version and no writer is at work.
        """
        used = json.dumps([self.read(v) for v in self.versions()[-keep:]])
        gone = [n for n in self._names(f"{self.path}/data") if n not in used]
        for name in gone:
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{name}")
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)
        return gone
