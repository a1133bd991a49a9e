"""Shared inputs of the registered queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hac import hac
from ..operators.embed import HASH_MODEL, embed
from ..functions.vector import get_vector

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
MAP_TYPE = "map<string,array<float>>"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The query of the search checks: the vector of the first row."""
    row = vectors(spark, sf).orderBy("vec_id").limit(1).first()
    return [float(v) for v in row["embedding"]]


def plane(spark: SparkSession, sf: str) -> DataFrame:
    """The first two vector elements as a point."""
    return vectors(spark, sf).select(
        "vec_id", "label", F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
    )


def hashed(df: DataFrame, *kept: str) -> DataFrame:
    """Texts embedded by the default model: the kept columns and the vector."""
    return embed(df, ["text"], HASH_MODEL).select(*kept, get_vector("embeddings", HASH_MODEL).alias("v"))


@lru_cache(maxsize=4)
def _tree(app: str, sf: str) -> tuple[DataFrame, DataFrame]:
    spark = SparkSession.getActiveSession()
    rows, merges = hac(vectors(spark, sf), "vec_id", "embedding")
    return rows, merges


def tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Rows and merge table of the whole table, written once per session."""
    return _tree(spark.sparkContext.applicationId, sf)


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


Q_SQL = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"
PLANE_SQL = "pts AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def hash_sql(table: str, key: str, name: str) -> str:
    """Common table expression ``name``(key, bucket, v): the default model in SQL."""
    return f"""{name} AS (
      SELECT {key}, ('0x' || m[1:8])::BIGINT % 64 AS bucket,
             sum(CASE WHEN m[9:9] < '8' THEN 1 ELSE -1 END)::DOUBLE AS v
      FROM (SELECT {key}, md5(t) AS m FROM (
              SELECT {key}, unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS t FROM {table}) WHERE t <> '')
      GROUP BY ALL)"""


MATCH_SQL = f"""WITH {hash_sql('documents', 'doc_id', 'a')}, {hash_sql('benchmark', 'item_id', 'b')},
      na AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM a GROUP BY 1 HAVING sum(v * v) > 0),
      nb AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM b GROUP BY 1 HAVING sum(v * v) > 0),
      dots AS (SELECT doc_id, item_id, sum(a.v * b.v) AS d FROM a JOIN b USING (bucket) GROUP BY 1, 2),
      sims AS (SELECT na.doc_id, nb.item_id, round(coalesce(d, 0) / (na.n * nb.n), 12) AS s
               FROM na CROSS JOIN nb LEFT JOIN dots ON dots.doc_id = na.doc_id AND dots.item_id = nb.item_id),
      best AS (SELECT doc_id, item_id, s FROM sims
               QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id) = 1)"""
