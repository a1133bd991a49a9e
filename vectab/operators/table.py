"""Scans, projections, simple joins, ordering and paging of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns a table view hides; columns a best match leaves out.
SYSTEM_COLUMNS = [
    "center", "embeddings", "hnsw", "clicked", "order", "coordinates",
    "embeddings2", "hnsw2", "clusterNumber2", "order2", "coordinates2",
    "bestMatch-clusterNumber", "bestMatch-order", "bestMatch-coordinates", "bestMatch-embeddings",
]
MATCH_DROPS = ["embeddings", "score", "hnsw"]


def scan(table: DataFrame, key: str, ordered: bool = False) -> DataFrame:
    """All rows; sorted by key only where the order is seen."""
    return table.orderBy(key) if ordered else table


def scan_by_keys(table: DataFrame, keys: DataFrame | Sequence, key: str) -> DataFrame:
    """Rows whose key is listed: a literal list becomes a pushed filter, a table a semi join."""
    if isinstance(keys, DataFrame):
        return table.join(keys.select(key), key, "left_semi")
    return table.filter(F.col(key).isin(list(keys)))


def keys(table: DataFrame, key: str) -> DataFrame:
    return table.select(key)


def first_row(table: DataFrame, key: str) -> DataFrame:
    return table.orderBy(key).limit(1)


def scan_many(tables: Sequence[DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """Tables one after another, columns matched by name, missing ones NULL.

    With ``names`` each row is tagged with its table, so that equal keys of two
    tables stay apart.
    """
    if names:
        tables = [t.withColumn("table_name", F.lit(n)) for t, n in zip(tables, names)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def count_rows(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_rows"))


def drop_system_columns(table: DataFrame) -> DataFrame:
    return table.drop(*SYSTEM_COLUMNS)


def column_union(tables: Sequence[DataFrame]) -> list[str]:
    """All column names over several tables, without the system columns."""
    seen = dict.fromkeys(c for t in tables for c in t.columns)
    return [c for c in seen if c not in SYSTEM_COLUMNS]


def map_keys_union(table: DataFrame, column: str) -> DataFrame:
    """Distinct keys over all rows of a map column."""
    return table.select(F.explode(F.map_keys(column)).alias("name")).distinct()


def suffix_columns(df: DataFrame, suffix: str = "2") -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c + suffix) for c in df.columns])


def prefix_columns(df: DataFrame, prefix: str = "bestMatch-") -> DataFrame:
    """Columns of a hit row under a prefix, without vectors and scores."""
    kept = [c for c in df.columns if c not in MATCH_DROPS]
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in kept])


def detail(
    table: DataFrame, title: str, description: str, key: str,
    clicked: Column | str = "clicked", color: Column | str = "color",
) -> DataFrame:
    """The listing of a cluster: title, description, id, clicked, color."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return table.select(
        F.col(title).alias("title"), F.col(description).alias("description"),
        F.col(key).alias("id"), as_col(clicked).alias("clicked"), as_col(color).alias("color"),
    )


def cluster_members(table: DataFrame, key: str, cluster: str, clicked_key) -> DataFrame:
    """Rows in the cluster of the clicked row, that row flagged.

    The clicked row's label is one value, so the join side is one row.
    """
    wanted = table.filter(F.col(key) == F.lit(clicked_key)).select(cluster)
    return table.join(F.broadcast(wanted), cluster, "left_semi").withColumn(
        "clicked", F.col(key) == F.lit(clicked_key)
    )


def centers_only(table: DataFrame, center: str = "center") -> DataFrame:
    return table.filter(F.col(center))


def label_join(table: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Attach labels by key; rows without one get NULL."""
    return table.join(labels, key, "left")


def lookup_join(hits: DataFrame, table: DataFrame, hit_key: str, key: str) -> DataFrame:
    """Attach the hit's row under the best-match prefix."""
    found = prefix_columns(table)
    return hits.join(found, F.col(hit_key) == F.col(f"`bestMatch-{key}`"), "left")


def table_sort(
    table: DataFrame, column: str = "clusterNumber", key: str | None = None,
    descending: bool = True, collation: str | None = None,
) -> DataFrame:
    """Sort by any column: numbers by value, then texts; NULL sorts as empty text.

    ``collation`` (for example ``UNICODE``) gives a language-aware text order.
    """
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    number = F.expr(f"try_cast(`{column}` AS double)")
    text = F.collate(value, collation) if collation else value
    order = [number.isNull(), number, text]
    order = [c.desc() if descending else c.asc() for c in order]
    return table.orderBy(*order, *([key] if key else []))


def table_page(table: DataFrame, order: Sequence[str | Column], page: int, size: int = 100) -> DataFrame:
    """One page; ``order`` must end in a unique key so that pages do not overlap."""
    return table.orderBy(*order).offset(page * size).limit(size)
