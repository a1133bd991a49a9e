"""The whole clustering job: tables to labelled, projected, density-clustered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.density import density_ball
from ..operators.hac import auto_cluster
from ..operators.projection import project_2d
from ..operators.stats import nearest_to_centroid, record_lows, singletons_to_noise
from ..operators.table import label_join, scan_many
from ..sources.store import Store
from .scaling import cut_lineage, global_row_number


ROW = "_row"


def cluster_map(
    tables: Sequence[DataFrame], key: str, vector: str, eps: float = 0.3, min_pts: int = 3,
    hierarchical: bool = True, supervised: bool = True, all_lows: bool = False, compat: bool = False,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Rows with table_name, clusterNumber, coordinates, dbscanCluster and center.

    Steps: union, automatic clustering, lone labels to -1, projection, density
    clusters in table and key order, centres. Rows are told apart by table and
    key, so equal keys of two tables keep their own labels. ``all_lows`` flags
    every running minimum of a cluster's distances, not only the nearest row.
    """
    names = names or [f"table{i}" for i in range(len(tables))]
    rows = cut_lineage(global_row_number(scan_many(tables, names), ["table_name", key], ROW))
    if hierarchical:
        rows = label_join(rows, auto_cluster(rows, ROW, vector, compat), ROW)
        rows = cut_lineage(singletons_to_noise(rows, ROW, "clusterNumber"))
    plane = project_2d(rows, ROW, vector, "clusterNumber" if hierarchical and supervised else None)
    labels, members = density_ball(cut_lineage(plane), ROW, ROW, eps, min_pts)
    flag = record_lows if all_lows else nearest_to_centroid
    centers = flag(cut_lineage(members), ROW, "list_pos").filter("center").select(
        ROW, "center").distinct()
    found = labels.select(
        ROW, F.array("x", "y").alias("coordinates"), F.col("cluster").alias("dbscanCluster")
    )
    return rows.join(found, ROW, "left").join(centers, ROW, "left").drop(ROW)


FOUND = ["clusterNumber", "coordinates", "dbscanCluster", "center"]


def save_cluster_map(store: Store, names: Sequence[str], vector: str, **options) -> DataFrame:
    """``cluster_map`` over stored tables whose result is kept: each table gets a new version with the found columns.

    Found columns of an earlier run are replaced, all other columns stay. The rows of all tables are returned, with
    ``table_name``. A run that dies leaves tables in their old or their new version, never in between. All tables
    must have the same key column.
    """
    keys = {store.key(n) for n in names}
    if len(keys) != 1:
        raise ValueError(f"tables with different keys: {sorted(keys)}")
    key = keys.pop()
    tables = [store.read(n).drop(*FOUND) for n in names]
    mapped = cut_lineage(cluster_map([t.select(key, vector) for t in tables], key, vector, names=names, **options))
    found = [c for c in FOUND if c in mapped.columns]
    for name, table in zip(names, tables):
        own = mapped.filter(F.col("table_name") == name).select(key, *found)
        store.write(name, table.join(own, key, "left"), key)
    return mapped
