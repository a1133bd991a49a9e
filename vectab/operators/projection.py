"""Projection of vectors onto the plane."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot, lit_vector, nonzero, unit
from .stats import vector_sums


def _axes(rows: DataFrame) -> list[list[float]]:
    """Two main axes (dimension-sized constants), the largest loading made positive."""
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows.select(array_to_vector("u").alias("v")))
    axes = np.array(model.pc.toArray()).T
    return [list(a if a[np.abs(a).argmax()] > 0 else -a) for a in axes]


def project_2d(table: DataFrame, key: str, vector: str, labels: str | None = None) -> DataFrame:
    """(key, x, y): unit vectors on their two main axes.

    With ``labels`` the axes are those between the mean vectors of the labelled
    groups (label -1 and NULL left out), so that labelled groups move apart; with
    fewer than three groups the plain axes are used. The rows themselves are
    projected by an expression, in one narrow pass.
    """
    rows = table.filter(nonzero(vector)).select(key, unit(vector).alias("u"))
    axes = None
    if labels:
        named = table.filter(F.col(labels).isNotNull() & (F.col(labels) != -1))
        means = vector_sums(named, vector, labels).select(
            F.transform("total", lambda t: t / F.col("n")).alias("u")
        )
        if len(means.head(3)) == 3:
            axes = _axes(means)
    axes = axes or _axes(rows)
    return rows.select(
        key, dot("u", lit_vector(axes[0])).alias("x"), dot("u", lit_vector(axes[1])).alias("y")
    )
