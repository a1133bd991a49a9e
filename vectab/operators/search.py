"""Top-k search, comparison of tables and of two rows, neighbour graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quant import hamming, sbq_code, sbq_words
from ..functions.vector import (
    cosine, get_vector, has_dim, lit_vector, nonzero, round_fixed3, round_sig2,
)
from .blocks import BLOCK_ROWS, keyed_vectors, row_bound, self_join, topk_join
from .embed import model_factory
from .table import lookup_join

TOP_K = 10


def search_exact(
    table: DataFrame, query: Sequence[float], key: str, vector: str,
    k: int = TOP_K, rank_on: str = "rounded",
) -> DataFrame:
    """The k rows most similar to the query vector.

    By default the rank is taken on the score after rounding to two digits, so
    near ties fall to the smaller key; ``rank_on='raw'`` ranks on the cosine.
    Rows without a vector, of another dimension or of length zero are skipped.
    The plan is one scan with a bounded top-k per task, no full sort.
    """
    fit = table.filter(has_dim(vector, len(query)) & nonzero(vector))
    if not any(query):
        fit = fit.limit(0)  # no direction, nothing is similar
    scored = fit.withColumn("_raw", cosine(vector, lit_vector(query))).withColumn("score", round_sig2("_raw"))
    order = F.col("_raw" if rank_on == "raw" else "score").desc()
    return scored.drop(vector).orderBy(order, F.col(key)).limit(k).drop("_raw")


def search(table: DataFrame, query: Sequence[float], key: str, model: str, k: int = TOP_K) -> DataFrame:
    """``search_exact`` over a stored table with an ``embeddings`` map."""
    vectors = table.withColumn("_vector", get_vector("embeddings", model)).drop("embeddings")
    return search_exact(vectors, query, key, "_vector", k)


def search_text(table: DataFrame, text: str, key: str, model: str, k: int = TOP_K) -> DataFrame:
    """Embed one query text and search with it; an empty text finds nothing."""
    text = text.strip()
    if not text:
        return search(table.limit(0), [0.0], key, model, k)
    query = model_factory(model)()([text])[0]
    return search(table, [float(v) for v in query], key, model, k)


def search_sbq(
    table: DataFrame, query: Sequence[float], key: str, vector: str,
    mean: Sequence[float], std: Sequence[float], k: int = TOP_K,
) -> DataFrame:
    """The k rows whose two-bit codes differ least from the query's; score = -distance."""
    dims = len(query)
    code = lambda v: sbq_words(sbq_code(v, mean, std), dims)
    return (
        table.filter(F.col(vector).isNotNull() & has_dim(vector, dims))
        .withColumn("score", -hamming(code(vector), code(lit_vector(query))))
        .drop(vector).orderBy(F.col("score").desc(), F.col(key)).limit(k)
    )


def topk_per_group(df: DataFrame, group: str, score: str | Column, key: str, k: int = TOP_K) -> DataFrame:
    """The k best rows per group; Spark limits each group before the shuffle."""
    score = F.col(score) if isinstance(score, str) else score
    window = Window.partitionBy(group).orderBy(score.desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def best_match(
    left: DataFrame, right: DataFrame, key: str, vector: str, right_key: str | None = None,
    block_rows: int = BLOCK_ROWS, metric: str = "cosine",
) -> DataFrame:
    """For each left row its most similar right row: (key, hit key, score)."""
    right_key = right_key or key
    hits = topk_join(
        keyed_vectors(left, key, vector, "l"), keyed_vectors(right, right_key, vector, "r"), 1,
        metric=metric, block_rows=block_rows, sizes=(row_bound(left), row_bound(right)),
    )
    return hits.select(
        F.col("l_key").alias(key), F.col("r_key").alias("hit_key"), F.col("score").alias("_raw")
    )


def attach_matches(
    hits: DataFrame, left: DataFrame, right: DataFrame, key: str, vector: str, right_key: str
) -> DataFrame:
    """Left columns, score to 3 decimals and the hit's columns under ``bestMatch-``."""
    scored = left.drop(vector, "score").join(hits, key).withColumn("score", round_fixed3("_raw"))
    return lookup_join(scored, right.drop(vector), "hit_key", right_key).drop("hit_key", "_raw")


def compare(left: DataFrame, right: DataFrame, key: str, vector: str, right_key: str | None = None) -> DataFrame:
    """Best-match table of two vector tables. Rows without a vector have no match row."""
    right_key = right_key or key
    hits = best_match(left, right, key, vector, right_key)
    return attach_matches(hits, left, right, key, vector, right_key)


def compare_pair(table: DataFrame, key: str, vector: str, selected: Sequence) -> DataFrame:
    """Two chosen rows side by side with their score; empty unless both have a vector."""
    rows = table.filter(F.col(key).isin(list(selected)) & F.col(vector).isNotNull())
    if len(selected) != 2:
        rows, selected = rows.limit(0), [None, None]
    first, second = selected
    plain = rows.drop("score")
    pick = lambda value: F.first(
        F.when(F.col(key) == F.lit(value), F.struct(*[F.col(f"`{c}`") for c in plain.columns])),
        ignorenulls=True,
    )
    # both rows come out of one scan and one aggregate, without a join
    paired = plain.agg(pick(first).alias("a"), pick(second).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    shown = [c for c in plain.columns if c != vector]
    return paired.select(
        round_fixed3(cosine(f"a.{vector}", f"b.{vector}")).alias("score"),
        *[F.col(f"a.`{c}`").alias(c) for c in shown],
        *[F.col(f"b.`{c}`").alias(c + "2") for c in shown],
    )


def knn_graph(table: DataFrame, key: str, vector: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest other rows of each row under 1 - cosine: (i, j, dist, rank)."""
    rows = row_bound(table)
    hits = topk_join(
        keyed_vectors(table, key, vector, "l"), keyed_vectors(table, key, vector, "r"), k,
        exclude_same=True, block_rows=block_rows, sizes=(rows, rows),
    )
    return hits.select(
        F.col("l_key").alias("i"), F.col("r_key").alias("j"), (1 - F.col("score")).alias("dist"), "rank"
    )


def pair_distances(
    table: DataFrame, key: str, vector: str, max_dist: float, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Pairs i < j no farther apart than ``max_dist`` under 1 - cosine.

    ``max_dist=2`` gives every pair, as a small table's distance matrix; the
    clustering operators here do not need it.
    """
    pairs = self_join(keyed_vectors(table, key, vector, "l"), 1 - max_dist, block_rows=block_rows, rows=row_bound(table))
    return pairs.select(
        F.col("l_key").alias("i"), F.col("r_key").alias("j"), (1 - F.col("score")).alias("dist")
    )
