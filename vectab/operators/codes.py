"""Search over stored two-bit codes by multi-index hashing; vectors are not read.

A code is cut into strings of eight dimensions. If two codes differ in at most m * (r + 1) - 1 bits, m being the
number of strings, one string differs in at most r bits: rows that share no near string need not be looked at.
Postings (string number, string, key, code) are laid out in folders by string number and leading bits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quant import hamming, sbq_code
from ..functions.vector import has_dim, lit_vector
from ..plans.scaling import cut_lineage
from ..sources.segments import SegmentLog
from .search import TOP_K

STRING_DIMS = 8
STRING_BITS = 2 * STRING_DIMS
FOLDER_ROWS = 1 << 20  # postings worth a folder of their own
MAX_HEAD_BITS = 8
SCAN_SHARE = 0.1  # beyond this share of all strings reading every code is cheaper


@dataclass
class CodeIndex:
    """``codes``: key, code. ``postings``: string, head, tail, key, code. A code is the list of its strings."""

    codes: DataFrame
    postings: DataFrame
    mean: list[float]
    std: list[float]
    head_bits: int


def strings_of(levels: Column, dims: int) -> Column:
    """The levels of a code as numbers of ``STRING_BITS`` bits; the last one is filled up with zero levels."""
    return F.array(*[
        F.aggregate(F.slice(levels, start + 1, min(STRING_DIMS, dims - start)), F.lit(0), lambda acc, c: acc * 4 + c)
        for start in range(0, dims, STRING_DIMS)
    ])


def save_codes(table: DataFrame, key: str, vector: str, mean: Sequence[float], std: Sequence[float], path: str) -> int:
    """Encode the vectors of the right dimension and write codes and postings as a new version; its number."""
    log, dims = SegmentLog(table.sparkSession, path), len(mean)
    rows = table.filter(F.col(vector).isNotNull() & has_dim(vector, dims)).select(
        F.col(key).alias("key"), strings_of(sbq_code(vector, mean, std), dims).alias("code"))
    kind = rows.schema["key"].dataType.simpleString()
    codes = log.write(rows)
    held = log.data(codes, f"key {kind}, code array<int>")
    n = held.count()
    # the folders grow with the postings, up to 256 for each string
    head_bits = min(MAX_HEAD_BITS, max(0, (n // FOLDER_ROWS).bit_length()))
    tail = 1 << (STRING_BITS - head_bits)
    postings = held.select("key", "code", F.posexplode("code").alias("string", "value")).select(
        "key", "code", F.floor(F.col("value") / tail).cast("int").alias("head"), (F.col("value") % tail).alias("tail"), "string")
    laid = postings.repartition("string", "head", F.pmod(F.col("tail"), F.lit(8))).sortWithinPartitions("string", "head", "tail")
    return log.commit({
        "codes": codes, "postings": log.write(laid, "string", "head"), "key": kind, "mean": list(mean), "std": list(std),
        "head_bits": head_bits, "rows": n,
    })


def load_codes(spark: SparkSession, path: str, version: int | None = None) -> CodeIndex:
    log = SegmentLog(spark, path)
    state = log.read(version)
    if state is None:
        raise ValueError(f"no codes at {path}")
    kind = state["key"]
    return CodeIndex(
        log.data(state["codes"], f"key {kind}, code array<int>"),
        log.data(state["postings"], f"key {kind}, code array<int>, tail int, string int, head int"),
        state["mean"], state["std"], state["head_bits"],
    )


def near_strings(value: int, flips: int) -> list[int]:
    """All strings that differ from ``value`` in at most ``flips`` bits."""
    return [
        value ^ sum(1 << b for b in spots)
        for n in range(flips + 1) for spots in itertools.combinations(range(STRING_BITS), n)
    ]


def search_codes(index: CodeIndex, query: Sequence[float], k: int = TOP_K) -> DataFrame:
    """(key, score): the k rows whose codes differ least from the query's, score = -distance, ties by smaller key.

    The strings of the query are looked up with 0, 1, 2, ... bits changed; rows found are compared on the
    whole code. Once the k-th distance is one that no other row can reach, the result is exact. When too many
    strings would have to be looked up, all codes are read instead.
    """
    dims = len(index.mean)
    if len(query) != dims:
        raise ValueError(f"the query has {len(query)} dimensions, the codes {dims}")
    spark = index.codes.sparkSession
    own = spark.range(1).select(strings_of(sbq_code(lit_vector(query), index.mean, index.std), dims).alias("code")).first()["code"]
    asked = F.array(*[F.lit(v) for v in own])
    apart = F.zip_with("code", asked, lambda a, b: F.bit_count(a.bitwiseXOR(b)))

    def best(rows: DataFrame) -> DataFrame:
        scored = rows.select("key", (-hamming("code", asked)).cast("long").alias("score"))
        return scored.orderBy(F.col("score").desc(), "key").limit(k)

    tail = 1 << (STRING_BITS - index.head_bits)
    flips = 0
    while sum(math.comb(STRING_BITS, n) for n in range(flips + 1)) <= SCAN_SHARE * (1 << STRING_BITS):
        wanted = [(s, v // tail, v % tail) for s, value in enumerate(own) for v in near_strings(value, flips)]
        probes = spark.createDataFrame(wanted, "string int, head int, tail int")
        hits = index.postings.filter(F.col("head").isin(sorted({head for _, head, _ in wanted}))).join(
            F.broadcast(probes), ["string", "head", "tail"], "left_semi")  # at most SCAN_SHARE of all strings, once per place
        # a row found by several strings counts by the first of them
        place = F.array_position(F.transform(apart, lambda bits: bits <= flips), True) - 1
        found = cut_lineage(best(hits.filter(F.col("string") == place)))
        reached = [-r["score"] for r in found.collect()]  # at most k rows
        if len(reached) == k and max(reached) <= len(own) * (flips + 1) - 1:
            return found.orderBy(F.col("score").desc(), "key")
        flips += 1
    return best(index.codes)
