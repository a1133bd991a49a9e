"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scaling import cut_lineage

SHARDS = 24
NODES = 256  # virtual nodes per shard


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Places of all virtual nodes in clockwise order, and the shard of each."""
    spots = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "little", signed=True), s)
        for s in range(shards) for v in range(nodes)
    )
    return np.array([p for p, _ in spots], dtype=np.int64), np.array([s for _, s in spots], dtype=np.int64)


def bounded_loads(counts: np.ndarray, owner: np.ndarray, shards: int) -> np.ndarray:
    """Rows (arc, first rank, shard, first slot), sorted: who takes which keys of an arc.

    ``counts`` has the keys of each arc, ``owner`` the shard whose virtual node ends it. A
    shard holds the mean, rounded down, and as many shards one more as the total
    needs, those with the most keys of their own. First every shard keeps its own
    keys, in ring order, up to its bound; then the keys beyond it go on clockwise, from
    node to node, to the first shards with room. At most one range per arc stays,
    and every further range fills a shard or ends an arc.
    """
    total, home = int(counts.sum()), np.bincount(owner, weights=counts, minlength=shards).astype(np.int64)
    bound = np.full(shards, total // shards)
    bound[np.argsort(-home, kind="stable")[: total % shards]] += 1
    used, rows, over = np.zeros(shards, dtype=np.int64), [], []
    for arc, (n, s) in enumerate(zip(counts.tolist(), owner.tolist())):
        stay = min(n, int(bound[s] - used[s]))
        if stay:
            rows.append((arc, 0, s, used[s]))
            used[s] += stay
        if n > stay:
            over.append((arc, stay, n - stay))
    for arc, rank, n in over:
        at = arc
        while n:
            at = (at + 1) % len(owner)
            s = owner[at]
            moved = min(n, int(bound[s] - used[s]))
            if moved:
                rows.append((arc, rank, s, used[s]))
                used[s] += moved
                rank, n = rank + moved, n - moved
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shards differ by at most one row. ``size`` is the UTF-8 length
    of the text plus 8. A key hashes to an arc of the ring, so rows with equal keys,
    and null keys, share an arc; the arc is cut, in the order of the key hashes, where its shard is full, so no key
    can overfill a shard and the same rows in other files go to the same shards. Equal texts lie wherever their keys put them. ``slot`` is gapless
    from 0 in each shard. ``grown_shard`` is null under this law. A null text has size
    8 and checksum 0. With fewer rows than shards some shards stay empty; an
    empty table gives an empty one. Other columns are not read.
    """
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("k"), (F.length(t) + 8).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
        F.xxhash64(F.col(key), F.lit("shard")).alias("h"), F.monotonically_increasing_id().alias("tie"),
    )
    # in ring order, so that ranks inside an arc do not depend on the files, and an arc lies in one task or a few
    # neighbouring ones; rows that repeat differ by ``tie`` alone, which spreads them
    around = ["h", "text_crc32", "size", "tie"]
    rows = rows.repartitionByRange(*around).sortWithinPartitions(*around).drop("tie")
    places, owner = ring(shards, nodes)
    arcs = len(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(arcs, dtype=np.int64), TaskContext.get().partitionId()
        for batch in batches:
            arc = np.searchsorted(places, batch.column(3).to_numpy()) % arcs
            order = np.argsort(arc, kind="stable")
            first = np.searchsorted(arc[order], arc[order])
            rank = np.empty(len(arc), dtype=np.int64)
            rank[order] = np.arange(len(arc)) - first + seen[arc[order]]
            seen += np.bincount(arc, minlength=arcs)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.full(len(arc), part, dtype=np.int32)), pa.array(arc.astype(np.int32)), pa.array(rank)],
                ["k", "size", "text_crc32", "part", "arc", "rank"])

    kind = dict(rows.dtypes)["k"]
    ranked = cut_lineage(rows.mapInArrow(run, f"k {kind}, size bigint, text_crc32 bigint, part int, arc int, rank bigint"))
    # only counts per task and arc are summed up, about as many as tasks and arcs; the plan is bounded by the ring
    counts = ranked.groupBy("part", "arc").agg((F.max("rank") + 1).alias("n"))
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    sizes = np.zeros(arcs, dtype=np.int64)
    for r in offsets.groupBy("arc").agg(F.sum("n").alias("n")).collect():
        sizes[r["arc"]] = r["n"]
    table = bounded_loads(sizes, owner, shards)

    @F.pandas_udf("shard int, slot bigint")
    def place(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        step = np.int64(1) << 45
        a, r = arc.to_numpy().astype(np.int64), rank.to_numpy()
        row = np.searchsorted(table[:, 0] * step + table[:, 1], a * step + r, side="right") - 1
        _, first, shard, slot = table[row].T
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot + r - first})

    placed = ranked.join(offsets.drop("n"), ["part", "arc"]).withColumn(
        "_place", place.asNondeterministic()("arc", F.col("rank") + F.col("before"))
    )
    return placed.select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "_place.*",
        F.lit(None).cast("int").alias("grown_shard"),
    )
