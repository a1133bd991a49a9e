"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from ..plans.scaling import cut_lineage

TABLES, HASHES, PROBES = 6, 2, 2  # a vector lies in PROBES ** HASHES buckets of each table
BLOCK = 1024
PACK_ROWS = 8192  # rows a task compares at a time, on average
BUCKET_ROWS = 256  # wanted vectors per bucket; more rows use more hashes per bucket name


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the width is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x


def bucket_keys(vectors: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """(vectors, tables * PROBES ** hashes) bucket names.

    Each hash rotates with three rounds of random signs and a Hadamard transform and
    names the nearest corners of the cross-polytope: the largest coordinates with their
    signs. Buckets are the combinations of the nearest corners of all hashes.
    """
    width = 1 << max(3, (vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors
    out = []
    for table in range(tables):
        corners = []
        for h in range(hashes):
            signs = np.random.default_rng([17, table, h]).integers(0, 2, (3, width)) * 2.0 - 1
            y = x
            for s in signs:
                y = hadamard(y * s) / np.sqrt(width)
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :PROBES]
            corners.append(2 * near + (np.take_along_axis(y, near, axis=1) > 0))
        for combination in itertools.product(range(PROBES), repeat=hashes):
            name = np.full(len(x), table + 1, dtype=np.int64)
            for h, c in enumerate(combination):
                name = name * (2 * width) + corners[h][:, c]
            out.append(name)
    return np.stack(out, axis=1)


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = len(column[0]) if len(column) else 1
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # large values must not overflow when squared
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    Vectors are linked when their cosine, in double precision, is ``least`` or more; candidates share
    a bucket, every candidate pair is computed, in blocks of a bucket, and counted in one bucket only.
    Equal vectors are linked without being compared, so copies cost one row. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest key reachable. Null, empty and zero
    vectors, and those with a null or non-finite element, link with nothing and are their own
    component; so are vectors of different widths for each other. Repeated rows link with each
    other; a null key is never the smallest, and a component of null keys has a null id. An empty
    table gives an empty one; other columns, labels among them, are not read.
    """
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    usable = F.coalesce(good, F.lit(False))
    rows = vectors.select(F.col(key).alias("k"), F.when(usable, F.col(vector)).alias("v")).withColumn(
        "node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))
    )
    # equal vectors become one; the first of a hash is the vector, min and count are combined before the shuffle
    classes = cut_lineage(
        rows.filter("node IS NOT NULL").groupBy("node")
        .agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"), F.first("v").alias("v"))
        .withColumn("width", F.size("v"))
    )
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.min("width").alias("w")).first()
    # so many hashes that an even bucket holds about BUCKET_ROWS; each further hash doubles the tables to keep recall
    hashes, sides = HASHES, 2 << max(3, ((size["w"] or 1) - 1).bit_length())
    while size["n"] * PROBES**hashes / sides**hashes > BUCKET_ROWS:
        hashes += 1
    tables = TABLES << (hashes - HASHES)

    def name_buckets(batches):
        for batch in batches:
            arrays = []
            widths = batch.column(3).to_numpy()
            keys = [None] * len(widths)
            for w in np.unique(widths):
                spot = np.flatnonzero(widths == w)
                named = bucket_keys(unit_rows(batch.column(2).take(pa.array(spot))), tables, hashes)
                for i, own in zip(spot, named):
                    keys[i] = own
            arrays = [*batch.columns, pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "n", "v", "width", "keys"])

    kind = dict(classes.dtypes)["v"]
    named = classes.select("node", "n", "v", "width").mapInArrow(
        name_buckets, f"node bigint, n bigint, v {kind}, width int, keys array<bigint>"
    )
    named = cut_lineage(named)
    spread = named.select("node", "width", F.explode("keys").alias("bucket"))
    sizes = spread.groupBy("bucket", "width").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    sizes = cut_lineage(sizes.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")))
    rows_placed = sizes.agg(F.sum(F.col("members") * F.col("blocks"))).first()[0] or 0
    packs = max(1, -(-rows_placed // PACK_ROWS))  # a pack holds whole block pairs, many small or a few large ones
    placed = (
        named.select("node", "n", "v", "width", "keys", F.explode("keys").alias("bucket"))
        .join(sizes.drop("members"), ["bucket", "width"])
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "bucket", "width", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"),
            (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"),
            "node", "n", "v", "keys",
        )
        .withColumn("pack", F.pmod(F.xxhash64("bucket", "bi", "bj"), F.lit(packs)))
    )

    def link(group: pa.Table) -> pa.Table:
        node, n, bucket = group["node"].to_numpy(), group["n"].to_numpy(), group["bucket"].to_numpy()
        bi, bj = group["bi"].to_numpy(), group["bj"].to_numpy()
        left, right = (group[c].to_numpy(zero_copy_only=False) for c in ("left", "right"))
        unit = unit_rows(group["v"])
        keys = group["keys"].combine_chunks().flatten().to_numpy().reshape(len(node), tables, -1)
        order = np.lexsort((bj, bi, bucket))
        new = np.any([np.diff(c[order]) != 0 for c in (bucket, bi, bj)], axis=0)
        links, roots = np.zeros(len(node), dtype=np.int64), np.argsort(np.argsort(node))
        for own in np.split(order, np.flatnonzero(new) + 1):
            a, b = own[left[own]], own[right[own]]
            cosine = unit[a] @ unit[b].T
            i, j = np.nonzero(cosine >= least - 1e-9)
            if bi[own[0]] == bj[own[0]]:  # a block with itself: each pair once
                i, j = i[a[i] < b[j]], j[a[i] < b[j]]
            if not len(i):
                continue
            close = cosine[i, j] < least + 1e-9
            i, j = a[i], b[j]
            keep = ~close
            keep[close] = np.einsum("ij,ij->i", unit[i[close]], unit[j[close]]) >= least
            for low in range(0, len(i), 8192):  # of the buckets a pair shares, the one with the smallest name counts it
                p, q = keys[i[low : low + 8192]], keys[j[low : low + 8192]]
                shared = (p[:, :, :, None] == q[:, :, None, :]).any(axis=3)  # names of different tables differ
                smallest = np.where(shared, p, np.iinfo(np.int64).max).min(axis=(1, 2))
                keep[low : low + 8192] &= smallest == bucket[own[0]]
            i, j = i[keep], j[keep]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            # each linked row names the smallest row it can reach in this block: a star instead of all pairs
            while len(i):
                low = np.minimum(roots[i], roots[j])
                if (low == roots[i]).all() and (low == roots[j]).all():
                    break
                np.minimum.at(roots, i, low)
                np.minimum.at(roots, j, low)
        at = np.flatnonzero(links)
        return pa.table({"node": node[at], "links": links[at], "root": np.sort(node)[roots[at]]})

    found = cut_lineage(
        placed.groupBy("pack", "width").applyInArrow(link, "node bigint, links bigint, root bigint")
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("node <> root").selectExpr("node AS u", "root AS v").distinct()
    both = edges.union(edges.selectExpr("v AS u", "u AS v"))
    comps = connected_components(both.selectExpr("u AS node").distinct(), both)
    known = (
        classes.select("node", "n", "k").join(links, "node", "left").join(comps, "node", "left")
        .withColumn("comp", F.coalesce("component", "node"))
    )
    least_key = known.groupBy("comp").agg(F.min("k").alias("component_id"))
    ids = known.join(least_key, "comp").select(
        "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    return rows.select("k", "node").join(ids, "node", "left").select(
        F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("k")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
