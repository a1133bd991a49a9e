"""Near-duplicate texts: fast similarity sketches, banding, verification on full shingle sets.

Plan of a run:

1. Every text becomes its set of word shingles, a 128-bit fingerprint of the set
   and a sketch. Texts with the same set form one class from here on, so copies
   cost one row each and never a pair.
2. Sketch coordinates are cut into bands. Each band bucket proposes its members
   to its smallest member, the hub, only: linear in the bucket, whatever its size.
3. Each member is verified against one hub first, on the full sets, and against its other hubs
   only where that left them in different components. A hub's text travels once for many members.
4. Buckets that still hold several components are opened: blocks of their members compare sketches and
   name the members that may have a link to another component; those come back with their sets, are
   verified block by block, and only links that join components leave the task. So no link between two
   components is lost to the star shape of step 2, and a crowd just below the limit costs time but no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from ..plans.scaling import salted_join
from .common import WordHasher, bound_batches, cut, free, mix64, temp_name

ROWS, BANDS = 7, 48  # a pair at similarity 0.8 shares no band with probability 1.2e-5
WIDTH = ROWS * BANDS
SLACK = 0.09  # 4.1 standard deviations of a sketch estimate at 0.8: missed with probability 2e-5
BLOCK = 2048  # members compared at once inside an opened bucket
HUBS = (1, 0)  # hubs that a member is verified against in each round; 0: all that are left
PACK_ROWS = 2000  # texts that a task verifies at a time, on average


class Shingler:
    """Sets of hashed word shingles of texts, lower-cased from A to Z."""

    def __init__(self, size: int):
        self.size, self.hasher = size, WordHasher(lower=True)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct 64-bit hashes per text; shorter texts are one shingle, blank ones none."""
        words = self.hasher(texts)
        ends = np.searchsorted(words.owner, np.arange(len(texts)), side="right")
        out, at = [], 0
        window = self._windows(words.hash, self.size)
        for end in ends.tolist():
            n = end - at
            if n >= self.size:
                out.append(np.unique(window[at : end - self.size + 1]))
            else:
                out.append(self._windows(words.hash[at:end], n) if n else np.zeros(0, dtype=np.uint64))
            at = end
        return out

    @staticmethod
    def _windows(h: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            window = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64)
            for k in range(n):
                window = mix64(window * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(window)])
        return window


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def fast_sketch(shingles: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Fast similarity sketch: every coordinate is filled after at most 2 * width rounds.

    Round i < width throws each element into one bin by a fresh hash and keeps the
    smallest (round, value) per bin; it stops when no bin is empty. If bins are still
    empty after ``width`` rounds, round width + b gives bin b the smallest
    value of all elements. Two sets agree in a coordinate with probability
    equal to their similarity, with Chernoff-like concentration.
    """
    sketch = np.full(width, np.iinfo(np.uint64).max, dtype=np.uint64)
    low = np.uint64((1 << 40) - 1)
    # a later round never lowers a filled bin, so several rounds can be thrown at once
    step = int(min(width, 1 + 1.2 * width * np.log(width) / len(shingles)))
    for start in range(0, width, step):
        rounds = np.arange(start, min(width, start + step), dtype=np.uint64)[:, None]
        h = mix64(shingles[None, :] ^ mix64(rounds + np.uint64(1)))
        bins = (h >> np.uint64(40)) % np.uint64(width)
        np.minimum.at(sketch, bins.ravel().view(np.int64), ((rounds << np.uint64(40)) | (h & low)).ravel())
        empty = sketch == np.iinfo(np.uint64).max
        if not empty.any():
            return sketch
    for b in np.flatnonzero(empty):
        h = mix64(shingles ^ mix64(np.array([width + b + 1], dtype=np.uint64)))
        sketch[b] = (np.uint64(width + b) << np.uint64(40)) | (h & low).min()
    return sketch


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(texts, BANDS) bucket names; the band's number is part of the name."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketches), BANDS))
    with np.errstate(over="ignore"):
        for column in np.moveaxis(sketches.reshape(-1, BANDS, ROWS), 2, 0):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def node_of(shingles: np.ndarray) -> int:
    """Half of the set's fingerprint: the class of all texts with this set."""
    return int.from_bytes(fingerprint(shingles)[:8], "little", signed=True)


def sketched(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(k, th, n_shingles, node, keys, sketch); th hashes the text, node its set.

    The sketch keeps 16 bits of each coordinate, enough to count agreements.
    """
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]
    schema = f"k {kind}, th bigint, n_shingles bigint, node bigint, keys array<bigint>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                own = batch.slice(low, 1000)
                sets = shingle(own.column(2).to_pylist())
                full = [s for s in sets if len(s)]
                sketches = np.stack([fast_sketch(s) for s in full]) if full else np.zeros((0, WIDTH), dtype=np.uint64)
                short = mix64(sketches).astype(np.uint16)
                keys, spot = list(band_keys(sketches)), count()
                at = [next(spot) if len(s) else None for s in sets]
                counts = [len(s) for s in sets]
                nodes = [node_of(s) if len(s) else None for s in sets]
                keys = [None if i is None else keys[i] for i in at]
                sketches = [None if i is None else short[i].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    ["k", "th", "n_shingles", "node", "keys", "sketch"])

    return rows.mapInArrow(run, schema)


def alike(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    """Whether two sorted sets have ``share`` hundredths of their union in common."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < share * len(large):
        return False
    spot = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[spot] == small))
    return 100 * both >= share * (len(a) + len(b) - both)


def sets_of(nodes: list[int], texts: list[str], shingle: Shingler) -> list[np.ndarray | None]:
    """The set of each text, None where it is not the set of its class."""
    out: list[np.ndarray | None] = []
    for low in range(0, len(texts), 500):
        for node, own in zip(nodes[low : low + 500], shingle(texts[low : low + 500])):
            out.append(own if len(own) and node_of(own) == node else None)
    return out


def verified(pairs: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """The (u, v) whose full sets are similar enough; u is a hub of many v.

    ``texts``: node, t. The members of a hub are dealt to shares, each with one copy of the hub, and a task
    gets packs of many small stars or a part of a large one.
    """
    pairs = cut(pairs)
    load = cut(pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PACK_ROWS).cast("int").alias("shares")))
    packs = max(1, -(-pairs.count() // PACK_ROWS))
    members = salted_join(pairs, load, ["u"], spread="v").select(
        "u", F.pmod(F.xxhash64("v"), F.col("shares")).cast("int").alias("share"), F.col("v").alias("node"))
    hubs = load.select("u", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("u").alias("node"))
    rows = members.unionByName(hubs).withColumn("pack", F.pmod(F.xxhash64("u", "share"), F.lit(packs)))

    def run(group: pa.Table) -> pa.Table:
        u, part, node = (group[c].to_pylist() for c in ("u", "share", "node"))
        own = sets_of(node, group["t"].to_pylist(), Shingler(size))
        middle = {(a, p): s for a, p, n, s in zip(u, part, node, own) if a == n and s is not None}
        found = [
            (a, n) for a, p, n, s in zip(u, part, node, own)
            if a != n and s is not None and (a, p) in middle and alike(middle[a, p], s, share)
        ]
        out = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": out[:, 0], "v": out[:, 1]})

    found = cut(rows.join(texts, "node").groupBy("pack").applyInArrow(run, "u bigint, v bigint"))
    free(pairs, load)
    return found


def _components(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return cut(connected_components(both.select(F.col("u").alias("node")).distinct(), both))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    cu, cv = (comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "uv")
    known = salted_join(salted_join(pairs, cu, ["u"], "v", "left"), cv, ["v"], "u", "left")
    return known.filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def _opened(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (bucket, band, node, comp) of buckets with several components, dealt to blocks.

    Only pairs across components matter. The members of a bucket's largest component are
    dealt to blocks of about ``BLOCK`` and never meet each other; the others are dealt to blocks
    of their own, numbered first, and meet all blocks. ``upto`` is the last block a row meets. A
    bucket of at most ``BLOCK`` members is one block.
    """
    placed = members.join(comps, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("comp"))
    per_comp = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_comp.groupBy("bucket").agg(
        F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("total"),
    ).filter(F.col("main.n") < F.col("total"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    one = F.col("total") <= BLOCK
    sizes = sizes.select(
        "bucket", F.col("main.comp").alias("main"),
        F.when(one, 1).otherwise(blocks(F.col("total") - F.col("main.n"))).alias("others"),
        F.when(one, 0).otherwise(blocks(F.col("main.n"))).alias("mains"),
    )
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    apart = (F.col("comp") == F.col("main")) & (F.col("mains") > 0)
    return placed.join(sizes, "bucket").select(
        "bucket", "band", "node", "comp",
        F.when(apart, F.col("others") + spread(F.col("mains"))).otherwise(spread(F.col("others"))).alias("mine"),
        F.when(apart, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1).alias("upto"),
    )


def plausible(same: np.ndarray, band: int, share: int) -> np.ndarray:
    """Which rows of sketch agreements may belong to linked pairs that share no band before ``band``."""
    fits = np.count_nonzero(same, axis=1) >= (share / 100 - SLACK) * same.shape[1]
    at = np.flatnonzero(fits)
    fits[at] = ~same[at, : band * ROWS].reshape(len(at), band, ROWS).all(axis=2).any(axis=1)
    return fits


def _live(rows: DataFrame, sketches: DataFrame, share: int) -> DataFrame:
    """The dealt rows of opened buckets that may have a link to another component in their block pair.

    ``rows``: those of ``_opened``. A task sees two blocks, so no bucket is gathered whole, and returns no more rows
    than it got. A pair counts in the first band that it shares only.
    """
    placed = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("upto")))).select(
        "bucket", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"),
        (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"),
        "band", "node", "comp",
    )
    packs = _packs(placed)

    def run(group: pa.Table) -> pa.Table:
        keep = np.zeros(len(group), dtype=bool)
        for own, left, right, band, comp, sketch in _blocks(group):
            for i in left:
                fits = plausible(sketch[right] == sketch[i], band, share) & (comp[right] != comp[i])
                if fits.any():
                    keep[own[i]] = True
                    keep[own[right[fits]]] = True
        return group.select(["pack", "bucket", "bi", "bj", "left", "right", "band", "node", "comp"]).filter(pa.array(keep))

    dealt = placed.withColumn("pack", F.pmod(F.xxhash64("bucket", "bi", "bj"), F.lit(packs))).join(sketches, "node")
    return dealt.groupBy("pack").applyInArrow(run, dealt.drop("sketch").select(
        "pack", "bucket", "bi", "bj", "left", "right", "band", "node", "comp").schema)


def _packs(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // PACK_ROWS))


def _blocks(group: pa.Table) -> Iterator[tuple]:
    """Block pairs of a pack: the rows' places, those of the left and right side within them, band, comp and sketches."""
    bucket, bi, bj = (group[c].to_numpy() for c in ("bucket", "bi", "bj"))
    left, right = (group[c].to_numpy(zero_copy_only=False) for c in ("left", "right"))
    comp, band = group["comp"].to_numpy(), group["band"].to_numpy()
    order = np.lexsort((bj, bi, bucket))
    new = np.any([np.diff(c[order]) != 0 for c in (bucket, bi, bj)], axis=0)
    raw = group["sketch"].combine_chunks()
    for own in np.split(order, np.flatnonzero(new) + 1):
        sketch = np.stack([np.frombuffer(raw[int(i)].as_py(), dtype=np.uint16) for i in own])
        yield own, np.flatnonzero(left[own]), np.flatnonzero(right[own]), int(band[own[0]]), comp[own], sketch


def _joined(live: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """Links (u, v) that join the components of live rows: at most one per row, verified on the full sets."""
    def run(group: pa.Table) -> pa.Table:
        nodes, out = group["node"].to_numpy(), []
        sets = sets_of(nodes.tolist(), group["t"].to_pylist(), Shingler(size))
        for own, left, right, band, comp, sketch in _blocks(group):
            _, root = np.unique(comp, return_inverse=True)
            for i in left:
                fits = right[plausible(sketch[right] == sketch[i], band, share)]
                for j in fits.tolist():
                    a, b = sets[own[i]], sets[own[j]]
                    if root[i] != root[j] and a is not None and b is not None and alike(a, b, share):
                        out.append((nodes[own[i]], nodes[own[j]]))
                        root[root == root[j]] = root[i]
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    packs = _packs(live)
    rows = live.withColumn("pack", F.pmod(F.xxhash64("bucket", "bi", "bj"), F.lit(packs)))
    return rows.join(sketches, "node").join(texts, "node").groupBy("pack").applyInArrow(run, "u bigint, v bigint")


def resolved(docs: DataFrame, key: str, text: str, size: int, share: int) -> DataFrame:
    """(k, th, n_shingles, node, component_id, first): one row per input row.

    ``first`` is the row of the component, (no key, k, th), that comes first.
    """
    bound_batches(docs)
    rows = cut(sketched(docs, key, text, size))
    named_rows = rows.filter("node IS NOT NULL")
    order = F.struct(F.col("k").isNull().alias("no_k"), "k", "th")
    classes = cut(named_rows.groupBy("node").agg(F.min(order).alias("first"), F.first("keys").alias("keys")))
    buckets = classes.select("node", F.posexplode("keys").alias("band", "bucket"))
    hubs = (
        buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size"))
        .filter("hub <> last").drop("last")
    )
    shared = cut(buckets.join(hubs, "bucket"))
    todo = cut(shared.filter("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct())
    # the text of one row of each class that shares a bucket
    wanted = classes.select("node", "first").join(shared.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("first.k").alias("wk"), F.col("first.th").alias("wh"))
    given = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("th"))
    texts = cut(given.join(wanted, F.col("k").eqNullSafe(F.col("wk")) & (F.col("th") == F.col("wh"))).select("node", "t").dropDuplicates(["node"]))
    members = shared.filter("size > 2").select("bucket", "band", "node")  # with two, the only pair is tried
    nearest = Window.partitionBy("v").orderBy("u")
    links, comps = None, None
    for most in HUBS:
        rest = todo if comps is None else cut(_apart(todo, comps))
        now = rest.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= most).drop("rank") if most else rest
        found = verified(now, texts, size, share)
        links = found if links is None else links.unionByName(found)
        if comps is not None:
            free(comps)
        comps = _components(links)
        if rest is not todo:
            free(todo)
        todo = cut(rest.join(now, ["u", "v"], "left_anti")) if most else rest
        free(rest)
    opened = cut(_opened(members, comps))
    if not opened.isEmpty():
        of_node = named_rows.select("node", "sketch").join(opened.select("node").distinct(), "node", "left_semi")
        sketches = cut(of_node.dropDuplicates(["node"]))
        live = cut(_live(opened, sketches, share).drop("pack"))
        more = cut(_joined(live, sketches, texts, size, share))
        free(live, sketches)
        if not more.isEmpty():
            comps = _components(links.unionByName(more))
    free(opened, shared, texts)
    named = classes.select("node", "first").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    least = named.groupBy("comp").agg(F.min("first").alias("first"))
    ids = named.select("node", "comp").join(least, "comp").select("node", "first")
    return rows.select("k", "th", "n_shingles", "node").join(ids, "node", "left").select(
        "k", "th", "n_shingles", "node", "first",
        F.when(F.col("node").isNull(), F.col("k")).otherwise(F.col("first.k")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, share: int = 80) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept.

    Texts are lower-cased (A to Z), cut into words and taken as sets of
    ``size``-word shingles; a shorter text is one shingle. Two texts are linked when
    100 * intersection >= ``share`` * union, confirmed on the full sets.
    ``component_id`` is the smallest key reachable by links, ``kept`` marks rows
    that have it. Null and blank texts have an empty set, link with nothing and are
    their own component. Rows with equal sets are linked; of repeated rows with the
    smallest key each is marked kept. A null key is never the smallest; a component of
    null keys has a null id and its rows are marked kept. An empty table gives an
    empty one, other columns are ignored, and texts of any length are read whole.
    """
    return resolved(docs, key, text, size, share).select(
        F.col("k").alias(key), "n_shingles", "component_id",
        F.col("k").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, share: int = 80) -> DataFrame:
    """One row of ``docs`` per component, with its own columns only.

    Rows with an empty set all stay. Of rows equal in key and text one stays.
    """
    decided = resolved(docs, key, text, size, share)
    stays = F.col("node").isNull() | (F.col("first.k").eqNullSafe(F.col("k")) & (F.col("first.th") == F.col("th")))
    gone = decided.filter(~stays).select(F.col("k").alias("_gone"), "th").distinct()
    name = temp_name(docs, "th")
    rows = docs.withColumn(name, F.xxhash64(text))
    left = rows.join(gone, rows[key].eqNullSafe(gone["_gone"]) & (rows[name] == gone["th"]), "left_anti")
    # only rows whose key and text occur twice meet; the others go straight through. Blank texts are told apart by no set
    twice = decided.filter(stays & F.col("node").isNotNull()).groupBy("k", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = twice.select(F.col("k").alias("_k"), F.col("th").alias("_th"))
    again = left[key].eqNullSafe(twice["_k"]) & (left[name] == twice["_th"])
    once = left.join(twice, again, "left_anti")
    return once.unionByName(left.join(twice, again, "left_semi").dropDuplicates([key, name])).drop(name)
