"""Best-fit decreasing packing of token sequences of bounded length.

Documents are tokenized where they lie; pieces of a length are interchangeable for
packing, so the placement depends only on how many pieces each length has: at most
``capacity`` numbers, whatever the table. From these the exact global best-fit
decreasing placement is planned once, as ranges of piece ranks; every task then
looks its own pieces up.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scaling import cut_lineage
from .common import Recent, WordHasher, bound_batches, give_back

CAPACITY = 2048
CACHE_WORDS = 120_000
GATHER = 1 << 19
_BYTES = np.arange(256)
_LETTER = (_BYTES >= 97) & (_BYTES <= 122)
_SIGN = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER


class TightestBin:
    """A segment tree over remaining capacities: the smallest one, at least as asked, with an open bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, dtype=np.int64)

    def add(self, remaining: int, bins: int) -> None:
        at = self.size + remaining
        while at:
            self.open[at] += bins
            at >>= 1

    def find(self, least: int) -> int:
        """The tightest remaining capacity of an open bin, or -1: up to the first right sibling with bins, then down."""
        at = self.size + least
        if self.open[at]:
            return least
        while at > 1 and (at & 1 or not self.open[at ^ 1]):
            at >>= 1
        if at <= 1:
            return -1
        at ^= 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first bin, first offset, pieces per bin), sorted.

    Best fit decreasing, piece by piece: a piece goes to the tightest open bin. Bins with
    equal history are one run; as the bin just filled is again the tightest, a bin
    takes as many pieces of a length as fit before the next bin of its run is begun.
    """
    tree, runs, rows, bins = TightestBin(capacity), [[] for _ in range(capacity + 1)], [], 0

    def settle(remaining: int, first: int, number: int) -> None:
        if number and remaining:
            runs[remaining].append((first, number))
            tree.add(remaining, number)

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.find(length)
            if remaining < 0:
                remaining, first, number = capacity, bins, -(-left // (capacity // length))
                bins += number
            else:
                first, number = runs[remaining].pop()
                tree.add(remaining, -number)
            each = remaining // length
            full, part = divmod(min(left, number * each), each)
            rows.append((length, rank, first, capacity - remaining, each))
            settle(remaining - each * length, first, full)
            if part:
                settle(remaining - part * length, first + full, 1)
            used = full + bool(part)
            settle(remaining, first + used, number - used)
            rank += full * each + part
            left -= full * each + part
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


class WordTokenizer:
    """Token ids of texts; words are tokenized once and kept by their hash.

    The vocabulary is lower case, blanks always end a token, and so does a letter from a
    to z before an ASCII sign or digit: texts are lower-cased (A to Z) and cut there first, which
    leaves few words. A text that may spell a special token goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads only hold memory
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), Recent(CACHE_WORDS)
        self.hasher = WordHasher(lower=False, parts=(_LETTER, _SIGN))
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # tokens that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of words; those of letters only are joined, their ends are known by the last tokens."""
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        for low in range(0, len(plain), 4096):
            groups = [plain[k : k + 64] for k in range(low, min(low + 4096, len(plain)), 64)]
            codes = self.tokenizer.encode_batch_fast([" ".join(words[i] for i in g) for g in groups], add_special_tokens=False)
            for group, code in zip(groups, codes):
                ids = np.array(code.ids, dtype="<u4")
                ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
                if len(ends) == len(group):
                    for i, begin, end in zip(group, [0, *ends], ends):
                        out[i] = ids[begin:end].tobytes()
        rest = [i for i, own in enumerate(out) if own is None]
        for low in range(0, len(rest), 4096):
            part = rest[low : low + 4096]
            for i, code in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)):
                out[i] = np.array(code.ids, dtype="<u4").tobytes()
        return out

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Little-endian 32-bit ids per text."""
        raws = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        special = [i for i, r in enumerate(raws) if b"<|" in r]
        words = self.hasher([b"" if b"<|" in r else r.lower() for r in raws])
        named, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        names = named.tolist()
        fresh = set(self.words.unknown(set(names)))
        new = np.array([i for i, h in enumerate(names) if h in fresh], dtype=np.int64)
        spelled = [w.decode("utf-8") for w in words.spelled(at[new])]
        self.words.update(zip(named[new].tolist(), self._ids(spelled)))
        ids = [self.words[h] for h in names]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        begin = np.cumsum(sizes) - sizes
        size = sizes[back]
        ends = np.cumsum(size)
        tokens = flat[np.repeat(begin[back] - (ends - size), size) + np.arange(size.sum())]
        bounds = np.concatenate([[0], ends])[np.searchsorted(words.owner, np.arange(len(texts) + 1))]
        out = [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i in special:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u4")
        return out


def tokenized_pieces(docs: DataFrame, path: str, key: str, text: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Pieces of all documents, each with its rank among the equal lengths of its task."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]
    schema = f"k {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen, part = WordTokenizer(path), Counter(), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        def gathered() -> Iterator[pa.Table]:
            """Several batches, up to ``GATHER`` bytes: words that repeat in them are looked up once."""
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.column(1).nbytes
                if size >= GATHER:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, size = [], 0
            if held:
                yield pa.Table.from_batches(held).combine_chunks()

        for table in gathered():
            for own in table.to_batches():
                source, columns, ids = [], [], []
                for i, own_ids in enumerate(tokenizer(own.column(1).to_pylist())):
                    raw = np.concatenate([own_ids, end]).tobytes()
                    for number, at in enumerate(range(0, len(raw), 4 * capacity)):
                        code = raw[at : at + 4 * capacity]
                        length = len(code) // 4
                        source.append(i)
                        columns.append((number, at // 4, length, zlib.crc32(code), part, seen[length]))
                        seen[length] += 1
                        if keep_ids:
                            ids.append(narrowed(code))
                values = np.array(columns, dtype=np.int64).reshape(-1, 6)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                arrays = [own.column(0).take(pa.array(source, pa.int64()))]
                arrays += [pa.array(values[:, j], pa.int64()).cast(t) for j, t in enumerate(kinds)]
                names = ["k", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if keep_ids:
                    arrays.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
        del tokenizer
        give_back()

    return rows.mapInArrow(run, schema)


def narrowed(code: bytes) -> bytes:
    """32-bit ids as 16-bit ones where they all fit: what is written in between takes half the room."""
    ids = np.frombuffer(code, dtype="<u4")
    return ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else code


def widened(ids: pd.Series, length: pd.Series) -> pd.Series:
    """The 32-bit ids of narrowed ones; their size tells which they are."""
    return pd.Series([
        np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes() if len(raw) == 2 * n else raw
        for raw, n in zip(ids, length)], index=ids.index, dtype=object)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length, part, rank, more) with ``sequence_id`` and ``offset``; narrowed ``ids`` become 32-bit ones.

    ``rank`` numbers the pieces of one length inside one ``part`` from 0. Only counts per
    (part, length) are summed up; the plan has at most two rows per length
    and remaining capacity, so its size is bounded by the capacity alone. One function
    places and widens: a task with two would hold two Python workers.
    """
    counts = pieces.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = cut_lineage(offsets)
    table = plan({r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)

    own = [c for c in pieces.columns if c == "ids"]

    @F.pandas_udf("sequence_id bigint, offset bigint" + ", ids binary" * len(own))
    def place(length: pd.Series, rank: pd.Series, *ids: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        step = np.int64(1) << 48  # ranks stay below 2**48
        row = np.searchsorted(table[:, 0] * step + table[:, 1], n * step + r, side="right") - 1
        _, first, bin_, offset, each = table[row].T
        out = {"sequence_id": bin_ + (r - first) // each, "offset": offset + (r - first) % each * n}
        return pd.DataFrame(out | {"ids": widened(i, length).to_numpy() for i in ids})

    placed = pieces.join(offsets.drop("n"), ["part", "length"]).withColumn(
        "_place", place.asNondeterministic()("length", F.col("rank") + F.col("before"), *own)
    )
    kept = [F.col(f"_place.{c}" if c in own else c) for c in pieces.columns if c not in ("part", "rank")]
    return placed.select(*kept, "_place.sequence_id", "_place.offset")


def pack_documents(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    Every document is its token ids followed by ``end_id``; only documents longer than
    ``capacity`` are cut. Sequences hold at most ``capacity`` tokens and have no gaps.
    ``ids`` are little-endian 32-bit numbers; grouping by ``sequence_id`` and joining
    them by ``offset`` gives a sequence. A null or blank text is its end id
    alone. Null keys and repeated rows are packed like any others, an empty table gives
    an empty one, other columns are ignored, texts are tokenized whole.
    """
    bound_batches(docs)
    pieces = cut_lineage(tokenized_pieces(docs, path, key, text, capacity, end_id, keep_ids))
    return pack(pieces, capacity).withColumnRenamed("k", key)
