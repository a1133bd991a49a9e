"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scaling import scratch_path

# what counts as a word: a run without ASCII blanks
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 512
SEGMENT = 1 << 18  # bytes hashed at once; longer texts are cut at blanks
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ANY_BLANK = re.compile(rb"[\x20\x09-\x0D]")


@dataclass
class Words:
    """The words of several texts in order: 64-bit hash, text number, code points, place in ``raw``."""

    hash: np.ndarray
    owner: np.ndarray
    chars: np.ndarray
    segment: np.ndarray
    start: np.ndarray
    end: np.ndarray
    raw: list[bytes]

    def spelled(self, at: np.ndarray) -> list[bytes]:
        return [self.raw[k][i:j] for k, i, j in zip(self.segment[at].tolist(), self.start[at].tolist(), self.end[at].tolist())]


class WordHasher:
    """Hashes all words of many texts with array operations only.

    Every byte becomes a fixed random 64-bit number (A to Z like a to z when
    ``lower``) and every place in a word another one; a word's hash is the sum of their
    products, taken from prefix sums, so the cost does not depend on the number of words. (Powers
    of one base in place of the random factors give some long words the same hash whatever the base.) With ``parts``, two
    masks over bytes, a word also ends between a byte of the first and one of the second.
    """

    def __init__(self, lower: bool, parts: tuple[np.ndarray, np.ndarray] | None = None):
        self.parts = parts
        byte = np.arange(256, dtype=np.uint64)
        if lower:
            byte[65:91] += np.uint64(32)
        self.values = mix64(byte + np.uint64(1))
        self.factors = np.zeros(0, dtype=np.uint64)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``starts`` to ``ends``, in rising order and apart from each other."""
        n = len(data)
        if n > len(self.factors):
            self.factors = mix64(np.arange(1 << 40, (1 << 40) + max(n, 2 * SEGMENT), dtype=np.uint64)) | np.uint64(1)
        begin = np.zeros(n, dtype=np.int32 if n < 1 << 31 else np.int64)
        begin[starts] = starts
        place = np.arange(n, dtype=begin.dtype) - np.maximum.accumulate(begin)
        sums = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[data] * self.factors[place], out=sums[1:])
            return mix64(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))

    def _segment(self, raw: bytes) -> tuple[np.ndarray, ...]:
        """Hash, code points, start and end of the words of one segment."""
        data = np.frombuffer(raw, dtype=np.uint8)
        n = len(data)
        edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        if self.parts is not None:
            cut = np.flatnonzero(self.parts[0][data[:-1]] & self.parts[1][data[1:]]) + 1
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        value = self.hashes(data, starts, ends)
        heads = np.zeros(n + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        return value, heads[ends] - heads[starts], starts, ends

    def __call__(self, texts: Sequence[str | bytes | None]) -> Words:
        parts: list[tuple[np.ndarray, ...]] = []
        raws: list[bytes] = []
        held: list[bytes] = []
        first = size = 0

        def add(raw: bytes, owner: Callable[[np.ndarray], np.ndarray]) -> None:
            value, chars, starts, ends = self._segment(raw)
            parts.append((value, owner(starts), chars, np.full(len(value), len(raws)), starts, ends))
            raws.append(raw)

        def flush(upto: int) -> None:
            nonlocal held, size, first
            if held:
                begin = np.cumsum([0, *(len(r) + 1 for r in held)])
                add(b" ".join(held), lambda starts: first + np.searchsorted(begin, starts, side="right") - 1)
            held, size, first = [], 0, upto

        for i, text in enumerate(texts):
            raw = text if isinstance(text, bytes) else text.encode("utf-8", "replace") if text else b""
            if size + len(raw) > SEGMENT:
                flush(i)
            if len(raw) <= SEGMENT:
                held.append(raw)
                size += len(raw)
                continue
            at = 0
            while at < len(raw):
                cut = _ANY_BLANK.search(raw, at + SEGMENT)
                end = cut.start() if cut else len(raw)
                add(raw[at:end], lambda starts, i=i: np.full(len(starts), i))
                at = end
            first = i + 1
        flush(0)
        if not parts:
            parts.append((np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 5))
        return Words(*(np.concatenate(column) for column in zip(*parts)), raws)


class Recent(dict):
    """What is known of words, about twice ``limit`` of those met last."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.previous = limit, {}

    def unknown(self, words: set) -> list:
        """The words of which nothing is known yet; the others are at hand from now on."""
        if len(self) > self.limit:
            self.previous = dict(self)
            self.clear()
        fresh = []
        for w in words:
            if w not in self:
                if w in self.previous:
                    self[w] = self.previous[w]
                else:
                    fresh.append(w)
        return fresh


def temp_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name in taken:
        name = f"_{base}_{uuid.uuid4().hex[:8]}"
    return name


def bound_batches(df: DataFrame) -> None:
    """Fewer rows per Arrow batch in this session: texts may be long, and a Python worker holds whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if int(spark.conf.get(name)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Memory that a task has freed goes back to the system: its Python worker lives on, idle or in other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, but the folder can be given back before the driver ends, with ``free``."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def free(*frames: DataFrame) -> None:
    """Delete the folders of frames that ``cut`` has written and nothing reads any more."""
    for df in frames:
        if getattr(df, "scratch", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
            df.scratch = None


def filter_by(df: DataFrame, decision: Column) -> DataFrame:
    """Rows whose ``decision`` is true; the columns stay as they are.

    The decision is computed once, next to the row it belongs to, so rows with
    equal or null keys need no join.
    """
    bound_batches(df)
    name = temp_name(df, "decision")
    return df.withColumn(name, decision).filter(F.col(name)).drop(name)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of unsigned 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def crc_fold(key: str, modulus: int) -> Column:
    """crc32 of a key written as text, modulo ``modulus`` (null key: null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus
