"""Language-model scores: the probability of a text over all its subword segmentations.

An existing vocabulary with its scores says which pieces there are and weights the
segmentations at first: merge scores are ranks, so by Zipf's law piece r has weight
1 / (r + 1). One expectation step over the distinct training words turns this prior into
piece probabilities; a forward recursion in log space then sums over all
segmentations of a word. Pieces never cross a word's start, so a text's probability is the
product over its words, times that of the end.

Every word of the training texts is one more edge of its own lattice, from its start to its end,
weighted by its count less a discount; the mass so set free is what the edges of pieces share.
So the word statistics grow with the corpus, and new words are spelled in pieces.

Work on words is done once per distinct word. Texts are cut into chunks of some
megabytes; a chunk lists its distinct words once, its texts refer to them by number,
and the joined values come back to the chunk. A word is in a chunk at most once, so
no word is a hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scaling import cut_lineage
from .common import bound_batches, crc_fold, mix64

SPACE = "▁"
CHUNK_BYTES = 32 << 20
PRIOR_TOKENS = 1000.0  # what the vocabulary's own scores weigh, in tokens
SLOTS = 1 << 22
WORDS_AT_ONCE = 1 << 15
LN10 = np.log(10.0)


class Lattice:
    """All pieces at all places of many words at once, and recursions over them."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(p[3:5], 16)] = i
        self.end_id = next(i for i, (p, _, kind) in enumerate(pieces) if kind == 3 and p == "</s>")
        normal = [(i, p) for i, (p, _, kind) in enumerate(pieces) if kind == 1]
        self.longest = max(len(p) for _, p in normal)
        for seed in range(1, 1000):  # a multiplier under which no two pieces share a slot's mark
            self.seed = int(mix64(np.array([seed], dtype=np.uint64))[0] | 1)
            h = np.array([self._hash_one(p) for _, p in normal], dtype=np.uint64)
            if len(np.unique(h)) == len(h):
                break
        order = np.argsort(h >> np.uint64(42), kind="stable")
        self.hashes, self.ids = h[order], np.array([i for i, _ in normal], dtype=np.int64)[order]
        slot = (self.hashes >> np.uint64(42)).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange(SLOTS + 1)).astype(np.int32)
        self.deep = int((self.first[1:] - self.first[:-1]).max())
        self.prior = np.zeros(len(pieces))
        ranks = sorted((-s, i) for i, (_, s, kind) in enumerate(pieces) if kind == 1)
        for r, (_, i) in enumerate(ranks):
            self.prior[i] = 1.0 / (r + 1)
        self.prior[self.byte_ids] = 1.0 / len(ranks)
        self.prior[self.end_id] = 0.1
        self.prior /= self.prior.sum()

    def _hash_one(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h ^ ord(c)) * self.seed) % (1 << 64)
            h ^= h >> 29
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none."""
        at = self.first[(h >> np.uint64(42)).astype(np.int64)]
        out = np.full(len(h), -1, dtype=np.int64)
        for k in range(self.deep):
            spot = np.minimum(at + k, len(self.hashes) - 1)
            hit = self.hashes[spot] == h
            out[hit] = self.ids[spot[hit]]
        return out

    def edges(self, signs: np.ndarray) -> list[list[np.ndarray]]:
        """``signs``: (words, n) code points. edges[s][l - 1]: ids of the pieces that cover l signs from s.

        A sign that is no piece has id -2 - sign: its bytes.
        """
        n, out = signs.shape[1], []
        with np.errstate(over="ignore"):
            for s in range(n):
                h, row = np.zeros(len(signs), dtype=np.uint64), []
                for size in range(1, min(self.longest, n - s) + 1):
                    h = (h ^ signs[:, s + size - 1]) * np.uint64(self.seed)
                    h = h ^ (h >> np.uint64(29))
                    row.append(self._find(h))
                lone = row[0] < 0
                row[0][lone] = -2 - signs[lone, s].astype(np.int64)
                out.append(row)
        return out

    def _bytes(self, sign: int) -> np.ndarray:
        return self.byte_ids[list(chr(sign).encode("utf-8", "replace"))]

    def _logs(self, ids: np.ndarray, logp: np.ndarray) -> np.ndarray:
        out = np.where(ids >= 0, logp[np.maximum(ids, 0)], -np.inf)
        for code in np.unique(ids[ids < -1]):
            out[ids == code] = logp[self._bytes(-2 - int(code))].sum()
        return out

    def forward(self, edges: list[list[np.ndarray]], logp: np.ndarray) -> np.ndarray:
        """(n + 1, words): log probability of every prefix over all its segmentations."""
        n = len(edges)
        alpha = np.full((n + 1, len(edges[0][0])), -np.inf)
        alpha[0] = 0
        for s in range(n):
            for size, ids in enumerate(edges[s], 1):
                if (ids != -1).any():
                    alpha[s + size] = np.logaddexp(alpha[s + size], alpha[s] + self._logs(ids, logp))
        return alpha

    def expected(self, edges: list[list[np.ndarray]], logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts of the words, each as often as ``weight`` says."""
        n, alpha = len(edges), self.forward(edges, logp)
        beta = np.full_like(alpha, -np.inf)
        beta[n] = 0
        counts = np.zeros(len(logp))
        for s in range(n - 1, -1, -1):
            for size, ids in enumerate(edges[s], 1):
                if not (ids != -1).any():
                    continue
                through = self._logs(ids, logp) + beta[s + size]
                beta[s] = np.logaddexp(beta[s], through)
                share = np.exp(alpha[s] + through - alpha[n]) * weight
                known = ids >= 0
                counts += np.bincount(ids[known], weights=share[known], minlength=len(counts))
                for code in np.unique(ids[ids < -1]):
                    np.add.at(counts, self._bytes(-2 - int(code)), share[ids == code].sum())
        return counts


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, code points) of the words with their blank mark, grouped by length."""
    marked = [SPACE + w for w in words]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    for n in np.unique(sizes):
        spot = np.flatnonzero(sizes == n)
        step = max(1, (1 << 18) // int(n))
        for low in range(0, len(spot), step):
            part = spot[low : low + step]
            raw = "".join(marked[i] for i in part).encode("utf-32-le", "replace")
            yield part, np.frombuffer(raw, dtype="<u4").reshape(len(part), n).astype(np.uint64)


def gathered(frames: Iterator[pd.DataFrame], least: int = WORDS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``least`` rows and more, but the last: array steps on few words are all overhead."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= least:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def shortest(values: np.ndarray) -> bytes:
    """Non-negative numbers as bytes: their width, then the numbers in 1, 2 or 4 bytes each."""
    width = 1 if values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def discounted(tokens: int, distinct: int, once: int, twice: int) -> tuple[float, float]:
    """(what is taken off every count, the mass this sets free): absolute discounting, by the words met once and twice.

    With nothing to train on all mass is free.
    """
    if not tokens:
        return 0.0, 1.0
    discount = min(0.99, max(0.01, (once + 0.5) / (once + 2 * twice + 1)))
    return discount, discount * distinct / tokens


def _listed(docs: DataFrame, key: str, text: str, fold: tuple[int, int]) -> DataFrame:
    """Texts and distinct words by chunk, in one table.

    A text row has k, held, n, the steps between the numbers of its distinct words, and their counts; a word row has
    word, its number in the chunk and its training count there. The end is the empty word.
    """
    held = F.coalesce(crc_fold(key, fold[0]) == fold[1], F.lit(False))
    rows = docs.select(F.col(key).alias("k"), held.alias("held"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]
    schema = (
        f"chunk bigint, k {kind}, held boolean, n bigint, numbers binary, counts binary, "
        "word string, number int, c bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, size, index, trained = TaskContext.get().partitionId(), 0, 0, {}, Counter()

        def emit(**columns) -> pa.RecordBatch:
            n = max(len(c) for c in columns.values())
            columns["chunk"] = pa.array(np.full(n, (part << 32) | chunk), pa.int64())
            kinds = {"k": key_type, "held": pa.bool_(), "n": pa.int64(), "numbers": pa.binary(), "counts": pa.binary(),
                     "word": pa.string(), "number": pa.int32(), "c": pa.int64()}
            arrays = [columns["chunk"], *[
                c if isinstance(c := columns.get(name), pa.Array) else pa.array(c, t) if c is not None else pa.nulls(n, t)
                for name, t in kinds.items()]]
            return pa.RecordBatch.from_arrays(arrays, ["chunk", *kinds])

        def words() -> Iterator[pa.RecordBatch]:
            names = list(index)
            for low in range(0, len(names), 20000):
                own = names[low : low + 20000]
                yield emit(word=[w.decode("utf-8", "replace") for w in own], number=np.arange(low, low + len(own)),
                           c=[trained[w] for w in own])

        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            key_type, low = batch.column(0).type, 0
            texts, held_out = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            out = {"n": [], "numbers": [], "counts": []}
            for i, t in enumerate(texts):
                raw = t.encode("utf-8", "replace").lower() if t else b""
                found = Counter(raw.split())
                found[b""] = 1
                if not held_out[i]:
                    trained.update(found)
                out["n"].append(sum(found.values()))
                numbers = np.array([index.setdefault(w, len(index)) for w in found], dtype=np.int64)
                times, order = np.fromiter(found.values(), dtype=np.int64, count=len(found)), np.argsort(numbers)
                out["numbers"].append(shortest(np.diff(numbers[order], prepend=0)))
                out["counts"].append(shortest(times[order]))
                size += len(raw)
                if size >= CHUNK_BYTES or i == len(texts) - 1:
                    yield emit(k=batch.column(0).slice(low, i + 1 - low), held=held_out[low : i + 1], **out)
                    out, low = {"n": [], "numbers": [], "counts": []}, i + 1
                if size >= CHUNK_BYTES:
                    yield from words()
                    chunk, size, index, trained = chunk + 1, 0, {}, Counter()
        if index:
            yield from words()

    return rows.mapInArrow(run, schema)


def score_texts(
    docs: DataFrame, pieces: list[tuple[str, float, int]], key: str = "doc_id", text: str = "text",
    fold: tuple[int, int] = (7, 2),
) -> DataFrame:
    """One row per input row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(key) modulo ``fold[0]`` is ``fold[1]`` are held out of all learning. Texts
    are lower-cased (A to Z) and cut into words; the end is one more token. ``base_score`` is the
    add-one word model, ``score`` the base-ten logarithm of the text's probability over all
    segmentations into pieces and whole training words. A null or empty text is its end alone. Null keys are trained on,
    repeated rows count and are returned each, an empty table gives an empty one, other columns are
    ignored, and texts are read whole. With nothing to train on the vocabulary's own scores decide.
    """
    bound_batches(docs)
    listed = cut_lineage(_listed(docs, key, text, fold))
    uses = listed.filter("word IS NOT NULL").select("chunk", "word", "number", "c")
    counts = cut_lineage(uses.groupBy("word").agg(F.sum("c").alias("c")))
    total = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"),
        F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"),
    ).first()
    train_tokens, distinct = int(total["n"]), int(total["v"])
    discount, spelled = discounted(train_tokens, distinct, int(total["once"]), int(total["twice"]))
    lattice = Lattice(pieces)
    first = np.log(np.maximum(lattice.prior, 1e-300))

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(first))
        for batch in gathered(batches):
            # every word counts once: the pieces' share of its count is the discount, however often it was met
            for part, signs in _by_length(batch.word[batch.word != ""].tolist()):
                sums += lattice.expected(lattice.edges(signs), first, np.ones(len(part)))
            sums[lattice.end_id] += (batch.word == "").sum()
        used = np.flatnonzero(sums)
        yield pd.DataFrame({"piece": used, "expected": sums[used]})

    found = counts.filter("c > 0").mapInPandas(expect, "piece bigint, expected double").groupBy("piece").agg(
        F.sum(F.round("expected", 6)).alias("expected")
    )
    expected = np.zeros(len(first))
    for r in found.collect():  # one row per piece of the vocabulary at most
        expected[r["piece"]] = r["expected"]
    mass = expected + PRIOR_TOKENS * lattice.prior
    logp = np.log(np.maximum(mass / mass.sum(), 1e-300))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in gathered(batches):
            value = np.full(len(batch), logp[lattice.end_id])
            spot = np.flatnonzero((batch.word != "").to_numpy())
            names = batch.word.tolist()
            for part, signs in _by_length([names[i] for i in spot]):
                value[spot[part]] = lattice.forward(lattice.edges(signs), logp)[-1]
            # the word as one edge beside the paths over pieces
            counted = batch.c.to_numpy(dtype=np.float64)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(counted - discount, 0) / max(1, train_tokens))
                value = np.logaddexp(whole, value + np.log(spelled))
            yield pd.DataFrame({"word": batch.word, "c": batch.c, "lp": value / LN10})

    weighed = cut_lineage(counts.mapInPandas(weigh, "word string, c bigint, lp double"))
    values = uses.select("chunk", "number", "word").join(weighed, "word").select("chunk", "number", "c", "lp")
    texts = listed.filter("word IS NULL").select(F.col("chunk").alias("of_chunk"), "k", "held", "n", "numbers", "counts")
    kind = dict(texts.dtypes)["k"]
    under = float(train_tokens + distinct + 1)

    def add(texts: pa.Table, values: pa.Table) -> pa.Table:
        number = values["number"].to_numpy()
        c, lp = np.zeros(len(number), dtype=np.int64), np.zeros(len(number))
        c[number], lp[number] = values["c"].to_numpy(), values["lp"].to_numpy()
        base = np.log10((c + 1) / under)
        known, bases, scores = [], [], []
        for raw, times in zip(texts["numbers"].to_pylist(), texts["counts"].to_pylist()):
            at, n = np.cumsum(widened(raw)), widened(times)
            known.append(int(n[c[at] > 0].sum()))
            bases.append(float(base[at] @ n))
            scores.append(float(lp[at] @ n))
        return pa.table([
            texts["k"], texts["held"], texts["n"], pa.array(known, pa.int64()),
            pa.array(bases, pa.float64()), pa.array(scores, pa.float64()),
        ], names=["k", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = texts.groupBy("of_chunk").cogroup(values.groupBy("chunk")).applyInArrow(
        add, f"k {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select(
        F.col("k").alias(key), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
