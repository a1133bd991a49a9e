"""Language identification: averaged hashed subword embeddings, linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, filter_by, mix64, temp_name

UNKNOWN = "und"
BUCKETS = 1 << 14
DIM = 16
GRAMS = 5
SAMPLE_PER_LABEL = 600  # most labelled rows of one language the model is fitted on
WINDOW_WORDS = 24  # short training windows, so that short texts are known too
CACHE_WORDS = 150_000
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """What a prediction needs: per-bucket class scores (embedding times weights), calibration."""

    labels: list[str]
    bucket_scores: np.ndarray  # (BUCKETS, labels)
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 5-byte runs of every word between edge marks, and whose they are."""
    raw = ["<%s>" % w for w in words]
    data = np.frombuffer("".join(raw).encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(r.encode("utf-8", "replace")) for r in raw), dtype=np.int64, count=len(raw))
    owner = np.repeat(np.arange(len(raw)), sizes)
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(data), dtype=np.uint64)
        for n in range(1, GRAMS + 1):
            if len(data) < n:
                break
            h = h[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(n)
            inside = owner[: len(h)] == owner[n - 1 :]
            buckets.append((mix64(h[inside]) % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(owner[: len(h)][inside])
    return np.concatenate([np.zeros(0, np.int64), *buckets]), np.concatenate([np.zeros(0, np.int64), *owners])


def words_of(text: str | None) -> list[str]:
    """Lower-cased letter runs of a whole text."""
    return _LETTERS.findall(text.lower()) if text else []


def tokens_of(text: str | None) -> list[str]:
    """The same text cut at blanks only: faster, and the letter runs of a token are kept per token."""
    return text.lower().split() if text else []


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    buckets, counts = np.unique(subwords(words)[0], return_counts=True)
    return buckets, (counts / max(1, counts.sum())).astype(np.float32)


def fit(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 32, rate: float = 8.0, seed: int = 7) -> Model | None:
    """Stochastic gradient descent on whole texts and short windows of them.

    Every tenth text is left out of the descent and serves to calibrate: the
    temperature minimises its log loss, and the rejection threshold lets at least
    99.8 % of its right answers pass (never above one half).
    """
    pairs = [(w, y) for w, y in ((words_of(t), y) for t, y in zip(texts, labels)) if w]
    names = sorted({y for _, y in pairs})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    held = [p for i, p in enumerate(pairs) if i % 10 == 9]
    train = [p for i, p in enumerate(pairs) if i % 10 != 9]
    items, ys = [], []
    for words, y in train:
        starts = rng.integers(0, max(1, len(words) - WINDOW_WORDS), 2)
        for part in [words, *[words[s : s + WINDOW_WORDS] for s in starts]]:
            items.append(_bag(part))
            ys.append(names.index(y))
    ys = np.asarray(ys)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight = np.zeros((DIM, len(names)), dtype=np.float32)
    weight += rng.normal(0, 0.1, weight.shape).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    steps, step = epochs * -(-len(items) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(items))
        for at in range(0, len(items), batch):
            pick = order[at : at + batch]
            used, place = np.unique(np.concatenate([items[i][0] for i in pick]), return_inverse=True)
            bags = np.zeros((len(pick), len(used)), dtype=np.float32)
            row = np.repeat(np.arange(len(pick)), [len(items[i][0]) for i in pick])
            bags[row, place] = np.concatenate([items[i][1] for i in pick])
            hidden = bags @ embed[used]
            grad = _softmax(hidden @ weight + bias)
            grad[np.arange(len(pick)), ys[pick]] -= 1
            grad *= rate * (1 - step / steps) / len(pick)
            back = grad @ weight.T
            weight -= hidden.T @ grad
            bias -= grad.sum(axis=0)
            embed[used] -= bags.T @ back
            step += 1
    scores = embed @ weight
    temperature, threshold = 1.0, 0.0
    if held:
        logits = np.stack([share @ scores[buckets] + bias for buckets, share in (_bag(w) for w, _ in held)])
        truth = np.asarray([names.index(y) for _, y in held])
        loss = {}
        for t in np.geomspace(0.25, 8, 41):
            p = _softmax(logits / t)
            loss[t] = -np.log(np.clip(p[np.arange(len(truth)), truth], 1e-9, 1)).mean()
        temperature = float(min(loss, key=loss.get))
        p = _softmax(logits / temperature)
        right = p.argmax(axis=1) == truth
        if right.any():
            threshold = min(0.5, float(np.quantile(p.max(axis=1)[right], 0.002)))
    return Model(names, scores.astype(np.float32), bias, temperature, threshold)


class Predictor:
    """Scores whole texts; the sum of a word's subword scores is kept per word."""

    def __init__(self, model: Model | None):
        self.model, self.index = model, {}
        self.table = np.zeros((1024, len(model.labels) + 1)) if model else None

    def _learn(self, tokens: set[str]) -> None:
        """Table rows of tokens not met before: class score sums and, last, the number of subwords."""
        fresh = [w for w in tokens if w not in self.index]
        first = len(self.index)
        self.index.update(zip(fresh, range(first, first + len(fresh))))
        while len(self.index) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        runs = [_LETTERS.findall(w) for w in fresh]
        whose = np.repeat(np.arange(len(fresh)), [len(r) for r in runs])
        buckets, owner = subwords([r for rs in runs for r in rs])
        owner = whose[owner]
        for y in range(len(self.model.labels)):
            self.table[first : first + len(fresh), y] = np.bincount(
                owner, weights=self.model.bucket_scores[buckets, y], minlength=len(fresh))
        self.table[first : first + len(fresh), -1] = np.bincount(owner, minlength=len(fresh))

    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        pred, score, accepted = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        given = texts.tolist() if self.model else []
        for start in range(0, len(given), 256):
            tokens = [tokens_of(t) for t in given[start : start + 256]]
            if len(self.index) > CACHE_WORDS:
                self.index.clear()
            self._learn(set().union(*tokens))
            for i, own in enumerate(tokens, start):
                total = self.table[list(map(self.index.__getitem__, own))].sum(axis=0) if own else np.zeros(1)
                if not total[-1]:  # no letter
                    continue
                z = total[:-1] / total[-1] + self.model.bias
                p = _softmax(z[None, :] / self.model.temperature)[0]
                best = int(p.argmax())
                pred[i], score[i] = self.model.labels[best], min(1.0, float(p[best]))
                accepted[i] = score[i] >= self.model.threshold
        return pd.DataFrame({"lang_pred": pred, "score": score, "accepted": accepted})


def labelled_sample(docs: DataFrame, key: str, text: str, lang: str, per_label: int = SAMPLE_PER_LABEL) -> list:
    """At most ``per_label`` labelled texts per language, the same ones however the table is cut.

    Row counts per language set a hash bound that passes about twice the wanted
    rows; only those are shuffled and cut to the smallest hashes.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang).alias("l")).count().collect()}
    if not sizes:
        return []
    span = 1 << 30
    bound = F.lit(0)
    for label, n in sizes.items():
        bound = F.when(F.col("l") == label, F.lit(min(span, -(-2 * per_label * span // n) + 1))).otherwise(bound)
    h = F.pmod(F.xxhash64(F.col(key), F.lit("language sample")), F.lit(span))
    some = rows.select(F.col(lang).alias("l"), F.col(text).alias("t"), h.alias("h")).filter(F.col("h") < bound)
    order = Window.partitionBy("l").orderBy("h", F.xxhash64("t"))
    picked = some.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_label)
    return sorted((r["h"], r["l"], r["t"]) for r in picked.select("h", "l", "t").collect())


def fit_model(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fold: tuple[int, int] = (4, 2)) -> Model | None:
    """The model of the rows whose crc32(key) modulo ``fold[0]`` is not ``fold[1]``."""
    crc = F.crc32(F.col(key).cast("string").cast("binary")) % fold[0]
    sample = labelled_sample(docs.filter(F.coalesce(crc, F.lit(-1)) != fold[1]), key, text, lang)
    return fit([t for _, _, t in sample], [y for _, y, _ in sample])


def language_column(model: Model | None, text: str = "text") -> Column:
    """A struct (lang_pred, score, accepted) of a text column."""

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = Predictor(model)
        for batch in batches:
            yield predict(batch)

    return predicted.asNondeterministic()(text)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """One row per input row: key, held_out, lang_pred, score (0 to 1), accepted.

    A null text, or one without a letter, is ``und`` with score 0, and so is every
    text when no labelled row was there to learn from; ``und`` is never accepted.
    Other texts get a learned language; ``accepted`` is false where the
    calibrated score is below the model's threshold. Null keys count as not held
    out. Repeated rows give one row each, an empty table an empty one, and
    the text is read whole. No other column is an input.
    """
    bound_batches(docs)
    name = temp_name(docs, "lang")
    crc = F.crc32(F.col(key).cast("string").cast("binary")) % fold[0]
    held = F.coalesce(crc == fold[1], F.lit(False)).alias("held_out")
    return docs.select(F.col(key), held, language_column(model, text).alias(name)).select(key, "held_out", f"{name}.*")


def keep_known(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with their own columns only."""
    return filter_by(docs, language_column(model, text)["accepted"])
