"""Main text of web pages: a bidirectional LSTM labels every block from the whole page's sequence.

A block is read as a vector: the summed embeddings of the tag names and class words on its path, the
mean embedding of its hashed words, and a few measures. Two recurrent layers, one from the top and one
from the end of the page, give the chance that the block belongs to the article. The net is
trained in numpy on made-up pages (``html_training``), a bounded sample given by ``TRAIN_PAGES``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WordHasher
from .html_blocks import Block, blocks
from .html_training import KEEP, training_pages

PATH_SLOTS, PATH_WIDTH = 1 << 12, 16
WORD_SLOTS, WORD_WIDTH = 1 << 15, 8
MEASURES = 8
HIDDEN = 24
RANDOM_WORDS = 0.2  # share of the words that are swapped for others in training
TRAIN_PAGES, EPOCHS, BATCH, RATE = 3500, 6, 32, 6e-3
BLOCKS_AT_ONCE = 1 << 14  # padded places labelled in one go


@lru_cache(maxsize=1 << 15)
def slots(element: tuple[str, ...], innermost: bool) -> tuple[int, ...]:
    """Where the embeddings of an element's names are; the innermost element's tag counts as a name more."""
    names = [*element, f"<{element[0]}"] if innermost else element
    return tuple(zlib.crc32(name.encode()) % PATH_SLOTS for name in names)


class Features:
    """All blocks of several pages in one run: hashed names and words as flat lists with owners, and measures."""

    def __init__(self, pages: list[list[Block]], hasher: WordHasher):
        flat = [b for page in pages for b in page]
        self.sizes = np.array([len(p) for p in pages], dtype=np.int64)
        names = [[s for i, e in enumerate(b.path) for s in slots(e, i == len(b.path) - 1)] for b in flat]
        self.name = np.array([s for n in names for s in n], dtype=np.int64)
        self.name_owner = np.repeat(np.arange(len(flat)), [len(n) for n in names])
        words = hasher([b.text for b in flat])
        self.word, self.word_owner = (words.hash % np.uint64(WORD_SLOTS)).astype(np.int64), words.owner.astype(np.int64)
        self.n_words = np.maximum(np.bincount(self.word_owner, minlength=len(flat)), 1)
        chars = np.array([len(b.text) for b in flat], dtype=np.float64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        ends = np.array([b.text[-1] in ".!?…\"»”" for b in flat], dtype=bool)
        self.measures = np.stack([
            np.log1p(chars) / 4, np.log1p(self.n_words) / 3, [b.linked for b in flat], ends, chars / self.n_words / 10 < 0.4,
            np.minimum(place, 10) / 10, np.array([b.text[:1].isupper() for b in flat], dtype=bool), np.ones(len(flat)),
        ], axis=1).astype(np.float32) if flat else np.zeros((0, MEASURES), np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Layer:
    """An LSTM layer over sequences held as (time, page, feature); ``mask`` is 0 behind a page's end."""

    def __init__(self, w: np.ndarray, u: np.ndarray, b: np.ndarray, backwards: bool):
        self.w, self.u, self.b, self.backwards = w, u, b, backwards

    def forward(self, x: np.ndarray, mask: np.ndarray, learn: bool = False) -> np.ndarray:
        steps, pages, _ = x.shape
        n = self.u.shape[0]
        given = x @ self.w + self.b
        h = c = np.zeros((pages, n), x.dtype)
        out = np.empty((steps, pages, n), x.dtype)
        self.past = []
        for t in range(steps - 1, -1, -1) if self.backwards else range(steps):
            z = given[t] + h @ self.u
            gates = sigmoid(z[:, : 3 * n])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            c_new = m * (f * c + i * g) + (1 - m) * c
            bent = np.tanh(c_new)
            h_new = m * o * bent + (1 - m) * h
            if learn:
                self.past.append((t, h, c, i, f, o, g, bent, m))
            h, c = h_new, c_new
            out[t] = h
        return out

    def backward(self, x: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        n = self.u.shape[0]
        d_given = np.zeros((*x.shape[:2], 4 * n), x.dtype)
        d_u = np.zeros_like(self.u)
        d_h = d_c = np.zeros((x.shape[1], n), x.dtype)
        for t, h, c, i, f, o, g, bent, m in reversed(self.past):
            d_h = d_h + d_out[t]
            d_cell = d_c + m * d_h * o * (1 - bent * bent)
            own = m * d_cell
            d_z = np.concatenate([own * g * i * (1 - i), own * c * f * (1 - f), m * d_h * bent * o * (1 - o), own * i * (1 - g * g)], axis=1)
            d_given[t] = d_z
            d_u += h.T @ d_z
            d_h = (1 - m) * d_h + d_z @ self.u.T
            d_c = (1 - m) * d_cell + own * f
        flat = d_given.reshape(-1, 4 * n)
        return d_given @ self.w.T, [x.reshape(-1, x.shape[2]).T @ flat, d_u, flat.sum(axis=0)]


class Labeller:
    """The net and its weights: two embeddings, two layers, an output."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        width = PATH_WIDTH + WORD_WIDTH + MEASURES

        def normal(rows, columns):
            return (rng.normal(size=(rows, columns)) / np.sqrt(rows)).astype(np.float32)

        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
        # names and words never met in training keep the zero vector
        self.weights = [
            np.zeros((PATH_SLOTS, PATH_WIDTH), np.float32), np.zeros((WORD_SLOTS, WORD_WIDTH), np.float32),
            normal(width, 4 * HIDDEN), normal(HIDDEN, 4 * HIDDEN), bias, normal(width, 4 * HIDDEN), normal(HIDDEN, 4 * HIDDEN), bias.copy(),
            normal(2 * HIDDEN, 1), np.zeros(1, np.float32),
        ]

    def vectors(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(f.measures)
        path = np.zeros((n, PATH_WIDTH), np.float32)
        word = np.zeros((n, WORD_WIDTH), np.float32)
        for out, table, at, owner in ((path, self.weights[0], f.name, f.name_owner), (word, self.weights[1], f.word, f.word_owner)):
            if len(owner):  # owners rise: sums of runs
                start = np.flatnonzero(np.diff(owner, prepend=-1))
                out[owner[start]] = np.add.reduceat(table[at], start, axis=0)
        word /= (f.n_words + 1)[:, None].astype(np.float32)
        return np.tanh(path), np.tanh(word), f.measures

    def layers(self) -> tuple[Layer, Layer]:
        return Layer(*self.weights[2:5], False), Layer(*self.weights[5:8], True)

    def _padded(self, sizes: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        page = np.repeat(np.arange(len(sizes)), sizes)
        time = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        mask = np.zeros((int(sizes.max(initial=0)), len(sizes)), np.float32)
        mask[time, page] = 1
        return (time, page), mask

    def chances(self, f: Features) -> np.ndarray:
        """For every block the chance that it is part of the article; pages of like length go together."""
        x = np.concatenate(self.vectors(f), axis=1)
        out = np.empty(len(x), np.float32)
        begin = np.cumsum(f.sizes) - f.sizes
        order = [p for p in np.argsort(f.sizes, kind="stable") if f.sizes[p]]
        at = 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and (upto + 1 - at) * f.sizes[order[upto]] <= BLOCKS_AT_ONCE:
                upto += 1
            pages = np.array(order[at:upto])
            own = np.concatenate([np.arange(begin[p], begin[p] + f.sizes[p]) for p in pages])
            spot, mask = self._padded(f.sizes[pages])
            padded = np.zeros((*mask.shape, x.shape[1]), np.float32)
            padded[spot] = x[own]
            h = np.concatenate([layer.forward(padded, mask) for layer in self.layers()], axis=2)
            out[own] = sigmoid(h[spot] @ self.weights[8] + self.weights[9])[:, 0]
            at = upto
        return out

    def gradients(self, f: Features, wanted: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over the blocks, for every weight."""
        path, word, measures = self.vectors(f)
        spot, mask = self._padded(f.sizes)
        x = np.zeros((*mask.shape, PATH_WIDTH + WORD_WIDTH + MEASURES), np.float32)
        x[spot] = np.concatenate([path, word, measures], axis=1)
        both = self.layers()
        h = np.concatenate([layer.forward(x, mask, learn=True) for layer in both], axis=2)
        d_out = (sigmoid(h[spot] @ self.weights[8] + self.weights[9]) - wanted[:, None]) / len(wanted)
        d_h = np.zeros_like(h)
        d_h[spot] = d_out @ self.weights[8].T
        found = [layer.backward(x, d_h[:, :, k * HIDDEN : (k + 1) * HIDDEN]) for k, layer in enumerate(both)]
        d_x = (found[0][0] + found[1][0])[spot]
        d_path, d_word = np.zeros_like(self.weights[0]), np.zeros_like(self.weights[1])
        np.add.at(d_path, f.name, (d_x[:, :PATH_WIDTH] * (1 - path * path))[f.name_owner])
        d_word_sum = d_x[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] * (1 - word * word) / (f.n_words + 1)[:, None]
        np.add.at(d_word, f.word, d_word_sum[f.word_owner].astype(np.float32))
        return [d_path, d_word, *found[0][1], *found[1][1], h[spot].T @ d_out, d_out.sum(axis=0)]


def labelled(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks of made-up pages and whether each belongs to the article."""
    out = []
    for html in training_pages(n, seed):
        found = [b for b in blocks(html) if b.text.replace(KEEP, "").strip()]  # a page may be cut behind a mark
        wanted = np.array([KEEP in b.text for b in found], dtype=np.float32)
        out.append(([Block(b.text.replace(KEEP, "").strip(), b.path, b.linked) for b in found], wanted))
    return [(b, w) for b, w in out if b]


@lru_cache(maxsize=2)
def fit(seed: int = 0, pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Labeller:
    """A labeller trained on made-up pages, the same for the same arguments."""
    net, hasher = Labeller(seed), WordHasher(lower=True)
    sample = labelled(pages, seed)
    rng = np.random.default_rng(seed)
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    step, last = 0, epochs * -(-len(sample) // BATCH)
    by_size = np.argsort([len(b) for b, _ in sample], kind="stable")
    groups = [by_size[i : i + BATCH] for i in range(0, len(by_size), BATCH)]
    held = [(Features([sample[i][0] for i in g], hasher), np.concatenate([sample[i][1] for i in g])) for g in groups]
    for f, _ in held:  # so that no single word decides, nor one that shares its slot by chance
        chance = rng.random(len(f.word)) < RANDOM_WORDS
        f.word[chance] = rng.integers(0, WORD_SLOTS, int(chance.sum()))
    for _ in range(epochs):
        for g in rng.permutation(len(held)):
            step += 1
            rate = RATE * min(1, step / 50) * (1 - step / (last + 1)) ** 0.5
            for w, d, m, v in zip(net.weights, net.gradients(*held[g]), first, second):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def extract(htmls: list[str | None], net: Labeller, hasher: WordHasher) -> list[str]:
    """The main text of each page: its article blocks, one per line."""
    pages = [blocks(h) for h in htmls]
    keep = net.chances(Features(pages, hasher)) > 0.5
    out, at = [], 0
    for page in pages:
        out.append("\n".join(b.text for b, k in zip(page, keep[at : at + len(page)]) if k))
        at += len(page)
    return out


def extract_text(pages: DataFrame, net: Labeller, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars.

    ``text`` holds the blocks that the labeller takes for the article, one per line, as ``html_blocks.blocks``
    reads them from the whole page; empty where there are none, as for a null, empty or textless page.
    Null keys and urls and repeated rows are kept as they come; an empty table gives an empty
    one; other columns are not read.
    """
    named = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    out = T.StructType([
        T.StructField(key, named.schema["k"].dataType), T.StructField(url, named.schema["u"].dataType),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])
    arrow = to_arrow_schema(out)
    weights = net.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = Labeller(), WordHasher(lower=True)
        own.weights = weights
        for batch in batches:
            sizes = np.cumsum([len(h) if (h := v.as_py()) else 0 for v in batch.column(2)])
            # pages are labelled some megabytes at a time
            group = sizes // (4 << 20)
            for g in np.unique(group):
                part = batch.take(pa.array(np.flatnonzero(group == g)))
                texts = extract(part.column(2).to_pylist(), own, hasher)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return named.mapInArrow(run, out)
