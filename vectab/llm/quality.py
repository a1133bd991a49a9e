"""Quality rules on repetition: text inside duplicated word runs and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, bound_batches, filter_by, mix64, temp_name

BASE_WORDS, BASE_GRAM, BASE_SHARE = 20, 8, 0.30
# run length in words -> largest share of a text's characters inside runs found twice or more
GRAM_SHARES = {3: 0.50, 5: 0.35, 10: 0.25}
LINE_SHARE = 0.30  # largest share of line characters in lines equal to an earlier one
CHUNK_CHARS = 1 << 21

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    + "".join(f"gram_chars_{n} bigint, " for n in GRAM_SHARES)
    + "line_chars bigint, dup_line_chars bigint, base_failed boolean, kept boolean"
)
_SYMBOLS, _BLANKS = "#*$%&|<>", " \t\n\v\f\r"


def repeated_windows(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words that lie in an n-word window found twice or more in their text.

    The window hashes roll: each is the previous prefix sum's difference scaled
    back by a power of an odd base, all modulo 2**64. The owner is mixed in, so
    windows of different texts never meet.
    """
    covered = np.zeros(len(hashes), dtype=bool)
    if len(hashes) < n:
        return covered
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        window = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        for k in range(n):
            window = window * base + hashes[k : k + len(window)]
        window = mix64(window) ^ mix64(owner[: len(window)].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    inside = np.flatnonzero(owner[: len(window)] == owner[n - 1 :])
    again = pd.Series(window[inside]).duplicated(keep=False).to_numpy()
    steps = np.zeros(len(hashes) + 1, dtype=np.int32)
    np.add.at(steps, inside[again], 1)
    np.add.at(steps, inside[again] + n, -1)
    return np.cumsum(steps[:-1]) > 0


def _line_counts(text: str) -> tuple[int, int, int]:
    seen, dups, chars, dup_chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            chars += len(line)
            if line in seen:
                dups += 1
                dup_chars += len(line)
            else:
                seen.add(line)
    return dups, chars, dup_chars


def _measure_chunk(texts: list[str], hasher: WordHasher) -> pd.DataFrame:
    docs, words = len(texts), hasher(texts)
    owner, lengths = words.owner, words.chars
    counts = np.bincount(owner, minlength=docs)

    def per_doc(mask: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        picked = None if weights is None else weights[mask].astype(np.float64)
        return np.bincount(owner[mask], weights=picked, minlength=docs).astype(np.int64)

    everything = np.ones(len(owner), dtype=bool)
    lines = [_line_counts(t) for t in texts]
    out = pd.DataFrame({
        "n_words": counts,
        "word_chars": per_doc(everything, lengths),
        "n_symbols": [sum(map(t.count, _SYMBOLS)) for t in texts],
        "n_dup_lines": [line[0] for line in lines],
        "n_repeat_words": per_doc(repeated_windows(words.hash, owner, BASE_GRAM)),
    })
    for n in GRAM_SHARES:
        out[f"gram_chars_{n}"] = per_doc(repeated_windows(words.hash, owner, n), lengths)
    out["line_chars"] = [line[1] for line in lines]
    out["dup_line_chars"] = [line[2] for line in lines]
    out["base_failed"] = (counts < BASE_WORDS) | (100 * out.n_repeat_words > round(100 * BASE_SHARE) * counts)
    fine = out.dup_line_chars * 100 <= round(100 * LINE_SHARE) * out.line_chars
    for n, share in GRAM_SHARES.items():
        fine &= out[f"gram_chars_{n}"] * 100 <= round(100 * share) * out.word_chars
    out["kept"] = ~out.base_failed & fine
    return out


def measure(texts: pd.Series) -> pd.DataFrame:
    """All measures and the verdict, one row per text in the given order."""
    parts, held, size, hasher = [], [], 0, WordHasher(lower=False)
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            parts.append(_measure_chunk(held, hasher))
            held, size = [], 0
    parts.append(_measure_chunk(held, hasher))
    return pd.concat(parts, ignore_index=True)


def quality_column(text: str | Column = "text") -> Column:
    """A struct with the measures and the verdict of a text column."""

    @F.pandas_udf(SCHEMA)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield measure(batch)

    return measured.asNondeterministic()(text)  # evaluated once, not copied into filters


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, the measures, ``base_failed`` and ``kept``.

    Words are runs without ASCII blanks. A text fails the base rule with fewer
    than 20 words or with more than 30 % of its words in 8-word windows found
    twice or more. Beyond it a text is rejected when too large a share of its word
    characters lies in repeated runs of 3, 5 or 10 words (``GRAM_SHARES``), or
    of its line characters in lines equal to an earlier one (``LINE_SHARE``).

    A null or blank text has no words and fails the base rule. Null keys and
    repeated rows give one row each; other columns are not read; an empty table
    gives an empty one. A very long text is measured whole.
    """
    bound_batches(docs)
    name = temp_name(docs, "q")
    return docs.select(F.col(key), quality_column(text).alias(name)).select(key, f"{name}.*")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    return filter_by(docs, quality_column(text)["kept"])
