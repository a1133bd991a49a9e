"""Token counts of a unigram vocabulary, without building the tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Recent, bound_batches, temp_name

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 150_000


class UnigramCounter:
    """Best-path piece counts of words, by dynamic programming over automaton matches.

    Ties are broken as the tokenizer does: of equal scores the path whose last piece
    starts first stays. A sign that is no piece costs the lowest score less ten; runs of such
    signs are one unknown token, or their bytes where the vocabulary has byte pieces.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in {p for p, _ in pieces} for b in range(256))
        self.words = Recent(CACHE_WORDS)
        # a line end that is in no piece parts the best path; sums of whole numbers are exact, so ties stay as they are
        apart = self.bytes and not any("\n" in p for p, _ in pieces) and all(float(s).is_integer() for _, s in pieces)
        self.cut = re.compile(f"{SPACE}[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if apart else f"{SPACE}[^{SPACE}]*")

    def count(self, word: str) -> int:
        n = len(word)
        best, start, pieces = [0.0] + [None] * n, [0] * (n + 1), [0] * (n + 1)
        open_run = [False] * (n + 1)  # does the best path end in an unknown sign?
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.automaton.iter(word):
            matches[last + 1].append((last + 1 - size, score))
        for end in range(1, n + 1):
            for begin, score in sorted(matches[end]):
                if best[begin] is not None and (best[end] is None or best[begin] + score > best[end]):
                    best[end], pieces[end] = best[begin] + score, pieces[begin] + 1
            if word[end - 1] not in self.single and (best[end] is None or best[end - 1] + self.unknown > best[end]):
                best[end] = best[end - 1] + self.unknown
                more = len(word[end - 1].encode("utf-8", "replace")) if self.bytes else int(not open_run[end - 1])
                pieces[end], open_run[end] = pieces[end - 1] + more, True
        return pieces[n]

    def __call__(self, text: str | None) -> int:
        """Pieces of a whole text: blanks become marks, each of which begins a word of its own."""
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        words, known = self.cut.findall(marked if marked[0] == SPACE else SPACE + marked), self.words
        for word in known.unknown(set(words)):
            known[word] = self.count(word)
        return sum(map(known.__getitem__, words))


def count_column(pieces: list[tuple[str, float]], text: str = "text") -> Column:
    """The number of tokens of a text column."""

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = UnigramCounter(pieces)
        for batch in batches:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    return counted.asNondeterministic()(text)


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_tokens.

    ``pieces`` is a unigram vocabulary with scores; the count is that of the best
    segmentation, as a unigram tokenizer with blank marks, one put first, gives it. A null or empty
    text has no tokens. Null keys and repeated rows give one row each, an empty table gives an empty
    one, other columns are ignored, texts are counted whole.
    """
    bound_batches(docs)
    name = temp_name(docs, "count")
    return docs.select(F.col(key), count_column(pieces, text).alias(name)).withColumnRenamed(name, "n_tokens")
