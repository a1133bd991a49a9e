"""SentencePiece-compatible encoding and decoding by a prefix table.

In a merge-type vocabulary the encoding of every prefix of a text ends in one
token only. The table stores that last token per prefix: of the vocabulary tokens
that end there (an automaton finds them), it is the one whose predecessor, the last
token of the prefix before it, is compatible with it, i.e. the two side by side
would not be merged otherwise. The ids are then read off from the end backwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, WordHasher, bound_batches, temp_name

SPACE = "▁"  # stands for a blank in the vocabulary
CACHE_WORDS = 150_000
NEVER = 1 << 60
LONG = 1 << 20  # bytes taken at once
_BORDER = re.compile(rb"[^ ](?= )")


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file, in id order; types: 1 normal, 2 unknown, 3 control, 6 byte."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec, norm = model.trainer_spec, model.normalizer_spec
    if not (spec.byte_fallback and norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces):
        raise ValueError("this model normalises its input; only identity models with byte fallback are supported")
    return [(p.piece, p.score, p.type) for p in model.pieces]


class Vocabulary:
    """Merge ranks and the merge tree of every piece: what the compatibility test needs.

    Pieces that the merges themselves never produce get no tree and are left out of
    the automaton. Runs of blanks share one score and are handled apart.
    """

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = [p for p, _, _ in pieces]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.blank_runs = {len(p): i for i, (p, _, kind) in enumerate(pieces) if kind == 1 and not p.strip(SPACE)}
        normal = sorted((-s, i) for i, (p, s, kind) in enumerate(pieces) if kind == 1 and (p == SPACE or p.strip(SPACE)))
        rank = {pieces[i][0]: r for r, (_, i) in enumerate(normal)}
        self.id = {pieces[i][0]: i for _, i in normal}
        # rank of the piece that two pieces make together, by their ids
        self.merge = {
            self.id[p[:k]] << 20 | self.id[p[k:]]: r
            for p, r in rank.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id
        }
        # right and left spines: (part, rank at which a merge takes the part in), inner to outer
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for p in sorted(rank, key=lambda p: (len(p) > 1, rank[p])):
            me, r = self.id[p], rank[p]
            if len(p) == 1:
                self.right[me] = self.left[me] = [(me, NEVER)]
                continue
            cuts = [(self.id.get(p[:k], -1), self.id.get(p[k:], -1)) for k in range(1, len(p))]
            cut = next(((a, b) for a, b in cuts if a in self.left and b in self.left and self.compatible(a, b, r)), None)
            if cut:
                a, b = cut
                self.right[me] = [*self.right[b][:-1], (b, r), (me, NEVER)]
                self.left[me] = [*self.left[a][:-1], (a, r), (me, NEVER)]

    def compatible(self, a: int, b: int, limit: int = NEVER) -> bool:
        """Do the merges, up to ``limit``, leave pieces ``a`` and ``b`` side by side?

        Walks up both parts' edges in merge order. A merge across the border happens if
        its rank comes before the merges that take either edge part away; of two
        equal ranks the left place comes first.
        """
        right, left, i, j, merge = self.right[a], self.left[b], 0, 0, self.merge
        while True:
            u, until_u = right[i]
            v, until_v = left[j]
            across = merge.get(u << 20 | v, NEVER)
            if across < until_u and across <= until_v and across < limit:
                return False
            if until_u <= until_v:
                if until_u == NEVER:
                    return True
                i += 1
            else:
                j += 1


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_pieces(path))


class Fits(dict):
    """Whether the token of the low 20 bits may follow the one above them; after none (-1) each may."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.compatible = vocab.compatible

    def __missing__(self, pair: int) -> bool:
        before = pair >> 20
        self[pair] = fits = before < 0 or self.compatible(before, pair & 0xFFFFF)
        return fits


class SegmentHasher(WordHasher):
    """Cuts texts where no merge can pass, and hashes what lies between.

    A segment begins at a run of blanks, at and after a line end, and between two signs that no
    piece holds side by side: such a border stays whatever the merges do.
    """

    def __init__(self, pieces: list[str]):
        super().__init__(lower=False)
        self.joined = np.zeros((256, 256), dtype=bool)  # last byte of a sign, first byte of the next
        for piece in pieces:
            signs = [c.encode() for c in piece.replace(SPACE, " ")]
            for a, b in zip(signs, signs[1:]):
                self.joined[a[-1], b[0]] = True

    def cut(self, raw: bytes, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of the segments of ``raw``, which holds texts that begin at ``heads``."""
        data = np.frombuffer(raw, dtype=np.uint8)
        n = len(data)
        blank, line = data == 32, data == 10
        begins = line.copy()
        begins[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        begins[1:] |= ~self.joined[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80) & ~blank[1:]
        begins[heads] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        return self.hashes(data, starts, ends), starts, ends


class Runs:
    """Byte strings, one after another, and any sequence of them joined by array operations."""

    def __init__(self, runs: list[bytes], kind: str = "u1"):
        self.flat = np.frombuffer(b"".join(runs), dtype=kind)
        self.size = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs)) // self.flat.itemsize
        self.begin = np.cumsum(self.size) - self.size

    def joined(self, picks: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
        """The runs ``picks`` joined, cut in parts that begin at the places ``cuts`` (last: the end) of ``picks``."""
        size = self.size[picks]
        ends = np.cumsum(size)
        whole = self.flat[np.repeat(self.begin[picks] - (ends - size), size) + np.arange(size.sum())]
        bounds = np.concatenate([[0], ends])[cuts]
        return [whole[i:j] for i, j in zip(bounds[:-1], bounds[1:])]


class PieceCodec:
    """Encodes and decodes whole texts; the ids of a segment are kept between texts, by its hash."""

    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.vocab, self.words, self.pairs = vocab, Recent(CACHE_WORDS), Fits(vocab)
        self.sizes = [len(p) for p in vocab.pieces]
        self.automaton = ahocorasick.Automaton()
        for i in vocab.left:
            self.automaton.add_word(vocab.pieces[i], (i, len(vocab.pieces[i])))
        self.automaton.make_automaton()
        self.hasher = SegmentHasher([vocab.pieces[i] for i in [*vocab.id.values(), *vocab.blank_runs.values()]])
        self.longest_run = max(vocab.blank_runs)
        kinds = {i: b for b, i in vocab.byte_ids.items()}
        self.surface = Runs([
            bytes([kinds[i]]) if i in kinds else p.replace(SPACE, " ").encode() for i, p in enumerate(vocab.pieces)
        ])
        self.names = Runs([b"%d," % i for i in range(len(vocab.pieces))])

    def _table(self, text: str) -> list[int]:
        """Ids of a text by its prefix table; signs outside the vocabulary stand alone, as their bytes."""
        n, pairs, sizes = len(text), self.pairs, self.sizes
        if len(pairs) > 300_000:
            pairs.clear()
        # token that ends the encoding of each prefix; -1: a sign without a token, and, found at place -1, the start
        last = [-1] * (n + 1)
        for end, (token, size) in self.automaton.iter(text):
            if last[end] < 0 and pairs[last[end - size] << 20 | token]:
                last[end] = token
        out, at = [], n - 1
        while at >= 0:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= sizes[token]
            else:
                out.extend(self.vocab.byte_ids[b] for b in reversed(text[at].encode("utf-8", "replace")))
                at -= 1
        out.reverse()
        return out

    def _blanks(self, number: int) -> list[int]:
        """Ids of a run of blanks: all merges of it rank alike, so the leftmost possible one is next."""
        runs, head = self.vocab.blank_runs, 0
        if number > 2 * self.longest_run:
            head = number // self.longest_run - 1
        parts = [1] * (number - head * self.longest_run)
        at = 0
        while at + 1 < len(parts):
            if parts[at] + parts[at + 1] in runs:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                at = 0
            else:
                at += 1
        return [runs[n] for n in [self.longest_run] * head + parts]

    def word(self, segment: str) -> list[int]:
        """Ids of blanks followed by a word without blanks or line ends.

        Merges of blanks with each other come last of all: those before the one next to
        the word, and that one too if the word leaves it alone.
        """
        bare = segment.lstrip(SPACE)
        blanks = len(segment) - len(bare)
        ids = self._table(SPACE + bare if blanks else bare)
        if blanks and ids[0] == self.vocab.id[SPACE]:
            ids = ids[1:]
        elif blanks:
            blanks -= 1
        return self._blanks(blanks) + ids if blanks else ids

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids per text. Long texts are cut before a run of blanks first, so that arrays stay small."""
        raws, heads = [], [0]
        for text in texts:
            raw = (" " + text.replace(SPACE, " ")).encode("utf-8", "replace") if text else b""
            at = 0
            while len(raw) - at > LONG and (border := _BORDER.search(raw, at + LONG)):
                raws.append(raw[at : border.end()])
                at = border.end()
            raws.append(raw[at:] if at else raw)
            heads.append(len(raws))
        ids, low, size = [], 0, 0
        for i, raw in enumerate(raws, 1):
            size += len(raw)
            if size >= LONG or i == len(raws):
                ids.extend(self._group(raws[low:i]))
                low, size = i, 0
        return [ids[i] if j == i + 1 else np.concatenate(ids[i:j]) for i, j in zip(heads[:-1], heads[1:])]

    def _group(self, raws: list[bytes]) -> list[np.ndarray]:
        raw, bounds = b"".join(raws), np.cumsum([0, *map(len, raws)])
        if not raw:
            return [np.zeros(0, dtype="<i4")] * len(raws)
        value, starts, ends = self.hasher.cut(raw, bounds[:-1][np.diff(bounds) > 0])
        named, at, back = np.unique(value, return_index=True, return_inverse=True)
        names, words = named.tolist(), self.words
        fresh = set(words.unknown(set(names)))
        for name, i, j in zip(names, starts[at].tolist(), ends[at].tolist()):
            if name in fresh:
                words[name] = np.array(self.word(raw[i:j].decode().replace(" ", SPACE)), dtype="<i4").tobytes()
        return Runs([words[name] for name in names], "<i4").joined(back, np.searchsorted(starts, bounds))

    def decode(self, ids: Sequence[np.ndarray]) -> list[str]:
        """The texts of ids of this encoder: pieces joined, blanks restored, without the blank put first."""
        texts = [raw.tobytes().decode("utf-8", "replace") for raw in self._all(self.surface, ids)]
        return [text[1:] if text.startswith(" ") else text for text in texts]

    def listed(self, ids: Sequence[np.ndarray]) -> list[bytes]:
        """Decimal ids joined by commas, per text."""
        return [raw[:-1].tobytes() for raw in self._all(self.names, ids)]

    @staticmethod
    def _all(runs: Runs, ids: Sequence[np.ndarray]) -> Iterator[np.ndarray]:
        """Joined runs per text, for some texts at a time."""
        held, size = [], 0
        for i, own in enumerate(ids, 1):
            held.append(own)
            size += len(own)
            if size >= LONG // 4 or i == len(ids):
                yield from runs.joined(np.concatenate(held), np.cumsum([0, *map(len, held)]))
                held, size = [], 0


def codec_column(path: str, text: str = "text", keep: bool = True):
    """A struct column: ids and decoded text (if ``keep``), their digests, and the number of ids."""
    vocab = vocabulary(path)
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    @F.pandas_udf(schema)
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = PieceCodec(vocab)
        for batch in batches:
            ids = codec.encode(batch.tolist())
            decoded = codec.decode(ids)
            out = pd.DataFrame({
                "n_tokens": np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)),
                "ids_sha256": [hashlib.sha256(names).hexdigest() for names in codec.listed(ids)],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in decoded],
            })
            if keep:
                out["ids"], out["decoded"] = pd.Series(ids, dtype=object), decoded
            yield out

    return coded.asNondeterministic()(text)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """One row per input row: key, n_tokens, ids_sha256, decoded_sha256, and with ``keep`` ids and decoded.

    Ids equal those of the sentencepiece library for the model at ``path``, without begin or
    end ids; the decoded text equals its decode(ids). A null or empty text has no ids and
    decodes to nothing. Null keys and repeated rows give one row each, an empty
    table gives an empty one, other columns are ignored, texts are coded whole.
    """
    bound_batches(docs)
    name = temp_name(docs, "code")
    return docs.select(F.col(key), codec_column(path, text, keep).alias(name)).select(key, f"{name}.*")
