"""Text to vectors: a model registry, a default hashing model, the embed step."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BLANKS, MISSING_TEXT, compose_text
from ..functions.vector import get_vector, put_vector

EmbedFn = Callable[[list[str]], Sequence[Sequence[float]]]

HASH_MODEL = "hash-64"
BATCH = 1000
_CACHE_LIMIT = 500_000

_registry: dict[str, Callable[[], EmbedFn]] = {}


def register_model(name: str, factory: Callable[[], EmbedFn]) -> None:
    """Register a model; ``factory`` runs once per Python worker and loads it there."""
    _registry[name] = factory


def model_factory(name: str) -> Callable[[], EmbedFn]:
    """A model by name, else by its provider prefix (``openai/...`` -> ``openai``)."""
    found = _registry.get(name) or _registry.get(name.split("/")[0])
    if found is None:
        raise ValueError(f"unknown model {name!r}")
    return found


def hash_model(dims: int = 64, normalize: bool = False) -> Callable[[], EmbedFn]:
    """Bag of words hashed to ``dims`` signed buckets.

    The first eight hex digits of a token's md5 choose the bucket, the ninth the
    sign. Without ``normalize`` the entries are whole numbers.
    """

    def factory() -> EmbedFn:
        token = re.compile(f"[^{BLANKS}]+")

        class Places(dict):
            """Word to slot: twice the bucket, plus one for a negative sign."""

            def __missing__(self, word: str) -> int:
                digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
                slot = 2 * (int(digest[:8], 16) % dims) + (int(digest[8], 16) >= 8)
                self[word] = slot
                return slot

        places = Places()

        def embed_texts(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            if len(places) > _CACHE_LIMIT:
                places.clear()
            for row, text in enumerate(texts):
                words = token.findall(text)
                slots = np.fromiter(map(places.__getitem__, words), dtype=np.int64, count=len(words))
                counts = np.bincount(slots, minlength=2 * dims)
                out[row] = counts[0::2] - counts[1::2]
            if normalize:
                size = np.linalg.norm(out, axis=1, keepdims=True)
                out = np.divide(out, size, out=out, where=size > 0)
            return out.astype(np.float32)

        return embed_texts

    return factory


register_model(HASH_MODEL, hash_model(64))


ANSWER = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])
ERROR_MAP = "map<string,struct<tries:int,message:string>>"


def answers(fn: EmbedFn, texts: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
    """(vector, None) or (None, message) per text. A failing batch is halved until the failing texts stand alone."""
    try:
        found = list(fn(texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return [(np.asarray(v, dtype=np.float32), None) for v in found]
    except Exception as e:  # a provider's failure must not lose the other rows
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return answers(fn, texts[:half]) + answers(fn, texts[half:])


def embed_column(text: Column, factory: Callable[[], EmbedFn], batch: int = BATCH) -> Column:
    """Struct (vector, error) for a text column, Arrow batches in, Arrow batches out.

    NULL texts are not sent to the model and get two NULLs. The call is marked nondeterministic so that the
    optimizer never copies it into a pushed filter and runs the model twice.
    """

    @F.pandas_udf(ANSWER)
    def run(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for chunk in chunks:
            wanted = np.flatnonzero(chunk.notna().to_numpy())
            vectors, errors = np.full(len(chunk), None, dtype=object), np.full(len(chunk), None, dtype=object)
            for part in (wanted[low:low + batch] for low in range(0, len(wanted), batch)):
                for i, (vector, error) in zip(part, answers(fn, chunk.iloc[part].tolist())):
                    vectors[i], errors[i] = vector, error
            yield pd.DataFrame({"vector": vectors, "error": errors})

    return run.asNondeterministic()(text)


def filter_unembedded(
    df: DataFrame, model: str, embeddings: str = "embeddings", errors: str | None = None, tries: int | None = None
) -> DataFrame:
    """Rows that have no vector for the model yet; with ``errors`` and ``tries``, not those that failed so often."""
    bare = get_vector(embeddings, model).isNull()
    if errors in df.columns and tries is not None:
        bare &= F.coalesce(F.try_element_at(errors, F.lit(model))["tries"], F.lit(0)) < tries
    return df.filter(bare)


def embed(
    df: DataFrame,
    fields: Sequence[str],
    model: str = HASH_MODEL,
    keep_existing: bool = True,
    batch: int = BATCH,
    missing: str = MISSING_TEXT,
    embeddings: str = "embeddings",
    errors: str | None = None,
) -> DataFrame:
    """Compose the fields' text, embed it and store the vector under the model's name.

    One narrow pass: no shuffle, no second read. Rows that keep their vector send NULL to the model and cost
    nothing there. A row on which the model fails gets no vector; ``errors`` names a column that then holds,
    under the model's name, how often that happened and the last message. A row that succeeds loses its entry.
    """
    if embeddings not in df.columns:
        df = df.withColumn(embeddings, F.create_map().cast("map<string,array<float>>"))
    text = compose_text(fields, missing)
    have = get_vector(embeddings, model)
    if keep_existing:
        text = F.when(have.isNull(), text)
    fresh = df.withColumn("_fresh", embed_column(text, model_factory(model), batch))
    vector, message = F.col("_fresh.vector"), F.col("_fresh.error")
    if errors:
        known = F.coalesce(F.col(errors), F.create_map().cast(ERROR_MAP)) if errors in df.columns else F.create_map().cast(ERROR_MAP)
        tries = F.coalesce(F.try_element_at(known, F.lit(model))["tries"], F.lit(0)) + 1
        entry = F.create_map(F.lit(model), F.struct(tries.alias("tries"), message.alias("message")))
        others = F.map_filter(known, lambda k, _: k != F.lit(model))
        fresh = fresh.withColumn(errors, (
            F.when(message.isNotNull(), F.map_concat(others, entry)).when(vector.isNotNull(), others).otherwise(known)
        ).cast(ERROR_MAP))
    chosen = F.coalesce(vector, get_vector(embeddings, model)) if keep_existing else vector
    stored = F.when(chosen.isNotNull(), put_vector(embeddings, model, chosen)).otherwise(F.col(embeddings))
    return fresh.withColumn(embeddings, stored).drop("_fresh")
