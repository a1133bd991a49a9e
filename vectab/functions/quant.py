"""Statistical binary quantisation: two bits per dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import as_col, lit_vector

DIMS_PER_WORD = 31  # 62 bits: a word stays positive, so no sign bit enters the count


def sbq_code(vector: Column | str, mean: Sequence[float], std: Sequence[float]) -> Column:
    """Per dimension 3 (z > 1), 1 (z > 0) or 0; a constant dimension gives 0.

    A zero spread must be caught here: 0/0 would be NaN, which Spark orders
    above every number.
    """
    centred = F.zip_with(as_col(vector), lit_vector(mean), lambda x, m: x.cast("double") - m)
    return F.zip_with(
        centred,
        lit_vector(std),
        lambda c, s: F.when(s <= 0, 0).when(c > s, 3).when(c > 0, 1).otherwise(0),
    )


def sbq_words(codes: Column | str, dims: int) -> Column:
    """Codes packed into positive bigint words for the Hamming distance."""
    codes = as_col(codes)
    words = []
    for start in range(0, dims, DIMS_PER_WORD):
        part = F.slice(codes, start + 1, min(DIMS_PER_WORD, dims - start))
        words.append(
            F.aggregate(part, F.lit(0).cast("long"), lambda acc, c: acc * 4 + c.cast("long"))
        )
    return F.array(*words)


def sbq_bytes(codes: Column | str, dims: int) -> Column:
    """Codes packed four to a byte, first code in the high bits, as hex text.

    The last byte is filled up with zero codes.
    """
    codes = as_col(codes)
    parts = []
    for start in range(0, dims, 4):
        width = min(4, dims - start)
        byte = F.aggregate(
            F.slice(codes, start + 1, width), F.lit(0), lambda acc, c: acc * 4 + c
        ) * (4 ** (4 - width))
        parts.append(F.lpad(F.hex(byte), 2, "0"))
    return F.concat(*parts)


def hamming(a: Column | str, b: Column | str) -> Column:
    bits = F.zip_with(as_col(a), as_col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)
