"""Vector and number expressions. All are JVM-side Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_vector(values: Sequence[float]) -> Column:
    """A constant vector; Catalyst folds it into one literal."""
    return F.array(*[F.lit(float(v)) for v in values])


def fold_sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return fold_sum(pairs)


def norm(a: Column | str) -> Column:
    squares = F.transform(as_col(a), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(fold_sum(squares))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; NULL when a vector has length zero."""
    # try_divide names the divisor once: a condition on it would compute it twice
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine(a, b)


def nonzero(a: Column | str) -> Column:
    """True for a vector that has a direction: an element other than 0, and no null, NaN or infinite one."""
    a = as_col(a)
    finite = F.forall(a, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    return F.coalesce(F.exists(a, lambda x: x != 0) & finite, F.lit(False))


def unit(a: Column | str) -> Column:
    """The vector scaled to length one; NULL for the zero vector.

    The length enters as an array, so it is computed once per row; inside the
    lambda it would be computed once per element.
    """
    a = as_col(a)
    lengths = F.array_repeat(norm(a), F.size(a))
    return F.when(nonzero(a), F.zip_with(a, lengths, lambda x, n: x.cast("double") / n))


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    """Distance over the shorter of the two lengths."""
    a, b = as_col(a), as_col(b)
    shared = F.least(F.size(a), F.size(b))
    gaps = F.zip_with(
        F.slice(a, F.lit(1), shared),
        F.slice(b, F.lit(1), shared),
        lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
    )
    return F.sqrt(fold_sum(gaps))


def euclidean_similarity(a: Column | str, b: Column | str) -> Column:
    return 1 / (1 + euclidean_distance(a, b))


def round_sig2(c: Column | str) -> Column:
    """Two significant digits, half away from zero; 0 stays 0."""
    c = as_col(c)
    # the guard keeps log10 away from 0, also where the planner evaluates both branches
    digits = F.floor(F.log10(F.when(c != 0, F.abs(c))))
    scale = F.pow(F.lit(10.0), 1 - digits)
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)


def round_fixed3(c: Column | str) -> Column:
    return F.round(as_col(c), 3)


def get_vector(embeddings: Column | str, model: str) -> Column:
    """The vector stored under ``model``, NULL when there is none."""
    return F.try_element_at(as_col(embeddings), F.lit(model))


def put_vector(embeddings: Column | str, model: str, vector: Column | str) -> Column:
    """Set one model's entry, leaving the others as they are."""
    m = F.coalesce(as_col(embeddings), F.create_map().cast("map<string,array<float>>"))
    rest = F.map_filter(m, lambda k, _: k != F.lit(model))
    return F.map_concat(rest, F.create_map(F.lit(model), as_col(vector).cast("array<float>")))


def cast_vectors(embeddings: Column | str) -> Column:
    """Any nested number arrays to the stored map of float vectors."""
    return as_col(embeddings).cast("map<string,array<float>>")


def plain_vectors(embeddings: Column | str) -> Column:
    """Stored vectors to plain double arrays, as exported files carry them."""
    return as_col(embeddings).cast("map<string,array<double>>")


def has_dim(vector: Column | str, dim: int) -> Column:
    return F.size(as_col(vector)) == dim
