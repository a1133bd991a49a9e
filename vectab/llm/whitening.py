"""Whitening of vectors: principal components kept up to date vector by vector.

A task holds the mean, the eigenvalues and the eigenvectors of the scatter it has seen. A new vector
is one centred rank-one update: its secular equation gives the new eigenvalues, and components that
the update does not touch are deflated. Spectra of tasks are combined by rank-one updates too, one per
eigenpair and one for the gap of the means, in a tree of bounded fan-in. A last pass over all vectors
refines the result by Rayleigh-Ritz: the exact covariance in the basis found is almost diagonal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.blocks import matrix
from ..plans.scaling import cut_lineage

EPS = np.finfo(float).eps
FAN = 16  # partial results combined by one task
STEPS = 120  # of the secular iteration; a handful is usual, bisection alone needs fewer than this
LONG = 2**63 - 1
LARGEST = 2.0**47  # from here on 64 times a component is no whole number that a double tells apart


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Root k of 1 + sum(z**2 / (d - x)) = 0, between the rising poles d[k] and d[k + 1].

    Given as ``delta`` (all poles) and ``x`` measured from the nearer of the two poles, so that the
    differences of poles and roots keep all digits. Each step solves the equation with both neighbouring
    poles kept and the rest taken as constant; a bracket holds it. A pole without weight closes
    the last interval.
    """
    n = len(d)
    weight, poles = np.append(z * z, 0.0), np.append(d, d[-1] + 2 * (z @ z))
    k = np.arange(n)
    gap = np.diff(poles)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        left = 1 + (weight / (poles - d[:, None] - gap[:, None] / 2)).sum(axis=1) >= 0
        delta = poles - poles[k + ~left][:, None]
        low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
        x = (low + high) / 2
        lower = k[:, None] >= np.arange(n + 1)
        for _ in range(STEPS):
            away = delta - x[:, None]
            term = weight / away
            f = 1 + term.sum(axis=1)
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            slopes = term / away
            whole = slopes.sum(axis=1)
            down = (slopes * lower).sum(axis=1)
            p, q = away[k, k], away[k, k + 1]
            a, b = (p + q) * f - p * q * whole, p * q * f
            c = f - p * down - q * (whole - down)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = x + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            # a value that rounding alone explains, or a bracket without room, ends the search for a root
            going = (np.abs(f) > 4 * EPS * (1 + np.abs(term).sum(axis=1))) & (high - low > 2 * EPS * np.abs(x))
            x = np.where(going, new, x)
            if not going.any():
                break
    return delta[:, :n], x


class Spectrum:
    """Mean, rising eigenvalues and eigenvectors (columns) of the scatter of ``n`` vectors."""

    def __init__(self, width: int, n: int = 0, mean=None, values=None, vectors=None):
        self.n = n
        self.mean = np.zeros(width) if mean is None else np.array(mean)
        self.values = np.zeros(width) if values is None else np.array(values)
        self.vectors = np.eye(width) if vectors is None else np.array(vectors).reshape(width, width)

    def update(self, w: np.ndarray) -> None:
        """Add the outer product of ``w`` with itself."""
        d, q = self.values, self.vectors
        z = w @ q
        small = 8 * EPS * (d[-1] + w @ w)
        live = np.flatnonzero(np.abs(z) * np.sqrt(w @ w) > small)
        if not len(live):
            return
        s, c, t = z[live[:-1]], z[live[1:]], np.diff(d[live])
        if (np.abs(t * s * c) <= small * (s * s + c * c)).any():
            d, q, z = d.copy(), q.copy(), z.copy()
            live = self._rotate(d, q, z, live, small)
        d_live, z_live = d[live], z[live]
        delta, x = secular_roots(d_live, z_live)
        root = x[:, None] - delta  # root k less pole i, exact to the last digits
        # the weights that make the computed roots exact, so that the vectors are orthogonal
        poles = d_live[:, None] - d_live
        np.fill_diagonal(poles, 1.0)
        weight = np.sqrt(np.abs((root / poles).prod(axis=0))) * np.sign(z_live)
        new = weight / -root
        new /= np.sqrt((new * new).sum(axis=1, keepdims=True))
        values, vectors = d.copy(), q.copy()
        values[live] = d_live - delta.diagonal() + x
        vectors[:, live] = q[:, live] @ new.T
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = np.maximum(values[order], 0), vectors[:, order]

    @staticmethod
    def _rotate(d: np.ndarray, q: np.ndarray, z: np.ndarray, live: np.ndarray, small: float) -> np.ndarray:
        """Turn neighbouring eigenvectors of almost equal eigenvalues until one has no part in the update."""
        kept, last = [], live[0]
        for j in live[1:]:
            size = np.hypot(z[last], z[j])
            c, s = z[j] / size, -z[last] / size
            if abs((d[j] - d[last]) * c * s) <= small:
                z[last], z[j] = 0.0, size
                q[:, [last, j]] = np.stack([c * q[:, last] + s * q[:, j], c * q[:, j] - s * q[:, last]], axis=1)
                d[last], d[j] = d[last] * c * c + d[j] * s * s, d[last] * s * s + d[j] * c * c
            else:
                kept.append(last)
            last = j
        return np.array([*kept, last])

    def add(self, x: np.ndarray) -> None:
        """One more vector: a rank-one update by its distance from the mean."""
        gap = x - self.mean
        if self.n:
            self.update(gap * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + gap / self.n

    def merge(self, other: Spectrum) -> None:
        """All vectors of another spectrum: an update per eigenpair and one for the gap of the means."""
        n, gap = self.n + other.n, other.mean - self.mean
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(np.sqrt(value) * vector)
        self.update(gap * np.sqrt(self.n * other.n / n))
        self.mean = self.mean + gap * (other.n / n)
        self.n = n


def partials(rows: DataFrame, start: Callable, take: Callable, give: Callable, schema: str) -> DataFrame:
    """One row per task that has rows: ``start`` (width), ``take`` (state, matrix) per batch, ``give`` the columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                y = np.floor(matrix(pa.Table.from_batches([batch])["v"]) * 64)
                state = take(start(y.shape[1]) if state is None else state, y)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), **give(state)}], schema=arrow)

    spec = T.StructType.fromDDL(f"part bigint, {schema}")
    arrow = to_arrow_schema(spec)
    return rows.select("v").mapInArrow(run, spec)


def combined(parts: DataFrame, merge: Callable[[list[dict]], dict]) -> dict | None:
    """All partial results as one, by rounds of tasks that combine ``FAN`` each; only the last one comes to the driver."""
    arrow = to_arrow_schema(parts.schema)

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_pylist([{**merge(rows), "part": rows[0]["part"] // FAN}], schema=arrow)

    parts = cut_lineage(parts)
    while parts.count() > 1:
        # the group is a column of its own: the rows keep the number they came with
        parts = cut_lineage(
            parts.withColumn("g", F.floor(F.col("part") / FAN)).groupBy("g")
            .applyInArrow(lambda table: run(table.drop(["g"])), parts.schema)
        )
    rows = parts.collect()
    return rows[0].asDict() if rows else None


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their scaled components."""
    def take(state, y):
        exact = y.astype(np.int64) if np.abs(y).max() * len(y) < 2.0**62 else np.vectorize(int, otypes=[object])(y)
        return [state[0] + len(y), [a + int(b) for a, b in zip(state[1], exact.sum(axis=0))]]

    def merge(parts):
        if len({len(p["sums"]) for p in parts}) > 1:
            raise ValueError("vectors of different dimensions")
        return {"n": sum(p["n"] for p in parts), "sums": [str(sum(map(int, c))) for c in zip(*(p["sums"] for p in parts))]}

    parts = partials(rows, lambda w: [0, [0] * w], take, lambda s: {"n": s[0], "sums": [str(v) for v in s[1]]}, "n bigint, sums array<string>")
    found = combined(parts, merge)
    return (found["n"], [int(v) for v in found["sums"]]) if found else (0, [])


def spectrum(rows: DataFrame) -> Spectrum | None:
    """The spectrum of all vectors: rank-one updates inside tasks, then between them."""
    def take(state, y):
        for x in y:
            state.add(x)
        return state

    def give(s):
        return {"n": s.n, "mean": s.mean.tolist(), "d": s.values.tolist(), "q": s.vectors.ravel().tolist()}

    def merge(parts):
        first, *rest = (Spectrum(len(p["mean"]), p["n"], p["mean"], p["d"], p["q"]) for p in parts)
        for other in rest:
            first.merge(other)
        return give(first)

    parts = partials(rows, Spectrum, take, give, "n bigint, mean array<double>, d array<double>, q array<double>")
    found = combined(parts, merge)
    return found and Spectrum(len(found["mean"]), found["n"], found["mean"], found["d"], found["q"])


def moments(rows: DataFrame, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and second moments, in ``basis``, of all vectors less ``mean``."""
    def take(state, y):
        z = (y - mean) @ basis
        return [state[0] + len(y), state[1] + z.sum(axis=0), state[2] + z.T @ z]

    def merge(parts):
        return {"n": sum(p["n"] for p in parts), **{c: np.sum([p[c] for p in parts], axis=0).tolist() for c in ("s", "ss")}}

    width = basis.shape[1]
    parts = partials(
        rows, lambda w: [0, np.zeros(width), np.zeros((width, width))], take,
        lambda s: {"n": s[0], "s": s[1].tolist(), "ss": s[2].ravel().tolist()}, "n bigint, s array<double>, ss array<double>")
    found = combined(parts, merge)
    return np.array(found["s"]) / found["n"], np.array(found["ss"]).reshape(width, width) / found["n"]


def deviations(y: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n * y - total) ** 2; None beyond a long."""
    about = ((n * y - np.array(total, dtype=np.float64)) ** 2).sum(axis=1)
    plain = about < 2.0**61
    out = [None] * len(y)
    if plain.any() and np.abs(y[plain]).max(initial=0) * n < 2.0**61 and max(map(abs, total)) < 2**61:
        gap = n * y[plain].astype(np.int64) - np.array(total, dtype=np.int64)
        for i, v in zip(np.flatnonzero(plain), (gap * gap).sum(axis=1).tolist()):
            out[i] = v
        plain = ~plain & (about < 2.0**64)
    else:
        plain = about < 2.0**64
    for i in np.flatnonzero(plain):
        v = sum((n * int(a) - t) ** 2 for a, t in zip(y[i], total))
        out[i] = v if v <= LONG else None
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """One row per vector and component: key, component, n, deviation, whitened, explained, identity_error.

    A component c of a vector counts as x = floor(64 * c) + 1000000; n, sums, covariance (divisor n) and
    eigenvectors are those of all x-vectors. Eigenvectors are numbered from 1 by falling eigenvalue;
    their signs make the largest entry positive. ``deviation`` is the exact sum of (n * x - S) ** 2 (null
    beyond a long), ``whitened`` the projection of x - S / n over the root of the eigenvalue, ``explained`` the
    eigenvalue's share of the trace, ``identity_error`` the largest absolute entry of the measured covariance
    of ``whitened`` less the identity.

    Rows whose vector is null, empty, or holds a null or non-finite component, or one of 2**47 or more,
    are left out; repeated rows count each; a null key is kept. Where the vectors do not vary along a
    component, ``whitened`` is null and the component takes no part in the error; where they do not vary at
    all, ``explained`` is null too. An empty table gives an empty one; vectors of different
    widths raise an error; other columns are not read.
    """
    spark = vectors.sparkSession
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST))  # NaN is above infinity
    fit = F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0)
    rows = vectors.filter(fit).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    out = T.StructType([
        T.StructField(key, rows.schema["k"].dataType), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    n, total = sums(rows)
    if not n:
        return spark.createDataFrame([], out)
    mean = np.array([t / n for t in total])
    basis = np.linalg.qr(spectrum(rows).vectors)[0]
    m, second = moments(rows, mean, basis)
    ritz, turn = np.linalg.eigh(second - np.outer(m, m))
    trace = float(ritz.sum())
    order = np.argsort(-ritz, kind="stable")[:components]
    e, axes = ritz[order], basis @ turn[:, order]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    live = e > max(EPS * len(mean) * ritz.max(), np.finfo(float).tiny)
    scaled = np.where(live, axes / np.sqrt(np.where(live, e, 1.0)), 0.0)
    error = None
    if live.any():
        m, second = moments(rows, mean, scaled[:, live])
        error = float(np.abs(second - np.outer(m, m) - np.eye(int(live.sum()))).max())
    share = [float(v / trace) if live.any() else None for v in np.maximum(e, 0)]
    arrow = to_arrow_schema(out)
    width = len(order)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.floor(matrix(pa.Table.from_batches([batch])["v"]) * 64)
            flat = np.repeat(np.arange(len(y)), width)
            dead = np.tile(~live, len(y))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(flat)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(y))),
                pa.array(np.full(len(flat), n, dtype=np.int64)), pa.array(deviations(y, n, total), pa.int64()).take(pa.array(flat)),
                pa.array(((y - mean) @ scaled).ravel(), mask=dead), pa.array(share * len(y), pa.float64()),
                pa.array([error] * len(flat), pa.float64()),
            ], schema=arrow)

    return rows.mapInArrow(project, out)
