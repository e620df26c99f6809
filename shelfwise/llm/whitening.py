"""Whitening of embeddings: the leading principal components, scaled to variance one.

Entries are put on an integer grid, so that sums are exact and equal vectors are equal. The fit
list holds each distinct vector once. Its sums, and then the covariance of the centred vectors,
are added up inside the tasks; a task passes on one small matrix, entry by entry, and Spark adds
these up. The covariance (dimensions squared, whatever the number of rows) comes to the driver:
Householder reflections make it tridiagonal, Sturm counts and bisection give the leading
eigenvalues, and inverse iteration gives their vectors, which are made orthogonal to the earlier
ones of their cluster in every step and turned back. All rows are projected with that matrix,
which is part of the task (components x dimensions).

Defined cases: vectors that are null or hold null or non-finite entries, entries beyond the
grid (2^52 steps), or no entry take no part; nor do vectors whose length is not the most frequent
one (of equally frequent ones the longest). Repeated rows count once in the fit, but each gets its
result. There are at most as many components as dimensions, and none with an eigenvalue below
1e-12 of the trace; so a single distinct vector gives no rows. A deviation beyond 64 bits is null.
An empty table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import written

COMPONENTS = 16
STEPS = 64
ORIGIN = 1_000_000
LARGEST = 2.0**52
#: Eigenvalues closer than this share of the matrix's norm form a cluster.
CLUSTER = 1e-3
NOTHING = 1e-12


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        norm = np.linalg.norm(v)
        v[0] += norm if v[0] >= 0 else -norm
        size = np.linalg.norm(v)
        v = v / size if size > 0 else np.zeros_like(v)
        mirrors.append(v)
        a[k + 1:, k:] -= 2 * np.outer(v, v @ a[k + 1:, k:])
        a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def smaller(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: negative pivots of the Sturm sequence."""
    tiny = np.finfo(np.float64).tiny * 4 + np.finfo(np.float64).eps * np.abs(off).max(initial=0) ** 2 * 1e-4
    count = np.zeros(len(at), dtype=np.int64)
    pivot = np.ones(len(at))
    for i, d in enumerate(diagonal):
        pivot = d - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection of all of them at a time."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    spare = np.finfo(np.float64).eps * max(np.abs(low).max(), np.abs(high).max()) + 1e-300
    low, high = low - spare, high + spare
    wanted = n - np.arange(k)  # the j-th largest lies below a point with that many below it
    for _ in range(200):
        middle = (low + high) / 2
        under = smaller(diagonal, off, middle) >= wanted
        high, low = np.where(under, middle, high), np.where(under, low, middle)
        if (high - low <= 2 * np.finfo(np.float64).eps * np.maximum(np.abs(low), np.abs(high))).all():
            break
    return (low + high) / 2


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges."""
    n = len(diagonal)
    main, first = (diagonal - shift).tolist(), [*off.tolist(), 0.0]
    second, lower, x = [0.0] * n, off.tolist(), right.tolist()
    for i in range(n - 1):
        if abs(main[i]) >= abs(lower[i]):
            if main[i] == 0:
                main[i] = tiny
            f = lower[i] / main[i]
            main[i + 1] -= f * first[i]
            x[i + 1] -= f * x[i]
        else:
            f = main[i] / lower[i]
            main[i], next_main = lower[i], first[i] - f * main[i + 1]
            first[i], main[i + 1] = main[i + 1], next_main
            second[i], first[i + 1] = first[i + 1], -f * first[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    for i in range(n - 1, -1, -1):
        rest = x[i]
        if i + 1 < n:
            rest -= first[i] * x[i + 1]
        if i + 2 < n:
            rest -= second[i] * x[i + 2]
        pivot = main[i] if abs(main[i]) > tiny else (tiny if main[i] >= 0 else -tiny)
        x[i] = rest / pivot
    found = np.array(x)
    return found / np.abs(found).max()


def leading_pairs(matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit vectors as rows.

    In every vector the entry of largest absolute value is positive.
    """
    n = len(matrix)
    k = min(k, n)
    scale = np.abs(matrix).max(initial=0)
    if not k or scale == 0:
        return np.zeros(0), np.zeros((0, n))
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    norm = max((np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))).max(), 1e-300)
    tiny = np.finfo(np.float64).eps * norm
    draw = np.random.default_rng(17)
    vectors, begin, shift = np.zeros((k, n)), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            begin = j
        shift = min(value, shift - 4 * tiny) if j > begin else value  # equal values: apart
        y = draw.standard_normal(n)
        for _ in range(5):
            y = solve(diagonal, off, shift, y / np.linalg.norm(y), tiny)
            for _ in range(2):
                y = y - vectors[begin:j].T @ (vectors[begin:j] @ y)
        vectors[j] = y / np.linalg.norm(y)
    for start in range(n - 3, -1, -1):
        v = mirrors[start]
        vectors[:, start + 1:] -= 2 * np.outer(vectors[:, start + 1:] @ v, v)
    largest = vectors[np.arange(k), np.abs(vectors).argmax(axis=1)]
    return values * scale, vectors * np.where(largest < 0, -1.0, 1.0)[:, None]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _added(df: DataFrame, column: str, width: int, of: object, out: str) -> dict[tuple, float]:
    """Per entry, the sum over all rows of a matrix that ``of`` makes from a batch of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0), width))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.ravel()) for x in (i.astype(np.int32), j.astype(np.int32), total)],
                names=["i", "j", "v"])

    parts = df.select(column).mapInArrow(run, f"i int, j int, v {out}")
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # dimensions squared
    return {(r["i"], r["j"]): r["v"] for r in rows}


def _dense(entries: dict[tuple, float], shape: tuple[int, int], dtype: type = np.float64) -> np.ndarray:
    out = np.zeros(shape, dtype)
    for at, v in entries.items():
        out[at] = v
    return out


@dataclass(frozen=True)
class Whitening:
    """The fitted numbers: ``count`` distinct vectors, their ``sums``, and the components."""

    count: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def projection(self) -> np.ndarray:
        return (self.vectors / np.sqrt(self.values)[:, None]).T


def on_grid(df: DataFrame, vector: str, steps: int = STEPS, origin: int = ORIGIN) -> DataFrame:
    """The rows whose vectors take part, with the grid vector in ``_x``."""
    entry = F.col(f"`{vector}`")
    good = entry.isNotNull() & (F.size(entry) > 0) & F.forall(
        entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * steps < LARGEST))
    kept = df.where(F.coalesce(good, F.lit(False)))
    lengths = kept.groupBy(F.size(entry).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept = kept.where(F.size(entry) == (lengths["d"] if lengths else 0))
    return kept.withColumn("_x", F.transform(
        entry, lambda c: F.floor(c.cast("double") * F.lit(float(steps))) + F.lit(origin).cast("bigint")))


def fit_whitening(vectors: DataFrame, column: str = "_x", components: int = COMPONENTS) -> Whitening:
    """Fit on the distinct vectors of a BIGINT array column, all of one length."""
    fit = written(vectors.select(column).distinct())
    first = fit.first()
    width = len(first[0]) if first else 0
    nothing = Whitening(0, np.zeros(width, np.int64), np.zeros(0), np.zeros((0, width)), 0.0, 0.0)
    if not width:
        return nothing
    n = fit.count()
    sums = _dense(_added(fit, column, width, lambda x: x.sum(axis=0)[None], "bigint"), (1, width), np.int64)[0]
    mean = sums / n

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = _dense(_added(fit, column, width, products, "double"), (width, width)) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = leading_pairs(covariance, components)
    trace = float(np.trace(covariance))
    many = int((values > NOTHING * trace).sum()) if trace > 0 else 0
    values, axes = values[:many], axes[:many]
    if not many:
        return nothing
    made = Whitening(n, sums, values, axes, trace, 0.0)
    turned = made.projection

    def white_products(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ turned
        return white.T @ white

    white = _dense(_added(fit, column, width, white_products, "double"), (many, many)) / n
    return Whitening(n, sums, values, axes, trace, float(np.abs(white - np.eye(many)).max()))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n x - sums)^2, exact; none beyond 64 bits."""
    largest = float(np.abs(x).max(initial=0)) * n + float(np.abs(sums).max(initial=0))
    if largest < 2.0**62:
        apart = n * x - sums
        if float(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


def whiten(
    df: DataFrame, vector: str = "embedding", keep: Sequence[str] = ("vec_id",),
    components: int = COMPONENTS, steps: int = STEPS, origin: int = ORIGIN,
) -> DataFrame:
    """One row per row that takes part and component, with the columns of ``keep``."""
    results = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    kept = [c for c in keep if c.lower() not in results]
    rows = on_grid(df, vector, steps, origin).select(*[F.col(f"`{c}`") for c in kept], "_x")
    model = fit_whitening(rows, "_x", components)
    mean, turned, width = model.sums / max(model.count, 1), model.projection, max(len(model.sums), 1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(len(kept)), width)
            white = (x - mean) @ turned
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * turned.shape[1], pa.int32()), pa.array(white.ravel()))
            exact = pa.array(deviations(x, model.count, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], exact, lists], names=[*kept, "deviation", "_white"])

    shape = T.StructType([*rows.drop("_x").schema.fields, T.StructField("deviation", T.LongType()),
                          T.StructField("_white", T.ArrayType(T.DoubleType()))])
    shares = [float(v / model.trace) for v in model.values] or [0.0]
    at = F.col("_at")
    return rows.mapInArrow(project, shape).select(
        *[F.col(f"`{c}`") for c in kept], "deviation", F.posexplode("_white").alias("_at", "whitened"),
    ).select(
        *[F.col(f"`{c}`") for c in kept], (at + 1).cast("int").alias("component"),
        F.lit(model.count).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(s) for s in shares]), at).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"))
