"""Whitening of embeddings by their leading principal components.

Entries become whole numbers x = floor(scale * c) + offset. Three passes over the vectors, each of
which leaves figures of the vectors' size only: exact sums of every dimension; products of centred
entries, summed in each task, then dimension by dimension; and, for the check, the same of the
whitened vectors. The covariance matrix (size x size doubles, however many rows) comes to the
driver and is reduced by Householder reflections to a tridiagonal one; its leading eigenvalues are
found by bisection on Sturm counts, their vectors by inverse iteration, orthogonalised again within
clusters of near eigenvalues. Mean and components (size x 8 doubles) are sent to every task, which
projects its rows.

Defined results: rows whose vector is null, or holds null or non-finite entries or such that
scale * c is beyond 2^52, are left out, of the fit too; vectors of each size are fitted by
themselves; empty vectors, and dimensions along which nothing varies (an eigenvalue below 1e-12 of
the trace), have no component, so a single vector or equal ones give no rows; null ids stay;
repeated rows count each; a deviation beyond a long is null; eigenvalues that tie share a space in
which the components are any orthonormal ones, the same for all rows; an empty table gives no rows;
further columns of any name are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm.common import read_table

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
MOST = float(2**52)
EPS = np.finfo(np.float64).eps


class Model(NamedTuple):
    """A fit of n vectors: exact sums, components as columns by falling eigenvalue, their share of the trace, and how far whitened vectors are from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    error: float


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Q, with a = Q T Q'."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        if length == 0 or np.linalg.norm(x[1:]) == 0:
            continue
        v = x.copy()
        v[0] += np.copysign(length, x[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - v * (v @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(length, v[0])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each number."""
    tiny = EPS * (np.abs(d).max(initial=0) + 2 * np.abs(e).max(initial=0)) ** 2 * EPS + np.finfo(np.float64).tiny
    count, pivot = np.zeros(len(at), dtype=int), np.ones(len(at))
    for k in range(len(d)):
        pivot = d[k] - at - (e[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each by bisection until its interval can't be halved."""
    n = len(d)
    reach = np.abs(np.concatenate([[0.0], e])) + np.abs(np.concatenate([e, [0.0]]))
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    slack = EPS * max(abs(low[0]), abs(high[0])) + np.finfo(np.float64).tiny
    low, high = low - slack, high + slack
    most = n - 1 - np.arange(k)  # the eigenvalue sought has so many below it
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        over = below(d, e, middle) > most
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    return (low + high) / 2


def solved(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """x with (T - shift) x = b, by elimination with row exchanges; a pivot of nothing counts as a rounding error."""
    n = len(d)
    small = EPS * (np.abs(d).max() + np.abs(e).max(initial=0)) + np.finfo(np.float64).tiny
    main, up, upper, x = (d - shift).tolist(), [*e.tolist(), 0.0], [0.0] * n, b.tolist()
    for k in range(n - 1):
        sub, nxt, after = float(e[k]), main[k + 1], up[k + 1]
        if abs(sub) > abs(main[k]):
            ratio = main[k] / sub
            main[k], old = sub, up[k]
            up[k], upper[k] = nxt, after
            main[k + 1], up[k + 1] = old - ratio * nxt, -ratio * after
            x[k], x[k + 1] = x[k + 1], x[k] - ratio * x[k + 1]
        else:
            main[k] = main[k] or small
            ratio = sub / main[k]
            main[k + 1] = nxt - ratio * up[k]
            x[k + 1] -= ratio * x[k]
    main = [m if abs(m) > small else small for m in main]
    for k in range(n - 1, -1, -1):
        x[k] = (x[k] - (up[k] * x[k + 1] if k + 1 < n else 0.0) - (upper[k] * x[k + 2] if k + 2 < n else 0.0)) / main[k]
    out = np.array(x)
    return out / np.abs(out).max()


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns for the eigenvalues, which fall; within a cluster each is kept orthogonal to those before it."""
    n, norm = len(d), np.abs(d).max() + 2 * np.abs(e).max(initial=0)
    out, start = np.zeros((n, len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        shift = min(value, values[k - 1] - 4 * EPS * norm) if k > start else value  # equal eigenvalues get shifts of their own
        x = np.random.default_rng(k).uniform(-1, 1, n)
        for _ in range(6):
            x = solved(d, e, shift, x / np.linalg.norm(x))
            for _ in range(2):
                x = x - out[:, start:k] @ (out[:, start:k].T @ x)
                x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    d, e, q = householder(a)
    values = leading(d, e, k)
    vectors = q @ eigenvectors(d, e, values)
    return values, vectors / np.linalg.norm(vectors, axis=0)


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """id and x, the vector in whole numbers, of the rows that remain."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale <= F.lit(MOST)))
    return vectors.where(F.coalesce(fine, F.lit(False)) & (F.size(v) > 0)).select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda c: F.floor(c * scale).cast("long") + offset).alias("x"))


def groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each size of x, and their entries."""
    column = batch.column(batch.schema.get_field_index("x"))
    ends = np.asarray(column.offsets)
    lengths, flat = np.diff(ends), np.asarray(column.values)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield at, flat[ends[at][:, None] + np.arange(size)]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size, n, sums in two halves: sums of high and low parts don't overflow."""
    found: dict[int, list] = {}
    for batch in batches:
        for at, x in groups(batch):
            so_far = found.setdefault(x.shape[1], [0, [0] * x.shape[1]])
            so_far[0] += len(at)
            parts = (x >> 26).sum(axis=0).tolist(), (x & (2**26 - 1)).sum(axis=0).tolist()
            so_far[1] = [s + (h << 26) + l for s, h, l in zip(so_far[1], *parts, strict=True)]
    rows = [(size, n, d, str(s)) for size, (n, sums) in found.items() for d, s in enumerate(sums)]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["size", "n", "d", "s"])


def _products(centre: dict, weights: dict):
    """size, i, row: row i of the products of this task's centred (and, with weights, projected) vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in groups(batch):
                size = x.shape[1]
                if size in centre:
                    y = _centred(x, *centre[size]) @ weights[size] if weights else _centred(x, *centre[size])
                    y = np.column_stack([y, np.ones(len(y))])  # the last row and column hold sums
                    found[size] = found.get(size, 0) + y.T @ y
        for size, m in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(m), pa.int32()), pa.array(np.arange(len(m)).astype(np.int32)), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["size", "i", "row"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for size, i, row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found[size, i] = found.get((size, i), 0) + np.array(row)
    for (size, i), row in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([i], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))], names=["size", "i", "row"])


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x less the mean, which is given as a whole number and what it lacks: no digit is lost first."""
    return (x - whole).astype(np.float64) - rest


def covariances(rows: DataFrame, centre: dict, weights: dict | None = None) -> dict[int, np.ndarray]:
    """For each size, the covariance matrix about the given centre, corrected by what the centre missed."""
    parts = rows.select("x").mapInArrow(_products(centre, weights or {}), "size int, i int, row array<double>").withColumn("part", F.spark_partition_id())
    tall = parts.repartition("size", "i").sortWithinPartitions("size", "i", "part").select("size", "i", "row").mapInArrow(_summed, "size int, i int, row array<double>")
    found: dict[int, dict] = {}
    for r in tall.collect():  # one row for each dimension
        found.setdefault(r["size"], {})[r["i"]] = r["row"]
    out = {}
    for size, lines in found.items():
        m = np.array([lines[i] for i in range(len(lines))])
        n, shift = m[-1, -1], m[-1, :-1] / m[-1, -1]
        v = m[:-1, :-1] / n - np.outer(shift, shift)
        out[size] = (v + v.T) / 2
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each size of vectors; rows: id, x."""
    totals = rows.select("x").mapInArrow(_totals, "size int, n long, d int, s string").groupBy("size", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    n: dict[int, int] = {}
    sums: dict[int, dict[int, int]] = {}
    for r in totals.collect():  # one row for each dimension
        n[r["size"]] = r["n"]
        sums.setdefault(r["size"], {})[r["d"]] = int(r["s"])
    centre = {}
    for size, by in sums.items():
        whole = [round(by[d] / n[size]) for d in range(size)]
        centre[size] = np.array(whole, dtype=np.int64), np.array([(by[d] - w * n[size]) / n[size] for d, w in enumerate(whole)])
    kept, weights = {}, {}
    for size, v in covariances(rows, centre).items():
        trace = float(np.trace(v))
        if trace > 0:
            values, vectors = eigen(v, min(components, size))
            real = values > 1e-12 * trace
            kept[size] = values[real], vectors[:, real], values[real] / trace
            weights[size] = vectors[:, real] / np.sqrt(values[real])
    whitened = covariances(rows, {size: centre[size] for size in weights}, weights) if weights else {}
    return {size: Model(n[size], [sums[size][d] for d in range(size)], vectors, values, share, float(np.abs(whitened[size] - np.eye(len(values))).max())) for size, (values, vectors, share) in kept.items()}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - sum)^2; null beyond a long."""
    most = max(abs(n * int(end[d]) - s) for end in (x.max(axis=0), x.min(axis=0)) for d, s in enumerate(sums))
    if len(sums) * most * most < 2**63 and n * int(np.abs(x).max()) < 2**63:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def _projected(models: dict[int, Model], id_col: str):
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in groups(batch):
                model = models.get(x.shape[1])
                if model is None:
                    continue
                whole = [round(s / model.n) for s in model.sums]
                rest = np.array([(s - w * model.n) / model.n for s, w in zip(model.sums, whole, strict=True)])
                y = _centred(x, np.array(whole, dtype=np.int64), rest) @ model.components / np.sqrt(model.values)
                k, rows = y.shape[1], len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)),
                        pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(y.ravel()), pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, model.error)),
                    ], names=names
                )

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """For every remaining row and component: id_col, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(vectors, id_col, vector_col, scale, offset)
    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_projected(fit(rows, components), id_col), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
