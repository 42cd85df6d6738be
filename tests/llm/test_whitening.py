"""Components against numpy's eigensolver, exact deviations, and odd tables."""

import numpy as np
import pytest

from savora.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, x int"


@pytest.mark.parametrize("n", [1, 2, 3, 20, 90])
@pytest.mark.parametrize("kind", ["random", "tied", "diagonal", "identity", "low rank", "zero"])
def test_eigen(n, kind):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n))
    a = a @ a.T
    if kind == "tied":
        q = np.linalg.qr(a)[0]
        a = q @ np.diag(np.r_[[5.0] * min(n, 4), np.linspace(1, 2, n - min(n, 4))]) @ q.T
    elif kind == "diagonal":
        a = np.diag(np.arange(n) * 1.0)
    elif kind == "identity":
        a = np.eye(n) * 3
    elif kind == "low rank":
        v = rng.standard_normal((n, 2))
        a = v @ v.T
    elif kind == "zero":
        a = np.zeros((n, n))
    a, k = (a + a.T) / 2, min(8, n)
    values, vectors = whitening.eigen(a, k)
    size = np.abs(np.linalg.eigvalsh(a)).max() + 1e-30
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-13 * size, rtol=0)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * size and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def expected(vectors):
    x = np.floor(np.array(vectors, dtype=np.float32).astype(np.float64) * 1024).astype(np.int64) + 100_000
    v = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    fine = values > 1e-12 * np.trace(v)
    return (x - x.mean(axis=0)) @ axes[:, fine] / np.sqrt(values[fine]), values[fine] / np.trace(v), ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)


@pytest.mark.parametrize(("n", "size"), [(300, 20), (6, 12), (40, 3), (2, 5)])
def test_whitening(spark, n, size):
    rng = np.random.default_rng(size)
    vectors = (rng.standard_normal((n, size)) * np.linspace(1, 3, size)).astype(np.float32).tolist()
    odd = [(9000, None, 1, 0, 0), (9001, [float("nan")] * size, 1, 0, 0), (9002, [float("inf")] + [0.0] * (size - 1), 1, 0, 0), (9003, [None] * size, 1, 0, 0), (9004, [], 1, 0, 0), (9005, [1e30] * size, 1, 0, 0), (9006, [1.0] * (size + 1), 1, 0, 0)]
    rows = [(k, v, 1, 7, 7) for k, v in enumerate(vectors)] + odd
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want, explained, deviation = expected(vectors)
    k = want.shape[1]
    assert len(got) == n * k and {r.vec_id for r in got} == set(range(n)) and all(r.n == n and r.identity_error < 1e-9 for r in got)
    table = np.zeros((n, k))
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and abs(r.explained - explained[r.component - 1]) < 1e-12
    assert np.abs(table * np.sign((table * want).sum(axis=0)) - want).max() < 1e-8


def test_repeated_rows_null_ids_and_empty(spark):
    v = [[1.0, 2.0], [3.0, 5.0], [3.0, 5.0], [0.0, 1.5]]
    rows = [(None, v[0], 1, 1, 1), (5, v[1], 1, 1, 1), (5, v[2], 1, 1, 1), (6, v[3], 1, 1, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == [(False, 5, 1), (False, 5, 1), (False, 5, 2), (False, 5, 2), (False, 6, 1), (False, 6, 2), (True, 0, 1), (True, 0, 2)]
    assert sum(r.whitened**2 for r in got if r.component == 1) == pytest.approx(4)
    same = spark.createDataFrame([(k, [1.0, 2.0], 1, 1, 1) for k in range(3)], SCHEMA)
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(0)).count() == 0


def test_large_entries_and_sums():
    x = np.array([[2**50, 0], [0, 3], [5, 2**50]], dtype=np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    assert whitening.deviations(x, 3, sums) == [None, None, None]
    assert whitening.deviations(x % 1000, 3, [int(s) for s in (x % 1000).sum(axis=0)]) == ((3 * (x % 1000) - (x % 1000).sum(axis=0)) ** 2).sum(axis=1).tolist()


def test_query(spark, tmp_path):
    at = str(tmp_path)
    vectors = np.random.default_rng(1).standard_normal((200, 16)).astype(np.float32).tolist()
    spark.createDataFrame([(k, v, 0, 0, 0) for k, v in enumerate(vectors)], SCHEMA).select("vec_id", "embedding", "label").write.parquet(f"{at}/embeddings.parquet")
    got = whitening.op12_whitening(spark, at)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 1600
