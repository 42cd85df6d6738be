"""The pivot-distance index against brute force: pruned clusters, ties, copies, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from savora.llm import topk_search

SCHEMA = "vec_id long, embedding array<float>, label int, score long, pivot int, class string"


def expected(rows, k, every):
    fine = [(i, np.floor(np.array(v, dtype=np.float32).astype(np.float64) * 256).astype(np.int64)) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for n, (q, v) in enumerate(fine):
        if q is not None and q % every == 0:
            found = sorted((-int(v @ w), i is None, i or 0) for m, (i, w) in enumerate(fine) if m != n and len(w) == len(v))[:k]
            out += [(q, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(found, 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "size", "spread", "k"), [(400, 8, 1.0, 5), (600, 4, 0.02, 3), (50, 16, 1.0, 60)])
def test_against_brute_force(spark, n, size, spread, k):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((5, size)) * 2
    vectors = (centres[rng.integers(0, 5, n)] + spread * rng.standard_normal((n, size))).astype(np.float32).tolist()
    rows = [(i, v, 0, 1, 2, "c") for i, v in enumerate(vectors)]
    rows += [(5, vectors[0], 0, 1, 2, "c"), (0, vectors[0], 0, 1, 2, "c"), (0, vectors[1], 0, 1, 2, "c"), (None, vectors[2], 0, 1, 2, "c"), (None, vectors[2], 0, 1, 2, "c")]  # shared ids, repeated rows
    rows += [(10_000 + i, vectors[20], 0, 1, 2, "c") for i in range(60)]  # a group of copies
    rows += [(20, None, 0, 1, 2, "c"), (40, [], 0, 1, 2, "c"), (60, [float("nan")] * size, 0, 1, 2, "c"), (80, [float("-inf")] * size, 0, 1, 2, "c"), (100, [None] * size, 0, 1, 2, "c"), (120, [1.0] * (size + 1), 0, 1, 2, "c"), (7, [2.0] * (size + 1), 0, 1, 2, "c"), (140, [0.0] * size, 0, 1, 2, "c")]
    got = topk_search.nearest(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("id") % 20 == 0, k=k, pivots=6, block=16, group=8)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and found(got) == expected(rows, k, 20)


def test_large_components(spark):
    rows = [(0, [3e12, -1.0], 0, 0, 0, ""), (1, [2e12, 5.0], 0, 0, 0, ""), (2, [2e12, -5e12], 0, 0, 0, ""), (3, [-1e30, 1.0], 0, 0, 0, "")]
    got = topk_search.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0).collect()
    assert [r.vec_id for r in got] == [1, 2, 3] and got[0].score == got[1].score == 2**63 - 1 and got[2].score == -(2**63) + 1


def test_empty_and_single(spark):
    rows = spark.createDataFrame([(50, [1.0, 2.0], 0, 0, 0, "")], SCHEMA)
    assert topk_search.nearest(rows, F.col("id") % 50 == 0).count() == 0
    assert topk_search.nearest(rows.limit(0), F.col("id") % 50 == 0).count() == 0
    assert topk_search.nearest(rows, F.col("id") % 50 == 1).count() == 0


def test_few_annuli_are_visited_where_clusters_are_tight(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 6))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    vectors = (centres[rng.integers(0, 20, 4000)] + 0.005 * rng.standard_normal((4000, 6))).astype(np.float32).tolist()
    rows = [(i, v, 0, 1, 2, "c") for i, v in enumerate(vectors)]
    visited, merged = [], topk_search.materialize

    def counted(df, tag):
        out = merged(df, tag)
        if tag == "search-visits":
            visited.append(out.count())
        return out

    topk_search.materialize = counted
    try:
        got = found(topk_search.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0, pivots=20, block=50))
    finally:
        topk_search.materialize = merged
    assert got == expected(rows, 5, 100) and sum(visited) < 40 * 80 / 2  # 40 queries, at least 80 annuli


def test_query(spark, tmp_path):
    at = str(tmp_path)
    vectors = np.random.default_rng(1).standard_normal((300, 12)).astype(np.float32).tolist()
    rows = [(k, v, 0, 0, 0, "") for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, SCHEMA).select("vec_id", "embedding", "label").write.parquet(f"{at}/embeddings.parquet")
    assert found(topk_search.op13_topk_search(spark, at)) == expected(rows, 5, 50)
