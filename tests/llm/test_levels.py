"""Doubling over several levels, against brute force."""

import numpy as np
import pytest

from savora.llm import substring_dedup


def test_lengths():
    assert substring_dedup.lengths(13) == [7, 13]
    assert substring_dedup.lengths(50) == [7, 13, 25, 50]
    assert all(b <= 2 * a for t in range(8, 200) for a, b in zip(substring_dedup.lengths(t), substring_dedup.lengths(t)[1:]))


@pytest.mark.parametrize("target", [5, 13, 50])
def test_against_brute_force(spark, target):
    rng = np.random.default_rng(target)
    passages = [[f"p{k}_{i}" for i in range(n)] for k, n in enumerate((9, 20, 49, 50, 80))]
    rows = []
    for k in range(40):
        ws = []
        for _ in range(rng.integers(0, 5)):
            ws += [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(0, 12))] + passages[rng.integers(0, 5)]
        rows.append((k, " ".join(ws)))
    firsts, want = {}, []
    split = [(k, t.split()) for k, t in rows]
    for k, ws in split:
        for i in range(len(ws) - target + 1):
            firsts.setdefault(tuple(ws[i : i + target]), k)
    for k, ws in split:
        gone = {j for i in range(len(ws) - target + 1) if firsts[tuple(ws[i : i + target])] < k for j in range(i, i + target)}
        want.append((k, len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.remove_repeats(df, target=target).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in got) == want
