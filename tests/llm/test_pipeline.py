"""The pipeline's stages on small tables, against brute force."""

import corpus_pipeline

from tests.llm.test_operators import sets


def similarity(a, b):
    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


def near_texts():
    """A text; one like it at about 0.82; one like it at about 0.75."""
    base = [f"w{k}" for k in range(100)]
    return [" ".join(base), " ".join(base[:90] + [f"x{k}" for k in range(10)]), " ".join([f"y{k}" for k in range(14)] + base[14:])]


def test_near_stage_takes_pairs_from_0_8(spark):
    base, near, far = near_texts()
    assert 0.80 <= similarity(base, near) < 0.85 and similarity(base, far) < 0.8 and similarity(near, far) < 0.8
    df = spark.createDataFrame([(1, base), (2, near), (3, far), (4, None), (None, base)], "doc_id long, text string")
    got = corpus_pipeline.near_stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, base), (3, far), (4, None), (0, base)], key=lambda r: r[0])
