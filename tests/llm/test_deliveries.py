"""State that outlives a call: a second delivery is held against the first."""

import pytest

from savora.llm import exact_dedup


def test_two_deliveries(spark, tmp_path):
    at = f"file://{tmp_path}/state"
    first = spark.createDataFrame([(5, "a b"), (6, "ab"), (7, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(first, state_dir=at).collect()}
    assert got == {5: (5, 2, True), 6: (5, 2, False), 7: (7, 1, True)}
    second = spark.createDataFrame([(1, "ab"), (2, "c "), (3, "d"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(second, state_dir=at).collect()}
    assert got == {1: (5, 3, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True)}
    assert exact_dedup.exact_dedup(second.limit(0), state_dir=at).count() == 0
    assert exact_dedup.keep_one(spark.createDataFrame([(9, "d"), (10, "e")], "doc_id long, text string"), state_dir=at).collect()[0].doc_id == 10
    # other files under the same state: several small batches
    many = spark.createDataFrame([(100 + k, f"t{k % 7}") for k in range(70)], "doc_id long, text string").repartition(9)
    kept = exact_dedup.keep_one(many, state_dir=at).collect()
    assert sorted(r.doc_id for r in kept) == list(range(100, 107))


def test_several_batches(spark, tmp_path):
    prints = spark.createDataFrame([(f"d{k % 3}", k) for k in range(30)], "digest string, rank long").repartition(6)
    prints.write.parquet(f"{tmp_path}/prints")
    got = {r.digest: (r["size"], r.best) for r in exact_dedup.keyed_state(spark, prints, f"file://{tmp_path}", files_a_batch=1).collect()}
    assert got == {"d0": (10, 0), "d1": (10, 1), "d2": (10, 2)}


@pytest.mark.parametrize("step", ["prints", "entry", "stream", "after"])
def test_a_failed_delivery_is_tried_again(spark, tmp_path, monkeypatch, step):
    at = f"file://{tmp_path}/state"
    before = spark.createDataFrame([(50, "ab"), (51, "z")], "doc_id long, text string")
    exact_dedup.exact_dedup(before, state_dir=at, delivery="one").collect()
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "ab", "c", "c", "d", "e", "f", "f", "g  ", "z"])], "doc_id long, text string").repartition(3)
    fails = [True]

    def breaking(real, first):
        def run(*args, **kwargs):
            if fails and first:
                fails.pop()
                raise OSError("lost")
            out = real(*args, **kwargs)
            if fails:
                fails.pop()
                raise OSError("lost")
            return out

        return run

    name = {"prints": "_printed", "entry": "_printed", "stream": "keyed_state", "after": "keyed_state"}[step]
    monkeypatch.setattr(exact_dedup, name, breaking(getattr(exact_dedup, name), step in ("prints", "stream")))
    with pytest.raises(OSError):
        exact_dedup.exact_dedup(rows, state_dir=at, delivery="two").collect()
    for _ in range(2):  # again, and once more after it was done
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows, state_dir=at, delivery="two").collect()}
        assert got == {0: (0, 3, True), 1: (0, 3, False), 2: (2, 2, True), 3: (2, 2, False), 4: (4, 1, True), 5: (5, 1, True), 6: (6, 2, True), 7: (6, 2, False), 8: (8, 1, True), 9: (9, 2, True)}


def test_bitmaps_pass_all_hits_and_few_others(spark):
    rows = spark.range(40_000).selectExpr("sha2(CAST(id AS STRING), 256) AS digest", "id AS body")
    hits = rows.where("body % 9 = 0").select("digest")
    got = {r.body for r in exact_dedup._marked(rows, hits).collect()}
    assert {k for k in range(40_000) if k % 9 == 0} <= got and len(got) < 40_000 / 9 + 200
    assert exact_dedup._marked(rows, hits.limit(0)).count() == 0
