"""Queries without SQL, and the pipeline, against brute force on small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from savora.llm import quality, sharding
from tests.llm.test_operators import SPACE, components, sets

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def good(rng, n=12):
    return " ".join("".join(rng.choice(list("aeioutnrs"), rng.integers(2, 9))) for _ in range(n)).capitalize() + "."


def bad(rng, n=12):
    return good(rng, n).upper().replace(" ", "!! ") + "!!"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """documents and labels: copies, near copies at about 0.82, junk, nulls, a long text."""
    rng = np.random.default_rng(21)
    texts = ["\n".join(good(rng) for _ in range(6)) for _ in range(60)] + [bad(rng, 40) for _ in range(30)]
    base = good(rng, 100)
    words = base.split()
    texts += [texts[0], texts[0].replace(" ", "  "), texts[1], base, " ".join(words[:90] + good(rng, 10).lower().split()), None, "", "\n".join(good(rng) for _ in range(2000))]
    rows = [(k, t, "en", ["s0", "s0", "s1", None][k % 4], len(t or "")) for k, t in enumerate(texts)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_quality_query(spark, corpus):
    got = quality.op8_quality(spark, corpus).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    model = quality.train(spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet"))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.score == pytest.approx(quality.score_texts([docs[r.doc_id]], model)[0]) and r.predicted == int(r.score >= 0.3)
    assert all(r.predicted == int(r.doc_id < 60) for r in got if r.doc_id < 90)
    # labels of the held-out fold change nothing
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(spark.read.parquet(f"{corpus}/documents.parquet"), flipped)
    assert (again[0] == model[0]).all() and (again[1] == model[1]).all()


def test_pipeline_against_brute_force(spark, corpus):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    scores = {r.doc_id: r.score for r in quality.op8_quality(spark, corpus).collect()}
    kept = {k: r for k, r in docs.items() if scores[k] >= 0.3}
    groups = defaultdict(list)
    for k, r in kept.items():
        groups[SPACE.sub("", r.text or "")].append(k)
    kept = {min(g, key=lambda k: (-len(kept[k].text or ""), k)) for g in groups.values()}
    s = {k: sets(docs[k].text) for k in kept}
    root = components(kept, [(a, b) for a in kept for b in kept if a < b and s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])])
    kept = [k for k in kept if root[k] == k]
    got = corpus_pipeline.run(spark, corpus).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    # what the mix takes of each source comes near its target
    sizes, taken = defaultdict(int), defaultdict(int)
    for k in kept:
        n = len((docs[k].text or "").split())
        sizes[docs[k].source] += n
        taken[docs[k].source] += n * copies[k]
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weights, level, open_ = dict(zip(order, (5, 2, 1))), 0.0, set(order)
    target = {}
    while open_:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weights[x] for x in open_)
        over = {x for x in open_ if level * weights[x] > 3 * sizes[x]}
        target |= {x: 3 * sizes[x] for x in over} if over else {x: level * weights[x] for x in open_}
        open_ -= over or open_
    most = max(len((docs[k].text or "").split()) for k in kept)
    assert all(abs(taken[x] - target[x]) <= most for x in order)
    for r in got:
        ids = LIBRARY.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id].text or "").encode()).hexdigest()


def test_stages_on_edges(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, "one two", None, "x"), (3, "one two", None, "x"), (None, "one two", "b", "x"), (4, "long words here " * 20_000, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _quality_score string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, df, "")
        assert stage(spark, df.limit(0), "").count() == 0
        if name != "encoding":
            assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in corpus_pipeline.exact_stage(spark, df, "").collect()) == ["1", "3", "4"]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_stage(spark, df, "").collect()) == ["1", "2", "3", "3", "4", "None"]


def test_shards_against_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = ["t" * int(n) for n in rng.integers(0, 60, 400)] + ["same words"] * 60 + [None, None]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    size = lambda t: len((t or "").encode()) + 1
    total, n = sum(size(t) for _, t in rows), 8
    got = sharding.shard_by_bytes(df, n).collect()
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.slot for r in ordered] == [i for k in range(n) for i in range(sum(r.shard == k for r in got))]
    # contiguous in the order of (hash of the text, id), and cut within a document or a small group of the equal targets
    keys = {r.t: r.h for r in spark.createDataFrame([(t or "",) for t in set(texts)], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    by_id = dict(rows)
    want = sorted(rows, key=lambda r: (keys[r[1] or ""], r[0]))
    assert [(keys[by_id[r.doc_id] or ""], r.doc_id) for r in ordered] == [(keys[t or ""], k) for k, t in want]
    ends = np.cumsum([sum(r.size for r in got if r.shard == k) for k in range(n)])
    limit = max(0.02 * total / n, max(size(t) for _, t in rows))
    assert all(abs(e - total * (k + 1) / n) <= limit for k, e in enumerate(ends))
    shards = defaultdict(set)
    for r in got:
        shards[by_id[r.doc_id] or ""].add(r.shard)
    weight = Counter(t or "" for _, t in rows)
    assert all(len(s) == 1 for t, s in shards.items() if weight[t] * size(t) <= limit)


def test_quality_stage_on_edges(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").withColumn("_quality_score", F.lit("own")).withColumn("score", F.lit(7))
    out = corpus_pipeline.quality_stage(spark, docs.unionByName(docs), corpus)
    scores = {r.doc_id: r.score for r in quality.op8_quality(spark, corpus).collect()}
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r._quality_score, r.score) for r in out.collect()) == sorted(2 * [(k, "own", 7) for k, x in scores.items() if x >= 0.3])
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), corpus).count() == 0
