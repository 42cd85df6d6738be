"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from savora.llm import embedding_dedup, exact_dedup, html_extract, minhash, mixing, quality, sharding, substring_dedup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size long, shard string, rank int, uid string, best string"
RNG = np.random.default_rng(3)


def words(n, seed=None):
    rng = np.random.default_rng(seed) if seed is not None else RNG
    return " ".join("w" + str(x) for x in rng.integers(0, 5000, n))


BASE = words(200, 1)
PASSAGE = words(40, 2)
TEXTS = [
    None, "", "  \n\t ", "one", "one", " one ", "two words", BASE, BASE, BASE + " tail", BASE.upper(), BASE.replace(" ", "\n", 3), words(60, 4) + " " + PASSAGE + " " + words(30, 5),
    PASSAGE + " " + words(20, 6), words(12, 7), words(13, 8), words(13, 8), "x" * 200_000, words(20_000, 9), "ab" * 50_000, "é🎉 ünï", "a b c d e f g h i j k l m", "a b c d e f g h i j k l m a b c d e f g h i j k l m",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["s0", "s1", "s2", None][k % 4], 7, "x", 1, "u", "b") for k, t in enumerate(TEXTS)]
    rows += [rows[7], rows[7], (None, BASE, "s0", 1, "x", 1, "u", "b"), (None, None, None, 1, "x", 1, "u", "b")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub("", r.text or "")].append(r)
    for digest in (exact_dedup.sha256, lambda c: F.crc32(c) % 2):
        got = exact_dedup.exact_dedup(docs, digest=digest).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
        by = defaultdict(list)
        for r in got:
            by[r.text_sha256].append(r)
        for body, group in groups.items():
            mine = by[hashlib.sha256(body.encode()).hexdigest()]
            best = min(group, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
            assert {(r.keep_id, r.group_size) for r in mine} == {(best.doc_id, len(group))}
            assert [r.doc_id for r in mine if r.kept] == [best.doc_id]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_substring_dedup(docs, rows):
    firsts = {}
    split = [(r, WORD.findall(r.text or "")) for r in rows]
    for r, ws in split:
        for i in range(len(ws) - 12):
            key = tuple(ws[i : i + 13])
            firsts[key] = min(firsts.get(key, 2**63), 2**63 - 1 if r.doc_id is None else r.doc_id)
    want = []
    for r, ws in split:
        gone = set()
        for i in range(len(ws) - 12):
            if firsts[tuple(ws[i : i + 13])] < (2**63 - 1 if r.doc_id is None else r.doc_id):
                gone.update(range(i, i + 13))
        want.append((r.doc_id, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in substring_dedup.remove_repeats(docs).collect())
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def sets(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return set() if not ws else {tuple(ws)} if len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_wanted(rows):
    s = {r.doc_id: sets(r.text) for r in rows if r.doc_id is not None}
    linked = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    root = components(s, linked)
    return sorted((i, len(s[i]), root[i], root[i] == i) for i in s)


def test_minhash(spark, docs, rows):
    got = minhash.near_duplicates(docs).collect()
    assert sorted(set((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None)) == near_wanted(rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_groups_mostly_unlinked(spark):
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(40):
        rng = np.random.default_rng(100 + k)
        own = list(base)
        for at in rng.choice(120, 1 + k % 4, replace=False):
            own[at] = f"x{k}_{at}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == near_wanted(df.collect())


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    assert len(got) == len(rows) and sum(sizes.values()) == sum(r.size for r in got)
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1, 5)))
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while True:
        left, w = total - sum(target.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > 3 * sizes[s]}
        if not over:
            target |= {s: left * weights[s] / w for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    by_size = {sizes[s]: target[s] for s in sizes}
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size])
        assert 0 <= r.taken <= 3 * r.size
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed(docs).count() == sum(r.copies for r in got)


def test_mixing_comes_near(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"))
    sums = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in sums)


def test_sharding(docs, rows):
    got = sharding.shard_by_bytes(docs, n_shards=4).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_sharding_is_even(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int"))).alias("text"))
    sums = [r.s for r in sharding.shard_by_bytes(df).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 16 and max(sums) - min(sums) <= 400


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://COM/en/", "https://a.example.com/en/71?x", "https://example.com/en/8", "http://xexample.com/en/7", "http://b.net/de/", "http://example.net/de/8", "http://a.org/x.com/en/", "http://a.org/es/#y", "http://a.net?/de/", "://net/de/" + "z" * 3000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.url_verdict.rule, r.url_verdict.verdict) for r in url_filter.filter_urls(df).collect()}
    none = (None, "allow")
    assert [got[k] for k in range(len(urls))] == [none, none, none, ("com/en/", "block"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), none, ("org/es/", "block"), none, ("net/de/", "allow")]


def test_shift_and_against_fnmatch():
    from fnmatch import fnmatchcase

    globs = ["*", "", "a*b", "?", "*aa*", "a?c*", "*" + "ab" * 60, "b" * 70 + "*"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(300)] + ["ab" * 60, "x" + "ab" * 60, "b" * 70, "b" * 69]
    got = url_filter.ShiftAnd(globs).match([t.encode() for t in texts])
    assert got.tolist() == [[fnmatchcase(t, g) for g in globs] for t in texts]


PAGE = """<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div id="cookie-notice">We use cookies for many things here, please accept them all.</div>
<div class="post"><h2>Title</h2><p>This is a long paragraph of the article that goes on and on with many words, indeed.</p><p>Short.</p><p>Another &amp; longer one with <a href=x>a link</a>
and more words to say.<br>Line.</p></div><div class="sidebar"><ul><li><a>x</a></li></ul></div><div class="comments"><p>Great article, I really liked it so much and wanted to say thank you.</p></div>
<form>Name <input></form><footer>&copy; x</footer><script>if(a<b){x="</p>"}</script></body></html>"""


def test_html(spark):
    assert html_extract.main_text(PAGE) == "Title\n\nThis is a long paragraph of the article that goes on and on with many words, indeed.\n\nShort.\n\nAnother & longer one with a link and more words to say. Line."
    assert [html_extract.main_text(x) for x in (None, "", "<", "<nav>a", "<p")] == [""] * 5
    assert html_extract.main_text("<article><p>One <p>two &am").endswith("two &am")
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, PAGE, "y")], "page_id long, url string, html string, text string")
    assert [r.text for r in html_extract.extract(df).orderBy("page_id").collect()] == ["", html_extract.main_text(PAGE)]


def test_minimum_cut_is_minimal():
    from itertools import product

    rng = np.random.default_rng(6)
    for _ in range(40):
        n = int(rng.integers(1, 8))
        costs = rng.normal(0, 2, n).round(2).tolist()
        edges = [(i, j, round(float(rng.uniform(0, 2)), 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        energy = lambda x: sum(-c if keep and c < 0 else c if not keep and c > 0 else 0 for c, keep in zip(costs, x)) + sum(w for i, j, w in edges if x[i] != x[j])
        assert energy(html_extract.minimum_cut(costs, edges)) == pytest.approx(min(map(energy, product((False, True), repeat=n))))


def vector_wanted(rows, cosine=0.98):
    fine = [(i, v, label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, n = [], defaultdict(int)
    for a, (i, v, x) in enumerate(fine):
        for j, w, y in fine[a + 1 :]:
            if x == y and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    root = components([i for i, _, _ in rows if i is not None], links)
    return sorted((i, n[i], root[i]) for i, _, _ in rows if i is not None)


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=16).tolist(), k % 3) for k in range(60)]
    centre = rng.normal(size=16)
    rows += [(100 + k, (centre + rng.normal(size=16) * 0.07).tolist(), 1) for k in range(150)]  # a dense group, larger than a window
    rows += [(300 + k, rows[5][1], rows[5][2]) for k in range(20)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [None] + [1.0] * 15, 1), (405, rows[5][1], None), (406, [1.0, 2.0], 1), (None, rows[5][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_vectors(df, block=32).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == vector_wanted(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_quality(spark):
    rng = np.random.default_rng(8)

    def text(good):
        lines = [" ".join("".join(rng.choice(list("aeioutnrs"), rng.integers(2, 9))) for _ in range(12)) for _ in range(rng.integers(1, 6))]
        return "\n".join(x.capitalize() + "." if good else x.upper().replace(" ", "!! ") + "!!" for x in lines)

    rows = [(k, text(k % 3 != 0), int(k % 3 != 0), "en") for k in range(400)]
    rows += [(1000, None, None, "en"), (1001, "", None, "en"), (1002, "\n\n", None, "en"), (None, "Plain text.", None, "en"), (1003, "A line of words. " * 5000, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, score string")
    labels = df.where("quality is not null").select("doc_id", "quality")
    model = quality.train(df, labels, sample=200)
    got = quality.with_score(df.drop("score"), model).collect()
    held = [r for r in got if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= quality.THRESHOLD) == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.train(df, labels.limit(0)) is None
    assert quality.with_score(df, None).first().score == 0.5


def test_forward_backward_against_all_labellings():
    from itertools import product

    rng = np.random.default_rng(9)
    counts = np.array([1, 4, 3])
    unary, pair = rng.normal(size=8), rng.normal(size=(2, 2))
    marginal, expected, log_z = quality.forward_backward(unary, counts, pair)
    at = 0
    for k, n in enumerate(counts):
        scores, states = [], list(product((0, 1), repeat=int(n)))
        for y in states:
            scores.append(sum(unary[at + i] * y[i] for i in range(n)) + sum(pair[y[i], y[i + 1]] for i in range(n - 1)))
        p = np.exp(scores) / np.exp(scores).sum()
        assert log_z[k] == pytest.approx(np.log(np.exp(scores).sum()))
        assert marginal[at : at + n] == pytest.approx((p[:, None] * np.array(states)).sum(axis=0))
        assert expected[k, 1, 1] == pytest.approx(sum(q * sum(y[i] and y[i + 1] for i in range(n - 1)) for q, y in zip(p, states)))
        at += n
