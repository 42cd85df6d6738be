"""The ratio against Python's sequence matcher, and the similarity join against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from savora.functions.similarity import matching_ratios
from savora.functions.text import name_similarity
from savora.operators.similar import similar_names


def test_ratios_equal_the_sequence_matcher():
    rng = random.Random(5)
    word = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randrange(most + 1)))
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("", "a"), ("a", ""), ("é🎉x", "x🎉é"), ("ab" * 150, "ba" * 150), ("x" * 250, "x" * 210), ("abc" * 100, "abd" * 90)]
    pairs += [(word("abc", 12), word("abc", 12)) for _ in range(1500)] + [(word("abcdefghij麺店", 30), word("abcdefghij麺店", 30)) for _ in range(800)]
    pairs += [(word("abcdefgh ", 260), word("abcdefgh ", 320)) for _ in range(40)] + [(word("ab", 40), word("ab", 230)) for _ in range(40)]
    base = [word("abcdefghijkl", 240) for _ in range(20)]
    pairs += [(x[:50] + word("abc", 20) + x[60:], x) for x in base]
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert matching_ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == pytest.approx(want, abs=1e-12)


def similarity(a, b):
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 0.9 if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.6, 0.79, 0.95])
def test_join_equals_all_pairs(spark, least):
    rng = random.Random(9)
    names = [("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))), rng.choice("xyz")) for _ in range(250)]
    names += [(n[:3] + "q" + n[3:], c) for n, c in names[:60]] + [("", "x"), (None, "x"), ("solo", None), ("a" * 300, "x"), ("a" * 290 + "b" * 9, "x")]
    left, right = names[::2] + [("aa", "x")], names[1::2] + [("aa", "x"), ("aa", "x")]
    frame = lambda rows: spark.createDataFrame(rows, "name string, city string")
    got = {(r.city, r.a, r.b): r.similarity for r in similar_names(frame(left), frame(right), ["city"], "name", least).collect()}
    want = {(c, a, b): similarity(a, b) for a, c in left for b, d in right if c is not None and c == d and a and b and similarity(a, b) >= least}
    assert got == pytest.approx(want) and want


def test_column(spark):
    df = spark.createDataFrame([("tide", "diet"), ("ab", "abc"), ("", "a"), (None, "a"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(name_similarity(F.col("a"), F.col("b"))).collect()] == [0.25, 0.9, 0.0, 0.0, 1.0]


def tokens(address):
    out = set()
    for part in (address or "").replace(" ", "").split(","):
        out |= {part} if 0 < len(part) <= 2 else {part[k : k + 2] for k in range(len(part) - 1)}
    return out


def test_duplicates_and_name_pairs_equal_brute_force(spark):
    from savora.plans import catalogue
    from savora.plans.bindings import shops

    d = "/root/testdata/sf0.001"
    rows = [r for r in shops(spark, d).collect() if r.status == "active"]
    want = set()
    for a in rows:
        for b in rows:
            if a.city == b.city and a.shop_id < b.shop_id:
                name, x, y = similarity(a.name_norm, b.name_norm), tokens(a.address), tokens(b.address)
                score = 0.7 * name + 0.3 * len(x & y) / len(x | y) if x and y else name
                if score >= 0.85:
                    want.add((a.city, a.shop_id, b.shop_id, round(score, 9)))
    assert {(r.city, r.a, r.b, round(r.similarity, 9)) for r in catalogue.QUERIES["duplicate_pairs_composite"](spark, d).collect()} == want
    names = {r.shop_id: r for r in shops(spark, d).collect()}
    for r in catalogue.QUERIES["name_similarity"](spark, d).collect():
        assert r.similarity == pytest.approx(similarity(names[r.shop_id].name_norm, names[r.next_id].name_norm)) if r.next_id is not None else r.similarity == 0.0
