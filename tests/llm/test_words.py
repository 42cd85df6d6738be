"""Hashes of words: as distinct as the words, also for words on which polynomials modulo 2^64 agree."""

import random

import numpy as np
import pytest

from savora.llm import minhash, substring_dedup
from savora.llm.words import word_hashes


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def hashes(texts, lower=False):
    values, counts = word_hashes([t.encode() for t in texts], lower)
    return [v.tolist() for v in np.split(values, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_thue_morse_words_differ(n):
    (x,), (y,) = hashes([thue_morse(n), thue_morse(n, "b", "a")])
    assert x != y


def test_hashes_are_those_of_words():
    rng = random.Random(1)
    texts = ["", " ", "a", "aa aaa  a\ta\na", "é ü", "ab ba", "x" * 5000, *(" ".join("".join(rng.choice("abC") for _ in range(rng.randrange(1, 6))) for _ in range(200)) for _ in range(20))]
    for lower in (False, True):
        seen, places = {}, {}
        for text, row in zip(texts, hashes(texts, lower), strict=True):
            words = [w.lower() if lower else w for w in text.split()]
            assert len(words) == len(row)
            for w, h in zip(words, row, strict=True):
                assert seen.setdefault(w, h) == h and places.setdefault(h, w) == w


def test_operators_tell_such_words_apart(spark):
    same = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{same} {thue_morse(2048)}"), (2, f"{same} {thue_morse(2048, 'b', 'a')}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs).collect()] == [0, 0]
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()) == [(1, 1), (2, 2)]
