import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from savora.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.ByteBpe(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab'sĠ²é \n\x1c\x85<|endoftext>", max_size=80), min_size=1, max_size=6))
def test_as_the_library(texts):
    for text, ids in zip(texts, OWN.encode(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert OWN.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "x" * 5000, "ab" * 3000 + " it's", "é🎉" * 400, "  \n\n  a"])
def test_edges(text):
    (ids,) = OWN.encode([text])
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.decode(ids) == text


def test_broken_bytes_decode_as_the_library():
    for ids in ([0, 160, 188, 50256], list(range(100, 256))):
        assert OWN.decode(np.array(ids)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_query_shape(spark):
    rows = [(1, "hello there", "x"), (2, None, "y"), (3, "", None), (None, "hello there", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.digests(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[2].n_tokens, got[2].ids_sha256, got[2].decoded_sha256) == (0, empty, empty) == (got[3].n_tokens, got[3].ids_sha256, got[3].decoded_sha256)
    ids = LIBRARY.encode("hello there", add_special_tokens=False).ids
    assert got[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() == got[None].ids_sha256
    assert bpe.digests(df.limit(0)).count() == 0
