"""Chunks with offsets and overlap (Python: a greedy fold over sentences)."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.text import SENTENCE

_SENTENCE = re.compile(SENTENCE)
_CJK = re.compile(r"[一-鿿]")


def tokens(text: str) -> int:
    cjk = len(_CJK.findall(text))
    return cjk + math.ceil((len(text) - cjk) / 4)


def chunks(text: str | None, most: int, overlap: int = 0) -> list[tuple[str, int, int, int]]:
    """(text, start, end, tokens) of each chunk: as many whole sentences as fit, measured on the span from the first's start to the last's end.

    Prefix sums give any span's size at once, and the sentences that the next chunk repeats are
    found by bisection, so the work grows with the text only.
    """
    if most <= 0:
        raise ValueError("the largest chunk must have a token or more")
    whole = text or ""
    spans = [m.span() for m in _SENTENCE.finditer(whole) if m[0].strip()]
    heavy = [0, *accumulate("一" <= c <= "鿿" for c in whole)]

    def size(a: int, b: int) -> int:
        wide = heavy[b] - heavy[a]
        return wide - (wide - (b - a)) // 4  # rounded up

    sizes = [size(a, b) for a, b in spans]
    sums = [0, *accumulate(sizes)]
    cuts: list[tuple[int, int]] = []
    first = 0  # the open chunk holds the sentences from first to the one before k
    for k, (a, b) in enumerate(spans):
        fits = sizes[k] <= most
        if first < k and not (fits and size(spans[first][0], b) <= most):
            cuts.append((spans[first][0], spans[k - 1][1]))
            first = bisect_left(sums, sums[k] - min(overlap, most - sizes[k]), first, k) if fits else k
        if not fits:
            cuts += [(at, min(at + most, b)) for at in range(a, b, most)]
            first = k + 1
    if first < len(spans):
        cuts.append((spans[first][0], spans[-1][1]))
    return [(whole[a:b], a, b, size(a, b)) for a, b in cuts]


def chunked(df: DataFrame, id_col: str, text_col: str, most: int, overlap: int = 0) -> DataFrame:
    """A row for each chunk: id_col, chunk_index, text, start, end, tokens."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, *c) for i, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for k, c in enumerate(chunks(t, most, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "text", "start", "end", "tokens"])

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, chunk_index int, text string, start int, `end` int, tokens int")


def chunk_list(text: Column, most: int, overlap: int = 0) -> Column:
    """The chunks as an array of structs (text, start, end, tokens) beside their text; null for null."""
    if most <= 0:
        raise ValueError("the largest chunk must have a token or more")

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [dict(zip(("text", "start", "end", "tokens"), c, strict=True)) for c in chunks(t, most, overlap)] for t in texts], dtype="object")

    return F.pandas_udf(run, "array<struct<text string, start int, `end` int, tokens int>>")(text)
