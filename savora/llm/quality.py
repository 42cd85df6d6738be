"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are shares of its words and characters (upper case, symbol endings, separators,
repeats, digits), its length, and whether the document repeats it, each as indicators of
exceeding fixed marks, together with those of the line before and the line after. The field has a
weight for each indicator and one for each pair of neighbouring labels; its lines' marginals of
the label good, from the forward-backward recursion, weighted by the lines' lengths, give the
document's score.

It is fitted on at most ``SAMPLE`` labelled documents (those with the smallest hash of their id;
the bound is a parameter) of no more than ``LINES`` lines, a bound of the sample too; their lines
carry the document's label. Scoring reads all lines of all documents. Features are made on the
executors; the driver gets indicator bits of sampled documents only. Scoring maps over whole texts
and shuffles nothing.

Defined results: a null or empty text, or one of blank lines only, counts as one empty line; rows
are independent, so repeated rows get equal scores; very long texts are scored whole; without two
classes of usable labels the score is 0.5; an empty table gives no rows; a column named like the
output is replaced, others are left alone; labels, lang, source and ids are never inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm.common import read_table

SAMPLE, LINES = 4000, 2000
THRESHOLD = 0.3
FOLDS = 5

SYMBOLS = re.compile(r"[^\w\s.,;:'\"?!()/-]")
ENDINGS = re.compile(r"[^\w\s.,;:'\")\]]{2,}(?!\S)")
DIGITS = re.compile(r"\d")
MARKS = [
    [0.15, 0.4, 0.7],  # upper-case words
    [0.1, 0.3, 0.6],  # words that end in two or more symbols
    [0.1, 0.3],  # words without a letter or digit
    [0.3, 0.6, 0.8],  # words that repeat another of the line
    [0.1, 0.3, 0.6],  # words equal to the one before
    [0.03, 0.1, 0.3],  # symbols among the characters
    [0.1, 0.3],  # digits among the characters
    [0.5, 3.5, 10.5, 40.5],  # words
    [3.0, 9.0, 14.0],  # characters a word
    [0.5],  # the document has the line again
    [0.5],  # ends a sentence
]
N_OWN = sum(map(len, MARKS))
N_BITS = 3 * N_OWN + 3


def line_values(line: str, again: bool) -> list[float]:
    words = line.split()
    n, chars = max(1, len(words)), max(1, len(line))
    bare = sum(1 for w in set(words) if not any(map(str.isalnum, w)))
    if bare:
        bare = sum(1 for w in words if not any(map(str.isalnum, w)))
    return [
        sum(map(str.isupper, words)) / n,
        len(ENDINGS.findall(line)) / n,
        bare / n,
        1 - len(set(words)) / n if words else 0.0,
        sum(map(eq, words, words[1:])) / n,
        len(SYMBOLS.findall(line)) / chars,
        len(DIGITS.findall(line)) / chars,
        len(words),
        len(line) / n,
        float(again),
        float(line.rstrip()[-1:] in ".!?"),
    ]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicator rows of all lines, the lines' lengths, and how many lines each text has."""
    values, lengths, counts = [], [], []
    for text in texts:
        lines = [x for x in (text or "").split("\n") if x.strip()] or [""]
        seen: dict[str, int] = {}
        for x in lines:
            seen[x] = seen.get(x, 0) + 1
        values += [line_values(x, seen[x] > 1) for x in lines]
        lengths += [len(x) or 1 for x in lines]
        counts.append(len(lines))
    raw, n = np.array(values, dtype=np.float64).reshape(-1, len(MARKS)), np.array(counts, dtype=np.int64)
    own = np.concatenate([raw[:, [k]] > np.array(marks) for k, marks in enumerate(MARKS)], axis=1)
    starts = np.cumsum(n) - n
    bits = np.zeros((len(own), N_BITS), dtype=np.float32)
    bits[:, :N_OWN] = own
    bits[1:, N_OWN : 2 * N_OWN] = own[:-1]
    bits[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:]
    bits[starts, N_OWN : 2 * N_OWN] = 0
    bits[starts + n - 1, 2 * N_OWN : 3 * N_OWN] = 0
    bits[:, -3] = 1
    bits[starts, -2] = 1
    bits[starts + n - 1, -1] = 1
    return bits, np.array(lengths, dtype=np.float64), n


def forward_backward(unary: np.ndarray, counts: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """unary: each line's score of good over bad. Marginals of good, expected label pairs of each text, log normaliser of each text."""
    order = np.argsort(-counts, kind="stable")
    n, begin = counts[order], (np.cumsum(counts) - counts)[order]
    longest = int(n.max(initial=0))
    live = np.searchsorted(-n, -np.arange(longest), side="left")  # texts with more lines than t
    alpha = np.zeros((len(unary), 2))
    beta = np.zeros((len(unary), 2))
    score = np.stack([np.zeros_like(unary), unary], axis=1)
    for t in range(longest):
        at = begin[: live[t]] + t
        alpha[at] = score[at] if t == 0 else score[at] + np.logaddexp(alpha[at - 1, 0, None] + pair[0], alpha[at - 1, 1, None] + pair[1])
    pairs = np.zeros((len(counts), 2, 2))
    ends = begin + n - 1
    z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    for t in range(longest - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        coming = score[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(pair[:, 0] + coming[:, [0]], pair[:, 1] + coming[:, [1]])
        pairs[: live[t + 1]] += np.exp(alpha[at][:, :, None] + pair + coming[:, None, :] - z[: live[t + 1], None, None])
    log_z, expected = np.empty(len(counts)), np.empty((len(counts), 2, 2))
    log_z[order], expected[order] = z, pairs
    return np.exp(alpha[:, 1] + beta[:, 1] - np.repeat(log_z, counts)), expected, log_z


def fit(bits: np.ndarray, counts: np.ndarray, good: np.ndarray, steps: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with an L2 penalty, by Adam over all sampled texts."""
    theta = np.zeros(bits.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    label = np.repeat(good, counts).astype(np.float64)
    observed = np.zeros((2, 2))
    observed[1, 1], observed[0, 0] = (counts - 1)[good].sum(), (counts - 1)[~good].sum()
    each = 1 / np.repeat(counts, counts)  # a long text weighs no more than a short one
    per_text = np.zeros((len(counts), 2, 2))
    per_text[good, 1, 1], per_text[~good, 0, 0] = (counts - 1)[good], (counts - 1)[~good]
    for step in range(1, steps + 1):
        marginal, expected, _ = forward_backward(bits @ theta[:-4].astype(np.float32), counts, theta[-4:].reshape(2, 2))
        slope = np.concatenate([((marginal - label) * each) @ bits, ((expected - per_text) / counts[:, None, None]).sum(axis=0).ravel()]) / len(counts) + penalty * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, lines: int = LINES) -> tuple[np.ndarray, np.ndarray] | None:
    """Fits on at most ``sample`` texts of at most ``lines`` lines each, outside the held-out fold; None without two classes."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("good")).where("id is not null and good in (0, 1)")
    usable = usable.where(F.crc32(F.col("id").cast("string")) % FOLDS != 0)
    chosen = usable.groupBy("id").agg(F.max("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most ``sample`` rows are broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # rows that share an id count once, by their greatest text, so there are at most ``sample`` rows
    texts = texts.groupBy("id").agg(F.max("text").alias("text"), F.max("good").alias("good"))
    # longer ones are no part of the sample, so that its lines are bounded too; no text is cut
    texts = texts.where(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) < lines).select("text", "good")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                bits, _, counts = features(batch["text"].tolist())
                packed = np.packbits(bits.astype(bool), axis=1)
                ends = np.cumsum(counts)
                yield pd.DataFrame({"good": batch["good"].astype("int32"), "bits": [packed[b - n : b].tobytes() for b, n in zip(ends, counts, strict=True)]})

    rows = sorted((r.good, bytes(r.bits)) for r in texts.mapInPandas(pack, "good int, bits binary").collect())
    if len({g for g, _ in rows}) < 2:
        return None
    width = -(-N_BITS // 8)
    counts = np.array([len(b) // width for _, b in rows], dtype=np.int64)
    packed = np.frombuffer(b"".join(b for _, b in rows), dtype=np.uint8).reshape(-1, width)
    return fit(np.unpackbits(packed, axis=1)[:, :N_BITS].astype(np.float32), counts, np.array([g == 1 for g, _ in rows]))


def score_texts(texts: list[str | None], model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    bits, lengths, counts = features(texts)
    marginal, _, _ = forward_backward((bits @ model[0]).astype(np.float64), counts, model[1])
    starts = np.cumsum(counts) - counts
    return np.clip(np.add.reduceat(marginal * lengths, starts) / np.add.reduceat(lengths, starts), 0.0, 1.0)


def with_score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.concatenate([[], *[score_texts(batch.iloc[k : k + 500].tolist(), model) for k in range(0, len(batch), 500)]]))

    return docs.withColumn(score_col, score(F.col(f"`{text_col}`")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
