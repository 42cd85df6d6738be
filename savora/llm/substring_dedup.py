"""Substring dedup: windows of words that a document with a smaller id also has are removed.

Level-wise doubling. A window can only repeat where the shorter windows inside it repeat, so what
repeats at one length alone is extended to twice that length (at last to the target), level after
level, until the target is reached or no candidate survives: 7, 13 for a target of 13 and 7, 13, 25,
50 for one of 50. At the first length not every window is sent: of those inside each window of the
second length, the one with the least hash stands for it. Equal longer windows have the same, so
nothing is lost, and about a quarter of the positions are sent. At the second length all windows
whose stand-in repeats are counted; from the third on, those whose first and last parts of the
length before both repeat.

Keys are grouped with sums before the shuffle, so a passage in a third of all documents sends one
row a task; what joins back by key are slim rows, which adaptive execution splits where a key is
hot. Whole copies (equal word sequences) are settled by their digest before any window is sent.

Defined results: a null or empty text has no words; fewer words than a window are never removed; a
null id counts as larger than all others; rows that share an id don't remove each other's words;
documents of equal ids and texts get equal results; very long texts are worked on whole; ids must
be integers or strings of digits; an empty table gives no rows; further columns of any name are left
alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm.common import discard, materialize, read_table, release
from savora.llm.words import chunks, mix, prefix_sums, windows, word_hashes

WINDOW = 13
FIRST = 7
LAST = 2**63 - 1


def lengths(target: int, first: int = FIRST) -> list[int]:
    """The lengths tried one after another: each at most twice the one before, the last is the target."""
    out = [target]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


def window_keys(words: np.ndarray, short: int, long: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the longer length: its hash, and the least hash of the shorter windows inside it, which stands for it."""
    whole, parts = windows(words, long, 11), windows(words, short, 12)
    anchor = parts[: len(whole)]
    for j in range(1, long - short + 1):
        anchor = np.minimum(anchor, parts[j : j + len(whole)])
    return whole.view(np.int64), anchor.view(np.int64)


def _distinct(owner: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of the first of each equal (owner, keys), grouped by owner."""
    order = np.lexsort((*keys, owner))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for x in (owner, *keys):
        new[1:] |= x[order[1:]] != x[order[:-1]]
    return order[new]


def _inside(counts: np.ndarray, target: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie within one text, and those texts' numbers."""
    owner = np.repeat(np.arange(len(counts)), counts)
    last = np.repeat(np.cumsum(counts), counts) - target
    at = np.arange(total)
    ok = at <= last
    return at[ok], owner[ok]


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _prints(short: int, long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(2).to_pylist()):
                words, counts = word_hashes(texts)
                sums = prefix_sums(words * (np.arange(len(words), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
                plain = prefix_sums(words)
                ends = np.cumsum(counts)
                starts = ends - counts
                total = plain[ends] - plain[starts]
                # sum of word * (2 * place + 1), place counted inside the text
                placed = sums[ends] - sums[starts] - total * (starts.astype(np.uint64) * np.uint64(2))
                _, anchor = window_keys(words, short, long)
                start, owner = _inside(counts, long, len(words))
                anchor = anchor[start]
                first = _distinct(owner, anchor)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(at, len(texts)) for k in (0, 1)], pa.array(counts.astype(np.int64)), pa.array(mix(placed).view(np.int64)), pa.array(mix(total ^ np.uint64(long)).view(np.int64)), _lists(owner[first], anchor[first], len(texts))],
                    names=["uid", "id", "n_words", "w1", "w2", "anchors"],
                )

    return run, "uid long, id long, n_words long, w1 long, w2 long, anchors array<long>"


def _candidates(short: int, long: int, anchored: bool):
    """Windows of the longer length that may repeat, given each row's repeating windows of the shorter one (``anchored``: stand-ins only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for at, texts in chunks(batch.column(2).to_pylist()):
                alive = batch.column(3).slice(at, len(texts))
                alive_owner = np.repeat(np.arange(len(texts)), np.asarray(pa.compute.list_value_length(alive)))
                words, counts = word_hashes(texts)
                # a window's hash and its text's number, in one key
                salt = lambda o, a: mix(a.view(np.uint64) + o.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                known = salt(alive_owner, np.asarray(alive.flatten()))
                start, owner = _inside(counts, long, len(words))
                if anchored:
                    whole, part = window_keys(words, short, long)
                    whole, part = whole[start], part[start]
                    there = np.isin(salt(owner, part), known)
                else:
                    parts = windows(words, short, 11).view(np.int64)
                    whole, part = windows(words, long, 11).view(np.int64)[start], parts[start]
                    there = np.isin(salt(owner, part), known) & np.isin(salt(owner, parts[start + long - short]), known)
                whole, part, owner = whole[there], part[there], owner[there]
                first = _distinct(owner, whole, part)
                owner = owner[first] + at
                yield pa.RecordBatch.from_arrays([pa.array(whole[first]), pa.array(part[first]), pa.array(ids[owner]), pa.array(uid[owner])], names=["h", "a", "id", "uid"])

    return run, "h long, a long, id long, uid long"


def _removal(target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ends, copies = batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()
            n_words, n_removed, kept, spans = [], [], [], []
            for text, gone, copy in zip(texts, ends, copies, strict=True):
                raw = (text or "").encode()
                words = raw.split()
                mask = np.zeros(len(words) + 1, dtype=np.int32)
                if copy and len(words) >= target:
                    mask[0] = 1
                elif gone.is_valid and len(gone):
                    whole = windows(word_hashes([raw])[0], target, 11).view(np.int64)
                    start = np.flatnonzero(np.isin(whole, np.asarray(gone.values)))
                    np.add.at(mask, start, 1)
                    np.add.at(mask, start + target, -1)
                covered = np.cumsum(mask[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))).reshape(-1, 2)
                n_words.append(len(words))
                n_removed.append(int(covered.sum()))
                kept.append(b" ".join(compress(words, ~covered) if len(edge) else words).decode())
                spans.append([{"start": a, "end": b} for a, b in edge.tolist()])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], names=["_id", "n_words", "n_removed", "kept_text", "spans"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = WINDOW) -> DataFrame:
    """For every row: id_col, n_words, n_removed, kept_text (words joined by a space), spans (removed runs of words)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    keyed = rows.withColumn("uid", F.xxhash64("_id", "text")).withColumn("id", F.coalesce(F.col("_id").cast("long"), F.lit(LAST)))
    steps = lengths(target) if target > FIRST else [target, target]
    run, schema = _prints(*steps[:2])
    prints = materialize(keyed.select("uid", "id", "text").mapInArrow(run, schema), "repeat-prints")
    same = prints.groupBy("w1", "w2", "n_words").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = materialize(prints.join(same, ["w1", "w2", "n_words"]).where("id > first").select("uid").distinct(), "repeat-copies")
    gone = _removed_windows(spark, keyed, prints, copies, steps)
    marks = gone.withColumn("copy", F.lit(False)).unionByName(copies.select("uid", F.array().cast("array<long>").alias("gone"), F.lit(True).alias("copy")))
    found = keyed.join(marks, "uid", "left").select("_id", "text", "gone", "copy")
    id_type = rows.schema["_id"].dataType.simpleString()
    done = found.mapInArrow(_removal(target), f"_id {id_type}, n_words long, n_removed long, kept_text string, spans array<struct<start: int, end: int>>")
    return done.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_text", "spans")


def _removed_windows(spark: SparkSession, keyed: DataFrame, prints: DataFrame, copies: DataFrame, steps: list[int]) -> DataFrame:
    """uid, gone: hashes of the windows of the last length to remove, for documents that aren't whole copies."""
    sent = prints.select("uid", "w1", F.explode("anchors").alias("a"))
    repeated = materialize(sent.groupBy("a").agg(F.min("w1").alias("x"), F.max("w1").alias("y")).where("x <> y").select("a"), "repeat-anchors")
    release(spark)
    alive = sent.select("uid", "a").join(repeated, "a", "left_semi").groupBy("uid").agg(F.collect_set("a").alias("alive")).join(copies, "uid", "left_anti")
    used = [prints, repeated]
    for k, (short, long) in enumerate(zip(steps, steps[1:])):
        texts = materialize(keyed.select("uid", "id", "text").join(alive, "uid"), "repeat-texts")
        discard(*used)
        release(spark)
        run, schema = _candidates(short, long, anchored=k == 0)
        extended = texts.mapInArrow(run, schema)
        firsts = materialize(extended.groupBy("h", "a").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h", "a", "first"), "repeat-windows")
        release(spark)
        used = [texts, firsts]
        if firsts.isEmpty():  # no candidate survives
            discard(*used)
            return spark.createDataFrame([], "uid long, gone array<long>")
        met = extended.join(firsts, ["h", "a"])
        if k + 2 < len(steps):
            alive = met.groupBy("uid").agg(F.collect_set("h").alias("alive"))
    gone = materialize(met.where("id > first").groupBy("uid").agg(F.collect_set("h").alias("gone")), "repeat-gone")
    discard(*used)
    release(spark)
    return gone


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split WHERE len(words) >= 13
), wins AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS w FROM starts
), firsts AS (SELECT w, min(doc_id) AS first FROM wins GROUP BY w HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM wins JOIN firsts USING (w) WHERE doc_id > first
), masks AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM split LEFT JOIN masks USING (doc_id)
"""
