"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A pre-token starts as its bytes. Leaf i of the tree holds the rank of the pair that starts at
symbol i, joined with i itself, or a value above all others; inner nodes hold the smaller child.
So the root is the leftmost pair of lowest rank. A merge changes at most three leaves, each in
logarithmic time, and merging ends when the root holds no pair. Trees of one size are worked on
together as the rows of one array: in each round, every tree takes its own root's merge.

Pre-tokens of a run of texts are encoded once; a worker remembers short ones that it has met (the
memory is emptied when it holds ``REMEMBER`` characters, which changes only the time taken). Trees
are worked on ``LEAVES`` leaves at a time; a single longer pre-token takes a tree of its own.

Defined results: a null text is an empty one and has no ids; the special token's string in a text
is that token; null ids decode to an empty text; very long texts are encoded whole; rows are
independent, so ties and repeats don't matter; an empty table gives no rows; other columns pass
through unchanged, except one named like the output, which is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from savora.llm.common import read_table

REMEMBER, SHORT = 2_500_000, 32
LEAVES = 250_000
CHARS_AT_ONCE = 1_000_000

#: Fixed value: the pre-tokenizer's pattern, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below U+0250 the same classes can be listed, which is faster; texts with other characters, or with those on which the two libraries differ, take PATTERN.
LISTED = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
QUICK = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LISTED}]+| ?[0-9]+| ?[^\s{LISTED}0-9]+|\s+(?!\S)|\s+")
OTHERS = re.compile(r"[\x1c-\x1f²³¹¼-¾ɐ-\U0010ffff]")


def byte_characters() -> dict[str, int]:
    """The printable stand-in for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        stand_in = byte_characters()
        pieces = {i: bytes(stand_in[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.size = max(pieces) + 1
        by_id = [pieces.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(p) for p in by_id], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.first = np.array([vocab[c] for c, _ in sorted(stand_in.items(), key=lambda x: x[1])], dtype=np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pairs, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.no_rank = len(merges)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], self.no_rank)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as the bytes of an int32 array."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([1 << max(0, len(w) - 1).bit_length() for w in words], dtype=np.int64)
        for size in np.unique(sizes):
            chosen = np.flatnonzero(sizes == size)
            step = max(1, LEAVES // int(size))
            for k in range(0, len(chosen), step):
                part = chosen[k : k + step]
                for i, ids in zip(part, self._merge_trees([words[i] for i in part], int(size)), strict=True):
                    out[i] = ids
        return out

    def _merge_trees(self, words: list[bytes], size: int) -> list[bytes]:
        n, width = len(words), size
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbol = np.full((n, width), -1, dtype=np.int32)
        inside = np.arange(width) < lengths[:, None]
        symbol[inside] = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        place = np.arange(width, dtype=np.int64)
        none = self.no_rank * width
        tree = np.full((n, 2 * width), none + width, dtype=np.int64)  # leaf: rank * width + place
        if width > 1:
            two = inside[:, 1:]
            ranks = self.rank(symbol[:, :-1][two], symbol[:, 1:][two])
            leaves = np.full((n, width - 1), none, dtype=np.int64)
            leaves[two] = ranks * width
            tree[:, width : 2 * width - 1] = leaves + place[:-1]
            for level in range(width.bit_length() - 2, -1, -1):
                a, b = 1 << level, 2 << level
                tree[:, a:b] = np.minimum(tree[:, 2 * a : 2 * b : 2], tree[:, 2 * a + 1 : 2 * b : 2])
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        live = np.flatnonzero(tree[:, 1] < none) if width > 1 else np.empty(0, dtype=np.int64)
        while len(live):
            root = tree[live, 1]
            i, rank = root % width, root // width
            j = after[live, i]
            k = after[live, j]
            h = before[live, i]
            made = self.merged[rank]
            symbol[live, i], symbol[live, j] = made, -1
            after[live, i] = k
            right, left = k < lengths[live], h >= 0
            before[live[right], k[right]] = i[right]
            self._set(tree, live, width + j, none + width)
            value = np.full(len(live), none, dtype=np.int64)
            value[right] = self.rank(made[right], symbol[live[right], k[right]]) * width
            self._set(tree, live, width + i, value + i)
            rows = live[left]
            self._set(tree, rows, width + h[left], self.rank(symbol[rows, h[left]], made[left]) * width + h[left])
            live = live[tree[live, 1] < none]
        kept = symbol >= 0
        ends = np.cumsum(kept.sum(axis=1)) * 4
        flat = symbol[kept].tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
        tree[rows, leaf] = value
        node = leaf >> 1
        while len(node) and node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def pieces(self, text: str) -> list[str]:
        return QUICK.findall(text) if OTHERS.search(text) is None else regex.findall(PATTERN, text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known = self.known
        parts: list[list] = []  # of each text: pre-tokens, and special tokens as numbers
        for text in texts:
            at, row = 0, []
            for m in self.split.finditer(text) if self.split and "<" in text else ():
                row += [*self.pieces(text[at : m.start()]), self.special[m[0]]]
                at = m.end()
            parts.append([*row, *self.pieces(text[at:])] if row else self.pieces(text))
        new = [w for w in set(chain.from_iterable(parts)) if w not in known]
        words = [w for w in new if isinstance(w, str)]
        fresh = dict(zip(words, self.merge([w.encode() for w in words]), strict=True))
        fresh |= {w: np.int32(w).tobytes() for w in new if not isinstance(w, str)}
        rows = [np.frombuffer(b"".join([known.get(w) or fresh[w] for w in row]), dtype=np.int32) for row in parts]
        short = [w for w in words if len(w) <= SHORT]
        self.held += sum(map(len, short))
        if self.held > REMEMBER:
            known.clear()
            self.held = sum(map(len, short))
        known.update((w, fresh[w]) for w in short)
        return rows

    def decode(self, ids: np.ndarray) -> str:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(self.begins[ids] - (ends - lengths), lengths)
        return self.bytes[where].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public vocabularies keeps the file; each executor looks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHARS_AT_ONCE bytes, so that a batch of very long texts isn't split into words all at once."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        total += size
        if total >= CHARS_AT_ONCE or i + 1 == len(sizes):
            yield at, i + 1
            at, total = i + 1, 0


def _with(batch: pa.RecordBatch, drop: str, column: pa.Array) -> pa.RecordBatch:
    kept = [k for k, f in enumerate(batch.schema) if f.name != drop]
    return pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], column], names=[*[batch.schema.names[k] for k in kept], "_out"])


def _mapped(df: DataFrame, source: str, output: str, kind: T.DataType, f) -> DataFrame:
    """df without the column source, with the column output made from it batch by batch."""
    kept = [c for c in df.columns if c not in (source, output)]
    slim = df.select(*[F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(kept)], F.col(f"`{source}`").alias("_in"))
    schema = T.StructType([*[x for x in slim.schema if x.name != "_in"], T.StructField("_out", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _with(batch, "_in", f(batch.column(batch.schema.get_field_index("_in"))))

    return slim.mapInArrow(run, schema).select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(kept)], F.col("_out").alias(output))


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """df with text_col replaced by its ids, an array of int."""

    def column(texts: pa.Array) -> pa.Array:
        bpe = loaded(path or vocabulary_path())
        rows = [r for a, b in _runs(texts) for r in bpe.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(rows)))

    return _mapped(df, text_col, ids_col, T.ArrayType(T.IntegerType()), column)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """df with text_col, decoded from ids_col; ids_col stays."""

    def column(ids: pa.Array) -> pa.Array:
        bpe = loaded(path or vocabulary_path())
        flat, ends = np.asarray(ids.flatten()), np.cumsum([0, *np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ids), 0)).tolist()])
        return pa.array([bpe.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())

    return _mapped(df.withColumn("_ids_in", F.col(f"`{ids_col}`")), "_ids_in", text_col, T.StringType(), column)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Each row's text encoded, and decoded again from its ids, in one pass: id_col, n_tokens, ids_sha256, decoded_sha256."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or vocabulary_path())
        for batch in batches:
            for a, b in _runs(batch.column(1)):
                rows = bpe.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                columns = [[len(r) for r in rows], [sha(",".join(map(str, r.tolist()))) for r in rows], [sha(bpe.decode(r)) for r in rows]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]], names=schema.names)

    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
