"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A document's distinct word shingles are hashed once and dealt into bins; each bin keeps its least
hash. An empty bin takes the value of another, picked by hashing (bin, attempt) until a filled one
is met, so equal sets agree in all bins and similar ones in about as many as their similarity.
Rows of bins make band keys. Documents of one set are one class from the start, whatever their
number; from there on only one representative is sent.

A bucket (one band key) is a star: its members are compared with its centre, so m members make
m - 1 candidates, however large the bucket. The first level takes the member of the least hash as
the centre, the second the one with most links so far: where noisy copies are close to their
original but not to each other, that is the original. After these, buckets whose members still lie
in different components are cut by further bins of the sketch (none at first, then ``GROWTH`` times
as many a level), and each part takes up to ``CENTRES`` new centres, until none is open. A centre
has met its whole bucket and leaves it, and parts shrink geometrically, so a member has at most
``CENTRES`` candidates a level in each of its bands, and there are no more levels than it takes
to use up the sketch. Candidates are confirmed on full sets of shingles; links are merged once
after the second level, to see which buckets are settled, and once at the end.

Two similar documents can stay apart only if they share no band, or if all their buckets are large,
mostly unlinked, and cut between them before one of them was a centre, and no chain of other links
joins them.

Defined results: documents without words have an empty set and are linked with nothing; fewer
words than a shingle make one shingle; very long texts are worked on whole; a null id is linked
with nothing, has a null component and is kept; rows that share an id are one node; ids must be
integers or strings of digits; an empty table gives no rows; further columns of any name are left
alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm.common import discard, materialize, read_table
from savora.llm.components import components
from savora.llm.words import chunks, mix, prefix_sums, randoms, windows, word_hashes

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 32, 7
#: For keep_one: pairs at 0.8 or more; one at 0.8 shares no band with a chance of (1 - 0.8^6)^40 = 5e-6 (32 x 7: 5e-4).
KEEP_PERCENT = 80
KEEP_BANDS, KEEP_ROWS = 40, 6
CENTRES, GROWTH = 4, 3
EMPTY = np.uint64(2**64 - 1)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within a text, and how many each text has."""
    words, counts = word_hashes(texts, lower=True)
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    at = np.arange(len(words))
    start = at[at <= np.repeat(ends, counts) - size]
    values, owners = windows(words, size, 21)[start] if len(words) >= size else np.empty(0, dtype=np.uint64), owner[start]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        odd = randoms(size, 22) | np.uint64(1)
        whole = [mix((words[ends[k] - counts[k] : ends[k]] * odd[: counts[k]]).sum(keepdims=True) + np.uint64(counts[k]))[0] for k in short]
        values, owners = np.concatenate([values, np.array(whole, dtype=np.uint64)]), np.concatenate([owners, short])
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[new], np.bincount(owners[new], minlength=len(counts))


def bins(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """A row of k bins for each text; texts without shingles keep empty bins."""
    n = len(counts)
    sketch = np.full(n * k, EMPTY, dtype=np.uint64)
    place = ((values >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    np.minimum.at(sketch, np.repeat(np.arange(n), counts) * k + place.astype(np.int64), mix(values ^ np.uint64(0x5851F42D4C957F2D)))
    sketch = sketch.reshape(n, k)
    filled = sketch != EMPTY
    row, col = np.nonzero(~filled & (counts > 0)[:, None])
    attempt = 0
    while len(row):
        donor = (mix(col.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt << 32)) % np.uint64(k)).astype(np.int64)
        ok = filled[row, donor]
        sketch[row[ok], col[ok]] = sketch[row[ok], donor[ok]]
        row, col = row[~ok], col[~ok]
        attempt += 1
    return sketch


def band_keys(sketch: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    n, k = sketch.shape
    odd = randoms(k // n_bands, 23) | np.uint64(1)
    parts = (sketch.reshape(n, n_bands, k // n_bands) * odd).sum(axis=2, dtype=np.uint64)
    return mix(parts + randoms(n_bands, 24)).view(np.int64)


def _sketches(size: int, n_bands: int, rows: int):
    """id, text -> each row's set size, digests of its set, band keys, and the lowest byte of every bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                values, counts = shingles(texts, size)
                sketch = bins(values, counts, n_bands * rows)
                keys = band_keys(sketch, n_bands)
                low = (sketch & np.uint64(255)).astype(np.uint8)
                bands = pa.ListArray.from_arrays(pa.array((np.arange(len(texts) + 1) * n_bands).astype(np.int32)), pa.array(keys.ravel()))
                columns = [pa.array(counts.astype(np.int64)), *_digests(values, counts), bands, pa.array([x.tobytes() for x in low], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], names=["id", "n", "s1", "s2", "bands", "low"])

    return run, "id long, n long, s1 long, s2 long, bands array<long>, low binary"


def _digests(values: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """Two sums over each text's set, as its name."""
    ends = np.cumsum(counts)
    sums = [prefix_sums(mix(values ^ s)) for s in randoms(2, 25)]
    return [pa.array(mix(s[ends] - s[ends - counts]).view(np.int64)) for s in sums]


def _sets(size: int):
    """id, text -> the digests and the members of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                values, counts = shingles(texts, size)
                members = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *_digests(values, counts), members], names=["id", "s1", "s2", "members"])

    return run, "id long, s1 long, s2 long, members array<long>"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For every row: id_col, n_shingles, component_id, kept."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    run, schema = _sketches(size, n_bands, rows)
    sketched = materialize(slim.mapInArrow(run, schema), "near-sketches")
    classes = sketched.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("low").alias("low"))
    classes = materialize(classes, "near-classes")
    nodes = materialize(sketched.select("id", "n", "s1", "s2").join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep")), "near-nodes")
    links, levels = _levels(slim, classes, size, percent, n_bands, rows)
    # of rows that share an id and differ, each has its class; the id ties them together
    ties = nodes.where("rep <> id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    ties = ties.join(nodes.groupBy("id").agg(F.countDistinct("rep").alias("k")).where("k > 1"), F.col("a") == F.col("id"), "left_semi")
    roots = materialize(components(links.unionByName(ties), "near-components"), "near-roots")
    discard(sketched, classes, *levels)
    found = nodes.join(roots, nodes["rep"] == roots["node"], "left")
    component = F.coalesce(F.col("root"), F.col("rep"), F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _levels(slim: DataFrame, classes: DataFrame, size: int, percent: int, n_bands: int, rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Confirmed links between representatives (a, b), and the tables that hold them. A class goes by (rep, s1), since rows that share an id may differ."""
    keyed = classes.select("rep", "s1", "n", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    left = first = materialize(keyed.join(shared, "key").withColumn("root", F.col("rep")), "near-buckets")
    run, schema = _sets(size)
    needed = classes.select("rep", "s1", "s2").join(left.select("rep", "s1").distinct(), ["rep", "s1"], "left_semi")
    there = slim.join(needed.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").mapInArrow(run, schema).withColumnRenamed("id", "rep").join(needed, ["rep", "s1", "s2"])
    sets = materialize(there.groupBy("rep", "s1").agg(F.any_value("members").alias("members")), "near-sets")
    met, done, level, spent = first, [], 0, 0
    while True:
        # the first two levels have one centre a bucket; from the fourth on, buckets are cut by bins not used yet
        extra = 2 * GROWTH ** (level - 3) if level > 2 else 0
        if extra:
            start = F.pmod((F.col("band") + 1) * rows + F.lit(spent), F.lit(n_bands * rows))
            cut = F.xxhash64("key", F.substring(F.concat("low", "low"), start + 1, F.lit(extra)))
            left = left.join(classes.select("rep", "s1", "low"), ["rep", "s1"]).withColumn("key", cut).drop("low")
            spent += extra
        before, met = met, materialize(_met(left, _links(done), 1 if level < 2 else CENTRES), "near-met")
        discard(before)
        if spent >= n_bands * rows or met.isEmpty():
            discard(met, sets)
            return _links(done) if done else met.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false"), done
        done.append(materialize(_checked(met, sets, done, percent), "near-checked"))
        left = met.where(~F.exists("centres", lambda c: (c["rep"] == F.col("rep")) & (c["s1"] == F.col("s1")))).drop("centres")
        if level == 1:
            halfway = materialize(components(_links(done), "near-round"), "near-halfway")
            left = left.drop("root").join(halfway, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")).drop("node")
        level += 1


def _links(checked: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, [x.where("linked").select("a", "b") for x in checked]) if checked else None


def _met(left: DataFrame, links: DataFrame | None, n_centres: int) -> DataFrame:
    """Members of the buckets that hold several roots, with their bucket's centres: up to n_centres, each the member with most links of its share."""
    if links is not None:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("links"))
        left = left.join(ends, "rep", "left")
    spread = F.xxhash64("rep", "s1")
    best = F.struct((F.coalesce("links", F.lit(0)) if links is not None else F.lit(0)).alias("links"), spread.alias("hash"), "rep", "s1", "n", "root")
    shares = left.groupBy("key", F.pmod(spread, F.lit(n_centres)).alias("share")).agg(F.max(best).alias("best"), F.min("root").alias("low"), F.max("root").alias("high"))
    buckets = shares.groupBy("key").agg(F.collect_list(F.struct("best.rep", "best.s1", "best.n", "best.root")).alias("centres"), F.min("low").alias("low"), F.max("high").alias("high"))
    return left.select("rep", "s1", "n", "band", "key", "root").join(buckets.where("low <> high").select("key", "centres"), "key")


def _checked(met: DataFrame, sets: DataFrame, done: list[DataFrame], percent: int) -> DataFrame:
    """Members and centres of different roots, each pair once and none that an earlier level has had: a, a_s1, b, b_s1, linked."""
    pairs = met.select("rep", "s1", "n", "root", F.explode("centres").alias("c")).where((F.col("c.root") != F.col("root")) & (F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent))
    ordered = F.sort_array(F.array(F.struct("rep", "s1"), F.struct("c.rep", "c.s1")))
    ends = ["a", "a_s1", "b", "b_s1"]
    pairs = pairs.select(ordered[0]["rep"].alias("a"), ordered[0]["s1"].alias("a_s1"), ordered[1]["rep"].alias("b"), ordered[1]["s1"].alias("b_s1")).distinct()
    if done:
        pairs = pairs.join(reduce(DataFrame.unionByName, [x.select(*ends) for x in done]), ends, "left_anti")
    for end in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(end), F.col("s1").alias(f"{end}_s1"), F.col("members").alias(f"{end}_set")), [end, f"{end}_s1"])
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.select(*ends, (100 * both >= percent * (F.size("a_set") + F.size("b_set") - both)).alias("linked"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = KEEP_PERCENT, n_bands: int = KEEP_BANDS, rows: int = KEEP_ROWS) -> DataFrame:
    """docs with one document of each component of pairs at percent or more (and all rows without an id)."""
    kept = near_duplicates(docs, id_col, text_col, percent=percent, n_bands=n_bands, rows=rows).where("kept").select(F.col(id_col).alias("_kept")).distinct()
    there = docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]), "left_semi")
    return there.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=PERCENT)


OP3_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS s FROM split
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), meets AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common
  FROM items x JOIN items y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (SELECT a, b FROM meets WHERE 100 * common >= 85 * (na + nb - common)
), reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
), roots AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots USING (doc_id)
"""
