"""Embedding near-dedup by sorted projection passes.

Equal vectors of a label are one class from the start, which goes by a number of its own; its least
id and its size count. Each pass draws random hyperplanes; the sides a vector lies on, concatenated, are its key,
and classes are ordered by (label, key). The order is cut into blocks, and each block's vectors are
compared, in double precision, with those of their own and the next block: a bounded window. Two
vectors that share so many first bits of their keys that no more than a block of vectors shares
them lie within a window. How many bits that takes is measured for every vector in ``PROBES``
passes of their own: more where a label's vectors lie in a cone, which few planes cut. The number
of passes follows from the vector that takes most, so that two vectors at the threshold miss each
other in all of them with a chance below ``MISS``, as far as the probes tell.

Tasks don't emit pairs but counts of links and a spanning forest of them. A pair found in several
passes is counted in the first only: every row carries its block in all passes, so a task can tell
what an earlier pass has seen. Where a block still has links at the far end of its window (a dense
group larger than the window), the window is moved on, in each pass, until no link is met.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
those with a null label, are linked with nothing; vectors of different sizes are not compared; a
null id is linked with nothing, has a null component and is kept; rows that share an id and a
vector count as copies; rows that share an id but not the vector are each linked on their own and
belong to one component; ids must be integers or strings of digits; an empty table gives no rows;
further columns of any name are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm.common import global_prefix, materialize, read_table
from savora.llm.components import components

COSINE = 0.98
BLOCK = 256
BITS = 62
MISS = 1e-5
PROBES, STEP = 16, 4


def n_passes(largest: int, block: int = BLOCK, cosine: float = COSINE, miss: float = MISS) -> int:
    """Two vectors that share the first log2(largest / block) bits lie within a window."""
    return passes_for(agreeing(cosine) ** first_bits(largest, block), miss)


def first_bits(largest: int, block: int) -> float:
    return max(1.0, math.log2(max(1, largest) / block) + 1)


def agreeing(cosine: float) -> float:
    """The chance that two vectors lie on the same side of a random hyperplane."""
    return 1 - math.acos(cosine) / math.pi


def passes_for(meet: float, miss: float = MISS) -> int:
    return max(2, math.ceil(math.log(miss) / math.log(1 - meet)))


def projection_keys(vectors: np.ndarray, passes: int, seed: int = 5) -> np.ndarray:
    """A row of keys for each vector: BITS sides of random hyperplanes, the first most significant."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], passes * BITS))
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    step = max(1, 2_000_000 // (passes * BITS))
    parts = [(vectors[k : k + step] @ planes > 0).reshape(-1, passes, BITS) @ weights for k in range(0, len(vectors), step)]
    return np.concatenate(parts) if parts else np.empty((0, passes), dtype=np.int64)


def _keys(passes: int, seed: int = 5):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = np.asarray(batch.column(2).flatten()), np.cumsum([0, *np.asarray(pa.compute.list_value_length(batch.column(2))).tolist()])
            out = np.empty((batch.num_rows, passes), dtype=np.int64)
            lengths = np.diff(ends)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                out[at] = projection_keys(values[ends[at][:, None] + np.arange(size)], passes, seed)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(out) + 1) * passes).astype(np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["rep", "code", "keys"])

    return run, "rep long, code long, keys array<long>"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """code, p, cell, v -> one row for each cell of a batch: how many vectors, and the sum of them at length 1."""
    for batch in batches:
        groups: dict[tuple, list[int]] = {}
        for k, cell in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            groups.setdefault(cell, []).append(k)
        column = batch.column(3)
        ends = np.cumsum([0, *np.asarray(pa.compute.list_value_length(column)).tolist()])
        values, sums = np.asarray(column.flatten()), []
        for at in groups.values():
            v = np.stack([values[ends[k] : ends[k + 1]] for k in at])
            sums.append((v / np.linalg.norm(v, axis=1, keepdims=True)).sum(axis=0).tolist())
        code, p, cell = (list(x) for x in zip(*groups)) if groups else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(p, pa.int32()), pa.array(cell, pa.int64()), pa.array([len(at) for at in groups.values()], pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["code", "p", "cell", "m", "total"])


def meeting(classes: DataFrame, largest: int, block: int = BLOCK, cosine: float = COSINE) -> float:
    """The least chance, over all vectors, that one at the threshold from it lies within its window in a pass.

    A vector takes bits until no more than a block of vectors shares them, or those that do are so
    alike that they are links of each other (for those the window is moved on instead).
    """
    run, schema = _keys(PROBES, seed=6)
    probed = classes.select("rep", "code", "v").mapInArrow(run, schema).select("rep", "code", F.posexplode("keys").alias("p", "key"))
    left = materialize(probed, "vector-probes")
    bits, lost = math.ceil(first_bits(largest, block)), None
    while bits < BITS:
        here = left.withColumn("cell", F.shiftright("key", BITS - bits))
        cells = ["code", "p", "cell"]
        crowds = materialize(here.groupBy(*cells).count().where(F.col("count") > block).select(*cells), "vector-crowds")
        if crowds.isEmpty():
            break
        crowded = here.join(crowds, cells, "left_semi")
        parts = crowded.join(classes.select("rep", "v"), "rep").select(*cells, "v").mapInArrow(_sums, "code long, p int, cell long, m long, total array<double>")
        single = parts.select(*cells, "m", F.posexplode("total").alias("d", "x")).groupBy(*cells, "d").agg(F.sum("x").alias("x"), F.sum("m").alias("m"))
        loose = single.groupBy(*cells).agg(F.sum(F.col("x") * F.col("x")).alias("s"), F.max("m").alias("m")).where(F.col("s") < F.lit(cosine) * F.col("m") * F.col("m"))
        left = materialize(crowded.join(loose.select(*cells), cells, "left_semi").drop("cell"), "vector-loose")
        after = min(BITS, bits + STEP)
        step = left.select("rep", F.lit(agreeing(cosine) ** bits - agreeing(cosine) ** after).alias("x"))
        lost, bits = step if lost is None else lost.unionByName(step), after
    worst = 0.0 if lost is None else lost.groupBy("rep").agg(F.sum("x").alias("x")).agg(F.max("x")).first()[0] or 0.0
    return agreeing(cosine) ** first_bits(largest, block) if not worst else agreeing(cosine) ** math.ceil(first_bits(largest, block)) - worst / PROBES


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return slim.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))


def _blocks(keyed: DataFrame, classes: DataFrame, passes: int, block: int) -> DataFrame:
    """classes with the number of each one's block in every pass."""
    total = classes.count()
    keys = keyed.select("rep", "code", F.posexplode("keys").alias("p", "key"))
    placed = global_prefix(keys, ["p", "code", "key", "rep"], {}, "vector-order")
    placed = placed.select("rep", F.struct("p", F.floor((F.col("row_index") - F.col("p") * F.lit(total)) / block).cast("int").alias("block")).alias("x"))
    lists = placed.groupBy("rep").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["block"]).alias("blocks"))
    return materialize(classes.join(lists, "rep"), "vector-blocks")


def _compare(cosine: float, dense: int):
    """Links between block ``base`` (side 0) and the one ``shift`` further on (side 1), and inside ``base`` when shift is 1."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        p, base, shift = (x.as_py() for x in key)
        order = np.argsort(np.asarray(table["rep"]), kind="stable")
        rep, side, code, size = (np.asarray(table[c])[order] for c in ("rep", "side", "code", "size"))
        column = table["v"].combine_chunks()
        sizes = np.asarray(pa.compute.list_value_length(column))
        vectors = np.zeros((len(rep), int(sizes.max())))  # padded: a block may hold labels, or sizes, side by side
        vectors[np.arange(vectors.shape[1]) < sizes[:, None]] = np.asarray(column.flatten())
        vectors = vectors[order]
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        blocks, before, now = (np.stack(table[c].to_numpy(zero_copy_only=False))[order] for c in ("blocks", "before", "now"))
        close = (vectors @ vectors.T >= cosine) & (code[:, None] == code)
        across = (side == 0)[:, None] & (side == 1)
        crowded = bool((close & across).sum(axis=1).max(initial=0) >= dense)
        i, j = np.nonzero(np.triu(close & ((side == 0)[:, None] & (side == 0) | across | across.T if shift == 1 else across | across.T), 1))
        gap = np.abs(blocks[i] - blocks[j])
        lower = np.where(blocks[i] <= blocks[j], i[:, None], j[:, None])
        passes = np.arange(blocks.shape[1])
        seen = (gap <= before[lower, passes]).any(axis=1) | (gap[:, :p] <= now[lower[:, :p], passes[:p]]).any(axis=1)
        i, j = i[~seen], j[~seen]
        links = (np.bincount(i, weights=size[j], minlength=len(rep)) + np.bincount(j, weights=size[i], minlength=len(rep))).astype(np.int64)
        root = np.arange(len(rep))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        top = np.array([find(x) for x in range(len(rep))], dtype=np.int64)
        keep = links > 0
        keep[:1] |= crowded
        n = int(keep.sum())
        return pa.table({"p": pa.array([p] * n, pa.int32()), "base": pa.array([base] * n, pa.int32()), "shift": pa.array([shift] * n, pa.int32()), "rep": rep[keep], "links": links[keep], "root": rep[top][keep], "crowded": pa.array([crowded] * n, pa.bool_())})

    return run, "p int, base int, shift int, rep long, links long, root long, crowded boolean"


def _reaches(placed: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """placed with how far each row's block was compared in every pass: before this round, and with it."""
    at = placed.select("rep", F.posexplode("blocks").alias("p", "block"))
    met = at.join(before.withColumnRenamed("r", "r0"), ["p", "block"], "left").join(now.withColumnRenamed("r", "r1"), ["p", "block"], "left")
    r0 = F.coalesce("r0", F.lit(1))
    both = met.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("p", r0.alias("r0"), F.greatest(r0, F.coalesce("r1", F.lit(1))).alias("r1")))).alias("x"))
    return placed.join(both.select("rep", F.transform("x", lambda x: x["r0"]).alias("before"), F.transform("x", lambda x: x["r1"]).alias("now")), "rep")


def _rounds(spark: SparkSession, placed: DataFrame, passes: int, block: int, cosine: float) -> DataFrame:
    """Counts and forests of all tasks: rep, links, root."""
    run, schema = _compare(cosine, max(1, block // 8))
    fill = lambda k: F.array_repeat(F.lit(k), passes)
    rows = placed.withColumn("before", fill(-1)).withColumn("now", fill(1)).select("*", F.posexplode("blocks").alias("p", "block"))
    sides = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), F.lit(1).alias("shift")).withColumn("base", F.col("block") - F.col("side"))
    done, reach = None, spark.createDataFrame([], "p int, block int, r int")
    width = 2  # the next round's first shift
    while True:
        out = sides.where("base >= 0").groupBy("p", "base", "shift").applyInArrow(run, schema)
        out = materialize(out, "vector-links")
        done = out if done is None else done.unionByName(out)
        open_blocks = materialize(out.where(F.col("crowded") & (F.col("shift") == width - 1)).select("p", "base").distinct(), "vector-open")
        if open_blocks.isEmpty():
            return done
        now = open_blocks.select("p", F.col("base").alias("block"), F.lit(2 * width - 1).alias("r"))
        reached = materialize(_reaches(placed, reach, now), "vector-reach").select("*", F.posexplode("blocks").alias("p", "block"))
        shifts = F.explode(F.sequence(F.lit(width), F.lit(2 * width - 1))).alias("shift")
        here = reached.join(open_blocks.withColumnRenamed("base", "block"), ["p", "block"], "left_semi").select("*", F.lit(0).alias("side"), shifts).withColumn("base", F.col("block"))
        there = reached.select("*", F.lit(1).alias("side"), shifts).withColumn("base", F.col("block") - F.col("shift"))
        there = there.join(open_blocks, ["p", "base"], "left_semi")
        sides = here.unionByName(there)
        reach = reach.unionByName(now).groupBy("p", "block").agg(F.max("r").alias("r"))
        width *= 2


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """For every row: id_col, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, label_col)
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    classes = materialize(classes.select("*", F.xxhash64("label", F.size("v")).alias("code"), F.monotonically_increasing_id().alias("rep")), "vector-classes")
    largest = classes.groupBy("code").count().agg(F.max("count")).first()[0] or 0
    none = F.lit(0).cast("long")
    if not largest:
        return rows.select(F.col("id").alias(id_col), none.alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    passes = passes_for(meeting(classes, largest, block, cosine), miss)
    run, schema = _keys(passes)
    keyed = classes.select("rep", "code", "v").mapInArrow(run, schema)
    placed = _blocks(keyed, classes.select("rep", "code", "v", "size"), passes, block)
    found = _rounds(spark, placed, passes, block, cosine)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    there = materialize(rows.where("ok").join(classes.select("label", "v", "rep", "size", "least"), ["label", "v"]).select("id", "rep", "size", "least"), "vector-rows")
    # rows that share an id and lie in several classes tie these together
    shared = there.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    ties = there.join(shared.select("id", "a"), "id").select("a", F.col("rep").alias("b"))
    edges = found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(ties.where("a <> b")).distinct()
    roots = components(edges, "vector-components")
    settled = classes.select("rep", "least").join(roots, F.col("rep") == F.col("node"), "left").select("rep", "least", F.coalesce("root", "rep").alias("root"))
    settled = materialize(settled, "vector-settled")
    first = settled.groupBy("root").agg(F.min("least").alias("component"))
    settled = settled.join(first, "root").join(counts, "rep", "left").select("rep", "component", "links")
    there = there.join(settled, "rep").select("id", (F.coalesce("links", none) + F.col("size") - 1).alias("links"), F.col("component").alias("root"))
    there = there.unionByName(rows.where("not ok").select("id", none.alias("links"), F.col("id").alias("root")))
    return there.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH RECURSIVE fine AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98
), reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r
), roots AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id
), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM roots LEFT JOIN counts USING (vec_id)
"""
