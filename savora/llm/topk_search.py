"""Exact search for the k largest inner products by a pivot-distance index.

Vectors become whole numbers, floor(scale * x). Equal ones are one class, known by its least ids
(one more than k, so that a query's own row can be left out). One more coordinate,
sqrt(M^2 - |y|^2) with M the largest length (0 for queries), turns the largest inner product into
the least distance: |q - y|^2 = |q|^2 + M^2 - 2 * score.

Index: each class is keyed by its nearest pivot and its distance to it, sorted so, and cut into
annuli of at most ``BLOCK`` classes. Pivots are the centres of k-means on a sample of at most
``SAMPLE`` vectors (those of least hash); every row is indexed, and the pivots only decide how many
annuli a query has to visit. By the triangle inequality no vector of the annulus [lo, hi] around a
pivot at distance D is nearer than max(lo - D, D - hi, 0). Queries visit annuli in the order of that
bound, in growing rounds (``FIRST`` annuli, then ``GROW`` times as many each, up to ``WIDEST``), and stop once the bound passes the
distance of the last of their k + 1 best, so nothing is lost. A round compares groups of at most
``QUERIES`` queries, near each other by pivot and distance, with an annulus each: a task holds one
of either, and lists nothing but the best of its annulus for each query.

Defined results: vectors that are null or empty or hold null or non-finite components take no part;
vectors of different sizes are not compared; a query's own row is left out, other rows with its id
or its vector are not; a query that is there twice is answered twice; a null id is no query, and
comes last among ties; a query without candidates gives no rows; an empty table gives none;
components beyond 2^53 and scores beyond a long count as those bounds; further columns of any name
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from savora.llm.common import discard, global_prefix, materialize, read_table

K = 5
SCALE = 256
PIVOTS = 32
SAMPLE = 2048
BLOCK = 1024
QUERIES = 1024
FIRST, GROW, WIDEST = 4, 4, 1024
MOST = float(2**53)
LEAST_LONG, MOST_LONG = -(2**63) + 1, 2**63 - 1
ENTRY = ("query", "class", "id", "copy", "score")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row for each list of the column; all lists are of one size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and v, the vector in whole numbers, of rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & (F.size(v) > 0)
    put = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), x * scale))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda x: F.floor(put(x)).cast("long")).alias("v"))


def centres(points: np.ndarray, n: int) -> np.ndarray:
    """k-means of a small sample: far-apart starts, then Lloyd's steps."""
    chosen = [int(np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1)))]
    least = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)) and least.max() > 0:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    at = points[chosen]
    for _ in range(8):
        nearest = np.argmin((at**2).sum(axis=1) - 2 * points @ at.T, axis=1)
        at = np.stack([points[nearest == j].mean(axis=0) if (nearest == j).any() else at[j] for j in range(len(at))])
    return at


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """With the coordinate that makes all vectors as long as the longest."""
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(0.0, most - (v * v).sum(axis=1)))])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Differences are squared, not expanded, so that near points keep their digits."""
    return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(points) else np.empty((0, len(pivots)))


def _keyed(pivots: np.ndarray, most: float, query: bool):
    """Adds pivot and r, the nearest pivot and its distance; for queries also all distances, away, and the squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1))
            away = distances(np.column_stack([v.astype(np.float64), np.zeros(len(v))]) if query else lifted(v, most), pivots)
            j = away.argmin(axis=1)
            out = [*batch.columns, pa.array(j.astype(np.int32)), pa.array(away[np.arange(len(j)), j])]
            if query:
                out += [pa.ListArray.from_arrays(pa.array((np.arange(len(v) + 1) * len(pivots)).astype(np.int32)), pa.array(away.ravel())), pa.array((v.astype(np.float64) ** 2).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "pivot", "r", *(["away", "own"] if query else [])])

    return run


def products(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every sum stays below 2^53."""
    if q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(y).max(initial=0)) < MOST:
        return (q.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ y.astype(object).T, LEAST_LONG, MOST_LONG).astype(np.int64)


def _best(top: int):
    """The best rows of an annulus for each query of a group that visits it, none below what the query has already."""

    def run(key: tuple, asked: pa.Table, there: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and there.num_rows:
            ids = there["ids"].to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i][0] is None, ids[i][0]))  # classes by their least id
            classes, ids = np.asarray(there["class"])[order].tolist(), [ids[i] for i in order]
            scores = products(matrix(asked["v"]), matrix(there["v"])[order])
            for query, floor, row in zip(asked["query"].to_pylist(), asked["floor"].to_pylist(), scores, strict=True):
                if len(row) > top:
                    bar = int(np.partition(row, len(row) - top)[len(row) - top])
                    floor = bar if floor is None else max(floor, bar)
                at = np.arange(len(row)) if floor is None else np.flatnonzero(row >= floor)
                for i in at[np.argsort(-row[at], kind="stable")][:top].tolist():
                    out += [(query, classes[i], x, copy, int(row[i])) for copy, x in enumerate(ids[i])]
        types = (pa.int64(), pa.int64(), there.schema.field("ids").type.value_type, pa.int32(), pa.int64())
        columns = list(zip(*out, strict=True)) or [()] * len(types)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(ENTRY, columns, types, strict=True)})

    return run


def _search(index: DataFrame, queries: DataFrame, directory: DataFrame, most: float, top: int, id_type: str) -> DataFrame:
    """query, class, id, copy, score, place: the first top rows of every query class."""
    away = queries.select("query", "own", F.posexplode("away").alias("pivot", "d"))
    state = queries.select("query", F.lit(None).cast("long").alias("floor"), F.lit(-1.0).alias("seen"), F.lit(-1).cast("long").alias("last"))
    # Spark takes the best of each task before the shuffle
    ranks = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "class", "copy"))
    room = F.col("own") + F.lit(most)
    far = room - 2.0 * F.col("floor") + 1e-9 * room + 1e-6  # squared distance of the last of the best, and room for rounding
    best, wave = None, FIRST
    while True:
        bound = lambda a: F.greatest(a["lo"] - F.col("d"), F.col("d") - a["hi"], F.lit(0.0))
        later = lambda a: (a["bound"] > F.col("seen")) | ((a["bound"] == F.col("seen")) & (a["block"] > F.col("last")))
        listed = F.transform("annuli", lambda a: F.struct(bound(a).alias("bound"), a["block"].alias("block")))
        ahead = F.filter(listed, lambda a: later(a) & (F.col("floor").isNull() | (a["bound"] * a["bound"] <= far)))
        lists = away.join(state, "query").join(directory, "pivot").select("query", F.slice(F.sort_array(ahead), 1, wave).alias("a")).where(F.size("a") > 0)
        chosen = lists.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("a"))), 1, wave).alias("a"))
        visits = materialize(chosen.select("query", F.explode("a").alias("a")).select("query", "a.*"), "search-visits")
        if best is not None and visits.isEmpty():
            discard(visits)
            return best
        asked = visits.join(state, "query").join(queries, "query").select("block", "group", "query", "floor", "v")
        wanted = asked.select(F.col("block").alias("at"), F.col("group").alias("for")).distinct()
        there = index.join(wanted, F.col("block") == F.col("at")).select("at", "for", "class", "ids", "v")
        found = asked.groupBy("block", "group").cogroup(there.groupBy("at", "for")).applyInArrow(_best(top), f"query long, class long, id {id_type}, copy int, score long")
        found = found if best is None else found.unionByName(best.select(*ENTRY))
        best = materialize(found.withColumn("place", ranks).where(F.col("place") <= top), "search-best")
        floors = best.where(F.col("place") == top).select("query", F.col("score").alias("floor"))
        ends = visits.groupBy("query").agg(F.max(F.struct("bound", "block")).alias("e"))  # queries that visited nothing have ended
        state = materialize(ends.join(floors, "query", "left").select("query", "floor", F.col("e.bound").alias("seen"), F.col("e.block").alias("last")), "search-state")
        wave = min(wave * GROW, WIDEST)


def _of_one_size(rows: DataFrame, k: int, pivots: int, block: int, group: int) -> DataFrame:
    """rows: id, v, asks, of vectors of one size."""
    top, id_type = k + 1, rows.schema["id"].dataType.simpleString()
    # of equal vectors, the least ids of each task go to the shuffle
    copies = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last()))).where(F.col("n") <= top)
    lists = copies.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
    classes = materialize(lists.withColumn("class", F.monotonically_increasing_id()), "search-classes")
    most = float(classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0])
    sample = classes.orderBy(F.xxhash64("v"), "class").limit(SAMPLE).select("v").toArrow()
    at = centres(lifted(matrix(sample["v"]), most), pivots)
    keyed = classes.select("class", "v", "ids").mapInArrow(_keyed(at, most, False), f"class long, v {_kind(rows)}, ids array<{id_type}>, pivot int, r double")
    placed = global_prefix(keyed, ["pivot", "r", "class"], {}, "search-order")
    first = placed.groupBy("pivot").agg(F.min("row_index").alias("first"))  # a row for each pivot
    index = materialize(placed.join(F.broadcast(first), "pivot").select("class", "v", "ids", "pivot", "r", (F.shiftleft(F.col("pivot").cast("long"), 40) + F.floor((F.col("row_index") - F.col("first")) / block)).alias("block")), "search-index")
    annuli = index.groupBy("pivot", "block").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    directory = materialize(annuli.groupBy("pivot").agg(F.sort_array(F.collect_list(F.struct("block", "lo", "hi"))).alias("annuli")), "search-directory")
    asking = materialize(rows.where("asks").join(classes.select("v", "class"), "v").select("id", "class"), "search-asking")
    asked = classes.join(asking.select("class").distinct(), "class").select(F.col("class").alias("query"), "v")
    far = asked.mapInArrow(_keyed(at, most, True), f"query long, v {_kind(rows)}, pivot int, r double, away array<double>, own double")
    queries = global_prefix(far, ["pivot", "r", "query"], {}, "search-queries").withColumn("group", F.floor(F.col("row_index") / group))
    best = _search(index, materialize(queries.select("query", "v", "away", "own", "group"), "search-groups"), directory, most, top, id_type)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "class", "id", "score"))).alias("a"))  # at most top each
    mine = asking.join(lists, F.col("class") == F.col("query"))
    own = F.array_position(F.transform("a", lambda x: (x["class"] == F.col("class")) & x["id"].eqNullSafe(F.col("id"))), True)
    others = F.filter("a", lambda x, n: n + 1 != own)
    return mine.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("n", "x")).select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


def _kind(rows: DataFrame) -> str:
    return rows.schema["v"].dataType.simpleString()


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK, group: int = QUERIES) -> DataFrame:
    """query_id, rank from 1, id_col, score: the k best other rows of every row for which is_query (a condition on ``id``) holds."""
    rows = materialize(whole(vectors, id_col, vector_col, scale).withColumn("asks", F.coalesce(is_query, F.lit(False))), "search-rows")
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.max("asks").alias("asks")).collect()  # a row for each size of vectors
    out = [_of_one_size(_narrow(rows.where(F.size("v") == s["size"]), s["most"]), k, pivots, block, group) for s in sizes if s["asks"]]
    if not out:
        out = [rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0).cast("long").alias("score")).limit(0)]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0].withColumnRenamed("id", id_col)


def _narrow(rows: DataFrame, most: int) -> DataFrame:
    """Half the bytes where all components fit."""
    return rows.withColumn("v", F.col("v").cast("array<int>")) if most < 2**31 else rows


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP13_SQL = r"""
WITH fine AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.n AS qn, y.vec_id, CAST(list_dot_product(q.v, y.v) AS BIGINT) AS score
  FROM fine q JOIN fine y ON q.n <> y.n AND len(q.v) = len(y.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
"""
