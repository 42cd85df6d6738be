"""Exact dedup as a stateful stream, with DataFrame operations only.

A first pass writes each row's fingerprint: digest of the normalised text, stable identifier,
code points, and a content locator (file and row in it). The fingerprints are a stream; its keyed
state, one entry for each digest, lies on disk (RocksDB), never expires, and retains the
digest, the number of rows and the best row's identifier and locator. The map side combines
before the shuffle, so a group with a third of all rows sends one row a task. With ``state_dir`` the
state outlives the call: rows of a later delivery are held against all earlier ones. A delivery with
a name of its own can be given again after a failure: its texts and fingerprints count once they
are complete and a small entry names them (fingerprints without an entry are passed over, those
with one are not written again), and the state's changes are kept until then.

Digests only find the hits: digests that the state has met more than once. For these, and only for
these, the full bytes are fetched and compared: the smallest and the largest normalised text of the
delivery's rows and of the retained row that the locator points to, again combined before the
shuffle, must be equal. Rows of a digest for which they are not are grouped by the text itself.

Defined results: a null text counts as empty, and all empty texts are one group; very long texts
are compared whole; a null id loses to any other; of rows that repeat an id and its text, the first
in the files stays; an empty table gives no rows; further columns of any name are left alone. A
later delivery's best row can be longer than one kept before: it is then the one to keep, and the
earlier decision stands until its delivery is read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from savora.llm.common import SPACE, located, materialize, read_table, scratch_path

#: State on disk; with fallocate each of many small stores would reserve megabytes that it never fills.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


#: Bitmaps of hits: how many, and the bits of each (Spark's own size).
MAPS, MAP_BITS = 2048, 32768
#: A delivery's entry: where its texts and fingerprints lie. A delivery has one at most.
ENTRY = "attempt string, texts string"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def keyed_state(spark: SparkSession, prints: DataFrame, folder: str, files_a_batch: int | None = None, lasting: bool = False) -> DataFrame:
    """Streams the fingerprints under folder that were not met yet through its keyed state: digest, size, best (a struct; the least rank wins) of all digests met in this call.

    lasting: of all digests met so far; only fingerprints of deliveries that have an entry count.
    """
    out = f"{folder}/states" if lasting else scratch_path(spark, "dedup-state")
    reader = spark.readStream.schema(prints.schema).option("recursiveFileLookup", "true")
    stream = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(f"{folder}/prints")
    if lasting:
        stream = stream.join(spark.read.schema(ENTRY).parquet(f"{folder}/deliveries/*").select("attempt"), "attempt")
    state = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min("rank").alias("best"))

    def save(changed: DataFrame, batch: int) -> None:  # a batch that is repeated replaces its own output
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    none = spark.createDataFrame([], state.schema)
    none.withColumn("batch", F.lit(-1)).write.mode("append").partitionBy("batch").parquet(out)  # so that there is a table even without batches
    saved = spark.read.schema(state.withColumn("batch", F.lit(0)).schema).parquet(out)
    # a digest met in several batches has its last state
    return saved.groupBy("digest").agg(F.max_by(F.struct("size", "best"), "batch").alias("last")).select("digest", "last.size", "last.best")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, stored: bool = False, state_dir: str | None = None, delivery: str | None = None) -> DataFrame:
    """For every row: id_col, keep_id, group_size, kept, text_sha256; stored as in common.located.

    state_dir: a folder for the state, in storage that all executors share, given again with the next delivery.
    delivery: its name, given again when the call is tried again; each call without one is a delivery of its own.
    """
    name = delivery or uuid.uuid4().hex
    return _decided(_placed(docs, [id_col, text_col], stored, state_dir, name), digest, state_dir, name).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False, state_dir: str | None = None, delivery: str | None = None) -> DataFrame:
    """docs without the rows that exact_dedup drops; stored as in common.located."""
    delivery = delivery or uuid.uuid4().hex
    names = [id_col, text_col, *[x for x in docs.columns if x not in (id_col, text_col)]]
    rows = _placed(docs, names, stored, state_dir, delivery)
    kept = _decided(rows, sha256, state_dir, delivery).where("kept").select("at")
    c = {name: f"_c{k}" for k, name in enumerate(names)}
    return rows.join(kept, rows["_at"] == kept["at"], "left_semi").select(*[F.col(c[name]).alias(name) for name in docs.columns])


def _entry(spark: SparkSession, state_dir: str, delivery: str) -> Row | None:
    try:
        return spark.read.schema(ENTRY).parquet(f"{state_dir}/deliveries/{delivery}").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _placed(docs: DataFrame, names: list[str], stored: bool, state_dir: str | None, delivery: str) -> DataFrame:
    """The columns named as _c0 (id), _c1 (text) ..., with _at; under a lasting state they are kept where locators can point to."""
    if state_dir is None:
        return located(docs, names, stored)
    chosen = docs.select(*[F.col(f"`{name}`").alias(f"_c{k}") for k, name in enumerate(names)])
    known = _entry(docs.sparkSession, state_dir, delivery)
    path = known["texts"] if known else f"{state_dir}/texts/{uuid.uuid4().hex}"
    if not known:
        chosen.write.parquet(path)
    rows = located(docs.sparkSession.read.schema(chosen.schema).parquet(path), chosen.columns, stored=True)
    rows._texts = path
    return rows


def _keyed(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Each row's digests, normalised text and rank (the least of a group stays)."""
    keyed = rows.select(F.col("_c0").alias("id"), F.col("_at").alias("at"), F.coalesce(F.char_length("_c1"), F.lit(0)).alias("n"), normal(F.col("_c1")).alias("body"))
    keyed = keyed.withColumn("sha", sha256(F.col("body"))).withColumn("digest", F.col("sha") if digest is sha256 else digest(F.col("body")))
    return keyed.withColumn("rank", F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("at").alias("at")))


def _marked(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows whose digest may be a hit, by bitmaps of the hits' hashes, so that other texts aren't shuffled.

    There are ``MAPS`` bitmaps of 4 KB at most, so what is broadcast is bounded by 8 MB; with more hits than they can
    tell apart more rows pass, and the join that follows sorts them out.
    """
    place = F.pmod(F.xxhash64("digest"), F.lit(MAPS * MAP_BITS))
    number, bit = F.floor(place / MAP_BITS).cast("int"), F.pmod(place, F.lit(MAP_BITS))
    maps = hits.select(number.alias("map"), bit.alias("bit")).groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(maps), (number == F.col("map")) & (F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))) % 2 == 1), "left_semi")


def _retained(spark: SparkSession, best: DataFrame) -> DataFrame | None:
    """digest, body of retained rows that earlier deliveries hold, fetched by their locators."""
    files = [r.file for r in best.select("best.at.file").distinct().collect()]  # files, not rows
    if not files:
        return None
    old = spark.read.schema("_c1 string").parquet(*files).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"), normal(F.col("_c1")).alias("body"))
    return best.select("digest", F.col("best.at").alias("at")).join(old, "at").select("digest", "body")


def _printed(rows: DataFrame, printed: DataFrame, state_dir: str, delivery: str) -> DataFrame:
    """The delivery's fingerprints, written and entered unless an earlier try has done so."""
    spark, known = rows.sparkSession, _entry(rows.sparkSession, state_dir, delivery)
    attempt = known["attempt"] if known else uuid.uuid4().hex
    path = f"{state_dir}/prints/{attempt}"
    wide = printed.withColumn("attempt", F.lit(attempt))
    if not known:
        wide.write.parquet(path)
        spark.createDataFrame([(attempt, vars(rows)["_texts"])], ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{state_dir}/deliveries/{delivery}")
    return spark.read.schema(wide.schema).parquet(path)


def _decided(rows: DataFrame, digest: Callable[[Column], Column], state_dir: str | None = None, delivery: str = "") -> DataFrame:
    spark = rows.sparkSession
    folder = state_dir or scratch_path(spark, "dedup")
    keyed = _keyed(rows, digest)
    printed = keyed.select("digest", "rank", *([] if digest is sha256 else ["sha"]))
    if state_dir:
        prints = _printed(rows, printed, state_dir, delivery)
        state = keyed_state(spark, prints, folder, lasting=True).join(prints.select("digest").distinct(), "digest", "left_semi")
    else:
        path = f"{folder}/prints/{uuid.uuid4().hex}"
        printed.write.parquet(path)
        prints = spark.read.schema(printed.schema).parquet(path)
        state = keyed_state(spark, prints, folder)
    state = materialize(state, "dedup-decided")
    sha = F.col("digest") if digest is sha256 else F.col("sha")

    def decided(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
        best = F.col("best")
        return rows.join(groups, key).select(
            F.col("rank.id").alias("id"), F.col("rank.at").alias("at"), best["id"].alias("keep_id"), F.col("size").alias("group_size"), (F.col("rank.at") == best["at"]).alias("kept"), sha.alias("text_sha256")
        )

    # the bytes behind the hits; where two texts meet in one digest, the text itself is the key
    hits = materialize(state.where("size > 1").select("digest"), "dedup-hits")
    bodies = _marked(keyed.select("digest", "body"), hits).join(hits, "digest", "left_semi")
    if state_dir:
        here = prints.select(F.col("rank.at").alias("at"))
        before = _retained(spark, state.where("size > 1").join(here, F.col("best.at") == F.col("at"), "left_anti"))
        bodies = bodies if before is None else bodies.unionByName(before)
    spans = bodies.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    clashes = materialize(spans.where("low <> high").select("digest"), "dedup-clashes")
    if clashes.isEmpty():
        return decided(prints, state, ["digest"])
    whole = keyed.select("digest", "rank", "sha", "body").join(clashes, "digest", "left_semi")
    apart = decided(whole, whole.groupBy("body").agg(F.count(F.lit(1)).alias("size"), F.min("rank").alias("best")), ["body"])
    return decided(prints.join(clashes, "digest", "left_anti"), state, ["digest"]).unionByName(apart)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), stored=True)


OP9_SQL = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents
)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM keyed WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
