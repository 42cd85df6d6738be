"""Helpers shared by the training-data operators: tables, scratch space, global prefix sums."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of characters other than ASCII white space (Java and Python regular expressions agree on it).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and all runs on one machine (tests), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="savora-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/savora/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote, once nothing that still has to run reads them."""
    for table in tables:
        spark, path = table.sparkSession, vars(table)["_scratch"]
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Collects here and in the driver's JVM, so that Spark's cleaner removes the shuffle files of plans that are out of reach.

    Listeners hold the last job's plan for a moment, so one collection isn't enough. For operators
    that move several times their input, at a second a call.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def located(docs: DataFrame, columns: list[str], stored: bool = False) -> DataFrame:
    """The columns as _c0, _c1 ... with _at, which tells the row's place in files.

    stored: docs is a table as it lies in files, each of its rows once (nothing above the scan makes
    several rows of one), so that places there name its rows. All others are written first.
    """
    chosen = [F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(columns)]
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_at")
    try:
        if stored and "_metadata" not in docs.columns:
            return docs.select(*chosen, place)
    except AnalysisException:
        pass
    return materialize(docs.select(*chosen), "located").select("*", place)


def global_prefix(df: DataFrame, order: list, sums: dict[str, str], tag: str) -> DataFrame:
    """Adds row_index and, for each name -> column of sums, the sum over all rows before, in the order given.

    The rows are range-partitioned and sorted once; in the same stage each partition counts and sums
    as it goes, and the rows are written with these local figures. Each partition's totals (one row
    for each) are summed up and added. Only the totals meet in one task; rows never do, and they are
    not shuffled again. Rows that tie in the order must be interchangeable.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    names = ["row_index", *sums]
    schema = T.StructType([*ranged.schema, *[T.StructField(n, T.LongType()) for n in names]])
    columns = list(sums.values())

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = [0] * len(names)
        for batch in batches:
            values = [np.ones(batch.num_rows, dtype=np.int64), *[np.asarray(batch.column(batch.schema.get_field_index(c)).fill_null(0)) for c in columns]]
            ends = [np.cumsum(v) + d for v, d in zip(values, done, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(e - v) for e, v in zip(ends, values, strict=True)]], names=schema.names)
            done = [int(e[-1]) if len(e) else d for e, d in zip(ends, done, strict=True)]

    stored = materialize(ranged.mapInArrow(running, schema), tag)
    totals = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_t_row_index"), *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    # offsets has one row for each shuffle partition, so its size is bounded by the job's own width
    joined = stored.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in names])
