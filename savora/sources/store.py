"""Tables that can be upserted: copy-on-write buckets of Parquet files behind a commit log.

A store holds tables that share a key. Each row lies in the bucket of its key's hash; a commit
writes the touched buckets anew, as files that nobody reads yet, and then one small log entry that
names them, for all tables together. Readers follow the log: of each table and bucket the folder of
the last entry counts. So a commit is there as a whole or not at all; what a crash leaves behind is
never read. Entries carry the writer's name and its batch number, and a batch that is in the log
already changes nothing, which makes ``foreachBatch`` exactly-once. One writer at a time.

What comes to the driver is a row for each table and bucket. Hot keys: a bucket's rows are spread
over several files by Spark's rebalancing.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "n long, writer string, batch long, tab string, bucket int, folder string"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set and all runs on one machine (tests), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="savora-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def work_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/savora/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a table of the shared folder, for what several branches of a plan read: it is made once, and a lost executor loses nothing."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Tables by name with their columns; all have the column ``key``."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.tables = {name: T.StructType.fromDDL(columns) for name, columns in tables.items()}

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def done(self, writer: str, batch: int) -> bool:
        return not self.log().where((F.col("writer") == writer) & (F.col("batch") == batch)).isEmpty()

    def live(self) -> tuple[int, dict[str, dict[int, str]]]:
        """The last entry's number, and the folder of each table and bucket."""
        last = self.log().groupBy("tab", "bucket").agg(F.max(F.struct("n", "folder")).alias("x")).select("tab", "bucket", "x.*").collect()
        out: dict[str, dict[int, str]] = {name: {} for name in self.tables}
        for r in last:
            if r["folder"]:
                out[r["tab"]][r["bucket"]] = r["folder"]
        return max((r["n"] for r in last), default=-1), out

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table as of now, or its rows in some buckets; later commits don't change what is read here."""
        folders = [f for b, f in self.live()[1][name].items() if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.tables[name])
        return self.spark.read.schema(self.tables[name]).parquet(*folders)

    def touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def commit(self, writer: str, batch: int, buckets: set[int], contents: dict[str, DataFrame]) -> None:
        """contents: all rows that these buckets hold from now on, of each table that changes."""
        n, _ = self.live()
        entries = []
        for name, rows in contents.items():
            folder = f"{self.path}/data/{name}/{n + 1:012d}-{uuid.uuid4().hex}"
            placed = rows.select(*self.tables[name].names).withColumn("bucket", self.bucket())
            placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
            try:
                full = {r[0] for r in self.spark.read.parquet(folder).select("bucket").distinct().collect()}
            except AnalysisException as error:
                if error.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                    raise
                full = set()
            if not full <= buckets:
                raise ValueError("rows outside the buckets that are written")
            entries += [(n + 1, writer, batch, name, b, f"{folder}/bucket={b}" if b in full else None) for b in sorted(buckets)]
        entries = entries or [(n + 1, writer, batch, next(iter(self.tables)), -1, None)]
        self.spark.createDataFrame(entries, LOG).coalesce(1).write.parquet(f"{self.path}/log/{n + 1:012d}-{uuid.uuid4().hex}")

    def sink(self, writer: str, step: Callable[[Store, DataFrame], tuple[set[int], dict[str, DataFrame]]]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: step gives the touched buckets and their new contents; a batch that was committed is skipped."""

        def run(rows: DataFrame, batch: int) -> None:
            if not self.done(writer, batch):
                self.commit(writer, batch, *step(self, rows))

        return run
