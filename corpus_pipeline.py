"""From raw documents to a deduplicated, mixed and encoded corpus.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame; the result is written as Parquet and read again as the next stage's docs. All stages but
the last return the columns of documents.

Defined results, for every stage: null texts count as empty and stay with their rows until a stage's
own rule drops them; very long texts are worked on whole; rows that share an id are rows of their
own, except that near-dedup takes them for one node; a null id never is a near copy, and loses to
any other among exact copies; columns of any further name pass through unchanged (the last stage
returns its own four); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm import bpe, exact_dedup, minhash, mixing, quality
from savora.llm.common import materialize, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    score = max([*docs.columns, "_"], key=len) + "_score"  # longer than any name there
    scored = quality.with_score(docs, model, score_col=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_one(docs, stored=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked by a similarity of 0.8 or more, stays."""
    return minhash.keep_one(docs, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document appears as often as the mix takes it."""
    return mixing.mixed(docs, stored=True)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs)


STAGES = [("quality", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: The classifier, near-duplicate search and encoder can't be expressed in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
