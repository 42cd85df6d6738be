"""Rows that share an id, and rows made from one row of a file."""

from pyspark.sql import functions as F

from savora.llm import embedding_dedup, exact_dedup, mixing, quality


def test_vectors_that_share_an_id(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 0, "x"), (1, b, 0, "x"), (2, a, 0, "x"), (3, b, 0, "x"), (3, b, 0, "x"), (4, c, 0, "x"), (5, b, 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5)]


def test_rows_exploded_from_one_file_row(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", "s", 6)], "doc_id long, text string, source string, n int").write.parquet(str(tmp_path / "t"))
    many = spark.read.parquet(str(tmp_path / "t")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    assert exact_dedup.keep_one(many).count() == 1
    assert sum(r.kept for r in exact_dedup.exact_dedup(many).collect()) == 1
    assert mixing.mixed(many).count() == sum(r.copies for r in mixing.mix(many).collect())


def test_unequal_odds_draw_heavy_documents_more_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w " * 10).alias("text"), (F.col("id") % 2).cast("string").alias("source"), F.when(F.col("id") % 4 < 2, 9.0).otherwise(1.0).alias("heavy"))
    got = mixing.mix(df, weights=(3, 1), weight_col="heavy", carry=("heavy",))
    by = {(r.target, r.heavy): r.copies / 1000 for r in got.groupBy("target", "heavy").agg(F.sum("copies").alias("copies")).collect()}
    # targets are 30,000 and 10,000 of 20,000 words each: means of 1.5 and 0.5 copies
    assert abs(by[30000.0, 9.0] + by[30000.0, 1.0] - 3) < 0.01 and abs(by[10000.0, 9.0] + by[10000.0, 1.0] - 1) < 0.01
    assert by[30000.0, 9.0] > 1.6 and by[30000.0, 1.0] < 1.4 and by[10000.0, 9.0] > 0.65 and by[10000.0, 1.0] < 0.35


def test_sample_counts_repeated_ids_once(spark):
    rows = [(k % 40, "Fine words here." if k % 40 % 2 else "BAD!! BAD!!", k % 40 % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df, df.select("doc_id", "quality"), sample=20)
    again = quality.train(df.repartition(3), df.select("doc_id", "quality").repartition(5), sample=20)
    assert (model[0] == again[0]).all() and (model[1] == again[1]).all()
