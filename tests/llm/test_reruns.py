"""Fitted operators give the same rows however the input is dealt, also where ids repeat."""

from pyspark.sql import functions as F

from ledgerline.llm import language, quality_model

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_language_fit_with_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") % 40)
    a, b = (language.fit(language.learnable(docs.repartition(n, "text"))) for n in (2, 5))
    assert a.langs == b.langs and (a.centroids == b.centroids).all() and (a.floors == b.floors).all()


def test_quality_fit_with_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") % 40)
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.col("doc_id") % 40).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    a, b = (rows(quality_model.quality_scores(docs.repartition(n, "text"), labels)) for n in (2, 5))
    assert a == b
