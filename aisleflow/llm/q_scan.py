"""Queries op3, op4 and op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, secrets, topk
from .common import held_out, materialise, small_batches, table


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = materialise(secrets.candidates(docs, secrets.dictionary(docs)), "secret-candidates")
    labelled = secrets.labelled(found.where(~held_out(F.col("doc_id"))))
    scored = secrets.score(found, secrets.fit(labelled))
    return scored.select("doc_id", "start", "end", "finding", held_out(F.col("doc_id")).alias("held_out"), F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("is_secret"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 64)
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    rated = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    rated = rated.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    model = quality.fit(docs.where(~F.col("held_out")), rated)
    scored = quality.score(docs, model, tail_at=1)
    return scored.select("doc_id", "held_out", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail", 6).alias("tail"), (F.col("tail") >= 0.5).alias("selected"))


SQL_OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
