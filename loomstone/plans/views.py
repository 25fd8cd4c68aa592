"""The canonical views over the tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def uid(key: str):
    """Ids of eight digits or more; longer ones stay whole."""
    text = F.col(key).cast("string")
    return F.lpad(text, F.greatest(F.lit(8), F.length(text)), "0").alias("uid")


def src(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", uid("doc_id"), F.concat(F.lit("raw/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"), F.col("text").alias("content"), "lang", "source")


def vec(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", uid("vec_id"), "embedding")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"), F.max("event_id").alias("updated_at"))
    status = F.when(F.col("t") == "view", "queued").when(F.col("t") == "click", "running").when(F.col("t") == "error", "failed").otherwise("done")
    return e.select(F.concat(F.lit("lib"), (F.col("user_id") % 5).cast("string")).alias("lib"), F.concat(F.lit("raw/"), (F.col("user_id") % 20).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit(".txt")).alias("rel"), status.alias("status"), "updated_at")


SRC = "src AS (SELECT doc_id, lpad(doc_id::VARCHAR, greatest(8, len(doc_id::VARCHAR))::INT, '0') AS uid, 'raw/' || source || '/' || lang || '/' || doc_id || '.txt' AS source_path, text AS content, lang, source FROM documents)"
VEC = "vec AS (SELECT vec_id, lpad(vec_id::VARCHAR, greatest(8, len(vec_id::VARCHAR))::INT, '0') AS uid, embedding::DOUBLE[] AS e FROM embeddings)"
JOBS = """jobs AS (SELECT 'lib' || (user_id % 5) AS lib, 'raw/' || (user_id % 20) || '/' || user_id || '.txt' AS rel,
  CASE t WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, updated_at
  FROM (SELECT user_id, max_by(event_type, event_id) AS t, max(event_id) AS updated_at FROM events GROUP BY user_id))"""
