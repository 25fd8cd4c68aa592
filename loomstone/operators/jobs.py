"""Ingest jobs and their queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Progress by step, and the prefix of jobs that stand for no file.
STEPS = {"queued": 0, "parsing": 10, "indexing": 40, "extracting": 60, "compiling": 80, "done": 100, "failed": 100}
SYNTHETIC = "__"


def percent(part: Column, whole: Column) -> Column:
    """Half rounds up."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part / whole * 100 + 0.5)).cast("int")


def progress(jobs: DataFrame) -> DataFrame:
    """A3: one row of totals over the jobs of files."""
    real = jobs.where(~F.col("rel").startswith(SYNTHETIC))
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = real.agg(F.count("*").alias("total"), n("failed").alias("failed"), n("done", "failed").alias("settled"), n("queued", "running").alias("active"), F.max("updated_at").alias("updated_at"))
    return out.withColumn("percent", percent(F.col("settled"), F.col("total")))


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs that a restart interrupted have failed."""
    hit = F.col("status") == "running"
    return jobs.withColumn("error", F.when(hit, F.lit("interrupted")).otherwise(F.col("error") if "error" in jobs.columns else F.lit(None).cast("string"))).withColumn("recovered", hit).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))


def busy_others(jobs: DataFrame, library: str) -> DataFrame:
    """How many other libraries have work."""
    per = jobs.where(F.col("lib") != library).groupBy("lib").agg(F.bool_or(F.col("status").isin("queued", "running")).alias("busy"))
    return per.agg(F.count_if("busy").alias("others_busy"))


def queue_order(requests: DataFrame) -> DataFrame:
    """(lib, rel, position) of requests (lib, rel, seq, front): a repeated one keeps its place, those to the front come last first."""
    first = requests.groupBy("lib", "rel").agg(F.min_by(F.struct("seq", "front"), "seq").alias("x")).select("lib", "rel", "x.seq", "x.front")
    order = Window.partitionBy("lib").orderBy(F.when(F.col("front"), 0).otherwise(1), F.when(F.col("front"), -F.col("seq")).otherwise(F.col("seq")))
    return first.withColumn("position", F.row_number().over(order)).select("lib", "rel", "position")


def file_status(files: DataFrame, jobs: DataFrame, needle: str, status: str) -> DataFrame:
    """The files whose path has the needle and whose job has the status ('all': any)."""
    rows = files.join(jobs.select(F.col("rel").alias("source_path"), "status"), "source_path", "left").where(F.lower("source_path").contains(needle.lower()))
    return rows if status == "all" else rows.where(F.col("status") == status)


def rebuilt(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """(rel, fate): live files are queued again, jobs without a file are dropped."""
    gone = jobs.join(live.select(F.col("source_path").alias("rel")), "rel", "left_anti").select("rel", F.lit("dropped").alias("fate"))
    return live.select(F.col("source_path").alias("rel"), F.lit("queued").alias("fate")).unionByName(gone)
