"""Streams (T1, T4, T6, T7, L11, S18-S20): file sources, one pass over what has arrived.

``availableNow`` reads all files there are in batches of ``per_batch`` files and stops;
progress is kept in a checkpoint folder, so a restart goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import place


def arriving(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_batch: int = 100, **options: str) -> DataFrame:
    """New files of a folder, or of one file, named so as a pattern of one letter, as streams only read folders and patterns."""
    if path.endswith(".parquet"):
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.format(fmt).schema(schema).options(maxFilesPerTrigger=str(per_batch), **options).load(path)


def drained(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs a stream over everything that has arrived; a restart with the same checkpoint folder goes on where it ended."""
    checkpoint = checkpoint or place(stream.sparkSession, "progress")
    stream.writeStream.outputMode(mode).trigger(availableNow=True).foreachBatch(each).option("checkpointLocation", checkpoint).start().awaitTermination()


def kept(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own number, so that a batch that is tried again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def latest_prompts(events: DataFrame, key: str = "session_id", order: str = "seq", text: str = "text") -> DataFrame:
    """T4: the newest text of each session that is not empty, and its place."""
    return events.where(F.coalesce(F.col(text), F.lit("")) != "").groupBy(key).agg(F.max_by(text, order).alias("prompt"), F.max(order).alias("last"))


def most_recent(prompts: DataFrame, most: int = 64, key: str = "session_id") -> DataFrame:
    """The sessions heard last."""
    return prompts.orderBy(F.desc("last"), key).limit(most)


def written(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What kept() has written so far; nothing where no batch has come yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(f"{schema}, batch long").parquet(folder).drop("batch") if there else spark.createDataFrame([], schema)


def final_state(stream: DataFrame, spark: SparkSession, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """The last complete state of an aggregating stream, as a table in a folder; without any input it is empty."""
    folder = path or (f"{checkpoint}-rows" if checkpoint else place(spark, "state"))
    drained(stream, kept(folder), "complete", checkpoint)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(folder)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).select(stream.columns)
