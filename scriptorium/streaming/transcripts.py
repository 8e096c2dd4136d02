"""Transcripts as a stream: the same expressions on new files as they arrive.

Row-wise operators (profiles, scores, signals) are append-safe.  Operators with windows
work on one document, so ``per_batch`` applies them inside ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import metrics as M


def stream_texts(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """(path, text) of text files as they appear in a folder."""
    lines = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files).load(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def with_signals(texts: DataFrame) -> DataFrame:
    return texts.select("path", M.text_signals(F.col("text")).alias("signals")).select("path", "signals.*")


def per_batch(texts: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Applies an operator to each micro-batch and appends its rows to a Parquet table."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
