"""Query op10: every document stored as a TIFF page and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .media import tiff_pages, to_tiff


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(text_or_empty(), "UTF-8").alias("payload"))
    stored = to_tiff(docs, "payload").withColumn("n_bytes", F.octet_length("payload").cast("long")).drop("payload")
    return tiff_pages(stored, "media").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "page", "width", "height", "error"
    )
