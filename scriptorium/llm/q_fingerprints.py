"""Query op8: fingerprints of every document and of its edited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .fingerprints import fingerprint_string, likeness, winnow, with_next


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    marked = docs.withColumn("marks", winnow(F.col("text")))
    led = with_next(marked, "doc_id", ["text", "marks"], tie="text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = led.withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.left("next_text", half)))
    both = edited.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "marks", "next_marks", winnow(F.col("edited")).alias("edited_marks"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_string(F.col("marks")).alias("fingerprint"),
        fingerprint_string(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
