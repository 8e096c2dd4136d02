"""Query op4: a quality score for every whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality import fit, score

#: a score from which on a document counts as good
THRESHOLD = 0.3


def held_out(key: str = "doc_id") -> Column:
    """The fifth of all documents that no model learns from."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def scored_documents(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a score, learnt from the rows of ``labels`` that are not held out."""
    return score(docs, fit(labelled, labels.filter(~held_out())))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scored_documents(docs, docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
