"""Choosing between candidate transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as X


def scored_candidates(candidates: DataFrame) -> DataFrame:
    """Adds ``score`` to (doc_id, ord, text, …): the quality score without page anchors."""
    bare = candidates.withColumn("_t", X.strip_page_anchors(F.coalesce("text", F.lit(""))))
    counted = bare.withColumn("_c", M.token_counts(F.col("_t")))
    return counted.withColumn("score", M.quality_score(F.col("_t"), F.col("_c"))).drop("_t", "_c")


def best_candidate(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """The candidate that is best by (safe, score), the first of equals: one aggregation, nothing sorted."""
    order = F.struct(F.col("safe"), F.col("score"), (-F.col("ord")).alias("o"))
    return scored.groupBy(key).agg(F.max_by(F.struct("ord", "score"), order).alias("_b")).select(key, F.col("_b.ord").alias("chosen"), F.col("_b.score").alias("score"))
