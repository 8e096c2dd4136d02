"""Query op1: rates for all documents that give each language its target share of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .mixing import Mixer, copies, fit_domains, weights_of_total

WEIGHTS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # the documents that the labels table covers: their languages count as known
    model = fit_domains(docs, "doc_id", "text", "lang", table(spark, sf_dir, "labels"))
    mixer = Mixer(docs, model, keep=["doc_id"]).fit(weights_of_total(WEIGHTS))
    rated = mixer.rated()
    return rated.select("doc_id", "tokens", *[F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
