"""Query op5: tokens of every whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .token_counts import count_tokens, over_limit

TOKEN_LIMIT = 4096


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    sized = counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens")
    return over_limit(sized, TOKEN_LIMIT)
