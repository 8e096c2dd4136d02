"""Query op2: all documents packed into sequences of at most 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack

WINDOW = 2048
END_ID = 1


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), window=WINDOW, end_id=END_ID)
