"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next stage's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import small_batches, table, written
from scriptorium.llm.jaccard import Rule, first_of_classes, text_digest
from scriptorium.llm.mixing import Mixer, copies, fit_domains, tempered
from scriptorium.llm.packing import pack
from scriptorium.llm.q_quality import THRESHOLD, scored_documents
from scriptorium.llm.suffix_dedup import dedupe_substrings

#: near duplicates share 80 in 100 of their runs of five words
NEAR = Rule(words=5, num=80, den=100)
REPEAT_BYTES = 200
#: languages are raised towards each other: target shares go with share^0.7, and none shrinks
TEMPER = 0.7
WINDOW, END_ID = 2048, 1


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    small_batches(spark)
    scored = scored_documents(docs, docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") >= THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: the one with the least doc_id, then text digest.

    Rows that repeat each other in key and text count as one document.  A row without a
    key stays only where its class has none with a key, and one such row of a class.
    """
    small_batches(spark)
    first = first_of_classes(docs, NEAR).select(F.col("doc").alias("_key"), F.col("digest").alias("_digest"), "rows")
    told = docs.withColumn("_told", text_digest("text"))
    kept = told.join(first, F.expr("CAST(doc_id AS LONG) <=> _key AND _told = _digest"))
    once = kept.filter("rows = 1")
    again = kept.filter("rows > 1").dropDuplicates(["_key", "_digest"])
    return once.unionByName(again).select(*[f"`{c}`" for c in docs.columns])


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every passage of 200 bytes or more that also stands elsewhere."""
    small_batches(spark)
    cut = dedupe_substrings(docs, length=REPEAT_BYTES)
    cut = cut.withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[f"`{c}`" for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that the languages' token totals meet tempered targets."""
    small_batches(spark)
    model = fit_domains(docs, "doc_id", "text", "lang", table(spark, sf_dir, "labels"))
    mixer = Mixer(docs, model, least_rate=1.0).fit(tempered(TEMPER))
    times = copies(F.col("rate"), F.col("doc_id"))
    return mixer.rated().withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).select(*[f"`{c}`" for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids, a row for each piece of a document."""
    small_batches(spark)
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=WINDOW, end_id=END_ID, with_ids=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", long_repeats),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

#: not expressible in SQL: stages learn, hash and tokenize; each is tested against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
