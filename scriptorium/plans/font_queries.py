"""Queries over character maps, ligatures and transcribed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cmaps, transcribed
from .common import table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("font"), F.col("p_partkey").cast("int").alias("gid"), F.left("p_name", F.lit(3)).alias("text"))


def cmap_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-155: maps of brands written as streams and parsed again."""
    return cmaps.parse_cmaps(cmaps.build_cmaps(_names(spark, sf_dir), ["font"]), "cmap", ["font"])


CMAP_ROUND_TRIP = "SELECT p_brand AS font, p_partkey::INTEGER AS gid, left(p_name, 3) AS text FROM part"


def cmap_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-155, OP-157, OP-194: a font's own map under corrections, with markers for signs out of order."""
    pdf = _names(spark, sf_dir).filter("gid % 3 != 0")
    right = _names(spark, sf_dir).filter("gid % 2 = 0").withColumn("text", F.when(F.col("gid") % 10 == 0, "र्").when(F.col("gid") % 10 == 2, "ि").otherwise(F.upper("text")))
    return cmaps.patch_maps(pdf, right, ["font"])


CMAP_PATCHES = """WITH p AS (SELECT p_brand AS font, p_partkey::INTEGER AS gid, left(p_name, 3) AS t, p_partkey % 3 <> 0 AS own, p_partkey % 2 = 0 AS fix FROM part),
f AS (SELECT *, CASE WHEN gid % 10 = 0 THEN chr(61440) WHEN gid % 10 = 2 THEN chr(61441) ELSE upper(t) END AS n FROM p WHERE own OR fix)
SELECT font, gid, CASE WHEN fix THEN n ELSE t END AS text, fix AND (NOT own OR n <> t) AS corrected FROM f"""


def ligatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-156: glyphs made of earlier glyphs, resolved pass by pass."""
    names = _names(spark, sf_dir).select(F.lit("f").alias("font"), F.col("gid").alias("glyph"), F.left("text", F.lit(1)).alias("text"))
    ids = spark.range(1, 6).select(F.col("id").cast("int").alias("i"))
    rules = ids.select(F.lit("f").alias("font"), F.col("i").alias("rule"), (F.col("i") - 100).alias("glyph"), F.when(F.col("i") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col("i") - 101, F.col("i"))).alias("components"))
    return cmaps.ligature_closure(names, rules).select("glyph", "text")


LIGATURES = """WITH RECURSIVE n AS (SELECT p_partkey::INTEGER AS glyph, left(p_name, 1) AS text FROM part),
l AS (SELECT 1 AS i, (SELECT text FROM n WHERE glyph = 1) || (SELECT text FROM n WHERE glyph = 2) AS text UNION ALL SELECT i + 1, l.text || n.text FROM l JOIN n ON n.glyph = l.i + 1 WHERE i < 5)
SELECT glyph, text FROM n UNION ALL SELECT i - 100, text FROM l"""


def decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-181, OP-199: orders of a customer as transcribed rows, every fourth over two lines."""
    o = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    first = F.concat(((F.col("n") - 1) % 99 + 1).cast("string"), F.lit(". "), "o_orderpriority", F.lit("   to "), "o_orderstatus")
    lines = F.when(F.col("o_orderkey") % 4 == 0, F.array(first, F.lit("more"))).otherwise(F.array(first))
    return transcribed.decision_rows(o.select(F.col("o_custkey").alias("doc_id"), F.col("n"), F.posexplode(lines).alias("i", "text")).select("doc_id", (F.col("n") * 2 + F.col("i")).alias("ord"), "text")).select("doc_id", F.col("row").cast("long"), "serial", "ministry", "decision")


DECISION_ROWS = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey AS doc_id, n AS row, ((n - 1) % 99 + 1) || '.' AS serial, o_orderpriority || CASE WHEN o_orderkey % 4 = 0 THEN ' more' ELSE '' END AS ministry, 'to ' || o_orderstatus AS decision FROM o QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 3"""

QUERIES = {f.__name__: f for f in (cmap_round_trip, cmap_patches, ligatures, decision_rows)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
