"""What the queries share: tables, made-up geometry, a small keymap, DuckDB fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import assemble


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer splits than there are cores, as small files have, dealt to all cores; others stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text")))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.text_fragments(documents(spark, sf_dir))


def placed_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of document lines on pages of 40 lines, odd lines in a right column; gaps after blank lines."""
    f = fragments(spark, sf_dir)
    line = F.col("line_number")
    right = (F.floor(line / 3) % 2 == 1).cast("double") * 260.0
    y = (line % 40) * 14.0 + 60.0
    return f.select(
        "doc_id", "ord", (F.floor(line / 40) + 1).cast("int").alias("page_number"), "block_number", "line_number", "text",
        (F.lit(50.0) + right).alias("x0"), y.alias("y0"), (F.lit(50.0) + right + F.least(F.char_length("text"), F.lit(40)) * 5.0).alias("x1"), (y + 11.0).alias("y1"),
        F.when(line % 7 == 0, 12.0).when(line > 0, 3.0).alias("gap_before"),
    )


# ---- DuckDB ------------------------------------------------------------------------------


def d_chars(text: str, members: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '[{members}]', '', 'g')))"


def d_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def d_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{P.SPACE}+|{P.SPACE}+$', '', 'g')"


def d_collapse(text: str) -> str:
    return d_strip(f"regexp_replace({text}, '{P.SPACE}+', ' ', 'g')")


def d_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{P.TOKEN}')"


FRAGMENTS = f"""
frag AS (
  SELECT doc_id, i - 1 AS line, {d_strip('lines[i]')} AS text
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)
  WHERE {d_strip('lines[i]')} <> '')"""

PLACED = f"""{FRAGMENTS},
placed AS (
  SELECT doc_id, line AS ord, (line // 40 + 1) AS page_number, line AS block_number, line AS line_number, text,
         50.0::DOUBLE + CASE WHEN (line // 3) % 2 = 1 THEN 260.0 ELSE 0.0 END AS x0, (line % 40) * 14.0::DOUBLE + 60.0 AS y0,
         50.0::DOUBLE + CASE WHEN (line // 3) % 2 = 1 THEN 260.0 ELSE 0.0 END + least(length(text), 40) * 5.0::DOUBLE AS x1, (line % 40) * 14.0::DOUBLE + 71.0 AS y1,
         CASE WHEN line % 7 = 0 THEN 12.0::DOUBLE WHEN line > 0 THEN 3.0::DOUBLE END AS gap_before
  FROM frag)"""

#: a keymap of our own for reaching Devanagari from Latin text: typed letters and what they stand for
KEYS = "abcdefghijklmnopqrstuvwxyz"
VALUES = "".join(chr(c) for c in (0x93E, 0x92C, 0x91A, 0x926, 0x947, 0x92B, 0x917, 0x939, 0x93F, 0x91C, 0x915, 0x932, 0x92E, 0x928, 0x94B, 0x92A, 0x915, 0x930, 0x938, 0x924, 0x941, 0x935, 0x936, 0x937, 0x92F, 0x94D))
KEYMAPS = {"first": VALUES, "second": VALUES[1:] + VALUES[:1], "third": VALUES[5:] + VALUES[:5]}
VOCABULARY = ["तान", "हर", "नि", "सत", "रे"]
