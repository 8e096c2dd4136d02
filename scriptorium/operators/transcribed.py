"""Transcribed tables and notices: rows of decisions, subjects set in line, paragraphs traced to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P

SERIAL = r"^\s*([\x{966}-\x{96F}0-9]{1,2}[.)\x{964}])\s+(.*\S)\s*$"
# fixed values: words that tell a decision, and the word that ends a ministry's name
DECISION_WORDS = ["गर्ने", "दिने", "तोक्ने", "स्वीकृति", "सहमति", "नियुक्त", "मनोनयन", "भाग लिन", "खारेज", "प्रदान"]
MINISTRY = "मन्त्रालय"
LONG_LINE, LEAST_ROWS = 48, 3


def reads_as_decision(text: Column) -> Column:
    found = (F.char_length(text) >= LONG_LINE) & ~F.contains(text, F.lit(MINISTRY))
    for w in DECISION_WORDS:
        found = found | F.contains(text, F.lit(w))
    return found


def decision_columns(text: Column) -> Column:
    """(ministry, decision) of a line: cut at a wide gap, else all of it on the side it reads like."""
    parts = F.split(text, r"\s{2,}", 2)
    lone = F.when(reads_as_decision(text), F.struct(F.lit("").alias("ministry"), text.alias("decision"))).otherwise(F.struct(text.alias("ministry"), F.lit("").alias("decision")))
    return F.when(F.size(parts) == 2, F.struct(P.stripped(F.get(parts, F.lit(0))).alias("ministry"), P.stripped(F.get(parts, F.lit(1))).alias("decision"))).otherwise(lone)


def decision_rows(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, row, serial, ministry, decision) of lines (key, ord, text): a serial opens a row, other lines add to it.

    Documents with fewer than three rows, or half of them, that have a decision give none.
    """
    said = lines.filter(P.stripped(F.col("text")) != "")
    serial = F.regexp_extract("text", SERIAL, 1)
    w = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    opened = said.withColumn("_s", serial).withColumn("row", F.sum((F.col("_s") != "").cast("int")).over(w)).filter("row > 0")
    body = P.stripped(F.when(F.col("_s") != "", F.regexp_extract("text", SERIAL, 2)).otherwise(F.col("text")))
    cut = opened.withColumn("_c", decision_columns(body))
    joined = lambda c: P.stripped(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ord", f"_c.{c}"))), lambda s: s[c]), lambda x: x != ""), " "))
    rows = cut.groupBy(key, "row").agg(F.max("_s").alias("serial"), joined("ministry").alias("ministry"), joined("decision").alias("decision")).filter("decision != ''")
    enough = F.count("*").over(W.partitionBy(key)) >= LEAST_ROWS
    return rows.withColumn("_ok", enough).filter("_ok AND ministry != ''").drop("_ok")


def decision_table(rows: DataFrame, header: str = "| No. | Ministry | Decision |", key: str = "doc_id") -> DataFrame:
    """(key, markdown): the rows of a document as a table."""
    line = F.concat(F.lit("| "), F.replace("serial", F.lit(")"), F.lit(".")), F.lit(" | "), "ministry", F.lit(" | "), "decision", F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))), lambda s: s["line"])
    return rows.groupBy(key).agg(F.concat(F.lit(header + "\n|---|---|---|\n"), F.array_join(lines, "\n")).alias("markdown"))


def split_inline_subjects(fragments: DataFrame, subject: str = r"^\s*((?:Re|Subject)\s*:\s*)([^.!?\x{964}]+[.!?\x{964}])\s*(.*)$") -> DataFrame:
    """A line that holds its subject and body becomes two fragments, the second a line lower with no gap."""
    body = P.stripped(F.regexp_extract("text", subject, 3))
    head = P.stripped(F.concat(F.regexp_extract("text", subject, 1), F.regexp_extract("text", subject, 2)))
    both = F.array(F.struct(head.alias("text"), F.lit(0).alias("more")), F.struct(body.alias("text"), F.lit(1).alias("more")))
    parts = F.when(body != "", both).otherwise(F.array(F.struct(F.col("text").alias("text"), F.lit(0).alias("more"))))
    split = fragments.withColumn("_p", F.explode(parts))
    gap = F.when(F.col("_p.more") == 1, 0.0).otherwise(F.col("gap_before"))
    return split.withColumns({"text": F.col("_p.text"), "line_number": F.col("line_number") + F.col("_p.more"), "gap_before": gap}).drop("_p")


def paragraph_pages(paragraphs: DataFrame, fragments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs (key, paragraph, text) with the page of the first fragment whose text they contain."""
    met = paragraphs.alias("p").join(fragments.alias("f"), F.expr(f"p.{key} = f.{key} AND contains(p.text, f.text)"), "left")
    return met.groupBy(f"p.{key}", "p.paragraph").agg(F.min_by("f.page_number", "f.ord").alias("page_number"))
