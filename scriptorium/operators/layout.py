"""Reading order: blocks, columns, lines and paragraphs of positioned fragments.

Fragments have doc_id, page_number, ord, text, x0, y0, x1, y1 and gap_before.  Windows
are over a page of a document, which bounds them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

# fixed values of the layout rules
HEADER_Y, GUTTER, BLOCK_GAP, TOLERANCE = 80.0, 20.0, 18.0, 1.5
PAGE = ("doc_id", "page_number")


def line_height(median: Column) -> Column:
    return F.coalesce(F.least(median, F.lit(24.0)), F.lit(12.0))


def with_line_height(fragments: DataFrame, within: Sequence[str] = PAGE) -> DataFrame:
    return fragments.withColumn("line_height", line_height(F.median(F.col("y1") - F.col("y0")).over(W.partitionBy(*within))))


def upper_median(values: Column) -> Column:
    """The middle value, the upper one of two."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def layout_blocks(fragments: DataFrame, within: Sequence[str] = PAGE) -> DataFrame:
    """Adds ``block``: a new one starts where the gap to the lowest line so far is wide."""
    w = W.partitionBy(*within).orderBy("y0", "x0", "ord")
    sized = with_line_height(fragments, within)
    lowest = F.max("y1").over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = (F.col("y0") - lowest > F.greatest(F.lit(BLOCK_GAP), F.col("line_height") * 1.35)).cast("int")
    flagged = sized.withColumn("_opens", F.coalesce(opens, F.lit(0)))
    return flagged.withColumn("block", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_opens", "line_height")


def anchored_lines(fragments: DataFrame, within: Sequence[str], order: Sequence[str], into: str = "line_group") -> DataFrame:
    """Adds ``into``: lines of fragments whose y0 is near the least y0 of the line so far.

    The comparison is with the line, not the neighbour, so it is a fold over the ordered
    fragments of a group (a page or block).
    """
    sized = with_line_height(fragments, within)
    grouped = sized.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("ord").alias("_ord"), F.col("y0").alias("_y")))).alias("fs"), F.first("line_height").alias("h"))
    near = F.greatest(F.lit(TOLERANCE), F.col("h") * 0.18)
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("y"), F.array().cast("array<struct<ord:bigint,line:int>>").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        same = (acc["line"] >= 0) & (F.abs(f["_y"] - acc["y"]) <= near)
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        y = F.when(same, F.least(acc["y"], f["_y"])).otherwise(f["_y"])
        return F.struct(line.alias("line"), y.alias("y"), F.array_append(acc["out"], F.struct(f["_ord"].cast("long").alias("ord"), line.alias("line"))).alias("out"))

    numbered = grouped.select(*within, F.inline(F.aggregate("fs", start, step, lambda acc: acc["out"]))).withColumnRenamed("line", into)
    return fragments.join(numbered, [*within, "ord"])


def column_votes(fragments: DataFrame, within: Sequence[str]) -> DataFrame:
    """Per group: body size, fragments left, right and in the middle of its centre line, and the verdicts."""
    body = fragments.filter(F.col("y0") > HEADER_Y)
    w = W.partitionBy(*within)
    centred = body.withColumn("_split", (F.min("x0").over(w) + F.max("x1").over(w)) / 2).withColumn("_c", (F.col("x0") + F.col("x1")) / 2)
    votes = centred.groupBy(*within).agg(
        F.count("*").alias("body"), F.count_if(F.col("_c") <= F.col("_split") - GUTTER).alias("left"), F.count_if(F.col("_c") >= F.col("_split") + GUTTER).alias("right"), F.first("_split").alias("split_x")
    )
    votes = votes.withColumn("centred", F.col("body") - F.col("left") - F.col("right"))
    return votes.withColumn(
        "two_column",
        F.expr("body >= 12 AND left >= 4 AND right >= 4 AND (left + right) >= 0.6D * body AND centred <= greatest(6, body div 3)"),
    )


def row_aligned(fragments: DataFrame, within: Sequence[str]) -> DataFrame:
    """Per group: whether it is set in rows (three lines of three separated cells, a third of all lines)."""
    lined = anchored_lines(fragments, within, ["y0", "x0"])
    w = W.partitionBy(*within, "line_group").orderBy("x0", "ord")
    gaps = lined.withColumn("_gap", F.lead("x0").over(w) - F.col("x1"))
    per_line = gaps.groupBy(*within, "line_group").agg(F.count("*").alias("cells"), F.coalesce(F.max(F.col("_gap") >= GUTTER), F.lit(False)).alias("apart"))
    rows = per_line.groupBy(*within).agg(F.count("*").alias("lines"), F.count_if((F.col("cells") >= 3) & F.col("apart")).alias("cell_rows"))
    return rows.withColumn("row_aligned", F.expr("lines >= 3 AND cell_rows >= 3 AND cell_rows >= 0.35D * lines"))


def reading_order(fragments: DataFrame) -> DataFrame:
    """Adds block, zone and ``reading_ord``: columns are read one after the other where a block has two."""
    blocks = layout_blocks(fragments)
    key = [*PAGE, "block"]
    votes, rows = column_votes(blocks, key), row_aligned(blocks, key)
    judged = blocks.join(votes.select(*key, "two_column", "split_x"), key, "left").join(rows.select(*key, "row_aligned"), key, "left")
    apart = F.coalesce(F.col("two_column"), F.lit(False)) & ~F.coalesce(F.col("row_aligned"), F.lit(False))
    centre, split = (F.col("x0") + F.col("x1")) / 2, F.col("split_x")
    spans = (F.col("x0") < split - GUTTER) & (F.col("x1") > split + GUTTER)
    side = F.when(F.col("y0") <= HEADER_Y, "header").when(spans, "centre").when(centre <= split - GUTTER, "left").when(centre >= split + GUTTER, "right").otherwise("centre")
    sided = judged.withColumn("_side", F.when(apart, side))
    w = W.partitionBy(*key)
    sided = sided.withColumn("_first", F.min(F.when(F.col("_side").isin("left", "right"), F.col("y0"))).over(w))
    both = F.max(F.col("_side") == "left").over(w) & F.max(F.col("_side") == "right").over(w)
    zone = (
        F.when(F.col("_side").isNull(), 0).when(F.col("_side") == "header", 0).when(~both, 1)
        .when((F.col("_side") == "centre") & (F.col("y0") < F.col("_first")), 1).when(F.col("_side") == "left", 2).when(F.col("_side") == "right", 3).otherwise(4)
    )
    zoned = sided.withColumn("zone", zone)
    order = W.partitionBy("doc_id").orderBy("page_number", "block", "zone", "y0", "x0", "ord")
    return zoned.withColumn("reading_ord", F.row_number().over(order).cast("long")).drop("_side", "_first", "two_column", "split_x", "row_aligned")


def paragraphs(fragments: DataFrame, order: str = "ord") -> DataFrame:
    """(doc_id, paragraph, page_number, text): lines merged, then split at pages and wide gaps."""
    # dealt by document once: all the narrower keys below are met by that
    said = fragments.withColumn("text", P.stripped(F.col("text"))).filter("text != ''").repartition("doc_id")
    sized = said.withColumn("_h", line_height(F.median(F.col("y1") - F.col("y0")).over(W.partitionBy("doc_id"))))
    heights = sized.groupBy("doc_id").agg(F.first("_h").alias("_h"))
    lined = anchored_lines(said, PAGE, [order], "_line")
    per_line = lined.groupBy(*PAGE, "_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.min_by("gap_before", F.when(F.col("gap_before").isNotNull(), F.struct("x0", "ord"))).alias("gap"), F.min(order).alias("_at"),
    )
    joined = per_line.join(heights, "doc_id")
    w = W.partitionBy("doc_id").orderBy("_at")
    page_change = F.col("page_number") != F.lag("page_number").over(w)
    opens = F.when(page_change, True).otherwise(F.coalesce(F.col("gap") >= F.greatest(F.lit(8.0), F.col("_h") * 0.7), F.lit(False)))
    numbered = joined.withColumn("_opens", (opens & (F.row_number().over(w) > 1)).cast("int")).withColumn("paragraph", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda s: s["text"]), "\n")
    return numbered.groupBy("doc_id", "paragraph").agg(F.min("page_number").alias("page_number"), text.alias("text"))


#: partitions for each split of an input: a task sorts about so large a part of one
PER_SPLIT = 16


def dealt(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Dealt by key to partitions whose number follows the input and which are not joined again, so that what a task sorts does not grow."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), PER_SPLIT * df.rdd.getNumPartitions()), *key)


def edge_clusters(values: DataFrame, within: Sequence[str], value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(…, cluster, edge, members): values whose gap to the one before is small, as their mean."""
    w = W.partitionBy(*within).orderBy(value)
    flagged = dealt(values, within).withColumn("_opens", F.coalesce((F.col(value) - F.lag(value).over(w) > tolerance).cast("int"), F.lit(0)))
    numbered = flagged.withColumn("cluster", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(*within, "cluster").agg(F.avg(value).alias("edge"), F.count("*").alias("members"))


def indent_threshold(fragments: DataFrame, within: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(…, threshold): half-way from the main left margin to the next one at least 12 further in; null if none."""
    bucketed = fragments.withColumn("_b", F.round(F.col("x0") / 4.0) * 4.0)
    counted = bucketed.groupBy(*within, "_b").agg(F.count("*").alias("_n"), F.min("ord").alias("_first"))
    main = counted.groupBy(*within).agg(F.max_by("_b", F.struct("_n", (-F.col("_first")).alias("o"))).alias("_main"))
    base = bucketed.join(main, list(within)).filter("_b = _main").groupBy(*within).agg(F.median("x0").alias("base"))
    further = bucketed.join(base, list(within)).groupBy(*within, "base").agg(F.min(F.when(F.col("_b") >= F.col("base") + 12, F.col("_b"))).alias("next"))
    return further.select(*within, "base", F.when(F.col("next").isNotNull(), F.col("base") + F.greatest(F.lit(8.0), (F.col("next") - F.col("base")) / 2)).alias("threshold"))


def document_structure(fragments: DataFrame) -> DataFrame:
    """(doc_id, layout): single-column-notice, two-column-layout or null."""
    first = fragments.withColumn("_p", F.min("page_number").over(W.partitionBy("doc_id"))).filter("page_number = _p")
    w = W.partitionBy("doc_id")
    width = F.greatest(F.max("x1").over(w) - F.min("x0").over(w), F.lit(1.0))
    middle = (F.max("x1").over(w) + F.min("x0").over(w)) / 2
    centred = (F.col("x1") - F.col("x0") <= width * 0.75) & (F.abs((F.col("x0") + F.col("x1")) / 2 - middle) <= width * 0.12)
    marked = first.withColumn("_top", centred & (F.col("y0") <= 220)).withColumn("_deep", F.count_if(F.col("y0") > 120).over(w))
    body = F.when(F.col("_deep") >= 3, F.col("y0") > 120).otherwise(F.lit(True))
    marked = marked.withColumn("_body", body)
    typical = F.median(F.when(F.col("_body"), F.col("y1") - F.col("y0"))).over(w)
    marked = marked.withColumn("_gap", F.coalesce(F.col("_body") & (F.col("gap_before") > typical * 0.45), F.lit(False)))
    notice = marked.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(X.is_subject_line(F.col("text"))).alias("subject"), F.max(X.is_date_line(F.col("text"))).alias("date"),
        F.count_if("_top").alias("top"), F.max("_gap").alias("gap"),
    )
    notice = notice.select("doc_id", F.expr("n >= 3 AND (subject OR (date AND top >= 2) OR (top >= 3 AND gap))").alias("notice"))
    votes = column_votes(fragments, ["doc_id"]).select("doc_id", "two_column")
    layout = F.when(F.col("notice"), "single-column-notice").when(F.col("two_column"), "two-column-layout")
    return notice.join(votes, "doc_id", "left").select("doc_id", layout.alias("layout"))
