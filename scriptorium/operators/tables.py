"""Table algebra: cells in rectangles, grids, continuations, rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

TOLERANCE, SHIFT = 1.5, 6.0


def inside(f: str, box: str, tolerance: float = TOLERANCE) -> str:
    """SQL: the centre of fragment ``f`` lies in the rectangle ``box``."""
    return (
        f"({f}.x0 + {f}.x1) / 2 BETWEEN {box}.x0 - {tolerance}D AND {box}.x1 + {tolerance}D AND "
        f"({f}.y0 + {f}.y1) / 2 BETWEEN {box}.y0 - {tolerance}D AND {box}.y1 + {tolerance}D"
    )


def fragments_in(fragments: DataFrame, boxes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Band join: each fragment with each box of its page that holds its centre (columns of the box: box_*)."""
    renamed = boxes.select(*key, *[F.col(c).alias(f"box_{c}") for c in boxes.columns if c not in key])
    condition = inside("f", "b").replace("b.", "b.box_")
    same = " AND ".join(f"f.{k} = b.{k}" for k in key)
    return fragments.alias("f").join(renamed.alias("b"), F.expr(f"{same} AND {condition}")).select("f.*", *[f"b.box_{c}" for c in boxes.columns if c not in key])


def fragments_outside(fragments: DataFrame, boxes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Anti range join: fragments in no box of their page."""
    same = " AND ".join(f"f.{k} = b.{k}" for k in key)
    return fragments.alias("f").join(boxes.alias("b"), F.expr(f"{same} AND {inside('f', 'b')}"), "left_anti")


def insertion_index(fragments: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, table_id, at): before which fragment (by ord) a table stands: the first in its region, else the first below its top, else the end."""
    ends = fragments.groupBy("doc_id").agg((F.max("ord") + 1).alias("_end"))
    joined = regions.alias("r").join(fragments.alias("f"), F.expr("r.doc_id = f.doc_id AND r.page_number = f.page_number"), "left")
    found = joined.groupBy("r.doc_id", "r.table_id").agg(
        F.min(F.when(F.expr(inside("f", "r")), F.col("f.ord"))).alias("_in"), F.min(F.when(F.expr("f.y0 >= r.y0"), F.col("f.ord"))).alias("_below")
    )
    return found.join(ends, "doc_id", "left").select("doc_id", "table_id", F.coalesce("_in", "_below", "_end", F.lit(0)).alias("at"))


def accepted(cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """Tables of at least 2 x 2 with text in two rows and two columns."""
    shape = cells.groupBy(*key).agg(
        F.max(F.col("row") + F.col("rowspan")).alias("rows"), F.max(F.col("col") + F.col("colspan")).alias("cols"),
        F.count_distinct(F.when(P.stripped(F.col("text")) != "", F.col("row"))).alias("rows_with_text"), F.count_distinct(F.when(P.stripped(F.col("text")) != "", F.col("col"))).alias("cols_with_text"),
    )
    return shape.filter("rows >= 2 AND cols >= 2 AND rows_with_text >= 2 AND cols_with_text >= 2").select(*key)


def expanded_grid(cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """(…, row, values): every row of a table with spans filled in; where cells overlap the first counts."""
    placed = cells.withColumn("_r", F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1))).withColumn("_c", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)))
    one = placed.groupBy(*key, "_r", "_c").agg(F.min_by("text", F.struct("row", "col")).alias("text"))
    width = one.groupBy(*key).agg((F.max("_c") + 1).alias("_w"))
    rows = one.join(width, list(key)).groupBy(*key, F.col("_r").alias("row"), "_w").agg(F.map_from_entries(F.collect_list(F.struct("_c", "text"))).alias("_m"))
    return rows.select(*key, "row", F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda c: F.coalesce(F.try_element_at(F.col("_m"), c), F.lit(""))).alias("values"))


def anchor_grid(cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """As ``expanded_grid``, but a text stands only where its cell begins."""
    return expanded_grid(cells.withColumn("rowspan", F.lit(1)).withColumn("colspan", F.lit(1)), key)


def render_rows(values: Column) -> Column:
    """A row of cells as ``| a | b |``; blank cells keep their place."""
    return F.concat(F.lit("| "), F.array_join(F.transform(values, lambda v: X.escape_pipes(P.collapsed(v))), " | "), F.lit(" |"))


def zip_lines(values: Column) -> Column:
    """A row whose cells have several lines as one row per line; shorter cells are blank below."""
    cut = F.transform(values, P.lines)
    height = F.array_max(F.transform(cut, F.size))
    return F.transform(F.sequence(F.lit(0), height - 1), lambda i: F.transform(cut, lambda c: F.coalesce(F.get(c, i), F.lit(""))))


def wrapped_as_one(values: Column) -> Column:
    """If a single cell of a row has several lines that are no register of figures, they are one line."""
    many = F.size(F.filter(values, lambda v: F.size(P.lines(v)) > 1))
    joined = F.transform(values, lambda v: F.when(F.exists(P.lines(v), lambda x: X.is_plausible_number(P.stripped(x))), v).otherwise(P.collapsed(v)))
    return F.when(many == 1, joined).otherwise(values)


def render_raw(grid: DataFrame, key: Sequence[str]) -> DataFrame:
    """Markdown lines of each table, every row with full width."""
    rows = grid.withColumn("values", wrapped_as_one(F.col("values"))).withColumn("_z", zip_lines(F.col("values")))
    text = rows.withColumn("_t", F.array_join(F.transform("_z", render_rows), "\n"))
    return text.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_t"))), lambda s: s["_t"]), "\n").alias("markdown"))


def render_markdown_table(grid: DataFrame, key: Sequence[str]) -> DataFrame:
    """A Markdown table: the first row heads it (Column N where blank), blank rows are dropped."""
    header = F.transform(F.col("values"), lambda v, i: F.when(P.stripped(v) == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(v))
    line = F.when(F.col("row") == 0, F.concat(render_rows(header), F.lit("\n| "), F.array_join(F.transform("values", lambda v: F.lit("---")), " | "), F.lit(" |"))).otherwise(render_rows(F.col("values")))
    kept = grid.filter((F.col("row") == 0) | F.exists("values", lambda v: P.stripped(v) != ""))
    return kept.withColumn("_t", line).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_t"))), lambda s: s["_t"]), "\n").alias("markdown"))


def continuation_groups(tables: DataFrame) -> DataFrame:
    """Adds ``merged_id``: tables that go on at the top of the next page belong together.

    ``tables`` has doc_id, ord, col_count, caption, and the page, x0, x1, y0, y1 and
    page_height of its first (first_*) and last (last_*) region.
    """
    w = W.partitionBy("doc_id").orderBy("ord")
    prev = lambda c: F.lag(c).over(w)
    caption = F.last(F.when(F.col("caption") != "", F.col("caption")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    goes_on = (
        (F.col("first_page") == prev("last_page") + 1) & (F.col("col_count") == prev("col_count"))
        & (F.coalesce(F.col("caption"), F.lit("")).isin("") | caption.isNull() | (F.col("caption") == caption))
        & (F.abs(F.col("first_x0") - prev("last_x0")) <= SHIFT) & (F.abs(F.col("first_x1") - prev("last_x1")) <= SHIFT)
        & ((prev("last_height") == 0) | (prev("last_y1") >= prev("last_height") * 0.7)) & ((F.col("first_height") == 0) | (F.col("first_y0") <= F.col("first_height") * 0.3))
    )
    flagged = tables.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    return flagged.withColumn("merged_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_new")


def shared_header_rows(head: Column, continuation: Column, rows: Column) -> Column:
    """How many leading rows (arrays of cell texts) of a continuation repeat the head's, at most 5 and never all."""
    sizes = F.sequence(F.lit(5), F.lit(1), F.lit(-1))
    norm = lambda t, n: F.transform(F.slice(t, 1, n), lambda r: F.transform(r, P.collapsed))
    fits = F.filter(sizes, lambda n: (n <= F.size(head)) & (n <= F.size(continuation)) & (n < rows) & (norm(head, n) == norm(continuation, n)))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(0))


# fixed value: what numbers a record, in either script
RECORD_KEY = r"^[0-9\x{966}-\x{96F}]+[.)\x{964}]?$"


def record_groups(rows: DataFrame, key: Sequence[str], serial: str = "serial", continued: str | None = None) -> DataFrame:
    """Adds ``record`` (from 1 in each table) and ``record_key``.

    A row whose serial reads as a number opens a record, unless it repeats the key of the
    record that is open; any other row goes on with the open record.  Rows before the
    first belong to the record ``continued`` from the table before; without that, each is
    a record of its own, named by its number.
    """
    w = W.partitionBy(*key).orderBy("row")
    stripped = P.stripped(F.col(serial))
    keyed = rows.withColumn("_key", F.when(stripped.rlike(RECORD_KEY), stripped))
    before = F.coalesce(F.last("_key", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(continued))
    told = keyed.withColumn("_before", before).withColumn("_first", F.row_number().over(w) == 1)
    opens = F.col("_first") | F.when(F.col("_key").isNull(), F.col("_before").isNull()).otherwise(~F.col("_key").eqNullSafe(F.col("_before")))
    numbered = told.withColumn("record", F.sum(opens.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return numbered.withColumn("record_key", F.coalesce("_key", "_before", F.col("record").cast("string"))).drop("_key", "_before", "_first")


def column_samples(rows: DataFrame, key: Sequence[str], column: str = "col", value: str = "text", most: int = 4) -> DataFrame:
    """The first few distinct values of each column, in order of rows."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", value))), lambda s: s[value])
    return rows.filter(F.col(value) != "").groupBy(*key, column).agg(F.slice(F.array_distinct(ordered), 1, most).alias("samples"))


def key_column(samples: DataFrame, key: Sequence[str], matches: Column) -> DataFrame:
    """The column most of whose cells match; the leftmost of equals."""
    counted = samples.groupBy(*key, "col").agg(F.count_if(matches).alias("n"))
    return counted.groupBy(*key).agg(F.max_by("col", F.struct("n", (-F.col("col")).alias("c"))).alias("key_column"))
