"""Queries over cells, numbers, glyphs and the benchmark artifact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keymaps, patterns as P, text as X
from ..operators import artifact, assemble, numeric, pages, render, tables
from ..sources import files
from .common import FRAGMENTS, KEYMAPS, KEYS, PLACED, d_chars, d_collapse, d_strip, documents, fragments, placed_fragments, table

# ---- joins over rectangles -------------------------------------------------------------------


def _plane(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as points of a plane per supplier, and a box per part size."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + 2).alias("x1"), (F.col("l_discount") * 1000).alias("y0"), (F.col("l_discount") * 1000 + 2).alias("y1"))
    boxes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 40 * 10.0).alias("x0"), (F.col("s_suppkey") % 40 * 10.0 + 100.0).alias("x1"), F.lit(10.0).alias("y0"), F.lit(60.0).alias("y1"))
    return li, boxes


_PLANE = """li AS (SELECT l_suppkey AS doc_id, l_orderkey AS k, l_linenumber AS n, l_quantity * 10 + 1 AS cx, l_discount * 1000 + 1 AS cy FROM lineitem),
boxes AS (SELECT s_suppkey AS doc_id, s_suppkey % 40 * 10.0 AS x0, s_suppkey % 40 * 10.0 + 100.0 AS x1, 10.0 AS y0, 60.0 AS y1 FROM supplier)"""
_IN = "li.doc_id = b.doc_id AND cx BETWEEN b.x0 - 1.5 AND b.x1 + 1.5 AND cy BETWEEN b.y0 - 1.5 AND b.y1 + 1.5"


def cells_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-47: band join, points counted per box."""
    li, boxes = _plane(spark, sf_dir)
    return tables.fragments_in(li, boxes, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("points"), F.min("k").alias("first_order"))


CELLS_IN_REGION = f"WITH {_PLANE} SELECT li.doc_id, count(*) AS points, min(k) AS first_order FROM li JOIN boxes b ON {_IN} GROUP BY li.doc_id"


def cells_outside_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-48: anti range join."""
    li, boxes = _plane(spark, sf_dir)
    return tables.fragments_outside(li, boxes, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("points"))


CELLS_OUTSIDE_REGIONS = f"WITH {_PLANE} SELECT doc_id, count(*) AS points FROM li WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE {_IN}) GROUP BY doc_id"


def insertion_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-117, OP-176: where a table stands among the fragments of its page."""
    f = placed_fragments(spark, sf_dir)
    regions = documents(spark, sf_dir).select("doc_id", F.col("doc_id").alias("table_id"), F.lit(1).alias("page_number"), (F.col("doc_id") % 4 * 90.0).alias("x0"), (F.col("doc_id") % 4 * 90.0 + 80.0).alias("x1"), F.lit(150.0).alias("y0"), F.lit(200.0).alias("y1"))
    return tables.insertion_index(f, regions).select("doc_id", "at")


INSERTION_INDEXES = f"""WITH {PLACED}, e AS (SELECT doc_id, max(ord) + 1 AS e FROM placed GROUP BY doc_id),
r AS (SELECT doc_id, doc_id % 4 * 90.0 AS x0, doc_id % 4 * 90.0 + 80.0 AS x1, 150.0 AS y0, 200.0 AS y1 FROM documents),
j AS (SELECT r.doc_id, min(f.ord) FILTER ((f.x0 + f.x1) / 2 BETWEEN r.x0 - 1.5 AND r.x1 + 1.5 AND (f.y0 + f.y1) / 2 BETWEEN r.y0 - 1.5 AND r.y1 + 1.5) AS i, min(f.ord) FILTER (f.y0 >= r.y0) AS b FROM r LEFT JOIN placed f ON r.doc_id = f.doc_id AND f.page_number = 1 GROUP BY r.doc_id)
SELECT j.doc_id, coalesce(i, b, e, 0) AS at FROM j LEFT JOIN e USING (doc_id)"""

# ---- grids -------------------------------------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the rows of a table per customer, three columns, some cells spanning a fourth."""
    o = table(spark, sf_dir, "orders").withColumn("row", (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int"))
    cents = F.round(F.col("o_totalprice")).cast("long")
    values = F.array(F.col("o_orderstatus"), F.concat("o_orderpriority", F.when(F.col("row") == 1, F.lit("\nX")).otherwise(F.lit(""))), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.concat(F.lit("a|"), cents.cast("string"))))
    c = o.select(F.col("o_custkey").alias("table_id"), "row", F.posexplode(values).alias("col", "text"))
    return c.withColumn("rowspan", F.lit(1)).withColumn("colspan", F.when((F.col("col") == 2) & (F.col("row") % 2 == 0), 2).otherwise(1))


_CELLS = """o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders),
cells AS (SELECT o_custkey AS table_id, r, o_orderstatus AS a, o_orderpriority || CASE WHEN r = 1 THEN chr(10) || 'X' ELSE '' END AS b, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'a|' || round(o_totalprice)::BIGINT END AS c,
 CASE WHEN r % 2 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'a|' || round(o_totalprice)::BIGINT END ELSE '' END AS d FROM o)"""


def pivot_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-172: spans filled in, a row per line."""
    return tables.expanded_grid(_cells(spark, sf_dir), ["table_id"]).select("table_id", F.col("row").cast("long").alias("row"), F.array_join("values", "~").alias("joined"))


PIVOT_GRID = f"WITH {_CELLS} SELECT table_id, r::BIGINT AS row, concat_ws('~', a, b, c, d) AS joined FROM cells"


def render_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-173: full-width pipe rows, lone wrapped cells rejoined."""
    md = tables.render_raw(tables.expanded_grid(_cells(spark, sf_dir), ["table_id"]), ["table_id"])
    return md.select("table_id", F.md5(F.encode("markdown", "UTF-8")).alias("markdown_md5"))


_ROW = "'| ' || a || ' | ' || replace(b, chr(10), ' ') || ' | ' || replace(c, '|', '\\|') || ' | ' || replace(d, '|', '\\|') || ' |'"
RENDER_ROWS = f"WITH {_CELLS} SELECT table_id, md5(string_agg({_ROW}, chr(10) ORDER BY r)) AS markdown_md5 FROM cells GROUP BY table_id"


def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-174, OP-171: Markdown tables of accepted grids."""
    cells = _cells(spark, sf_dir).withColumn("colspan", F.lit(1))
    good = cells.join(tables.accepted(cells, ["table_id"]), "table_id", "left_semi")
    md = tables.render_markdown_table(tables.expanded_grid(good, ["table_id"]), ["table_id"])
    return md.select("table_id", F.md5(F.encode("markdown", "UTF-8")).alias("markdown_md5"))


_ROW3 = "'| ' || a || ' | ' || replace(b, chr(10), ' ') || ' | ' || replace({}, '|', '\\|') || ' |'"
MARKDOWN_TABLES = f"""WITH {_CELLS} SELECT table_id, md5(string_agg(CASE WHEN r = 0 THEN {_ROW3.format("CASE WHEN c = '' THEN 'Column 3' ELSE c END")} || chr(10) || '| --- | --- | --- |' ELSE {_ROW3.format('c')} END, chr(10) ORDER BY r)) AS markdown_md5
FROM cells GROUP BY table_id HAVING max(r) >= 1"""


def record_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-100: rows go on with the record above (events of a user; some are numbered, some labelled with no number)."""
    n = F.col("event_id")
    serial = F.when(n % 3 == 0, F.concat(F.lit(" "), (F.floor(n / 3) % 2).cast("string"), F.lit("."))).when(n % 3 == 1, "1a").otherwise("")
    e = table(spark, sf_dir, "events").select("user_id", n.alias("row"), serial.alias("serial"))
    return tables.record_groups(e, ["user_id"]).groupBy("user_id", "record", "record_key").agg(F.count("*").alias("rows"))


RECORD_GROUPS = """WITH s AS (SELECT user_id, event_id AS r, CASE WHEN event_id % 3 = 0 THEN (event_id // 3 % 2) || '.' END AS k FROM events),
p AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM s),
g AS (SELECT *, sum(CASE WHEN k IS NULL THEN open IS NULL ELSE open IS NULL OR k <> open END::INTEGER) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INTEGER AS record FROM p)
SELECT user_id, record, coalesce(k, open, record::VARCHAR) AS record_key, count(*) AS rows FROM g GROUP BY ALL"""


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-93, OP-94: an order's lines as the printed lines of a cell; one that repeats the line above is overprint."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    y = F.col("l_linenumber") * 20.0
    fragment = F.struct(F.lit(10.0).alias("x0"), y.alias("y0"), F.lit(60.0).alias("x1"), (y + 11.0).alias("y1"), F.when(F.col("q") > 25, " many ").otherwise("few").alias("text"))
    cells = lines.groupBy("l_orderkey").agg(F.collect_list(fragment).alias("fragments"))
    return cells.select("l_orderkey", assemble.cell_text(F.col("fragments")).alias("text"))


CELL_TEXTS = """WITH l AS (SELECT l_orderkey, l_linenumber AS n, CASE WHEN max(l_quantity) > 25 THEN 'many' ELSE 'few' END AS t FROM lineitem GROUP BY ALL),
k AS (SELECT *, lag(t) OVER (PARTITION BY l_orderkey ORDER BY n) IS DISTINCT FROM t AS kept FROM l) SELECT l_orderkey, string_agg(t, chr(10) ORDER BY n) AS text FROM k WHERE kept GROUP BY l_orderkey"""


def header_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-151: heads of columns, and captions as keys."""
    k = F.col("p_partkey") % 3
    head = F.when(k == 0, "आयोग  को निर्णय").when(k == 1, " मिति/मुद्दानं र").otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  "))))
    return table(spark, sf_dir, "part").select("p_partkey", X.header_label(head).alias("head"), X.caption_key(F.concat_ws(" - ", "p_name", "p_brand")).alias("caption_key"))


HEADER_LABELS = r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'आयोगको निर्णय' WHEN 1 THEN 'मिति/मुद्दा नं र' ELSE trim(regexp_replace(p_name, ' +', ' ', 'g')) END AS head,
lower(regexp_replace(p_name || p_brand, '[^\pL\pN]+', '', 'g')) AS caption_key FROM part"""


def continued_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-101: orders of a customer as tables on pages that may go on."""
    o = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    t = o.select(
        F.col("o_custkey").alias("doc_id"), F.col("n").alias("ord"), (F.col("o_orderkey") % 2).alias("col_count"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("caption"),
        F.col("n").alias("first_page"), F.col("n").alias("last_page"), *[(F.col("o_orderkey") % 4 * 2.0).alias(f"{s}_x0") for s in ("first", "last")], *[F.lit(500.0).alias(f"{s}_x1") for s in ("first", "last")],
        F.lit(100.0).alias("first_y0"), F.lit(700.0).alias("last_y1"), F.lit(800.0).alias("first_height"), F.lit(800.0).alias("last_height"),
    )
    return tables.continuation_groups(t).groupBy("doc_id", "merged_id").agg(F.count("*").alias("parts"))


CONTINUED_TABLES = """WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 2 AS cols, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS cap, o_orderkey % 4 * 2.0 AS x0 FROM orders),
p AS (SELECT *, last_value(cap IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
f AS (SELECT *, CASE WHEN coalesce(cols = lag(cols) OVER w AND (cap IS NULL OR before IS NULL OR cap = before) AND abs(x0 - lag(x0) OVER w) <= 6.0, false) THEN 0 ELSE 1 END AS opens FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
g AS (SELECT doc_id, sum(opens) OVER (PARTITION BY doc_id ORDER BY n)::INTEGER AS merged_id FROM f) SELECT doc_id, merged_id, count(*) AS parts FROM g GROUP BY doc_id, merged_id"""


def column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-114, OP-116, OP-123: first distinct values, and the column most like a key."""
    c = _cells(spark, sf_dir)
    samples = tables.column_samples(c, ["table_id"]).groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "samples"))), lambda s: F.array_join(s["samples"], ",")), ";").alias("samples"))
    return samples.join(tables.key_column(c, ["table_id"], F.col("text").rlike("[0-9]")), "table_id")


COLUMN_SAMPLES = f"""WITH {_CELLS}, l AS (SELECT table_id, list(a ORDER BY r) AS la, list(b ORDER BY r) AS lb, list(c ORDER BY r) AS lc FROM cells GROUP BY table_id)
SELECT table_id, array_to_string(list_filter([{', '.join(f"array_to_string(list_filter({x}, lambda v, i: v <> '' AND list_position({x}, v) = i)[1:4], ',')" for x in ('la', 'lb', 'lc'))}], lambda s: s <> ''), ';') AS samples, 1 AS key_column FROM l"""

# ---- numbers -----------------------------------------------------------------------------------


def plausible_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-34, OP-140: prices in several spellings and both scripts."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%.2f", F.col("o_totalprice")).alias("t"))
    spelled = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.translate("t", ".", "।")).when(F.col("o_orderkey") % 4 == 1, F.concat("t", "t")).when(F.col("o_orderkey") % 4 == 2, F.regexp_replace("t", r"^([0-9]+)([0-9]{3})\.", "$1,$2.")).otherwise(X.to_devanagari_digits(F.col("t"))).alias("t"))
    return spelled.select("o_orderkey", X.is_plausible_number(F.col("t")).alias("plausible"), X.canonical_number(F.col("t")).alias("canonical"), X.is_two_decimal_join(F.col("t")).alias("joined"))


PLAUSIBLE_NUMBERS = f"""WITH o AS (SELECT o_orderkey, printf('%.2f', o_totalprice) AS t FROM orders),
s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN t WHEN 1 THEN t || t WHEN 2 THEN regexp_replace(t, '^([0-9]+)([0-9]{{3}})\\.', '\\1,\\2.') ELSE t END AS t FROM o)
SELECT o_orderkey, regexp_matches(t, '{X.PLAUSIBLE}') AS plausible, t AS canonical, regexp_matches(t, '^[0-9][0-9,]*\\.[0-9]{{1,2}}[0-9][0-9,]*\\.[0-9]{{1,2}}$') AS joined FROM s"""


def normalized_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-144: order dates in either script."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy/M/d").alias("t"))
    return o.select("o_orderkey", X.normalize_date(F.when(F.col("o_orderkey") % 2 == 0, X.to_devanagari_digits(F.col("t"))).otherwise(F.concat(F.lit("on "), "t"))).alias("date"))


NORMALIZED_DATES = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders"


def median_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-71: medians by two grouping sets with at least three samples."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("font"), F.lit(1.0).alias("size"), F.col("event_type").alias("c"), (F.round(F.col("value") * 100) % 200 / 100).alias("advance"))
    return numeric.expected_advances(e).select("font", "c", "advance", "samples")


MEDIAN_ADVANCE = """WITH e AS (SELECT (user_id % 50)::VARCHAR AS font, event_type AS c, round(value * 100) % 200 / 100 AS advance FROM events)
SELECT font, c, median(advance) AS advance, count(*) AS samples FROM e WHERE advance > 0 AND advance <= 2 GROUP BY GROUPING SETS ((font, c), (font)) HAVING count(*) >= 3"""


def edge_stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-49, OP-102, OP-183: ruled edges between neighbouring digits."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%.2f", F.col("o_totalprice")).alias("t"))
    ch = o.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.split("t", "")).alias("idx", "c"))
    x = F.col("idx") * 5.0
    ch = ch.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), "idx", "c", x.alias("origin_x"), x.alias("x0"), F.lit(10.0).alias("y0"), (x + 4.5).alias("x1"), F.lit(20.0).alias("y1"), F.lit("f").alias("font"), F.lit(10.0).alias("size"))
    drawings = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("o_orderkey") % 2 == 0, "re").otherwise("l").alias("kind"), (F.col("o_orderkey") % 7 * 5.0 + 4.8).alias("x0"), F.lit(0.0).alias("y0"), (F.col("o_orderkey") % 7 * 5.0 + F.when(F.col("o_orderkey") % 2 == 0, 9.8).otherwise(4.8)).alias("x1"), F.lit(30.0).alias("y1"))
    cuts = numeric.rule_cuts(ch, numeric.vertical_edges(drawings))
    return cuts.select("doc_id", F.col("idx").cast("long").alias("idx"))


EDGE_STAB = """WITH o AS (SELECT o_orderkey AS k, printf('%.2f', o_totalprice) AS t FROM orders), c AS (SELECT k, i, substr(t, i, 1) AS a, substr(t, i + 1, 1) AS b FROM o, LATERAL (SELECT unnest(range(1, length(t))) AS i)),
e AS (SELECT k, unnest(CASE WHEN k % 2 = 0 THEN [k % 7 * 5.0 + 4.8, k % 7 * 5.0 + 9.8] ELSE [k % 7 * 5.0 + 4.8] END) AS x FROM o)
SELECT DISTINCT c.k AS doc_id, i AS idx FROM c JOIN e ON c.k = e.k WHERE regexp_matches(a, '[0-9]') AND regexp_matches(b, '[0-9]') AND x BETWEEN (i - 1) * 5.0 + 4.5 - 0.8 AND i * 5.0"""


def _repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as merged numbers, taken apart after the cents of a first amount."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_suppkey") % 9 + 1).cast("string").alias("a"), (F.col("l_partkey") % 9 + 1).cast("string").alias("b"))
    merged = F.concat("a", F.lit(".5"), F.lit("0"), "b", F.lit(".25"))
    parts = F.when((F.col("l_linenumber") % 4 != 0) | (F.col("l_suppkey") % 3 == 0), F.array(F.concat("a", F.lit(".50")), F.concat("b", F.lit(".25")))).otherwise(F.array(F.concat("a", F.lit(".5")), F.concat(F.lit("0"), "b", F.lit(".25"))))
    return li.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), merged.alias("merged_text"), parts.alias("parts"))


_REPAIRS = """rep AS (SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS ord, (l_suppkey % 9 + 1) || '.50' || (l_partkey % 9 + 1) || '.25' AS merged, CASE WHEN l_linenumber % 4 <> 0 OR l_suppkey % 3 = 0 THEN (l_suppkey % 9 + 1) || '.50 | ' || (l_partkey % 9 + 1) || '.25' ELSE (l_suppkey % 9 + 1) || '.5 | 0' || (l_partkey % 9 + 1) || '.25' END AS parts FROM lineitem)"""


def partition_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-73."""
    e = numeric.partition_evidence(_repairs(spark, sf_dir))
    return e.select("doc_id", "merged", F.array_join("parts", " | ").alias("parts"), "evidence", "partitions")


PARTITION_EVIDENCE = f"WITH {_REPAIRS}, g AS (SELECT doc_id, merged, parts, count(*) AS evidence FROM rep GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY doc_id, merged) AS partitions FROM g"


def unique_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-74."""
    return numeric.unique_repairs(_repairs(spark, sf_dir)).select("doc_id", "merged_text", F.array_join("parts", " | ").alias("parts"))


UNIQUE_PARTITION = f"WITH {_REPAIRS} SELECT doc_id, merged AS merged_text, arg_min(parts, ord) AS parts FROM rep GROUP BY doc_id, merged HAVING count(DISTINCT parts) = 1"


def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-75, OP-76: of repairs alike in place and value the last."""
    r = _repairs(spark, sf_dir).withColumns({"page": F.lit(1), "block": F.lit(0), "line": (F.col("ord") % 3).cast("int"), "start_index": F.lit(0)})
    return numeric.last_repairs(r).select("doc_id", "line", "ord", "merged_text")


DEDUPE_LAST = f"WITH {_REPAIRS} SELECT doc_id, (ord % 3)::INTEGER AS line, max(ord) AS ord, merged AS merged_text FROM rep GROUP BY doc_id, ord % 3, merged, parts"


def mode_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-72: the most frequent event type of a user, the first seen of equals."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("text"), F.col("event_id").alias("ord"))
    return numeric.modal_text(e, "user_id").select("user_id", "text")


MODE_FIRST = "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, row(n, -f)) AS text FROM c GROUP BY user_id"


def nearest_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-50: embeddings (in thousandths) against five of them by L1."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("glyph"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000)).alias("feature"))
    marks = v.filter("glyph < 5").select(F.col("glyph").alias("ord"), F.col("glyph").cast("string").alias("mark"), "feature")
    return numeric.nearest_mark(v, marks, 1_000_000)


NEAREST_MARK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)) AS f FROM embeddings), d AS (SELECT v.vec_id AS glyph, m.vec_id AS mark, list_sum(list_transform(list_zip(v.f, m.f), lambda z: abs(z[1] - z[2]))) AS distance FROM v, v m WHERE m.vec_id < 5)
SELECT glyph, arg_min(mark, row(distance, mark))::VARCHAR AS mark, min(distance) AS distance FROM d GROUP BY glyph"""


def signature_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-80, OP-195: digit signatures (hashes of titles) against a reference row."""
    d = documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).alias("font"), (F.col("doc_id") % 10).alias("digit"), F.when(F.col("doc_id") % 17 != 0, F.sha2(F.encode("text", "UTF-8"), 256)).alias("hex"))
    d = d.select("font", "digit", F.when(F.col("hex").isNotNull(), numeric.signature_longs(F.col("hex"))).alias("signature"))
    votes = numeric.draws_reference_digits(d, d.filter("font = 3"), near=128)
    return votes.select("font", "verdict")


SIGNATURE_VOTES = """WITH d AS (SELECT doc_id // 10 AS font, doc_id % 10 AS digit, CASE WHEN doc_id % 17 <> 0 THEN sha256(coalesce(text, '')) END AS hex FROM documents),
b AS (SELECT font, digit, CASE WHEN hex IS NOT NULL THEN unhex(hex)::BIT END AS s FROM d)
SELECT a.font, CASE WHEN count(a.s) >= 7 THEN count(*) FILTER (bit_count(xor(a.s, r.s)) <= 128) >= 7 END AS verdict FROM b a JOIN b r ON a.digit = r.digit AND r.font = 3 GROUP BY a.font"""


def outline_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-54: glyph outlines known by digest."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("glyph"), F.col("p_brand").alias("font"), F.encode("p_name", "UTF-8").alias("outline"), F.when(F.col("p_partkey") % 3 == 0, 1000).otherwise(2048).alias("units_per_em"))
    dictionary = table(spark, sf_dir, "part").filter("p_size < 20").select(F.left(F.sha2(F.encode("p_name", "UTF-8"), 256), F.lit(16)).alias("digest"), F.col("p_name").alias("text")).distinct()
    return numeric.outline_map(p, dictionary).select("font", "glyph", "text")


OUTLINE_MAP = "WITH dict AS (SELECT DISTINCT left(sha256(p_name), 16) AS digest, p_name AS text FROM part WHERE p_size < 20) SELECT p_brand AS font, p_partkey AS glyph, text FROM part JOIN dict ON left(sha256(p_name), 16) = digest WHERE p_partkey % 3 <> 0"

# ---- artifact ----------------------------------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels in three configurations, with checks and recorded texts."""
    d = documents(spark, sf_dir)
    recorded = d.crossJoin(spark.range(3)).filter("(doc_id + id) % 7 != 0").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document"), F.element_at(F.array(F.lit("plain"), F.lit("repair"), F.lit("ocr")), (F.col("id") + 1).cast("int")).alias("config"),
        F.when((F.col("doc_id") + F.col("id")) % 5 == 0, "error").otherwise("ok").alias("status"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"), F.lit("Fell back").alias("diagnostics"),
        F.when(F.col("id") == 2, F.col("doc_id") % 4).alias("calls"), F.when(F.col("id") == 2, F.col("doc_id") % 4 * 100).alias("tokens"),
    )
    documents_ = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document"), F.when(F.col("doc_id") % 11 == 0, "known_issue").when(F.col("doc_id") % 13 == 0, "reference").otherwise("must").alias("expectation"))
    configs = spark.range(4).select(F.element_at(F.array(F.lit("plain"), F.lit("repair"), F.lit("ocr"), F.lit("vision")), (F.col("id") + 1).cast("int")).alias("config"), (F.col("id") < 3).alias("available"))
    expanded = artifact.expand(documents_, configs, recorded)
    check = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"))
    checks = F.array(check("min_chars", "300"), check("contains", " "), check("max_replacement", "0"), check("max_devanagari", "5"), check("diagnostic_contains", "FELL"))
    judged = artifact.evaluate(expanded.withColumn("checks", checks))
    return judged.withColumn("outcome", F.when(F.col("status").isNotNull(), artifact.outcome(F.col("expectation"), F.col("status"), F.col("passed"))))


_RUNS = f"""rec AS (SELECT 'doc-' || doc_id AS document, ['plain', 'repair', 'ocr'][i + 1] AS config, CASE WHEN (doc_id + i) % 5 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 9 <> 0 THEN coalesce(text, '') END AS text, CASE WHEN i = 2 THEN doc_id % 4 END AS calls, CASE WHEN i = 2 THEN doc_id % 4 * 100 END AS tokens FROM documents, range(3) t(i) WHERE (doc_id + i) % 7 <> 0),
doc AS (SELECT 'doc-' || doc_id AS document, CASE WHEN doc_id % 11 = 0 THEN 'known_issue' WHEN doc_id % 13 = 0 THEN 'reference' ELSE 'must' END AS expectation FROM documents),
ex AS (SELECT doc.document, c.config, expectation, status, text, calls, tokens FROM doc CROSS JOIN (VALUES ('plain'), ('repair'), ('ocr')) c(config) LEFT JOIN rec ON rec.document = doc.document AND rec.config = c.config),
ch AS (SELECT *, CASE WHEN text IS NULL THEN false ELSE length(text) >= 300 AND contains(text, ' ') AND {d_chars('text', chr(92) + 'x{FFFD}')} <= 0 AND {d_chars('text', P.DEVANAGARI)} <= 5 END AS passed FROM ex),
runs AS (SELECT *, CASE WHEN status IS NOT NULL THEN CASE WHEN expectation = 'reference' THEN 'reference' WHEN NOT (status = 'ok' AND passed) AND expectation = 'known_issue' THEN 'known_issue' WHEN NOT (status = 'ok' AND passed) THEN 'fail' ELSE 'pass' END END AS outcome FROM ch)"""


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-53, OP-160, OP-161, OP-162."""
    return artifact.replayed(_runs(spark, sf_dir)).select("document", "config", "status", "outcome", F.char_length("text").cast("long").alias("chars"))


RUN_OUTCOMES = f"WITH {_RUNS} SELECT document, config, coalesce(status, 'bad-output') AS status, outcome, length(coalesce(text, ''))::BIGINT AS chars FROM runs"


def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-77."""
    return artifact.tally(_runs(spark, sf_dir).filter("outcome IS NOT NULL"))


OUTCOME_TALLY = f"""WITH {_RUNS} SELECT config, count(*) FILTER (outcome = 'pass') AS pass, count(*) FILTER (outcome = 'fail') AS fail, count(*) FILTER (outcome = 'known_issue') AS known_issue, count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER (outcome = 'reference') AS reference,
count(*) AS runs, sum(calls)::BIGINT AS ocr_calls, sum(tokens)::BIGINT AS ocr_tokens, count(calls) AS counted FROM runs WHERE outcome IS NOT NULL GROUP BY config"""


def outcome_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-77 as a pivot."""
    return artifact.tally_pivot(_runs(spark, sf_dir).filter("outcome IS NOT NULL")).select("config", "pass", "fail", "known_issue")


OUTCOME_PIVOT = f"WITH {_RUNS} SELECT config, count(*) FILTER (outcome = 'pass') AS pass, count(*) FILTER (outcome = 'fail') AS fail, count(*) FILTER (outcome = 'known_issue') AS known_issue FROM runs WHERE outcome IS NOT NULL GROUP BY config"


def missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-190, OP-122."""
    return artifact.missing_runs(_runs(spark, sf_dir))


MISSING_RUNS = f"WITH {_RUNS} SELECT document || '--' || config AS run FROM runs WHERE status IS NULL"


def summary_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-187."""
    return artifact.summary_markdown(artifact.tally(_runs(spark, sf_dir).filter("outcome IS NOT NULL")))


SUMMARY_MARKDOWN = f"""WITH {_RUNS}, t AS (SELECT config, printf('| %s | %d | %d | %d | %d |', config, count(*) FILTER (outcome = 'pass'), count(*) FILTER (outcome = 'fail'), count(*) FILTER (outcome = 'known_issue'), count(*) FILTER (outcome = 'blocked')) AS line FROM runs WHERE outcome IS NOT NULL GROUP BY config)
SELECT '| Configuration | Pass | Fail | Known issue | Blocked |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY config) AS markdown FROM t"""


def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-38, OP-39: documents of a kind with words in them and a failed run, and the run each opens with."""
    runs = _runs(spark, sf_dir).filter("outcome IS NOT NULL").withColumn("ord", F.element_at(F.create_map(F.lit("plain"), F.lit(0), F.lit("repair"), F.lit(1), F.lit("ocr"), F.lit(2)), F.col("config")))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document"), F.col("lang").alias("kind"), F.coalesce("text", F.lit("")).alias("title"), F.col("source").alias("publisher"))
    found = artifact.filtered(d, runs, outcome="fail", kind="en", words="The")
    return found.join(artifact.default_run(runs, "ocr"), "document").select("document", "config")


CATALOG_FILTER = f"""WITH {_RUNS}, r AS (SELECT *, CASE config WHEN 'plain' THEN 0 WHEN 'repair' THEN 1 ELSE 2 END AS ord FROM runs WHERE outcome IS NOT NULL),
d AS (SELECT document, arg_min(config, row(CASE WHEN config = 'ocr' THEN 0 WHEN outcome <> 'reference' THEN 1 ELSE 2 END, ord)) AS config FROM r GROUP BY document)
SELECT d.document, d.config FROM d JOIN documents x ON d.document = 'doc-' || x.doc_id WHERE lang = 'en' AND contains(lower(concat_ws(' ', coalesce(text, ''), source, lang)), 'the') AND EXISTS (SELECT 1 FROM r WHERE r.document = d.document AND outcome = 'fail')"""


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-18: logged responses, of which half name their counters in the older way."""
    n, old = F.col("event_id"), F.col("event_id") % 2 == 0
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("config"), F.when(old, n % 100).alias("prompt_tokens"), F.when(~old, n % 90).alias("input_tokens"),
        F.when(old, n % 80).alias("completion_tokens"), F.when(~old, n % 70).alias("output_tokens"),
    )
    return files.usage_totals(e)


USAGE_TOTALS = """SELECT event_type AS config, count(*) AS calls, sum(CASE WHEN event_id % 2 = 0 THEN event_id % 100 ELSE event_id % 90 END)::BIGINT AS input_tokens,
sum(CASE WHEN event_id % 2 = 0 THEN event_id % 80 ELSE event_id % 70 END)::BIGINT AS output_tokens FROM events GROUP BY event_type"""


def attempt_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-188: how attempts to convert ended."""
    n = F.col("event_id")
    output = F.when(n % 3 == 1, F.concat(F.lit('{"status":"'), "event_type", F.lit('"}'))).when(n % 3 == 2, "no record").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", artifact.attempt_status(n % 11 != 0, n % 7 == 0, n % 5 - 2, output).alias("status"))


ATTEMPT_STATUSES = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unreadable_source' WHEN event_id % 7 = 0 THEN 'timeout' WHEN event_id % 3 = 0 AND event_id % 5 < 2 THEN 'killed'
WHEN event_id % 3 = 0 AND event_id % 5 > 2 THEN 'worker_error' WHEN event_id % 3 = 1 THEN event_type ELSE 'bad_output' END AS status FROM events"""


def backend_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-189: configurations that need nothing, a service that is there, one that is not, and an unknown one."""
    needs = F.element_at(F.array(F.lit(""), F.lit("service"), F.lit("local"), F.lit("other")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    ready = table(spark, sf_dir, "nation").select("n_nationkey", needs.alias("requires")).withColumn("available", artifact.availability(F.col("requires"), {"service": True, "local": False}))
    return ready.withColumn("reason", artifact.unavailable_reason(F.col("requires"), F.col("available"), {"local": "no local server"}))


BACKEND_AVAILABILITY = """SELECT n_nationkey, ['', 'service', 'local', 'other'][n_nationkey % 4 + 1] AS requires, n_nationkey % 4 < 2 AS available,
CASE n_nationkey % 4 WHEN 2 THEN 'no local server' WHEN 3 THEN 'backend not configured' END AS reason FROM nation"""


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-196: orders with their lines as JSON, and read back."""
    lines = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))))
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order")).agg(lines.alias("lines"), F.lit(None).cast("string").alias("note"))
    told = o.select("order", files.encoded("order", "lines", "note").alias("t"))
    back = files.decoded(F.col("t"), "order long, lines array<struct<line:long,part:long>>, note string")
    return told.select("order", F.md5(F.encode("t", "UTF-8")).alias("json_md5"), F.aggregate(back["lines"], F.lit(0).cast("long"), lambda s, x: s + x["part"]).alias("parts"))


JSON_RECORDS = """SELECT l_orderkey AS "order", md5('{"order":' || l_orderkey || ',"lines":[' || string_agg('{"line":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || '],"note":null}') AS json_md5,
sum(l_partkey)::BIGINT AS parts FROM lineitem GROUP BY l_orderkey"""


def http_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-40: addresses that may be followed; every third is made one that may not."""
    k = F.col("page_id") % 3
    return table(spark, sf_dir, "pages").select("page_id", files.http_url(F.when(k == 0, F.concat(F.lit("ftp:"), "url")).when(k == 1, F.concat(F.lit("  "), "url")).otherwise(F.col("url"))).alias("url"))


HTTP_URLS = f"SELECT page_id, CASE WHEN page_id % 3 <> 0 AND regexp_matches({d_strip('url')}, '(?i)^https?://[^/?#{P.SPACES}]') THEN {d_strip('url')} END AS url FROM pages"


def corpus_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-07: known suffixes in any case, and explicit files with any."""
    suffix = F.element_at(F.array(F.lit(".pdf"), F.lit(".DOCX"), F.lit(".doc"), F.lit(".txt")), (F.col("p_partkey") % 4 + 1).cast("int"))
    every = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_name", suffix).alias("path"), "p_size")
    return files.list_corpus(every.select("path"), every.filter("p_size > 25").select("path"))


CORPUS_LISTING = """SELECT DISTINCT p_brand || '/' || p_name || ['.pdf', '.DOCX', '.doc', '.txt'][p_partkey % 4 + 1] AS path FROM part WHERE p_partkey % 4 < 3 OR p_size > 25"""


def size_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-164: whole numbers above zero, else the default."""
    k = F.col("p_partkey") % 4
    value = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.concat(F.lit("-"), F.col("p_size").cast("string"))).when(k == 2, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", files.parse_size(value, 512).alias("size"))


SIZE_SETTINGS = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_size > 0 THEN p_size ELSE 512 END::INTEGER AS size FROM part"


def degraded_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-153: what failed for want of resources is stamped, and the stamp reads back."""
    error = F.element_at(F.array(F.lit("MemoryError"), F.lit("OSError"), F.lit("ValueError")), (F.col("doc_id") % 3 + 1).cast("int"))
    stamped = documents(spark, sf_dir).select("doc_id", X.stamp_degraded(F.col("text"), error).alias("t"))
    return stamped.select("doc_id", F.md5(F.encode("t", "UTF-8")).alias("text_md5"), X.degraded_error(F.col("t")).alias("error"))


DEGRADED_STAMPS = """SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN '<!-- degraded: MemoryError -->' || chr(10) || chr(10) WHEN 1 THEN '<!-- degraded: OSError -->' || chr(10) || chr(10) ELSE '' END || coalesce(text, '')) AS text_md5,
CASE doc_id % 3 WHEN 0 THEN 'MemoryError' WHEN 1 THEN 'OSError' END AS error FROM documents"""


def press_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-131: lines behind a bullet, a symbol-font glyph or a reordering marker, which is no symbol."""
    opening = F.element_at(F.array(F.lit("• "), F.lit(chr(0xF0B7) + " "), F.lit(chr(0xF001) + " ")), (F.col("line_number") % 3 + 1).cast("int"))
    f = fragments(spark, sf_dir).select("doc_id", F.col("line_number").cast("long").alias("line"), X.normalize_press_line(F.concat(opening, "text")).alias("t"))
    return f.select("doc_id", "line", F.md5(F.encode("t", "UTF-8")).alias("text_md5"))


PRESS_LINES = f"""WITH {FRAGMENTS} SELECT doc_id, line, md5(regexp_replace({d_collapse("CASE WHEN line % 3 = 2 THEN chr(61441) ELSE '-' END || ' ' || text")}, ' ([।,:;])', '\\1', 'g')) AS text_md5 FROM frag"""


def pipe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-150: figures run together in a pipe line, taken apart by their digits; the merged text ends in a point."""
    n = (F.col("o_orderkey") % 9000 + 1000).cast("string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.left(n, F.lit(2)).alias("a"), F.right(n, F.lit(2)).alias("b"))
    line = F.concat(F.lit("| x | "), "a", F.lit(" "), "b", F.lit(". |"))
    merged, parts = F.concat("a", "b", F.lit(".")), F.array(F.col("a"), F.concat("b", F.lit(".")))
    return o.select("o_orderkey", numeric.repaired_pipe_lines(line, merged, parts).alias("line"))


PIPE_LINES = "SELECT o_orderkey, '| x | ' || left(n, 2) || ' | ' || right(n, 2) || '. |' AS line FROM (SELECT o_orderkey, (o_orderkey % 9000 + 1000)::VARCHAR AS n FROM orders)"


def span_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-143: lines as spans of fonts of every kind, each decoded by the first rule for it."""
    n, t = F.col("line_number"), F.col("text")
    strategy = F.when(n % 7 < 3, "legacy_remap").when(n % 7 < 5, "broken_cmap").otherwise("correct")
    decoded = assemble.decode_span(
        t, strategy, n % 11 == 0, F.when(n % 3 == 0, F.translate(t, KEYS, KEYMAPS["first"])), n % 2 == 0, F.contains(t, F.lit("the")),
        F.when(n % 7 < 2, F.translate(t, "abc", "xyz")), F.when(n % 5 == 0, F.translate(t, "eo", "EO")), F.lit(True),
    )
    return fragments(spark, sf_dir).select("doc_id", n.cast("long").alias("line"), F.md5(F.encode(decoded, "UTF-8")).alias("text_md5"))


SPAN_DECODING = f"""WITH {FRAGMENTS} SELECT doc_id, line, md5(CASE WHEN line % 11 = 0 THEN translate(text, '0123456789', '०१२३४५६७८९') WHEN line % 3 = 0 AND line % 2 = 1 AND contains(text, 'the') THEN text
WHEN line % 3 = 0 AND line % 2 = 1 THEN translate(text, '{KEYS}', '{KEYMAPS['first']}') WHEN line % 7 < 2 THEN translate(text, 'abc', 'xyz') WHEN line % 7 < 3 THEN text
WHEN line % 5 = 0 THEN translate(text, 'eo', 'EO') ELSE text END) AS text_md5 FROM frag"""


def usage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-78: counters of consecutive events of a user; null where one went back."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct((F.col("event_id") % 100).alias("calls"), (F.col("event_id") * 3 % 500).alias("input_tokens"), (F.col("event_id") * 7 % 300).alias("output_tokens")).alias("u"))
    prev = F.lag("u").over(W.partitionBy("user_id").orderBy("event_id"))
    return e.withColumn("d", artifact.usage_delta(prev, F.col("u"))).select("event_id", "d.calls", "d.total_tokens")


USAGE_DELTA = """WITH e AS (SELECT event_id, user_id, event_id % 100 AS c, event_id * 3 % 500 AS i, event_id * 7 % 300 AS o FROM events), p AS (SELECT *, c - lag(c) OVER w AS dc, i - lag(i) OVER w AS di, o - lag(o) OVER w AS dn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, CASE WHEN dc >= 0 AND di >= 0 AND dn >= 0 THEN dc END AS calls, CASE WHEN dc >= 0 AND di >= 0 AND dn >= 0 THEN di + dn END AS total_tokens FROM p"""


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-12: names that collide get -2, -3, …"""
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("directory"), F.split("p_name", " ")[0].alias("stem"), F.col("p_partkey").alias("ord"))
    return render.output_names(f).select("ord", "directory", "name")


OUTPUT_NAMES = """WITH f AS (SELECT p_brand AS directory, split_part(p_name, ' ', 1) AS stem, p_partkey AS ord FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY directory, stem ORDER BY ord) AS n FROM f)
SELECT ord, directory, CASE WHEN n = 1 THEN stem ELSE stem || '-' || n END AS name FROM n"""


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-20: page specifications of every kind."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 12 + 1).alias("total"), F.element_at(F.array(*map(F.lit, ("3", "2-5", "0", "7-2", "x", "1-", "9-20"))), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("spec"))
    return o.select("o_orderkey", pages.page_range(F.col("spec"), F.col("total")).alias("r")).select("o_orderkey", "r.first", "r.last", "r.error")


PAGE_RANGES = """WITH o AS (SELECT o_orderkey, o_orderkey % 12 + 1 AS total, ['3', '2-5', '0', '7-2', 'x', '1-', '9-20'][o_orderkey % 7 + 1] AS spec FROM orders), p AS (SELECT *, try_cast(regexp_extract(spec, '^([0-9]+)(?:-([0-9]+))?$', 1) AS INTEGER) AS a, nullif(regexp_extract(spec, '^([0-9]+)(?:-([0-9]+))?$', 2), '') AS b0 FROM o),
q AS (SELECT *, coalesce(try_cast(b0 AS INTEGER), a) AS b FROM p), e AS (SELECT *, CASE WHEN a IS NULL THEN 'malformed' WHEN a < 1 THEN 'start below 1' WHEN b < a THEN 'end before start' WHEN a > total THEN 'start beyond end' END AS error FROM q)
SELECT o_orderkey, CASE WHEN error IS NULL THEN a END AS first, CASE WHEN error IS NULL THEN least(b, total)::INTEGER END AS last, error FROM e"""


def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-21: pages in the order written, repeats kept."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("1-"), (F.col("c_custkey") % 3 + 1).cast("string"), F.lit(",5,"), (F.col("c_custkey") % 2 + 1).cast("string")).alias("spec"))
    return pages.page_selection(c, "spec").select("c_custkey", "selection_ord", "page")


PAGE_SELECTION = "WITH c AS (SELECT c_custkey, list_concat(range(1, c_custkey % 3 + 2), [5, c_custkey % 2 + 1]) AS p FROM customer) SELECT c_custkey, i AS selection_ord, p[i]::INTEGER AS page FROM c, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)"


def devanagari_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-133, OP-134, OP-158: one i-matra and one repha marker in each decoded line."""
    f = fragments(spark, sf_dir).select("doc_id", F.col("line_number").cast("long").alias("line"), F.translate("text", KEYS, KEYMAPS["first"]).alias("t"))
    marked = F.concat(F.regexp_replace("t", "^(.)", "$1"), F.lit("क"))
    return f.select("doc_id", "line", F.md5(F.encode(X.reorder_devanagari(marked), "UTF-8")).alias("text_md5"))


_RC = r"[\x{915}-\x{939}]"
_RCL = rf"(?:{_RC}\x{{94D}})*{_RC}"
DEVANAGARI_REORDER = f"""WITH {FRAGMENTS}, f AS (SELECT doc_id, line, regexp_replace(translate(text, '{KEYS}', '{KEYMAPS['first']}'), '^(.)', '\\1' || chr(61441)) || 'क' || chr(61440) AS t FROM frag),
i AS (SELECT doc_id, line, replace(regexp_replace(t, chr(61441) || '({_RCL})', '\\1ि', 'g'), chr(61441), 'ि') AS t FROM f)
SELECT doc_id, line, md5(replace(regexp_replace(t, '({_RCL}[\\x{{93E}}-\\x{{94C}}\\x{{962}}\\x{{963}}\\x{{901}}-\\x{{903}}\\x{{94D}}]*)' || chr(61440), 'र्\\1', 'g'), chr(61440), 'र्')) AS text_md5 FROM i"""


def symbol_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-141, OP-139: lifted symbols put back, bracketed numbers guarded."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", "abcdefgh", "".join(chr(0xF000 + ord(c)) for c in "abcdefgh")).alias("t"))
    return p.select("p_partkey", keymaps.unlift_symbols(F.col("t")).alias("text"), X.guarded_number(F.concat(F.lit("("), F.col("p_partkey").cast("string"), F.lit(")")), F.lit("x"), True).alias("number"))


SYMBOL_REMAP = "SELECT p_partkey, p_name AS text, translate('(' || p_partkey || ')', '0123456789', '०१२३४५६७८९') AS number FROM part"


def tied_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-142: only what two tied maps read alike is decoded."""
    base = dict(zip(KEYS, KEYMAPS["first"], strict=True))
    other = base | {"a": "ख", "q": "ङ"}
    rules = [[("char", k, v) for k, v in m.items()] for m in (base, other)]
    return documents(spark, sf_dir).select("doc_id", F.md5(F.encode(keymaps.decode_tied(F.col("text"), rules), "UTF-8")).alias("text_md5"))


_UNSURE = {"a", "q"}
_K2 = "".join(k for k in KEYS if k not in _UNSURE)
_V2 = "".join(v for k, v in zip(KEYS, KEYMAPS["first"], strict=True) if k not in _UNSURE)
TIED_MAPS = f"SELECT doc_id, md5(translate(coalesce(text, ''), '{_K2}', '{_V2}')) AS text_md5 FROM documents"


def number_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-149: the second occurrence of a merged number taken apart."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 90 + 10).cast("string").alias("n"))
    line = F.concat("n", F.lit(" a "), F.lit("1"), "n", F.lit(" b "), "n", F.lit(" c"))
    return o.select("o_orderkey", X.apply_number_split(line, F.col("n"), F.array(F.left("n", F.lit(1)), F.right("n", F.lit(1))), F.lit(1)).alias("line"))


NUMBER_SPLITS = "WITH o AS (SELECT o_orderkey, (o_orderkey % 90 + 10)::VARCHAR AS n FROM orders) SELECT o_orderkey, n || ' a 1' || n || ' b ' || left(n, 1) || ' | ' || right(n, 1) || ' c' AS line FROM o"


def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-145, OP-198: the first short line that is no date, cut at its first stop."""
    f = fragments(spark, sf_dir).filter((F.char_length("text") <= 120) & ~X.is_date_line(F.col("text")))
    first = f.groupBy("doc_id").agg(F.min_by("text", "ord").alias("t"))
    d = documents(spark, sf_dir).select("doc_id").join(first, "doc_id", "left")
    return d.select("doc_id", F.coalesce(F.regexp_extract("t", r"^[^\x{964}!?.]*", 0), F.lit("Untitled")).alias("title"))


TITLE_LINES = f"""WITH {FRAGMENTS}, t AS (SELECT doc_id, arg_min(text, line) AS t FROM frag WHERE length(text) <= 120 AND NOT regexp_matches(text, '(मिति|मिमि){P.SPACE}*:') GROUP BY doc_id)
SELECT doc_id, coalesce(regexp_extract(t, '^[^\\x{{964}}!?.]*'), 'Untitled') AS title FROM documents LEFT JOIN t USING (doc_id)"""


def junit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-11: precedence of test outcomes."""
    e = table(spark, sf_dir, "events").select("event_type", *[F.when(F.col("event_id") % n == 0, F.lit("x")).alias(c) for n, c in ((7, "failure"), (5, "error"), (3, "skipped"))])
    return e.groupBy(files.junit_outcome(F.col("failure"), F.col("error"), F.col("skipped")).alias("outcome"), "event_type").agg(F.count("*").alias("cases"))


JUNIT_OUTCOMES = "SELECT CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'skipped' ELSE 'passed' END AS outcome, event_type, count(*) AS cases FROM events GROUP BY ALL"


def minimal_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-115, OP-193 (no SQL form: a bounded search per run)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%.2f", F.col("l_extendedprice")).alias("t"))
    runs = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))), lambda s: s["t"]).alias("segments"))
    return runs.select("l_orderkey", numeric.minimal_partition("segments", F.transform("segments", lambda s: F.lit(False))).alias("cuts"))


QUERIES = {f.__name__: f for f in (cells_in_region, cells_outside_regions, insertion_indexes, pivot_grid, render_rows, markdown_tables, record_groups, cell_texts, header_labels, usage_totals, attempt_statuses, backend_availability, json_records, http_urls, corpus_listing, size_settings, degraded_stamps, press_lines, pipe_lines, span_decoding, continued_tables, column_samples, plausible_numbers, normalized_dates, median_advance, edge_stab, partition_evidence, unique_partition, dedupe_last, mode_first, nearest_mark, signature_votes, outline_map, run_outcomes, outcome_tally, outcome_pivot, missing_runs, summary_markdown, catalog_filter, usage_delta, output_names, page_ranges, page_selection, devanagari_reorder, symbol_remap, tied_maps, number_splits, title_lines, junit_outcomes, minimal_partitions)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
__all__ = ["ORACLES", "QUERIES", "d_collapse", "d_strip"]
