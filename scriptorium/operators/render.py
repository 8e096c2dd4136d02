"""Blocks to Markdown: page anchors, furniture, paragraphs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as X


def with_page_anchors(parts: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, markdown): parts (key, ord, page, text) under one anchor per page of ``pages`` (key, page).

    A part goes under the first anchor not before its page nor above a part before it;
    parts beyond the last anchor come after it; every page has its anchor, also an empty
    one; a document without pages is its parts joined.
    """
    w = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    reached = parts.withColumn("_page", F.max("page").over(w))
    numbers = pages.groupBy(key).agg(F.array_sort(F.collect_set("page")).alias("_pages"))
    placed = reached.join(numbers, key, "left").withColumn("_at", F.coalesce(F.array_min(F.filter("_pages", lambda p: p >= F.col("_page"))), F.lit(2**31 - 1)))
    texts = placed.filter("text != ''").select(key, "_at", F.lit(1).alias("_k"), F.col("ord").cast("long").alias("_o"), F.col("text").alias("_t"))
    anchors = pages.distinct().select(key, F.col("page").alias("_at"), F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_o"), X.page_anchor(F.col("page")).alias("_t"))
    chunks = F.array_sort(F.collect_list(F.struct("_at", "_k", "_o", "_t")))
    joined = texts.unionByName(anchors).groupBy(key).agg(P.stripped(F.array_join(F.transform(chunks, lambda c: c["_t"]), "\n\n")).alias("markdown"))
    return joined


def furniture_beside_tables(blocks: DataFrame, header: str, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks (key, ord, kind, text) without page furniture next to a table."""
    w = W.partitionBy(*key).orderBy("ord")
    beside = (F.coalesce(F.lag("kind").over(w), F.lit("")) == "table") | (F.coalesce(F.lead("kind").over(w), F.lit("")) == "table")
    return blocks.withColumn("_beside", beside).filter(~((F.col("kind") == "paragraph") & F.col("_beside") & X.is_page_furniture(F.col("text"), header))).drop("_beside")


def wrapped_headers(lines: DataFrame, header: str, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Lines without a running header, also where it is wrapped over two or three of them (the shortest such run)."""
    tight = "".join(header.split())
    w = W.partitionBy(*key).orderBy("ord")
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), F.lit(P.SPACE), F.lit(""))
    cols = {f"_l{i}": bare(F.lead("text", i).over(w)) for i in range(3)}
    wide = lines.withColumns(cols)
    hit = lambda *cs: F.contains(F.concat(*cs), F.lit(tight))
    run = F.when(hit("_l0"), 1).when(hit("_l0", "_l1") & ~hit("_l1"), 2).when(hit("_l0", "_l1", "_l2") & ~hit("_l1", "_l2"), 3).otherwise(0)
    starts = wide.withColumn("_run", run)
    inside = (F.col("_run") > 0) | (F.coalesce(F.lag("_run", 1).over(w), F.lit(0)) >= 2) | (F.coalesce(F.lag("_run", 2).over(w), F.lit(0)) >= 3)
    return starts.withColumn("_in", inside).filter("NOT _in").select(*lines.columns)


def blocks_markdown(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraph blocks rendered with hard breaks and joined by blank lines, tables as they are."""
    text = F.when(F.col("kind") == "table", F.col("text")).otherwise(X.render_paragraph(F.col("text")))
    rendered = blocks.withColumn("_t", text).filter("_t != ''")
    return rendered.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_t"))), lambda s: s["_t"]), "\n\n").alias("markdown"))


def _named(rows: pd.DataFrame) -> pd.DataFrame:
    """One family of stems in order: each takes the first name that is free."""
    taken, following, out = set(rows["name"].dropna()), {}, []
    for stem in rows[rows["name"].isna()].sort_values("_order")["stem"]:
        n = following.get(stem, 1)
        while (name := stem if n == 1 else f"{stem}-{n}") in taken:
            n += 1
        following[stem] = n
        taken.add(name)
        out.append(name)
    given = rows[rows["name"].isna()].sort_values("_order")
    return given.assign(name=out)[["directory", "_order", "name"]]


def output_names(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Files (directory, stem, ord, …) with ``name``: the stem, with -2, -3, … until it is free in its directory.

    ``existing`` (directory, name) are names already there.  An empty stem is "document".
    ``ord`` is unique in a directory.  Only stems alike but for numbers at their end can
    want one name: such a family with one stem is numbered as a window, and one with
    several (or with names already there) in one pass over it.
    """
    family = lambda c: F.regexp_replace(c, r"(?:-[0-9]+)+$", "")
    rows = files.select("directory", F.when(F.col("stem") == "", "document").otherwise(F.col("stem")).alias("stem"), F.col("ord").alias("_order"), F.lit(None).cast("string").alias("name"))
    there = rows.limit(0) if existing is None else existing.select("directory", F.col("name").alias("stem"), F.lit(None).cast(rows.schema["_order"].dataType).alias("_order"), "name")
    every = rows.unionByName(there).withColumn("_family", family(F.col("stem")))
    kinds = every.groupBy("directory", "_family").agg((F.min("stem") == F.max("stem")).alias("_one"), F.count("name").alias("_there"))
    told = every.join(kinds, ["directory", "_family"])
    alone = told.filter("_one AND _there = 0")
    n = F.row_number().over(W.partitionBy("directory", "stem").orderBy("_order"))
    numbered = alone.withColumn("name", F.when(n == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", n.cast("string")))).select("directory", "_order", "name")
    schema = T.StructType([rows.schema["directory"], rows.schema["_order"], T.StructField("name", T.StringType())])
    met = told.filter("NOT (_one AND _there = 0)").select("directory", "stem", "_order", "name", "_family").groupBy("directory", "_family").applyInPandas(_named, schema)
    return files.join(numbered.unionByName(met).withColumnRenamed("_order", "ord"), ["directory", "ord"])
