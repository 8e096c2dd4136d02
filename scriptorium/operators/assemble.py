"""Spans, characters and lines put together: fragments, runs, joined line texts.

Order is data here: every input has an ``ord`` column, and nothing relies on the order
of partitions.  Everything is dealt by document and page.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import batches as B
from ..functions import patterns as P
from ..functions import text as X

JOIN_GAP, RUNS = 0.75, 1 << 16


def text_fragments(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain text as fragments with made-up geometry: one per line that is not blank; blank lines count."""
    at = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    line = F.col("line")
    made = at.select(
        "doc_id", line.cast("long").alias("ord"), F.lit(0).alias("page_number"), line.alias("block_number"), line.alias("line_number"), P.stripped(F.col("raw")).alias("text"),
        F.lit(0.0).alias("x0"), (line * 20.0).alias("y0"), F.lit(100.0).alias("x1"), (line * 20.0 + 15.0).alias("y1"), F.lit(None).cast("double").alias("gap_before"),
    )
    return made.filter("text != ''")


def joined_spans(spans: Column) -> Column:
    """Span texts in order of x; one space where a gap is wider than 0.75 and neither side has one."""
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("double").alias("x1"))
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], F.when(acc["x1"].isNotNull() & (s["x0"] - acc["x1"] > JOIN_GAP) & ~acc["out"].rlike("[ \t]$") & ~s["text"].rlike("^[ \t]"), " ").otherwise(""), s["text"]).alias("out"),
        s["x1"].alias("x1"),
    )
    return F.aggregate(spans, start, step, lambda acc: acc["out"])


def assemble_lines(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, page, block, line, ord, text, x0, y0, x1, y1) as line fragments.

    Lines are ordered by (y0 rounded to 2, x0); ``gap_before`` is the distance to the
    line above on the page, null at its top and after a line without text.
    """
    order = F.array_sort(F.collect_list(F.struct("x0", "ord", "text", "x1")))
    lines = spans.groupBy("doc_id", "page", "block", "line").agg(
        order.alias("s"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("ord").alias("ord")
    )
    lines = lines.withColumn("text", P.stripped(joined_spans(F.col("s")))).drop("s")
    w = W.partitionBy("doc_id", "page").orderBy(F.round("y0", 2), "x0", "ord")
    above = F.lag(F.when(F.col("text") != "", F.col("y1"))).over(w)
    return lines.withColumn("gap_before", F.col("y0") - above).withColumn("ord", F.row_number().over(w).cast("long")).filter("text != ''")


def runs(df: DataFrame, within: Sequence[str], order: Sequence[str], value: str, into: str = "run") -> DataFrame:
    """Numbers the maximal runs of equal ``value`` in each group (gap and island)."""
    w = W.partitionBy(*within).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)).cast("long")
    marked = df.withColumn("_changed", changed)
    return marked.withColumn(into, F.sum("_changed").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_changed")


def run_flags(df: DataFrame, within: Sequence[str], order: Sequence[str], value: str, text: str, veto: Column, into: str = "vetoed") -> DataFrame:
    """Judges each run of one font as a whole by its joined text and gives every member the verdict.

    ``veto`` is an expression over a column called ``run_text``.
    """
    numbered = runs(df, within, order, value, "_run")
    key = [*within, "_run"]
    joined = numbered.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda s: s["_t"]), "").alias("run_text"))
    return numbered.join(joined.select(*key, veto.alias(into)), key).drop("_run")


def unmappable_runs(chars: DataFrame, within: Sequence[str] = ("doc_id", "page", "block", "line", "span")) -> DataFrame:
    """Runs of undecodable characters in each span: (…, first, length)."""
    flagged = chars.withColumn("_bad", F.col("c") == "�")
    numbered = runs(flagged, within, ["idx"], "_bad").filter("_bad")
    return numbered.groupBy(*within, "run").agg(F.min("idx").alias("first"), F.count("*").alias("length")).drop("run")


def unmappable_runs_of_texts(texts: DataFrame, text: str, undecoded: str = "�") -> DataFrame:
    """As ``unmappable_runs`` for whole texts: (other columns, first, length), a text's characters never dealt out.

    ``undecoded`` are the characters that count.  Runs leave in batches of ``RUNS`` about, so memory is that of one text.
    """
    kept = [c for c in texts.columns if c != text]
    schema = T.StructType([texts.schema[c] for c in kept] + [T.StructField("first", T.LongType()), T.StructField("length", T.LongType())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, rows, first, length, held = batch.select(kept), [], [], [], 0

            def made() -> pa.RecordBatch:
                of = others.take(pa.array(np.concatenate(rows)))
                return pa.RecordBatch.from_arrays([*of.columns, pa.array(np.concatenate(first), pa.int64()), pa.array(np.concatenate(length), pa.int64())], [*kept, "first", "length"])

            for i, t in enumerate(batch.column(text)):
                at, n = B.runs_of(t.as_py() or "", undecoded)
                if len(at):
                    rows.append(np.full(len(at), i))
                    first.append(at)
                    length.append(n)
                    held += len(at)
                if held >= RUNS:
                    yield made()
                    rows, first, length, held = [], [], [], 0
            if held:
                yield made()

    return texts.select(*kept, text).mapInArrow(dealt, schema)


def decode_chain(text: Column, rules: Sequence[tuple[Column, Column]]) -> Column:
    """The first rule whose condition holds gives the text; else it stays as it is."""
    chain = text
    for condition, decoded in reversed(rules):
        chain = F.when(condition, decoded).otherwise(chain)
    return chain


def decode_span(
    text: Column, strategy: Column, companion: Column, content: Column, vetoed: Column, latin: Column,
    legacy: Column, symbols: Column, reorder: Column, private_use: str = r"[\x{F000}\x{F001}]",
) -> Column:
    """A span by the first rule for its font.

    Digit companions draw ASCII digits as Devanagari ones; a map found by content gives
    ``content`` (null: none) unless ``vetoed``, and leaves spans that read as Latin words;
    fonts of strategy legacy_remap give ``legacy`` (null: no map); symbol fonts give
    ``symbols`` (null: none); broken or marked text is reordered where ``reorder`` asks it.
    """
    found = content.isNotNull() & ~vetoed
    misplaced = reorder & ((strategy == "broken_cmap") | text.rlike(private_use))
    return decode_chain(text, [
        (companion, X.to_devanagari_digits(text)), (found & latin, text), (found, content),
        (strategy == "legacy_remap", F.coalesce(legacy, text)), (symbols.isNotNull(), symbols),
        (misplaced, X.fix_devanagari_spacing(X.reorder_devanagari(text))),
    ])


def visual_lines(fragments: Column, tolerance: float = 1.5) -> Column:
    """An array of fragments, by y, as an array of printed lines.

    A fragment belongs to a line if it overlaps the line's *first* member by more than
    half of the lower of both heights, so close lines do not chain.
    """
    kind = "array<array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>>"

    def shares(a: Column, f: Column) -> Column:
        overlap = F.least(a["y1"], f["y1"]) - F.greatest(a["y0"], f["y0"])
        shortest = F.least(a["y1"] - a["y0"], f["y1"] - f["y0"])
        return F.when(shortest <= 0, F.abs(a["y0"] - f["y0"]) <= tolerance).otherwise(overlap > shortest / 2)

    def step(acc: Column, f: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array_append(last, f)))
        return F.when((F.size(acc) > 0) & shares(F.get(last, F.lit(0)), f), grown).otherwise(F.array_append(acc, F.array(f)))

    return F.transform(F.aggregate(fragments, F.array().cast(kind), step), lambda line: F.array_sort(line))


def join_visual_line(line: Column, tolerance: float = 1.5) -> Column:
    """Texts of one printed line; the same text drawn again at the same origin is dropped."""
    kind = "array<struct<x0:double,y0:double,text:string>>"

    def step(acc: Column, f: Column) -> Column:
        text, last = P.collapsed(f["text"]), F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (last["text"] == text) & (F.abs(last["x0"] - f["x0"]) <= tolerance) & (F.abs(last["y0"] - f["y0"]) <= tolerance)
        return F.when((text == "") | same, acc).otherwise(F.array_append(acc, F.struct(f["x0"].alias("x0"), f["y0"].alias("y0"), text.alias("text"))))

    kept = F.aggregate(line, F.array().cast(kind), step)
    return F.array_join(F.transform(kept, lambda k: k["text"]), " ")


def cell_text(fragments: Column, tolerance: float = 1.5) -> Column:
    """The printed lines of a cell's fragments, one under the other.

    A line of one fragment that repeats a line of one fragment right above it is
    overprint and dropped; longer lines may repeat.  Blank fragments do not count.
    """
    by_place = F.transform(F.array_sort(F.transform(fragments, lambda f: F.struct(f["y0"].alias("y0"), f["x0"].alias("x0"), f.alias("f")))), lambda s: s["f"])
    lone = lambda line: F.size(F.filter(line, lambda f: P.stripped(f["text"]) != "")) == 1
    said = F.transform(visual_lines(by_place, tolerance), lambda line: F.struct(join_visual_line(line, tolerance).alias("text"), lone(line).alias("lone")))

    def step(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        repeats = (F.size(acc) > 0) & (last["text"] == line["text"]) & last["lone"] & line["lone"]
        return F.when((line["text"] == "") | repeats, acc).otherwise(F.array_append(acc, line))

    kept = F.aggregate(said, F.array().cast("array<struct<text:string,lone:boolean>>"), step)
    return F.array_join(F.transform(kept, lambda k: k["text"]), "\n")
