"""Page triage: coverage, text layers, OCR votes and font strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import patterns as P
from ..functions import text as X

# fixed values
DOMINANT, READABLE = 0.85, 10
STRATEGY_PRIORITY = {"correct": 0, "broken_cmap": 1, "legacy_remap": 2}


def image_coverage(pages: DataFrame, images: DataFrame) -> DataFrame:
    """``pages`` (doc_id, page, …) with image_count and max_image_coverage; 0 where a page has none."""
    share = F.col("width") * F.col("height") / F.greatest(F.col("page_width") * F.col("page_height"), F.lit(1.0))
    per_page = images.groupBy("doc_id", "page").agg(F.count("*").alias("image_count"), F.max(share).alias("max_image_coverage"))
    joined = pages.join(per_page, ["doc_id", "page"], "left")
    return joined.fillna({"image_count": 0, "max_image_coverage": 0.0})


def analyze_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds the text profile of each page and what follows from it; needs max_image_coverage."""
    t = F.coalesce(F.col(text), F.lit(""))
    counted = pages.withColumn("_c", M.token_counts(t))
    c = F.col("_c")
    profiled = counted.withColumns({
        "text_length": F.char_length(P.stripped(t)).cast("long"), "token_count": c["tokens"], "devanagari_char_count": P.characters(t, P.DEVANAGARI),
        "suspicious_latin_ratio": M.ratio(c["suspicious"], c["latin"]), "vowel_poor_latin_ratio": M.ratio(c["vowel_poor"], c["latin"]),
    })
    odd = M.suspicious_text_layer(F.col("devanagari_char_count"), F.col("token_count"), F.col("suspicious_latin_ratio"), F.col("vowel_poor_latin_ratio"))
    dominant = F.col("max_image_coverage") >= DOMINANT
    return profiled.drop("_c").withColumns({"is_image_dominant": dominant, "suspicious_text_layer": odd, "likely_needs_ocr": dominant & ((F.col("token_count") == 0) | odd)})


def ocr_vote(pages: DataFrame, flag: str = "likely_needs_ocr") -> DataFrame:
    """(doc_id, pages, flagged, needs_ocr): half of a document's pages, rounded up, must be flagged."""
    votes = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(flag).alias("flagged"))
    return votes.withColumn("needs_ocr", F.col("flagged") >= F.greatest(F.lit(1), F.floor((F.col("pages") + 1) / 2)))


def ocr_marker(coverage: Column, text: Column, fonts: Column, any_embedded: Column, devanagari: Column, garbled: Column) -> Column:
    """Why a page must be read by OCR (image_only, scanned_decoy_text), or null."""
    return (
        F.when(coverage < DOMINANT, F.lit(None)).when((P.stripped(text) == "") | (fonts == 0), F.lit("image_only"))
        .when(any_embedded, F.lit(None)).when(devanagari >= READABLE, F.lit(None)).when(garbled, F.lit("scanned_decoy_text"))
    )


def _priority(strategy: Column) -> Column:
    return F.coalesce(F.get(F.map_values(F.create_map(*[x for k, v in STRATEGY_PRIORITY.items() for x in (F.lit(k), F.lit(v))])), F.array_position(F.array(*map(F.lit, STRATEGY_PRIORITY)), strategy).cast("int") - 1), F.lit(-1))


def strategy_by_page(fonts: DataFrame) -> DataFrame:
    """The strategy of the font that needs most work on each page."""
    return fonts.groupBy("doc_id", "page").agg(F.max_by("strategy", _priority(F.col("strategy"))).alias("strategy"))


def strategy_by_font(fonts: DataFrame) -> DataFrame:
    """The first strategy seen of each base font of a document."""
    return fonts.groupBy("doc_id", X.base_font(F.col("font")).alias("base_font")).agg(F.min_by("strategy", "ord").alias("strategy"))


def font_texts(spans: DataFrame) -> DataFrame:
    """All text set in a font (full name) of a document, in reading order."""
    pieces = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return spans.groupBy("doc_id", "font").agg(F.array_join(F.transform(pieces, lambda s: s["text"]), "").alias("text"), F.count("*").alias("spans"))


def uses_repair_fonts(fonts: DataFrame) -> DataFrame:
    """Documents with at least one font that must be repaired."""
    return fonts.filter(F.col("strategy") != "correct").select("doc_id").distinct()


def judged_decodings(decodings: DataFrame, key: list[str], vocabulary: Sequence[str], attested: Sequence[str]) -> DataFrame:
    """(key, map_key, validity) of (key, map_key, decoded): pieces of a font's text are judged where they are, and the counts summed."""
    parts = decodings.withColumn("_v", M.validity_parts(F.col("decoded"), vocabulary, attested))
    return parts.groupBy(*key, "map_key").agg(M.validity(F.col("_v"), vocabulary, attested).alias("validity"))


def choose_maps(decodings: DataFrame, key: list[str]) -> DataFrame:
    """(key, map_key, tied): the keymap whose decoding ranks best, and all that tie with it; none passes the gate: no row.

    ``decodings`` has a ``validity`` struct and a map_key per candidate.
    """
    good = decodings.filter(M.passes_gate(F.col("validity"))).withColumn("_rank", F.rank().over(W.partitionBy(*key).orderBy(M.rank_key(F.col("validity")).desc())))
    return good.filter("_rank = 1").groupBy(*key).agg(F.min("map_key").alias("map_key"), F.array_sort(F.collect_set("map_key")).alias("tied"))


def choose_maps_with_margin(decodings: DataFrame, key: list[str], margin: int) -> DataFrame:
    """As ``choose_maps``, but candidates with many mixed letter-digit words only compete if the others abstain.

    ``decodings`` also has mixed_words; a candidate is eligible with fewer than ``margin`` more than the least.
    """
    if margin < 1:
        raise ValueError("the margin must be at least 1")
    least = F.min("mixed_words").over(W.partitionBy(*key))
    first = choose_maps(decodings.withColumn("_least", least).filter(F.col("mixed_words") < F.col("_least") + margin).drop("_least"), key)
    plain = choose_maps(decodings, key)
    return first.unionByName(plain.join(first.select(*key), key, "left_anti"))


def page_range(spec: Column, total: Column) -> Column:
    """Struct (first, last, error) of ``N`` or ``A-B``: 1-based, the end clamped, anything else an error."""
    a = F.regexp_extract(spec, r"^\s*([0-9]+)\s*(?:-\s*([0-9]+)\s*)?$", 1)
    b = F.regexp_extract(spec, r"^\s*([0-9]+)\s*(?:-\s*([0-9]+)\s*)?$", 2)
    first = a.try_cast("int")
    last = F.when(b == "", first).otherwise(b.try_cast("int"))
    error = (
        F.when(first.isNull() | last.isNull(), F.lit("malformed")).when(first < 1, F.lit("start below 1")).when(last < first, F.lit("end before start")).when(first > total, F.lit("start beyond end"))
    )
    return F.struct(F.when(error.isNull(), first).alias("first"), F.when(error.isNull(), F.least(last, total.cast("int"))).alias("last"), error.alias("error"))


def page_selection(df: DataFrame, spec: str, into: str = "page") -> DataFrame:
    """One row per page of ``"1-2,5"``, in the order written, repeats kept, nothing clamped."""
    part = F.posexplode(F.split(F.col(spec), r"\s*,\s*")).alias("_i", "_p")
    bounds = F.split(F.col("_p"), r"\s*-\s*")
    pages = F.sequence(F.get(bounds, F.lit(0)).cast("int"), F.element_at(bounds, -1).cast("int"))
    return df.select("*", part).select(*df.columns, "_i", F.posexplode(pages).alias("_j", into)).withColumn("selection_ord", F.row_number().over(W.partitionBy(*[c for c in df.columns]).orderBy("_i", "_j"))).drop("_i", "_j")
