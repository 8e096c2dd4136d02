"""Character maps of fonts as rows: parsing, building, patching, ligature closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .lineage import checkpointed

RA_VIRAMA, VIRAMA_RA, IKAR = "र्", "्र", "ि"
REPHA_MARK, IKAR_MARK = "", ""


def _text(hexes: Column) -> Column:
    return F.decode(F.unhex(hexes), "UTF-16BE")


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _at_least_four(hexes: Column) -> Column:
    """Padded with zeros to four digits; longer ones, of glyph ids above FFFF, stay whole (``lpad`` cuts)."""
    return F.lpad(hexes, F.greatest(F.char_length(hexes), F.lit(4)), "0")


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("int")


def parse_cmaps(df: DataFrame, cmap: str, key: list[str]) -> DataFrame:
    """(key, gid, text) of ToUnicode streams: single characters, ranges, and ranges with lists; the last of equals wins."""
    blocks = lambda kind: F.array_join(F.regexp_extract_all(cmap, F.lit(rf"(?s)begin{kind}\s*(.*?)\s*end{kind}"), F.lit(1)), "\n")
    h = "<([0-9A-Fa-f]+)>"
    single = rf"{h}\s*{h}"
    listed = rf"(?s){h}\s*{h}\s*\[(.*?)\]"
    spans = rf"{h}\s*{h}\s*{h}"
    group = lambda text, pattern, i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    chars, ranges = blocks("bfchar"), blocks("bfrange")
    bare = F.regexp_replace(ranges, rf"(?s){h}\s*{h}\s*\[.*?\]", "")
    one = F.transform(F.arrays_zip(group(chars, single, 1).alias("g"), group(chars, single, 2).alias("u")), lambda p: F.struct(_number(p["g"]).alias("gid"), _text(p["u"]).alias("text")))
    many = F.flatten(F.transform(
        F.arrays_zip(group(ranges, listed, 1).alias("a"), group(ranges, listed, 2).alias("b"), group(ranges, listed, 3).alias("l")),
        lambda p: F.filter(F.transform(F.regexp_extract_all(p["l"], F.lit(h), F.lit(1)), lambda u, i: F.when(_number(p["a"]) + i <= _number(p["b"]), F.struct((_number(p["a"]) + i).alias("gid"), _text(u).alias("text")))), lambda x: x.isNotNull()),
    ))
    runs = F.filter(F.arrays_zip(group(bare, spans, 1).alias("a"), group(bare, spans, 2).alias("b"), group(bare, spans, 3).alias("u")), lambda p: F.char_length(p["u"]) <= 4)
    ranged = F.flatten(F.transform(runs, lambda p: F.transform(F.sequence(_number(p["a"]), F.greatest(_number(p["a"]), _number(p["b"]))), lambda g: F.struct(g.alias("gid"), _code_point(_number(p["u"]) + g - _number(p["a"])).alias("text")))))
    entries = df.select(*key, F.posexplode(F.concat(one, many, ranged)).alias("_ord", "_e"))
    last = entries.groupBy(*key, F.col("_e.gid").alias("gid")).agg(F.max_by("_e.text", "_ord").alias("text"))
    return last.filter("text != ''")


def build_cmaps(entries: DataFrame, key: list[str]) -> DataFrame:
    """(key, cmap): the entries as the single-character part of a stream, a hundred to a block."""
    line = F.format_string("<%s> <%s>", _at_least_four(F.hex("gid")), F.hex(F.encode("text", "UTF-16BE")))
    ordered = entries.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("gid", line.alias("line")))), lambda s: s["line"]).alias("_l"))
    starts = F.sequence(F.lit(0), (F.ceil(F.size("_l") / 100) - 1).cast("int"))
    part = lambda i: F.slice("_l", i * 100 + 1, F.lit(100))
    block = F.transform(starts, lambda i: F.concat(F.size(part(i)).cast("string"), F.lit(" beginbfchar\n"), F.array_join(part(i), "\n"), F.lit("\nendbfchar")))
    return ordered.select(*key, F.array_join(block, "\n").alias("cmap"))


def inverts_rakar(old: Column, new: Column) -> Column:
    """Whether a correction would turn one virama-ra of a map into ra-virama, all else equal."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(old) - 1, F.lit(1)))
    swapped = lambda i: F.concat(F.substring(old, F.lit(1), i - 1), F.lit(RA_VIRAMA), F.substring(old, i + 2, F.char_length(old)))
    return F.exists(places, lambda i: (F.substring(old, i, F.lit(2)) == VIRAMA_RA) & (new == swapped(i)))


def patched(old: Column, right: Column) -> Column:
    """The value a map should have: the correction, with markers where it draws out of order; ``old`` is null for new glyphs."""
    matra = F.left(old, F.lit(1)).rlike(r"^[\x{93E}-\x{94C}\x{962}\x{963}]") & (F.left(old, F.lit(1)) != IKAR)
    return (
        F.when(right.isNull() | (old == right) | F.coalesce(inverts_rakar(old, right), F.lit(False)), old).when(right == RA_VIRAMA, REPHA_MARK)
        .when((right == IKAR) & ~old.eqNullSafe(F.lit(IKAR)), IKAR_MARK)
        .when((F.char_length(right) >= 2) & right.endswith(RA_VIRAMA) & F.coalesce(matra, F.lit(False)), F.concat(F.left(old, F.lit(1)), F.lit(REPHA_MARK))).otherwise(right)
    )


def patch_maps(pdf: DataFrame, corrections: DataFrame, key: list[str]) -> DataFrame:
    """Full outer merge of a font's own map with its corrections: (key, gid, text, corrected)."""
    by = [*key, "gid"]
    joined = pdf.withColumnRenamed("text", "_old").join(corrections.withColumnRenamed("text", "_right"), by, "full_outer")
    return joined.select(*by, patched(F.col("_old"), F.col("_right")).alias("text"), (~patched(F.col("_old"), F.col("_right")).eqNullSafe(F.col("_old"))).alias("corrected"))


def meaningful_differences(pdf: DataFrame, corrections: DataFrame, key: list[str]) -> DataFrame:
    """(key, differences): values that a correction changes and that have to do with Devanagari."""
    joined = pdf.withColumnRenamed("text", "_old").join(corrections.withColumnRenamed("text", "_right"), [*key, "gid"])
    script = rf"[{P.DEVANAGARI}\x{{F000}}\x{{F001}}]"
    differs = (F.col("_old") != F.col("_right")) & ~inverts_rakar(F.col("_old"), F.col("_right")) & (F.col("_old").rlike(script) | F.col("_right").rlike(script))
    return joined.groupBy(*key).agg(F.count_if(differs).alias("differences"))


def ligature_closure(known: DataFrame, rules: DataFrame, key: str = "font") -> DataFrame:
    """(font, glyph, text): texts of ligatures whose components are known, until nothing new follows.

    ``known`` (font, glyph, text); ``rules`` (font, rule, glyph, components).  A pass joins
    components to texts; a ligature is resolved once all of its components are.
    """
    parts = rules.select(key, "rule", F.col("glyph").alias("_lig"), F.size("components").alias("_n"), F.posexplode("components").alias("_i", "glyph"))
    current, size = known.select(key, "glyph", "text"), -1
    while True:  # each pass but the last adds a glyph, so there are at most as many as rules, and one
        found = parts.join(current, [key, "glyph"]).groupBy(key, "rule", "_lig", "_n").agg(F.array_sort(F.collect_list(F.struct("_i", "text"))).alias("_t"))
        made = found.filter(F.size("_t") == F.col("_n")).select(key, "rule", F.col("_lig").alias("glyph"), F.array_join(F.transform("_t", lambda s: s["text"]), "").alias("text"))
        first = made.groupBy(key, "glyph").agg(F.min_by("text", "rule").alias("text")).join(current, [key, "glyph"], "left_anti")
        both = current.unionByName(first)
        current = checkpointed(both)
        now = current.count()
        if now == size:
            break
        size = now
    return current


def apply_map(glyphs: DataFrame, cmap: DataFrame, key: list[str]) -> DataFrame:
    """Glyph ids with the text their font's map gives them, null where it gives none."""
    return glyphs.join(cmap, [*key, "gid"], "left")
