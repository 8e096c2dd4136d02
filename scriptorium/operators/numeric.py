"""Merged numbers taken apart by geometry: rules between digits, unusual advances.

Characters have doc_id, page, block, line, span, idx, c, origin_x, x0, y0, x1, y1, font
and size.  Searches over partitions of a run are bounded (12 segments) and run per line
in Arrow batches; everything else is joins, windows and aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

LINE = ("doc_id", "page", "block", "line")
DIGIT = r"^[0-9\x{966}-\x{96F}]$"
MOST_SEGMENTS, RULE_HEIGHT, RULE_WIDTH, ADVANCE_OUTLIER, MIN_SAMPLES = 12, 4.0, 0.35, 0.10, 3
AMOUNT = r"^[0-9][0-9,]*\.[0-9]{1,2}$"


def vertical_edges(drawings: DataFrame) -> DataFrame:
    """(doc_id, page, x, y0, y1): both sides of tall rectangles, and upright lines."""
    top, bottom = F.least("y0", "y1"), F.greatest("y0", "y1")
    tall = bottom - top >= RULE_HEIGHT
    xs = F.when((F.col("kind") == "re") & tall, F.array("x0", "x1")).when((F.col("kind") == "l") & tall & (F.abs(F.col("x1") - F.col("x0")) <= RULE_WIDTH), F.array((F.col("x0") + F.col("x1")) / 2))
    return drawings.select("doc_id", "page", F.explode(xs).alias("x"), top.alias("y0"), bottom.alias("y1"))


def digit_pairs(chars: DataFrame) -> DataFrame:
    """Neighbouring digits of a line with what lies between them; ``idx`` is the right one's."""
    w = W.partitionBy(*LINE).orderBy("idx")
    nxt = {f"n_{c}": F.lead(c).over(w) for c in ("idx", "c", "origin_x", "y0", "y1")}
    pairs = chars.withColumns(nxt).filter(F.col("c").rlike(DIGIT) & F.col("n_c").rlike(DIGIT))
    return pairs.select(
        *LINE, F.col("n_idx").alias("idx"), "c", "font", "size", ((F.col("n_origin_x") - F.col("origin_x")) / F.col("size")).alias("advance"),
        (F.col("x1") - F.greatest(F.lit(0.75), F.col("size") * 0.08)).alias("left"), F.col("n_origin_x").alias("right"), ((F.greatest("y0", "n_y0") + F.least("y1", "n_y1")) / 2).alias("centre"),
    )


def rule_cuts(chars: DataFrame, edges: DataFrame) -> DataFrame:
    """Digit pairs with a ruled edge between them: an interval-stab semi join on the page."""
    between = F.expr("p.doc_id = e.doc_id AND p.page = e.page AND e.x BETWEEN p.left AND p.right AND p.centre BETWEEN e.y0 - 1 AND e.y1 + 1")
    return digit_pairs(chars).alias("p").join(edges.alias("e"), between, "left_semi").select(*LINE, "idx")


def expected_advances(pairs: DataFrame) -> DataFrame:
    """(font, size, c, advance, samples): medians by character and, with c null, by size alone, from three samples on."""
    usable = pairs.filter("size > 0 AND advance > 0 AND advance <= 2").select("font", F.round("size", 2).alias("size"), "c", "advance")
    font, size, c = F.col("font"), F.col("size"), F.col("c")
    medians = usable.groupingSets([[font, size, c], [font, size]], font, size, c).agg(F.median("advance").alias("advance"), F.count("*").alias("samples"))
    return medians.filter(F.col("samples") >= MIN_SAMPLES)


def advance_cuts(pairs: DataFrame, expected: DataFrame) -> DataFrame:
    """Pairs whose advance is too wide for their character (or, without samples, their size)."""
    sized = pairs.withColumn("_s", F.round("size", 2))
    own = expected.filter("c IS NOT NULL").select(F.col("font").alias("_f1"), F.col("size").alias("_s1"), F.col("c").alias("_c1"), F.col("advance").alias("_own"))
    any_ = expected.filter("c IS NULL").select(F.col("font").alias("_f2"), F.col("size").alias("_s2"), F.col("advance").alias("_any"))
    joined = sized.join(own, F.expr("font = _f1 AND _s = _s1 AND c = _c1"), "left").join(any_, F.expr("font = _f2 AND _s = _s2"), "left")
    return joined.filter(F.col("advance") - F.coalesce("_own", "_any") >= ADVANCE_OUTLIER).select(*LINE, "idx")


_PLAUSIBLE, _AMOUNT = re.compile(X.PLAUSIBLE), re.compile(AMOUNT)
#: what every beginning of a plausible number looks like
_OPEN = re.compile(r"^(?:[0-9,]*\.?[0-9]{0,2}|[0-9]{1,4}(?:\.[0-9]{1,4})*\.?)$")
_CANONICAL = str.maketrans(X.DEVANAGARI_DIGITS + X.DANDA, X.ASCII_DIGITS + ".")
_DIGITS, GAP = re.compile(f"[{X.ASCII_DIGITS}{X.DEVANAGARI_DIGITS}]+"), " \t|\0"


def least_partition(segments: Sequence[str], supported: Sequence[bool]) -> list[int] | None:
    """Where to cut between segments so that every part is a plausible number.

    Fewest cuts, then most supported by a rule (``supported[i]``: a rule before segment
    i+1); null if there is no such partition, it needs no cut, it is not unique, or there
    are more than 12 segments.
    """
    n = len(segments)
    if not 2 <= n <= MOST_SEGMENTS:
        return None
    plain = [s.translate(_CANONICAL) for s in segments]
    hopeless = set()  # starts of which no longer part is a number either
    # by end: parts, supported cuts (negative), ways to have as many of both, start of the last part
    best: list[tuple[int, int, int, int] | None] = [(0, 0, 1, 0), *[None] * n]
    for b in range(1, n + 1):
        for a in range(b):
            if a in hopeless or best[a] is None or b - a == n:
                continue
            cost, now = (best[a][0] + 1, best[a][1] - bool(a and supported[a - 1])), best[b]
            if now and cost > now[:2]:
                continue
            part = "".join(plain[a:b])
            if not _PLAUSIBLE.match(part):
                if not _OPEN.match(part):
                    hopeless.add(a)
                continue
            best[b] = (*cost, best[a][2] + (now[2] if now and cost == now[:2] else 0), a)
    if best[n] is None or best[n][2] > 1:
        return None
    cuts, at = [], best[n][3]
    while at:
        cuts.append(at)
        at = best[at][3]
    return cuts[::-1]


def bounds(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list starts and ends among the flattened values; a null one is empty."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return np.concatenate([[0], ends[:-1]]), ends


def least_partitions(segments: pa.ListArray, supported: pa.ListArray) -> list[list[int] | None]:
    """``least_partition`` of each row.

    Where no two neighbouring segments begin a number, every segment is a part; that is told for all rows at once.
    """
    values, (start, end) = segments.flatten(), bounds(segments)
    if not pc.all(pc.string_is_ascii(values)).as_py():
        values = pa.array([v and v.translate(_CANONICAL) for v in values.to_pylist()], pa.string())
    # a line end may follow, as Python's $ allows
    fits = lambda texts, pattern: pc.fill_null(pc.match_substring_regex(texts, pattern.pattern[:-1] + r"\n?\z"), False).to_numpy(zero_copy_only=False)
    alone, pairs = fits(values, _PLAUSIBLE), np.zeros(len(values), bool)
    if len(values) > 1:
        pairs[:-1] = fits(pc.binary_join_element_wise(values[:-1], values[1:], ""), _OPEN)
        pairs[end[end > start] - 1] = False
    held = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([start, end])], axis=0)[0].tolist()
    out = []
    for i, (a, b, wrong, opens) in enumerate(zip(start.tolist(), end.tolist(), held(~alone), held(pairs), strict=True)):
        if not 2 <= b - a <= MOST_SEGMENTS or (wrong and not opens):
            out.append(None)
        else:
            out.append(least_partition(values[a:b].to_pylist(), supported[i].as_py()) if opens else list(range(1, b - a)))
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def minimal_partition(segments: pa.Array, supported: pa.Array) -> pa.Array:
    """``least_partition`` over array columns."""
    return pa.array(least_partitions(segments, supported), pa.list_(pa.int32()))


def line_repairs(chars: DataFrame, cuts: DataFrame) -> DataFrame:
    """Repairs of each numeric run with cuts: merged text, parts, where it starts and which occurrence it is.

    A run whose parts are not all plausible numbers is left alone.
    """
    numeric = chars.withColumn("_num", F.col("c").rlike(r"^[0-9\x{966}-\x{96F},.]$"))
    w = W.partitionBy(*LINE).orderBy("idx")
    marked = numeric.join(cuts.select(*LINE, "idx", F.lit(True).alias("_cut")), [*LINE, "idx"], "left")
    marked = marked.withColumn("_new", (~F.col("_num").eqNullSafe(F.lag("_num").over(w))).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    line_text = chars.groupBy(*LINE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "c"))), lambda s: s["c"]), "").alias("line_text"))
    joined = runs.filter("_num").groupBy(*LINE, "_run").agg(
        F.min("idx").alias("start_index"), F.array_sort(F.collect_list(F.struct("idx", "c", F.coalesce("_cut", F.lit(False)).alias("cut")))).alias("_cs")
    )
    whole = F.array_join(F.transform("_cs", lambda s: s["c"]), "")
    split = F.array_join(F.transform("_cs", lambda s: F.concat(F.when(s["cut"] & (s["idx"] > F.col("start_index")), "\u0001").otherwise(""), s["c"])), "")
    cut_up = joined.withColumn("merged_text", whole).withColumn("parts", F.split(split, "\u0001")).filter(F.size("parts") > 1)
    good = cut_up.filter(F.forall("parts", X.is_plausible_number)).join(line_text, list(LINE))
    before = F.substring(F.col("line_text"), F.lit(1), F.col("start_index"))
    occurrence = F.expr("(char_length(_before) - char_length(replace(_before, merged_text, ''))) div char_length(merged_text)")
    return good.withColumn("_before", before).withColumn("occurrence_index", occurrence.cast("int")).select(*LINE, "start_index", "merged_text", "parts", "line_text", "occurrence_index")


def decimal_space_repairs(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """Two decimal amounts with white space between digits: (…, merged_text, parts)."""
    canon = X.canonical_number(F.col(text))
    pairs = F.regexp_extract_all(canon, F.lit(r"(?<![0-9,.])([0-9][0-9,]*\.[0-9]{1,2})\s+(?=[0-9])"), F.lit(1))
    nexts = F.regexp_extract_all(canon, F.lit(r"(?<![0-9,.])[0-9][0-9,]*\.[0-9]{1,2}\s+([0-9][0-9,]*\.[0-9]{1,2})(?![0-9,.])"), F.lit(1))
    made = lines.withColumn("_p", F.arrays_zip(pairs.alias("a"), nexts.alias("b"))).withColumn("_q", F.explode("_p"))
    parts = F.array(F.col("_q.a"), F.col("_q.b"))
    return made.filter("_q.a IS NOT NULL AND _q.b IS NOT NULL").select(*lines.columns, F.concat("_q.a", "_q.b").alias("merged_text"), parts.alias("parts"))


def canonical_parts(parts: Column) -> Column:
    return F.transform(parts, X.canonical_number)


def partition_evidence(repairs: DataFrame, within: Sequence[str] = ("doc_id",)) -> DataFrame:
    """How often each merged number was taken apart in each way, and in how many ways in all."""
    canon = repairs.select(*within, X.canonical_number(F.col("merged_text")).alias("merged"), canonical_parts(F.col("parts")).alias("parts"))
    counted = canon.groupBy(*within, "merged", "parts").agg(F.count("*").alias("evidence"))
    ways = counted.groupBy(*within, "merged").agg(F.count("*").alias("partitions"))
    return counted.join(ways, [*within, "merged"])


def unique_repairs(repairs: DataFrame, within: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Merged numbers that were taken apart in one way only, in their first spelling."""
    good = repairs.filter(F.forall("parts", X.is_plausible_number))
    keyed = good.withColumn("_m", X.canonical_number(F.col("merged_text"))).withColumn("_p", canonical_parts(F.col("parts")))
    one = keyed.groupBy(*within, "_m").agg(F.count_distinct("_p").alias("_n"), F.min_by(F.struct("merged_text", "parts"), "ord").alias("_r"))
    return one.filter("_n = 1").select(*within, "_r.merged_text", "_r.parts")


def last_repairs(repairs: DataFrame) -> DataFrame:
    """Of repairs alike in place and value, the last."""
    key = [*LINE, "start_index", "merged_text", "parts"]
    w = W.partitionBy(*key).orderBy(F.col("ord").desc())
    return repairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def by_line(repairs: DataFrame) -> DataFrame:
    return repairs.groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct("start_index", "merged_text", "parts", "occurrence_index"))).alias("repairs"))


def digit_signature(text: Column) -> Column:
    return F.regexp_replace(X.canonical_number(text), "[^0-9]", "")


def needs_geometry(docs: DataFrame, repairs: DataFrame) -> DataFrame:
    """Documents with a repair whose merged text reads as one number and occurs in their text."""
    misleading = repairs.filter(X.is_plausible_number(F.col("merged_text"))).select("doc_id", "merged_text")
    return docs.alias("d").join(misleading.alias("r"), F.expr("d.doc_id = r.doc_id AND contains(d.text, r.merged_text)"), "left_semi")


def repair_pipe_line(line: str, merged: str, parts: Sequence[str]) -> str:
    """Takes a number apart in a pipe line by its digits, whatever stands between them there; what ends the number may follow."""
    plain = merged.translate(_CANONICAL)
    digits = [c for c in plain if c in X.ASCII_DIGITS]
    if "|" not in line or len(digits) < 4:
        return line
    ending = plain[max(plain.rfind(d) for d in digits) + 1 :]
    point = X.DANDA if X.DANDA in line else "."
    # a match takes whole groups of digits, as no digit may stand on either side of it; nothing is compiled for a number
    groups = [(m.start(), m.end(), m.group()) for m in _DIGITS.finditer(line)]
    wanted, canonical = "".join(digits), [g.translate(_CANONICAL) for _, _, g in groups]
    out, at, i = [], 0, 0
    while i < len(groups):
        seen, k = canonical[i], i + 1
        while len(seen) < len(wanted) and wanted.startswith(seen) and k < len(groups) and not line[groups[k - 1][1] : groups[k][0]].strip(GAP):
            seen, k = seen + canonical[k], k + 1
        if seen != wanted:
            i += 1
            continue
        end = groups[k - 1][1]
        tail = end + len(ending)
        if line[end:tail].replace(X.DANDA, ".") == ending and not _DIGITS.match(line, tail):
            end = tail
        own = iter("".join(g for _, _, g in groups[i:k]))
        made = ["".join(next(own) if c.translate(_CANONICAL).isdigit() else point if c in ("." + X.DANDA) else c for c in part) for part in parts]
        out += [line[at : groups[i][0]], " | ".join(made)]
        at, i = end, k
    return "".join([*out, line[at:]])


@F.arrow_udf(T.StringType())
def repaired_pipe_lines(line: pa.Array, merged: pa.Array, parts: pa.Array) -> pa.Array:
    values, (start, end) = parts.flatten().to_pylist(), bounds(parts)
    rows = zip(line.to_pylist(), merged.to_pylist(), start.tolist(), end.tolist(), strict=True)
    return pa.array([None if t is None else repair_pipe_line(t, m, values[a:b]) for t, m, a, b in rows], pa.string())


# ---- glyph signatures -------------------------------------------------------------------


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two signatures, each an array of four longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def signature_longs(hexes: Column) -> Column:
    """64 hex digits as four longs."""
    part = lambda i: F.conv(F.substring(hexes, 16 * i + 1, 16), 16, -10).cast("long")
    return F.array(*map(part, range(4)))


def draws_reference_digits(signatures: DataFrame, reference: DataFrame, near: int = 25, enough: int = 7) -> DataFrame:
    """(font, verdict): whether at least 7 of a font's ten digits look like the reference's; null if fewer can be read.

    ``signatures`` (font, digit, signature or null) and ``reference`` (digit, signature): ten rows.
    """
    joined = signatures.join(reference.select("digit", F.col("signature").alias("_ref")), "digit")
    votes = joined.groupBy("font").agg(F.count("signature").alias("readable"), F.count_if(hamming(F.col("signature"), F.col("_ref")) <= near).alias("alike"))
    return votes.select("font", F.when(F.col("readable") >= enough, F.col("alike") >= enough).alias("verdict"))


MOST_MARKS = 1000


def nearest_mark(glyphs: DataFrame, marks: DataFrame, most: int = 350) -> DataFrame:
    """The mark whose feature vector is nearest by L1, the first of equals; farther than ``most``: none.  A row of ``glyphs`` gives at most one.

    ``marks`` (ord, mark, feature) are the handful of candidate vowel signs of a font: at most ``MOST_MARKS``.
    """
    if marks.limit(MOST_MARKS + 1).count() > MOST_MARKS:
        raise ValueError(f"more than {MOST_MARKS} marks")
    listed = marks.agg(F.collect_list(F.struct("ord", "mark", "feature")).alias("_marks"))  # one row of at most MOST_MARKS
    distance = lambda m: F.aggregate(F.zip_with("feature", m["feature"], lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, d: s + d)
    told = F.transform("_marks", lambda m: F.struct(distance(m).alias("distance"), m["ord"].alias("ord"), m["mark"].alias("mark")))
    best = glyphs.join(F.broadcast(listed), how="cross").withColumn("_b", F.array_min(told))
    return best.filter(F.col("_b.distance") <= most).select("glyph", "_b.mark", "_b.distance")


def modal_text(observations: DataFrame, key: str = "glyph") -> DataFrame:
    """The text seen most often for each glyph, the one seen first of equals."""
    counted = observations.groupBy(key, "text").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counted.groupBy(key).agg(F.max_by("text", F.struct("n", (-F.col("first")).alias("f"))).alias("text"))


def outline_map(outlines: DataFrame, dictionary: DataFrame, units: int = 2048) -> DataFrame:
    """Glyphs whose outline digest is known, of fonts with the reference's units: (font, glyph, text)."""
    digest = F.left(F.sha2("outline", 256), F.lit(16))
    return outlines.filter(F.col("units_per_em") == units).withColumn("digest", digest).join(dictionary, "digest").select("font", "glyph", "text")


def merged_maps(*columns: Column) -> Column:
    """Maps with precedence, the last wins (the session's map policy must be LAST_WIN)."""
    return F.map_concat(*columns)
