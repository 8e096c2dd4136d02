"""Queries over whole documents: profiles, scores, signals, decodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import batches as B, keymaps, metrics as M, patterns as P, text as X
from ..operators import measure, pages, select
from .common import KEYMAPS, KEYS, VOCABULARY, d_chars, d_collapse, d_count, d_strip, d_tokens, documents, table

# ---- token profile, quality score, re-extraction ------------------------------------------


def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-55."""
    d = documents(spark, sf_dir).withColumn("c", M.token_counts(F.col("text")))
    return d.select("doc_id", F.col("c.tokens").alias("tokens"), P.characters(F.col("text"), P.DEVANAGARI).alias("devanagari"), M.ratio(F.col("c.suspicious"), F.col("c.latin")).alias("suspicious_ratio"), M.ratio(F.col("c.vowel_poor"), F.col("c.latin")).alias("vowel_poor_ratio"))


def _d_counts(source: str) -> str:
    """CTE counted(*, tok…): token counts of a relation with a text column."""
    poor = f"{d_chars('t', chr(92) + 'pL')} >= 4 AND {d_chars('t', 'aeiouAEIOU')} * 5 < {d_chars('t', chr(92) + 'pL')}"
    sus = r"regexp_matches(t, '[\\\[\]{}$^&*_+=<>]|[A-Za-z][0-9]|[0-9][A-Za-z]')"
    return f"""
toks AS (SELECT *, {d_tokens('text')} AS toks FROM {source}),
lat AS (SELECT *, list_filter(toks, lambda t: regexp_matches(t, '[A-Za-z]')) AS lat FROM toks),
counted AS (SELECT * EXCLUDE (toks, lat), len(toks) AS tokens, len(lat) AS latin, len(list_filter(lat, lambda t: {sus})) AS suspicious,
  len(list_filter(lat, lambda t: {poor})) AS vowel_poor, len(list_filter(toks, lambda t: t <> '|')) AS content, len(list_filter(toks, lambda t: length(t) = 1 AND t <> '|')) AS single FROM lat)"""


_DOCS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"

TOKEN_PROFILE = f"""WITH {_d_counts(_DOCS)}
SELECT doc_id, tokens, {d_chars('text', P.DEVANAGARI)} AS devanagari, {_ratio('suspicious', 'latin')} AS suspicious_ratio, {_ratio('vowel_poor', 'latin')} AS vowel_poor_ratio FROM counted"""

_LINES = r"string_split_regex(regexp_replace(text, '(\r\n|[\n\r\x{B}\x{C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\x{B}\x{C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]')"
_PIPES = f"len(list_filter({_LINES}, lambda l: {d_chars('''regexp_replace(''' + d_strip('l') + r''', '^\|+|\|+$', '', 'g')''', '|')} >= 2))"
_MATRA = f"({d_count('text', '[' + P.SCORE_MATRAS + ']{2,}')} + {d_chars('text', P.SCORE_MATRAS)} - {d_count('text', '[' + P.MATRA_BASES + '][' + P.SCORE_MATRAS + ']')} + {d_count('text', chr(92) + 'x{94D}[' + P.SCORE_MATRAS + ']')})"
_SCORE = f"""(3 * {d_chars('text', P.DEVANAGARI)} + tokens - 8 * suspicious - 3 * vowel_poor - 4 * {_PIPES} - 12 * {d_count('text', P.CID)} - 12 * {d_chars('text', chr(92) + 'x{FFFD}' + chr(92) + 'x{0}')}
 - greatest(0, {d_chars('text', P.SPACES)} - floor(length(text)::DOUBLE * 0.35::DOUBLE)::BIGINT) - 6 * greatest(0, single - floor(content::DOUBLE * 0.35::DOUBLE)::BIGINT) - 8 * {_MATRA})"""


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-61."""
    d = documents(spark, sf_dir).withColumn("c", M.token_counts(F.col("text")))
    return d.select("doc_id", M.quality_score(F.col("text"), F.col("c")).alias("score"), M.pipe_heavy_lines(F.col("text")).alias("pipe_lines"))


QUALITY_SCORE = f"WITH {_d_counts(_DOCS)} SELECT doc_id, {_SCORE} AS score, {_PIPES} AS pipe_lines FROM counted"


def needs_reextraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-185."""
    d = documents(spark, sf_dir).withColumn("c", M.token_counts(F.col("text")))
    return d.select("doc_id", M.needs_reextraction(F.col("text"), F.col("c")).alias("needs"))


NEEDS_REEXTRACTION = f"""WITH {_d_counts(_DOCS)}, r AS (SELECT *, {_ratio('suspicious', 'latin')} AS s, {_ratio('vowel_poor', 'latin')} AS v, {_PIPES} AS p, {d_count('text', P.CID)} AS cid FROM counted)
SELECT doc_id, CASE WHEN {d_strip('text')} = '' THEN true WHEN cid >= 2 THEN true WHEN tokens = 0 THEN true WHEN latin < 12 THEN false ELSE s >= 0.12 OR (s >= 0.06 AND v >= 0.45) OR (p >= 4 AND s >= 0.05) END AS needs FROM r"""

# ---- best candidate -----------------------------------------------------------------------

_DEC = KEYMAPS["first"]
_FIRST = dict(zip(KEYS, _DEC, strict=True))
_NUMERIC_TOKEN = r"(^|[\x{9}-\x{D}\x{20}])[0-9]+(\.[0-9]{1,2})?($|[\x{9}-\x{D}\x{20}])"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three transcripts of each document: as it is, decoded by a keymap, white space normalised."""
    d = documents(spark, sf_dir)
    texts = F.array(F.col("text"), keymaps.substituted(F.col("text"), _FIRST), B.collapsed(F.col("text")))
    c = d.select("doc_id", F.posexplode(texts).alias("ord", "text"))
    return c.withColumn("safe", ~F.col("text").rlike(_NUMERIC_TOKEN))


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship, OP-110 over OP-61, OP-120, OP-130 and OP-137."""
    return select.best_candidate(select.scored_candidates(candidates(spark, sf_dir))).withColumn("chosen", F.col("chosen").cast("long"))


BEST_CANDIDATE = f"""WITH cand AS (
  SELECT doc_id, 0 AS ord, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT doc_id, 1, translate(coalesce(text, ''), '{KEYS}', '{_DEC}') FROM documents
  UNION ALL SELECT doc_id, 2, {d_collapse("coalesce(text, '')")} FROM documents),
{_d_counts("(SELECT doc_id, ord, regexp_replace(text, '<!-- page: ([0-9]+) -->" + chr(92) + "n*', '', 'g') AS text, NOT regexp_matches(text, '" + _NUMERIC_TOKEN + "') AS safe FROM cand)")},
scored AS (SELECT doc_id, ord, safe, {_SCORE} AS score FROM counted)
SELECT doc_id, arg_max(ord, row(safe, score, -ord))::BIGINT AS chosen, arg_max(score, row(safe, score, -ord)) AS score FROM scored GROUP BY doc_id"""

# ---- signals, decoding, well-formedness ---------------------------------------------------


def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-69, OP-154."""
    return documents(spark, sf_dir).select("doc_id", M.text_signals(F.col("text")).alias("s")).select("doc_id", "s.*")


def _d_wellformed(text: str) -> dict[str, str]:
    marks = P.MATRAS + P.SIGNS
    rest = f"regexp_replace({text}, '[{P.CONSONANTS}{P.INDEPENDENT_VOWELS}][{marks}{P.JOINERS}]*', '', 'g')"
    out = {"stranded": d_chars(rest, marks), "stranded_matras": d_chars(rest, P.MATRAS), "word_initial": d_count(text, f"(?:^|{P.SPACE})[{marks}]"), "matras": d_chars(text, P.MATRAS), "marks": d_chars(text, marks)}
    out["doubled"] = f"({out['matras']} - {d_count(text, '[' + P.MATRAS + ']+')})"
    out["halant_matra"] = d_count(text, rf"\x{{94D}}[{P.MATRAS}]")
    out["malformed"] = f"({out['stranded']} + {out['doubled']} + {out['halant_matra']})"
    return out


def _signals_sql(source: str) -> str:
    w = _d_wellformed("text")
    letters = "(length(text) - length(regexp_replace(text, '\\pL', '', 'g')))"
    deva = "len(list_filter(regexp_extract_all(text, '[\\x{900}-\\x{97F}]'), lambda c: regexp_matches(c, '\\pL')))"
    return f"""SELECT *, length(text) AS chars, {letters} AS letters, {deva} AS devanagari, {d_chars('text', chr(92) + 'x{FFFD}')} AS replacement, {d_chars('text', chr(92) + 'x{E000}-' + chr(92) + 'x{F8FF}')} AS pua,
  {d_chars('text', r'\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}')} AS control, {d_count('text', chr(92) + '(cid:')} AS cid_garbage, {w['malformed']} AS malformed, {w['stranded']} AS stranded,
  {w['stranded_matras']} AS stranded_matras, {w['doubled']} AS doubled_matras, {w['matras']} AS matras, sha256(text) AS sha256 FROM {source}"""


_LOW = "regexp_replace(text, '[^\\x{0}-\\x{24F}]', '', 'g')"
_LATIN = f"(length({_LOW}) - length(regexp_replace({_LOW}, '\\pL', '', 'g')))"
TEXT_SIGNALS = f"""SELECT * EXCLUDE (text, latin), CASE WHEN letters > 0 THEN round(devanagari::DOUBLE / letters, 4) END AS deva_frac, CASE WHEN letters > 0 THEN round(latin::DOUBLE / letters, 4) END AS latin_frac
FROM (SELECT *, {_LATIN} AS latin FROM ({_signals_sql(_DOCS)}))"""


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("text", keymaps.substituted(F.col("text"), _FIRST))


_D_DECODED = f"(SELECT doc_id, translate(coalesce(text, ''), '{KEYS}', '{_DEC}') AS text FROM documents)"


def legacy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-137: a keymap applied word by word, which for one-to-one maps is a translation."""
    rules = [("char", k, v) for k, v in zip(KEYS, _DEC, strict=True)]
    d = documents(spark, sf_dir)
    text = keymaps.decode(F.col("text"), rules)
    return d.select("doc_id", F.sha2(F.encode(text, "UTF-8"), 256).alias("decoded_sha256"), P.characters(text, P.DEVANAGARI).alias("devanagari"))


LEGACY_DECODE = f"SELECT doc_id, sha256(text) AS decoded_sha256, {d_chars('text', P.DEVANAGARI)} AS devanagari FROM {_D_DECODED}"


def derived_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-138: a keyboard rotation composed with a base map."""
    rules = keymaps.rotated([("char", k, v) for k, v in zip(KEYS, _DEC, strict=True)], KEYS, KEYS[3:] + KEYS[:3])
    table_ = {p: r for _, p, r in rules}
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.encode(keymaps.substituted(F.col("text"), table_), "UTF-8"), 256).alias("decoded_sha256"))


DERIVED_MAP = f"SELECT doc_id, sha256(translate(translate(coalesce(text, ''), '{KEYS}', '{KEYS[3:] + KEYS[:3]}'), '{KEYS}', '{_DEC}')) AS decoded_sha256 FROM documents"


def deva_wellformedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-68."""
    d = _decoded(spark, sf_dir).withColumn("q", M.wellformedness(F.col("text")))
    return d.select("doc_id", "q.*", M.orphaned_matra_ratio(F.col("q")).alias("orphaned_ratio"))


_W = _d_wellformed("text")
DEVA_WELLFORMEDNESS = f"SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in _W.items())}, {_ratio(_W['stranded_matras'], _W['matras'])} AS orphaned_ratio FROM {_D_DECODED}"

_CONS = [chr(c) for c in range(0x915, 0x93A)]


def _d_penalty(text: str) -> dict[str, str]:
    """Lookarounds as closed forms: pairs are counted with what stands before or after consumed."""
    after = r"[\x{93E}-\x{944}\x{947}\x{948}\x{94B}\x{94C}]"
    # an i-matra may itself follow one, so pairs overlap: count those that nothing of the class follows, and take them off
    ikar_matra = rf"({d_chars(text, chr(92) + 'x{93F}')} - len(regexp_extract_all({text}, '\x{{93F}}([^{after[1:-1]}]|$)')))"
    nasal = rf"(len(regexp_extract_all({text}, '\x{{93F}}[\x{{901}}-\x{{903}}]')) - len(regexp_extract_all({text}, '[\x{{915}}-\x{{939}}\x{{93C}}\x{{94D}}]\x{{93F}}[\x{{901}}-\x{{903}}]')))"
    prefix = rf"(len(regexp_extract_all({text}, '(^|[{P.SPACES}(])\x{{93F}}[\x{{915}}-\x{{939}}]')))"
    doublet = d_count(text, "|".join(c * 2 for c in _CONS))
    return {
        "replacement": d_chars(text, r"\x{FFFD}"), "private": d_chars(text, r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}"), "invalid": d_chars(text, r"\x{94A}\x{929}\x{931}\x{934}"),
        "prefix": prefix, "ikar_matra": ikar_matra, "nasal": nasal, "halant": d_count(text, r"\x{94D}\x{93F}"), "doublets": doublet, "artifacts": d_count(text, M.ARTIFACTS),
    }


def _d_penalty_sum(p: dict[str, str]) -> str:
    weights = {"replacement": 12, "private": 12, "invalid": 8, "prefix": 6, "ikar_matra": 6, "nasal": 6, "halant": 4, "doublets": 3, "artifacts": 8}
    return "(" + " + ".join(f"{w} * {p[k]}" for k, w in weights.items()) + ")"


def text_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-63, OP-64 (raw doublets)."""
    d = _decoded(spark, sf_dir)
    return d.select("doc_id", M.doublets(F.col("text")).alias("doublets"), M.text_penalty(F.col("text"), M.doublets(F.col("text"))).alias("penalty"), M.unexplained_doublets(F.col("text")).alias("unexplained"))


_P = _d_penalty("text")
# words with doublets, cut between their halves: an end is explained inside a listed word or where a suffix follows a stem
_D_DOUBLET = "|".join(f"{c}{c}" for c in _CONS)
_D_INSIDE = " OR ".join(f"(e >= {i + 1} AND substr(w, e - {i}, {len(x)}) = '{x}')" for x in M.DOUBLED_LEXEMES for i in range(len(x) - 1) if x[i] == x[i + 1])
_D_OPENS = " OR ".join(f"starts_with(substr(w, e + 1), '{s}')" for s in M.STEM_SUFFIXES)
_D_MARKED = "w"
for _c in _CONS:
    _D_MARKED = f"replace({_D_MARKED}, '{_c}{_c}', '{_c}' || chr(1) || '{_c}')"
_D_UNEXPLAINED = f"""unexplained AS (SELECT doc_id, count(*) FILTER (NOT (({_D_INSIDE}) OR (e >= 2 AND ({_D_OPENS})))) AS n FROM
 (SELECT doc_id, w, length(array_to_string(p[1:k], '')) AS e FROM (SELECT doc_id, w, string_split({_D_MARKED}, chr(1)) AS p FROM
  (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[{P.DEVANAGARI}]+'), lambda x: regexp_matches(x, '{_D_DOUBLET}'))) AS w FROM {_D_DECODED})), LATERAL (SELECT unnest(range(1, len(p))) AS k)) GROUP BY doc_id)"""
TEXT_PENALTY = f"WITH {_D_UNEXPLAINED} SELECT d.doc_id, {_P['doublets']} AS doublets, {_d_penalty_sum(_P)} AS penalty, coalesce(n, 0) AS unexplained FROM {_D_DECODED} d LEFT JOIN unexplained USING (doc_id)"


def _font_decodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each source (as a font) under three keymaps, judged font by font."""
    spans = documents(spark, sf_dir, "source").select(F.col("source").alias("font"), F.concat("text", F.lit("\n")).alias("text"))
    maps = F.array(*[F.struct(F.lit(k).alias("map_key"), keymaps.substituted(F.col("text"), dict(zip(KEYS, v, strict=True))).alias("decoded")) for k, v in KEYMAPS.items()])
    return pages.judged_decodings(spans.select("font", F.inline(maps)), ["font"], VOCABULARY, VOCABULARY)


def map_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-65, OP-66, OP-67, OP-51."""
    d = _font_decodings(spark, sf_dir)
    return d.select("font", "map_key", "validity.*", M.passes_gate(F.col("validity")).alias("passes"))


# per text and keymap, then summed by font; doublets are taken as unexplained where the decoded words have no listed one
_SOLID = d_count("text", r"[^\pZ\x{9}-\x{D}]")
_D_STRANDED = f"(length(text) - length(regexp_replace(regexp_replace(text, '([{P.LETTER_GAP}])[()\\[\\]{{}}]([{P.LETTER_GAP}])', '\\1\\2', 'g'), '([{P.LETTER_GAP}])[()\\[\\]{{}}]([{P.LETTER_GAP}])', '\\1\\2', 'g')))"
_D_MAPPED = f"(SELECT row_number() OVER () AS doc_id, font, map_key, text FROM ({' UNION ALL '.join(f"SELECT source AS font, '{k}' AS map_key, translate(coalesce(text, ''), '{KEYS}', '{v}') || chr(10) AS text FROM documents" for k, v in KEYMAPS.items())}))"
_D_VALID = f"""dec AS MATERIALIZED {_D_MAPPED}, {_D_UNEXPLAINED.replace(_D_DECODED, 'dec')},
parts AS (SELECT dec.*, coalesce(n, 0) AS doubled, {_d_penalty_sum(_P | {'doublets': 'coalesce(n, 0)'})} AS whole, {d_chars('text', P.DEVANAGARI)} AS deva, {_SOLID} AS solid, {_P['nasal']} AS nasal, {_D_STRANDED} AS stranded,
 list_transform({d_tokens('text')}, lambda t: regexp_replace(t, '^[\\x{{964}}\\x{{965}}]+|[\\x{{964}}\\x{{965}}]+$', '', 'g')) AS bare FROM dec LEFT JOIN unexplained USING (doc_id)),
valid AS (SELECT font, map_key, {' + '.join(f"max(contains(text, '{w}')::INTEGER)" for w in VOCABULARY)} AS hits, sum(deva)::BIGINT AS devanagari, sum(whole)::BIGINT AS whole, least(sum(doubled), 1)::BIGINT * 3 AS forgiven, sum(nasal)::BIGINT AS ikar_nasal, sum(stranded)::BIGINT AS stranded,
 {_ratio('sum(deva)', 'sum(solid)')} AS ratio, {' + '.join(f"max(list_contains(bare, '{w}')::INTEGER)" for w in VOCABULARY)} AS attested FROM parts GROUP BY font, map_key),
full_valid AS (SELECT *, whole - forgiven AS penalty, {_ratio('whole', 'devanagari')} AS penalty_per_deva, (hits >= 2 AND devanagari >= 8 AND ratio >= 0.6 AND {_ratio('whole', 'devanagari')} <= 0.05) AS passes FROM valid)"""
MAP_VALIDITY = f"WITH {_D_VALID} SELECT font, map_key, hits::BIGINT AS hits, devanagari, ratio, penalty, penalty_per_deva, ikar_nasal, stranded, attested::BIGINT AS attested, passes FROM full_valid"


def choose_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-111: the best by the lexicographic key behind the accept gate; ties are kept."""
    # typed letters read as Devanagari carry far more damage than the gate lets through, so a font's penalty is scaled here
    d = _font_decodings(spark, sf_dir)
    v = F.col("validity")
    eased = d.withColumn("validity", v.withField("penalty_per_deva", v["penalty_per_deva"] / 20))
    return pages.choose_maps(eased, ["font"]).select("font", "map_key", F.size("tied").cast("long").alias("tied"))


CHOOSE_MAP = f"""WITH {_D_VALID}, ranked AS (SELECT font, map_key, rank() OVER (PARTITION BY font ORDER BY hits DESC, -greatest(penalty - 6, 0) DESC, -greatest(stranded - 1, 0) DESC, attested DESC, -penalty DESC, ratio DESC, devanagari DESC) AS r FROM full_valid
 WHERE hits >= 2 AND devanagari >= 8 AND ratio >= 0.6 AND penalty_per_deva / 20 <= 0.05)
SELECT font, min(map_key) AS map_key, count(*) AS tied FROM ranked WHERE r = 1 GROUP BY font"""


def latin_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-27, OP-36."""
    d = documents(spark, sf_dir)
    t = F.col("text")
    return d.select("doc_id", X.is_legacy_ascii(t).alias("legacy_ascii"), X.reads_as_latin_words(t, ["the", "of", "and", "de", "la", "der", "und"]).alias("latin_words"), X.reads_as_latin_structure(t, F.lit(0)).alias("latin_structure"))


_WORDS2 = "list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 2)"
_TIGHT = f"regexp_replace(text, '{P.SPACE}', '', 'g')"
LATIN_VETO = f"""WITH d AS (SELECT doc_id, text, {_WORDS2} AS w, {_TIGHT} AS solid FROM {_DOCS})
SELECT doc_id, (length(text) >= 8 AND {d_chars('text', P.DEVANAGARI)} = 0 AND {d_chars('text', chr(92) + 'x{20}-' + chr(92) + 'x{7E}')} >= 0.8 * length(text)) AS legacy_ascii,
 (len(w) > 0 AND len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'de', 'la', 'der', 'und'))) * 10 >= len(w)) AS latin_words,
 (length(solid) >= 16 AND NOT regexp_matches(solid, '[\\\\\\[\\]{{}}|~^_@#$%*+=<>]') AND {d_chars('solid', 'A-Za-z')} >= 0.88 * length(solid) AND {d_chars('solid', 'aeiouAEIOU')} >= 0.30 * {d_chars('solid', 'A-Za-z')} AND NOT regexp_matches(text, '[a-z][A-Z]')) AS latin_structure FROM d"""


def acronym_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-37, OP-82, OP-121: acronyms of each document that also survive in another one of its source."""
    d = documents(spark, sf_dir, "source").select("doc_id", "source", X.acronym_tokens(F.col("text")).alias("a"))
    each = d.select("doc_id", "source", F.explode("a").alias("acronym"))
    per = each.groupBy("source", "acronym").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))
    return per


_BARE = f"list_distinct(list_filter(list_transform({d_tokens('text')}, lambda t: regexp_replace(t, '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g')), lambda t: regexp_matches(t, '^[A-Z0-9]{{2,5}}$') AND {d_chars('t', 'A-Z')} >= 2))"
ACRONYM_SURVIVORS = f"""WITH e AS (SELECT doc_id, source, unnest({_BARE}) AS acronym FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents))
SELECT source, acronym, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM e GROUP BY source, acronym"""

# ---- regression diff -----------------------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs of the harness over documents: raw, and decoded or normalised; each misses some files and fails on some."""
    d = documents(spark, sf_dir)
    after_text = F.when(F.col("doc_id") % 3 == 0, keymaps.substituted(F.col("text"), _FIRST)).when(F.col("doc_id") % 3 == 1, B.collapsed(F.col("text"))).otherwise(F.col("text"))

    def run(df: DataFrame, text: F.Column, fails: int, wall: float) -> DataFrame:
        s = df.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), F.when(F.col("doc_id") % fails == 5, "error").otherwise("ok").alias("status"), M.text_signals(text).alias("s"), (F.col("doc_id") % 100 * wall).alias("wall_s"))
        return s.select("file", "status", "s.*", "wall_s")

    return run(d.filter("doc_id % 11 != 0"), keymaps.substituted(F.col("text"), _FIRST), 17, 0.5), run(d.filter("doc_id % 13 != 0"), after_text, 19, 0.25)


def regression_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-46, OP-163."""
    return measure.diff(*_runs(spark, sf_dir)).select("file", "verdict")


def _d_run(where: str, text: str, fails: int, wall: float) -> str:
    inner = f"(SELECT doc_id, 'doc-' || doc_id AS file, CASE WHEN doc_id % {fails} = 5 THEN 'error' ELSE 'ok' END AS status, {text} AS text, (doc_id % 100) * {wall}::DOUBLE AS wall_s FROM {_DOCS} WHERE {where})"
    return f"SELECT *, CASE WHEN letters > 0 THEN devanagari::DOUBLE / letters END AS frac FROM ({_signals_sql(inner)})"


_AFTER = f"CASE WHEN doc_id % 3 = 0 THEN translate(text, '{KEYS}', '{_DEC}') WHEN doc_id % 3 = 1 THEN {d_collapse('text')} ELSE text END"
_DIFF = f"""WITH b AS ({_d_run('doc_id % 11 <> 0', f"translate(text, '{KEYS}', '{_DEC}')", 17, 0.5)}), a AS ({_d_run('doc_id % 13 <> 0', _AFTER, 19, 0.25)}),
diff AS (SELECT coalesce(b.file, a.file) AS file, b.wall_s AS before_s, a.wall_s AS after_s, CASE WHEN a.file IS NULL THEN 'missing' WHEN b.file IS NULL THEN 'new-file'
 WHEN b.status = 'ok' AND a.status <> 'ok' THEN 'newly-failing' WHEN b.status <> 'ok' AND a.status = 'ok' THEN 'newly-passing' WHEN b.status <> 'ok' THEN 'same' WHEN b.sha256 = a.sha256 THEN 'same'
 WHEN coalesce(round(b.frac, 4) >= 0.3 AND round(a.frac, 4) < round(b.frac, 4) * 0.5, false) THEN 'worse' WHEN b.devanagari > 100 AND a.devanagari < b.devanagari * 0.9 THEN 'worse'
 WHEN a.malformed > b.malformed OR a.replacement + a.cid_garbage > b.replacement + b.cid_garbage THEN 'worse' WHEN a.malformed < b.malformed OR a.devanagari > b.devanagari THEN 'better' ELSE 'changed' END AS verdict
 FROM b FULL OUTER JOIN a ON a.file = b.file)"""
REGRESSION_DIFF = f"{_DIFF} SELECT file, verdict FROM diff"


def regression_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-79."""
    return measure.summary(measure.diff(*_runs(spark, sf_dir)))


REGRESSION_COUNTS = f"{_DIFF} SELECT verdict, count(*) AS files FROM diff GROUP BY verdict"


def regression_wall_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-79: seconds over files in both runs."""
    return measure.wall_time(measure.diff(*_runs(spark, sf_dir)))


REGRESSION_WALL_TIME = f"{_DIFF} SELECT sum(before_s) AS before_s, sum(after_s) AS after_s, (sum(after_s) - sum(before_s)) * 100 / sum(before_s) AS delta_pct FROM diff WHERE verdict NOT IN ('missing', 'new-file')"


def digit_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-70, OP-32: over documents and over the digits of their letters (a..j as 0..9)."""
    d = documents(spark, sf_dir)
    coded = F.translate("text", "abcdefghijABCDEFGHIJ", "0123456789" * 2)
    return d.select("doc_id", M.digit_dominant(F.regexp_replace(coded, "[A-Za-z]", "")).alias("dominant"), M.garbled_orphan(F.translate("text", "e", "�")).alias("garbled"))


_CODED = "regexp_replace(translate(text, 'abcdefghijABCDEFGHIJ', '01234567890123456789'), '[A-Za-z]', '', 'g')"
_BAD = d_chars("translate(text, 'e', chr(65533))", r"\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{94A}\x{929}\x{931}\x{934}")
DIGIT_DOMINANCE = f"""WITH d AS (SELECT doc_id, text, {_CODED} AS c FROM {_DOCS}), s AS (SELECT *, length(regexp_replace(c, '{P.SPACE}', '', 'g')) AS n FROM d)
SELECT doc_id, (n >= 40 AND {d_chars('c', '0-9')} >= 0.5 * n) AS dominant, ({d_strip('text')} = '' OR {_BAD} > 0) AS garbled FROM s"""

QUERIES = {f.__name__: f for f in (token_profile, quality_score, needs_reextraction, best_candidate, text_signals, legacy_decode, derived_map, deva_wellformedness, text_penalty, map_validity, choose_map, latin_veto, acronym_survivors, regression_diff, regression_counts, regression_wall_time, digit_dominance)}
ORACLES = {
    "token_profile": TOKEN_PROFILE, "quality_score": QUALITY_SCORE, "needs_reextraction": NEEDS_REEXTRACTION, "best_candidate": BEST_CANDIDATE, "text_signals": TEXT_SIGNALS, "legacy_decode": LEGACY_DECODE, "derived_map": DERIVED_MAP,
    "deva_wellformedness": DEVA_WELLFORMEDNESS, "text_penalty": TEXT_PENALTY, "map_validity": MAP_VALIDITY, "choose_map": CHOOSE_MAP, "latin_veto": LATIN_VETO, "acronym_survivors": ACRONYM_SURVIVORS,
    "regression_diff": REGRESSION_DIFF, "regression_counts": REGRESSION_COUNTS, "regression_wall_time": REGRESSION_WALL_TIME, "digit_dominance": DIGIT_DOMINANCE,
}
__all__ = ["ORACLES", "QUERIES", "pages"]
