"""Measures of how well a transcript reads, as expressions over one text column.

What looks at every character is counted by batch (``batches``), so these do not go into lambdas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batches as B
from . import patterns as P

# fixed values: weights of the quality score
DEVANAGARI_CREDIT, SUSPICIOUS_COST, VOWEL_POOR_COST, PIPE_LINE_COST = 3, 8, 3, 4
CID_COST, UNDECODED_COST, SINGLE_COST, MATRA_COST = 12, 12, 6, 8
SPACE_SHARE = SINGLE_SHARE = 0.35
# fixed values: limits of the re-extraction and page tests
SUSPICIOUS_HIGH, SUSPICIOUS_LOW, VOWEL_POOR_HIGH, PIPES_MANY, SUSPICIOUS_PIPES = 0.12, 0.06, 0.45, 4, 0.05
LEAST_LATIN, LEAST_TOKENS, FEW_DEVANAGARI = 12, 12, 20


def token_counts(text: Column) -> Column:
    """Struct of counts of the tokens of a text: all, with Latin letters, of those suspicious and poor in vowels (at least
    four letters, less than a fifth of them Latin vowels), and besides lone pipes all and single characters."""
    return B.token_counts(text)


def pipe_heavy_lines(text: Column) -> Column:
    """Lines with at least two pipes between values, enclosing ones not counted."""
    return B.pipe_heavy_lines(text)


def excess(count: Column, of: Column, share: float) -> Column:
    """By how much a count is above the whole part of a share."""
    return F.greatest(F.lit(0).cast("long"), count - F.floor(of.cast("double") * F.lit(share)).cast("long"))


def quality_score(text: Column, counts: Column) -> Column:
    """How much of a transcript is readable, less what is damaged; page anchors must be stripped first."""
    held = B.text_counts(text)  # matra damage: doubled, orphaned and virama-preceded vowel signs
    return (
        held["devanagari"] * DEVANAGARI_CREDIT
        + counts["tokens"]
        - counts["suspicious"] * SUSPICIOUS_COST
        - counts["vowel_poor"] * VOWEL_POOR_COST
        - held["pipe_lines"] * PIPE_LINE_COST
        - held["cid"] * CID_COST
        - held["undecoded"] * UNDECODED_COST
        - excess(held["spaces"], held["chars"], SPACE_SHARE)
        - excess(counts["single"], counts["content"], SINGLE_SHARE) * SINGLE_COST
        - held["matra_damage"] * MATRA_COST
    )


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def needs_reextraction(text: Column, counts: Column) -> Column:
    """Whether a default transcript is too damaged to keep."""
    suspicious, poor = ratio(counts["suspicious"], counts["latin"]), ratio(counts["vowel_poor"], counts["latin"])
    return (
        F.when(P.stripped(text) == "", True)
        .when(P.occurrences(text, P.CID) >= 2, True)
        .when(counts["tokens"] == 0, True)
        .when(counts["latin"] < LEAST_LATIN, False)
        .otherwise(
            (suspicious >= SUSPICIOUS_HIGH)
            | ((suspicious >= SUSPICIOUS_LOW) & (poor >= VOWEL_POOR_HIGH))
            | ((pipe_heavy_lines(text) >= PIPES_MANY) & (suspicious >= SUSPICIOUS_PIPES))
        )
    )


def suspicious_text_layer(devanagari: Column, tokens: Column, suspicious: Column, vowel_poor: Column) -> Column:
    """A page whose text layer is likely a decoy: little Devanagari, many odd Latin tokens."""
    odd = (suspicious >= SUSPICIOUS_HIGH) | ((suspicious >= SUSPICIOUS_LOW) & (vowel_poor >= VOWEL_POOR_HIGH))
    return (devanagari < FEW_DEVANAGARI) & (tokens >= LEAST_TOKENS) & odd


def wellformedness(text: Column) -> Column:
    """Struct of defect counts of Devanagari; every defect is 0 in clean text.

    A mark is stranded if no consonant or vowel with only marks and joiners between
    stands to its left.
    """
    return B.wellformedness(text)


def orphaned_matra_ratio(quality: Column) -> Column:
    return ratio(quality["stranded_matras"], quality["matras"])


def text_signals(text: Column) -> Column:
    """Struct of the signals that the corpus harness records of a transcript."""
    q = B.signals(text)
    share = lambda n: F.when(q["letters"] > 0, F.round(n / q["letters"], 4))
    return F.struct(
        q["chars"].alias("chars"), q["letters"].alias("letters"), q["devanagari"].alias("devanagari"), share(q["devanagari"]).alias("deva_frac"), share(q["latin"]).alias("latin_frac"),
        *[q[c].alias(c) for c in ("replacement", "pua", "control", "cid_garbage", "malformed", "stranded", "stranded_matras")], q["doubled"].alias("doubled_matras"), q["matras"].alias("matras"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("sha256"),
    )


# ---- the penalty used when transcripts of one line compete -------------------------------

# fixed values: weights of the penalty
REPLACEMENT_COST = PRIVATE_COST = 12
INVALID_SIGN_COST = ARTIFACT_COST = 8
PREFIX_IKAR_COST = IKAR_MATRA_COST = IKAR_NASAL_COST = 6
HALANT_IKAR_COST, DOUBLET_COST = 4, 3
INVALID_SIGNS = r"\x{94A}\x{929}\x{931}\x{934}"
PREFIX_IKAR = rf"(?:^|(?<=[{P.SPACES}(]))\x{{93F}}(?=[\x{{915}}-\x{{939}}])"
IKAR_MATRA = r"\x{93F}(?=[\x{93E}-\x{944}\x{947}\x{948}\x{94B}\x{94C}])"
IKAR_NASAL = r"(?<![\x{915}-\x{939}\x{93C}\x{94D}])\x{93F}(?=[\x{901}-\x{903}])"
HALANT_IKAR = r"\x{94D}\x{93F}"
DOUBLET = r"([\x{915}-\x{939}])\1"
#: spellings that wrong maps leave behind
ARTIFACTS = "ख्ज|अधध|धिरूद्ध|धिरुद्ध|प्रविधध|राविय|नम्िर|िडा|ितन|उज्वल|उज्जवल"
# fixed values: words that have a doubled consonant inside, and suffixes that make one where they follow a stem
DOUBLED_LEXEMES = (
    "व्यय", "कक्षा", "अध्ययन", "तत्काल", "ललितपुर", "ससुरा", "बबरमहल", "उत्खनन", "जज", "ननाघे", "तत्सम", "सम्ममा", "ससर्त", "छैनन्", "तहहरु", "कार्ययोजना",
)
STEM_SUFFIXES = ("को", "मा", "ता", "ताको", "ताले", "तामा", "सँग", "सङ्ग", "हरु", "हरू", "रेट", "योजना")


def _held(text: Column, lexemes: Sequence[str] = DOUBLED_LEXEMES, suffixes: Sequence[str] = STEM_SUFFIXES) -> Column:
    return B.penalty(tuple(ARTIFACTS.split("|")), tuple(lexemes), tuple(suffixes))(text)


def explained_doublets(text: Column, lexemes: Sequence[str] = DOUBLED_LEXEMES, suffixes: Sequence[str] = STEM_SUFFIXES) -> Column:
    """Doubled consonants that morphology explains, by word.

    A doublet is explained inside a listed lexeme, or where its second half opens a
    listed suffix after a stem of at least two characters.
    """
    return _held(text, lexemes, suffixes)["explained"]


def unexplained_doublets(text: Column) -> Column:
    return doublets(text) - explained_doublets(text)


def has_severe_noise(text: Column) -> Column:
    """Whether a line holds any sign that only damage leaves."""
    found = text.rlike(rf"[\x{{FFFD}}{P.PRIVATE_USE}{INVALID_SIGNS}]")
    for p in (PREFIX_IKAR, IKAR_MATRA, IKAR_NASAL, HALANT_IKAR):
        found = found | text.rlike(p)
    return found


def charged(held, unexplained_doublets):  # noqa: ANN001, ANN201
    """The penalty of what ``batches.penalty`` counts: a column's struct, or arrays by name."""
    return (
        held["replacement"] * REPLACEMENT_COST
        + held["private"] * PRIVATE_COST
        + held["invalid"] * INVALID_SIGN_COST
        + held["prefix_ikar"] * PREFIX_IKAR_COST
        + held["ikar_matra"] * IKAR_MATRA_COST
        + held["ikar_nasal"] * IKAR_NASAL_COST
        + held["halant_ikar"] * HALANT_IKAR_COST
        + unexplained_doublets * DOUBLET_COST
        + held["artifacts"] * ARTIFACT_COST
    )


def text_penalty(text: Column, unexplained_doublets: Column) -> Column:
    return charged(_held(text), unexplained_doublets)


def doublets(text: Column) -> Column:
    return _held(text)["doublets"]


def validity_parts(text: Column, vocabulary: Sequence[str], attested: Sequence[str], unexplained: Column | None = None) -> Column:
    """Struct of what ``validity`` takes of each piece of a font's text; pieces end at line ends."""
    held = B.validity(tuple(vocabulary), tuple(attested), tuple(ARTIFACTS.split("|")), DOUBLED_LEXEMES, STEM_SUFFIXES)(text)
    doubled = held["doublets"] - held["explained"] if unexplained is None else unexplained
    return F.struct(*[held[c].alias(c) for c in ("hits", "devanagari", "solid", "ikar_nasal", "stranded", "attested")], charged(held, doubled).alias("whole"), doubled.alias("doubled"))


def validity(parts: Column, vocabulary: Sequence[str], attested: Sequence[str]) -> Column:
    """Aggregate over ``validity_parts``: a struct of the axes on which decodings of one font compete.

    ``vocabulary`` words count as substrings, ``attested`` ones as distinct whole tokens
    (dandas stripped).  The penalty per Devanagari character takes the whole penalty; the
    ranking penalty forgives one doublet.  Everything is a sum or a maximum, so a font's
    text is never gathered in one place.
    """
    total = lambda c: F.coalesce(F.sum(parts[c]), F.lit(0)).cast("long")

    def any_of(name: str, words: Sequence[str]) -> Column:
        count = F.lit(0)
        for i in range(len(words)):
            count = count + F.coalesce(F.max(F.get(parts[name], F.lit(i))), F.lit(False)).cast("int")
        return count.cast("long")

    return F.struct(
        any_of("hits", vocabulary).alias("hits"),
        total("devanagari").alias("devanagari"),
        ratio(total("devanagari"), total("solid")).alias("ratio"),
        (total("whole") - F.least(total("doubled"), F.lit(1)) * DOUBLET_COST).alias("penalty"),
        ratio(total("whole"), total("devanagari")).alias("penalty_per_deva"),
        total("ikar_nasal").alias("ikar_nasal"),
        total("stranded").alias("stranded"),
        any_of("attested", attested).alias("attested"),
    )


# fixed values: the accept gate
GATE_HITS, GATE_DEVANAGARI, GATE_RATIO, GATE_PENALTY = 2, 8, 0.6, 0.05


def passes_gate(v: Column) -> Column:
    return (v["hits"] >= GATE_HITS) & (v["devanagari"] >= GATE_DEVANAGARI) & (v["ratio"] >= GATE_RATIO) & (v["penalty_per_deva"] <= GATE_PENALTY)


def rank_key(v: Column) -> Column:
    """Higher wins: a struct compared field by field."""
    zero = F.lit(0).cast("long")
    return F.struct(
        v["hits"].alias("hits"), (-F.greatest(v["penalty"] - 6, zero)).alias("penalty_over"), (-F.greatest(v["stranded"] - 1, zero)).alias("stranded_over"),
        v["attested"].alias("attested"), (-v["penalty"]).alias("penalty"), v["ratio"].alias("ratio"), v["devanagari"].alias("devanagari"),
    )


def digit_dominant(text: Column) -> Column:
    """At least 40 characters that are not space, few letters, half of them digits."""
    solid = F.char_length(F.regexp_replace(text, F.lit(P.SPACE), F.lit("")))
    return (solid >= 40) & (P.characters(text, "A-Za-z") <= 0.05 * solid) & (P.characters(text, "0-9") >= 0.5 * solid)


def garbled_orphan(text: Column) -> Column:
    """A repaired-only line not worth keeping: blank, or invalid marks that its Devanagari does not outweigh."""
    bad = P.characters(text, rf"\x{{FFFD}}{P.PRIVATE_USE}{INVALID_SIGNS}")
    deva = P.characters(text, P.DEVANAGARI)
    return (P.stripped(text) == "") | ((bad > 0) & ((deva == 0) | (bad >= 2) | (bad.cast("double") / deva >= 0.08)))
