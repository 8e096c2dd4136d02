"""Closed forms against plain folds, and the calibration of the metrics."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import keymaps, metrics as M, patterns as P, text as X

CONSONANT = {*range(0x915, 0x93A), *range(0x958, 0x960), *range(0x978, 0x980)}
VOWEL = {*range(0x904, 0x915), *range(0x972, 0x978)}
MATRA = {0x93A, 0x93B, *range(0x93E, 0x94D), 0x94E, 0x94F, 0x955, 0x956, 0x957, 0x962, 0x963}
SIGN = {0x900, 0x901, 0x902, 0x903, 0x93C, 0x94D}


def fold(text):
    """Stranded marks and their kin, one character at a time."""
    out = dict.fromkeys(("stranded", "stranded_matras", "word_initial", "doubled", "halant_matra", "matras", "marks"), 0)
    based, prev = False, ""
    for c in text:
        m, s = ord(c) in MATRA, ord(c) in SIGN
        out["matras"] += m
        if m or s:
            out["marks"] += 1
            if not based:
                out["stranded"] += 1
                out["stranded_matras"] += m
                out["word_initial"] += not prev or prev.isspace()
            out["doubled"] += m and bool(prev) and ord(prev) in MATRA
            out["halant_matra"] += m and prev == "्"
        elif ord(c) in CONSONANT | VOWEL:
            based = True
        elif c not in "‌‍":
            based = False
        prev = c
    return out | {"malformed": out["stranded"] + out["doubled"] + out["halant_matra"]}


def column(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r[0] for r in df.select("i", expression(F.col("text")).alias("v")).orderBy("i").select("v").collect()]


def test_wellformedness_equals_fold(spark):
    rng = random.Random(3)
    alphabet = "कखगरआइिाी्ं़‍ ab\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert [r.asDict() for r in column(spark, texts, M.wellformedness)] == [fold(t) for t in texts]


def reorder_fold(text):
    chars, i = list(text), 0
    cons = lambda c: "क" <= c <= "ह"
    while i < len(chars):
        if chars[i] == "":
            if i + 1 < len(chars) and cons(chars[i + 1]):
                e = i + 1
                while e + 2 < len(chars) and chars[e + 1] == "्" and cons(chars[e + 2]):
                    e += 2
                chars.pop(i)
                chars.insert(e, "ि")
                continue
            chars[i] = "ि"
        i += 1
    i = 0
    while i < len(chars):
        if chars[i] == "":
            k = i - 1
            while k >= 0 and ("ा" <= chars[k] <= "ौ" or chars[k] in "ॢॣँंः्"):
                k -= 1
            while k >= 2 and cons(chars[k]) and chars[k - 1] == "्" and cons(chars[k - 2]):
                k -= 2
            if k >= 0 and cons(chars[k]):
                chars.pop(i)
                chars[k:k] = ["र", "्"]
            else:
                chars[i : i + 1] = ["र", "्"]
            i += 2
        else:
            i += 1
    return "".join(chars)


def test_reordering_equals_fold_for_one_repha(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("कखर््ाी a") for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts = [t for t in texts if t.count("") <= 1]
    assert column(spark, texts, X.reorder_devanagari) == [reorder_fold(t) for t in texts]


def test_profile_of_empty_and_odd_texts(spark):
    def profile(t):
        return M.token_counts(t)

    got = [tuple(r) for r in column(spark, ["", "a|b | c d", "bcdfg x1y {z}"], profile)]
    assert got == [(0, 0, 0, 0, 0, 0), (4, 3, 0, 0, 3, 2), (3, 3, 2, 1, 3, 0)]


def test_penalty_weights_are_pinned():
    assert (M.DEVANAGARI_CREDIT, M.SUSPICIOUS_COST, M.VOWEL_POOR_COST, M.PIPE_LINE_COST, M.CID_COST, M.UNDECODED_COST, M.SINGLE_COST, M.MATRA_COST) == (3, 8, 3, 4, 12, 12, 6, 8)


@pytest.mark.parametrize(("text", "good"), [("12.50", True), ("1,00,000", True), ("123,456.78", True), ("12.", True), ("1.2.3", True), ("12.345", False), ("1,2", False), ("", False), ("१२।५", True)])
def test_plausible_numbers(spark, text, good):
    assert column(spark, [text], X.is_plausible_number) == [good]


def test_marks_round_trip(spark):
    df = spark.createDataFrame([([0, 5, 65533, 300],)], "g array<int>")
    marked = X.mark_glyphs(F.col("g"))
    r = df.select(X.unmark_glyphs(marked).alias("back"), X.count_marks(marked).alias("n"), X.strip_marks(marked).alias("rest")).first()
    assert (list(r.back), r.n, r.rest) == ([0, 5, 65533, 300], 4, "")


def test_latin_recovery_needs_one_reading(spark):
    df = spark.createDataFrame([([ord(c) - 29 for c in "the law of"],), ([1, 2],)], "g array<int>")
    assert [r[0] for r in df.select(X.recover_latin(F.col("g"), ["the", "law", "of"])).collect()] == ["the law of", None]


def test_keymap_rules_apply_word_by_word(spark):
    rules = [("pre", "^x", "k"), ("char", "k", "क"), ("char", "s", "क्ष"), ("post", "क$", "ख")]
    assert column(spark, ["xs k", "kk"], lambda t: keymaps.decode(t, rules)) == ["कक्ष ख", "कख"]


def test_explained_doublets(spark):
    lexemes, suffixes = ["मम्म", "बब"], ["को"]
    got = column(spark, ["कक", "अबब", "राककोट", "ककको"], lambda t: M.explained_doublets(t, lexemes, suffixes))
    assert got == [0, 1, 1, 0]


def test_number_split_takes_the_nth_whole_run(spark):
    df = spark.createDataFrame([("12 312 12 १२", "12", ["1", "2"], 1)], "l string, m string, p array<string>, n int")
    assert df.select(X.apply_number_split(F.col("l"), F.col("m"), F.col("p"), F.col("n"))).first()[0] == "12 312 1 | 2 १२"


@pytest.mark.parametrize(
    ("text", "subject", "dated"), [("पत्र विषय: x", True, False), ("मिषय :", True, False), ("मिति बिहान", False, False), ("आज मिति: २०८०", False, True), ("Subject: x", False, False)]
)
def test_subject_and_date_lines(spark, text, subject, dated):
    assert (column(spark, [text], X.is_subject_line), column(spark, [text], X.is_date_line)) == ([subject], [dated])


def test_markers_and_headings(spark):
    texts = ["a) item", "(1) item", "१२३४. कुरा", "- x", "-x", "", "It ends।", "Short, line;", "x" * 121]
    assert column(spark, texts, X.list_marker) == ["a)", None, "१२३४.", "-", None, None, None, None, None]
    assert column(spark, texts, lambda t: X.heading_level(t, F.lit(0))) == [None, 1, None, None, 1, None, 1, 1, None]
    assert column(spark, texts, lambda t: X.heading_level(t, F.lit(3))) == [None, 2, None, None, 2, None, None, 2, None]


def test_words_noise_and_press_lines(spark):
    words = ["नेपाल सरकार", "ािक", "क्", "कअ", "अक", "क्ा", "काी", "कa", ""]
    assert column(spark, words, X.is_wellformed_word) == [True, False, False, False, True, False, False, False, False]
    assert column(spark, ["सिंह", "एिं", "क्ि", "िक", "ॊ", "(cid:3)", "\uf0b7"], M.has_severe_noise) == [False, True, True, True, True, False, True]
    lines = ["\uf0b7 x ।", "\uf000 x", "➢  x", "● x", "प्रेस विज्ञ?ित", "•x"]
    assert column(spark, lines, X.normalize_press_line) == ["- x।", "\uf000 x", "- x", "● x", "प्रेस विज्ञप्ति", "•x"]
    assert column(spark, ["२०८०/ १-2", "2080 /1/2"], X.normalize_date) == ["2080-01-02", None]


def test_artifacts_and_doublets_are_charged(spark):
    assert column(spark, ["उज्वल", "कक्षागग", "क्रममा"], lambda t: M.text_penalty(t, M.unexplained_doublets(t))) == [8, 3, 0]
