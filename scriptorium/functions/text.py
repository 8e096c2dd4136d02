"""Line- and token-level text functions: normalising, detecting, repairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batches as B
from . import patterns as P

ASCII_DIGITS, DEVANAGARI_DIGITS = "0123456789", "".join(chr(0x966 + i) for i in range(10))
DANDA = "।"

# ---- normalising ------------------------------------------------------------------------

# fixed values: what opens a list item of a press release, and its title
LEADING_SYMBOL = r"[\x{FFFD}\x{2022}\x{25AA}\x{27A2}\x{F020}-\x{F0FF}\x{F0000}-\x{FFFFD}]"
PRESS_TITLE, PRESS_NOTE = "प्रेस", "विज्ञ"


def normalize_line(text: Column) -> Column:
    """White space collapsed, none before a danda, comma, colon or semicolon."""
    return F.regexp_replace(P.collapsed(text), r" ([\x{964},:;])", "$1")


def normalize_press_line(text: Column) -> Column:
    """A leading bullet or symbol-font glyph becomes a dash, then as any line; the title of a press release in one spelling.

    The reordering markers U+F000 and U+F001 are no symbols and stay.
    """
    line = normalize_line(F.regexp_replace(text, rf"^{LEADING_SYMBOL}(?={P.SPACE})", "-"))
    return F.when(line.rlike(rf"^{PRESS_TITLE}{P.SPACE}+{PRESS_NOTE}[^{P.SPACES}]*$"), f"{PRESS_TITLE} {PRESS_NOTE}प्ति").otherwise(line)


def fix_devanagari_spacing(text: Column) -> Column:
    """No space before a combining mark or reordering marker, none after a virama."""
    after = F.regexp_replace(text, r"(?<=\x{94D}) +", "")
    return F.regexp_replace(after, rf" (?=[{P.MATRAS}{P.SIGNS}\x{{F000}}\x{{F001}}])", "")


def reorder_devanagari(text: Column) -> Column:
    """Puts marked signs in logical order.

    An i-matra marker (U+F001) moves behind the consonant cluster after it; a repha marker
    (U+F000) becomes ra and virama before the cluster it follows, marks skipped.  A marker
    without a cluster becomes its plain letters.  Exact for at most one repha marker in a
    string; ``reorder_devanagari_any`` covers the rest.
    """
    c = r"[\x{915}-\x{939}]"
    cluster = rf"(?:{c}\x{{94D}})*{c}"
    imatra = F.replace(F.regexp_replace(text, rf"\x{{F001}}({cluster})", "$1\u093f"), F.lit("\uf001"), F.lit("\u093f"))
    repha = F.regexp_replace(imatra, rf"({cluster}[\x{{93E}}-\x{{94C}}\x{{962}}\x{{963}}\x{{901}}-\x{{903}}\x{{94D}}]*)\x{{F000}}", "\u0930\u094d$1")
    return F.replace(repha, F.lit("\uf000"), F.lit("\u0930\u094d"))


def reorder_devanagari_any(text: Column) -> Column:
    """As ``reorder_devanagari`` for any number of markers: each repha in turn, left to right."""
    parts = F.split(text, "(?<=\uf000)")
    return F.aggregate(parts, F.lit(""), lambda done, part: reorder_devanagari(F.concat(done, part)))


def with_reordering_markers(glyph_text: Column) -> Column:
    """The text of one glyph that draws out of order, with markers: i-matra, leading repha, matra with repha."""
    ikar = F.when(glyph_text == "\u093f", "\uf001")
    leading = F.when(glyph_text == "\u0930\u094d", "\uf000")
    both = F.when(glyph_text.rlike(rf"^[{P.MATRAS}]+\x{{930}}\x{{94D}}$"), F.concat(F.regexp_replace(glyph_text, r"\x{930}\x{94D}$", ""), F.lit("\uf000")))
    return F.coalesce(ikar, leading, both, glyph_text)


# ---- glyph marks ------------------------------------------------------------------------

MARK_BASE = 0xF0000


def _from_code(code: Column) -> Column:
    """The character of any code point, also beyond the BMP, where ``chr`` stops."""
    high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
    low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
    pair = F.concat(F.lpad(F.hex(high), 4, "0"), F.lpad(F.hex(low), 4, "0"))
    single = F.lpad(F.hex(code), 4, "0")
    return F.decode(F.unhex(F.when(code > 0xFFFF, pair).otherwise(single)), "UTF-16BE")


def mark_glyphs(glyphs: Column) -> Column:
    """Undecodable glyph ids (an array of ints) as marked characters of plane 15."""
    return F.array_join(F.transform(glyphs, lambda g: _from_code(g + MARK_BASE)), "")


def unmark_glyphs(text: Column) -> Column:
    """Marked characters back to their glyph ids."""
    marked = F.regexp_extract_all(text, F.lit(r"[\x{F0000}-\x{FFFFD}]"), F.lit(0))
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    return F.transform(marked, lambda c: (code(c) - MARK_BASE).cast("int"))


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{F0000}-\x{FFFFD}]", "")


def count_marks(text: Column) -> Column:
    return P.characters(text, r"\x{F0000}-\x{FFFFD}")


def recover_latin(glyphs: Column, lexicon: Sequence[str], offsets: Sequence[int] = (0, 29)) -> Column:
    """Glyph ids of a Latin font read at an offset that gives words of the lexicon; null if none or two do.

    The whole run must be printable ASCII, with two words of the lexicon, or one that is half of all letters.
    """
    words = F.array(*map(F.lit, lexicon))

    def reading(offset: int) -> Column:
        text = F.array_join(F.transform(glyphs, lambda g: F.chr(g + offset)), "")
        tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
        known = F.filter(tokens, lambda t: F.array_contains(words, t))
        covered = F.aggregate(F.transform(known, F.char_length), F.lit(0), lambda a, n: a + n)
        letters = P.characters(text, "A-Za-z")
        ok = F.forall(glyphs, lambda g: (g + offset).between(0x20, 0x7E)) & ((F.size(known) >= 2) | ((F.size(known) >= 1) & (covered * 2 >= letters)))
        return F.when(ok, text)

    found = F.array_distinct(F.array_compact(F.array(*map(reading, offsets))))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


# ---- fonts by name ----------------------------------------------------------------------


def base_font(name: Column) -> Column:
    """Without a subset prefix."""
    return F.element_at(F.split(name, r"\+", 2), -1)


def symbol_base_font(name: Column) -> Column:
    return F.lower(F.regexp_replace(base_font(name), ",.*$", ""))


def classify_font(name: Column, registry: Sequence[str], broken: Sequence[str] = ("kalimati", "lohit")) -> Column:
    """legacy_remap where a registered legacy name occurs in it, broken_cmap for fonts with broken maps, else correct."""
    low = F.lower(base_font(name))
    chain = F.lit("correct")
    for n in reversed(broken):
        chain = F.when(F.contains(low, F.lit(n)), "broken_cmap").otherwise(chain)
    for n in reversed(registry):
        chain = F.when(F.contains(low, F.lit(n)), "legacy_remap").otherwise(chain)
    return chain


def registry_key(name: Column, registry: Sequence[tuple[str, str]]) -> Column:
    """The keymap of the first registered needle that occurs in a font's name; null if none does."""
    low = F.lower(base_font(name))
    chain = F.lit(None).cast("string")
    for needle, key in reversed(registry):
        chain = F.when(F.contains(low, F.lit(needle)), key).otherwise(chain)
    return chain


# fixed values: families every viewer has
CORE_FAMILIES = ["helvetica", "times", "courier", "symbol", "zapfdingbats", "arial", "timesnewroman"]


def is_core_font(name: Column) -> Column:
    family = F.regexp_extract(F.lower(base_font(name)), "^[^,-]*", 0)
    found = F.lit(False)
    for f in CORE_FAMILIES:
        found = found | F.startswith(family, F.lit(f))
    return found


def is_unembedded_core_font(ext: Column, subtype: Column, name: Column, has_tounicode: Column) -> Column:
    return F.lower(ext).isin("n/a", "") & F.lower(subtype).isin("type1", "truetype", "mmtype1") & ~has_tounicode & is_core_font(name)


def symbol_table(name: Column, keys: Sequence[str]) -> Column:
    """The longest key that is the font's name, or begins it before a dash or space; null if none."""
    low = symbol_base_font(name)
    chain = F.lit(None).cast("string")
    for k in sorted(keys, key=len):
        chain = F.when((low == k) | F.startswith(low, F.lit(k + "-")) | F.startswith(low, F.lit(k + " ")), k).otherwise(chain)
    return chain


def is_latin_cid_font(name: Column, registry: Sequence[str], symbols: Sequence[str], families: str) -> Column:
    return (classify_font(name, registry, ()) == "correct") & symbol_table(name, symbols).isNull() & F.lower(base_font(name)).rlike(families)


# ---- predicates over lines --------------------------------------------------------------


def is_legacy_ascii(text: Column) -> Column:
    """At least 8 characters, no Devanagari, four fifths printable ASCII."""
    return B.legacy_ascii(text)


def reads_as_latin_structure(raw: Column, hits_when_decoded: Column) -> Column:
    """Prose rather than keystrokes: letters, vowels, no inner capitals, no words when decoded."""
    return B.latin_structure(raw) & (hits_when_decoded == 0)


def reads_as_latin_words(raw: Column, stop_words: Sequence[str]) -> Column:
    """A tenth of its words of several letters are stop words."""
    return B.latin_words(tuple(stop_words))(raw)


def acronym_tokens(text: Column) -> Column:
    """Distinct tokens of 2 to 5 capitals and digits, at least two capitals, marks at the edges dropped."""
    bare = F.transform(P.tokens(text), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_distinct(F.filter(bare, lambda t: t.rlike("^[A-Z0-9]{2,5}$") & (P.characters(t, "A-Z") >= 2)))


def is_page_furniture(text: Column, header: str) -> Column:
    """A chapter head, a running header, or a bare page number."""
    tight = F.regexp_replace(text, F.lit(P.SPACE), F.lit(""))
    chapter = tight.rlike(r"^[0-9\x{966}-\x{96F}]+\x{92A}\x{930}\x{93F}\x{91A}\x{94D}\x{91B}\x{947}\x{926}")
    return chapter | (F.contains(tight, F.lit("".join(header.split()))) if header else F.lit(False)) | tight.rlike(r"^[0-9\x{966}-\x{96F}]{1,3}$")


# fixed values: words before the subject and the date of a letter, each with a misreading
SUBJECT, DATE_LINE = f"(?:विषय|मिषय){P.SPACE}*:", f"(?:मिति|मिमि){P.SPACE}*:"


def is_subject_line(text: Column) -> Column:
    return text.rlike(SUBJECT)


def is_date_line(text: Column) -> Column:
    return text.rlike(DATE_LINE)


#: only digits, or only letters and operators
NOISE_ONLY = r"^(?:[0-9]+|[A-Za-z+\-^&*/\\|=()]+)$"


def is_noise_only(text: Column) -> Column:
    tight = F.regexp_replace(text, F.lit(P.SPACE), F.lit(""))
    return tight.rlike(NOISE_ONLY)


# fixed values: signs and letters that the test of well-formed words looks at
WORD_SIGNS, WORD_MARKS, WORD_VOWELS = r"\x{93A}\x{93B}\x{93E}-\x{94C}\x{94E}\x{94F}\x{962}\x{963}", r"\x{900}-\x{903}\x{93A}-\x{94F}\x{951}-\x{957}\x{962}\x{963}", r"\x{905}-\x{914}\x{960}\x{961}"


def is_wellformed_word(word: Column) -> Column:
    """Devanagari and spaces only, no mark first, no virama last or before a sign, no two signs together, no vowel letter but first."""
    return (
        word.rlike(rf"^[{P.DEVANAGARI} ]+$") & ~word.rlike(rf"^[{WORD_MARKS}]") & ~word.rlike(r"\x{94D}$") & ~word.rlike(rf"^[\s\S]+[{WORD_VOWELS}]")
        & ~word.rlike(rf"\x{{94D}}[{WORD_SIGNS}]") & ~word.rlike(rf"[{WORD_SIGNS}]{{2}}")
    )


# ---- numbers and dates ------------------------------------------------------------------


def canonical_number(text: Column) -> Column:
    """Devanagari digits as ASCII, a danda as a point."""
    return F.translate(text, DEVANAGARI_DIGITS + DANDA, ASCII_DIGITS + ".")


def to_devanagari_digits(text: Column) -> Column:
    return F.translate(text, ASCII_DIGITS, DEVANAGARI_DIGITS)


# fixed values: what a single number may look like
PLAIN = r"[0-9]+(?:\.[0-9]{1,2})?"
INDIAN = r"[0-9]{1,3}(?:,[0-9]{2})*,[0-9]{3}(?:\.[0-9]{1,2})?"
WESTERN = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{1,2})?"
SERIAL = r"[0-9]{1,4}\."
DOTTED = r"[0-9]{1,4}(?:\.[0-9]{1,4}){2,}"
PLAUSIBLE = f"^(?:{PLAIN}|{INDIAN}|{WESTERN}|{SERIAL}|{DOTTED})$"


def is_plausible_number(text: Column) -> Column:
    """Plain, Indian- or Western-grouped, a serial, or a dotted reference."""
    return canonical_number(text).rlike(PLAUSIBLE)


def is_two_decimal_join(text: Column) -> Column:
    """Two amounts of two decimals each, run together."""
    return canonical_number(text).rlike(r"^[0-9][0-9,]*\.[0-9]{1,2}[0-9][0-9,]*\.[0-9]{1,2}$")


def normalize_date(text: Column) -> Column:
    """YYYY-MM-DD of a date in either digit script, as a string (months may have 32 days); null if there is none."""
    pattern = rf"([0-9]{{4}})[\x{{964}}./-]{P.SPACE}*([0-9]{{1,2}})[\x{{964}}./-]{P.SPACE}*([0-9]{{1,2}})"
    digits = F.translate(text, DEVANAGARI_DIGITS, ASCII_DIGITS)
    part = lambda i: F.regexp_extract(digits, pattern, i)
    return F.when(part(1) != "", F.concat(part(1), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0")))


def guarded_number(raw: Column, decoded: Column, reads_digits: bool) -> Column:
    """A bracketed number keeps its brackets and only changes script, on maps that read digits as digits."""
    return F.when(F.lit(reads_digits) & raw.rlike(r"^\s*\([0-9]+\)\s*$"), to_devanagari_digits(raw)).otherwise(decoded)


# ---- headings, lists, anchors -----------------------------------------------------------


# fixed values: a bullet, or a number or one letter with a stop or bracket, before a body on one line
LIST_MARKER = rf"^([-*\x{{2022}}]|\p{{Nd}}+[.)]|[A-Za-z][.)]){P.SPACE}+[^\n]+$"


def list_marker(text: Column) -> Column:
    m = F.regexp_extract(P.stripped(text), LIST_MARKER, 1)
    return F.when(m != "", m)


def heading_level(text: Column, ordinal: Column) -> Column:
    """1 for a heading that opens a document, 2 for a short line that ends in no stop, null for text."""
    line = P.stripped(text)
    able = (line != "") & (F.char_length(line) <= 120) & list_marker(line).isNull()
    return F.when(able & (ordinal == 0), 1).when(able & ~line.rlike(r"[\x{964}.?!:]$") & (F.size(P.tokens(line)) <= 10), 2)


def caption_key(text: Column) -> Column:
    """Letters and numbers only (marks do not count), whatever their case."""
    return F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")))


# fixed values: column heads whose words run together
HEADER_ALIASES = {"आयोगकोनिर्णय": "आयोगको निर्णय", "मिति/मुद्दानंर": "मिति/मुद्दा नं र"}


def header_label(text: Column) -> Column:
    """A column's head with its white space collapsed, known ones in one spelling."""
    clean = P.collapsed(text)
    compact = F.replace(clean, F.lit(" "), F.lit(""))
    return F.coalesce(*[F.when(compact == tight, F.lit(label)) for tight, label in HEADER_ALIASES.items()], clean)


def escape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


ANCHOR = r"<!-- page: ([0-9]+) -->"


def page_anchor(page: Column) -> Column:
    return F.concat(F.lit("<!-- page: "), page.cast("string"), F.lit(" -->"))


def page_anchor_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(1)), lambda n: n.cast("int"))


def strip_page_anchors(text: Column) -> Column:
    return F.regexp_replace(text, rf"{ANCHOR}\n*", "")


def degraded_marker(error: Column) -> Column:
    return F.concat(F.lit("<!-- degraded: "), error, F.lit(" -->"))


def stamp_degraded(text: Column, error: Column) -> Column:
    """Only a failure for want of resources is stamped."""
    return F.when(error.isin("MemoryError", "OSError"), F.concat(degraded_marker(error), F.lit("\n\n"), text)).otherwise(text)


def degraded_error(text: Column) -> Column:
    m = F.regexp_extract(text, r"<!-- degraded: (\w+) -->", 1)
    return F.when(m != "", m)


def frontmatter(fields: Sequence[tuple[str, Column]]) -> Column:
    """YAML front matter; a null field is left out."""
    quoted = [F.when(c.isNotNull(), F.concat(F.lit(f'{n}: "'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))) for n, c in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *quoted), F.lit("\n---\n\n"))


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"^---\n[\s\S]*?\n---\n+", "")


def render_paragraph(text: Column) -> Column:
    """Line ends kept as hard breaks, blank lines dropped."""
    kept = F.filter(F.transform(P.lines(text), lambda x: F.regexp_replace(x, f"{P.SPACE}+$", "")), lambda x: P.stripped(x) != "")
    return F.array_join(kept, "  \n")


def split_columns(line: Column) -> Column:
    """A line cut at its first gap of two or more spaces."""
    return F.split(line, r"\s{2,}", 2)


def apply_number_split(line: Column, merged: Column, parts: Column, occurrence: Column) -> Column:
    """Replaces the nth (from 0) whole-run occurrence of ``merged`` by its parts joined with pipes.

    Digits match in either script; a match must not touch further digits, points or commas.
    """
    canon, needle = canonical_number(line), canonical_number(merged)
    run = F.regexp_extract_all(canon, F.lit("[0-9.,]+|[^0-9.,]+"), F.lit(0))
    # (canonical pieces, where the next starts, matches so far, output)
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("seen"), F.lit("").alias("out"))
    step = lambda acc, piece: F.struct(
        (acc["at"] + F.char_length(piece)).alias("at"),
        (acc["seen"] + (piece == needle).cast("int")).alias("seen"),
        F.concat(acc["out"], F.when((piece == needle) & (acc["seen"] == occurrence), F.array_join(parts, " | ")).otherwise(F.substring(line, acc["at"], F.char_length(piece)))).alias("out"),
    )
    return F.aggregate(run, start, step, lambda acc: acc["out"])
