"""Character classes and patterns, all as escapes so that no normalisation can change them.

White space is spelled out because Java's ``\\s`` is ASCII only and a document's spaces
are not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Unicode white space, as members of a class
SPACES = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
OTHER_SPACES = SPACES.replace(r"\x{1C}-\x{20}", r"\x{1C}-\x{1F}")
SPACE = f"[{SPACES}]"
SPACE_CHARACTERS = "".join(chr(c) for first, last in ((0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(first, last + 1))
TOKEN = f"[^{SPACES}]+"
#: what ends a line: \n, \r\n, \r, \v, \f, FS, GS, RS, NEL, LS, PS
LINE_END = r"\r\n|[\n\r\x{B}\x{C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"

# fixed values: Devanagari ranges, as members of a class
DEVANAGARI = r"\x{900}-\x{97F}"
CONSONANTS = r"\x{915}-\x{939}\x{958}-\x{95F}\x{978}-\x{97F}"
INDEPENDENT_VOWELS = r"\x{904}-\x{914}\x{972}-\x{977}"
MATRAS = r"\x{93A}\x{93B}\x{93E}-\x{94C}\x{94E}\x{94F}\x{955}-\x{957}\x{962}\x{963}"
SIGNS = r"\x{900}-\x{903}\x{93C}\x{94D}"
JOINERS = r"\x{200C}\x{200D}"
#: dependent vowel signs that the quality score looks at, and what may stand before one
SCORE_MATRAS = r"\x{93E}-\x{94C}"
MATRA_BASES = r"\x{915}-\x{939}\x{958}-\x{95F}\x{94D}\x{93C}"
PRIVATE_USE = r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}"
LETTER_GAP = r"\x{900}-\x{963}\x{970}-\x{97F}"

SUSPICIOUS = r"[\\\[\]{}$^&*_+=<>]|[A-Za-z][0-9]|[0-9][A-Za-z]"
CID = r"\(cid:[0-9]+\)"

#: tokens within a text whose white space is all plain: a class of one character is much cheaper than one of all spaces
WORD = "[^ ]+"


def occurrences(text: Column, pattern: str) -> Column:
    """How often a pattern matches."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def characters(text: Column, members: str) -> Column:
    """How many characters are in a class; cheaper than matching each."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, F.lit(f"[{members}]"), F.lit("")))).cast("long")


def plainly_spaced(text: Column) -> Column:
    """With a space in place of each other character of white space."""
    return F.regexp_replace(text, F.lit(f"[{OTHER_SPACES}]"), F.lit(" "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(plainly_spaced(text), F.lit(WORD), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(plainly_spaced(text), F.lit("  +"), F.lit(" ")))


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end starts no further line."""
    return F.split(F.regexp_replace(text, F.lit(f"(?:{LINE_END})$"), F.lit("")), LINE_END)
