"""Legacy keymaps: what was typed for a legacy font, decoded to Unicode.

A keymap is a lookup table (map_key, seq, kind, pattern, replacement) with kinds ``pre``
and ``post`` (regular expressions, applied in order of seq, word by word) and ``char``
(one character to a string).  Maps are inputs; none is built in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches as B
from . import patterns as P

Rule = tuple[str, str, str]  # kind, pattern, replacement


def translation(pairs: dict[str, str]) -> tuple[str, str]:
    """Arguments of ``translate`` for the one-to-one part of a map."""
    one = {k: v for k, v in pairs.items() if len(v) == 1}
    return "".join(one), "".join(one.values())


def decode_word(word: Column, rules: Sequence[Rule]) -> Column:
    """Pre rules, characters, post rules.  Characters that give several are set apart by placeholders first."""
    out = word
    for kind, pattern, replacement in rules:
        if kind == "pre":
            out = F.regexp_replace(out, pattern, replacement)
    chars = {p: r for k, p, r in rules if k == "char"}
    several = {c: r for c, r in chars.items() if len(r) != 1}
    hold = {c: chr(0xF700 + i) for i, c in enumerate(several)}
    source, target = translation(chars | hold)
    out = F.translate(out, source, target)
    for c, r in several.items():
        out = F.replace(out, F.lit(hold[c]), F.lit(r))
    for kind, pattern, replacement in rules:
        if kind == "post":
            out = F.regexp_replace(out, pattern, replacement)
    return out


def one_to_one(rules: Sequence[Rule]) -> dict[str, str] | None:
    """The characters of a map that has nothing but one for one, white space left out; else null."""
    chars = {p: r for _, p, r in rules}
    if all(kind == "char" and len(p) == len(r) == 1 for kind, p, r in rules):
        return {p: r for p, r in chars.items() if p not in P.SPACE_CHARACTERS}
    return None


def substituted(text: Column, chars: dict[str, str]) -> Column:
    """A text with single characters in place of others; a whole text at once, so no lambda can have it."""
    source, target = translation(chars)
    return B.substituted(source, target)(text)


def decode(text: Column, rules: Sequence[Rule]) -> Column:
    """A text decoded word by word, white space kept.  Words do not matter to a map of single characters, which is applied to the whole."""
    if (chars := one_to_one(rules)) is not None:
        return substituted(text, chars)
    return _decode_words(text, rules)


def _decode_words(text: Column, rules: Sequence[Rule]) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(f"{P.SPACE}+|{P.TOKEN}"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda w: F.when(w.rlike(f"^{P.SPACE}"), w).otherwise(decode_word(w, rules))), "")


def decode_distinct(df: DataFrame, text: str, rules: Sequence[Rule], into: str = "decoded") -> DataFrame:
    """As ``decode`` for a table whose texts are single words that repeat: each distinct one is decoded once."""
    words = df.select(text).distinct().withColumn(into, decode_word(F.col(text), rules))
    return df.join(words, text, "left")


def rotated(rules: Sequence[Rule], keys: str, becomes: str) -> list[Rule]:
    """A map for a keyboard on which ``keys`` type what ``becomes`` do on the base map."""
    moved = dict(zip(keys, becomes, strict=True))
    base = {p: r for k, p, r in rules if k == "char"}
    chars = [("char", k, base.get(moved.get(k, k), moved.get(k, k))) for k in dict.fromkeys([*base, *moved])]
    return [r for r in rules if r[0] == "pre"] + chars + [r for r in rules if r[0] == "post"]


def overridden(rules: Sequence[Rule], **chars: str) -> list[Rule]:
    """A map with other values for single characters."""
    return [r for r in rules if not (r[0] == "char" and r[1] in chars)] + [("char", k, v) for k, v in chars.items()]


def reads_ascii_digits(rules: Sequence[Rule]) -> bool:
    """Whether a map reads every ASCII digit as the Devanagari digit of its value."""
    chars = {p: r for k, p, r in rules if k == "char"}
    return all(chars.get(str(i)) == chr(0x966 + i) for i in range(10))


def ambiguous_characters(maps: Sequence[Sequence[Rule]]) -> str:
    """Characters that tied maps read differently."""
    tables = [{p: r for k, p, r in rules if k == "char"} for rules in maps]
    return "".join(sorted(c for c in set().union(*tables) if len({t.get(c, c) for t in tables}) > 1))


def decode_tied(text: Column, maps: Sequence[Sequence[Rule]]) -> Column:
    """What tied maps agree on: characters that they read differently stay as typed; null if the rest still differs."""
    unsure = ambiguous_characters(maps)
    if not unsure:
        return decode(text, maps[0])
    tables = [one_to_one(rules) for rules in maps]
    if None not in tables:  # what is not unsure, all maps read alike
        return substituted(text, {p: r for p, r in tables[0].items() if p not in unsure})
    cls = "".join(f"\\x{{{ord(c):X}}}" for c in unsure)
    pieces = F.regexp_extract_all(text, F.lit(f"[{cls}]+|[^{cls}]+"), F.lit(0))

    def reading(rules: Sequence[Rule]) -> Column:
        return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^[{cls}]"), p).otherwise(_decode_words(p, rules))), "")

    read = [reading(m) for m in maps]
    same = F.lit(True)
    for other in read[1:]:
        same = same & (other == read[0])
    return F.when(same, read[0])


def remap_symbols(text: Column, font_table: Column, tables: dict[str, dict[str, str]]) -> Column:
    """Private-use symbols of a symbol font by the table of its name; other fonts as they are."""
    chain = text
    for name, table in tables.items():
        source, target = translation(table)
        chain = F.when(font_table == name, F.translate(text, source, target)).otherwise(chain)
    return chain


def unlift_symbols(text: Column) -> Column:
    """Bytes lifted to U+F020-U+F0FF back to their values."""
    return F.translate(text, "".join(chr(0xF000 + b) for b in range(0x20, 0x100)), "".join(chr(b) for b in range(0x20, 0x100)))


def converter(rules: Sequence[Rule]) -> Callable[[Column], Column]:
    """A keymap as a function of columns, for registries."""
    return lambda text: decode(text, rules)


MOST_RULES = 4096


def rules_of(keymaps: DataFrame, map_key: str) -> list[Rule]:
    """The rules of one map of a lookup table; a map has a few hundred rows, and one of more than ``MOST_RULES`` is refused."""
    rows = keymaps.filter(F.col("map_key") == map_key).orderBy("seq").select("kind", "pattern", "replacement").take(MOST_RULES + 1)
    if len(rows) > MOST_RULES:
        raise ValueError(f"map {map_key} has more than {MOST_RULES} rules")
    return [tuple(r) for r in rows]
