"""Metrics of whole texts by Arrow batch: arrays over code points instead of a pattern run over each text.

A batch is taken in pieces of about ``PIECE`` characters, so memory does not follow the size of
a batch.  In a piece each text stands between two edges, which are in no class of characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

PIECE, EDGE = 1 << 18, 0x110000
SCRIPT = "\u0900-\u097f"

#: classes of characters, as members of a class in a pattern; each is a bit
CLASSES = {
    "space": P.SPACES, "devanagari": P.DEVANAGARI, "matra": P.MATRAS, "sign": P.SIGNS, "joiner": P.JOINERS, "base": P.CONSONANTS + P.INDEPENDENT_VOWELS,
    "score_matra": P.SCORE_MATRAS, "matra_base": P.MATRA_BASES, "private": P.PRIVATE_USE, "invalid": r"\x{94A}\x{929}\x{931}\x{934}", "consonant": r"\x{915}-\x{939}",
    "after_ikar": r"\x{93E}-\x{944}\x{947}\x{948}\x{94B}\x{94C}", "nasal": r"\x{901}-\x{903}", "nasal_base": r"\x{915}-\x{939}\x{93C}\x{94D}", "letter_gap": P.LETTER_GAP,
    "bracket": r"()\[\]{}", "ascii": "A-Za-z", "upper": "A-Z", "digit": "0-9", "vowel": "aeiouAEIOU", "suspicious": r"\\\[\]{}$^&*_+=<>", "keystroke": r"\\\[\]{}|~^_@#$%*+=<>",
    "undecoded": r"\x{FFFD}\x{0}", "pua": r"\x{E000}-\x{F8FF}", "control": r"\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}", "low": r"\x{0}-\x{24F}", "printable": r"\x{20}-\x{7E}",
    "danda": r"\x{964}\x{965}", "letter": "", "blank": r"\x{9}-\x{D}", "edge": "",
}
BIT = {name: np.uint32(1 << i) for i, name in enumerate(CLASSES)}


def members(spec: str) -> Iterator[tuple[int, int]]:
    """The ranges of a class: escapes, characters, and two of them with a hyphen between."""
    items = [(int(h, 16) if h else ord(e or c), not h and not e and c == "-") for h, e, c in re.findall(r"\\x\{([0-9A-Fa-f]+)\}|\\(.)|(.)", spec, re.S)]
    i = 0
    while i < len(items):
        span = 2 if i + 2 < len(items) and items[i + 1][1] else 0
        yield items[i][0], items[i + span][0]
        i += span + 1


@lru_cache(1)
def _bits() -> np.ndarray:
    table = np.zeros(EDGE + 1, np.uint32)
    for name, spec in CLASSES.items():
        for first, last in members(spec):
            table[first : last + 1] |= BIT[name]
    for i in range(EDGE):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] |= BIT["letter"]
        elif kind == "Z":
            table[i] |= BIT["blank"]
    table[EDGE] = BIT["edge"]
    return table


class Texts:
    """Texts side by side as code points, each between two edges."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.joined = texts, "\0".join(["", *texts, ""])
        self.code = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.edges = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        self.code[self.edges] = EDGE
        self.bits, self._found = _bits()[self.code], {}

    def any(self, *names: str) -> np.ndarray:
        """Which characters are in one of the classes."""
        return (self.bits & np.bitwise_or.reduce([BIT[n] for n in names])) != 0

    def count(self, mask: np.ndarray) -> np.ndarray:
        """By text, how many characters a mask has."""
        return self.count_at(np.flatnonzero(mask))

    def count_at(self, places: np.ndarray) -> np.ndarray:
        """By text, how many of the places, which ascend, are in it."""
        return np.diff(np.searchsorted(places, self.edges))

    def find(self, word: str) -> np.ndarray:
        """Where a word stands, places that overlap too."""
        if word not in self._found:
            at = np.flatnonzero(self.code[: len(self.code) - len(word) + 1] == ord(word[0])) if word in self.joined else np.zeros(0, np.int64)
            for k, c in enumerate(word[1:], 1):
                at = at[self.code[at + k] == ord(c)]
            self._found[word] = at
        return self._found[word]

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of characters that are no white space start and end."""
        gap = self.any("space", "edge")
        turns = np.flatnonzero(gap[:-1] != gap[1:]) + 1
        return turns[::2], turns[1::2]


def before(mask: np.ndarray) -> np.ndarray:
    """At each character, what a mask has for the one before."""
    return np.concatenate([[False], mask[:-1]])


def after(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([mask[1:], [False]])


def by_piece(texts: Sequence[str | None], measure: Callable[[Texts], list[np.ndarray]]) -> list[np.ndarray]:
    """The columns that ``measure`` gives for the texts, a null one taken as empty."""
    out, piece, size = [], [], 0
    for t in texts:
        piece.append(t or "")
        size += len(piece[-1]) + 1
        if size >= PIECE:
            out.append(measure(Texts(piece)))
            piece, size = [], 0
    if piece or not out:
        out.append(measure(Texts(piece)))
    return [np.concatenate(column) for column in zip(*out, strict=True)]


def longs(text: pa.Array, measure: Callable[[Texts], dict[str, np.ndarray]], names: Sequence[str]) -> pa.Array:
    """A struct of whole numbers for each text, null for null."""
    columns = by_piece(text.to_pylist(), lambda t: [m[n] for m in [measure(t)] for n in names])
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names), mask=text.is_null())


def number(text: pa.Array, measure: Callable[[Texts], np.ndarray], kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(by_piece(text.to_pylist(), lambda t: [measure(t)])[0], kind or pa.int64(), mask=text.is_null().to_numpy(zero_copy_only=False))


def struct_of(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


# ---- tokens and the quality score --------------------------------------------------------

TOKEN_COUNTS = ("tokens", "latin", "suspicious", "vowel_poor", "content", "single")


def _token_counts(t: Texts) -> dict[str, np.ndarray]:
    start, end = t.tokens()

    def held(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[end] - total[start]

    letter, digit = t.any("ascii"), t.any("digit")
    odd = t.any("suspicious") | (letter & after(digit)) | (digit & after(letter))
    latin, letters = held(letter) > 0, held(t.any("letter"))
    lone = end - start == 1
    pipe = lone & (t.code[start] == ord("|"))
    of = lambda which: t.count_at(start[which])
    tokens = t.count_at(start)
    return {
        "tokens": tokens, "latin": of(latin), "suspicious": of(latin & (held(odd) > 0)), "vowel_poor": of(latin & (letters >= 4) & (held(t.any("vowel")) * 5 < letters)),
        "content": tokens - of(pipe), "single": of(lone & ~pipe),
    }


@F.arrow_udf(struct_of(TOKEN_COUNTS))
def token_counts(text: pa.Array) -> pa.Array:
    return longs(text, _token_counts, TOKEN_COUNTS)


def _pipe_heavy_lines(t: Texts) -> np.ndarray:
    out = np.zeros(len(t.texts), np.int64)
    for i in np.flatnonzero(t.count(t.code == ord("|")) >= 2):
        out[i] = sum(x.count("|") >= 2 and x.strip().strip("|").count("|") >= 2 for x in t.texts[i].splitlines())
    return out


@F.arrow_udf(T.LongType())
def pipe_heavy_lines(text: pa.Array) -> pa.Array:
    return number(text, _pipe_heavy_lines)


_CID = re.compile(P.CID)
TEXT_COUNTS = ("devanagari", "pipe_lines", "cid", "undecoded", "spaces", "chars", "matra_damage")


def _text_counts(t: Texts) -> dict[str, np.ndarray]:
    m, base = t.any("score_matra"), t.any("matra_base")
    follows = before(m)
    runs = t.count(m & follows & ~before(follows))
    orphans = t.count(m) - t.count(m & before(base))
    cid = np.array([x.start() for x in _CID.finditer(t.joined)] if "(cid:" in t.joined else [], np.int64)
    return {
        "devanagari": t.count(t.any("devanagari")), "pipe_lines": _pipe_heavy_lines(t), "cid": t.count_at(cid), "undecoded": t.count(t.any("undecoded")), "spaces": t.count(t.any("space")),
        "chars": t.lengths, "matra_damage": runs + orphans + t.count(m & before(t.code == 0x94D)),
    }


@F.arrow_udf(struct_of(TEXT_COUNTS))
def text_counts(text: pa.Array) -> pa.Array:
    """What the quality score takes of a text besides its tokens."""
    return longs(text, _text_counts, TEXT_COUNTS)


# ---- signals -----------------------------------------------------------------------------

WELLFORMEDNESS = ("stranded", "stranded_matras", "word_initial", "doubled", "halant_matra", "matras", "marks", "malformed")


def _wellformedness(t: Texts) -> dict[str, np.ndarray]:
    m, mark = t.any("matra"), t.any("matra", "sign")
    # the last character that is neither mark nor joiner: a mark is stranded unless that is a consonant or a vowel
    last = np.maximum.accumulate(np.where(t.any("matra", "sign", "joiner"), 0, np.arange(len(t.code), dtype=np.int32)))
    stranded = mark & ~t.any("base")[last]
    out = {"stranded": t.count(stranded), "stranded_matras": t.count(stranded & m), "word_initial": t.count(mark & before(t.any("space", "edge")))}
    out |= {"doubled": t.count(m & before(m)), "halant_matra": t.count(m & before(t.code == 0x94D)), "matras": t.count(m), "marks": t.count(mark)}
    return out | {"malformed": out["stranded"] + out["doubled"] + out["halant_matra"]}


@F.arrow_udf(struct_of(WELLFORMEDNESS))
def wellformedness(text: pa.Array) -> pa.Array:
    return longs(text, _wellformedness, WELLFORMEDNESS)


SIGNALS = ("chars", "letters", "devanagari", "latin", "replacement", "pua", "control", "cid_garbage", "malformed", "stranded", "stranded_matras", "doubled", "matras")


def _signals(t: Texts) -> dict[str, np.ndarray]:
    letter = t.any("letter")
    return _wellformedness(t) | {
        "chars": t.lengths, "letters": t.count(letter), "devanagari": t.count(letter & t.any("devanagari")), "latin": t.count(letter & t.any("low")), "replacement": t.count(t.code == 0xFFFD),
        "pua": t.count(t.any("pua")), "control": t.count(t.any("control")), "cid_garbage": t.count_at(t.find("(cid:")),
    }


@F.arrow_udf(struct_of(SIGNALS))
def signals(text: pa.Array) -> pa.Array:
    return longs(text, _signals, SIGNALS)


# ---- legacy text -------------------------------------------------------------------------


def _legacy_ascii(t: Texts) -> np.ndarray:
    return (t.lengths >= 8) & (t.count(t.any("devanagari")) == 0) & (t.count(t.any("printable")) >= 0.8 * t.lengths)


@F.arrow_udf(T.BooleanType())
def legacy_ascii(text: pa.Array) -> pa.Array:
    return number(text, _legacy_ascii, pa.bool_())


def _latin_structure(t: Texts) -> np.ndarray:
    solid, letters = t.lengths - t.count(t.any("space")), t.count(t.any("ascii"))
    upper = t.any("upper")
    inner = t.count(upper & before(t.any("ascii") & ~upper))
    return (solid >= 16) & (t.count(t.any("keystroke")) == 0) & (letters >= 0.88 * solid) & (t.count(t.any("vowel")) >= 0.30 * letters) & (inner == 0)


@F.arrow_udf(T.BooleanType())
def latin_structure(text: pa.Array) -> pa.Array:
    return number(text, _latin_structure, pa.bool_())


def _latin_words(t: Texts, stop_words: Sequence[str]) -> np.ndarray:
    letter = t.any("ascii")
    turns = np.flatnonzero(letter[:-1] != letter[1:]) + 1
    start, length = turns[::2], turns[1::2] - turns[::2]
    stops = np.zeros(len(start), bool)
    for w in {w for w in stop_words if re.fullmatch("[a-z]{2,}", w)}:
        at = np.flatnonzero(length == len(w))
        for k, c in enumerate(w):
            at = at[t.code[start[at] + k] | 0x20 == ord(c)]
        stops[at] = True
    words = t.count_at(start[length >= 2])
    return (words > 0) & (t.count_at(start[stops]) * 10 >= words)


@lru_cache(64)
def latin_words(stop_words: tuple[str, ...]) -> Callable[[Column], Column]:
    @F.arrow_udf(T.BooleanType())
    def told(text: pa.Array) -> pa.Array:
        # two characters outside of ASCII have ASCII letters in lower case
        lower = pa.array([t.lower() if t and ("\u0130" in t or "\u212a" in t) else t for t in text.to_pylist()], pa.string())
        return number(lower, lambda t: _latin_words(t, stop_words), pa.bool_())

    return told


# ---- the penalty and validity of decodings ------------------------------------------------


def _doublets(t: Texts) -> np.ndarray:
    """Where the second halves of doublets are, from left to right, none overlapping: every other twin of a run."""
    same = t.code[:-1] == t.code[1:]
    twins = np.flatnonzero(same & t.any("consonant")[:-1])
    opens = np.flatnonzero(np.diff(twins, prepend=-2) != 1)
    nth = np.arange(len(twins)) - np.repeat(opens, np.diff(opens, append=len(twins)))
    return twins[nth % 2 == 0] + 1


def _explained(t: Texts, second: np.ndarray, lexemes: Sequence[str], suffixes: Sequence[str]) -> np.ndarray:
    """Which doublets, given by their second halves, lie inside a listed lexeme or open a suffix after a stem of two characters at least.

    A word is a run of Devanagari, so lexemes and suffixes of that script alone can be in one.
    """
    out, script = np.zeros(len(second), bool), re.compile(f"[{SCRIPT}]+").fullmatch
    at, code = lambda places: t.code.take(places, mode="clip"), t.code[second]
    stem = (t.bits[second - 2] & BIT["devanagari"]) != 0
    spelt = [(x, i + 1, False) for x in lexemes if script(x) for i in range(len(x) - 1) if x[i] == x[i + 1]] + [(x, 0, True) for x in suffixes if script(x)]
    for x, k, opens in spelt:  # the second half is character k of x
        which = np.flatnonzero((code == ord(x[k])) & stem if opens else code == ord(x[k]))
        for j, c in enumerate(x):
            which = which[at(second[which] + (j - k)) == ord(c)]
        out[which] = True
    return out


def _alternatives(t: Texts, words: Sequence[str]) -> np.ndarray:
    """Matches of ``a|b|…`` by text: the leftmost first, of equals the first listed, none overlapping."""
    found = sorted((at, k, len(w)) for k, w in enumerate(words) for at in t.find(w).tolist())
    kept, free = [], 0
    for at, _, n in found:
        if at >= free:
            kept.append(at)
            free = at + n
    return t.count_at(np.array(kept, np.int64))


PENALTY = ("replacement", "private", "invalid", "prefix_ikar", "ikar_matra", "ikar_nasal", "halant_ikar", "artifacts", "doublets", "explained")


def penalty_counts(t: Texts, artifacts: Sequence[str], lexemes: Sequence[str], suffixes: Sequence[str]) -> dict[str, np.ndarray]:
    ikar, second = t.code == 0x93F, _doublets(t)
    opens = t.any("space", "edge") | (t.code == ord("("))
    return {
        "replacement": t.count(t.code == 0xFFFD), "private": t.count(t.any("private")), "invalid": t.count(t.any("invalid")),
        "prefix_ikar": t.count(ikar & before(opens) & after(t.any("consonant"))), "ikar_matra": t.count(ikar & after(t.any("after_ikar"))),
        "ikar_nasal": t.count(ikar & after(t.any("nasal")) & ~before(t.any("nasal_base"))), "halant_ikar": t.count(ikar & before(t.code == 0x94D)), "artifacts": _alternatives(t, artifacts),
        "doublets": t.count_at(second), "explained": t.count_at(second[_explained(t, second, lexemes, suffixes)]),
    }


@lru_cache(64)
def penalty(artifacts: tuple[str, ...], lexemes: tuple[str, ...], suffixes: tuple[str, ...]) -> Callable[[Column], Column]:
    """What the penalty charges, and the doublets that are explained; one function for each set of lists, so that its uses on a text are one call."""

    @F.arrow_udf(struct_of(PENALTY))
    def told(text: pa.Array) -> pa.Array:
        return longs(text, lambda t: penalty_counts(t, artifacts, lexemes, suffixes), PENALTY)

    return told


def _attested(t: Texts, words: Sequence[str]) -> list[np.ndarray]:
    """By word, whether it is a token of a text, dandas at the token's ends not counted."""
    gap, danda, out = t.any("space", "edge"), t.any("danda"), []
    for w in words:
        at = t.find(w) if w else np.zeros(0, np.int64)
        first, last = at - 1, at + len(w)
        while len(at) and (more := danda[first]).any():
            first = first - more
        while len(at) and (more := danda[last]).any():
            last = last + more
        at = at[gap[first] & gap[last]]
        out.append(t.count_at(at) > 0)
    return out


VALIDITY = (*PENALTY, "devanagari", "solid", "stranded")


def _validity(t: Texts, vocabulary: Sequence[str], attested: Sequence[str], *lists: Sequence[str]) -> list[np.ndarray]:
    gap = t.any("letter_gap")
    held = penalty_counts(t, *lists) | {"devanagari": t.count(t.any("devanagari")), "solid": t.lengths - t.count(t.any("blank")), "stranded": t.count(t.any("bracket") & before(gap) & after(gap))}
    return [held[n] for n in VALIDITY] + [t.count_at(t.find(w)) > 0 if w else np.ones(len(t.texts), bool) for w in vocabulary] + _attested(t, attested)


@lru_cache(64)
def validity(vocabulary: tuple[str, ...], attested: tuple[str, ...], *lists: tuple[str, ...]) -> Callable[[Column], Column]:
    """What ``penalty`` gives, with (devanagari, solid, stranded, hits, attested)."""
    kind = struct_of(VALIDITY).add("hits", T.ArrayType(T.BooleanType())).add("attested", T.ArrayType(T.BooleanType()))

    @F.arrow_udf(kind)
    def told(text: pa.Array) -> pa.Array:
        columns = by_piece(text.to_pylist(), lambda t: _validity(t, vocabulary, attested, *lists))
        listed = lambda c: pa.array(np.stack(c, 1).tolist() if c else [[]] * len(text), pa.list_(pa.bool_()))
        n, k = len(VALIDITY), len(VALIDITY) + len(vocabulary)
        return pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:n]], listed(columns[n:k]), listed(columns[k:])], [*VALIDITY, "hits", "attested"], mask=text.is_null())

    return told


# ---- other texts -------------------------------------------------------------------------


@F.arrow_udf(T.StringType())
def collapsed(text: pa.Array) -> pa.Array:
    """As ``patterns.collapsed``: what Python splits at is the same white space."""
    return pa.array([None if t is None else " ".join(t.split()) for t in text.to_pylist()], pa.string())


@lru_cache(64)
def _becomes(source: str, target: str) -> np.ndarray:
    table = np.arange(EDGE, dtype=np.uint32)
    for a, b in reversed(list(zip(source, target, strict=True))):  # the first of equals counts
        table[ord(a)] = ord(b)
    return table


@lru_cache(64)
def substituted(source: str, target: str) -> Callable[[Column], Column]:
    """As ``translate`` with as many characters on either side."""

    @F.arrow_udf(T.StringType())
    def told(text: pa.Array) -> pa.Array:
        return pa.array(substitute(text.to_pylist(), source, target), pa.string())

    return told


def substitute(texts: list[str | None], source: str, target: str) -> list[str | None]:
    table, out, piece, size = _becomes(source, target), [], [], 0
    for i, t in enumerate(texts, 1):
        piece.append(t)
        size += len(t or "")
        if size >= PIECE or i == len(texts):
            joined = "".join(t or "" for t in piece)
            made = table[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].tobytes().decode("utf-32-le")
            at = 0
            for t in piece:
                out.append(None if t is None else made[at : at + len(t)])
                at += len(t or "")
            piece, size = [], 0
    return out


def runs_of(text: str, characters: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of some characters in a text start, and how long they are."""
    found = np.isin(np.frombuffer(text.encode("utf-32-le"), np.uint32), [ord(c) for c in characters])
    turns = np.flatnonzero(np.diff(found, prepend=False, append=False))
    return turns[::2], turns[1::2] - turns[::2]
