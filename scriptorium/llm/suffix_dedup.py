"""Exact long-repeat removal with a logarithmic family of suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere else in the
corpus is removed.  Judging every such string (a *window*) of a corpus by a suffix array
over all of it would need many times the corpus in space, so windows are first sorted
out by content:

1. Documents are read in *batches* of bounded bytes.  Each window belongs to one *anchor*:
   of its k-grams the one with the least hash (the rightmost on a tie).  Equal windows
   have equal anchors at equal offsets, so windows with different anchors never need to
   meet.  Neighbouring windows share anchors: about one anchor in 85 bytes.  A batch
   gives its anchors as one sorted array, in which anchors with equal surroundings (the
   text of all their windows) are one *class*, with their number.
2. The sorted arrays of all batches meet, dealt by k-gram.  A k-gram that occurs once:
   none of its windows repeats.  A class that occurs twice: all do (this settles the
   inside of long repeats and all copies).  What is left are anchors at the edges of
   repeats.  No step has a row for each occurrence: a batch has one for each class, so
   what copies cost follows from batches, not from copies.
3. The windows of those are judged by suffix arrays.  They are dealt by k-gram; in each
   task they come in batches, each batch gets a sorted suffix array, is merge-scanned
   against the existing levels for full-length matches, and then becomes a level itself;
   two levels of one size are merged into one of twice the size.
4. K-grams with very many different surroundings would make one task's family too large.
   Their windows are dealt by more text: first in blocks of neighbouring windows by what
   all of a block have in common, and of blocks with a partner each window by itself.
   Equal windows still meet in one family, and any number of tasks can share a k-gram.

Rows are told apart by batch and place, never by key, so null or repeated keys change
nothing.  Batches are written to the shared folder once, so a lost task or executor
repeats only its own part.

Defined results: texts are UTF-8, null is empty, texts shorter than ``length`` lose
nothing, texts of any length are judged whole (a text is never split between batches);
overlaps count, also within one text; strings are judged on the input; repeated rows
repeat each other; an empty table gives an empty table; columns of the input are kept,
except the text and those that have the name of a result.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, each, worker_state, written

GRAM = 32
MIX = 0x9E3779B97F4A7C15  # an odd constant: 2^64 over the golden ratio
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Sizes:
    """Bounds on what a task holds; results do not depend on them."""

    batch_bytes: int = 2_000_000  # of text in a batch (a longer text is a batch of its own)
    batch_windows: int = 40_000  # in a batch that gets a suffix array
    judged_together: int = 2500  # surroundings dealt to a task (about 75 windows each), which bounds its index family
    crowded: int = 1024  # surroundings of a k-gram from which its windows are dealt by more text
    block: int = 8  # windows in a block then
    hot_least: int = 8  # a k-gram with so many classes in a batch ..
    hot_share: int = 4096  # .. and one of so many classes there is dealt by class, ..
    hot: int = 1 << 16  # .. so many k-grams at most


def gram_hashes(data: bytes, k: int = GRAM) -> np.ndarray:
    """A hash of each k-gram (k a power of two), by doubling."""
    x, m, s = _BYTES[np.frombuffer(data, np.uint8)], MIX, 1
    while s < k:
        x = x[:-s] * np.uint64(m) + x[s:]
        m = m * m & (1 << 64) - 1
        s *= 2
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(32))


def least_positions(x: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` values, where its least one stands (the rightmost)."""
    at = np.arange(len(x), dtype=np.int32)

    def pick(at: np.ndarray, y: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        right = y[step:] <= y[:-step]
        return np.where(right, at[step:], at[:-step]), np.where(right, y[step:], y[:-step])

    y, width = x, 1
    while width * 2 <= window:
        at, y = pick(at, y, width)
        width *= 2
    return pick(at, y, window - width)[0] if window > width else at


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, number of windows, digest of the windows' text) of each anchor; their windows follow each other."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none
    h = gram_hashes(data)
    owner = least_positions(h, length - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    count = np.diff(np.append(first, len(owner)))
    place = owner[first]
    digests = [xxhash.xxh3_64_intdigest(data[a : a + n - 1 + length], p - a) for a, n, p in zip(first.tolist(), count.tolist(), place.tolist(), strict=True)]
    return h[place].view(np.int64), count, np.array(digests, np.uint64).view(np.int64)


class Level:
    """A sorted suffix array with the first ``length`` bytes of each suffix beside it; equal windows are one entry."""

    def __init__(self, suffixes: np.ndarray, seen: np.ndarray):
        self.suffixes = suffixes  # sorted, distinct
        self.seen = seen  # an occurrence (its place in the task's list)

    def __len__(self) -> int:
        return len(self.suffixes)


class IndexFamily:
    """The levels of one task; ``repeats`` tells of each window that came in whether it repeats."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[Level] = []
        self.repeats: list[np.ndarray] = []
        self.total = 0

    def add(self, texts: list[bytes]) -> None:
        """A batch: all windows of each text, in order."""
        batch, group, repeat = suffix_array(texts, self.length)
        batch.seen = batch.seen + self.total
        self.repeats.append(repeat)
        self.total += len(repeat)
        for level in self.levels:  # merge-scan: both are sorted
            at = np.minimum(np.searchsorted(level.suffixes, batch.suffixes), len(level) - 1)
            same = level.suffixes[at] == batch.suffixes
            repeat |= same[group]
            self._mark(level.seen[at[same]])
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self._merge()

    def _mark(self, seen: np.ndarray) -> None:
        """The occurrences that stood in a level for their window repeat too."""
        ends = np.cumsum([len(r) for r in self.repeats])
        which = np.searchsorted(ends, seen, side="right")
        for k in np.unique(which):
            self.repeats[k][seen[which == k] - (ends[k] - len(self.repeats[k]))] = True

    def _merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        both, seen = np.concatenate([a.suffixes, b.suffixes]), np.concatenate([a.seen, b.seen])
        order = np.argsort(both, kind="stable")
        both, seen = both[order], seen[order]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        self.levels.append(Level(both[new], seen[new]))


def suffix_array(texts: list[bytes], length: int) -> tuple[Level, np.ndarray, np.ndarray]:
    """All windows of the texts as a level; the place in it of each window; and which windows repeat among them."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([np.arange(o, o + n - length + 1) for o, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True)])
    windows = np.lib.stride_tricks.sliding_window_view(flat, length)[starts].view(f"S{length}").ravel()
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.empty(len(starts), np.int64)
    group[order] = np.cumsum(new) - 1
    repeat = np.zeros(len(starts), bool)
    repeat[order] = ~new | np.append(~new[1:], False)
    return Level(ranked[new], order[new]), group, repeat


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


# ---- batches ----------------------------------------------------------------------------

CLASS = "batch long, gram long, digest long, cls int, n int"
HELD = ["blob", "sizes", "counts", "owners", "windows"]
AROUND = [("gram", pa.int64()), ("single", pa.bool_()), ("crowded", pa.bool_()), ("batch", pa.int64()), ("doc", pa.int32()), ("first", pa.int32()), ("text", pa.binary())]
AROUND_SCHEMA = "gram long, single boolean, crowded boolean, batch long, doc int, first int, text binary"
SPAN = [("batch", pa.int64()), ("doc", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]
SPAN_SCHEMA = "batch long, doc int, start int, stop int"


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _batched(length: int, sizes: Sizes):
    """(row, text) -> one row per batch of documents, one per class of its anchors, and one per k-gram that may be hot."""
    names = ["batch", "gram", "digest", "cls", "n", "rows", *HELD]

    def filled(size: int, rows_type: pa.DataType, **given) -> pa.RecordBatch:
        types = {"batch": pa.int64(), "gram": pa.int64(), "digest": pa.int64(), "cls": pa.int32(), "n": pa.int32(), "rows": pa.list_(rows_type)} | {c: pa.binary() for c in HELD}
        return pa.RecordBatch.from_arrays([given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], types[c]) if c in given else pa.nulls(size, types[c]) for c in names], names)

    def sealed(batch: int, rows: list[pa.Array], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = [anchors(t, length) for t in texts]
        grams, windows, digests = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((digests, grams))
        g, d = grams[order], digests[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])[: len(g)]
        owners = np.empty(len(g), np.uint32)
        owners[order] = np.cumsum(new) - 1
        rows = pa.concat_arrays(rows)
        held = [
            pa.compress(b"".join(texts), codec="zstd", asbytes=True), np.array([len(t) for t in texts], np.uint32).tobytes(),
            np.array([len(f[0]) for f in found], np.uint32).tobytes(), owners.tobytes(), windows.astype(np.uint32).tobytes(),
        ]
        yield filled(1, rows.type, batch=[batch], rows=pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), **{c: [x] for c, x in zip(HELD, held, strict=True)})
        if not len(g):
            return
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(g))).astype(np.int32)
        g, d = g[at], d[at]
        yield filled(len(at), rows.type, batch=np.full(len(at), batch), gram=g, digest=d, cls=np.arange(len(at), dtype=np.int32), n=n)
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        classes = np.diff(np.append(first, len(g)))
        many = classes >= max(sizes.hot_least, len(g) // sizes.hot_share)
        if many.any():
            yield filled(int(many.sum()), rows.type, batch=np.full(many.sum(), batch), gram=g[first[many]], n=classes[many].astype(np.int32))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("batches", length), object)  # lets go of what another operator has remembered
        batch, rows, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            from_row = 0
            for i, text in enumerate(each(b.column(1).cast(pa.binary()))):
                texts.append(text)
                held += len(text)
                if held >= sizes.batch_bytes:
                    yield from sealed(batch, [*rows, b.column(0).slice(from_row, i + 1 - from_row)], texts)
                    batch, rows, texts, held, from_row = batch + 1, [], [], 0, i + 1
            if from_row < b.num_rows:
                rows.append(b.column(0).slice(from_row))
        if texts:
            yield from sealed(batch, rows, texts)

    return made


class _Held:
    """A batch as it was written: its documents, and where the windows of its anchors stand."""

    def __init__(self, row: pa.Table):
        one = {c: row.column(c)[0].as_py() for c in HELD}
        self.sizes = np.frombuffer(one["sizes"], np.uint32).astype(np.int64)
        self.data = pa.decompress(one["blob"], int(self.sizes.sum()), codec="zstd", asbytes=True) if self.sizes.sum() else b""
        self.at = np.cumsum(self.sizes) - self.sizes  # where each document starts
        self.owners = np.frombuffer(one["owners"], np.uint32)  # the class of each anchor
        self.windows = np.frombuffer(one["windows"], np.uint32).astype(np.int64)
        counts = np.frombuffer(one["counts"], np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(counts)), counts)  # the document of each anchor
        before = np.cumsum(self.windows) - self.windows
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.first = before - np.repeat(before[starts[counts > 0]], counts[counts > 0])  # its first window there


def _cut(length: int):
    """Batches with their classes to be judged -> the text around one anchor of each class."""

    def cut(batch: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = []
        if batch.num_rows and wanted.num_rows:
            held, name = _Held(batch), batch.column("batch")[0].as_py()
            classes, where = np.unique(held.owners, return_index=True)
            place = dict(zip(classes.tolist(), where.tolist(), strict=True))
            for cls, gram, single, crowded in zip(*(wanted.column(c).to_pylist() for c in ("cls", "gram", "single", "crowded")), strict=True):
                k = place[cls]
                doc, first = int(held.doc[k]), int(held.first[k])
                start = int(held.at[doc]) + first
                rows.append((gram, single, crowded, name, doc, first, held.data[start : start + int(held.windows[k]) - 1 + length]))
        return pa.Table.from_batches([_table(rows, AROUND)])

    return cut


# ---- judging ----------------------------------------------------------------------------


def _judged(length: int, sizes: Sizes):
    """Windows dealt by content -> spans of those that repeat, by a family of suffix arrays."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, owners, texts, held = IndexFamily(length), [], [], 0
        for b in batches:
            for single, batch, doc, first, text in zip(*(b.column(c).to_pylist() for c in ("single", "batch", "doc", "first", "text")), strict=True):
                owners.append((single, batch, doc, first, len(text) - length + 1))
                texts.append(text)
                held += len(text) - length + 1
                if held >= sizes.batch_windows:
                    family.add(texts)
                    texts, held = [], 0
        if texts:
            family.add(texts)
        flags = np.concatenate(family.repeats) if family.repeats else np.zeros(0, bool)
        rows, at = [], 0
        for single, batch, doc, first, n in owners:
            if single:  # the others are known to repeat; they only lend their windows
                rows += [(batch, doc, first + a, first + e - 1 + length) for a, e in _runs(flags[at : at + n])]
            at += n
            if len(rows) > 10_000:
                yield _table(rows, SPAN)
                rows = []
        if rows:
            yield _table(rows, SPAN)

    return judged


def _blocks(length: int, size: int):
    """Surroundings -> runs of at most ``size`` neighbouring windows, by a digest of what all windows of the block share.

    A block is told by the distance of its windows from the anchor, which equal windows
    have in common, so equal windows are in blocks with equal digests.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for single, batch, doc, first, text in zip(*(b.column(c).to_pylist() for c in ("single", "batch", "doc", "first", "text")), strict=True):
                n = len(text) - length + 1
                place = int(least_positions(gram_hashes(text[:length]), length - GRAM + 1)[0])
                for k in range((place - n + 1) // size, place // size + 1):
                    last = place - k * size  # the block's last window in the text, if it is there
                    start, stop = max(0, last - size + 1), min(n - 1, last)
                    shared = text[last : last - size + 1 + length]
                    rows.append((xxhash.xxh3_64_intdigest(shared, k) - (1 << 63), single, True, batch, doc, first + start, text[start : stop + length]))
                if len(rows) > 10_000:
                    yield _table(rows, AROUND)
                    rows = []
            yield _table(rows, AROUND)

    return made


def _single_windows(length: int):
    """Blocks -> their windows one by one, by digest; those that repeat in one run of rows as spans already, and one of them to meet the rest."""
    fields = [*AROUND, ("stop", pa.int32())]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                texts = part.column("text").to_pylist()
                level, group, repeat = suffix_array(texts, length)
                stands = np.zeros(len(repeat), bool)
                stands[level.seen] = True
                rows, at = [], 0
                for single, batch, doc, first, text in zip(*(part.column(c).to_pylist() for c in ("single", "batch", "doc", "first")), texts, strict=True):
                    n = len(text) - length + 1
                    known = repeat[at : at + n]
                    if single:
                        rows += [(0, True, True, batch, doc, first + a, None, first + e - 1 + length) for a, e in _runs(known)]
                    for k in np.flatnonzero(stands[at : at + n]).tolist():
                        window = text[k : k + length]
                        rows.append((xxhash.xxh3_64_intdigest(window) - (1 << 63), single and not known[k], True, batch, doc, first + k, window, None))
                    at += n
                yield _table(rows, fields)

    return made


def _verdicts(batches: DataFrame, sizes: Sizes) -> DataFrame:
    """(batch, cls, gram, repeated, judge, single, crowded) of the classes whose k-gram occurs again.

    Dealt by k-gram, and those of hot k-grams by class: they occur again in any case.
    """
    hot = batches.filter("gram IS NOT NULL AND digest IS NULL").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(sizes.hot)
    classes = batches.filter("digest IS NOT NULL").select("batch", "gram", "digest", "cls", "n").join(F.broadcast(hot.select("gram", F.lit(True).alias("hot"))), "gram", "left")
    dealt = classes.withColumn("salt", F.expr("CASE WHEN hot THEN digest END")).repartition("gram", "salt")
    same, alike = "OVER (PARTITION BY gram, salt, digest)", "OVER (PARTITION BY gram, salt)"
    counted = dealt.select("*", F.expr(f"sum(n) {same}").alias("all"), F.expr(f"min(batch) {same}").alias("from"))
    met = counted.select(
        "*", F.expr(f"sum(n) {alike}").alias("total"), F.expr(f"sum(CAST(`all` = 1 AS INT)) {alike}").alias("singles"), F.expr(f"sum(CAST(`from` = batch AS INT)) {alike}").alias("members")
    )
    hot_gram = F.coalesce("hot", F.lit(False))
    return met.filter(hot_gram | (F.col("total") > 1)).select(
        "batch", "cls", "gram", (F.col("all") > 1).alias("repeated"), ((F.col("from") == F.col("batch")) & (hot_gram | (F.col("singles") > 0))).alias("judge"),
        (F.col("all") == 1).alias("single"), (hot_gram | (F.col("members") > sizes.crowded)).alias("crowded"),
    )


def _families(around: DataFrame, length: int, sizes: Sizes, windows: int = 1) -> DataFrame:
    tasks = max(1, math.ceil(around.count() / (sizes.judged_together * windows)))
    return around.repartition(tasks, "gram").mapInArrow(_judged(length, sizes), SPAN_SCHEMA)


def _spans(batches: DataFrame, verdicts: DataFrame, length: int, sizes: Sizes) -> DataFrame:
    """The ranges that the families find, at the edges of repeats."""
    held = batches.filter("blob IS NOT NULL").select("batch", *HELD)
    wanted = verdicts.filter("judge").select("batch", "cls", "gram", "single", "crowded")
    around = written(held.groupBy("batch").cogroup(wanted.groupBy("batch")).applyInArrow(_cut(length), AROUND_SCHEMA), "around")
    plain = _families(around.filter("NOT crowded"), length, sizes)
    blocks = written(around.filter("crowded").mapInArrow(_blocks(length, sizes.block), AROUND_SCHEMA), "blocks")  # made once, read twice
    often = blocks.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    partnered = blocks.join(often, "gram", "left_semi").repartition("batch", "doc", "first")  # spread again, whatever they share
    met = written(partnered.mapInArrow(_single_windows(length), AROUND_SCHEMA + ", stop int"), "met")
    dropped(blocks)
    split = _families(met.filter("text IS NOT NULL"), length, sizes, windows=64)
    spans = plain.unionByName(met.filter("text IS NULL").select("batch", "doc", F.col("first").alias("start"), "stop")).unionByName(split)
    # families are many and short: their few spans are gathered first, as each file that a task writes costs its executor a process
    out = written(spans.hint("rebalance"), "spans")
    dropped(around)
    dropped(met)
    return out


# ---- removal ----------------------------------------------------------------------------


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, stop in spans:
        kept.append(data[at:start])
        at = stop
    return b"".join([*kept, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans shrunk to whole UTF-8 characters."""
    out = []
    for start, stop in spans:
        while start < stop and data[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        if start < stop:
            out.append((start, stop))
    return out


def _removed(length: int, added: list[tuple[str, pa.DataType]]):
    """Batches with their repeated classes and spans -> their rows with what is left of each text."""

    def removed(batch: pa.Table, found: pa.Table) -> pa.Table:
        held = _Held(batch)
        change = np.zeros(len(held.data) + 1, np.int32)
        if found.num_rows:
            cls, doc, start, stop = (found.column(c).to_numpy() for c in ("cls", "doc", "start", "stop"))
            known = np.zeros(int(held.owners.max(initial=0)) + 1, bool)
            known[cls[~np.isnan(cls)].astype(np.int64)] = True
            hit = np.flatnonzero(known[held.owners])
            begin = held.at[held.doc[hit]] + held.first[hit]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + held.windows[hit] - 1 + length, -1)
            one = ~np.isnan(doc)
            base = held.at[doc[one].astype(np.int64)]
            np.add.at(change, base + start[one].astype(np.int64), 1)
            np.add.at(change, base + stop[one].astype(np.int64), -1)
        covered = np.cumsum(change[:-1]) > 0
        rows = []
        for a, n in zip(held.at.tolist(), held.sizes.tolist(), strict=True):
            data, cuts = held.data[a : a + n], list(_runs(covered[a : a + n]))
            kept = without(data, cuts)
            rows.append((n, n - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), without(data, whole_characters(data, cuts)).decode()))
        given = batch.column("rows").combine_chunks().flatten()
        made = _table(rows, added)
        return pa.Table.from_arrays([given, *made.columns], ["row", *made.schema.names])

    return removed


def _nullable(of: T.DataType) -> T.DataType:
    """The type with nulls allowed throughout, as they come out of a written table."""
    made = T.StructType([T.StructField("c", of)]).json()
    for name in ("nullable", "containsNull", "valueContainsNull"):
        made = made.replace(f'"{name}":false', f'"{name}":true')
    return T.StructType.fromJson(json.loads(made))["c"].dataType


def dedupe_substrings(df: DataFrame, text: str = "text", length: int = 200, sizes: Sizes = Sizes()) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256 (exact bytes) and kept_text (whole characters) to each row of ``df``."""
    added = [("n_bytes", T.LongType(), pa.int64()), ("n_removed", T.LongType(), pa.int64()), ("n_spans", T.LongType(), pa.int64()), ("kept_sha256", T.StringType(), pa.string()), ("kept_text", T.StringType(), pa.string())]
    rest = [c for c in df.columns if c not in {n for n, *_ in added} and c != text]
    spare = "_" * (1 + max(map(len, rest), default=0))  # a struct has a field at least
    row = F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(True).alias(spare)).alias("row")
    given = df.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    of_row = _nullable(given.schema["row"].dataType)
    schema = T._parse_datatype_string(CLASS).add("rows", T.ArrayType(of_row))
    for c in HELD:
        schema = schema.add(c, T.BinaryType())
    batches = written(given.mapInArrow(_batched(length, sizes), schema), "batches", **{"parquet.block.size": 16 << 20})
    verdicts = written(_verdicts(batches, sizes), "verdicts")
    spans = _spans(batches, verdicts, length, sizes)
    none = F.lit(None).cast("int")
    known = verdicts.filter("repeated").select("batch", "cls", none.alias("doc"), none.alias("start"), none.alias("stop"))
    found = known.unionByName(spans.select("batch", none.alias("cls"), "doc", "start", "stop"))
    held = batches.filter("blob IS NOT NULL").select("batch", "rows", *HELD)
    out = held.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_removed(length, [(n, t) for n, _, t in added]), T.StructType([T.StructField("row", of_row), *[T.StructField(n, t) for n, t, _ in added]]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], *[n for n, *_ in added])
