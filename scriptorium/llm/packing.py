"""Packing token streams into fixed windows by non-negative least squares.

Whole windows of long documents become sequences at once.  What remains of each document
(fewer tokens than a window) goes into a shard of bounded size.  For a shard, the
combinations of at most three lengths that fill a window are enumerated (in units of a
few tokens), the number of times each is used is solved by non-negative least squares
against the histogram of the remaining lengths, the solution is rounded and carried out,
and the residual pieces are packed greedily, cut wherever a window is full.  Only the
planned sequences (by less than a unit a piece) and the last one of a shard have padding.

Shards are runs of consecutive rows of an input partition, so packing needs no shuffle,
memory is bounded by the shard, and a lost task is simply run again; sequences are
numbered by partition.  A caller whose rows come straight from a shuffle should write
them first (as the pipeline does), for a partition's order to be the same each time.

Defined results: a null or empty text is just the end token; repeated rows are packed
each; an empty table gives an empty table; long texts are never truncated.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each, worker_state

PARTS = 3  # lengths in a combination


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next after 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_CHARACTERS = _byte_characters()


def combinations(units: int) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c >= 0 and a + b + c = units: what fills a window."""
    a, b = np.meshgrid(np.arange(units + 1), np.arange(units + 1), indexing="ij")
    c = units - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nonnegative_least_squares(columns: np.ndarray, target: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Active-set solution of min |A x - target|, x >= 0; column j of A counts the entries of ``columns[j]`` (0: none).

    Several columns enter at once; any x that is returned is feasible, and what it
    leaves uncovered is packed greedily.
    """
    m = len(target)
    n = len(columns)
    dense = np.zeros((n, m))
    for k in range(columns.shape[1]):
        used = columns[:, k] > 0
        np.add.at(dense, (np.flatnonzero(used), columns[used, k] - 1), 1.0)
    x = np.zeros(n)
    active = np.zeros(n, bool)
    tolerance = 1e-6 * max(1.0, np.abs(target).max(initial=0.0))
    for _ in range(rounds):
        gradient = dense @ (target - x @ dense)
        gradient[active] = -np.inf
        enter = np.argsort(-gradient)[: max(1, m // 16)]
        enter = enter[gradient[enter] > tolerance]
        if not len(enter):
            break
        active[enter] = True
        while active.any():
            at = np.flatnonzero(active)
            a = dense[at]
            solved = np.linalg.solve(a @ a.T + 1e-8 * np.eye(len(at)), a @ target)
            if (solved > 0).all():
                x[:] = 0
                x[at] = solved
                break
            low = solved <= 0
            old = x[at]
            step = np.min(np.where(low, old / np.maximum(old - solved, 1e-300), np.inf))
            moved = old + min(1.0, step) * (solved - old)
            gone = low & (moved <= 1e-9)
            if not gone.any():
                gone = low & (moved == moved[low].min())
            x[at] = np.where(gone, 0.0, np.maximum(moved, 0.0))
            active[at[gone]] = False
    return x


def plan(lengths: np.ndarray, window: int, unit: int) -> tuple[list[list[int]], list[int]]:
    """Sequences as lists of positions in ``lengths`` by the solved combinations, and the positions left over."""
    units = window // unit
    bins = -(-lengths // unit)
    histogram = np.bincount(bins, minlength=units + 1)[1:].astype(float)
    choices = combinations(units)
    present = np.concatenate([[True], histogram > 0])
    choices = choices[present[choices].all(axis=1)]
    repeats = np.rint(nonnegative_least_squares(choices, histogram)).astype(int) if len(choices) else np.zeros(0, int)
    waiting: list[list[int]] = [[] for _ in range(units + 1)]
    for i in range(len(bins) - 1, -1, -1):
        waiting[bins[i]].append(i)
    sequences = []
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] <= 0:
            break
        parts = [int(p) for p in choices[j] if p]
        need = {p: parts.count(p) for p in parts}
        for _ in range(min(int(repeats[j]), *(len(waiting[p]) // k for p, k in need.items()))):
            sequences.append([waiting[p].pop() for p in parts])
    return sequences, sorted(i for w in waiting for i in w)


class WordTokens:
    """Token ids of whole texts by a ``tokenizers`` file, remembered word by word.

    Words here are what spaces and line feeds separate; that these never share a token is
    a property of tokenizers that drop white space, which is checked on construction.
    """

    #: an NFC word in lower case, and marks after it: the two are separate to the tokenizer
    SPLIT = re.compile(r"([a-zß-öø-ÿœ]+)([^a-z0-9\s'ß-ÿœ\u0080-￿\U00010000-\U0010ffff]*)")

    def __init__(self, path: str, remembered: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = remembered
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}
        probe = "It's <b> a ,B\n12 cd! Ünï ."
        if b"".join(self.encode(w) for w in re.split("[ \n]", probe)) != self.encode(probe):
            raise ValueError("this tokenizer does not treat words apart")
        # words of letters and marks may skip the normaliser and go to the merges by their bytes, if that gives the same ids
        probes = ["abc!!", "the", "naïve.", "straßenöü", "ABc&&&", "œuvre", "xyzzyq###!?", "é"]
        self.splits = all(b"".join(map(self._merged, self.SPLIT.fullmatch(w.lower()).groups())) == self.encode(w) for w in probes)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, part: str) -> bytes:
        """Ids of a run of letters or of marks straight from the merges."""
        if not part:
            return b""
        return np.array([t.id for t in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(BYTE_CHARACTERS))], "<u4").tobytes()

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for t in texts:
            yield self.text(t or "")

    def text(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self._learn(words)
            return b"".join([x if (x := self.words.get(w)) is not None else self.encode(w) for w in words])

    def _learn(self, words: list[str]) -> None:
        if len(self.words) > self.most:
            self.words = {"": b""}
        if len(self.parts) > self.most:
            self.parts = {"": b""}
        new = {w for w in words if w not in self.words and len(w) <= 64}
        split = {w: m.groups() for w in new if (m := self.SPLIT.fullmatch(w.lower())) is not None and "<|" not in w} if self.splits else {}
        for p in {p for pair in split.values() for p in pair}:
            if p not in self.parts:
                self.parts[p] = self._merged(p)
        rest = [w for w in new - split.keys() if w not in self.parts]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.parts[w] = np.array(e.ids, "<u4").tobytes()
        for w in new:
            self.words[w] = self.parts[split[w][0]] + self.parts[split[w][1]] if w in split else self.parts[w]


def word_tokens(path: str) -> WordTokens:
    return worker_state(("words", path), lambda: WordTokens(path))


class Packer:
    """Packs one partition's documents; rows come out shard by shard."""

    def __init__(self, window: int, unit: int, end_id: int, shard_pieces: int, shard_tokens: int, first_sequence: int):
        self.window, self.unit = window, unit
        self.end = np.array([end_id], "<u4").tobytes()
        self.shard_pieces, self.shard_tokens = shard_pieces, shard_tokens
        self.sequence = first_sequence
        self.rows: list[tuple] = []  # doc, start, ids, doc_tokens, sequence, offset
        self.held: list[tuple] = []  # doc, start, ids, doc_tokens
        self.held_tokens = 0

    def add(self, doc, ids: bytes) -> None:
        ids += self.end
        n, full = len(ids) // 4, self.window * 4
        whole = len(ids) // full
        for k in range(whole):
            self.rows.append((doc, k * self.window, ids[k * full : (k + 1) * full], n, self.sequence, 0))
            self.sequence += 1
        if len(ids) > whole * full:
            self.held.append((doc, whole * self.window, ids[whole * full :], n))
            self.held_tokens += n - whole * self.window
            if len(self.held) >= self.shard_pieces or self.held_tokens >= self.shard_tokens:
                self.flush()

    def flush(self) -> None:
        held, self.held, self.held_tokens = self.held, [], 0
        if not held:
            return
        lengths = np.array([len(ids) // 4 for _, _, ids, _ in held])
        sequences, rest = plan(lengths, self.window, self.unit)
        for members in sequences:
            offset = 0
            for i in members:
                doc, start, ids, n = held[i]
                self.rows.append((doc, start, ids, n, self.sequence, offset))
                offset += len(ids) // 4
            self.sequence += 1
        offset = 0
        for i in rest:
            doc, start, ids, n = held[i]
            while ids:
                take = min(len(ids) // 4, self.window - offset)
                self.rows.append((doc, start, ids[: 4 * take], n, self.sequence, offset))
                ids, start, offset = ids[4 * take :], start + take, offset + take
                if offset == self.window:
                    self.sequence, offset = self.sequence + 1, 0
        if offset:
            self.sequence += 1


def pack(df: DataFrame, tokenizer_path: str, doc: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1, unit: int = 8,
         shard_pieces: int = 20_000, shard_tokens: int = 20_000_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: where a run of a document's ids stands in which sequence.

    Columns: the document's key, start and length (in its ids), ids_crc32 (of the ids as
    little-endian 32-bit), doc_tokens, sequence_id, offset, and with ``with_ids`` the ids
    themselves as such bytes.
    """
    key = df.schema[doc]
    fields = [T.StructField(doc, key.dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType(fields + ([T.StructField("ids", T.BinaryType())] if with_ids else []))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer_path)
        packer = Packer(window, unit, end_id, shard_pieces, shard_tokens, TaskContext.get().partitionId() << 40)
        key_type = None

        def out(least: int) -> Iterator[pa.RecordBatch]:
            while len(packer.rows) > least:
                rows, packer.rows = packer.rows[:8192], packer.rows[8192:]
                docs, starts, ids, totals, sequences, offsets = zip(*rows, strict=True)
                columns = [pa.array(docs, key_type), *(pa.array(x, pa.int64()) for x in (starts, [len(i) // 4 for i in ids], map(zlib.crc32, ids), totals, sequences, offsets))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), schema.names)

        for b in batches:
            key_type = b.schema.field(0).type
            for d, ids in zip(b.column(0).to_pylist(), words.texts(each(b.column(1))), strict=True):
                packer.add(d, ids)
                yield from out(8192)
        packer.flush()
        yield from out(0)

    return df.select(F.col(f"`{doc}`"), F.col(f"`{text}`")).mapInArrow(packed, schema)
