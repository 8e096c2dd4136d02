"""Token counts by heap-and-linked-list byte-pair merging.

A piece model ranks the strings it knows.  A text starts as one symbol per character;
the adjacent pair whose concatenation ranks best is merged again and again (leftmost
first on a tie).  Only the *number* of tokens is wanted, so no identifier is ever
produced: the count is the initial symbols less the merges.

Two facts about a vocabulary make this fast without changing any result.  If no piece
holds a non-space followed by a space marker, merges never cross a word start; and if
two neighbouring characters occur in no piece side by side, merges never cross between
them.  Both are computed from the vocabulary when it is loaded.  Words repeat, so their
counts are remembered (in a bounded table, emptied when full).

Defined results: null and empty texts have 0 tokens; ties go left; repeated rows are
counted each; an empty table gives an empty table; other columns are kept as they are.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each, worker_state

SPACE = "▁"
BITS = 40
POSITION = (1 << BITS) - 1


class PieceCounter:
    """Counts the pieces a BPE piece model cuts a text into."""

    def __init__(self, model_path: str, remembered: int = 600_000, word_chars: int = 48):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        kind = pb.ModelProto.SentencePiece
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != pb.TrainerSpec.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("a BPE piece model with byte fallback and leading space markers is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("piece models that rewrite characters are not supported")
        self.dummy = norm.add_dummy_prefix
        score: dict[str, float] = {}
        self.fixed: list[str] = []
        for p in proto.pieces:
            if p.type == kind.UNUSED:
                raise ValueError("models with unused pieces are not supported")
            if p.type == kind.USER_DEFINED:
                self.fixed.append(p.piece)
            elif p.type == kind.NORMAL:
                score[p.piece] = p.score
        order = {x: i for i, x in enumerate(sorted(set(score.values()), reverse=True))}
        #: pieces of one score share a rank
        self.rank: dict[str, int] = {p: order[x] for p, x in score.items()}
        #: every character inside a piece is a piece itself, so what cannot be a symbol is never merged
        self.closed = all(c in self.rank for p in self.rank for c in p)
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.by_word = not self.fixed and not any(a != SPACE and b == SPACE for a, b in self.pairs)
        self.fixed_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.fixed, key=len, reverse=True))) + ")") if self.fixed else None
        self.words = _Remembered(self._chunk, SPACE, remembered, word_chars)
        self.parts = _Remembered(self.merge, "", remembered, word_chars)

    def cost(self, symbol: str) -> int:
        """Tokens a final symbol stands for: itself, or its bytes if the model has no such character."""
        return 1 if symbol in self.rank else len(symbol.encode())

    def merge(self, text: str) -> int:
        """Heap and linked list: pop the best adjacent pair until none is left.

        A heap entry is one integer, rank above position, so ties go left.  An entry is
        stale when the pair that now starts at its position has another rank.
        """
        n = len(text)
        if n == 1:
            return self.cost(text)
        get, low = self.rank.get, POSITION
        heap = [(r << BITS) + i for i in range(n - 1) if (r := get(text[i : i + 2])) is not None]
        if not heap:
            return n if self.closed else sum(map(self.cost, text))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        symbols = [*text, ""]  # what has been merged away, and the end, is empty
        after, before = list(range(1, n + 2)), list(range(-1, n))
        merges = extra = 0
        while heap:
            entry = pop(heap)
            i = entry & low
            left = symbols[i]
            if not left:
                continue
            j = after[i]
            right = symbols[j]
            both = left + right
            if not right or get(both) != entry >> BITS:
                continue
            merges += 1
            if not self.closed:
                extra += self.cost(left) + self.cost(right) - 2
            symbols[i], symbols[j] = both, ""
            after[i] = k = after[j]
            before[k] = i
            nxt = symbols[k]
            if nxt and (r := get(both + nxt)) is not None:
                push(heap, (r << BITS) + i)
            h = before[i]
            if h >= 0 and (r := get(symbols[h] + both)) is not None:
                push(heap, (r << BITS) + h)
        return (n if self.closed else sum(map(self.cost, text))) - merges - extra

    def _chunk(self, text: str) -> int:
        """Cuts between characters that no piece holds side by side; the parts are independent."""
        pairs, parts, start, total = self.pairs, self.parts, 0, 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in pairs:
                total += parts[text[start:i]]
                start = i
        return total + parts[text[start:]] if start else self.parts[text]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.fixed_pattern is not None:
            marked = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
            cut = self.fixed_pattern.split(marked)
            return sum(1 if i % 2 else self._chunk(part) for i, part in enumerate(cut) if part)
        if not self.by_word or not self.dummy:
            return self._chunk((SPACE if self.dummy else "") + text.replace(" ", SPACE))
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            marked = SPACE + text.replace(" ", SPACE)
            # a run of markers and the word after it belong together
            return sum(map(self._chunk, re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)))
        return sum(map(self.words.__getitem__, text.split(" ")))


class _Remembered(dict):
    """A bounded memo: emptied when full, and never holding strings that are long."""

    def __init__(self, make, prefix: str, most: int, chars: int):
        super().__init__()
        self.make, self.prefix, self.most, self.chars = make, prefix, most, chars

    def __missing__(self, key: str) -> int:
        value = self.make(self.prefix + key)
        if len(key) <= self.chars:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def piece_counter(model_path: str) -> PieceCounter:
    """One counter for a model in each Python worker."""
    return worker_state(("pieces", model_path), lambda: PieceCounter(model_path))


def count_tokens(df: DataFrame, model_path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Adds ``into``: the tokens of each whole ``text`` (null: 0).

    The model is read by path on every executor.  A column that is already called
    ``into`` is replaced.
    """
    rest = [c for c in df.columns if c != into]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(into, T.LongType())])
    at = rest.index(text)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_path)
        for b in batches:
            n = pa.array([counter.count(t) for t in each(b.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], [*b.schema.names, into])

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(counted, schema)


def over_limit(df: DataFrame, limit: int, tokens: str = "n_tokens") -> DataFrame:
    return df.withColumn("over_limit", F.col(tokens) > F.lit(limit))
