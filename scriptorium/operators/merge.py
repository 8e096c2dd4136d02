"""Merging two extractions of one page, and choosing the best text of a line."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import batches as B
from ..functions import metrics as M

LINE = ("doc_id", "page_number", "block_number", "line_number")


def charges(texts: list[str]) -> tuple[list[int], list[bool]]:
    """The penalty of each text, and whether it holds any sign that only damage leaves."""

    def measure(t: B.Texts) -> list[np.ndarray]:
        held = B.penalty_counts(t, M.ARTIFACTS.split("|"), M.DOUBLED_LEXEMES, M.STEM_SUFFIXES)
        severe = sum(held[c] for c in ("replacement", "private", "invalid", "prefix_ikar", "ikar_matra", "ikar_nasal", "halant_ikar")) > 0
        return [M.charged(held, held["doublets"] - held["explained"]), severe]

    cost, severe = B.by_piece(texts, measure)
    return cost.tolist(), severe.tolist()


def best_texts(original: list[str], repaired: list[str]) -> list[str]:
    """For each pair the text that reads best: repaired, original, or the better token at each place (the repaired one on a tie).

    The last only competes if either side is noisy and both have as many tokens.  Least
    penalty wins, then that order.
    """
    n = len(original)
    cost, severe = charges(original + repaired)
    tokens = {}
    for i in range(n):
        if severe[i] or severe[n + i]:
            a, b = original[i].split(), repaired[i].split()
            if len(a) == len(b):
                tokens[i] = a, b
    words = list({w for a, b in tokens.values() for pair in zip(a, b, strict=True) if pair[0] != pair[1] for w in pair})
    of = dict(zip(words, charges(words)[0], strict=True))
    mixed = {i: " ".join(x if x != y and of[x] < of[y] else y for x, y in zip(a, b, strict=True)) for i, (a, b) in tokens.items()}
    mixed = {i: t for i, t in mixed.items() if t not in (original[i], repaired[i])}
    told = dict(zip(mixed, charges(list(mixed.values()))[0], strict=True))
    best = [repaired[i] if cost[n + i] <= cost[i] else original[i] for i in range(n)]
    return [mixed[i] if i in mixed and told[i] <= min(cost[i], cost[n + i]) else best[i] for i in range(n)]


@F.arrow_udf(T.StringType())
def _best_text(original: pa.Array, repaired: pa.Array) -> pa.Array:
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(original.to_pylist(), repaired.to_pylist(), strict=True)) if a is not None and b is not None]
    out = [None] * len(original)
    for (i, _, _), t in zip(pairs, best_texts([a for _, a, _ in pairs], [b for _, _, b in pairs]), strict=True):
        out[i] = t
    return pa.array(out, pa.string())


def best_text(original: Column, repaired: Column) -> Column:
    """``best_texts`` of two columns; pairs that are equal are not looked at."""
    differ = original != repaired
    return F.when(original == repaired, original).otherwise(_best_text(F.when(differ, original), F.when(differ, repaired)))


def merge_variants(original: DataFrame, repaired: DataFrame, key: Sequence[str] = LINE) -> DataFrame:
    """Full outer merge of original and repaired fragments by line.

    Of repeated keys the last repaired one counts, and only the first original one meets
    it.  Lines on one side only stay unless they are garbled.
    """
    by = list(key)
    last = W.partitionBy(*by).orderBy(F.col("ord").desc())
    first = W.partitionBy(*by).orderBy("ord")
    right = repaired.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    left = original.withColumn("_n", F.row_number().over(first))
    a, b = left.alias("a"), right.alias("b")
    same = F.expr(" AND ".join(f"a.{c} <=> b.{c}" for c in by) + " AND a._n = 1")
    joined = a.join(b, same, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    text = F.when(F.col("a.text").isNotNull() & F.col("b.text").isNotNull(), best_text(F.col("a.text"), F.col("b.text"))).otherwise(F.coalesce("a.text", "b.text"))
    matched = F.col("a.text").isNotNull() & F.col("b.text").isNotNull()
    kept = joined.filter(matched | ~M.garbled_orphan(F.coalesce("a.text", "b.text")))
    return kept.select(*map(pick, by), *map(pick, ("ord", "x0", "y0", "x1", "y1")), text.alias("text"), matched.alias("matched"))


def merge_order() -> list[Column]:
    """How merged fragments are sorted."""
    return [F.col("page_number"), F.round("y0", 2), F.col("x0"), F.col("block_number"), F.col("line_number")]


def undecoded_places(replaced: DataFrame, decoded: DataFrame, key: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Places (bboxes to 2 decimals) where one extraction has a replacement character and the other nothing decoded."""
    box = ["x0", "y0", "x1", "y1"]
    r = replaced.select(*key, *[F.round(c, 2).alias(c) for c in box])
    d = decoded.select(*key, *[F.round(c, 2).alias(c) for c in box])
    return r.join(d, [*key, *box], "left_anti")
