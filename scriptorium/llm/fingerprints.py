"""Document fingerprints by winnowing, with DataFrame operations only.

A text is cut into tokens (runs of non-space characters, at most 24 long; each character
by itself in scripts written without spaces), each run of k tokens is hashed, and of
every w neighbouring hashes the least is kept, the rightmost one on a tie, with its
position.  Any passage of k + w - 1 tokens that two texts share therefore gives both a
common fingerprint hash, and passages of fewer than k tokens never do.

A hash and its position are packed into one long, the position counted down, so that the
least long of a window is the least hash with the rightmost position.  Everything is an
expression over one row, evaluated where the text is.

Defined results: a null text is empty; a text with fewer than k tokens has the one hash
of all its tokens; one with fewer than k + w - 1 has the least of its hashes; equal
texts have equal fingerprints; positions are exact up to 2^27 tokens.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, WINDOW = 4, 12
POSITION_BITS = 27
HASH_MASK = (1 << 35) - 1
LAST_POSITION = (1 << POSITION_BITS) - 1
_ALONE = r"\x{0e00}-\x{0e7f}\x{3040}-\x{30ff}\x{3400}-\x{9fff}"
TOKEN = rf"[{_ALONE}]|[^\s{_ALONE}]{{1,24}}"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also inside the functions that ``use`` maps."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def packed_grams(hashes: Column, k: int) -> Column:
    """One long per run of k tokens: hash, then the position counted down."""
    n = F.size(hashes)

    def gram(i: Column) -> Column:
        h = F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])  # a position past the end is null, which hashes to nothing
        return F.shiftleft(h.bitwiseAND(F.lit(HASH_MASK)), POSITION_BITS).bitwiseOR((F.lit(LAST_POSITION) - i).cast("long"))

    return F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), gram)


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The kept hashes of a text in order of position, packed with their positions."""

    def kept(grams: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(grams) - window + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda j: F.array_min(F.slice(grams, j, F.lit(window)))))

    return bound(F.transform(tokens(text), lambda t: F.xxhash64(t)), lambda h: bound(packed_grams(h, k), kept))


def hash_of(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def position_of(packed: Column) -> Column:
    return F.lit(LAST_POSITION) - packed.bitwiseAND(F.lit(LAST_POSITION))


def fingerprint_string(marks: Column) -> Column:
    """``hash@position`` of each kept hash, in order."""
    return F.array_join(F.transform(marks, lambda m: F.concat(F.lower(F.hex(hash_of(m))), F.lit("@"), position_of(m).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of kept hashes that two fingerprints have in common (Jaccard), 0 to 1."""
    x, y = (F.array_distinct(F.transform(m, hash_of)) for m in (a, b))
    return bound(F.struct(x.alias("x"), y.alias("y")), lambda s: bound(F.size(F.array_intersect(s["x"], s["y"])), lambda both: both / (F.size(s["x"]) + F.size(s["y"]) - both)))


def shared_positions(a: Column, b: Column) -> Column:
    """(hash, position in a, position in b) of every kept hash in both: where shared passages are."""
    return F.flatten(
        F.transform(a, lambda m: F.transform(F.filter(b, lambda o: hash_of(o) == hash_of(m)), lambda o: F.struct(hash_of(m).alias("hash"), position_of(m).alias("a"), position_of(o).alias("b"))))
    )


def with_next(df: DataFrame, key: str, columns: list[str], tie: str, rows_in_bucket: int = 4096, most_buckets: int = 65_536) -> DataFrame:
    """Adds ``next_<column>``: the values in the row that follows by ``key`` (ties by ``tie``); the first follows the last.

    Rows are dealt to ranges of keys with about ``rows_in_bucket`` rows each, whose limits
    are keys of the table; the first row of a range also goes to the range before it, so
    no order over the whole table is needed.  Null keys come first.
    """
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    rows = df.count()
    if rows == 0:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    buckets = max(1, min(most_buckets, math.ceil(rows / rows_in_bucket)))
    points = [i / buckets for i in range(buckets)]
    limits = df.agg(F.min(order), F.percentile_approx(order, points, max(10_000, 10 * buckets))).first()  # at most most_buckets longs
    limits = sorted({limits[0], *limits[1]})
    side = math.ceil(math.sqrt(len(limits)))
    groups = [limits[i : i + side] for i in range(0, len(limits), side)]
    array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    heads, all_groups = array([g[0] for g in groups]), F.array(*[array(g) for g in groups])
    placed = df.withColumn("_order", order).withColumn("_group", F.size(F.filter(heads, lambda h: h <= F.col("_order"))))
    placed = placed.withColumn("_limits", F.get(all_groups, F.col("_group") - 1))
    placed = placed.withColumn("_in", F.size(F.filter("_limits", lambda h: h <= F.col("_order"))))
    bucket = (F.col("_group") - 1) * side + F.col("_in") - 1
    first = F.get(F.col("_limits"), F.col("_in") - 1) == F.col("_order")
    at = lambda b, kind: F.struct(b.cast("int").alias("bucket"), F.lit(kind).alias("kind"))
    copies = F.array(at(bucket, 0), F.when(first & (bucket > 0), at(bucket - 1, 1)), F.when(F.col("_order") == limits[0], at(F.lit(len(limits) - 1), 2)))
    dealt = placed.withColumn("_at", F.explode(F.filter(copies, lambda c: c.isNotNull()))).drop("_group", "_limits", "_in")
    w = W.partitionBy("_at.bucket").orderBy(F.col("_at.kind") == 2, "_order", tie)
    led = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return led.filter("_at.kind = 0").drop("_at", "_order")
