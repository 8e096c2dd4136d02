"""The corpus harness: signals before and after a change, joined and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: what the judgement looks at
FIELDS = ["status", "sha256", "deva_frac", "devanagari", "malformed", "replacement", "cid_garbage", "wall_s"]


def verdict(b: str, a: str) -> Column:
    """The first rule that holds, of the record ``b`` (before) and ``a`` (after)."""
    f = lambda side, c: F.col(f"{side}.{c}")
    number = lambda side, c: F.coalesce(f(side, c), F.lit(0))
    ok = lambda side: F.coalesce(f(side, "status") == "ok", F.lit(False))
    change = lambda c: number(a, c) - number(b, c)
    collapse = F.coalesce((f(b, "deva_frac") >= 0.3) & (f(a, "deva_frac") < f(b, "deva_frac") * 0.5), F.lit(False))
    loss = (number(b, "devanagari") > 100) & (number(a, "devanagari") < number(b, "devanagari") * 0.9)
    damage = change("replacement") + change("cid_garbage")
    return (
        F.when(f(a, "file").isNull(), "missing").when(f(b, "file").isNull(), "new-file")
        .when(ok(b) & ~ok(a), "newly-failing").when(~ok(b) & ok(a), "newly-passing").when(~ok(b) & ~ok(a), "same")
        .when(f(b, "sha256") == f(a, "sha256"), "same").when(collapse | loss, "worse")
        .when((change("malformed") > 0) | (damage > 0), "worse").when((change("malformed") < 0) | (change("devanagari") > 0), "better").otherwise("changed")
    )


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, verdict, before_s, after_s): full outer join of two runs by file."""
    joined = before.alias("b").join(after.alias("a"), F.expr("a.file = b.file"), "full_outer")
    return joined.select(F.coalesce("b.file", "a.file").alias("file"), verdict("b", "a").alias("verdict"), F.col("b.wall_s").alias("before_s"), F.col("a.wall_s").alias("after_s"))


def summary(diffed: DataFrame) -> DataFrame:
    """(verdict, files): the histogram."""
    return diffed.groupBy("verdict").agg(F.count("*").alias("files"))


def wall_time(diffed: DataFrame) -> DataFrame:
    """One row: total seconds before and after over files in both, and the change in per cent."""
    both = diffed.filter(~F.col("verdict").isin("missing", "new-file"))
    total = both.agg(F.sum("before_s").alias("before_s"), F.sum("after_s").alias("after_s"))
    return total.withColumn("delta_pct", F.when(F.col("before_s") > 0, (F.col("after_s") - F.col("before_s")) * 100 / F.col("before_s")))


def regressions(diffed: DataFrame, allowed: DataFrame) -> DataFrame:
    """Files that got worse and are not on the list of allowed ones (column file): the gate."""
    bad = diffed.filter(F.col("verdict").isin("worse", "newly-failing", "missing"))
    return bad.join(allowed.select("file"), "file", "left_anti")


def duplicate_files(records: DataFrame) -> DataFrame:
    """Files recorded more than once, which a run must not have."""
    return records.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1")
