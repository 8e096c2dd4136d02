"""The benchmark artifact: runs expanded, checked, judged and tallied."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

OUTCOMES = ["pass", "fail", "known_issue", "blocked", "reference"]


def expand(documents: DataFrame, configurations: DataFrame, recorded: DataFrame) -> DataFrame:
    """Every document in every available configuration with its recorded run, if there is one.

    Configurations are a handful of rows by nature; the join is one of documents with a
    short list, and the optimiser broadcasts it by its size.
    """
    wanted = documents.join(configurations.filter("available").select("config"), how="cross")
    return wanted.join(recorded, ["document", "config"], "left")


def check_passes(kind: Column, value: Column, text: Column, diagnostics: Column) -> Column:
    """Whether one check holds; null for a kind that is not known."""
    n = value.try_cast("long")
    deva = P.characters(text, P.DEVANAGARI)
    return (
        F.when(kind == "contains", F.contains(text, value)).when(kind == "min_chars", F.char_length(text) >= n)
        .when(kind == "min_devanagari", deva >= n).when(kind == "max_devanagari", deva <= n)
        .when(kind == "max_replacement", P.characters(text, r"\x{FFFD}") <= n)
        .when(kind == "diagnostic_contains", F.contains(F.lower(diagnostics), F.lower(value)))
    )


def evaluate(runs: DataFrame) -> DataFrame:
    """Adds ``passed``: all checks hold; text that is missing fails, an unknown kind is an error (null)."""
    one = lambda c: F.coalesce(F.when(F.col("text").isNull(), F.lit(False)), check_passes(c["kind"], c["value"], F.col("text"), F.coalesce("diagnostics", F.lit(""))))
    results = F.transform("checks", one)
    return runs.withColumn("passed", F.when(F.exists(results, lambda r: r.isNull()), F.lit(None)).otherwise(F.forall(results, lambda r: r)))


def outcome(expectation: Column, status: Column, passed: Column) -> Column:
    good = (status == "ok") & F.coalesce(passed, F.lit(False))
    return (
        F.when(expectation.isin("reference", "blocked"), expectation).when(~good & (expectation == "known_issue"), "known_issue").when(~good, "fail").otherwise("pass")
    )


def tally(runs: DataFrame) -> DataFrame:
    """One row per configuration: a column for each outcome, and OCR calls and tokens with how many runs counted them."""
    return runs.groupBy("config").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count("*").alias("runs"),
        F.sum("calls").alias("ocr_calls"), F.sum("tokens").alias("ocr_tokens"), F.count("calls").alias("counted"),
    )


def tally_pivot(runs: DataFrame) -> DataFrame:
    return runs.groupBy("config").pivot("outcome", OUTCOMES).count().fillna(0, OUTCOMES)


def usage_delta(before: Column, after: Column) -> Column:
    """Counters after less before; null if either is missing or any counter went back. Structs of calls, input_tokens, output_tokens."""
    d = {c: after[c] - before[c] for c in ("calls", "input_tokens", "output_tokens")}
    bad = before.isNull() | after.isNull()
    for x in d.values():
        bad = bad | (x < 0)
    return F.when(~bad, F.struct(*[x.alias(c) for c, x in d.items()], (d["input_tokens"] + d["output_tokens"]).alias("total_tokens")))


def replayed(recorded: DataFrame) -> DataFrame:
    """Recorded runs as results: status bad-output and empty text where nothing was recorded."""
    return recorded.withColumns({"status": F.coalesce("status", F.lit("bad-output")), "text": F.coalesce("text", F.lit(""))})


def attempt_status(readable: Column, timed_out: Column, exit_code: Column, output: Column) -> Column:
    """How one attempt to convert a file ended: its own status where its output tells one.

    An exit code below zero is a signal.  Output beats an exit code.
    """
    told = F.get_json_object(output, "$.status")
    silent = F.coalesce(output, F.lit("")) == ""
    return (
        F.when(~readable, "unreadable_source").when(timed_out, "timeout")
        .when(silent & (exit_code < 0), "killed").when(silent & (exit_code > 0), "worker_error")
        .otherwise(F.coalesce(F.nullif(told, F.lit("")), F.lit("bad_output")))
    )


def availability(requires: Column, backends: Mapping[str, bool]) -> Column:
    """Whether what a configuration needs is there; one that needs nothing always is, an unknown need never."""
    there = F.lit(False)
    for name, ready in backends.items():
        there = F.when(requires == name, F.lit(ready)).otherwise(there)
    return F.when(F.coalesce(requires, F.lit("")) == "", F.lit(True)).otherwise(there)


def unavailable_reason(requires: Column, available: Column, reasons: Mapping[str, str], otherwise: str = "backend not configured") -> Column:
    """Why a configuration cannot run; null for one that can."""
    known = F.coalesce(*[F.when(requires == name, F.lit(reason)) for name, reason in reasons.items()], F.lit(otherwise))
    return F.when(~available, known)


def missing_runs(expanded: DataFrame) -> DataFrame:
    return expanded.filter(F.col("status").isNull()).select(F.concat_ws("--", "document", "config").alias("run")).orderBy("run")


def is_stale(recorded_commit: Column, built_commit: Column) -> Column:
    return F.coalesce(recorded_commit != built_commit, F.lit(True))


def verified_source(content: Column, expected_sha256: Column, most_bytes: int = 100 * 1024 * 1024) -> Column:
    return (F.octet_length(content) <= most_bytes) & (F.sha2(content, 256) == F.lower(expected_sha256))


def filtered(documents: DataFrame, runs: DataFrame, config: str | None = None, outcome: str | None = None, kind: str | None = None, words: str = "") -> DataFrame:
    """Documents that match, and have at least one run that does."""
    kept = runs
    for c, v in (("config", config), ("outcome", outcome)):
        kept = kept.filter(F.col(c) == v) if v else kept
    found = documents.filter(F.col("kind") == kind) if kind else documents
    if words:
        everything = F.lower(F.concat_ws(" ", *[c for c in ("title", "summary", "publisher", "kind") if c in documents.columns], *(["tags"] if "tags" in documents.columns else [])))
        found = found.filter(F.contains(everything, F.lit(words.lower())))
    return found.join(kept.select("document"), "document", "left_semi")


def default_run(runs: DataFrame, preferred: str) -> DataFrame:
    """The run a document opens with: the preferred configuration, else the first that is no reference, else the first."""
    rank = F.when(F.col("config") == preferred, 0).when(F.col("outcome") != "reference", 1).otherwise(2)
    return runs.groupBy("document").agg(F.min_by("config", F.struct(rank.alias("r"), F.col("ord"))).alias("config"))


def summary_markdown(tallied: DataFrame) -> DataFrame:
    """One row: the table of the benchmark summary."""
    line = F.format_string("| %s | %d | %d | %d | %d |", "config", "pass", "fail", "known_issue", "blocked")
    head = "| Configuration | Pass | Fail | Known issue | Blocked |\n| --- | --- | --- | --- | --- |\n"
    rows = tallied.select("config", line.alias("line"))  # a row per configuration, a handful
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("config", "line"))), lambda s: s["line"]), "\n")).alias("markdown"))


def shortened(message: Column, most: int = 200) -> Column:
    flat = P.collapsed(message)
    return F.when(F.char_length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)
