"""Sources and sinks: corpus listings, records, test reports, Markdown files, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P

SUFFIXES = ("pdf", "docx", "doc")


def scan_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty PDF files as (path, length, content); the glob and the length reach the reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path).filter("length > 0")


def is_pdf(name: Column, mime: Column, length: Column) -> Column:
    return (length > 0) & (F.lower(name).endswith(".pdf") | (F.lower(F.split(mime, ";")[0]) == "application/pdf"))


def is_legacy_doc(name: Column, mime: Column) -> Column:
    """By extension; the MIME type counts only where there is none."""
    ext = F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)
    return F.when(ext != "", ext == "doc").otherwise(F.lower(F.split(mime, ";")[0]) == "application/msword")


def open_status(name: Column, content: Column) -> Column:
    """What kind of error opening a file would be; null if it looks sound."""
    return (
        F.when(content.isNull(), "ValidationError").when(~F.lower(name).endswith(".pdf"), "ValidationError")
        .when(~F.coalesce(F.decode(F.substring(content, 1, 5), "ISO-8859-1") == "%PDF-", F.lit(False)), "ExtractionError")
    )


def http_url(value: Column) -> Column:
    """An absolute http or https address with a host, without white space around it; null for anything else."""
    trimmed = P.stripped(value)
    return F.when(trimmed.rlike(rf"(?i)^https?://[^/?#{P.SPACES}]+"), trimmed)


def list_corpus(files: DataFrame, explicit: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Paths with a known suffix, and explicit ones with any, each once, sorted."""
    known = files.filter(F.lower(path).rlike(rf"\.({'|'.join(SUFFIXES)})$")).select(path)
    return (known.unionByName(explicit.select(path)) if explicit is not None else known).distinct().orderBy(path)


RECORD = T.StructType([T.StructField(n, t) for n, t in [
    ("file", T.StringType()), ("pages", T.StringType()), ("bytes", T.LongType()), ("source_sha256", T.StringType()), ("status", T.StringType()), ("wall_s", T.DoubleType()), ("max_rss_mb", T.DoubleType()),
    *[(c, T.LongType()) for c in ("chars", "letters", "devanagari")], ("deva_frac", T.DoubleType()), ("latin_frac", T.DoubleType()),
    *[(c, T.LongType()) for c in ("replacement", "pua", "control", "cid_garbage", "malformed", "stranded", "stranded_matras", "doubled_matras", "matras")],
    ("sha256", T.StringType()), ("exc_type", T.StringType()), ("exc_msg", T.StringType()),
]])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Measurement records (JSON lines); a file that is recorded twice fails the read where it is used."""
    records = spark.read.schema(RECORD).json(path)
    n = F.count("*").over(W.partitionBy("file"))
    return records.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("recorded twice: "), "file"))).otherwise(F.lit(True)).cast("boolean")).drop("_n")


def write_records(records: DataFrame, path: str) -> None:
    records.orderBy("file").write.mode("overwrite").json(path)


def encoded(*columns: str) -> Column:
    """A nested record as JSON, nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def decoded(text: Column, schema: str) -> Column:
    """A nested record from JSON; null for text that is no JSON."""
    return F.when(F.get_json_object(text, "$").isNotNull(), F.from_json(text, schema))


def read_catalog(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """A JSON artifact of a known version; another version fails the read where it is used."""
    found = spark.read.schema(schema).option("multiLine", True).json(path)
    right = F.when(F.col("version") == version, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unexpected version "), F.coalesce(F.col("version").cast("string"), F.lit("none"))))).cast("boolean")
    return found.filter(right)


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """(name, classname, outcome) of every test case: failed before error before skipped, else passed."""
    schema = "_name string, _classname string, failure string, error string, skipped string"
    cases = spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\u0000").schema(schema).load(path)
    return cases.select(F.col("_name").alias("name"), F.col("_classname").alias("classname"), junit_outcome(F.col("failure"), F.col("error"), F.col("skipped")).alias("outcome"))


def junit_outcome(failure: Column, error: Column, skipped: Column) -> Column:
    return F.when(failure.isNotNull(), "failed").when(error.isNotNull(), "error").when(skipped.isNotNull(), "skipped").otherwise("passed")


def write_markdown(docs: DataFrame, path: str, name: str = "name", text: str = "markdown") -> None:
    """One directory per output name, its Markdown as text; written under Spark's commit protocol."""
    docs.select(F.col(text).alias("value"), F.col(name)).write.mode("overwrite").partitionBy(name).option("lineSep", "\n").text(path)


def publish(df: DataFrame, root: str, version: str) -> str:
    """Writes a new versioned folder; readers switch to it only once it is complete.

    A folder of that version that is already there is refused, so nothing is replaced.
    """
    target = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def usage_totals(responses: DataFrame, key: str = "config") -> DataFrame:
    """Calls and tokens of logged OCR responses; either naming of the counters is read."""
    first = lambda *c: F.coalesce(*[F.col(x) for x in c], F.lit(0))
    return responses.groupBy(key).agg(
        F.count("*").alias("calls"), F.sum(first("prompt_tokens", "input_tokens")).alias("input_tokens"), F.sum(first("completion_tokens", "output_tokens")).alias("output_tokens")
    )


def parse_size(value: Column, default: int) -> Column:
    """A positive whole number from a setting, else the default."""
    n = value.try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(default))
