"""Optional connectors: readers that need libraries or services this package does not bring.

Each has the same shape, ``read(spark, path) -> DataFrame``, and says what is missing
when it is used, not when it is imported.  A document that cannot be read is a row with
``status`` and ``error_class``; it never fails the job.
"""

from __future__ import annotations

import importlib.util
import shutil
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "path string, status string, error_class string, page int, block int, line int, span int, ord long, font string, size double, text string, x0 double, y0 double, x1 double, y1 double"
WORD_TIMEOUT_S = 120


class NotInstalled(RuntimeError):
    """A connector's library or program is not there."""


def pdf_spans(spark: SparkSession, path: str) -> DataFrame:
    """Positioned spans of PDF files; needs PyMuPDF on the executors."""
    if importlib.util.find_spec("fitz") is None:
        raise NotInstalled("reading PDF bytes needs PyMuPDF; give the engine a spans table instead")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        names = [c.split(" ")[0] for c in SPANS.split(", ")]
        for b in batches:
            for path_, content in zip(b["path"], b["content"], strict=True):
                rows = []
                try:
                    with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                        for number, page in enumerate(doc, 1):
                            for i, block in enumerate(page.get_text("dict")["blocks"]):
                                for j, line in enumerate(block.get("lines", [])):
                                    rows += [(path_, "ok", None, number, i, j, k, len(rows) + k, s["font"], s["size"], s["text"], *s["bbox"]) for k, s in enumerate(line["spans"])]
                except Exception as e:
                    rows = [(path_, "error", type(e).__name__, *[None] * (len(names) - 3))]
                yield pd.DataFrame(rows, columns=names)

    from .files import scan_pdfs

    return scan_pdfs(spark, path).select("path", "content").mapInPandas(read, SPANS)


def word_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, status) of legacy .doc files by the first program that gives a text: antiword, textutil, LibreOffice."""

    def attempts(file: str) -> list[list[str]]:
        return [a for a in (["antiword", file], ["textutil", "-convert", "txt", "-stdout", file], ["soffice", "--headless", "--cat", file]) if shutil.which(a[0])]

    if not attempts("x"):
        raise NotInstalled("reading .doc files needs antiword, textutil or LibreOffice")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path_, content in zip(b["path"], b["content"], strict=True):
                with tempfile.NamedTemporaryFile(suffix=".doc") as f:
                    f.write(bytes(content))
                    f.flush()
                    text = None
                    for command in attempts(f.name):
                        try:
                            done = subprocess.run(command, capture_output=True, timeout=WORD_TIMEOUT_S)
                        except (OSError, subprocess.TimeoutExpired):
                            continue
                        if done.returncode == 0:
                            text = done.stdout.decode(errors="replace")
                            break
                    rows.append((path_, text, "error" if text is None else "ok"))
            yield pd.DataFrame(rows, columns=["path", "text", "status"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(read, "path string, text string, status string")


ATTEMPTS = "path string, readable boolean, timed_out boolean, exit_code int, output string, errors string, wall_s double"


def run_converter(files: DataFrame, command: Sequence[str], timeout_s: float = 300) -> DataFrame:
    """Attempts (path, readable, timed_out, exit_code, output, errors, wall_s) of a program on files (path, content).

    Each file has a process of its own, its name as the last argument, so a crash or a
    hang is a row and never ends the job.  ``artifact.attempt_status`` judges the rows.
    A file without content is unreadable.
    """
    command = list(command)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, content in zip(b["path"], b["content"], strict=True):
                if content is None:
                    row = (path_, False, False, None, None, None, None)
                else:
                    with tempfile.NamedTemporaryFile() as f:
                        f.write(bytes(content))
                        f.flush()
                        begun = time.monotonic()
                        try:
                            done = subprocess.run([*command, f.name], capture_output=True, timeout=timeout_s)
                            row = (path_, True, False, done.returncode, done.stdout.decode(errors="replace"), done.stderr.decode(errors="replace"), time.monotonic() - begun)
                        except subprocess.TimeoutExpired:
                            row = (path_, True, True, None, None, None, float(timeout_s))
                yield pd.DataFrame([row], columns=[c.split(" ")[0] for c in ATTEMPTS.split(", ")])

    return files.select("path", "content").mapInPandas(read, ATTEMPTS)


def ocr_candidates(pages: DataFrame, provider: Callable[[bytes], str] | None, content: str = "image") -> DataFrame:
    """Adds ``ocr_text`` by a provider (page image -> text); without one the candidate is absent (null)."""
    if provider is None:
        return pages.withColumn("ocr_text", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def read(images: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else provider(bytes(i)) for i in images])

    return pages.withColumn("ocr_text", read(content))


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A switch of the engine, from the session's configuration (scriptorium.<name>)."""
    return spark.conf.get(f"scriptorium.{name}", default)
