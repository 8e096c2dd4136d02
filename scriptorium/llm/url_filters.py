"""URL filters over a sorted digest array.

A list of rules ``host/path-prefix`` is stored as three flat files: the sorted 64-bit
xxhash digests of the rule strings, the offsets of the strings, and the strings
themselves with their verdicts.  Spark ships the files to every executor, where each
Python worker memory-maps them (the pages are shared by the workers of a machine, so a
list may be far larger than a worker's memory).

A url is turned into the rules that could fit it: every parent domain of its host times
every path-prefix length in use.  A batch's candidates are hashed, probed with one
vectorised binary search, and a hit counts only if the stored string is the same, so a
digest collision changes nothing.  The longest fitting rule wins.

Defined results: a null url, or one without ``://``, has an empty host and path; a url
that no rule fits gets the default verdict and a null rule; ties in length go to the
longer host; repeated rows are judged alike; an empty table gives an empty table; other
columns are kept (those with the names of results are replaced).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SUFFIXES = ("keys", "offsets", "strings")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host ends at ``/``, ``?`` or ``#``; path at ``?`` or ``#``."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        cut = rest.find(mark)
        if cut >= 0:
            rest = rest[:cut]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


class DigestArray:
    """The memory-mapped index in one worker."""

    def __init__(self, base: str):
        self.keys = np.memmap(f"{base}.keys", np.uint64, "r")
        self.offsets = np.memmap(f"{base}.offsets", np.int64, "r")
        self.strings = np.memmap(f"{base}.strings", np.uint8, "r")
        head = bytes(self.strings[: self.offsets[0]])
        self.path_lengths = [int(x) for x in head.split(b",") if x]

    def probe(self, candidates: list[str]) -> list[str | None]:
        """For each candidate its verdict, or None where it is not in the list."""
        digests = np.fromiter((xxhash.xxh64_intdigest(c.encode()) for c in candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, digests)
        out: list[str | None] = [None] * len(candidates)
        found = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests))
        for i in found:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:  # equal digests stand side by side
                string, _, verdict = bytes(self.strings[self.offsets[k] : self.offsets[k + 1]]).decode().rpartition("\t")
                if string == candidates[i]:
                    out[i] = verdict
                    break
                k += 1
        return out


def write_index(rules: Iterable[tuple[str, str, str]], base: str) -> None:
    """Writes (verdict, host, path) rules as the index files ``base``.keys/.offsets/.strings."""
    entries = {}
    lengths = set()
    for verdict, host, path in rules:
        host = host.translate(LOWER)
        if entries.setdefault(host + path, verdict) != verdict:
            raise ValueError(f"two verdicts for {host + path}")
        lengths.add(len(path))
    ordered = sorted((xxhash.xxh64_intdigest(s.encode()), s, v) for s, v in entries.items())
    head = ",".join(map(str, sorted(lengths))).encode() + b","
    ends = [len(head)]
    with open(f"{base}.strings", "wb") as f:
        f.write(head)
        for _, s, v in ordered:
            ends.append(ends[-1] + f.write(f"{s}\t{v}".encode()))
    # an index without rules still has a key to map: the largest, which no string stands for
    np.array([d for d, _, _ in ordered] or [2**64 - 1], np.uint64).tofile(f"{base}.keys")
    np.array(ends if ordered else ends * 2, np.int64).tofile(f"{base}.offsets")


def ship_index(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Builds the index on the driver and ships it to every executor; returns its name there."""
    name = f"urls-{uuid.uuid4().hex}"
    # executors that start later fetch the files too, so the driver keeps them while it lives
    folder = tempfile.mkdtemp(prefix="scriptorium-urls-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    write_index(rules, f"{folder}/{name}")
    for suffix in SUFFIXES:
        spark.sparkContext.addFile(f"{folder}/{name}.{suffix}")
    return name


_opened: dict[str, DigestArray] = {}


def _index(name: str) -> DigestArray:
    if name not in _opened:
        _opened[name] = DigestArray(os.path.splitext(SparkFiles.get(f"{name}.keys"))[0])
    return _opened[name]


def candidates(host: str, path: str, path_lengths: list[int]) -> list[str]:
    """Rule strings that fit (host and its parent domains, path prefixes), longest first."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    fits = [(len(h) + n, len(h), h + path[:n]) for h in hosts if h for n in path_lengths if n <= len(path)]
    return [s for *_, s in sorted(fits, reverse=True)]


def judge_urls(df: DataFrame, index: str, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to each row of ``df``."""
    added = ["host", "path", "rule", "verdict"]
    rest = [c for c in df.columns if c not in added]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(c, T.StringType()) for c in added])
    at = rest.index(url)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _index(index)
        for b in batches:
            split = [split_url(u) for u in b.column(at).to_pylist()]
            asked = [candidates(h, p, array.path_lengths) for h, p in split]
            distinct = list(dict.fromkeys(s for a in asked for s in a))
            known = {s: v for s, v in zip(distinct, array.probe(distinct), strict=True) if v is not None} if distinct else {}
            rules = [next((s for s in a if s in known), None) for a in asked]
            verdicts = [default if r is None else known[r] for r in rules]
            columns = [[h for h, _ in split], [p for _, p in split], rules, verdicts]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.string()) for c in columns)], [*b.schema.names, *added])

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(judged, schema)
