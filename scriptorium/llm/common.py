"""What the operators of this subpackage share: tables, scratch space, lineage cuts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none is a local one made, and removed when the process
    ends; that is for a single machine, and refused on a cluster.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="scriptorium-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def checkpointed(df: DataFrame) -> DataFrame:
    """A replicated lineage cut in the shared folder; Spark removes the files once the frame is unreachable."""
    scratch_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """A lineage cut as a Parquet table in the shared folder (columnar and compressed)."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/scriptorium-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table of ``written`` that no later step reads, and lets Spark free unreachable shuffles."""
    for path in df.inputFiles()[:1]:
        _remove(df.sparkSession, path.rsplit("/", 1)[0])
    freed(df.sparkSession)


def freed(spark: SparkSession) -> None:
    """Lets Spark free the shuffles that no later step can reach; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            _remove(spark, path)
        except Exception:  # the session is gone; the folder belongs to the cluster's own clean-up
            pass

    atexit.register(remove)


#: of a batch of rows on its way to a Python worker
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers by bytes, unless the session does so itself.

    By rows alone, 10,000 long texts stand in the worker and, outside the heap, in the executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


_held: dict = {}


def worker_state(key, make):
    """What an operator remembers between the tasks of one Python worker.

    A worker remembers for one operator at a time: the next one's state takes its place,
    so reused workers do not pile up the tables of all operators that have run in them.
    """
    if key not in _held:
        if _held:
            _held.clear()
            _give_back()
        _held[key] = make()
    return _held[key]


def _give_back() -> None:
    """Returns freed memory of this process to the machine, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def each(column: pa.Array) -> Iterator:
    """The values of a column, a few at a time: a batch of long texts never stands twice in memory."""
    for i in range(0, len(column), 128):
        yield from column.slice(i, 128).to_pylist()


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def kept_as(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, addressed by exact name so that extra columns never clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
