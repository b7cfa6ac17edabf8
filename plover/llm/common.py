"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A word: a run of characters other than the space and the five ASCII controls that separate words.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []
_local: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _local:
        _local[key] = tempfile.mkdtemp(prefix="plover-")
    return f"file://{_local[key]}"


def _write(df: DataFrame, path: str) -> None:
    """Append ``df`` to the Parquet table at ``path``; once it is whole, the shuffle files behind it are removed."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks that read the table, not the plan that made it.
    The table is removed when the driver ends, or by :func:`cleanup`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plover-{name}-{uuid.uuid4().hex}"
    _write(df, path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._plover_path = path
    return out


def save_all(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """Write frames of one schema, one after another, and read all of them."""
    path = schema = None
    for df in frames:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_dir(spark)}/plover-{name}-{uuid.uuid4().hex}"
            _written.append((spark, path))
        _write(df, path)
    return spark.read.schema(schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be closed by now
        pass


def discard(saved: DataFrame) -> None:
    """Remove a table that :func:`save` returned; what was read from it must have been saved."""
    _remove(saved.sparkSession, saved._plover_path)


def cleanup() -> None:
    """Remove the tables that :func:`save` wrote; call it once their readers have ended."""
    while _written:
        _remove(*_written.pop())


atexit.register(cleanup)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def parts(df: DataFrame, at_least: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Whole texts that a Python task is handed at once; Spark's default is 10,000, a partition's at most.
ARROW_ROWS = 1_000

#: Bytes after which such a batch ends (it holds a row at least); Spark's default is 64 MB, which JVM and Python hold several times over.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand Python tasks at most ``ARROW_ROWS`` rows and about ``ARROW_BYTES`` at once: batches of whole texts, or of packed rows, are held by the
    JVM and by Python.  A bound in bytes that the session sets stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_BYTES)


@contextlib.contextmanager
def in_small_batches(spark: SparkSession) -> Iterator[None]:
    """:func:`small_batches` for what is written within; the session's own bounds come back."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [(k, spark.conf.get(k, None)) for k in keys]
    small_batches(spark)
    try:
        yield
    finally:
        for k, v in before:
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of Spark columns in DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))
