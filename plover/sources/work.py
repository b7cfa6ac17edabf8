"""Tables written between stages, in the folder that driver and executors share, and the reports' sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of this machine where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(id(spark.sparkContext), f"file://{tempfile.mkdtemp(prefix='plover-work-')}")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet and read again: later readers, and retries, don't run the plan again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sink(df: DataFrame, out_dir: str | None, name: str, fmt: str = "csv", partition_by: tuple[str, ...] = (), one_file: bool = True) -> DataFrame:
    """Write a report; with ``one_file`` as one part (reports hold a row for each feature, fold or metric, not for each row
    of data).  Returns ``df``; without an output folder nothing is written."""
    if out_dir:
        w = (df.coalesce(1) if one_file else df).write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(f"{out_dir}/{name}")
    return df
