"""Sources: subject tables, cluster maps, chunks of null scores, saved scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plover.config import Roles

#: Texts that stand for a missing value in a CSV file (fixed values).
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def scan_subjects(spark: SparkSession, path: str, roles: Roles | None = None) -> DataFrame:
    """A subject table, CSV with a header or Parquet.  With roles, role columns of a CSV file are cast to numbers."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raw = spark.read.option("header", True).csv(path)
    clean = raw.select(*[F.when(~F.trim(raw[f"`{c}`"]).isin(*NULL_TOKENS), F.trim(raw[f"`{c}`"])).alias(c) for c in raw.columns])
    if roles is None:
        return clean
    numeric = {*roles.outcomes, *roles.covariates, *([roles.weight] if roles.weight else []), *(c for c in raw.columns if roles.feature_substring in c)} - {roles.row_id}
    return clean.select(*[clean[f"`{c}`"].try_cast("double").alias(c) if c in numeric else clean[f"`{c}`"] for c in clean.columns])


def scan_cluster_map(spark: SparkSession, path: str) -> DataFrame:
    """``feature, cluster`` from a CSV file without a header."""
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("cluster", T.StringType())])
    try:
        out = spark.read.schema(schema).csv(path)
        out.limit(1).count()
    except Exception as e:
        raise ValueError(f"the cluster map can't be read: {path}") from e
    return out.select(F.trim("feature").alias("feature"), F.trim("cluster").alias("cluster")).dropna("any")


def scan_null_chunks(spark: SparkSession, folder: str, pattern: str = "perm_chunk_*") -> DataFrame:
    """All chunks of a null distribution in a folder, as one ``score`` column (UNION ALL)."""
    raw = spark.read.option("header", True).csv(f"{folder}/{pattern}")
    return raw.select(F.col(f"`{raw.columns[0]}`").cast("double").alias("score"))


def scan_score(spark: SparkSession, path: str) -> float:
    """The first ``score`` of a saved score table."""
    first = (spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)).select(F.col("score").cast("double")).first()
    if first is None:
        raise FileNotFoundError(f"no score in {path}")
    return first[0]


def array_features(df: DataFrame, row_id: str, vector: str, names: list[str]) -> DataFrame:
    """A wide subject table from an array column: the row id, then a DOUBLE column for each name."""
    return df.select(df[row_id].cast("string").alias("row_id"), *[df[vector].getItem(i).cast("double").alias(n) for i, n in enumerate(names)])


def to_long(df: DataFrame, row_id: str, names: list[str]) -> DataFrame:
    """``row_id, f_idx, feature, value`` from wide columns, in one pass (no self-unions)."""
    cells: Column = F.array(*[F.struct(F.lit(i).alias("f_idx"), F.lit(n).alias("feature"), df[f"`{n}`"].cast("double").alias("value")) for i, n in enumerate(names)])
    return df.select(df[row_id].alias("row_id"), F.explode(cells).alias("c")).select("row_id", "c.*")


def array_to_long(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """``row_id, f_idx, value`` from an array column."""
    return df.select(df[row_id].alias("row_id"), F.posexplode(df[vector]).alias("f_idx", "value")).select("row_id", "f_idx", F.col("value").cast("double").alias("value"))
