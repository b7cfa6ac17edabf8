"""Roles, filters and validation of a subject table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plover.config import LOG, Config, Roles


def listwise_deletion(df: DataFrame) -> DataFrame:
    """Rows without a missing value (null or NaN) in any column."""
    return df.dropna("any")


def deletion_counts(df: DataFrame) -> DataFrame:
    """``n_rows, n_complete, n_dropped`` in one pass."""
    bad = F.lit(False)
    for c, kind in df.dtypes:
        col = df[f"`{c}`"]
        bad = bad | col.isNull() | (F.isnan(col) if kind in ("double", "float") else F.lit(False))
    out = df.select(bad.alias("bad")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("bad"), 0).otherwise(1)), F.lit(0)).cast("bigint").alias("n_complete"))
    return out.withColumn("n_dropped", F.col("n_rows") - F.col("n_complete"))


def feature_columns(columns: Sequence[str], roles: Roles, overlap: bool = False) -> list[str]:
    """Columns whose name contains the feature substring, without id and outcomes; covariates and the weight are left out
    too, unless ``overlap``."""
    out = {roles.row_id, *roles.outcomes} | (set() if overlap else {*roles.covariates, roles.weight})
    return [c for c in columns if roles.feature_substring in c and c not in out]


def block_columns(features: Sequence[str], block: str | Sequence[str]) -> list[str]:
    """Features of a block: by substring, or by membership of a list; none matched is a warning."""
    found = [f for f in features if block in f] if isinstance(block, str) else [f for f in features if f in set(block)]
    if not found:
        LOG.warning("no feature matches block %s", block)
    return found


def required(df: DataFrame, names: Sequence[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def role_projection(df: DataFrame, cfg: Config) -> tuple[DataFrame, list[str]]:
    """``row_id, y ARRAY, cov ARRAY, w, features ARRAY`` of complete rows, and the features' names."""
    roles = cfg.roles
    required(df, [roles.row_id, *roles.outcomes])
    cov = list(roles.covariates) if cfg.covariate_method != "none" else []
    required(df, cov + ([roles.weight] if roles.weight else []))
    names = feature_columns(df.columns, roles)
    arr = lambda cs: F.array(*[F.col(f"`{c}`").cast("double") for c in cs]).cast("array<double>")
    w = F.col(f"`{roles.weight}`").cast("double") if roles.weight else F.lit(1.0)
    out = listwise_deletion(df).select(F.col(f"`{roles.row_id}`").cast("string").alias("row_id"), arr(roles.outcomes).alias("y"), arr(cov).alias("cov"), w.alias("w"), arr(names).alias("features"))
    return out, names


def check_rows(rows: DataFrame) -> tuple[int, float | None]:
    """The number of rows and the effective sample size; no rows, or a negative weight, is a ValueError."""
    n, least, s, ss = rows.agg(F.count("*"), F.min("w"), F.sum("w"), F.sum(F.col("w") * F.col("w"))).first()
    if not n:
        raise ValueError("no complete rows are left")
    if least < 0:
        raise ValueError("negative sample weights")
    ess = s * s / ss if ss else None
    if ess is not None and ess / n < 0.5:
        LOG.warning("the effective sample size is %.1f of %d", ess, n)
    return n, ess


def weight_ess(df: DataFrame, w: str = "w") -> DataFrame:
    """``n, ess, ess_ratio, low``: Kish's effective sample size."""
    s, ss, n = F.sum(w), F.sum(F.col(w) * F.col(w)), F.count("*")
    return df.agg(n.alias("n"), (s * s / ss).alias("ess")).withColumn("ess_ratio", F.col("ess") / F.col("n")).withColumn("low", F.col("ess_ratio") < 0.5)


def normalize_weights(df: DataFrame, w: str = "w") -> DataFrame:
    """Weights that sum to the number of rows; the totals are one row, joined back, so no task gathers the table."""
    total = df.agg(F.count("*").alias("__n"), F.sum(w).alias("__s"))
    return df.join(F.broadcast(total), how="cross").withColumn(w, F.col(w) * F.col("__n") / F.col("__s")).drop("__n", "__s")


def negative_weights(df: DataFrame, w: str = "w") -> DataFrame:
    return df.agg(F.min(w).alias("min_weight"), F.coalesce(F.sum((F.col(w) < 0).cast("int")), F.lit(0)).cast("bigint").alias("n_negative"))


def map_coverage(features: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """Features without a cluster."""
    return features.join(cluster_map, "feature", "left_anti")


def check_coverage(features: DataFrame, cluster_map: DataFrame) -> None:
    first = map_coverage(features, cluster_map).orderBy("feature").first()
    if first is not None:
        raise ValueError(f"feature without a cluster: {first.feature}")


def np_diagnostic(df: DataFrame, n_features: int) -> DataFrame:
    """``n, p, ceiling, np_ratio, over``: a fifth of the rows is the ceiling for features."""
    out = df.agg(F.count("*").alias("n")).withColumn("p", F.lit(n_features).cast("bigint")).withColumn("ceiling", F.expr("n div 5"))
    ratio = F.when(F.col("p") == 0, F.lit(float("inf"))).otherwise(F.col("n") / F.col("p"))
    return out.withColumn("np_ratio", ratio).withColumn("over", F.col("p") > F.col("ceiling"))


def subsample_viability(folds: DataFrame, n_reduced: int) -> DataFrame:
    """``fold, n_train, half, need, warn``: half of a fold's training rows against max(3 features, 30)."""
    sizes = folds.groupBy("fold").agg(F.count("*").alias("n_test"))
    total = sizes.agg(F.sum("n_test").alias("n"))
    out = sizes.join(F.broadcast(total), how="cross").withColumn("n_train", F.col("n") - F.col("n_test"))
    need = max(3 * n_reduced, 30)
    return out.select(F.col("fold").cast("bigint").alias("fold"), "n_train", F.expr("n_train div 2").alias("half"), F.lit(need).cast("bigint").alias("need"), (F.expr("n_train div 2") < need).alias("warn"))


def assemble(df: DataFrame, cov: str = "cov", features: str = "features") -> DataFrame:
    """``design``: covariates, then features."""
    return df.withColumn("design", F.concat(cov, features))


def strip_covariates(df: DataFrame, n_covs: int, col: str = "coef") -> DataFrame:
    """Without the leading covariates of an array column."""
    return df.withColumn(col, F.slice(col, n_covs + 1, F.greatest(F.lit(0), F.size(col) - n_covs)))


def replace_nan(df: DataFrame, col: str, value: float) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.nanvl(F.col(col), F.lit(value)), F.lit(value)))


def sorted_labels(df: DataFrame, col: str) -> DataFrame:
    """Labels as text, numbered in the order of their values."""
    out = df.select(F.col(col).alias("v")).distinct()
    return out.select(F.col("v").cast("string").alias("label"), (F.row_number().over(Window.orderBy("v")) - 1).cast("bigint").alias("k"))
