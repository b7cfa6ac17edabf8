"""Fit/transform operators in DataFrame form, on long (row, feature) or array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def standard_scale(long: DataFrame) -> DataFrame:
    """Mean 0 and sd 1 (ddof 0, unweighted) by feature; a constant feature has scale 1.  Moments are one row a feature."""
    m = long.groupBy("feature").agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    out = long.join(m, "feature")
    return out.withColumn("value", (F.col("value") - F.col("__m")) / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))).drop("__m", "__s")


def sqrt_weight(df: DataFrame, w: str = "w") -> DataFrame:
    """Features and outcomes times the root of the weight (multi-task fits with weights)."""
    root = F.sqrt(F.col(w))
    return df.withColumn("features", F.transform("features", lambda x: x * root)).withColumn("y", F.transform("y", lambda x: x * root))


def covariate_scale(df: DataFrame, n_covs: int, penalty_weight: float, col: str = "design") -> DataFrame:
    """The leading covariates times 1 / penalty_weight."""
    if penalty_weight <= 0:
        raise ValueError("the covariates' penalty weight must be positive")
    if not n_covs or penalty_weight == 1:
        return df
    return df.withColumn(col, F.transform(col, lambda x, i: F.when(i < n_covs, x / penalty_weight).otherwise(x)))


def named_loadings(loadings: DataFrame) -> DataFrame:
    """``name, feature, loading, n``: ``Cluster_<id>`` for clusters of several features; one alone keeps its name, loading 1."""
    sizes = loadings.groupBy("cluster").agg(F.count("*").alias("n"))
    out = loadings.join(sizes, "cluster")
    return out.select(F.when(F.col("n") > 1, F.concat(F.lit("Cluster_"), "cluster")).otherwise(F.col("feature")).alias("name"), "cluster", "feature", F.when(F.col("n") > 1, F.col("loading")).otherwise(1.0).alias("loading"), "n")


def cluster_scores(long: DataFrame, loadings: DataFrame) -> DataFrame:
    """``row_id, name, score``: loadings on standardised features; a feature alone passes through, unscaled."""
    named = named_loadings(loadings)
    z = standard_scale(long).select("row_id", "feature", F.col("value").alias("z"))
    both = z.join(long.select("row_id", "feature", "value"), ["row_id", "feature"]).join(named, "feature")
    return both.groupBy("row_id", "name").agg(F.sum(F.when(F.col("n") > 1, F.col("z") * F.col("loading")).otherwise(F.col("value"))).alias("score"))


def backproject(reduced: DataFrame, named: DataFrame) -> DataFrame:
    """Coefficients of reduced features, taken back to features: sums of coefficient times loading."""
    on = [c for c in ("fold", "task") if c in named.columns] + ["name"]
    by = [c for c in ("fold", "task", "iter") if c in reduced.columns]
    return reduced.join(named.select(*on, "feature", "loading"), on).groupBy(*by, "feature").agg(F.sum(F.col("coef") * F.col("loading")).alias("coef"))


def plotting(rows: DataFrame, coef: DataFrame, classification: bool) -> DataFrame:
    """``row_id, outcome_raw, feature_name, y_axis_value, x_value`` for each feature of ``coef``, joined by row id.

    rows: ``row_id, y, linear`` (a model's linear predictor), ``feature, value``.
    """
    m = rows.groupBy("feature").agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__s"))
    out = rows.join(F.broadcast(m.join(coef, "feature")), "feature")  # one row a significant feature
    out = out.withColumn("contrib", F.col("coef") * (F.col("value") - F.col("__m")) / (F.col("__s") + 1e-10)).withColumn("rest", F.col("linear") - F.col("contrib"))
    if classification:
        rest = out.groupBy("feature").agg(F.avg("rest").alias("__rest"))
        y = expit(F.col("contrib") + F.col("__rest"))
        out = out.join(F.broadcast(rest), "feature").withColumn("y_axis_value", y)
    else:
        out = out.withColumn("y_axis_value", F.col("y") - F.col("rest"))
    return out.select("row_id", F.col("y").alias("outcome_raw"), F.col("feature").alias("feature_name"), "y_axis_value", F.col("value").alias("x_value"))
