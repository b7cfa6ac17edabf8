"""Aggregates, metrics and ranking operators, as DataFrame compositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.functions.tdist import t_quantile, two_sided_p

EPS = 2.220446049250313e-16  # of double precision


# --- correlation -------------------------------------------------------------------------------------------------


PARTS = 64


def prefix_sums(df: DataFrame, value: str, by: Sequence[str], columns: Sequence[str], parts: int = PARTS) -> DataFrame:
    """``__before_<column>``: sums over smaller values within ``by``; values are unique there.

    Approximate quantiles cut each group into ranges, range sums come first, and a task orders one range: not a whole
    group, which may be the whole table.
    """
    by = list(by)
    cuts = F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(1000))
    cut = df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(cuts.alias("__cuts"))  # one row a group
    on = [df[c].eqNullSafe(cut[f"__{c}"]) for c in by]
    rows = df.join(F.broadcast(cut) if not by else cut, on or None, "inner" if by else "cross").drop(*[f"__{c}" for c in by])
    rows = rows.withColumn("__part", F.size(F.filter("__cuts", lambda x: x < F.col(value)))).drop("__cuts")
    own = rows.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__sum_{c}") for c in columns])
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__part")  # parts rows a group at most
    own = own.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__part").alias("__k_part"), *[(F.sum(f"__sum_{c}").over(w) - F.col(f"__sum_{c}")).alias(f"__base_{c}") for c in columns])
    local = Window.partitionBy(*by, "__part").orderBy(value)
    rows = rows.select("*", *[(F.sum(c).over(local) - F.col(c)).alias(f"__in_{c}") for c in columns])
    match = [rows[c].eqNullSafe(own[f"__k_{c}"]) for c in by] + [rows["__part"] == own["__k_part"]]
    out = rows.join(own, match)
    return out.select(*df.columns, *[(F.col(f"__base_{c}") + F.col(f"__in_{c}")).alias(f"__before_{c}") for c in columns])


def average_rank(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``rank``: average ranks of ``value`` within ``by``; ties are folded to counts first."""
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__c"))
    ranks = prefix_sums(counts, value, by, ["__c"]).withColumn("rank", F.col("__before___c") + (F.col("__c") + 1) / 2)
    return df.join(ranks.select(*by, value, "rank"), [*by, value])


def univariate_pearson(long: DataFrame, y: DataFrame) -> DataFrame:
    """``feature, f_idx, r`` of a long table with ``row_id, y``."""
    return long.join(y, "row_id").groupBy("feature", "f_idx").agg(F.corr("value", "y").alias("r"))


def univariate_spearman(long: DataFrame, y: DataFrame) -> DataFrame:
    ranked = average_rank(long, "value", ["feature", "f_idx"]).select("row_id", "feature", "f_idx", F.col("rank").alias("value"))
    ry = average_rank(y, "y").select("row_id", F.col("rank").alias("y"))
    return univariate_pearson(ranked, ry)


def top_by_strength(corr: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest absolute correlations (a top-n per task, then a merge)."""
    return corr.orderBy(F.abs("r").desc(), "feature").limit(n)


def _moment_sums(df: DataFrame, vector: str) -> DataFrame:
    """Each pair's sums over all rows, computed by task in NumPy: rows ``i, s, g`` with g the i-th row of X'X."""
    import numpy as np
    import pandas as pd

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["v"].to_numpy()).astype(float)])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "g": list(total)})

    part = df.select(F.col(vector).alias("v")).mapInPandas(run, "i int, g array<double>")
    return part.groupBy("i").applyInPandas(lambda pdf: pd.DataFrame({"i": [pdf["i"].iloc[0]], "g": [np.sum(np.stack(pdf["g"].to_numpy()), axis=0)]}), "i int, g array<double>")


def corr_matrix(df: DataFrame, vector: str = "features") -> DataFrame:
    """``i, j, r`` for i <= j from one pass over an array column: sums of products by task, then one row for each feature.

    The long form with a self-join would make rows times features squared of pairs; this makes tasks times features.
    """
    import numpy as np
    import pandas as pd

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.stack(pdf.sort_values("i")["g"].to_numpy())
        n, m = g[0, 0], g[0, 1:] / g[0, 0]
        cov = g[1:, 1:] / n - np.outer(m, m)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        with np.errstate(all="ignore"):
            r = np.where(np.outer(sd, sd) > 0, cov / np.outer(sd, sd), np.nan)
        i, j = np.triu_indices(len(r))
        return pd.DataFrame({"i": i, "j": j, "r": r[i, j]})

    # One group: features squared numbers, which is what the result holds too.
    return _moment_sums(df, vector).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(finish, "i int, j int, r double")


def corr_distance(r: Column, signed: bool = False) -> Column:
    """Distance of a correlation: sqrt(2 (1 - |r|)), or sqrt(2 (1 - r)); a missing one counts as 0; within [0, 2]."""
    r = F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))
    x = 2 * (1 - (r if signed else F.abs(r)))
    return F.least(F.greatest(F.sqrt(F.greatest(x, F.lit(0.0))), F.lit(0.0)), F.lit(2.0))


def auto_min_cluster(n_features: Column, n_rows: Column) -> Column:
    """max(3, int(ceil(log2(P) * (100 / N) ** 0.25)))."""
    return F.greatest(F.lit(3), F.ceil(F.log2(n_features) * F.pow(100 / n_rows, F.lit(0.25)))).cast("bigint")


def feature_moments(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd0"), F.stddev_samp("value").alias("sd1"))


# --- metrics of out-of-fold predictions ----------------------------------------------------------------------------


def regression_metrics(oof: DataFrame, by: str = "task") -> DataFrame:
    """``task, rmse, mae, r2, pearson`` of ``task, y_true, y_pred``; R2 is about the mean of the pooled outcomes."""
    e = F.col("y_true") - F.col("y_pred")
    out = oof.groupBy(by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop("y_true") * F.count("*"))).alias("r2"), F.corr("y_true", "y_pred").alias("pearson"), F.count("*").alias("n"))
    return out


def macro_regression(metrics: DataFrame) -> DataFrame:
    """Over tasks: RMSE of the mean squared error, the means of MAE and R2."""
    return metrics.agg(F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))).alias("rmse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"))


def with_p(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """``p``: two-sided p-value of a Pearson correlation, from t with n - 2 degrees of freedom."""
    t = F.col(r) * F.sqrt((F.col(n) - 2) / F.greatest(1 - F.col(r) * F.col(r), F.lit(1e-300)))
    return df.withColumn("p", two_sided_p(t, F.col(n) - 2))


def auc(df: DataFrame, positive: Column, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUC with average ranks.  Scores are folded to counts of positives and negatives first."""
    by = list(by)
    counts = df.withColumn("__p", positive.cast("int")).groupBy(*by, score).agg(F.sum("__p").alias("p"), F.sum(1 - F.col("__p")).alias("q"))
    wins = prefix_sums(counts, score, by, ["q"]).withColumn("u", F.col("p") * (F.col("__before_q") + F.col("q") / 2))
    return wins.groupBy(*by).agg(F.when((F.sum("p") > 0) & (F.sum("q") > 0), F.sum("u") / (F.sum("p") * F.sum("q"))).alias("auc"))


def log_loss(df: DataFrame, p_true: str = "p_true", eps: float = EPS) -> DataFrame:
    return df.agg(F.avg(-F.log(F.least(F.greatest(F.col(p_true), F.lit(eps)), F.lit(1 - eps)))).alias("log_loss"))


def recalls(df: DataFrame) -> DataFrame:
    """``label, sensitivity, specificity`` of each label of ``y_true``, from the confusion counts; 0 where undefined."""
    cells = df.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    n = cells.groupBy("y_true").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = cells.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("m"))
    total = cells.agg(F.sum("n").alias("all"))
    out = n.withColumnRenamed("y_true", "label").join(pred, "label", "left").join(F.broadcast(total), how="cross")
    neg = F.col("all") - F.col("t")
    fp = F.coalesce("m", F.lit(0)) - F.col("tp")
    return out.select("label", F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0).alias("sensitivity"), F.when(neg > 0, (neg - fp) / neg).otherwise(0.0).alias("specificity"))


def balanced_accuracy(df: DataFrame) -> DataFrame:
    return recalls(df).agg(F.avg("sensitivity").alias("balanced_accuracy"))


def confusion_matrix(df: DataFrame, labels: Sequence) -> DataFrame:
    """Counts, a row for each true label and a column ``c<k>`` for each predicted one, in the labels' order."""
    at = {v: i for i, v in enumerate(labels)}
    number = lambda c: F.coalesce(*[F.when(F.col(c) == v, F.lit(i)) for v, i in at.items()])
    counts = df.select(number("y_true").alias("k"), number("y_pred").alias("p")).groupBy("k").agg(*[F.sum((F.col("p") == i).cast("bigint")).alias(f"c{i}") for i in at.values()])
    return counts.withColumn("k", F.col("k").cast("bigint"))


# --- inference ------------------------------------------------------------------------------------------------------


def fold_t_test(coefs: DataFrame, n_folds: int, ci_level: float = 0.95, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean, sd, cv, t, p, interval and significance of each feature's fold coefficients (``feature, fold, coef``)."""
    q = t_quantile(1 - (1 - ci_level) / 2, n_folds - 1)
    out = coefs.groupBy(*by).agg(F.avg("coef").alias("mean"), F.coalesce(F.stddev_samp("coef"), F.lit(float("nan"))).alias("sd"), F.count("*").alias("n"))
    se = F.col("sd") / F.sqrt(F.col("n"))
    out = out.withColumn("cv", F.when(F.abs("mean") > 1e-30, F.abs(F.col("sd") / F.col("mean"))).otherwise(float("nan")))
    t = F.when(se > 0, F.col("mean") / se).when(F.col("mean") == 0, float("nan")).otherwise(F.signum("mean") * float("inf"))
    out = out.withColumn("t", t).withColumn("ci_low", F.col("mean") - q * se).withColumn("ci_high", F.col("mean") + q * se)
    return out.withColumn("significant", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)) & ~F.isnan("sd")).withColumn("p", two_sided_p(F.col("t"), F.lit(float(n_folds - 1))))


def param_summary(models: DataFrame, params: Sequence[str]) -> DataFrame:
    """``param, mean, sd, min, max, n_folds`` of fold parameters; parameters without any value are left out."""
    long = models.select(F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("v")) for p in params])).alias("x")).select("x.*")
    long = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return long.groupBy("param").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n_folds"))


def direction(x: str = "coef") -> Column:
    """Probability of direction; zeros count in the denominator."""
    return F.greatest(F.avg((F.col(x) > 0).cast("double")), F.avg((F.col(x) < 0).cast("double")))


def direction_p(pd_: Column) -> Column:
    return F.least(F.greatest(2 * (1 - pd_), F.lit(0.0)), F.lit(1.0))


def bootstrap_summary(boot: DataFrame, ci_level: float = 0.95, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean, exact percentile interval, direction and p-value of ``coef`` for each feature."""
    a = (1 - ci_level) / 2
    out = boot.groupBy(*by).agg(F.avg("coef").alias("mean"), F.percentile("coef", F.array(F.lit(a), F.lit(1 - a))).alias("q"), direction().alias("pd"))
    out = out.withColumn("ci_low", F.col("q")[0]).withColumn("ci_high", F.col("q")[1]).drop("q")
    return out.withColumn("p_value", direction_p(F.col("pd"))).withColumn("is_significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def safe_divide(x: Column, s: Column) -> Column:
    return F.when(s != 0, x / s).otherwise(0.0)


def raw_scale(summary: DataFrame, scale: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``raw_<column>``: standardised values in the feature's units; a feature without a scale has 1, scale 0 gives 0."""
    s = F.coalesce("scale", F.lit(1.0))
    out = summary.join(scale, "feature", "left")
    return out.select("*", *[safe_divide(F.col(c), s).alias(f"raw_{c}") for c in columns]).drop("scale")


def permutation_p(null: DataFrame, observed: float | Column, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """(number of null scores at least as high + 1) / (number + 1)."""
    obs = F.lit(observed) if isinstance(observed, float) else observed
    return null.groupBy(*by).agg(((F.sum((F.col(score) >= obs).cast("bigint")) + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("n_permutations"))


def selection_frequency(sel: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    return sel.groupBy(*by).agg(F.avg(F.col("selected").cast("double")).alias("selection_probability"))


def selection_union(sel: DataFrame) -> DataFrame:
    """Selected in any task of an iteration, then the mean over iterations."""
    any_ = sel.groupBy("fold", "iter", "feature").agg(F.max("selected").alias("selected"))
    return selection_frequency(any_)


def cluster_importance(boot: DataFrame, cluster_map: DataFrame, ci_level: float = 0.95) -> DataFrame:
    """The summary of each cluster's mean coefficient per iteration."""
    small = boot.join(F.broadcast(cluster_map), "feature") if _small(cluster_map) else boot.join(cluster_map, "feature")
    means = small.groupBy("fold", "iter", "cluster").agg(F.avg("coef").alias("coef"))
    return bootstrap_summary(means, ci_level, ("cluster",)).withColumnRenamed("cluster", "cluster_id")


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def failure_rate(boot: DataFrame) -> DataFrame:
    """``n, failed, rate, level``: over 50 % failed is an error, over 5 % a warning."""
    out = boot.agg(F.count("*").alias("n"), F.coalesce(F.sum((~F.col("ok")).cast("bigint")), F.lit(0)).alias("failed"))
    rate = F.col("failed") / F.col("n")
    return out.withColumn("rate", rate).withColumn("level", F.when(rate > 0.5, "error").when(rate > 0.05, "warning").otherwise("info"))


def convergence(boot: DataFrame) -> DataFrame:
    return boot.agg(F.coalesce(F.sum((~F.col("converged")).cast("bigint")), F.lit(0)).alias("n_not_converged"))


def bh_fdr(df: DataFrame, q: float = 0.05, p: str = "p", key: str = "feature", by: Sequence[str] = ()) -> DataFrame:
    """``rejected``: Benjamini-Hochberg at level q; NaN sorts last, is never rejected, and counts in n."""
    by = list(by)
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = part.orderBy(F.col(p).asc_nulls_last(), key)
    out = df.withColumn("__rn", F.row_number().over(w)).withColumn("__n", F.count("*").over(part))
    passed = F.when(~F.isnan(p) & (F.col(p) <= F.col("__rn") * F.lit(q) / F.col("__n")), F.col("__rn"))
    out = out.withColumn("__max", F.max(passed).over(part))
    return out.withColumn("rejected", F.coalesce(F.col("__rn") <= F.col("__max"), F.lit(False))).drop("__rn", "__n", "__max")


def best_candidate(scores: DataFrame) -> DataFrame:
    """``fold, cand_id, mean_score``: the highest mean inner score; the first candidate wins ties."""
    means = scores.groupBy("fold", "cand_id").agg(F.avg("score").alias("mean_score"))
    best = means.groupBy("fold").agg(F.max(F.struct(F.col("mean_score"), (-F.col("cand_id")).alias("neg"))).alias("b"))
    return best.select("fold", (-F.col("b.neg")).alias("cand_id"), F.col("b.mean_score").alias("mean_score"))


def ensemble(preds: DataFrame, by: str = "row_id") -> DataFrame:
    """Mean and sd (ddof 1) over fold models."""
    return preds.groupBy(by).agg(F.avg("pred").alias("mean"), F.stddev_samp("pred").alias("sd"))


def significant(report: DataFrame, flag: str = "is_significant") -> DataFrame:
    return report.filter(F.col(flag))
