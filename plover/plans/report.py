"""Reports of an analysis, as DataFrames and as files, and the whole run."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.config import LOG, Config, load_config
from plover.operators import ingest, splits, stats, transforms
from plover.plans import changes
from plover.plans.runs import MAX_CELLS, PARAMS, Run, collect_block
from plover.sources import tables
from plover.sources.work import save, sink

FDR = 0.05


def performance(run: Run, oof: DataFrame) -> DataFrame:
    """``scope, class, task, metric, value, cv_type``: the metrics of the analysis' kind."""
    cfg, k = run.cfg, len(run.block.classes)
    loo = "loo" if isinstance(cfg.outer_folds, str) else "kfold"
    row = lambda scope, cls, task, metric, value: F.struct(F.lit(scope).alias("scope"), (cls if isinstance(cls, Column) else F.lit(cls).cast("string")).alias("class"), (task if isinstance(task, Column) else F.lit(task).cast("string")).alias("task"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    if not cfg.is_classification:
        m = stats.with_p(stats.regression_metrics(oof).withColumnRenamed("pearson", "r"))
        out = m.select(F.explode(F.array(*[row("task", None, F.col("task"), name, F.col(c)) for name, c in (("rmse", "rmse"), ("mae", "mae"), ("r2", "r2"), ("pearson_r", "r"), ("pearson_p", "p"))])).alias("x")).select("x.*")
        if len(run.block.tasks) > 1:
            out = out.unionByName(stats.macro_regression(m).select(F.explode(F.array(*[row("macro", None, "macro", n, F.col(n)) for n in ("rmse", "mae", "r2")])).alias("x")).select("x.*"))
    else:
        at = F.col("y_true").cast("int")
        loss = stats.log_loss(oof.withColumn("p_true", F.get("prob", at))).select(row("overall", None, None, "log_loss", F.col("log_loss")).alias("x"))
        rec = stats.recalls(oof)
        bal = rec.agg(F.avg("sensitivity").alias("b")).select(row("overall", None, None, "balanced_accuracy", F.col("b")).alias("x"))
        names = F.element_at(F.array(*[F.lit(str(c)) for c in run.block.classes]), (F.col("label") + 1).cast("int"))
        if k == 2:
            a = stats.auc(oof.withColumn("s", F.col("prob")[1]), F.col("y_true") == 1, "s").select(row("overall", None, None, "roc_auc", F.col("auc")).alias("x"))
            both = rec.filter("label = 1").select(F.explode(F.array(row("overall", None, None, "sensitivity", F.col("sensitivity")), row("overall", None, None, "specificity", F.col("specificity")))).alias("x"))
            out = a.unionByName(loss).unionByName(bal).unionByName(both).select("x.*")
        else:
            per = stats.auc(oof.select("y_true", F.posexplode("prob").alias("label", "s")), F.col("y_true") == F.col("label"), "s", ["label"])
            macro = per.agg(F.avg("auc").alias("auc")).select(row("macro", None, None, "roc_auc_ovr", F.col("auc")).alias("x"))
            each = per.join(rec, "label", "left").select(F.explode(F.array(*[row("class", names, None, n, F.coalesce(F.col(c), F.lit(0.0))) for n, c in (("roc_auc_ovr", "auc"), ("sensitivity", "sensitivity"), ("specificity", "specificity"))])).alias("x"))
            out = macro.unionByName(loss).unionByName(bal).unionByName(each).select("x.*")
    return out.withColumn("cv_type", F.lit(loo))


def tier1(coefs: DataFrame, n_folds: int, ci_level: float) -> DataFrame:
    """Fold-level t-tests with false discovery control, by task."""
    t = stats.fold_t_test(coefs, n_folds, ci_level, ("task", "feature"))
    t = stats.bh_fdr(t, FDR, "p", "feature", ("task",))
    return t.select("task", "feature", F.col("mean").alias("fold_mean_coef"), F.col("sd").alias("fold_sd_coef"), F.col("cv").alias("fold_cv_coef"), F.col("t").alias("t_statistic"), F.col("p").alias("p_value_t"), F.col("ci_low").alias("ci_low_t"), F.col("ci_high").alias("ci_high_t"), F.col("significant").alias("is_significant"), F.col("rejected").alias("is_significant_fdr"))


def tier2(boot: DataFrame, ci_level: float) -> DataFrame:
    """Pooled bootstrap intervals with false discovery control, by task."""
    s = stats.bootstrap_summary(boot.filter("ok"), ci_level, ("task", "feature"))
    s = stats.bh_fdr(s, FDR, "p_value", "feature", ("task",))
    return s.select("task", "feature", F.col("mean").alias("boot_mean_coef"), F.col("ci_low").alias("boot_ci_low"), F.col("ci_high").alias("boot_ci_high"), "pd", "p_value", "is_significant", F.col("rejected").alias("is_significant_fdr"))


def importance(boot: DataFrame, scale: DataFrame, ci_level: float) -> DataFrame:
    """Standardised and raw bootstrap summaries, by task."""
    t = tier2(boot, ci_level).withColumnsRenamed({"boot_mean_coef": "std_coef_mean", "boot_ci_low": "std_ci_low", "boot_ci_high": "std_ci_high"})
    t = stats.raw_scale(t, scale, ["std_coef_mean", "std_ci_low", "std_ci_high"])
    t = t.withColumnsRenamed({"raw_std_coef_mean": "raw_coef_mean", "raw_std_ci_low": "raw_ci_low", "raw_std_ci_high": "raw_ci_high"})
    return t.select("task", "feature", "std_coef_mean", "std_ci_low", "std_ci_high", "raw_coef_mean", "raw_ci_low", "raw_ci_high", "pd", "is_significant", "p_value", "is_significant_fdr")


def cluster_report(boot: DataFrame, cluster_map: DataFrame, ci_level: float) -> DataFrame:
    means = boot.filter("ok").join(F.broadcast(cluster_map), "feature").groupBy("fold", "iter", "task", "cluster").agg(F.avg("coef").alias("coef"))  # a row a feature in the map
    s = stats.bh_fdr(stats.bootstrap_summary(means, ci_level, ("task", "cluster")), FDR, "p_value", "cluster", ("task",))
    return s.select("task", F.col("cluster").alias("cluster_id"), F.col("mean").alias("std_coef_mean"), F.col("ci_low").alias("std_ci_low"), F.col("ci_high").alias("std_ci_high"), "pd", "is_significant", "p_value", F.col("rejected").alias("is_significant_fdr"))


def permutation_result(null: DataFrame, observed: float) -> DataFrame:
    return stats.permutation_p(null, float(observed)).select(F.lit(float(observed)).alias("observed_score"), "p_value", "n_permutations")


def block_result(null: DataFrame, observed: float) -> DataFrame:
    return stats.permutation_p(null, float(observed), ["block"]).select("block", F.lit(float(observed)).alias("observed_score"), "p_value")


def feature_scale(run: Run, rows_long: DataFrame) -> DataFrame:
    """``feature, scale``: the sd (ddof 1) over all rows; fold 0's training sd (ddof 0) without reduction and ``incorporate``."""
    if run.cfg.reduction == "none" and run.cfg.covariate_method != "incorporate":
        train = rows_long.join(run.fold_rows().filter("fold <> 0"), "row_id")
        return train.groupBy("feature").agg(F.stddev_pop("value").alias("scale"))
    return rows_long.groupBy("feature").agg(F.stddev_samp("value").alias("scale"))


def plotting(run: Run, report: DataFrame, rows_long: DataFrame) -> DataFrame:
    """Partial effects of significant features, each task with its own coefficients and fold 0's linear predictor."""
    import pickle

    first = run.models().filter("fold = 0").select("model").first()
    b = run.block
    z = pickle.loads(first.model).linear(run.cfg, b.x, b.cov)
    y = b.y if b.y.ndim == 2 else b.y[:, None]
    rows = [(i, t, float(y[n, min(k, y.shape[1] - 1)]), float(z[n, k])) for n, i in enumerate(b.ids) for k, t in enumerate(b.tasks)]
    base = run.spark.createDataFrame(rows, "row_id string, task string, y double, linear double")
    return _partial_effects(base, b.tasks, report, rows_long, run.cfg.is_classification)


def _partial_effects(base: DataFrame, tasks: list[str], report: DataFrame, rows_long: DataFrame, classification: bool) -> DataFrame:
    coef = save(stats.significant(report).select("task", "feature", F.col("std_coef_mean").alias("coef")), "significant")
    out = None
    for t in tasks:
        own = coef.filter(F.col("task") == t).select("feature", "coef")
        part = transforms.plotting(base.filter(F.col("task") == t).join(rows_long.join(F.broadcast(own.select("feature")), "feature"), "row_id"), own, classification).withColumn("task", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out.select("task", F.col("row_id").alias("subject_id"), "outcome_raw", "feature_name", "y_axis_value", "x_value")


def _describe(run: Run, long: DataFrame) -> None:
    """Logs the strongest univariate correlations of numeric outcomes, and folds too small for half samples."""
    b = run.block
    if not run.cfg.is_classification:
        for k, name in enumerate(b.outcomes):
            y = run.spark.createDataFrame([(i, float(v)) for i, v in zip(b.ids, b.y[:, k], strict=True)], "row_id string, y double")
            for kind, f in (("Pearson", stats.univariate_pearson), ("Spearman", stats.univariate_spearman)):
                top = stats.top_by_strength(f(long, y)).collect()
                LOG.info("%s correlations with %s: %s", kind, name, ", ".join(f"{r.feature} {r.r:.3f}" for r in top if r.r is not None))
    for r in ingest.subsample_viability(run.fold_rows(), len(b.names)).filter("warn").collect():  # a row a fold at most
        LOG.warning("half of fold %d's %d training rows are fewer than %d", r.fold, r.n_train, r.need)


def analyse(spark: SparkSession, df: DataFrame, cfg: Config, cluster_map: DataFrame | None = None, permute: bool = True) -> dict[str, DataFrame]:
    """The whole analysis: every report by name, also written to ``cfg.output_dir`` if that is set."""
    out_dir, out = cfg.output_dir, {}
    if by_moments(df, cfg):
        return analyse_moments(spark, df, cfg, permute, cluster_map)
    run = Run(spark, collect_block(df, cfg, cluster_map), cfg)

    def put(name: str, frame: DataFrame, **kw) -> DataFrame:
        out[name] = sink(frame, out_dir, name, **kw)
        return frame

    by_task = {"partition_by": ("task",)} if len(run.block.tasks) > 1 else {}
    long = tables.to_long(ingest.listwise_deletion(df), cfg.roles.row_id, run.block.names).withColumn("row_id", F.col("row_id").cast("string"))
    _describe(run, long)
    oof = save(run.out_of_fold(), "out-of-fold")
    score = run.score(oof)
    LOG.info("%s of nested cross-validation: %.6f", cfg.metric, score)
    put("out_of_fold", oof, fmt="parquet", one_file=False)
    put("nested_cv_scores", spark.createDataFrame([(score,)], "score double"))
    put("model_performance", performance(run, oof))
    if len(run.block.classes) > 2:
        put("confusion_matrix", stats.confusion_matrix(oof, [float(i) for i in range(len(run.block.classes))]).orderBy("k").drop("k"))
    models = run.models()
    put("report_fold_diagnostics", models.select(F.col("fold").alias("fold_idx"), F.col("alpha_or_c").alias("alpha_or_C"), "l1_ratio", "penalty_weight"))
    put("report_fold_params_summary", stats.param_summary(models, PARAMS))
    put("report_fold_ensemble_importance", tier1(run.coefficients(), run.n_folds, cfg.ci_level), **by_task)
    if cfg.reduction in ("cluster_pca", "apriori"):
        load = save(run.loadings(), "loadings")
        put("cluster_loadings_folds", load, partition_by=("fold",))
        put("cluster_loadings", load.filter("fold = 0").drop("fold"))
    if cfg.reduction == "ica":
        mixing = save(run.mixing(), "mixing")
        put("ica_mixing_matrix_folds", mixing, partition_by=("fold",))
        comps = [r.component for r in mixing.filter("fold = 0").select("component").distinct().orderBy(F.length("component"), "component").collect()]
        put("ica_mixing_matrix", mixing.filter("fold = 0").groupBy("feature").pivot("component", comps).agg(F.first("value")))
    sel = run.selection()
    put("report_selection_frequency", stats.selection_union(sel))
    if by_task:
        put("report_selection_frequency_tasks", stats.selection_frequency(sel, ("task", "feature")), **by_task)
    boot = run.bootstrap()
    LOG.info("%d bootstrap coefficients of models that did not converge", stats.convergence(boot.filter("ok")).first()[0])
    put("report_fold_bootstrap_ci", tier2(boot, cfg.ci_level), **by_task)
    report = put("report_feature_importance", importance(boot, feature_scale(run, long), cfg.ci_level), **by_task)
    if cfg.reduction == "apriori" and cluster_map is not None:
        put("report_cluster_importance", cluster_report(boot, cluster_map, cfg.ci_level), **by_task)
    if cfg.save_distributions:
        put("bootstrap_coef_distribution", boot, fmt="parquet", one_file=False)
    if stats.significant(report).limit(1).count():
        put("report_individual_plotting", plotting(run, report, long), one_file=False)
    if permute and cfg.n_permutations:
        null = run.null_scores()
        put(f"permutation_null_distribution_{cfg.metric}", null.select(F.col("score").alias(f"null_{cfg.metric}")))
        put("permutation_result", permutation_result(null, score))
    if cfg.blocks:
        null = run.block_null_scores()
        put("block_perm_null", null, partition_by=("block",))
        put("report_block_permutation", block_result(null, score))
    return out


def by_moments(df: DataFrame, cfg: Config, max_cells: int | None = None) -> bool:
    """Whether a table is too large for a block, and of a kind that moments serve."""
    if not changes.served(cfg):
        return False
    rows, names = ingest.role_projection(df, cfg)
    return rows.count() * max(1, len(names)) > (MAX_CELLS if max_cells is None else max_cells)


def analyse_moments(spark: SparkSession, df: DataFrame, cfg: Config, permute: bool = True, cluster_map: DataFrame | None = None) -> dict[str, DataFrame]:
    """The reports of :func:`analyse` for a regression on any number of rows."""
    from types import SimpleNamespace

    from plover.plans import moments, resample

    t, out = resample.Table(df, cfg, cluster_map), {}

    def put(name: str, frame: DataFrame, **kw) -> DataFrame:
        out[name] = sink(frame, cfg.output_dir, name, **kw)
        return frame

    by_task = {"partition_by": ("task",)} if len(t.tasks) > 1 else {}
    found = moments.NestedCV(df, cfg, cluster_map)
    oof, params = save(found.out_of_fold(), "out-of-fold"), found.params
    score = stats.macro_regression(stats.regression_metrics(oof)).first().r2
    LOG.info("%s of nested cross-validation: %.6f", cfg.metric, score)
    put("out_of_fold", oof, fmt="parquet", one_file=False)
    put("nested_cv_scores", spark.createDataFrame([(score,)], "score double"))
    put("model_performance", performance(SimpleNamespace(cfg=cfg, block=SimpleNamespace(classes=[], tasks=t.tasks)), oof))
    put("report_fold_diagnostics", params.select(F.col("fold").alias("fold_idx"), F.col("alpha_or_c").alias("alpha_or_C"), "l1_ratio", "penalty_weight"))
    put("report_fold_params_summary", stats.param_summary(params, PARAMS))
    put("report_fold_ensemble_importance", tier1(found.coefficients(), int(cfg.outer_folds), cfg.ci_level), **by_task)
    if cfg.reduction != "none":
        load = save(found.loadings(), "loadings")
        put("cluster_loadings_folds", load, partition_by=("fold",))
        put("cluster_loadings", load.filter("fold = 0").drop("fold"))
    sel = resample.selection(t, params)
    put("report_selection_frequency", stats.selection_union(sel))
    if by_task:
        put("report_selection_frequency_tasks", stats.selection_frequency(sel, ("task", "feature")), **by_task)
    boot = resample.bootstrap(t, params)
    put("report_fold_bootstrap_ci", tier2(boot, cfg.ci_level), **by_task)
    report = put("report_feature_importance", importance(boot, resample.feature_scale(t), cfg.ci_level), **by_task)
    if cfg.reduction == "apriori":
        put("report_cluster_importance", cluster_report(boot, cluster_map, cfg.ci_level), **by_task)
    if cfg.save_distributions:
        put("bootstrap_coef_distribution", boot, fmt="parquet", one_file=False)
    if stats.significant(report).limit(1).count():
        base = save(resample.linear_predictor(t, params), "linear-predictor")
        long = tables.to_long(ingest.listwise_deletion(df), cfg.roles.row_id, t.names).withColumn("row_id", F.col("row_id").cast("string"))
        put("report_individual_plotting", _partial_effects(base, t.tasks, report, long, False), one_file=False)
    if permute and cfg.n_permutations:
        null = resample.null_scores(t)
        put(f"permutation_null_distribution_{cfg.metric}", null.select(F.col("score").alias(f"null_{cfg.metric}")))
        put("permutation_result", permutation_result(null, score))
    if cfg.blocks:
        null = resample.block_null_scores(t)
        put("block_perm_null", null, partition_by=("block",))
        put("report_block_permutation", block_result(null, score))
    return out


def perm_worker_moments(df: DataFrame, cfg: Config, job_id: int, n_jobs: int, cluster_map: DataFrame | None = None) -> DataFrame:
    """One job's part of the label permutations of a large table."""
    from plover.plans import resample

    mine = splits.seed_partition(splits.seed_frame(df.sparkSession, cfg.n_permutations), n_jobs).filter(F.col("job") == job_id).orderBy("i")
    null = resample.null_scores(resample.Table(df, cfg, cluster_map), seeds=[r.seed for r in mine.select("seed").collect()])  # seeds, not rows
    return sink(null.select(F.col("score").alias(f"null_{cfg.metric}")), cfg.output_dir, f"perm_chunk_{job_id}.csv")


def perm_worker(run: Run, job_id: int, n_jobs: int) -> DataFrame:
    """One job's part of the label permutations, as a chunk with its own file."""
    cfg, spark = run.cfg, run.spark
    mine = splits.seed_partition(splits.seed_frame(spark, cfg.n_permutations), n_jobs).filter(F.col("job") == job_id).select("seed")
    from plover.functions import fitting

    shared = run.shared

    def go(batches):
        for pdf in batches:
            b = shared.value
            import numpy as np
            from dataclasses import replace

            yield pdf.assign(score=[fitting.cv_score(cfg, replace(b, y=b.y[np.random.RandomState(s).permutation(len(b.ids))]), int(s), cfg.weighted_null) for s in pdf["seed"]])

    null = mine.repartition(max(1, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(go, "seed long, score double")
    return sink(null.select(F.col("score").alias(f"null_{cfg.metric}")), cfg.output_dir, f"perm_chunk_{job_id}.csv")


def aggregate(spark: SparkSession, cfg: Config) -> DataFrame:
    """The p-value from the chunks of all jobs and the saved score; the data file isn't read."""
    null = tables.scan_null_chunks(spark, cfg.output_dir)
    observed = tables.scan_score(spark, f"{cfg.output_dir}/nested_cv_scores")
    sink(null.select(F.col("score").alias(f"null_{cfg.metric}")), cfg.output_dir, f"permutation_null_distribution_{cfg.metric}")
    return sink(permutation_result(null, observed), cfg.output_dir, "permutation_result")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plover", description="Penalised predictive modelling and inference on Spark")
    p.add_argument("--config")
    p.add_argument("--mode", choices=("main", "perm_worker", "aggregate"), default="main")
    p.add_argument("--job_id", type=int, default=0)
    p.add_argument("--n_jobs", type=int, default=1)
    p.add_argument("--skip_main_perm", action="store_true")
    a = p.parse_args(argv)
    if not a.config:
        p.print_help()
        return 1
    prefix = f"[Job {a.job_id}] " if a.job_id else ""
    logging.basicConfig(level=logging.INFO, format=f"%(asctime)s {prefix}%(message)s", stream=sys.stdout)
    try:
        cfg = load_config(a.config)
        if cfg.output_dir and "://" not in cfg.output_dir:
            os.makedirs(cfg.output_dir, exist_ok=True)
            handler = logging.FileHandler(os.path.join(cfg.output_dir, "pipeline.log"))
            handler.setFormatter(logging.Formatter(f"%(asctime)s {prefix}%(message)s"))
            logging.getLogger().addHandler(handler)
        spark = SparkSession.builder.appName("plover").getOrCreate()
        if a.mode == "aggregate":
            aggregate(spark, cfg)
            return 0
        df = tables.scan_subjects(spark, cfg.data_file, cfg.roles)
        cmap = tables.scan_cluster_map(spark, cfg.cluster_map_file) if cfg.cluster_map_file else None
        if a.mode == "perm_worker":
            if by_moments(df, cfg):
                perm_worker_moments(df, cfg, a.job_id, a.n_jobs, cmap)
            else:
                perm_worker(Run(spark, collect_block(df, cfg, cmap), cfg), a.job_id, a.n_jobs)
        else:
            analyse(spark, df, cfg, cmap, permute=not a.skip_main_perm)
        return 0
    except Exception:
        LOG.exception("the analysis failed")
        return 1


if __name__ == "__main__":
    sys.exit(main())
