from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plover.config import Config, Roles
from plover.functions import fitting
from plover.operators import ingest, splits, stats
from plover.plans import moments, report
from plover.plans.runs import Run, collect_block, predict_ensemble
from plover.sources import tables


def data(n=120, p=6, seed=0, kind="regression"):
    r = np.random.RandomState(seed)
    x = r.normal(size=(n, p))
    lin = 2 * x[:, 0] - 1.5 * x[:, 1]
    y = {"regression": lin + 0.3 * r.normal(size=n), "binary": (lin + r.normal(size=n) > 0).astype(float), "multiclass": np.digitize(lin + 0.3 * r.normal(size=n), [-1, 1]).astype(float)}[kind]
    d = pd.DataFrame({"SUBJ_ID": [f"s{i:03d}" for i in range(n)], "y": y, "y2": x[:, 0] - x[:, 2] + 0.3 * r.normal(size=n), "cov": r.normal(size=n), "w": r.uniform(0.5, 2, size=n)})
    return d.assign(**{f"brain_{i}": x[:, i] for i in range(p)})


def config(kind="regression", **kw):
    base = dict(roles=Roles("SUBJ_ID", "y", "brain"), analysis_type="regression" if kind == "regression" else "classification", analysis_mode="predict", outer_folds=4, inner_folds=3, n_candidates=4, n_permutations=9, n_bootstraps=50, n_block_permutations=9)
    base["model_params"] = {"alpha_min_predict": 1e-3, "alpha_max_predict": 0.1} if kind == "regression" else {"alpha_min_predict": 0.1, "alpha_max_predict": 10}
    return Config(**(base | kw))


def block(spark, d, cfg):
    return collect_block(spark.createDataFrame(d), cfg)


def test_incomplete_rows(spark):
    d = data()
    d.loc[3, "brain_0"] = np.nan
    cfg = config()
    assert len(block(spark, d, cfg).ids) == 119
    d["empty"] = np.nan
    with pytest.raises(ValueError, match="complete"):
        block(spark, d, cfg)


def test_negative_weights_and_missing_columns(spark):
    d = data()
    d.loc[0, "w"] = -1
    with pytest.raises(ValueError, match="negative"):
        block(spark, d, config(roles=Roles("SUBJ_ID", "y", "brain", (), "w")))
    with pytest.raises(ValueError, match="missing"):
        block(spark, d, config(roles=Roles("SUBJ_ID", "y", "brain", ("nope",)), covariate_method="incorporate"))


def test_size_bound(spark):
    with pytest.raises(ValueError, match="bound"):
        collect_block(spark.createDataFrame(data()), config(), max_cells=100)


def test_config_validation():
    with pytest.raises(ValueError):
        config(reduction="nope")
    with pytest.raises(ValueError):
        config(distance="nope")
    with pytest.raises(ValueError):
        config(model_params={"l1_min_predict": 0.5, "l1_max_predict": 0.5})
    raw = {"analysis_type": "classification", "paths": {}, "data_cols": {"subject_id_col": "i", "post_score_col": ["a", "b"], "brain_feature_substr": "x", "covariate_cols": None}, "cv_params": {"n_random_search_iter": 5}, "stats_params": {"n_bootstraps": 10}}
    cfg = Config.from_dict(raw)
    assert cfg.roles.outcomes == ("a", "b") and cfg.n_permutations == 10_000 and cfg.fold_bootstraps == 50 and cfg.metric == "roc_auc"
    with pytest.raises(ValueError, match="n_random_search_iter"):
        Config.from_dict(raw | {"cv_params": {}})


def test_feature_overlap_is_left_out():
    roles = Roles("brain_id", "y", "brain", ("brain_cov",), "brain_w")
    cols = ["brain_id", "y", "brain_cov", "brain_w", "brain_1"]
    assert ingest.feature_columns(cols, roles) == ["brain_1"]
    assert ingest.feature_columns(cols, roles, overlap=True) == ["brain_cov", "brain_w", "brain_1"]
    assert ingest.block_columns(["brain_1"], "zzz") == []


def test_folds_of_both_forms_agree(spark):
    d = data(50)
    f = {r.row_id: r.fold for r in splits.kfold(spark.createDataFrame([(i,) for i in d.SUBJ_ID], "row_id string"), 7).collect()}
    mine = fitting.folds(list(d.SUBJ_ID), None, 7, 42)
    assert [f[i] for i in d.SUBJ_ID] == mine.tolist()
    assert sorted(np.bincount(mine)) == [7] * 6 + [8]


def test_no_leakage(spark):
    d = data()
    cfg = config()
    b = block(spark, d, cfg)
    f = fitting.folds(b.ids, None, 4, 42)
    one = fitting.fit_fold(cfg, b.take(np.flatnonzero(f != 0)), 0, None)
    x = b.x.copy()
    x[f == 0] += 100
    two = fitting.fit_fold(cfg, replace(b, x=x).take(np.flatnonzero(f != 0)), 0, None)
    assert np.array_equal(one.coef, two.coef)


def test_weight_scale_invariance(spark):
    d = data()
    cfg = config(roles=Roles("SUBJ_ID", "y", "brain", (), "w"))
    a = fitting.cv_score(cfg, block(spark, d, cfg), 1, True)
    b = fitting.cv_score(cfg, block(spark, d.assign(w=d.w * 7), cfg), 1, True)
    assert abs(a - b) < 1e-9


@pytest.mark.parametrize("method", ["none", "incorporate"])
def test_moments_equal_rows(spark, method):
    cfg = config(roles=Roles("SUBJ_ID", ("y", "y2"), "brain", ("cov",), "w"), covariate_method=method, n_candidates=1)
    d = spark.createDataFrame(data())
    oof, coefs, params = moments.nested_cv(d, cfg)
    run = Run(spark, collect_block(d, cfg), cfg)
    p = {r.fold: r.asDict() for r in params.collect()}
    want = {}
    for k in range(run.n_folds):
        m = fitting.fit_fold(cfg, run.block.take(np.flatnonzero(run.folds != k)), k, {c: p[k][c] for c in ("alpha_or_c", "l1_ratio", "penalty_weight")})
        y, z = fitting.predict_fold(cfg, m, run.block.take(np.flatnonzero(run.folds == k)))
        for i, row in zip(run.block.take(np.flatnonzero(run.folds == k)).ids, z, strict=True):
            want[i] = row
    got = {(r.row_id, r.task): r.y_pred for r in oof.collect()}
    assert max(abs(got[i, t] - want[i][j]) for i in want for j, t in enumerate(("y", "y2"))) < 1e-6
    assert coefs.count() == 4 * 2 * 6


def test_ml_fit_matches_own_solver(spark):
    from pyspark.ml.feature import VectorAssembler

    d = data(80)
    names = [f"brain_{i}" for i in range(6)]
    z = (d[names] - d[names].mean()) / d[names].std(ddof=0)
    df = VectorAssembler(inputCols=names, outputCol="features").transform(spark.createDataFrame(z.assign(label=d.y, w=1.0)))
    params = {"alpha_or_c": 0.2, "l1_ratio": 0.5, "penalty_weight": 1.0}
    own = fitting.fit_model(config(), z.to_numpy(), 0, d[["y"]].to_numpy(), 0, params, None)
    assert np.allclose(moments.ml_fit(df, config(), params).coefficients.toArray(), own.coef[0], atol=1e-5)
    b = data(80, kind="binary")
    df = VectorAssembler(inputCols=names, outputCol="features").transform(spark.createDataFrame(z.assign(label=b.y, w=1.0)))
    own = fitting.fit_model(config("binary"), z.to_numpy(), 0, b.y.to_numpy().astype(int), 2, params, None)
    assert np.allclose(moments.ml_fit(df, config("binary"), params).coefficients.toArray(), own.coef[0], atol=1e-3)


@pytest.mark.parametrize("kind,reduction,extra", [
    ("regression", "none", {}),
    ("binary", "apriori", {}),
    ("multiclass", "ica", {"ica_components": 2}),
    ("regression", "cluster_pca", {"roles": Roles("SUBJ_ID", ("y", "y2"), "brain", ("cov",), "w"), "covariate_method": "pre_regress", "min_cluster_size": 3}),
])
def test_whole_analysis(spark, tmp_path, kind, reduction, extra):
    d = spark.createDataFrame(data(90, kind=kind))
    cmap = spark.createDataFrame([(f"brain_{i}", f"c{i // 2}") for i in range(6)], "feature string, cluster string")
    cfg = config(kind, reduction=reduction, n_candidates=2, n_bootstraps=5, n_permutations=4, n_block_permutations=4, blocks={"first": "brain_0", "none": "zzz"}, output_dir=str(tmp_path), **extra)
    Run_ = report.Run
    class Fewer(Run_):  # noqa: E301,N801
        def bootstrap(self, n=None):
            return super().bootstrap(3)

        def selection(self, n=None):
            return super().selection(3)

    report.Run = Fewer
    try:
        out = report.analyse(spark, d, cfg, cmap)
    finally:
        report.Run = Run_
    assert {"model_performance", "nested_cv_scores", "report_feature_importance", "report_fold_ensemble_importance", "report_selection_frequency", "permutation_result", "report_block_permutation"} <= set(out)
    # Unrelated features are all noise to the density clusters, and one component holds little of the outcome.
    assert out["nested_cv_scores"].first()[0] > (0.4 if reduction != "cluster_pca" else -0.5)
    n_tasks = {"regression": 2 if extra.get("roles") else 1, "binary": 1, "multiclass": 3}[kind]
    assert out["report_feature_importance"].count() == 6 * n_tasks
    p = out["permutation_result"].first()
    assert 1 / 5 <= p.p_value <= 1 and p.n_permutations == 4
    assert [r.block for r in out["report_block_permutation"].collect()] == ["first"]
    assert (tmp_path / "report_feature_importance").exists()
    if kind == "multiclass":
        assert "confusion_matrix" in out and "ica_mixing_matrix" in out
    agg = report.aggregate(spark, replace(cfg, output_dir=str(_chunks(spark, tmp_path, cfg))))
    assert agg.first().n_permutations == 3


def _chunks(spark, tmp_path, cfg):
    folder = tmp_path / "chunks"
    for j, rows in enumerate(([0.1, 0.2], [0.3])):
        spark.createDataFrame([(x,) for x in rows], f"null_{cfg.metric} double").coalesce(1).write.option("header", True).csv(f"{folder}/perm_chunk_{j}.csv")
    spark.createDataFrame([(0.25,)], "score double").coalesce(1).write.option("header", True).csv(f"{folder}/nested_cv_scores")
    return folder


def test_perm_worker_parts(spark):
    cfg = config(n_permutations=3, n_candidates=1)
    run = Run(spark, block(spark, data(40), cfg), cfg)
    assert [report.perm_worker(run, j, 2).count() for j in range(2)] == [2, 1]


def test_leave_one_out(spark):
    cfg = config(outer_folds="loo", inner_folds="loo", n_candidates=1)
    assert fitting.cv_score(cfg, block(spark, data(20), cfg), 1) > 0.5


def test_single_feature_and_constant(spark):
    d = data(40, p=3).drop(columns=["brain_1", "brain_2"]).assign(brain_c=1.0)
    cfg = config(n_candidates=1)
    run = Run(spark, block(spark, d, cfg), cfg)
    coefs = run.coefficients().toPandas()
    assert (coefs[coefs.feature == "brain_c"].coef == 0).all()


def test_ensemble_and_stream(spark, tmp_path):
    from plover.streaming.scoring import score_stream

    cfg = config(n_candidates=2)
    d = data(60)
    run = Run(spark, block(spark, d, cfg), cfg)
    rows, _ = ingest.role_projection(spark.createDataFrame(d), cfg)
    got = {r.row_id: (r.mean, r.sd) for r in predict_ensemble(run.models(), rows, cfg).collect()}
    assert np.corrcoef([got[i][0] for i in d.SUBJ_ID], d.y)[0, 1] > 0.95
    rows.write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), run.models(), cfg)
    q = stream.writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    again = {r.row_id: (r["mean"], r.sd) for r in spark.sql("SELECT * FROM scored").collect()}
    assert again == got


def test_csv_scan(spark, tmp_path):
    (tmp_path / "d.csv").write_text("SUBJ_ID,y,brain_1,other\na,1,2.5,x\nb,NA,3,x\nc,2,,x\nd,3,4,None\ne,5,6,z\n")
    roles = Roles("SUBJ_ID", "y", "brain")
    df = tables.scan_subjects(spark, str(tmp_path / "d.csv"), roles)
    assert dict(df.dtypes)["brain_1"] == "double"
    assert sorted(r.SUBJ_ID for r in ingest.listwise_deletion(df).collect()) == ["a", "e"]
    (tmp_path / "m.csv").write_text("f1,1\nf2,2\n")
    m = tables.scan_cluster_map(spark, str(tmp_path / "m.csv"))
    assert {(r.feature, r.cluster) for r in m.collect()} == {("f1", "1"), ("f2", "2")}
    with pytest.raises(ValueError):
        tables.scan_cluster_map(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(ValueError, match="f3"):
        ingest.check_coverage(spark.createDataFrame([("f1",), ("f3",)], "feature string"), m)


def test_bh_edge_cases(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", float("nan")), ("c", 0.04), ("d", 0.9)], "feature string, p double")
    got = {r.feature: r.rejected for r in stats.bh_fdr(df).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}
    assert stats.bh_fdr(df.filter("p > 2 AND NOT isnan(p)")).count() == 0


def test_permutation_is_a_bijection(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("row_id"), F.col("id").alias("v"))
    got = [r.v for r in splits.permuted(df, ["v"], 3).collect()]
    assert sorted(got) == list(range(50)) and got != list(range(50))


def test_command_line_help(capsys):
    assert report.main([]) == 1
    assert "plover" in capsys.readouterr().out
