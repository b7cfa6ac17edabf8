"""Reductions and residuals from moments against those on rows."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plover.config import Roles
from plover.functions import fitting, reducers, solvers
from plover.operators import ingest, splits
from plover.plans import changes, moments, report, resample
from plover.plans.runs import Run, collect_block, predict_ensemble
from tests.test_engine import config, data

CASES = [
    {"reduction": "apriori"},
    {"reduction": "apriori", "covariate_method": "incorporate"},
    {"reduction": "apriori", "covariate_method": "pre_regress"},
    {"reduction": "cluster_pca", "distance": "pearson", "min_cluster_size": 3, "covariate_method": "pre_regress"},
    {"reduction": "none", "covariate_method": "pre_regress"},
]


def table(n=150):
    """Correlated features, far from zero; two covariates and one that repeats them."""
    d = data(n)
    for i in (1, 2):
        d[f"brain_{i}"] = d["brain_0"] + 0.3 * i * d[f"brain_{i}"]
    for i in range(6):
        d[f"brain_{i}"] = 1000.0 + 3 * d[f"brain_{i}"]
    d["cov2"] = np.arange(n) % 7
    d["cov3"] = 2 * d["cov"] - d["cov2"]
    d["y"] = d["y"] + 2 * d["cov"] - d["cov2"]
    return d


def fold_models(run_block, folds, cfg, params):
    return [fitting.fit_fold(cfg, run_block.take(np.flatnonzero(folds != k)), k, params[k]) for k in range(4)]


@pytest.mark.parametrize("case", CASES)
def test_moments_equal_rows(spark, case):
    cfg = config(roles=Roles("SUBJ_ID", ("y", "y2"), "brain", ("cov", "cov2", "cov3") if "pre" in case.get("covariate_method", "") else ("cov", "cov2"), "w"), n_candidates=1, **case)
    df = spark.createDataFrame(table()).repartition(3)
    cmap = spark.createDataFrame([(f"brain_{i}", f"c{min(i // 3, 1) if i < 5 else 2}") for i in range(6)], "feature string, cluster string")
    got = moments.NestedCV(df, cfg, cmap)
    b = collect_block(df, cfg, cmap)
    folds = fitting.folds(b.ids, None, 4, cfg.seed)
    params = {r.fold: {p: r[p] for p in moments.PARAMS} for r in got.params.collect()}
    oof = {(r.row_id, r.task): (r.y_true, r.y_pred) for r in got.out_of_fold().collect()}
    coef = {(r.fold, r.task, r.feature): r.coef for r in got.coefficients().collect()}
    reduced = {(r.fold, r.task, r.feature): r.coef for r in got.coefficients(reduced=True).collect()}
    loadings = {(r.fold, r.cluster, r.feature): r.loading for r in got.loadings().collect()}
    assert len(oof) == 2 * len(b.ids)
    shown = {r.row_id: r for r in got.representative().collect()}
    first = fold_models(b, folds, cfg, params)[0]
    want = np.column_stack([b.cov[:, : first.n_covs], first.reducer.transform(b.x)])
    assert len(shown) == len(b.ids) and shown[b.ids[0]].names == list(cfg.roles.covariates)[: first.n_covs] + first.reducer.names
    assert np.allclose([shown[i]["values"] for i in b.ids], want, atol=1e-6)
    n_reduced = n_loadings = 0
    for k, m in enumerate(fold_models(b, folds, cfg, params)):
        te = b.take(np.flatnonzero(folds == k))
        y, z = fitting.predict_fold(cfg, m, te)
        for i, row in enumerate(te.ids):
            for j, t in enumerate(("y", "y2")):
                assert oof[row, t] == pytest.approx((y[i, j], z[i, j]), abs=1e-6)
        for j, t in enumerate(("y", "y2")):
            assert [coef[k, t, n] for n in b.names] == pytest.approx(m.coef[j].tolist(), abs=1e-7)
            assert [reduced[k, t, n] for n in m.reducer.names] == pytest.approx(m.reduced[j].tolist(), abs=1e-7)
            n_reduced += len(m.reducer.names)
        for c, f, w in m.reducer.loadings():
            assert loadings[k, c, f] == pytest.approx(w, abs=1e-7)
            n_loadings += 1
    assert (len(reduced), len(loadings)) == (n_reduced, n_loadings)


def test_search_scores_match_rows(spark):
    cfg = config(roles=Roles("SUBJ_ID", "y", "brain", ("cov", "cov2")), reduction="apriori", covariate_method="pre_regress", n_candidates=5)
    df = spark.createDataFrame(table(400))
    cmap = spark.createDataFrame([(f"brain_{i}", f"c{i // 3}") for i in range(6)], "feature string, cluster string")
    got = {(r.fold, r.cand_id): r.score for r in moments.NestedCV(df, cfg, cmap).scored.collect()}
    b = collect_block(df, cfg, cmap)
    folds = fitting.folds(b.ids, None, 4, cfg.seed)
    for k in range(4):
        tr = b.take(np.flatnonzero(folds != k))
        (y,), _ = fitting.residualise(cfg, tr)
        want = fitting.search_scores(cfg, tr, reducers.fit_reducer(tr.x, tr.names, cfg, tr.cluster_map).transform(tr.x), 0, y, fitting.candidates(cfg, 5, 42))
        assert [got[k, i] for i in range(5)] == pytest.approx(want, rel=0.02)  # inner folds differ by a row or so


def test_collinear_and_constant_covariates():
    r = np.random.RandomState(0)
    c = r.normal(size=(50, 2))
    x = np.column_stack([c, c[:, 0] - c[:, 1], np.full(50, 7.0)])
    y = (c @ np.array([[1.0], [2.0]])) + r.normal(size=(50, 1))
    a = np.column_stack([np.ones(50), x, y])
    slopes, intercepts = changes.nuisance(a.T @ a, 4, 1)
    b, b0 = solvers.ols(x, y)
    assert np.allclose(x @ slopes + intercepts, x @ b + b0, atol=1e-9) and slopes[3, 0] == 0


def test_what_moments_serve():
    cfg = config()
    assert changes.served(cfg) and changes.served(replace(cfg, covariate_method="pre_regress")) and changes.served(replace(cfg, reduction="apriori"))
    assert not changes.served(replace(cfg, reduction="ica")) and not changes.served(replace(cfg, reduction="cluster_pca", distance="spearman"))
    assert not changes.served(replace(cfg, outer_folds="LOO")) and not changes.served(config("binary"))


@pytest.mark.parametrize("case", [CASES[2], CASES[3]])
def test_resampling_refits_changes(spark, case):
    roles = Roles("SUBJ_ID", ("y", "y2"), "brain", ("cov", "cov2"), "w" if case is CASES[2] else None)
    cfg = config(roles=roles, n_candidates=2, weighted_null=case is CASES[2], blocks={"first": ["brain_0", "brain_3"]}, **case)
    d = table(80)
    df = spark.createDataFrame(d).repartition(3)
    cmap = spark.createDataFrame([(f"brain_{i}", f"c{i // 3}") for i in range(6)], "feature string, cluster string")
    t, b = resample.Table(df, cfg, cmap), collect_block(df, cfg, cmap)
    params = spark.createDataFrame([(0, 0.02, 0.5, 1.0), (1, 0.1, 0.9, 1.0)], "fold long, alpha_or_c double, l1_ratio double, penalty_weight double")
    boot = {(r.fold, r.iter, r.task, r.feature): r.coef for r in resample.bootstrap(t, params, 2).collect()}
    ids = spark.createDataFrame(d[["SUBJ_ID", "w"]]).withColumnRenamed("SUBJ_ID", "row_id")
    where = {s: i for i, s in enumerate(b.ids)}
    for n, seed in enumerate(splits.seed_stream(4, 42)):
        at = [where[r.row_id] for r in (splits.weighted_bootstrap_draw(ids, seed) if roles.weight else splits.bootstrap_draw(ids, seed)).collect()]
        m = fitting.fit_fold(cfg, b.take(np.array(at)), 0, params.filter(f"fold = {n // 2}").first().asDict())
        for j, task in enumerate(t.tasks):
            assert [boot[n // 2, n % 2, task, f] for f in b.names] == pytest.approx(m.coef[j].tolist(), abs=1e-6)
    # Null scores are those of nested cross-validations of permuted tables.
    seed = splits.seed_stream(1, 42)[0]
    keep = fitting.candidates
    for got, columns in ((resample.null_scores(t, 1).first().score, list(roles.outcomes)), (resample.block_null_scores(t, 1).first().score, ["brain_0", "brain_3"])):
        fitting.candidates = lambda c, n, _: keep(c, n, seed)
        try:
            moved = replace(cfg, roles=replace(roles, weight=roles.weight if cfg.weighted_null else None))
            oof = moments.nested_cv(splits.permuted(df, columns, seed, row_id="SUBJ_ID").drop(*([] if moved.roles.weight else ["w"])), moved, cmap)[0].toPandas()
        finally:
            fitting.candidates = keep
        assert got == pytest.approx(np.mean([1 - ((g.y_true - g.y_pred) ** 2).sum() / ((g.y_true - g.y_true.mean()) ** 2).sum() for _, g in oof.groupby("task")]), abs=1e-7)


def test_whole_analysis_with_reduction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "MAX_CELLS", 0)
    monkeypatch.setattr(resample, "bootstrap", lambda t, p, f=resample.bootstrap: f(t, p, 3))
    monkeypatch.setattr(resample, "selection", lambda t, p, f=resample.selection: f(t, p, 3))
    monkeypatch.setattr(report, "collect_block", None)
    cfg = config(roles=Roles("SUBJ_ID", "y", "brain", ("cov", "cov2")), reduction="apriori", covariate_method="pre_regress", n_candidates=1, n_permutations=2, n_block_permutations=2, blocks={"first": "brain_0"}, output_dir=str(tmp_path))
    cmap = spark.createDataFrame([(f"brain_{i}", f"c{i // 3}") for i in range(6)], "feature string, cluster string")
    out = report.analyse(spark, spark.createDataFrame(table(60)), cfg, cmap)
    assert {"cluster_loadings", "cluster_loadings_folds", "report_cluster_importance", "report_feature_importance", "permutation_result", "report_block_permutation"} <= set(out)
    assert out["report_cluster_importance"].count() == 2 and out["cluster_loadings"].count() == 6


@pytest.mark.parametrize("weighted,n", [(True, 131), (False, 60)])
def test_like_rows_equals_the_row_path(spark, weighted, n):
    """Search, chosen parameters, predictions and models of the whole nested cross-validation, with two repeats of the inner one."""
    roles = Roles("SUBJ_ID", "y" if weighted else ("y", "y2"), "brain", ("cov", "cov2") if weighted else (), "w" if weighted else None)
    cfg = config(roles=roles, covariate_method="incorporate" if weighted else "none", n_candidates=5, inner_repeats=2, outer_folds=5)
    df = spark.createDataFrame(table(n)).repartition(3)
    found = moments.NestedCV(df, cfg, like_rows=True)
    run = Run(spark, collect_block(df, cfg), cfg)
    scores = {(r.fold, r.cand_id): r.score for r in run.search().collect()}
    got = {(r.fold, r.cand_id): r.score for r in found.scored.collect()}
    assert got.keys() == scores.keys() and [got[k] for k in scores] == pytest.approx(list(scores.values()), rel=1e-7)
    want = {(r.row_id, r.fold, r.task): (r.y_true, r.y_pred) for r in run.out_of_fold().collect()}
    have = {(r.row_id, r.fold, r.task): (r.y_true, r.y_pred) for r in found.out_of_fold().collect()}
    assert have.keys() == want.keys() and all(have[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    models = [{r.fold: r.asDict() for r in x.collect()} for x in (found.fold_models(), run.models())]
    shown = [{k: {c: v for c, v in r.items() if c != "model"} for k, r in m.items()} for m in models]
    assert shown[0] == shown[1]
    rows, _ = ingest.role_projection(df, cfg)
    one, two = ({r.row_id: (r["mean"], r.sd) for r in predict_ensemble(m, rows, cfg).collect()} for m in (found.fold_models(), run.models()))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-6) for k in two)


@pytest.mark.parametrize("stratified", [False, True])
def test_training_sets_are_dealt_one_by_one(spark, stratified):
    """Each training set's inner folds are those of its own dealing, also with more folds than a class has rows."""
    ids = [f"s{i}" for i in range(47)]
    label = [0 if i < 2 else 1 + i % 3 for i in range(47)]
    rows = spark.createDataFrame([(i, y) for i, y in zip(ids, label, strict=True)], "row_id string, label long").repartition(3)
    dealt = splits.stratified_kfold(rows, 4, "label", 42) if stratified else splits.kfold(rows, 4, 42)
    got = {r.row_id: (r.fold, r.inner) for r in splits.training_folds(dealt, 4, 5, F.lit("42/1"), "label" if stratified else None).collect()}
    outer = fitting.folds(ids, np.array(label) if stratified else None, 4, 42)
    assert [got[i][0] for i in ids] == outer.tolist()
    for k in range(4):
        tr = [j for j in range(47) if outer[j] != k]
        want = fitting.folds([ids[j] for j in tr], np.array([label[j] for j in tr]) if stratified else None, 5, "42/1")
        assert [got[ids[j]][1][k] for j in tr] == want.tolist()
        assert all(got[ids[j]][1][k] == -1 for j in range(47) if outer[j] == k)


@pytest.mark.parametrize("name", ["nested_cv_multitask", "nested_cv_weighted_covariates", "fold_diagnostics", "ensemble_prediction"])
def test_queries_without_a_block(spark, sf, monkeypatch, name):
    """No block of rows reaches the driver."""
    from plover import queries
    from plover.plans import runs

    monkeypatch.setattr(runs, "collect_block", None)
    assert queries.QUERIES[name](spark, sf).count() == {"nested_cv_multitask": 13, "ensemble_prediction": spark.read.parquet(f"{sf}/embeddings.parquet").count()}.get(name, 5)
