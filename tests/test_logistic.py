"""Distributed logistic regression against the dense solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plover.config import Roles
from plover.functions import fitting
from plover.plans import logistic
from tests.test_engine import config, data


@pytest.mark.parametrize("kind,covariates", [("binary", False), ("binary", True), ("multiclass", False)])
def test_equals_the_dense_solver(spark, kind, covariates):
    extra = {"roles": Roles("SUBJ_ID", "y", "brain", ("cov",), "w"), "covariate_method": "incorporate"} if covariates else {}
    cfg = config(kind, n_candidates=2, **extra)
    d = data(150, kind=kind).assign(cov=lambda x: 1e4 + x["cov"])
    oof, coefs, params, classes = logistic.nested_cv(spark.createDataFrame(d).repartition(3), cfg)
    rows = logistic.prepare(spark.createDataFrame(d), cfg)[0].filter("repeat = 0").toPandas().sort_values("row_id", ignore_index=True)
    x, y, w, fold = np.stack(rows["design"]), rows["label"].to_numpy(int), rows["w"].to_numpy(), rows["fold"].to_numpy()
    n_covs, k = int(covariates), len(classes)
    got = {(r.fold, r.task, r.feature): r.coef for r in coefs.collect()}
    prob = {r.row_id: np.array(r.prob) for r in oof.collect()}
    tasks = ["single"] if k == 2 else [str(c) for c in classes]
    fit = logistic.Fit(logistic.prepare(spark.createDataFrame(d), cfg)[0], k, n_covs, covariates)
    chosen = {r.fold: r for r in params.collect()}
    models = fit.fit([fit.model(f, 0, -1, 0, {c: chosen[f][c] for c in logistic.PARAMS}) for f in sorted(chosen)])
    for m in models:
        r = chosen[m.fold]
        p, tr = {c: r[c] for c in logistic.PARAMS}, fold != m.fold
        want = fitting.fit_model(cfg, x[tr], n_covs, y[tr], k, p, w[tr] if covariates else None)
        own = m.beta @ np.linalg.inv(m.standard())
        b, b0 = own[:, 1:], own[:, 0]
        z, ww = (x[tr] - want.mean) / want.scale, w[tr] if covariates else np.ones(tr.sum())
        assert np.allclose(fit.mean + fit.scale * m.mean, want.mean) and np.allclose(fit.scale * m.scale, want.scale)

        def objective(b, b0):
            q = fitting.probabilities(z @ b.T + b0)
            return -p["alpha_or_c"] * (ww * np.log(q[np.arange(len(q)), y[tr]])).sum() + p["l1_ratio"] * np.abs(b).sum() + (1 - p["l1_ratio"]) / 2 * (b * b).sum()

        # No worse than the dense solver, which stops early where columns are badly scaled; equal where it doesn't.
        assert r.converged and objective(b, b0) <= objective(want.coef, want.intercept) * (1 + 1e-9)
        if not covariates:
            assert np.abs(b - want.coef).max() < 2e-4
        mine = np.array([[got[m.fold, t, f"brain_{j}"] for j in range(6)] for t in tasks])
        assert np.abs(mine - b[:, n_covs:]).max() < 1e-6
        q = fitting.probabilities(z @ b.T + b0)
        e = (q[:, 1:] - (y[tr] == 1)[:, None]) if k == 2 else q - np.eye(k)[y[tr]]
        g = -p["alpha_or_c"] * (ww[:, None] * e).T @ z - (1 - p["l1_ratio"]) * b
        bad = np.where(b != 0, np.abs(g - p["l1_ratio"] * np.sign(b)), np.maximum(np.abs(g) - p["l1_ratio"], 0))
        assert bad.max() < 1e-4 * p["alpha_or_c"] * ww.sum() * np.abs(z).max()
        te = fitting.probabilities((x[~tr] - want.mean) / want.scale @ b.T + b0)
        assert max(np.abs(prob[i] - v).max() for i, v in zip(rows["row_id"][~tr], te)) < 1e-6


def test_search_scores_and_folds(spark):
    cfg = config("binary", n_candidates=1, inner_repeats=2)
    d = spark.createDataFrame(data(90, kind="binary"))
    rows, _, classes, _ = logistic.prepare(d, cfg)
    pdf = rows.toPandas()
    assert (pdf.groupby(["fold", "repeat", "inner", "label"]).size().unstack() - len(pdf) / 2 / 4 / 3 / 2).abs().to_numpy().max() < 4
    fit = logistic.Fit(rows, 2, 0, False)
    p = {"alpha_or_c": 1.0, "l1_ratio": 0.5, "penalty_weight": 1.0}
    models = fit.fit([fit.model(1, r, 2, 0, p) for r in range(2)])
    for r, (m, score) in enumerate(zip(models, fit.left_out(models))):
        own = pdf[pdf["repeat"] == r]
        tr, va = own[(own.fold != 1) & (own.inner != 2)], own[(own.fold != 1) & (own.inner == 2)]
        want = fitting.fit_model(cfg, np.stack(tr["design"]), 0, tr["label"].to_numpy(int), 2, p, None)
        assert abs(score - fitting.inner_score(cfg, want, np.stack(va["design"]), va["label"].to_numpy(int), False)) < 1e-5


def test_chunks_of_models_and_bounds(spark, monkeypatch):
    cfg = config("multiclass", n_candidates=1)
    d = spark.createDataFrame(data(90, kind="multiclass"))
    want = {tuple(r) for r in logistic.nested_cv(d, cfg)[1].withColumn("coef", F.round("coef", 4)).collect()}
    monkeypatch.setattr(logistic, "MAX_BYTES", 6 * 7 * 8 // 2 * 8 * 2)
    assert {tuple(r) for r in logistic.nested_cv(d, cfg)[1].withColumn("coef", F.round("coef", 4)).collect()} == want
    monkeypatch.setattr(logistic, "MAX_BYTES", 10)
    with pytest.raises(ValueError, match="bound"):
        logistic.nested_cv(d, cfg)
    with pytest.raises(ValueError, match="classes"):
        logistic.nested_cv(spark.createDataFrame(data(30).assign(y=1.0)), cfg)
    with pytest.raises(ValueError, match="without reduction"):
        logistic.nested_cv(d, config("multiclass", reduction="ica"))


def test_constant_feature_and_separable_classes(spark):
    d = data(80, kind="binary").assign(brain_c=3.0)
    d["brain_0"] = np.where(d.y > 0, 5.0, -5.0) + np.random.RandomState(1).normal(size=80) * 0.1
    coefs = logistic.nested_cv(spark.createDataFrame(d), config("binary", n_candidates=1))[1].toPandas()
    assert np.isfinite(coefs["coef"]).all() and (coefs[coefs.feature == "brain_c"]["coef"] == 0).all()
