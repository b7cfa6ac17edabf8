"""Multinomial regression by passes against the row path."""

import numpy as np
import pytest

from plover.config import Roles
from plover.plans import logistic, multinomial
from plover.plans.runs import Run, collect_block
from tests.test_engine import config, data


@pytest.mark.parametrize("weighted,steps", [(False, 8), (True, 1)])
def test_equals_the_row_path(spark, monkeypatch, weighted, steps):
    monkeypatch.setattr(multinomial, "STEPS", steps)
    # The dense solver stops early where a covariate is scaled up by a small penalty weight (tests/test_logistic.py).
    bounds = {"alpha_min_predict": 0.1, "alpha_max_predict": 10, "covariate_penalty_weight_min": 0.8}
    extra = {"roles": Roles("SUBJ_ID", "y", "brain", ("cov",), "w"), "covariate_method": "incorporate", "model_params": bounds} if weighted else {}
    cfg = config("multiclass", n_candidates=2, inner_repeats=1 + (not weighted), **extra)
    df = spark.createDataFrame(data(140, kind="multiclass")).repartition(3)
    oof, coefs, params, classes = multinomial.nested_cv(df, cfg)
    run = Run(spark, collect_block(df, cfg), cfg)
    assert {r.fold: tuple(r[p] for p in logistic.PARAMS) for r in params.collect()} == {r.fold: tuple(r[p] for p in logistic.PARAMS) for r in run.models().collect()}
    assert classes == run.block.classes and all(r.converged for r in params.collect())
    want = {r.row_id: (r.fold, r.y_true, np.array(r.prob)) for r in run.out_of_fold().collect()}
    got = {r.row_id: (r.fold, r.y_true, np.array(r.prob)) for r in oof.collect()}
    assert got.keys() == want.keys() and all(got[i][:2] == want[i][:2] and np.abs(got[i][2] - want[i][2]).max() < 2e-3 for i in want)
    have, rows = ({(r.fold, r.task, r.feature): r.coef for r in x.collect()} for x in (coefs, run.coefficients()))
    assert have.keys() == rows.keys() and all(abs(have[k] - rows[k]) < 5e-3 * max(1, abs(rows[k])) for k in rows)


def test_recentred_is_best():
    r = np.random.RandomState(0)
    b = r.normal(size=(5, 40)) * (r.uniform(size=(5, 40)) > 0.4)
    cost = lambda x, rho: rho * np.abs(x).sum(0) + (1 - rho) / 2 * (x * x).sum(0)
    for rho in (0.01, 0.5, 0.99, 1.0):
        least = np.min([cost(b - t, rho) for t in np.linspace(-4, 4, 4001)], axis=0)
        new = logistic.recentred(b, rho)
        assert (cost(new, rho) <= least + 1e-12).all() and np.allclose(np.ptp(b - new, axis=0), 0)


def test_query_without_a_block(spark, sf, monkeypatch):
    from plover import queries
    from plover.plans import runs

    monkeypatch.setattr(runs, "collect_block", None)
    monkeypatch.setattr(queries, "NAMES", queries.NAMES[:4])
    assert queries.QUERIES["nested_cv_multiclass"](spark, sf).count() == 33
