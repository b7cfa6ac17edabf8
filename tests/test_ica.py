"""Independent components by passes over rows against the dense solver."""

import numpy as np
import pytest

from plover.config import Roles
from plover.functions import fitting
from plover.plans import ica, moments
from plover.plans.runs import Run, collect_block
from tests.test_engine import config, data


def mixed(n=400):
    """Features that mix skewed and heavy-tailed sources, far from zero, and one constant."""
    r = np.random.RandomState(3)
    s = np.column_stack([r.exponential(size=n), r.laplace(size=n), r.uniform(size=n), r.normal(size=n) ** 3])
    x = 50 + s @ r.normal(size=(4, 6)) + 0.01 * r.normal(size=(n, 6))
    d = data(n).assign(**{f"brain_{i}": x[:, i] for i in range(6)}, brain_6=0.1)
    return d.assign(y=s[:, 0] - s[:, 1] + 0.1 * d["y"])


@pytest.mark.parametrize("small,covariates", [(1 << 20, True), (0, False)])
def test_equals_the_row_path(spark, monkeypatch, small, covariates):
    monkeypatch.setattr(ica, "SMALL", small)
    monkeypatch.setattr(ica, "ROWS", 37)
    roles = Roles("SUBJ_ID", "y", "brain", ("cov",) if covariates else ())
    cfg = config(reduction="ica", ica_components=3, n_candidates=2, roles=roles, covariate_method="incorporate" if covariates else "none")
    df = spark.createDataFrame(mixed()).repartition(3)
    found, run = moments.NestedCV(df, cfg, like_rows=True), Run(spark, collect_block(df, cfg), cfg)
    rows = {(r.fold, r.feature, r.component): r.value for r in run.mixing().collect()}
    got = {(r.fold, r.feature, r.component): r.value for r in found.mixing().collect()}
    assert got.keys() == rows.keys() and len(rows) == 4 * 7 * 3
    assert max(abs(got[k] - rows[k]) for k in rows) < 1e-6
    want = {r.row_id: (r.y_true, r.y_pred) for r in run.out_of_fold().collect()}
    have = {r.row_id: (r.y_true, r.y_pred) for r in found.out_of_fold().collect()}
    assert have.keys() == want.keys() and all(have[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    b = run.block
    first = fitting.reducers.fit_reducer(b.x[run.folds != 0], b.names, cfg).transform(b.x)
    shown = {r.row_id: r["values"] for r in found.representative().collect()}
    assert np.allclose([shown[i][covariates:] for i in b.ids], first, atol=1e-6)


def test_no_more_components_than_rank_and_bounds(spark):
    df = spark.createDataFrame(mixed(60).assign(brain_5=lambda d: d.brain_0 + d.brain_1).drop(columns=["brain_2", "brain_3"]))
    cfg = config(reduction="ica", ica_components=8, n_candidates=1)
    found = {(r.fold, r.component) for r in moments.NestedCV(df, cfg).mixing().collect()}
    assert found == {(k, f"IC_{i}") for k in range(4) for i in (1, 2, 3)}
    with pytest.raises(ValueError, match="given number"):
        moments.NestedCV(df, config(reduction="ica"))


def test_query_without_a_block(spark, sf, monkeypatch):
    from plover import queries
    from plover.plans import runs

    monkeypatch.setattr(runs, "collect_block", None)
    assert queries.QUERIES["ica_components"](spark, sf).count() == 5 * 63 * 8
