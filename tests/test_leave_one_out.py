"""Leave-one-out by downdates against refits on rows."""

import numpy as np
import pandas as pd
import pytest

from plover.config import Roles
from plover.functions import fitting, reducers
from plover.plans import leave_one_out
from plover.plans.runs import collect_block
from tests.test_changes import table
from tests.test_engine import config


@pytest.mark.parametrize("method,n_candidates", [("incorporate", 1), ("pre_regress", 3)])
def test_outer_equals_rows(spark, method, n_candidates):
    cfg = config(roles=Roles("SUBJ_ID", ("y", "y2"), "brain", ("cov", "cov2"), "w"), covariate_method=method, reduction="apriori" if n_candidates > 1 else "none", outer_folds="LOO", n_candidates=n_candidates)
    df = spark.createDataFrame(table(40)).repartition(3)
    cmap = spark.createDataFrame([(f"brain_{i}", f"c{i // 3}") for i in range(6)], "feature string, cluster string")
    rows = leave_one_out.outer(df, cfg, cmap).collect()
    b = collect_block(df, cfg, cmap)
    got = {(r.row_id, r.task): r for r in rows}
    assert len(rows) == len(got) == 80 and sorted({r.fold for r in rows}) == list(range(40))
    for i in (0, 17, 39):
        one = got[b.ids[i], "y"]
        m = fitting.fit_fold(cfg, b.take(np.delete(np.arange(40), i)), 0, {p: one[p] for p in leave_one_out.PARAMS})
        y, z = fitting.predict_fold(cfg, m, b.take(np.array([i])))
        for j, t in enumerate(("y", "y2")):
            r = got[b.ids[i], t]
            assert (r.y_true, r.y_pred) == pytest.approx((y[0, j], z[0, j]), abs=1e-6) and r.coef == pytest.approx(m.coef[j].tolist(), abs=1e-7)


@pytest.mark.parametrize("multi", [False, True])
def test_inner_equals_rows(spark, multi):
    cfg = config(roles=Roles("SUBJ_ID", ("y", "y2") if multi else "y", "brain", ("cov",), "w"), covariate_method="pre_regress", reduction="apriori" if multi else "none", outer_folds=3, inner_folds="LOO", n_candidates=3)
    df = spark.createDataFrame(table(30)).repartition(3)
    cmap = spark.createDataFrame([(f"brain_{i}", f"c{i // 3}") for i in range(6)], "feature string, cluster string")
    found = leave_one_out.inner(df, cfg, cmap)
    got = {(r.fold, r.cand_id): r.score for r in found.collect()}
    b = collect_block(df, cfg, cmap)
    folds = fitting.folds(b.ids, None, 3, cfg.seed)
    for k in range(3):
        tr = b.take(np.flatnonzero(folds != k))
        (y,), _ = fitting.residualise(cfg, tr)
        d = reducers.fit_reducer(tr.x, tr.names, cfg, tr.cluster_map).transform(tr.x)
        assert [got[k, i] for i in range(3)] == pytest.approx(fitting.search_scores(cfg, tr, d, 0, y, fitting.candidates(cfg, 3, 42)), rel=1e-6)
    assert leave_one_out.best(found).count() == 3


def counted(spark, df):
    """``df``, and an accumulator of the rows that it was asked for."""
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), n


def test_outer_computes_its_input_once(spark):
    cfg = config(outer_folds="LOO", n_candidates=2)
    df, n = counted(spark, spark.createDataFrame(table(40)))
    assert len(leave_one_out.outer(df, cfg).collect()) == 40 and n.value == 40


def test_outer_of_odd_rows(spark):
    cfg = config(outer_folds="LOO", n_candidates=2, inner_repeats=2)
    rows = table(40)
    odd = rows.iloc[:3].assign(SUBJ_ID=["p", None, "q"], y=[np.nan, 1.0, 2.0], brain_1=[1.0, 2.0, np.nan])
    key = lambda r: r.row_id
    want = sorted(leave_one_out.outer(spark.createDataFrame(rows), cfg).collect(), key=key)
    got = sorted(leave_one_out.outer(spark.createDataFrame(pd.concat([rows, odd])).repartition(3), cfg).collect(), key=key)
    assert [(r.row_id, r.fold) for r in got] == [(r.row_id, r.fold) for r in want]
    assert [r.y_pred for r in got] == pytest.approx([r.y_pred for r in want], abs=1e-9)
    assert got[0].asDict().keys() == {"row_id", "task", "y_true", "y_pred", "coef", *leave_one_out.PARAMS, "fold"}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        leave_one_out.outer(spark.createDataFrame(pd.concat([rows, rows.iloc[:1]])), cfg)
    with pytest.raises(ValueError, match="no complete rows"):
        leave_one_out.outer(spark.createDataFrame(odd), cfg)


def test_inner_solves_rows_in_stacks(spark, monkeypatch):
    cfg = config(outer_folds=3, inner_folds="LOO", n_candidates=2)
    df, n = counted(spark, spark.createDataFrame(table(60)).coalesce(1))
    calls, plain = spark.sparkContext.accumulator(0), leave_one_out.solve

    def solve(*a):
        calls.add(1)
        return plain(*a)

    monkeypatch.setattr(leave_one_out, "solve", solve)
    assert leave_one_out.inner(df, cfg).count() == 6 and n.value == 60
    assert 0 < calls.value <= 60  # of each fold and candidate its own model, and in each task those of all of its rows: one by one there are 240


def test_inner_of_odd_rows(spark):
    cfg = config(outer_folds=3, inner_folds="LOO", n_candidates=2)
    rows = table(40)
    odd = rows.iloc[:3].assign(SUBJ_ID=["p", None, "q"], y=[np.nan, 1.0, 2.0], brain_1=[1.0, 2.0, np.nan])
    scores = lambda d: {(r.fold, r.cand_id): r.score for r in leave_one_out.inner(spark.createDataFrame(d).repartition(5), cfg).collect()}
    assert scores(pd.concat([rows, odd])) == pytest.approx(scores(rows), rel=1e-9)
    twice = pd.concat([rows, rows.iloc[:1]])  # rows of one id count each
    b = collect_block(spark.createDataFrame(twice), cfg)
    folds, got = fitting.folds(b.ids, None, 3, cfg.seed), scores(twice)
    for k in range(3):
        tr = b.take(np.flatnonzero(folds != k))
        assert [got[k, i] for i in range(2)] == pytest.approx(fitting.search_scores(cfg, tr, tr.x, 0, tr.y, fitting.candidates(cfg, 2, 42)), rel=1e-6)
    with pytest.raises(ValueError, match="no complete rows"):
        scores(odd)
