"""Resampling by moments against the draws of single seeds and refits on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plover.config import Roles
from plover.functions import fitting
from plover.operators import splits
from plover.plans import moments, resample
from tests.test_engine import config, data

ROLES = Roles("SUBJ_ID", ("y", "y2"), "brain", ("cov",), "w")
SEEDS = [(0, 11), (1, 12), (2, 99)]


def by_seed(drawn):
    out = {}
    for r in drawn.collect():
        for i in r.seeds:
            out.setdefault(i, []).append(r.row_id)
    return {i: sorted(v) for i, v in out.items()}


def test_draws_of_many_seeds(spark):
    df = spark.createDataFrame([(f"r{i}", float(i % 5)) for i in range(101)], "row_id string, w double")
    plain, weighted, half = by_seed(splits.bootstrap_counts(df, SEEDS)), by_seed(splits.bootstrap_counts(df, SEEDS, "w")), by_seed(splits.half_members(df, SEEDS))
    for i, s in SEEDS:
        assert plain[i] == sorted(r.row_id for r in splits.bootstrap_draw(df, s).collect())
        assert weighted[i] == sorted(r.row_id for r in splits.weighted_bootstrap_draw(df, s).collect())
        assert half[i] == sorted(r.row_id for r in splits.half_subsample(df, s).collect())
    given = {r.row_id: r.given for r in splits.permuted_values(df, "w", SEEDS).collect()}
    for i, s in SEEDS:
        assert {k: v[i] for k, v in given.items()} == {r.row_id: r.w for r in splits.permuted(df, ["w"], s).collect()}


@pytest.mark.parametrize("weighted", [False, True])
def test_refits_equal_those_on_rows(spark, monkeypatch, weighted):
    roles = ROLES if weighted else Roles("SUBJ_ID", "y", "brain")
    cfg = config(roles=roles, covariate_method="incorporate" if weighted else "none", n_candidates=1)
    d = data(80)
    df = spark.createDataFrame(d).repartition(3)
    t = resample.Table(df, cfg)
    params = spark.createDataFrame([(0, 0.02, 0.5, 0.3), (1, 0.1, 0.9, 1.0)], "fold long, alpha_or_c double, l1_ratio double, penalty_weight double")
    monkeypatch.setattr(resample, "MAX_BYTES", 2 * t.size * (t.size + 1) // 2 * 8 * 4)  # four seeds a group
    boot = {(r.fold, r.iter, r.task, r.feature): r.coef for r in resample.bootstrap(t, params, 3).collect()}
    half = {(r.fold, r.iter, r.task, r.feature): r.selected for r in resample.selection(t, params, 3).collect()}
    where = {s: i for i, s in enumerate(d["SUBJ_ID"])}
    cols = (["cov"] if weighted else []) + [f"brain_{i}" for i in range(6)]
    x, y, w = d[cols].to_numpy(), d[list(roles.outcomes)].to_numpy(), d["w"].to_numpy() if weighted else None
    ids = spark.createDataFrame(d[["SUBJ_ID", "w"]]).withColumnRenamed("SUBJ_ID", "row_id")
    for seed, got, draw in ((42, boot, (lambda s: splits.weighted_bootstrap_draw(ids, s)) if weighted else (lambda s: splits.bootstrap_draw(ids, s))), (43, half, lambda s: splits.half_subsample(ids, s))):
        stream = splits.seed_stream(6, seed)
        for n in (0, 4):
            fold, it = n // 3, n % 3
            at = [where[r.row_id] for r in draw(stream[n]).collect()]
            p = {k: v for k, v in params.filter(F.col("fold") == fold).first().asDict().items() if k != "fold"}
            m = fitting.fit_model(cfg, x[at], int(weighted), y[at], 0, p, None if w is None else w[at])
            for k, task in enumerate(t.tasks):
                for j in range(6):
                    want = m.coef[k, int(weighted) + j]
                    value = got[fold, it, task, f"brain_{j}"]
                    assert abs(value - want) < 1e-6 if got is boot else value == (want != 0)


@pytest.mark.parametrize("multi", [False, True])
def test_null_scores_equal_nested_cv_on_permuted_tables(spark, multi):
    roles = ROLES if multi else Roles("SUBJ_ID", "y", "brain")
    cfg = config(roles=roles, covariate_method="incorporate" if multi else "none", n_candidates=2, blocks={"first": ["brain_0", "brain_3"], "none": "zzz"}, weighted_null=multi)
    df = spark.createDataFrame(data(70))
    t = resample.Table(df, cfg)
    null = {r.seed: r.score for r in resample.null_scores(t, 2).collect()}
    blocks = {(r.block, r.seed): r.score for r in resample.block_null_scores(t, 1).collect()}
    stream = splits.seed_stream(2, 42)
    assert set(null) == set(stream) and set(blocks) == {("first", stream[0])}

    def score(moved, seed):
        monkey = fitting.candidates
        fitting.candidates = lambda c, n, _: monkey(c, n, seed)
        try:
            oof = moments.nested_cv(moved, cfg)[0].toPandas()
        finally:
            fitting.candidates = monkey
        return np.mean([1 - ((g.y_true - g.y_pred) ** 2).sum() / ((g.y_true - g.y_true.mean()) ** 2).sum() for _, g in oof.groupby("task")])

    for seed in stream:
        moved = splits.permuted(df, list(roles.outcomes), seed, row_id="SUBJ_ID")
        assert abs(null[seed] - score(moved, seed)) < 1e-8
    moved = splits.permuted(df, ["brain_0", "brain_3"], stream[0], row_id="SUBJ_ID")
    assert abs(blocks["first", stream[0]] - score(moved, stream[0])) < 1e-8
    assert abs(resample.observed_score(t) - score(df, 42)) < 1e-8


def test_bounds(spark, monkeypatch):
    t = resample.Table(spark.createDataFrame(data(30)), config())
    monkeypatch.setattr(resample, "MAX_BYTES", 10)
    with pytest.raises(ValueError, match="bound"):
        resample.null_scores(t, 1)
    with pytest.raises(ValueError, match="without reduction"):
        resample.Table(spark.createDataFrame(data(30)), config(reduction="ica"))


def test_whole_analysis_by_moments(spark, tmp_path, monkeypatch):
    from plover.plans import report

    monkeypatch.setattr(report, "MAX_CELLS", 0)
    monkeypatch.setattr(resample, "bootstrap", lambda t, p, f=resample.bootstrap: f(t, p, 3))
    monkeypatch.setattr(resample, "selection", lambda t, p, f=resample.selection: f(t, p, 3))
    cfg = config(n_candidates=1, n_permutations=3, n_block_permutations=2, blocks={"first": "brain_0"}, output_dir=str(tmp_path))
    df = spark.createDataFrame(data(60))
    out = report.analyse(spark, df, cfg)
    assert {"out_of_fold", "model_performance", "nested_cv_scores", "report_feature_importance", "report_individual_plotting", "permutation_result", "report_block_permutation"} <= set(out)
    assert out["nested_cv_scores"].first()[0] > 0.8 and out["report_feature_importance"].count() == 6
    assert out["report_individual_plotting"].filter("feature_name = 'brain_0'").count() == 60
    plot = out["report_individual_plotting"].filter("feature_name = 'brain_0'").toPandas()
    assert np.corrcoef(plot.x_value, plot.y_axis_value)[0, 1] > 0.95
    # Two workers' parts are the whole null distribution.
    whole = sorted(r[0] for r in out["permutation_null_distribution_r2"].collect())
    parts = sorted(r[0] for j in range(2) for r in report.perm_worker_moments(df, cfg, j, 2).collect())
    assert np.allclose(whole, parts)
