"""Nested cross-validation and resampling as Spark jobs.

A job is a table of small tasks (folds x candidates, folds x seeds, blocks x seeds) that ``mapInPandas`` runs; the block of
complete rows is broadcast once, if it has at most ``MAX_CELLS`` numbers.  Beyond that size, regression without
reduction goes by moments (``plover.plans.moments``), whose state doesn't grow with the rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.config import LOG, Config
from plover.functions import fitting
from plover.functions.fitting import Block, FoldModel
from plover.operators import ingest, splits, stats
from plover.sources.work import save

MAX_CELLS = 64_000_000
PARAMS = ("alpha_or_c", "l1_ratio", "penalty_weight")


def collect_block(df: DataFrame, cfg: Config, cluster_map: DataFrame | None = None, max_cells: int = MAX_CELLS) -> Block:
    """The complete rows as a dense block; its size is checked before anything is collected."""
    rows, names = ingest.role_projection(df, cfg)
    n, _ = ingest.check_rows(rows)
    if n * max(1, len(names)) > max_cells:
        raise ValueError(f"{n} x {len(names)} numbers are over the bound of {max_cells}: use plover.plans.moments")
    if not names:
        LOG.warning("no feature's name contains %r", cfg.roles.feature_substring)
    elif len(names) > n // 5:
        LOG.warning("%d features for %d rows: over a fifth", len(names), n)
    mapping = None
    if cfg.reduction == "apriori":
        if cluster_map is None:
            raise ValueError("the apriori reduction needs a cluster map")
        spark = df.sparkSession
        ingest.check_coverage(spark.createDataFrame([(f,) for f in names], "feature string"), cluster_map)
        mapping = {r.feature: r.cluster for r in cluster_map.join(F.broadcast(spark.createDataFrame([(f,) for f in names], "feature string")), "feature", "left_semi").collect()}
    pdf = rows.toPandas().sort_values("row_id", kind="stable", ignore_index=True)
    mat = lambda c, k: np.stack(pdf[c].to_numpy()).astype(float).reshape(n, k)
    y, classes = mat("y", len(cfg.roles.outcomes)), []
    if cfg.is_classification:
        found = np.unique(y[:, 0])
        classes = [int(c) if float(c).is_integer() else float(c) for c in found]
        y = np.searchsorted(found, y[:, 0])
    cov = list(cfg.roles.covariates) if cfg.covariate_method != "none" else []
    w = pdf["w"].to_numpy(dtype=float) if cfg.roles.weight else None
    return Block(pdf["row_id"].tolist(), mat("features", len(names)), mat("cov", len(cov)), y, None if w is None else w * n / w.sum(), names, cov, list(cfg.roles.outcomes), classes, mapping)


def _folds(cfg: Config, b: Block) -> np.ndarray:
    return fitting.folds(b.ids, b.y if cfg.is_classification else None, cfg.outer_folds, cfg.seed)


def _spread(df: DataFrame) -> DataFrame:
    """The rows of a small task table over all cores."""
    n = df.count()
    return df.repartition(max(1, min(n, 4 * df.sparkSession.sparkContext.defaultParallelism)))


class Run:
    """One analysis: a broadcast block, its configuration, and the stages over it."""

    def __init__(self, spark: SparkSession, block: Block, cfg: Config) -> None:
        self.spark, self.block, self.cfg = spark, block, cfg
        self.shared = spark.sparkContext.broadcast(block)
        self.folds = _folds(cfg, block)
        self.n_folds = int(self.folds.max()) + 1
        self.models_: DataFrame | None = None

    # --- nested cross-validation ----------------------------------------------------------------------------------

    def fold_rows(self) -> DataFrame:
        return self.spark.createDataFrame(pd.DataFrame({"row_id": self.block.ids, "fold": self.folds.astype("int64")}))

    def search(self) -> DataFrame:
        """``fold, cand_id, alpha_or_c, l1_ratio, penalty_weight, score``: mean inner scores of every candidate."""
        cfg, shared, folds = self.cfg, self.shared, self.folds
        tried = fitting.candidates(cfg, cfg.n_candidates or 20, 42)
        tasks = [(k, i, *(c[p] for p in PARAMS)) for k in range(self.n_folds) for i, c in enumerate(tried)]
        df = _spread(self.spark.createDataFrame(tasks, "fold long, cand_id long, alpha_or_c double, l1_ratio double, penalty_weight double"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b = shared.value
            known: dict[int, tuple] = {}  # what a fold's candidates share
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    if r.fold not in known:
                        tr = b.take(np.flatnonzero(folds != r.fold))
                        reducer = fitting.reducers.fit_reducer(tr.x, tr.names, cfg, tr.cluster_map)
                        (y,), _ = fitting.residualise(cfg, tr)
                        known[r.fold] = tr, y, *fitting.design(cfg, tr.cov, reducer.transform(tr.x))
                    tr, y, d, n_covs = known[r.fold]
                    out.append(fitting.search_scores(cfg, tr, d, n_covs, y, [{p: getattr(r, p) for p in PARAMS}])[0])
                yield pdf.assign(score=out)

        return df.mapInPandas(run, df.schema.simpleString()[7:-1].replace(":", " ") + ", score double")

    def models(self) -> DataFrame:
        """``fold, alpha_or_c, l1_ratio, penalty_weight, n_covs, converged, model``, a row a fold, saved."""
        if self.models_ is None:
            scored = save(self.search(), "search")
            best = stats.best_candidate(scored)
            chosen = scored.join(best.select("fold", "cand_id"), ["fold", "cand_id"]).select("fold", *PARAMS)
            cfg, shared, folds = self.cfg, self.shared, self.folds

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                b = shared.value
                for pdf in batches:
                    made = [fitting.fit_fold(cfg, b.take(np.flatnonzero(folds != r.fold)), int(r.fold), {p: getattr(r, p) for p in PARAMS}) for r in pdf.itertuples(index=False)]
                    yield pdf.assign(n_covs=[m.n_covs for m in made], converged=[m.model.converged for m in made], model=[pickle.dumps(m) for m in made])

            self.models_ = save(_spread(chosen).mapInPandas(run, "fold long, alpha_or_c double, l1_ratio double, penalty_weight double, n_covs int, converged boolean, model binary"), "fold-models")
        return self.models_

    def out_of_fold(self) -> DataFrame:
        """``row_id, fold, task, y_true, y_pred, prob``: every row predicted by the model that didn't see it."""
        cfg, shared, folds = self.cfg, self.shared, self.folds

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b = shared.value
            for pdf in batches:
                for raw in pdf["model"]:
                    m: FoldModel = pickle.loads(raw)
                    te = b.take(np.flatnonzero(folds == m.fold))
                    y, p = fitting.predict_fold(cfg, m, te)
                    if cfg.is_classification:
                        yield pd.DataFrame({"row_id": te.ids, "fold": m.fold, "task": "single", "y_true": y.astype(float), "y_pred": p.argmax(1).astype(float), "prob": list(p)})
                    else:
                        for t, name in enumerate(b.tasks):
                            yield pd.DataFrame({"row_id": te.ids, "fold": m.fold, "task": name, "y_true": y[:, t], "y_pred": p[:, t], "prob": [[]] * len(te.ids)})

        return self.models().select("model").mapInPandas(run, "row_id string, fold long, task string, y_true double, y_pred double, prob array<double>")

    def coefficients(self, reduced: bool = False) -> DataFrame:
        """``fold, task, feature, coef``: taken back to features, or of reduced features."""
        shared = self.shared

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b = shared.value
            for pdf in batches:
                for raw in pdf["model"]:
                    m = pickle.loads(raw)
                    c = m.reduced if reduced else m.coef
                    for t, name in enumerate(b.tasks):
                        yield pd.DataFrame({"fold": m.fold, "task": name, "feature": m.reducer.names if reduced else b.names, "coef": c[t]})

        return self.models().select("model").mapInPandas(run, "fold long, task string, feature string, coef double")

    def loadings(self) -> DataFrame:
        """``fold, cluster, feature, loading`` of every fold's clusters."""
        return self._of_reducer("cluster string, feature string, loading double", lambda r: r.loadings())

    def mixing(self) -> DataFrame:
        """``fold, feature, component, value`` of every fold's mixing matrix (ICA)."""
        return self._of_reducer("feature string, component string, value double", lambda r: r.mixing_rows() if hasattr(r, "mixing_rows") else [])

    def _of_reducer(self, schema: str, get) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for raw in pdf["model"]:
                    m = pickle.loads(raw)
                    yield pd.DataFrame(get(m.reducer), columns=names).assign(fold=m.fold)[["fold", *names]]

        return self.models().select("model").mapInPandas(run, f"fold long, {schema}")

    def score(self, oof: DataFrame | None = None) -> float:
        """R2 (mean over tasks) or ROC AUC of all out-of-fold predictions."""
        oof = self.out_of_fold() if oof is None else oof
        if not self.cfg.is_classification:
            return stats.macro_regression(stats.regression_metrics(oof)).first().r2
        k = len(self.block.classes)
        if k == 2:
            return stats.auc(oof.withColumn("s", F.col("prob")[1]), F.col("y_true") == 1, "s").first().auc
        long = oof.select("y_true", F.posexplode("prob").alias("c", "s"))
        return stats.auc(long, F.col("y_true") == F.col("c"), "s", ["c"]).agg(F.avg("auc")).first()[0]

    # --- resampling ----------------------------------------------------------------------------------------------------

    def _fixed(self) -> dict[int, dict[str, float]]:
        return {r.fold: {p: r[p] for p in PARAMS} for r in self.models().select("fold", *PARAMS).collect()}

    def _resample(self, seed: int, n: int, draw, indicator: bool) -> DataFrame:
        """Folds x seeds: a fresh reducer and the fold's parameters on a drawn sample of all rows."""
        cfg, shared, params = self.cfg, self.shared, self._fixed()
        stream = splits.seed_stream(n * self.n_folds, seed)
        tasks = [(i // n, i % n, s) for i, s in enumerate(stream)]
        df = _spread(self.spark.createDataFrame(tasks, "fold long, iter long, seed long"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b = shared.value
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    try:
                        m = fitting.fit_fold(cfg, b.take(draw(np.random.RandomState(r.seed), b)), int(r.fold), params[r.fold])
                    except Exception as e:  # one draw may be of one class, or constant
                        LOG.info("iteration %s of fold %s failed: %s", r.iter, r.fold, e)
                        yield pd.DataFrame({"fold": [r.fold], "iter": [r.iter], "task": [None], "feature": [None], "coef": [None], "converged": [False], "ok": [False]})
                        continue
                    for t, name in enumerate(b.tasks):
                        c = (m.coef[t] != 0).astype(float) if indicator else m.coef[t]
                        yield pd.DataFrame({"fold": r.fold, "iter": r.iter, "task": name, "feature": b.names, "coef": c, "converged": m.model.converged, "ok": True})

        return save(df.mapInPandas(run, "fold long, iter long, task string, feature string, coef double, converged boolean, ok boolean"), "resampled")

    def bootstrap(self, n: int | None = None) -> DataFrame:
        """``fold, iter, task, feature, coef, converged, ok`` of bootstrap samples, drawn by weight if there are weights."""

        def draw(rng: np.random.RandomState, b: Block) -> np.ndarray:
            return rng.choice(len(b.ids), len(b.ids), replace=True, p=None if b.w is None else b.w / b.w.sum())

        out = self._resample(42, n or self.cfg.fold_bootstraps, draw, False)
        level = stats.failure_rate(out.select("fold", "iter", "ok").distinct()).first()
        if level.level == "error":
            raise RuntimeError(f"{level.failed} of {level.n} bootstrap iterations failed")
        if level.level == "warning":
            LOG.warning("%d of %d bootstrap iterations failed", level.failed, level.n)
        return out

    def selection(self, n: int | None = None) -> DataFrame:
        """``fold, iter, task, feature, selected``: whether a feature's coefficient is not zero in half samples."""

        def draw(rng: np.random.RandomState, b: Block) -> np.ndarray:
            return rng.choice(len(b.ids), len(b.ids) // 2, replace=False)

        out = self._resample(43, n or self.cfg.fold_bootstraps, draw, True)
        return out.filter("ok").select("fold", "iter", "task", "feature", F.col("coef").cast("int").alias("selected"))

    def null_scores(self, n: int | None = None) -> DataFrame:
        """``seed, score`` of nested cross-validations with permuted outcomes (tasks move together)."""
        return self._null(self.cfg.n_permutations if n is None else n, {"": None})

    def block_null_scores(self, n: int | None = None) -> DataFrame:
        """``block, seed, score`` with the rows of a block's columns permuted jointly; all blocks share their seeds."""
        at = {k: [self.block.names.index(f) for f in ingest.block_columns(self.block.names, v)] for k, v in self.cfg.blocks.items()}
        return self._null(self.cfg.n_block_permutations if n is None else n, {k: v for k, v in at.items() if v})

    def _null(self, n: int, blocks: dict[str, list[int] | None]) -> DataFrame:
        cfg, shared = self.cfg, self.shared
        tasks = [(k, s) for k in blocks for s in splits.seed_stream(n, 42)]
        schema = "block string, seed long"
        df = self.spark.createDataFrame(tasks, schema)
        df = df.repartition(max(1, min(len(tasks), 8 * self.spark.sparkContext.defaultParallelism)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b = shared.value
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    at, p = blocks[r.block], np.random.RandomState(r.seed).permutation(len(b.ids))
                    if at is None:
                        moved = replace(b, y=b.y[p])
                    else:
                        x = b.x.copy()
                        x[:, at] = x[p][:, at]
                        moved = replace(b, x=x)
                    out.append(fitting.cv_score(cfg, moved, int(r.seed), cfg.weighted_null))
                yield pdf.assign(score=out)

        return save(df.mapInPandas(run, schema + ", score double"), "null-scores")


def predict_ensemble(models: DataFrame, rows: DataFrame, cfg: Config, max_mb: int = 256) -> DataFrame:
    """``row_id, mean, sd, proba`` over fold models for rows ``row_id, features, cov`` (batch or stream).

    Numbers, or hard class labels, are averaged, with sd (ddof 1); ``proba`` holds the mean class probabilities.  Models are
    collected and broadcast; their size is checked.  Outcomes from which covariates' part was removed stay so.
    """
    size = models.agg(F.sum(F.octet_length("model"))).first()[0] or 0
    if size > max_mb * 1e6:
        raise ValueError(f"fold models of {size / 1e6:.0f} MB are over the bound of {max_mb}")
    shared = models.sparkSession.sparkContext.broadcast([r.model for r in models.select("model").orderBy("fold").collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [pickle.loads(m) for m in shared.value]
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["features"].to_numpy()).astype(float)
            cov = np.stack(pdf["cov"].to_numpy()).astype(float).reshape(len(pdf), -1)
            z = [m.linear(cfg, x, cov) for m in known]
            if cfg.is_classification:
                p = [fitting.probabilities(a) for a in z]
                pred, proba = np.stack([a.argmax(1) for a in p]).astype(float), list(np.mean(p, axis=0))
            else:
                pred, proba = np.stack([a[:, 0] for a in z]), [[]] * len(pdf)
            yield pd.DataFrame({"row_id": pdf["row_id"], "mean": pred.mean(0), "sd": pred.std(0, ddof=1) if len(pred) > 1 else np.nan, "proba": proba})

    return rows.select("row_id", "features", "cov").mapInPandas(run, "row_id string, mean double, sd double, proba array<double>")
