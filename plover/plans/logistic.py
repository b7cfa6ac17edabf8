"""Nested cross-validation of penalised logistic and multinomial regression over rows that never leave their partitions.

All models of a stage (outer fold x inner fold x candidate) are fitted together by proximal Newton steps.  A step is one pass over the rows: each batch gives every model
its loss, gradient and curvature as matrix products, partitions add them up, and a group for each model takes the sums and solves its penalised quadratic.
What comes to the driver is each model's coefficients.  A step that raises a model's objective is halved; models that have converged leave the pass.

The curvature is the whole Hessian: one matrix of columns for a binary model, one for each two classes for a multinomial one.  Intercepts are profiled out of the quadratic.

Columns are centred and scaled by the whole table's moments first, for the numbers' sake; models have their own training set's scaler, from moments by cell.
State: models x pairs of classes x columns^2 numbers for a chunk of models, checked; it doesn't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plover.config import LOG, Config
from plover.functions import fitting, solvers
from plover.operators import ingest, splits, stats
from plover.sources.work import save

MAX_BYTES = 256_000_000
MAX_CLASSES = 1_000
SWEEPS = 60  # of coordinate descent in a step; the next one goes on from there
PARAMS = ("alpha_or_c", "l1_ratio", "penalty_weight")


def assign(rows: DataFrame, cfg: Config) -> DataFrame:
    """``fold, repeat, inner``: outer and inner folds, both stratified by ``label``; inner ones are dealt within outer ones."""
    out = splits.stratified_kfold(rows, int(cfg.outer_folds), "label", cfg.seed)
    many = out.withColumn("repeat", F.explode(F.array(*[F.lit(r).cast("bigint") for r in range(cfg.inner_repeats)])))
    by = ["fold", "repeat", "label"]
    ranked = splits.hash_rank(many, F.concat_ws("/", F.lit(str(cfg.seed)), F.col("repeat").cast("string")), by=by)
    # A row for each fold, repeat and class: where a class begins.
    size = many.groupBy(*by).agg(F.count("*").alias("__c"))
    size = size.withColumn("__before", F.sum("__c").over(Window.partitionBy("fold", "repeat").orderBy("label")) - F.col("__c")).drop("__c")
    return ranked.join(F.broadcast(size), by).withColumn("inner", ((F.col("__before") + F.col("rn")) % int(cfg.inner_folds)).cast("bigint")).drop("h", "rn", "n", "__before")


@dataclass
class Model:
    """One model to fit: whose rows train it, its parameters and scaler, and where its steps are."""

    fold: int
    repeat: int
    inner: int  # -1: no inner fold is left out
    cand: int
    c: float
    rho: float
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray  # (m, p + 1) on centred and scaled columns, the intercept first
    before: np.ndarray | None = None  # the last accepted one
    objective: float = np.inf
    done: bool = False
    ok: bool = False

    def standard(self) -> np.ndarray:
        """Takes (1, x) to the model's own (1, z)."""
        t = np.diag(np.concatenate([[1.0], 1 / self.scale]))
        t[1:, 0] = -self.mean / self.scale
        return t


def pairs_of(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m)


def recentred(b: np.ndarray, rho: float) -> np.ndarray:
    """(classes, columns) less what is best taken from a column's every class: the likelihood stays, and the penalty is least."""
    m, at = len(b), np.sort(b, axis=0)
    edge = np.concatenate([np.full((1, b.shape[1]), -np.inf), at, np.full((1, b.shape[1]), np.inf)])
    over = (m - 2 * np.arange(m + 1))[:, None]  # classes above less classes below, between two coefficients
    t = np.clip(b.mean(0) + rho * over / (max(1 - rho, 1e-300) * m), edge[:-1], edge[1:])
    gap = b[:, None, :] - t
    cost = rho * np.abs(gap).sum(0) + (1 - rho) / 2 * (gap * gap).sum(0)
    best = np.argmin(cost, axis=0)
    return b - np.take_along_axis(t, best[None], 0)


def quadratic(s: np.ndarray, c: np.ndarray, alpha: float, rho: float, m: int, start: np.ndarray) -> np.ndarray:
    """The penalised quadratic of a step.  The classes of a multinomial model may all move by the same without a change of likelihood, so only the penalty holds them:
    coordinates would creep that way, and go there at once instead, every few sweeps."""
    if m == 1:
        return solvers.enet_gram(s, c, alpha, rho, max_iter=SWEEPS, start=start)[0]
    w = start
    for _ in range(SWEEPS // 6):
        new, ok = solvers.enet_gram(s, c, alpha, rho, max_iter=6, start=w)
        new = recentred(new.reshape(m, -1), rho).ravel()
        small = np.abs(new - w).max(initial=0) <= 1e-10 * max(1.0, np.abs(new).max(initial=0))
        w = new
        if ok or small:
            break
    return w


def step(x: Model, weight: float, loss: float, grad: np.ndarray, hess: np.ndarray, tol: float) -> Model:
    """Accept or halve the last step, and take the next one; ``hess`` is over (class, column)."""
    m, n = x.beta.shape
    t = x.standard()
    b = x.beta @ np.linalg.inv(t)  # on the model's own columns
    objective = x.c * loss + x.rho * np.abs(b[:, 1:]).sum() + (1 - x.rho) / 2 * (b[:, 1:] ** 2).sum()
    if x.before is not None and objective > x.objective + 1e-10 * abs(x.objective):
        half = (x.beta + x.before) / 2
        if np.abs(half - x.before).max() <= 1e-13 * max(1.0, np.abs(half).max()):
            return Model(**(vars(x) | {"beta": x.before, "done": True, "ok": True}))
        return Model(**(vars(x) | {"beta": half}))
    g = (grad @ t.T).ravel() / weight
    h = np.einsum("ab,kblc,dc->kald", t, hess.reshape(m, n, m, n), t, optimize=True).reshape(m * n, m * n) / weight
    free = np.arange(m) * n
    pen = np.setdiff1d(np.arange(m * n), free)
    inv = np.linalg.pinv(h[np.ix_(free, free)], rcond=1e-10)
    s = h[np.ix_(pen, pen)] - h[np.ix_(pen, free)] @ inv @ h[np.ix_(free, pen)]
    old = b.ravel()[pen]
    w = quadratic(s, s @ old - g[pen] + h[np.ix_(pen, free)] @ inv @ g[free], 1 / (x.c * weight), x.rho, m, old)
    new = b.ravel().copy()
    new[pen] = w
    new[free] -= inv @ (g[free] + h[np.ix_(free, pen)] @ (w - old))
    done = bool(np.abs(new - b.ravel()).max() <= tol * max(1.0, float(np.abs(new).max())))
    return Model(**(vars(x) | {"beta": (b if done else new.reshape(m, n)) @ t, "before": x.beta, "objective": objective, "done": done, "ok": done}))


def probabilities_of(eta: np.ndarray) -> np.ndarray:
    """``(n, M, m)`` linear predictors to probabilities of the classes that ``m`` stands for."""
    if eta.shape[2] == 1:
        return 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
    e = np.exp(eta - eta.max(2, keepdims=True))
    return e / e.sum(2, keepdims=True)


class Fit:
    """Rows ``row_id, label (0, 1, ...), w, design, fold, repeat, inner`` and what their fits share."""

    def __init__(self, rows: DataFrame, n_classes: int, n_covs: int, weighted: bool = True) -> None:
        self.rows, self.k, self.n_covs, self.weighted = rows, n_classes, n_covs, weighted
        self.m = 1 if n_classes == 2 else n_classes
        self.spark = rows.sparkSession
        self._moments()

    def _moments(self) -> None:
        """Sums of columns and of their squares, and classes, by cell; a row for each cell and class."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for key, part in pdf.groupby(["fold", "repeat", "inner", "label"]):
                    x = np.stack(part["design"].to_numpy()).astype(float)
                    mid = x.mean(0)
                    yield pd.DataFrame({**dict(zip(("fold", "repeat", "inner", "label"), key, strict=True)), "n": len(x), "s": [mid], "q": [((x - mid) ** 2).sum(0)]}, index=[0])

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            n = pdf["n"].to_numpy(dtype=float)
            s, q = np.stack(pdf["s"].to_numpy()), np.stack(pdf["q"].to_numpy())
            mid = n @ s / n.sum()
            return pd.DataFrame({**{c: pdf[c].iloc[0] for c in ("fold", "repeat", "inner", "label")}, "n": int(n.sum()), "s": [mid], "q": [q.sum(0) + n @ (s - mid) ** 2]}, index=[0])

        schema = "fold long, repeat long, inner long, label long, n long, s array<double>, q array<double>"
        got = self.rows.select("fold", "repeat", "inner", "label", "design").mapInPandas(run, schema).groupBy("fold", "repeat", "inner", "label").applyInPandas(merge, schema).collect()
        self.cell = [(r.fold, r.repeat, r.inner, r.label, r.n, np.array(r.s), np.array(r.q)) for r in got]
        self.mean, var = self.pooled([c for c in self.cell if c[1] == 0])
        self.scale = np.where(var > 0, np.sqrt(var), 1.0)
        self.p = len(self.mean)

    @staticmethod
    def pooled(cells: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([c[4] for c in cells], dtype=float)
        s, q = np.stack([c[5] for c in cells]), np.stack([c[6] for c in cells])
        mid = n @ s / n.sum()
        return mid, (q.sum(0) + n @ (s - mid) ** 2) / n.sum()

    def model(self, fold: int, repeat: int, inner: int, cand: int, params: dict[str, float]) -> Model | None:
        """A model before its first step; none if its training rows are of one class."""
        cells = [c for c in self.cell if c[1] == repeat and c[0] != fold and (inner < 0 or c[2] != inner)]
        if len({c[3] for c in cells}) < 2:
            return None
        mean, var = self.pooled(cells)
        sd = np.sqrt(var)
        sd = np.where(sd > 10 * np.finfo(float).eps * np.maximum(np.abs(mean), 1e-300), sd, 1.0)
        sd[: self.n_covs] *= params["penalty_weight"]
        return Model(fold, repeat, inner, cand, params["alpha_or_c"], params["l1_ratio"], (mean - self.mean) / self.scale, sd / self.scale, np.zeros((self.m, self.p + 1)))

    def _sums(self, models: list[Model], curved: bool) -> DataFrame:
        """``id, weight, loss, grad, hess`` of every model: over its training rows, or, without ``curved``, over those its inner fold left out."""
        p, k, m, weighted = self.p, self.k, self.m, self.weighted
        of = [np.array([getattr(x, c) for x in models]) for c in ("fold", "repeat", "inner")]
        beta = np.stack([x.beta for x in models])
        shared = self.spark.sparkContext.broadcast((of, beta, self.mean, self.scale))
        up, two = np.triu_indices(p + 1), pairs_of(m)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (fold, repeat, inner), beta, mean, scale = shared.value
            total: dict[int, list] = {}
            for whole in batches:
                for r, pdf in whole.groupby("repeat"):
                    mine = np.flatnonzero(repeat == r)
                    if not len(mine):
                        continue
                    b = beta[mine]
                    for at in range(0, len(pdf), 512):
                        part = pdf.iloc[at : at + 512]
                        a = np.column_stack([np.ones(len(part)), (np.stack(part["design"].to_numpy()).astype(float) - mean) / scale])
                        y, w = part["label"].to_numpy(dtype=int), part["w"].to_numpy(dtype=float) if weighted else np.ones(len(part))
                        f, j = part["fold"].to_numpy()[:, None], part["inner"].to_numpy()[:, None]
                        left = (inner[mine] >= 0) & (j == inner[mine])
                        use = (f != fold[mine]) & (~left if curved else left)
                        weight = use * (w[:, None] if curved else 1.0)
                        q = probabilities_of((a @ b.reshape(-1, p + 1).T).reshape(len(a), len(mine), m))
                        t = (y == 1)[:, None].astype(float) if m == 1 else np.eye(k)[y]
                        true = np.where(t[:, None, 0] > 0, q[:, :, 0], 1 - q[:, :, 0]) if m == 1 else (q * t[:, None, :]).sum(2)
                        got = [weight.sum(0), -(weight * np.log(np.clip(true, 1e-300 if curved else 1e-15, 1.0 if curved else 1 - 1e-15))).sum(0)]
                        if curved:
                            e = weight[:, :, None] * (q - t[:, None, :])
                            h = weight[:, :, None] * (q * (1 - q) if m == 1 else q[:, :, two[0]] * ((two[0] == two[1]) - q[:, :, two[1]]))
                            z = a[:, up[0]] * a[:, up[1]]
                            got += [np.tensordot(e, a, (0, 0)), np.tensordot(h, z, (0, 0))]
                        total[r] = got if r not in total else [x + g for x, g in zip(total[r], got, strict=True)]
            for r, got in total.items():
                out = {"id": np.flatnonzero(repeat == r), "weight": got[0], "loss": got[1]}
                if curved:
                    out |= {"grad": list(got[2].reshape(len(out["id"]), -1)), "hess": list(got[3].reshape(len(out["id"]), -1))}
                yield pd.DataFrame(out)

        schema = "id long, weight double, loss double" + (", grad array<double>, hess array<double>" if curved else "")
        return self.rows.select("fold", "repeat", "inner", "label", "w", "design").mapInPandas(run, schema)

    def fit(self, models: list[Model], max_steps: int = 100, tol: float = 1e-7) -> list[Model]:
        """The fitted models, a chunk of them at a time."""
        each = self.m * (self.m + 1) // 2 * (self.p + 1) * (self.p + 2) // 2 * 8
        if each > MAX_BYTES:
            raise ValueError(f"the curvature of one model has {each} bytes, over the bound of {MAX_BYTES}")
        chunk, out = max(1, MAX_BYTES // each), []
        for at in range(0, len(models), chunk):
            out += self._fit(models[at : at + chunk], max_steps, tol)
        return out

    def _fit(self, models: list[Model], max_steps: int, tol: float) -> list[Model]:
        models, m, p = list(models), self.m, self.p
        up, two = np.triu_indices(p + 1), pairs_of(m)
        for _ in range(max_steps):
            open_ = [i for i, x in enumerate(models) if not x.done]
            if not open_:
                break
            now = [models[i] for i in open_]
            shared = self.spark.sparkContext.broadcast(now)

            def solve(pdf: pd.DataFrame) -> pd.DataFrame:
                x = shared.value[int(pdf["id"].iloc[0])]  # noqa: B023
                grad, flat = np.stack(pdf["grad"].to_numpy()).sum(0).reshape(m, p + 1), np.stack(pdf["hess"].to_numpy()).sum(0).reshape(len(two[0]), -1)
                each = np.zeros((len(two[0]), p + 1, p + 1))
                each[:, up[0], up[1]] = each[:, up[1], up[0]] = flat
                hess = np.zeros((m, p + 1, m, p + 1))
                hess[two[0], :, two[1], :] = hess[two[1], :, two[0], :] = each
                new = step(x, float(pdf["weight"].sum()), float(pdf["loss"].sum()), grad, hess, tol)
                return pd.DataFrame({"id": pdf["id"].iloc[:1], "beta": [new.beta.ravel()], "before": [new.before.ravel()], "objective": [new.objective], "done": [new.done], "ok": [new.ok]})

            # A row from each task for a model.
            got = self._sums(now, True).groupBy("id").applyInPandas(solve, "id long, beta array<double>, before array<double>, objective double, done boolean, ok boolean").collect()
            shape = (m, p + 1)
            for r in got:  # coefficients of the models, not rows
                i = open_[r.id]
                models[i] = Model(**(vars(models[i]) | {"beta": np.array(r.beta).reshape(shape), "before": np.array(r.before).reshape(shape), "objective": r.objective, "done": r.done, "ok": r.ok}))
            shared.unpersist()
        return models

    def left_out(self, models: list[Model]) -> list[float]:
        """Mean log-likelihood of each model on the rows that its inner fold left out."""
        out = np.full(len(models), -np.inf)
        for r in self._sums(models, False).groupBy("id").agg(F.sum("weight").alias("n"), F.sum("loss").alias("loss")).collect():
            out[r.id] = -r.loss / r.n if r.n else -np.inf
        return out.tolist()


def labelled(df: DataFrame, cfg: Config) -> tuple[DataFrame, list[str], list, int]:
    """Rows ``row_id, label, w, design``, features' names, classes in order, and the number of covariates in the design."""
    if not cfg.is_classification or cfg.reduction != "none" or isinstance(cfg.outer_folds, str) or isinstance(cfg.inner_folds, str):
        raise ValueError("this path serves classification with k folds, without reduction")
    rows, names = ingest.role_projection(df, cfg)
    ingest.check_rows(rows)
    rows = rows.withColumn("label_value", F.get("y", F.lit(0)))
    found = sorted(r[0] for r in rows.select("label_value").distinct().limit(MAX_CLASSES + 1).collect())
    if not 2 <= len(found) <= MAX_CLASSES:
        raise ValueError(f"classification needs 2 to {MAX_CLASSES} classes")
    n_covs = len(cfg.roles.covariates) if cfg.covariate_method == "incorporate" else 0
    known = df.sparkSession.createDataFrame(list(enumerate(found)), "label long, v double")
    rows = rows.join(F.broadcast(known), F.col("label_value") == F.col("v"))  # a row a class
    total = rows.agg(F.count("*").alias("__n"), F.sum("w").alias("__s"))
    rows = rows.join(F.broadcast(total), how="cross").withColumn("w", F.col("w") * F.col("__n") / F.col("__s"))
    design = F.concat("cov", "features") if n_covs else F.col("features")
    return rows.select("row_id", "label", "w", design.alias("design")), names, [int(c) if float(c).is_integer() else c for c in found], n_covs


def prepare(df: DataFrame, cfg: Config) -> tuple[DataFrame, list[str], list, int]:
    """The rows of :func:`labelled` with their folds, saved."""
    rows, names, classes, n_covs = labelled(df, cfg)
    return save(assign(rows, cfg), "logistic-rows"), names, classes, n_covs


def nested_cv(df: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame, list]:
    """``row_id, fold, task, y_true, y_pred, prob``; ``fold, task, feature, coef``; each fold's parameters; and the classes."""
    rows, names, classes, n_covs = prepare(df, cfg)
    spark, fit = df.sparkSession, Fit(rows, len(classes), n_covs, bool(cfg.roles.weight))
    tried = fitting.candidates(cfg, cfg.n_candidates or 20, 42)
    folds = range(int(cfg.outer_folds))
    made = [(k, i, fit.model(k, r, j, i, c)) for k in folds for i, c in enumerate(tried) for r in range(cfg.inner_repeats) for j in range(int(cfg.inner_folds))]
    fitted = fit.fit([m for *_, m in made if m is not None])
    scores, score = iter(fit.left_out(fitted) if fitted else []), {}
    for k, i, m in made:
        score.setdefault((k, i), []).append(-np.inf if m is None else next(scores))
    table = save(spark.createDataFrame([(k, i, *(float(tried[i][p]) for p in PARAMS), float(np.mean(s))) for (k, i), s in score.items()], "fold long, cand_id long, alpha_or_c double, l1_ratio double, penalty_weight double, score double"), "logistic-search")
    best = {r.fold: r.cand_id for r in stats.best_candidate(table).collect()}  # a row a fold
    last = [fit.model(k, 0, -1, best[k], tried[best[k]]) for k in folds]
    if None in last:
        raise ValueError("a training set of one class")
    last = fit.fit(last)
    slow = sum(not m.ok for m in [*fitted, *last])
    if slow:
        LOG.warning("%d of %d models did not converge", slow, len(fitted) + len(last))
    betas = {m.fold: m.beta for m in last}
    shared, mean, scale = spark.sparkContext.broadcast(betas), fit.mean, fit.scale

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k, part in whole.groupby("fold"):
                a = np.column_stack([np.ones(len(part)), (np.stack(part["design"].to_numpy()).astype(float) - mean) / scale])
                prob = fitting.probabilities(a @ shared.value[k].T)
                yield pd.DataFrame({"row_id": part["row_id"], "fold": k, "task": "single", "y_true": part["label"].astype(float), "y_pred": prob.argmax(1).astype(float), "prob": list(prob)})

    oof = rows.filter("repeat = 0").select("row_id", "fold", "label", "design").mapInPandas(predict, "row_id string, fold long, task string, y_true double, y_pred double, prob array<double>")
    tasks = ["single"] if len(classes) == 2 else [str(c) for c in classes]
    coef = [(m.fold, t, name, float(b[1 + n_covs + j])) for m in last for t, b in zip(tasks, m.beta @ np.linalg.inv(m.standard()), strict=True) for j, name in enumerate(names)]
    return oof, spark.createDataFrame(coef, "fold long, task string, feature string, coef double"), spark.createDataFrame([(k, *(float(tried[best[k]][p]) for p in PARAMS), bool(m.ok)) for k, m in zip(folds, last, strict=True)], "fold long, alpha_or_c double, l1_ratio double, penalty_weight double, converged boolean"), classes
