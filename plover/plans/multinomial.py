"""Nested cross-validation of penalised multinomial regression over rows that never leave their partitions, by passes that cost what a gradient does.

The whole Hessian of ``plover.plans.logistic`` has classes^2 x columns^2 numbers a row and model.  Here a step's curvature is the mean curvature of the classes times the training
set's products of columns, which one pass has summed before: a pass takes each model's loss and gradient, and classes^2 numbers.  It is the Hessian if all rows have the same
probabilities; a step that raises the objective is halved.  After ``STEPS`` such steps the models go on with whole Hessians from where they are, near the optimum, and two or
three of those end them: the same optimum, as the gradients are of all rows throughout.

Outer and inner folds are those of the row path: stratified, each training set dealt by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.config import LOG, Config
from plover.functions import fitting
from plover.operators import splits, stats
from plover.plans.logistic import MAX_BYTES, PARAMS, Model, labelled, pairs_of, probabilities_of, step
from plover.sources.work import save

STEPS = 8  # by mean curvatures
NUMBERS = 1 << 18  # linear predictors that a task holds at once


def prepare(df: DataFrame, cfg: Config) -> tuple[DataFrame, list[str], list, int]:
    """Saved rows ``row_id, label, w, design, fold, inner`` (inner folds by repeat and outer fold, end to end), features' names, classes, and the number of covariates."""
    rows, names, classes, n_covs = labelled(df, cfg)
    k, keep = int(cfg.outer_folds), rows.columns
    rows = splits.stratified_kfold(rows, k, "label", cfg.seed)
    for r in range(cfg.inner_repeats):
        rows = splits.training_folds(rows, k, int(cfg.inner_folds), F.lit(f"{cfg.seed}/{r}"), "label").withColumnRenamed("inner", f"__inner{r}")
    inner = F.concat(*[F.col(f"__inner{r}") for r in range(cfg.inner_repeats)])
    return save(rows.select(*keep, "fold", inner.alias("inner")), "multinomial-rows"), names, classes, n_covs


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


class Passes:
    """Rows of :func:`prepare` and what their fits share; a set is (outer fold, repeat, inner fold left out or -1)."""

    def __init__(self, rows: DataFrame, n_classes: int, n_covs: int, k_out: int, weighted: bool, sets: list[tuple[int, int, int]]) -> None:
        self.rows, self.k, self.n_covs, self.k_out, self.weighted = rows, n_classes, n_covs, k_out, weighted
        self.m, self.spark, self.sets = 1 if n_classes == 2 else n_classes, rows.sparkSession, sets
        self._overall()
        if (self.m * (self.p + 1)) ** 2 * 8 > MAX_BYTES:
            raise ValueError(f"the curvature of a model of {self.m * (self.p + 1)} coefficients is over the bound of {MAX_BYTES} bytes")
        self._products()

    def _overall(self) -> None:
        """Means and sds of all columns, for the numbers' sake."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, mid, q = 0, 0.0, 0.0
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(0), b.num_rows)
                    own, more = x.mean(0), len(x)
                    gap, total = own - mid, n + more
                    mid, q, n = mid + gap * (more / total), q + ((x - own) ** 2).sum(0) + gap**2 * (n * more / total), total
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mid.tobytes()]), pa.array([q.tobytes()])], ["n", "mid", "q"])

        got = self.rows.select("design").mapInArrow(run, "n long, mid binary, q binary").collect()  # a row a task
        n, mid, q = np.array([r.n for r in got], dtype=float), *(np.stack([np.frombuffer(r[c]) for r in got]) for c in ("mid", "q"))
        self.mean = n @ mid / n.sum()
        var = (q.sum(0) + n @ (mid - self.mean) ** 2) / n.sum()
        self.scale, self.p = np.where(var > 0, np.sqrt(var), 1.0), len(self.mean)

    def _each(self, sets: list[tuple[int, int, int]], left: bool, init, add, numbers: int) -> DataFrame:
        """``id, sums``: what ``add`` sums over the rows that each of ``sets`` trains on, or, with ``left``, over those its inner fold leaves out.

        ``add(total, columns, label, w, use)`` changes the arrays of ``init()`` in place; their first axis is that of ``sets``.  ``numbers`` is what a row takes.
        """
        fold, repeat, inner = (np.array(c) for c in zip(*sets, strict=True))
        at, mean, scale, weighted, chunk = repeat * self.k_out + fold, self.mean, self.scale, self.weighted, max(128, NUMBERS // numbers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for whole in batches:
                for i in range(0, whole.num_rows, chunk):
                    b = whole.slice(i, chunk)
                    n = b.num_rows
                    total = init() if total is None else total
                    f, label, w = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
                    part = _matrix(b.column(1), n)[:, at]
                    out = (inner >= 0) & (part == inner)
                    use = (f[:, None] != fold) & (out if left else ~out)
                    a = np.column_stack([np.ones(n), (_matrix(b.column(4), n) - mean) / scale])
                    add(total, a, label, w if weighted else np.ones(n), use)
            if total is not None:
                flat = np.hstack([x.reshape(len(fold), -1) for x in total])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fold))), pa.array([x.tobytes() for x in flat])], ["id", "sums"])

        rows = self.rows.select("fold", "inner", "label", "w", "design").coalesce(2 * self.spark.sparkContext.defaultParallelism)  # sums come from each task
        return rows.mapInArrow(run, "id long, sums binary")

    @staticmethod
    def _added(parts: DataFrame) -> DataFrame:
        """Sums of the arrays by ``id``; a group has a row from each task."""

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"id": pdf["id"].iloc[:1], "sums": [sum(np.frombuffer(x) for x in pdf["sums"]).tobytes()]})

        return parts.groupBy("id").applyInPandas(add, "id long, sums binary")

    def _products(self) -> None:
        """Every set's classes, scaler, and weighted mean products of (1, columns)."""
        k, n, up = self.k, self.p + 1, np.triu_indices(self.p + 1)
        chunk = max(1, MAX_BYTES // (16 * len(up[0])))
        self.seen, self.scaler, self.gram = [], [], []
        for i in range(0, len(self.sets), chunk):
            sets = self.sets[i : i + chunk]

            def init(t: int = len(sets)) -> list[np.ndarray]:
                return [np.zeros((t, k)), np.zeros((t, len(up[0]))), np.zeros((t, 3 * n))]

            def add(total: list[np.ndarray], a: np.ndarray, label: np.ndarray, w: np.ndarray, use: np.ndarray) -> None:
                use = use.astype(float)
                total[0] += use.T @ np.eye(k)[label]
                total[1] += (use * w[:, None]).T @ (a[:, up[0]] * a[:, up[1]])
                total[2] += np.hstack([use.T @ a, use.T @ (a * a), (use * w[:, None]).T @ a])

            for r in sorted(self._added(self._each(sets, False, init, add, len(up[0]))).collect(), key=lambda r: r.id):  # a row a set
                x = np.frombuffer(r.sums)
                g, rest = np.zeros((n, n)), x[k + len(up[0]) :]
                g[up] = x[k : k + len(up[0])]
                g = g + np.triu(g, 1).T
                mean = rest[1:n] / rest[0]
                var = rest[n + 1 : 2 * n] / rest[0] - mean * mean
                self.seen.append(int((x[:k] > 0).sum()))
                self.scaler.append((mean, np.sqrt(np.maximum(var, 0))))
                self.gram.append(g / max(g[0, 0], 1e-300))

    def model(self, at: int, cand: int, params: dict[str, float]) -> Model | None:
        """A model of the set numbered ``at`` before its first step; none if its training rows are of one class."""
        if self.seen[at] < 2:
            return None
        mean, sd = self.scaler[at]
        raw = self.mean + self.scale * mean
        sd = np.where(sd * self.scale > 1e-12 * np.maximum(np.abs(raw), 1e-300), sd, 1 / self.scale)
        sd[: self.n_covs] *= params["penalty_weight"]
        return Model(*self.sets[at], cand, params["alpha_or_c"], params["l1_ratio"], mean, sd, np.zeros((self.m, self.p + 1)))

    def _sums(self, models: list[Model], kind: str) -> DataFrame:
        """``id, sums`` of models: weight and loss; with their gradients and mean (``kind`` "mean") or whole ("full") curvature; "left": over the rows left out."""
        p, k, m = self.p, self.k, self.m
        up, two = np.triu_indices(p + 1), pairs_of(m)
        shared, t = self.spark.sparkContext.broadcast(np.stack([x.beta for x in models])), len(models)
        size = {"left": [], "mean": [m * (p + 1), m * m], "full": [m * (p + 1), len(two[0]) * len(up[0])]}[kind]

        def init() -> list[np.ndarray]:
            return [np.zeros((t, 2)), *(np.zeros((t, s)) for s in size)]

        def add(total: list[np.ndarray], a: np.ndarray, label: np.ndarray, w: np.ndarray, use: np.ndarray) -> None:
            weight = use * (1.0 if kind == "left" else w[:, None])
            q = probabilities_of((a @ shared.value.reshape(-1, p + 1).T).reshape(len(a), t, m))
            y = (label == 1)[:, None].astype(float) if m == 1 else np.eye(k)[label]
            true = np.where(y[:, None, 0] > 0, q[:, :, 0], 1 - q[:, :, 0]) if m == 1 else np.take_along_axis(q, label[:, None, None], 2)[:, :, 0]
            lo, hi = (1e-15, 1 - 1e-15) if kind == "left" else (1e-300, 1.0)
            total[0] += np.column_stack([weight.sum(0), -(weight * np.log(np.clip(true, lo, hi))).sum(0)])
            if kind == "left":
                return
            total[1] += ((weight[:, :, None] * (q - y[:, None, :])).reshape(len(a), -1).T @ a).reshape(t, -1)
            wq = weight[:, :, None] * q
            if kind == "mean":
                one = np.ascontiguousarray(q.transpose(1, 0, 2))
                both = -np.matmul(wq.transpose(1, 2, 0), one)
                both[:, np.arange(m), np.arange(m)] += wq.sum(0)
                total[2] += both.reshape(t, -1)
            else:
                h = wq * (1 - q) if m == 1 else wq[:, :, two[0]] * ((two[0] == two[1]) - q[:, :, two[1]])
                total[2] += np.tensordot(h, a[:, up[0]] * a[:, up[1]], (0, 0)).reshape(t, -1)

        return self._each([(x.fold, x.repeat, x.inner) for x in models], kind == "left", init, add, t * m * (1 if kind != "full" else len(two[0])))

    def fit(self, models: list[Model], max_steps: int = 100, tol: float = 1e-7) -> list[Model]:
        """The fitted models: by mean curvatures, then, for those that aren't done, by whole ones; a chunk of them at a time."""
        n = self.m * (self.p + 1)
        for kind, each, steps in (("mean", n + self.m**2, STEPS), ("full", n * (n + 1) // 2, max_steps)):
            todo, chunk = [i for i, x in enumerate(models) if not x.done], max(1, MAX_BYTES // (each * 8))
            for at in range(0, len(todo), chunk):
                for i, x in zip(todo[at : at + chunk], self._fit([models[i] for i in todo[at : at + chunk]], kind, steps, tol), strict=True):
                    models[i] = x
        return models

    def _fit(self, models: list[Model], kind: str, max_steps: int, tol: float) -> list[Model]:
        models, m, n = list(models), self.m, self.p + 1
        up, two, shape = np.triu_indices(n), pairs_of(m), (m, n)
        grams = self.spark.sparkContext.broadcast(dict(zip(self.sets, self.gram, strict=True)))
        for _ in range(max_steps):
            open_ = [i for i, x in enumerate(models) if not x.done]
            if not open_:
                break
            now = [models[i] for i in open_]
            shared = self.spark.sparkContext.broadcast(now)

            def solve(pdf: pd.DataFrame) -> pd.DataFrame:
                x = shared.value[int(pdf["id"].iloc[0])]  # noqa: B023
                got = sum(np.frombuffer(s) for s in pdf["sums"])
                grad, rest = got[2 : 2 + m * n].reshape(shape), got[2 + m * n :]
                if kind == "mean":
                    hess = rest.reshape(m, 1, m, 1) * grams.value[x.fold, x.repeat, x.inner].reshape(1, n, 1, n)
                else:
                    each = np.zeros((len(two[0]), n, n))
                    each[:, up[0], up[1]] = each[:, up[1], up[0]] = rest.reshape(len(two[0]), -1)
                    hess = np.zeros((m, n, m, n))
                    hess[two[0], :, two[1], :] = hess[two[1], :, two[0], :] = each
                new = step(x, float(got[0]), float(got[1]), grad, hess, tol)
                return pd.DataFrame({"id": pdf["id"].iloc[:1], "beta": [new.beta.tobytes()], "before": [new.before.tobytes()], "objective": [new.objective], "done": [new.done], "ok": [new.ok]})

            # A row from each task for a model; the models are solved over all cores.
            for r in self._sums(now, kind).repartition(min(len(now), 4 * self.spark.sparkContext.defaultParallelism), "id").groupBy("id").applyInPandas(solve, "id long, beta binary, before binary, objective double, done boolean, ok boolean").collect():
                i = open_[r.id]
                models[i] = Model(**(vars(models[i]) | {"beta": np.frombuffer(r.beta).reshape(shape), "before": np.frombuffer(r.before).reshape(shape), "objective": r.objective, "done": r.done, "ok": r.ok}))
            shared.unpersist()
        return models

    def left_out(self, models: list[Model]) -> list[float]:
        """Mean log-likelihood of each model on the rows that its inner fold left out."""
        out = np.full(len(models), -np.inf)
        for r in self._added(self._sums(models, "left")).collect() if models else []:
            weight, loss = np.frombuffer(r.sums)
            out[r.id] = -loss / weight if weight else -np.inf
        return out.tolist()


def nested_cv(df: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame, list]:
    """As :func:`plover.plans.logistic.nested_cv`, with the row path's folds."""
    rows, names, classes, n_covs = prepare(df, cfg)
    spark, folds = df.sparkSession, range(int(cfg.outer_folds))
    sets = [(k, 0, -1) for k in folds] + [(k, r, j) for k in folds for r in range(cfg.inner_repeats) for j in range(int(cfg.inner_folds))]
    fit = Passes(rows, len(classes), n_covs, len(folds), bool(cfg.roles.weight), sets)
    tried = fitting.candidates(cfg, cfg.n_candidates or 20, 42)
    made = [(sets[at][0], i, fit.model(at, i, c)) for i, c in enumerate(tried) for at in range(len(folds), len(sets))]
    fitted = fit.fit([m for *_, m in made if m is not None])
    scores, score = iter(fit.left_out(fitted)), {}
    for k, i, m in made:
        score.setdefault((k, i), []).append(-np.inf if m is None else next(scores))
    table = save(spark.createDataFrame([(k, i, *(float(tried[i][p]) for p in PARAMS), float(np.mean(s))) for (k, i), s in score.items()], "fold long, cand_id long, alpha_or_c double, l1_ratio double, penalty_weight double, score double"), "multinomial-search")
    best = {r.fold: r.cand_id for r in stats.best_candidate(table).collect()}  # a row a fold
    last = [fit.model(k, best[k], tried[best[k]]) for k in folds]
    if None in last:
        raise ValueError("a training set of one class")
    last = fit.fit(last)
    slow = sum(not m.ok for m in [*fitted, *last])
    if slow:
        LOG.warning("%d of %d models did not converge", slow, len(fitted) + len(last))
    shared, mean, scale = spark.sparkContext.broadcast({m.fold: m.beta for m in last}), fit.mean, fit.scale

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k, part in whole.groupby("fold"):
                a = np.column_stack([np.ones(len(part)), (np.stack(part["design"].to_numpy()).astype(float) - mean) / scale])
                prob = fitting.probabilities(a @ shared.value[k].T)
                yield pd.DataFrame({"row_id": part["row_id"], "fold": k, "task": "single", "y_true": part["label"].astype(float), "y_pred": prob.argmax(1).astype(float), "prob": list(prob)})

    oof = rows.select("row_id", "fold", "label", "design").mapInPandas(predict, "row_id string, fold long, task string, y_true double, y_pred double, prob array<double>")
    tasks = ["single"] if len(classes) == 2 else [str(c) for c in classes]
    coef = [(m.fold, t, name, float(b[1 + n_covs + j])) for m in last for t, b in zip(tasks, m.beta @ np.linalg.inv(m.standard()), strict=True) for j, name in enumerate(names)]
    params = [(k, *(float(tried[best[k]][p]) for p in PARAMS), bool(m.ok)) for k, m in zip(folds, last, strict=True)]
    return oof, spark.createDataFrame(coef, "fold long, task string, feature string, coef double"), spark.createDataFrame(params, "fold long, alpha_or_c double, l1_ratio double, penalty_weight double, converged boolean"), classes
