"""Nested cross-validation of elastic-net regression from moments: state that doesn't grow with the rows.

One pass sums products of (1, design, outcomes) for each cell of (outer fold, repeat, inner fold), once for each repeat.
Inner folds are dealt within outer folds, so that every training set's inner folds differ by a row or so for each fold; or each training set
is dealt by itself, as on rows (``like_rows``): then a cell holds the rows of a fold that every training set deals alike, ``outer folds x (inner folds - 1) + 1`` in a fold
at most, as all deal them in one order.
Any training or validation set's scaler, Gram matrix and errors are sums and differences of cells; the models are then
solved by tasks over folds x candidates.  Outcomes may be taken less their covariates' part, and features reduced to components of
their clusters: see ``plover.plans.changes``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.config import Config
from plover.functions import fitting, solvers
from plover.operators import ingest, splits, stats
from plover.plans import changes, ica
from plover.sources.work import save

MAX_BYTES = 512_000_000
ROWS = 16
PARAMS = ("alpha_or_c", "l1_ratio", "penalty_weight")


def assign(rows: DataFrame, cfg: Config) -> DataFrame:
    """``fold`` and, for each repeat, ``repeat, inner``."""
    out = splits.kfold(rows, int(cfg.outer_folds), cfg.seed)
    many = out.withColumn("repeat", F.explode(F.array(*[F.lit(r).cast("bigint") for r in range(cfg.inner_repeats)])))
    ranked = splits.hash_rank(many, F.concat_ws("/", F.lit(str(cfg.seed)), F.col("repeat").cast("string")), by=["fold", "repeat"])
    return ranked.withColumn("inner", (F.col("rn") % int(cfg.inner_folds)).cast("bigint")).drop("h", "rn", "n")


def assign_like_rows(rows: DataFrame, cfg: Config) -> DataFrame:
    """``fold, repeat, inner``: for each outer fold, the inner fold in its training set as the row path deals it, joined by commas."""
    out, k = splits.kfold(rows, int(cfg.outer_folds), cfg.seed), int(cfg.outer_folds)
    parts = []
    for r in range(cfg.inner_repeats):
        out = splits.training_folds(out, k, int(cfg.inner_folds), F.lit(f"{cfg.seed}/{r}")).withColumnRenamed("inner", f"__inner{r}")
        parts.append(F.struct(F.lit(r).cast("bigint").alias("repeat"), F.array_join(f"__inner{r}", ",").alias("inner")))
    return out.select(*rows.columns, "fold", F.explode(F.array(*parts)).alias("__p")).select(*rows.columns, "fold", "__p.*")


def cells(assigned: DataFrame) -> DataFrame:
    """``fold, repeat, inner, kind, i, g``: rows of the moment matrices; kind 0 counts rows, kind 1 weighs them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, list] = {}
        for pdf in batches:
            for key, part in pdf.groupby(["fold", "repeat", "inner"], sort=False):
                a = np.column_stack([np.ones(len(part)), np.stack(part["design"].to_numpy()).astype(float), np.stack(part["y"].to_numpy()).astype(float)])
                aw = a * part["w"].to_numpy(dtype=float)[:, None]
                got = [a.T @ a, aw.T @ a]
                total[key] = got if key not in total else [x + z for x, z in zip(total[key], got, strict=True)]
        for (f, r, j), got in total.items():
            for kind, m in enumerate(got):
                yield pd.DataFrame({"fold": f, "repeat": r, "inner": j, "kind": kind, "i": np.arange(len(m)), "g": list(m)})

    schema = f"fold long, repeat long, inner {assigned.schema['inner'].dataType.simpleString()}, kind int, i int, g array<double>"
    part = assigned.select("fold", "repeat", "inner", "design", "y", "w").mapInPandas(run, schema)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        i = pdf["i"].to_numpy()
        at, to = np.unique(i, return_inverse=True)
        g = np.zeros((len(at), len(pdf["g"].iloc[0])))
        np.add.at(g, to, np.stack(pdf["g"].to_numpy()))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in ("fold", "repeat", "inner", "kind")}, "i": at, "g": list(g)})

    # A group has ROWS of the matrix's rows from each task at most.
    return part.groupBy("fold", "repeat", "inner", "kind", F.floor(F.col("i") / ROWS).alias("part")).applyInPandas(add, schema)


def solve(plain: np.ndarray, weighted: np.ndarray, n_tasks: int, n_covs: int, params: dict[str, float], start: np.ndarray | None = None) -> solvers.Fitted:
    """The model of a set of rows from its moments, or a stack of models from stacks of moments; ``start`` (tasks, columns) is where to begin."""
    size = plain.shape[-1]
    d, t = slice(1, size - n_tasks), slice(size - n_tasks, size)
    n = plain[..., 0, :1]
    m = plain[..., 0, d] / n
    s = np.sqrt(np.maximum(np.diagonal(plain, axis1=-2, axis2=-1)[..., d] / n - m * m, 0))
    s = np.where(s > 1e-12 * np.maximum(np.abs(m), 1e-300), s, 1.0)
    s[..., :n_covs] *= params["penalty_weight"]
    w = weighted[..., 0, :1]
    xm, ym = weighted[..., 0, d] / w, weighted[..., 0, t] / w
    outer = lambda x, y: x[..., :, None] * y[..., None, :]
    g = (weighted[..., d, d] / w[..., None] - outer(xm, xm)) / outer(s, s)
    c = (weighted[..., d, t] / w[..., None] - outer(xm, ym)) / s[..., None]
    begin = None if start is None else start.T if n_tasks > 1 else start[0]
    b, ok = solvers.enet_gram(g, c[..., 0] if n_tasks == 1 else c, params["alpha_or_c"], params["l1_ratio"], start=begin)
    b = b[..., None] if n_tasks == 1 else b
    return solvers.Fitted(m, s, np.swapaxes(b, -1, -2), ym - (((xm - m) / s)[..., None, :] @ b)[..., 0, :], ok)


def squared_errors(plain: np.ndarray, model: solvers.Fitted) -> np.ndarray:
    """Each task's sum of squared errors on a set of rows, from its moments; of a stack for stacks of moments and models."""
    t = model.coef.shape[-2]
    p = plain.shape[-1] - t
    dot = lambda x, y: (x[..., None, :] @ y[..., None])[..., 0, 0]
    out = []
    for k in range(t):
        b = model.coef[..., k, :] / model.scale
        v = np.zeros(plain.shape[:-1])
        v[..., 0], v[..., 1:p], v[..., p + k] = -(model.intercept[..., k] - dot(model.mean, b)), -b, 1.0
        out.append(dot((v[..., None, :] @ plain)[..., 0, :], v))
    return np.maximum(np.stack(out, -1), 0)


def _means(rows: DataFrame) -> DataFrame:
    return rows.select(F.posexplode("design").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i")


def centred(rows: DataFrame) -> DataFrame:
    """``design`` less its columns' means, so that sums of squares lose no digits; no result depends on it."""
    return _less(rows, [r.m for r in _means(rows).collect()])  # a row a column


def _less(rows: DataFrame, m: list[float]) -> DataFrame:
    return rows.withColumn("design", F.zip_with("design", F.array(*[F.lit(x) for x in m]).cast("array<double>"), lambda x, c: x - c))


class NestedCV:
    """Nested cross-validation of a regression of any number of rows: what it found, as saved tables.

    ``cluster_map`` (``feature, cluster``) is for the a-priori reduction.  ``like_rows`` deals inner folds as the row path does, and so scores candidates as it does.
    """

    def __init__(self, df: DataFrame, cfg: Config, cluster_map: DataFrame | None = None, like_rows: bool = False) -> None:
        rows, names = ingest.role_projection(df, cfg)
        ingest.check_rows(rows)
        self.cfg, self.spark, self.names = cfg, df.sparkSession, names
        self.recipe = changes.independent(cfg, names) if cfg.reduction == "ica" else changes.recipe(df, cfg, names, cluster_map)
        k_out, k_in, size = int(cfg.outer_folds), int(cfg.inner_folds), self.recipe.size
        n_cells = k_out * cfg.inner_repeats * (k_out * (k_in - 1) + 1 if like_rows else k_in)
        if n_cells * 2 * size * size * 8 > MAX_BYTES:
            raise ValueError(f"moments of {n_cells} cells and {size} columns are over the bound")
        self.raw_rows = rows.withColumn("design", F.concat("cov", "features") if self.recipe.n_covs else F.col("features"))
        self.centre = [r.m for r in _means(self.raw_rows).collect()]  # a row a column
        self.rows = _less(self.raw_rows, self.centre)
        found: dict[tuple, np.ndarray] = {}
        for r in cells((assign_like_rows if like_rows else assign)(self.rows, cfg)).orderBy("i").collect():  # bounded above
            inner = tuple(map(int, r.inner.split(","))) if like_rows else (r.inner,) * k_out
            found.setdefault((r.fold, r.repeat, inner, r.kind), np.zeros((size, size)))[r.i] = r.g
        self.shared = self.spark.sparkContext.broadcast(found)
        self.reducers: dict[int, object] = {}  # those that moments can't fit
        if cfg.reduction == "ica":
            placed = splits.kfold(self.rows, k_out, cfg.seed).select("fold", F.slice("design", self.recipe.n_covs + 1, len(names)).alias("x"))
            self.reducers = ica.fit(placed, names, self.centre[self.recipe.n_covs :], cfg)
        self._fit()

    def _fit(self) -> None:
        cfg, spark, shared, recipe, known = self.cfg, self.spark, self.shared, self.recipe, self.reducers
        t, k_out, k_in, reps = len(recipe.tasks), int(cfg.outer_folds), int(cfg.inner_folds), cfg.inner_repeats
        tried = fitting.candidates(cfg, cfg.n_candidates or 20, 42)
        spread = 4 * spark.sparkContext.defaultParallelism

        def total(have: dict, kind: int, repeat: int, outer: int, inner: int | None, inside: bool) -> np.ndarray:
            return sum((m for (f, r, j, q), m in have.items() if q == kind and r == repeat and f != outer and (inner is None or (j[outer] == inner) == inside)), np.zeros((recipe.size, recipe.size)))

        def change(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(change=[pickle.dumps(recipe.fit(total(shared.value, 0, 0, k, None, True), known.get(k))) for k in pdf["fold"]])

        folds = spark.createDataFrame([(k,) for k in range(k_out)], "fold long").repartition(max(1, min(k_out, spread)))
        self.changes = save(folds.mapInPandas(change, "fold long, change binary"), "moment-changes")
        table = spark.createDataFrame([(k, i, *(c[p] for p in PARAMS)) for k in range(k_out) for i, c in enumerate(tried)], "fold long, cand_id long, alpha_or_c double, l1_ratio double, penalty_weight double")
        table = table.join(self.changes, "fold").repartition(max(1, min(k_out * len(tried), spread)), "fold", "cand_id")

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            have, sums = shared.value, {}
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    made, params, got = pickle.loads(row.change), {p: getattr(row, p) for p in PARAMS}, []
                    for r in range(reps):
                        for j in range(k_in):
                            key = (row.fold, r, j)
                            if key not in sums:
                                sums[key] = [made.moments(total(have, q, r, row.fold, j, inside)) for q, inside in ((0, False), (1, False), (0, True))]
                            a, aw, v = sums[key]
                            got.append(-np.mean(np.sqrt(squared_errors(v, solve(a, aw, t, made.n_covs, params)) / v[0, 0])))
                    out.append(float(np.mean(got)))
                yield pdf.drop(columns="change").assign(score=out)

        self.scored = save(table.mapInPandas(score, "fold long, cand_id long, alpha_or_c double, l1_ratio double, penalty_weight double, score double"), "moment-search")
        best = self.scored.join(stats.best_candidate(self.scored).select("fold", "cand_id"), ["fold", "cand_id"])
        self.best = save(best, "moment-best")

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            have = shared.value
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    made = pickle.loads(row.change)
                    m = solve(*(made.moments(total(have, q, 0, row.fold, None, True)) for q in (0, 1)), t, made.n_covs, {p: getattr(row, p) for p in PARAMS})
                    (b, b0), taken, back, reduced = made.raw(m), made.taken(), made.features(m), made.reduced(m)
                    for k, name in enumerate(recipe.tasks):
                        yield pd.DataFrame({"fold": [row.fold], "task": [name], "k": [k], "std_coef": [back[k]], "reduced": [reduced[k]], "names": [made.reducer.names], "beta": [b[k]], "beta0": [b0[k]], "taken": [None if taken is None else taken[0][k]], "taken0": [0.0 if taken is None else taken[1][k]], "converged": [m.converged]})

        schema = "fold long, task string, k int, std_coef array<double>, reduced array<double>, names array<string>, beta array<double>, beta0 double, taken array<double>, taken0 double, converged boolean"
        self.models = save(self.best.join(self.changes, "fold").mapInPandas(fit, schema), "moment-models")

    @property
    def params(self) -> DataFrame:
        """``fold, alpha_or_c, l1_ratio, penalty_weight``."""
        return self.best.select("fold", *PARAMS)

    def fold_models(self) -> DataFrame:
        """``fold, alpha_or_c, l1_ratio, penalty_weight, n_covs, converged, model``, a row a fold, saved, as of ``Run.models``; models take columns as they are read."""
        recipe, centre = self.recipe, np.array(self.centre)
        q, covs = recipe.n_covs, 0 if self.cfg.covariate_method == "pre_regress" else recipe.n_covs

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("k")
            of = lambda c: np.stack(pdf[c].to_numpy())
            first, b, at = pdf.iloc[0], of("beta"), slice(q - covs, None)
            nuisance = None
            if first.taken is not None:
                slopes = of("taken")[:, :q]
                nuisance = slopes.T, pdf["taken0"].to_numpy() - slopes @ centre[:q]
            params = {p: float(first[p]) for p in PARAMS}
            model = solvers.Fitted(centre[at], np.ones(b[:, at].shape[1]), b[:, at], pdf["beta0"].to_numpy(), bool(first.converged))
            made = fitting.FoldModel(int(first.fold), params, fitting.reducers.Identity(recipe.names), model, covs, nuisance, of("std_coef"), of("reduced"))
            return pd.DataFrame({"fold": [made.fold], **{p: [x] for p, x in params.items()}, "n_covs": [covs], "converged": [model.converged], "model": [pickle.dumps(made)]})

        schema = "fold long, alpha_or_c double, l1_ratio double, penalty_weight double, n_covs int, converged boolean, model binary"
        return save(self.models.join(self.params, "fold").groupBy("fold").applyInPandas(run, schema), "fold-models")  # a row a task of a fold

    def out_of_fold(self) -> DataFrame:
        """``row_id, fold, task, y_true, y_pred``; of outcomes from which covariates' part was taken, what is left."""
        placed = splits.kfold(self.rows, int(self.cfg.outer_folds), self.cfg.seed)
        dot = lambda b: F.aggregate(F.zip_with("design", b, lambda x, z: x * z), F.lit(0.0), lambda x, z: x + z)
        oof = placed.join(F.broadcast(self.models.withColumnRenamed("fold", "m_fold")), F.col("fold") == F.col("m_fold"))  # folds x tasks rows
        left = F.get("y", F.col("k")) - F.when(F.col("taken").isNull(), 0.0).otherwise(dot("taken") + F.col("taken0"))
        return oof.select("row_id", "fold", "task", left.alias("y_true"), (dot("beta") + F.col("beta0")).alias("y_pred"))

    def coefficients(self, reduced: bool = False) -> DataFrame:
        """``fold, task, feature, coef``: taken back to features, or of reduced features."""
        pairs = F.arrays_zip(F.col("names").alias("f"), F.col("reduced").alias("c")) if reduced else F.arrays_zip(F.array(*[F.lit(n) for n in self.names]).alias("f"), F.col("std_coef").alias("c"))
        return self.models.select("fold", "task", F.explode(pairs).alias("p")).select("fold", "task", F.col("p.f").alias("feature"), F.col("p.c").alias("coef"))

    def loadings(self) -> DataFrame:
        """``fold, cluster, feature, loading`` of every fold's clusters."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for fold, raw in zip(pdf["fold"], pdf["change"], strict=True):
                    yield pd.DataFrame(pickle.loads(raw).reducer.loadings(), columns=["cluster", "feature", "loading"]).assign(fold=fold)

        return self.changes.mapInPandas(run, "fold long, cluster string, feature string, loading double")

    def mixing(self) -> DataFrame:
        """``fold, feature, component, value`` of every fold's mixing matrix (ICA)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for fold, raw in zip(pdf["fold"], pdf["change"], strict=True):
                    yield pd.DataFrame(pickle.loads(raw).reducer.mixing_rows(), columns=["feature", "component", "value"]).assign(fold=fold)

        return self.changes.mapInPandas(run, "fold long, feature string, component string, value double")

    def representative(self, fold: int = 0) -> DataFrame:
        """``row_id, names ARRAY, values ARRAY`` of all rows: covariates of the design, and features as the fold's reducer changes them."""
        recipe, uncentred = self.recipe, self.raw_rows
        made = pickle.loads(self.changes.filter(F.col("fold") == fold).first().change)  # of columns^2 numbers, within the bound above
        means = np.array([r.m for r in _means(uncentred).collect()])  # a row a column
        q = recipe.n_covs
        a = made.reducer.affine()
        kept = {"none": lambda: np.ones(len(a)), "ica": lambda: np.zeros(len(a))}.get(recipe.cfg.reduction, lambda: np.array([float(m is None) for _, m, _, _ in made.reducer.parts]))
        through = kept()
        back = a[:, 1:] @ means[q:] * through  # columns that pass through get their mean again
        covs = list(recipe.cfg.roles.covariates)[: made.n_covs]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["design"].to_numpy())
                    out = np.column_stack([x[:, : made.n_covs], (x[:, q:] - means[q:]) @ a[:, 1:].T + a[:, 0] + back])
                    yield pd.DataFrame({"row_id": pdf["row_id"], "names": [covs + made.reducer.names] * len(pdf), "values": list(out)})

        return uncentred.select("row_id", "design").mapInPandas(run, "row_id string, names array<string>, values array<double>")


def nested_cv(df: DataFrame, cfg: Config, cluster_map: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``row_id, fold, task, y_true, y_pred``; ``fold, task, feature, coef``; and each fold's parameters."""
    found = NestedCV(df, cfg, cluster_map)
    return found.out_of_fold(), found.coefficients(), found.params


def ml_fit(df: DataFrame, cfg: Config, params: dict[str, float]):
    """One fit on all rows by Spark ML, whatever their number; columns ``features`` (a vector), ``label``, ``w``.

    Elastic net: regParam = a rho + a (1 - rho) sd(y), elasticNetParam = a rho / regParam, with the population sd of the
    normal solver.  Logistic: regParam = 1 / (C sum w).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    a, rho = params["alpha_or_c"], params["l1_ratio"]
    n, sw, sd, k = df.agg(F.count("*"), F.sum("w"), F.stddev_pop("label"), F.count_distinct("label")).first()
    if cfg.is_classification:
        return LogisticRegression(regParam=1 / (a * sw), elasticNetParam=rho, standardization=False, family="binomial" if k == 2 else "multinomial", weightCol="w", maxIter=1000, tol=1e-9).fit(df)
    reg = a * rho + a * (1 - rho) * sd
    return LinearRegression(regParam=reg, elasticNetParam=a * rho / reg, standardization=False, solver="normal", weightCol="w", maxIter=1000, tol=1e-10).fit(df)
