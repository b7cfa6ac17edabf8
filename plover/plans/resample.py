"""Resampling inference by moments: bootstrap, half samples, and permutations of outcomes or of blocks of columns.

Rows never leave their partitions, and no task holds a sample.  Draws are those of ``plover.operators.splits``, for many seeds at once:

* *bootstrap, half samples*: each row gets the list of seeds that drew it (as often as they did).  A batch's counts (seeds x rows) times its products of columns
  (rows x columns^2) is one matrix product that adds to the moments of every seed; a partition sends each seed's sums once.
* *permuted outcomes*: each row gets the outcome that every seed gives it.  Only products with the outcome change, so the cells' products of columns are summed once, and each
  cell adds columns x seeds numbers.
* *permuted blocks*: each row gets a block's columns as every seed gives them; products within the rest of the columns are summed once, and only those with the block again.

Seeds go in groups whose sums stay within ``MAX_BYTES``.  Models are then solved by tasks over seeds and folds, from sums alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.config import LOG, Config
from plover.functions import fitting
from plover.operators import ingest, splits, stats
from plover.plans import changes, moments
from plover.sources.work import save

MAX_BYTES = 128_000_000
PARAMS = ("alpha_or_c", "l1_ratio", "penalty_weight")


class Table:
    """Complete rows ``row_id, design, y, w`` of a regression, saved, and what their columns are."""

    def __init__(self, df: DataFrame, cfg: Config, cluster_map: DataFrame | None = None) -> None:
        rows, self.names = ingest.role_projection(df, cfg)
        self.n, _ = ingest.check_rows(rows)
        self.recipe = changes.recipe(df, cfg, self.names, cluster_map)
        self.cov = list(cfg.roles.covariates) if cfg.covariate_method != "none" else []
        self.tasks, self.size = self.recipe.tasks, self.recipe.size
        self.cfg, self.spark = cfg, df.sparkSession
        design = F.concat("cov", "features") if self.cov else F.col("features")
        self.rows = save(rows.select("row_id", design.alias("design"), "y", "w"), "resample-rows")

    def groups(self, seeds: list[int], numbers: int) -> list[list[tuple[int, int]]]:
        """Numbered seeds in groups, each with ``numbers`` sums a seed within the bound."""
        if numbers * 8 > MAX_BYTES:
            raise ValueError(f"the sums of one seed have {numbers} numbers, over the bound")
        k = max(1, MAX_BYTES // (numbers * 8))
        return [list(enumerate(seeds))[i : i + k] for i in range(0, len(seeds), k)]


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    """(1, design, outcomes) of a batch."""
    return np.column_stack([np.ones(len(pdf)), np.stack(pdf["design"].to_numpy()).astype(float), np.stack(pdf["y"].to_numpy()).astype(float)])


def _added(parts: DataFrame, by: list[str], schema: str) -> DataFrame:
    """Sums of the arrays ``g`` by key; a group has a row from each task at most."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in by}, "g": [np.stack(pdf["g"].to_numpy()).sum(0)]})

    return parts.groupBy(*by).applyInPandas(add, schema)


# --- samples --------------------------------------------------------------------------------------------------------


def sample_moments(t: Table, drawn: DataFrame, seeds: list[tuple[int, int]]) -> DataFrame:
    """``i, g``: of each numbered seed, the upper triangles of the plain and the weighted moments, end to end.

    drawn: ``row_id, seeds ARRAY`` with a seed's number as often as it drew the row.
    """
    size, first, many = t.size, seeds[0][0], len(seeds)
    up = np.triu_indices(size)
    weighted = bool(t.cfg.roles.weight)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for whole in batches:
            for at in range(0, len(whole), 1024):
                pdf = whole.iloc[at : at + 1024]
                a = _matrix(pdf)
                z = a[:, up[0]] * a[:, up[1]]
                n = np.array([len(s) for s in pdf["seeds"]])
                counts = np.zeros((len(pdf), many))
                np.add.at(counts, (np.repeat(np.arange(len(pdf)), n), np.concatenate(pdf["seeds"].to_numpy()).astype(int) - first), 1.0)
                got = counts.T @ z
                if weighted:
                    got = np.hstack([got, counts.T @ (z * pdf["w"].to_numpy(dtype=float)[:, None])])
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"i": np.arange(many) + first, "g": list(total)})

    joined = t.rows.join(drawn, "row_id").select("design", "y", "w", "seeds")
    return _added(joined.mapInPandas(run, "i long, g array<double>"), ["i"], "i long, g array<double>")


def _square(g: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    up = np.triu_indices(size)
    out[up] = g
    return out + np.triu(out, 1).T


def _refit(t: Table, params: DataFrame, n: int, seed: int, draw, indicator: bool) -> DataFrame:
    """Folds x iterations: the fold's parameters on a drawn sample of all rows."""
    fixed = {r.fold: {p: r[p] for p in PARAMS} for r in params.collect()}  # a row a fold
    stream = splits.seed_stream(n * len(fixed), seed)
    size, tasks, recipe, names = t.size, t.tasks, t.recipe, t.names
    triangle = size * (size + 1) // 2

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, g in zip(pdf["i"], pdf["g"], strict=True):
            fold, it = int(i) // n, int(i) % n
            plain = _square(np.asarray(g)[:triangle], size)
            weighted = _square(np.asarray(g)[triangle:], size) if len(g) > triangle else plain
            try:
                made = recipe.fit(plain)
                m = moments.solve(made.moments(plain), made.moments(weighted), len(tasks), made.n_covs, fixed[fold])
                coef = made.features(m)
                if not np.isfinite(coef).all():
                    raise ValueError("a sample without spread")
            except (ValueError, np.linalg.LinAlgError, ZeroDivisionError) as e:
                LOG.info("iteration %s of fold %s failed: %s", it, fold, e)
                out.append(pd.DataFrame({"fold": [fold], "iter": [it], "task": [None], "feature": [None], "coef": [None], "converged": [False], "ok": [False]}))
                continue
            for k, name in enumerate(tasks):
                out.append(pd.DataFrame({"fold": fold, "iter": it, "task": name, "feature": names, "coef": (coef[k] != 0).astype(float) if indicator else coef[k], "converged": m.converged, "ok": True}))
        return pd.concat(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield solve(pdf)

    made = []
    for group in t.groups(stream, 2 * triangle):
        sums = save(sample_moments(t, draw(t.rows, group), group), "resample-moments")
        made.append(save(sums.repartition(max(1, min(len(group), 4 * t.spark.sparkContext.defaultParallelism))).mapInPandas(run, "fold long, iter long, task string, feature string, coef double, converged boolean, ok boolean"), "resampled"))
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out


def bootstrap(t: Table, params: DataFrame, n: int | None = None) -> DataFrame:
    """``fold, iter, task, feature, coef, converged, ok`` of bootstrap samples, drawn by weight if there are weights."""
    w = "w" if t.cfg.roles.weight else None
    out = _refit(t, params, n or t.cfg.fold_bootstraps, 42, lambda rows, seeds: splits.bootstrap_counts(rows, seeds, w), False)
    level = stats.failure_rate(out.select("fold", "iter", "ok").distinct()).first()
    if level.level == "error":
        raise RuntimeError(f"{level.failed} of {level.n} bootstrap iterations failed")
    if level.level == "warning":
        LOG.warning("%d of %d bootstrap iterations failed", level.failed, level.n)
    slow = stats.convergence(out.filter("ok")).first()[0]
    if slow:
        LOG.info("%d bootstrap coefficients of models that did not converge", slow)
    return out


def selection(t: Table, params: DataFrame, n: int | None = None) -> DataFrame:
    """``fold, iter, task, feature, selected``: whether a feature's coefficient is not zero in half samples."""
    out = _refit(t, params, n or t.cfg.fold_bootstraps, 43, splits.half_members, True)
    return out.filter("ok").select("fold", "iter", "task", "feature", F.col("coef").cast("int").alias("selected"))


def feature_scale(t: Table) -> DataFrame:
    """``feature, scale``: the sd (ddof 1) over all rows with ``incorporate`` or a reduction, else fold 0's training sd (ddof 0)."""
    every = t.cfg.covariate_method == "incorporate" or t.cfg.reduction != "none"
    known = t.spark.createDataFrame(list(enumerate(t.names)), "k int, feature string")  # a row a feature
    rows = t.rows if every else splits.kfold(t.rows, int(t.cfg.outer_folds), t.cfg.seed).filter("fold <> 0")
    sd = F.stddev_samp("value") if every else F.stddev_pop("value")
    long = rows.select(F.posexplode(F.slice("design", len(t.cov) + 1, len(t.names))).alias("k", "value"))
    return long.groupBy("k").agg(sd.alias("scale")).join(F.broadcast(known), "k").select("feature", "scale")


# --- permutations -----------------------------------------------------------------------------------------------------


def _cells(t: Table, assigned: DataFrame) -> dict[tuple[int, int, int, int], np.ndarray]:
    """Moments of every cell, checked against the bound of ``moments``."""
    cfg = t.cfg
    n_cells = int(cfg.outer_folds) * cfg.inner_repeats * int(cfg.inner_folds)
    if n_cells * 2 * t.size**2 * 8 > moments.MAX_BYTES:
        raise ValueError(f"moments of {n_cells} cells and {t.size} columns are over the bound")
    found: dict[tuple[int, int, int, int], np.ndarray] = {}
    for r in moments.cells(assigned).orderBy("i").collect():
        found.setdefault((r.fold, r.repeat, r.inner, r.kind), np.zeros((t.size, t.size)))[r.i] = r.g
    return found


def score_cells(cells: dict[tuple[int, int, int, int], np.ndarray], recipe: changes.Recipe, seed: int, weighted: bool) -> float:
    """R2 (mean over tasks) of a whole nested cross-validation from its cells, its search seeded with ``seed``."""
    kind, cfg, n_tasks = 1 if weighted else 0, recipe.cfg, len(recipe.tasks)
    add = lambda q, keep: sum(m for (f, r, j, k), m in cells.items() if k == q and keep(f, r, j))
    tried = fitting.candidates(cfg, cfg.n_candidates or 20, seed)
    sse = n = total = squares = 0
    for k in range(int(cfg.outer_folds)):
        train = lambda f, r, j: f != k and r == 0  # noqa: B023,E731
        made, sets = recipe.fit(add(0, train)), []
        for r in range(cfg.inner_repeats):
            for j in range(int(cfg.inner_folds)):
                inner = lambda f, q, i, r=r, j=j: f != k and q == r and i != j  # noqa: B023,E731
                sets.append([made.moments(g) for g in (add(0, inner), add(kind, inner), add(0, lambda f, q, i, r=r, j=j: f != k and q == r and i == j))])  # noqa: B023
        score = [np.mean([-np.mean(np.sqrt(moments.squared_errors(v, moments.solve(a, b, n_tasks, made.n_covs, p)) / v[0, 0])) for a, b, v in sets]) for p in tried]
        model = moments.solve(made.moments(add(0, train)), made.moments(add(kind, train)), n_tasks, made.n_covs, tried[int(np.argmax(score))])
        own = made.moments(add(0, lambda f, r, j: f == k and r == 0))  # noqa: B023
        y = np.arange(len(own) - n_tasks, len(own))
        sse, n, total, squares = sse + moments.squared_errors(own, model), n + own[0, 0], total + own[0, y], squares + own[y, y]
    sst = squares - total**2 / n
    with np.errstate(all="ignore"):
        return float(np.mean(1 - sse / sst))


def _moved(t: Table, columns: dict[str, list[int] | None], seeds: list[int]) -> DataFrame:
    """``block, seed, score``: for each block of features (None: the outcomes), every seed's score with those columns permuted jointly."""
    cfg, size, n_tasks, n_covs, recipe = t.cfg, t.size, len(t.tasks), len(t.cov), t.recipe
    assigned = save(moments.assign(t.rows, cfg), "resample-assigned")
    shared = t.spark.sparkContext.broadcast(_cells(t, assigned))
    n_cells = len({k[:3] for k in shared.value})

    def group_scores(block: str, at: list[int] | None, where: np.ndarray, group: list[tuple[int, int]]) -> DataFrame:
        rest, width, many = np.setdiff1d(np.arange(size), where), len(where), len(group)
        moving = F.col("y") if at is None else F.transform(F.array(*[F.lit(n_covs + c) for c in at]), lambda i: F.get("design", i))
        values = splits.permuted_values(t.rows.select("row_id", moving.alias("v")), "v", group)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple, np.ndarray] = {}
            for whole in batches:
                for key, pdf in whole.groupby(["fold", "repeat", "inner"]):
                    a = _matrix(pdf)[:, rest]
                    v = np.stack([np.stack(x) for x in pdf["given"]]).astype(float)  # rows x seeds x columns
                    for kind, q in ((0, np.ones(len(a))), (1, pdf["w"].to_numpy(dtype=float))):
                        cross = (a * q[:, None]).T @ v.reshape(len(a), -1)
                        own = np.einsum("nsi,nsj->sij", v * q[:, None, None], v, optimize=True)
                        got = np.concatenate([cross.reshape(len(rest), many, width).transpose(1, 0, 2).reshape(many, -1), own.reshape(many, -1)], axis=1)
                        total[(*key, kind)] = got if (*key, kind) not in total else total[(*key, kind)] + got
            for (f, r, j, kind), got in total.items():
                yield pd.DataFrame({"fold": f, "repeat": r, "inner": j, "kind": kind, "s": np.arange(many), "g": list(got)})

        cell = "fold long, repeat long, inner long, kind long, s long, g array<double>"
        joined = assigned.join(values, "row_id").select("fold", "repeat", "inner", "design", "y", "w", "given")
        sums = _added(joined.mapInPandas(run, cell), ["fold", "repeat", "inner", "kind", "s"], cell)

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            cells = {k: m.copy() for k, m in shared.value.items()}
            for m in cells.values():
                m[where] = m[:, where] = 0
            for r in pdf.itertuples(index=False):
                m, g = cells[r.fold, r.repeat, r.inner, r.kind], np.asarray(r.g)
                cross = g[: len(rest) * width].reshape(len(rest), width)
                m[np.ix_(rest, where)], m[np.ix_(where, rest)] = cross, cross.T
                m[np.ix_(where, where)] = g[len(rest) * width :].reshape(width, width)
            seed = group[int(pdf["s"].iloc[0])][1]
            return pd.DataFrame({"block": [block], "seed": [seed], "score": [score_cells(cells, recipe, seed, cfg.weighted_null)]})

        return save(sums.groupBy("s").applyInPandas(score, "block string, seed long, score double"), "null-scores")

    made = []
    for block, at in columns.items():
        where = np.arange(size - n_tasks, size) if at is None else 1 + n_covs + np.array(at)
        made += [group_scores(block, at, where, g) for g in t.groups(seeds, 2 * n_cells * len(where) * (size + len(where)))]
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out


def null_scores(t: Table, n: int | None = None, seeds: list[int] | None = None) -> DataFrame:
    """``seed, score`` of nested cross-validations with permuted outcomes (tasks move together); of ``seeds``, else of the stream's first ``n``."""
    return _moved(t, {"": None}, splits.seed_stream(t.cfg.n_permutations if n is None else n, 42) if seeds is None else seeds).select("seed", "score")


def block_null_scores(t: Table, n: int | None = None) -> DataFrame:
    """``block, seed, score`` with the rows of a block's columns permuted jointly; all blocks share their seeds."""
    at = {k: [t.names.index(f) for f in ingest.block_columns(t.names, v)] for k, v in t.cfg.blocks.items()}
    return _moved(t, {k: v for k, v in at.items() if v}, splits.seed_stream(t.cfg.n_block_permutations if n is None else n, 42))


def linear_predictor(t: Table, params: DataFrame, fold: int = 0) -> DataFrame:
    """``row_id, task, y, linear``: a fold's model on every row."""
    cells = _cells(t, moments.assign(t.rows, t.cfg))
    train = [sum(m for (f, r, _, k), m in cells.items() if k == kind and r == 0 and f != fold) for kind in (0, 1)]
    made = t.recipe.fit(train[0])
    m = moments.solve(*map(made.moments, train), len(t.tasks), made.n_covs, params.filter(F.col("fold") == fold).select(*PARAMS).first().asDict())
    beta, beta0 = made.raw(m)
    rows = [(k, name, beta[k].tolist(), float(beta0[k])) for k, name in enumerate(t.tasks)]
    models = t.spark.createDataFrame(rows, "k int, task string, beta array<double>, beta0 double")  # a row a task
    dot = F.aggregate(F.zip_with("design", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return t.rows.join(F.broadcast(models), how="cross").select("row_id", "task", F.get("y", F.col("k")).alias("y"), (dot + F.col("beta0")).alias("linear"))


def observed_score(t: Table) -> float:
    """The same score with nothing permuted, its search seeded as the main analysis is."""
    return score_cells(_cells(t, moments.assign(t.rows, t.cfg)), t.recipe, 42, bool(t.cfg.roles.weight))
