"""Leave-one-out cross-validation of a regression by downdates: a row's products leave the moments of all rows.

Outer leave-one-out: a row's training set is all rows less itself, and its inner training and validation sets are inner cells less itself, so a
row costs its solves and nothing that grows with the table.  Inner leave-one-out: a row of a fold's training set is predicted, for each
candidate, by the model of that set less the row, which starts from the set's own model.  Rows stay where they are; cells are broadcast, their size checked.

Inner folds are dealt over all rows, so that a training set's differ by a row from those dealt without it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.config import Config
from plover.functions import fitting
from plover.operators import ingest, splits, stats
from plover.plans import changes
from plover.plans.moments import MAX_BYTES, PARAMS, cells, centred, solve, squared_errors
from plover.sources.work import save

NUMBERS = 1 << 15  # of the rows' products that a task holds at once


def _prepared(df: DataFrame, cfg: Config, cluster_map: DataFrame | None) -> tuple[DataFrame, changes.Recipe]:
    rows, names = ingest.role_projection(df, cfg)
    rows = save(rows, "loo-input")  # read some six times
    ingest.check_rows(rows)
    made = changes.recipe(df, replace(cfg, outer_folds=2, inner_folds=2), names, cluster_map)
    return centred(rows.withColumn("design", F.concat("cov", "features") if made.n_covs else F.col("features"))), made


def _collected(assigned: DataFrame, size: int, n_cells: int) -> dict[tuple, np.ndarray]:
    if n_cells * 2 * size * size * 8 > MAX_BYTES:
        raise ValueError(f"moments of {n_cells} cells and {size} columns are over the bound")
    found: dict[tuple, np.ndarray] = {}
    for r in cells(assigned).collect():  # bounded above
        found.setdefault((r.fold, r.repeat, r.inner, r.kind), np.zeros((size, size)))[r.i] = r.g
    return found


def _own(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time, with their design, their outcomes and the products of each."""
    step = max(1, NUMBERS // size**2)
    for pdf in batches:
        for i in range(0, len(pdf), step):
            part = pdf.iloc[i : i + step]
            x, y = (np.stack(part[c].to_numpy()).astype(float) for c in ("design", "y"))
            a = np.column_stack([np.ones(len(part)), x, y])
            yield part, x, y, a[:, :, None] * a[:, None, :]


def outer(df: DataFrame, cfg: Config, cluster_map: DataFrame | None = None) -> DataFrame:
    """``row_id, fold, task, y_true, y_pred, coef ARRAY`` (of the features) and the row's parameters: each row predicted by the model of all others."""
    rows, recipe = _prepared(df, cfg, cluster_map)
    k, reps, ids = int(cfg.inner_folds), cfg.inner_repeats, rows.select("row_id")
    many = ids.select("row_id", F.explode(F.array(*[F.lit(r).cast("bigint") for r in range(reps)])).alias("repeat"))
    dealt = splits.hash_rank(many, F.concat_ws("/", F.lit(str(cfg.seed)), F.col("repeat").cast("string")), by=["repeat"])
    dealt = dealt.select("row_id", F.struct("repeat", splits.ntile_of(F.col("rn"), F.col("n"), k).alias("inner")).alias("p"))
    dealt = dealt.groupBy("row_id").agg(F.map_from_entries(F.collect_list("p")).alias("inner"))  # a repeated id is an error here
    inner = F.array(*[F.col("inner")[r] for r in range(reps)]).alias("inner")
    placed = save(rows.join(dealt, "row_id").join(splits.leave_one_out(ids), "row_id").select("row_id", "fold", "design", "y", "w", inner), "loo-rows")
    assigned = placed.select("design", "y", "w", F.posexplode("inner").alias("repeat", "inner")).withColumn("fold", F.lit(0).cast("bigint"))
    have = df.sparkSession.sparkContext.broadcast(_collected(assigned, recipe.size, k * reps))
    tried, tasks = fitting.candidates(cfg, cfg.n_candidates or 20, 42), recipe.tasks
    t = len(tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = {(r, j, kind): m for (_, r, j, kind), m in have.value.items()}
        whole = {(r, kind): sum(cell.get((r, j, kind), 0) for j in range(k)) for r in range(reps) for kind in (0, 1)}

        def chosen(made: changes.Change, less: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
            """The candidate of each row by its inner scores."""
            score, n = np.zeros((len(tried), len(at))), np.zeros(len(at))
            for r in range(reps):
                for j in range(k):
                    mine = (at[:, r] == j)[:, None, None]
                    held = cell[r, j, 0] - np.where(mine, less[0], 0)
                    use = held[:, 0, 0] > 0.5
                    train = [whole[r, q] - cell.get((r, j, q), 0) - np.where(mine, 0, less[q]) for q in (0, 1)]
                    a, aw, v = (made.moments(m[use]) for m in (*train, held))
                    n += use
                    for i, p in enumerate(tried):
                        score[i, use] -= np.sqrt(squared_errors(v, solve(a, aw, t, made.n_covs, p)) / v[:, 0, :1]).mean(1)
            with np.errstate(invalid="ignore"):
                return np.argmax(score / n, axis=0)

        def predicted(made: changes.Change, part: pd.DataFrame, x: np.ndarray, y: np.ndarray, g: np.ndarray) -> Iterator[pd.DataFrame]:
            less = g, part["w"].to_numpy(dtype=float)[:, None, None] * g
            best = chosen(made, less, np.stack(part["inner"].to_numpy())) if len(tried) > 1 else np.zeros(len(part), dtype=int)
            taken = made.taken()
            left = y if taken is None else y - x @ taken[0].T - taken[1]
            for c in np.unique(best):
                at = best == c
                m = solve(*(made.moments(whole[0, q] - less[q][at]) for q in (0, 1)), t, made.n_covs, tried[c])
                (b, b0), back = made.raw(m), made.features(m)
                y_pred = (b @ x[at][:, :, None])[:, :, 0] + b0
                own = {f: np.repeat(part[f].to_numpy()[at], t) for f in ("row_id", "fold")}
                yield pd.DataFrame({**own, "task": tasks * int(at.sum()), "y_true": left[at].ravel(), "y_pred": y_pred.ravel(), "coef": list(back.reshape(-1, back.shape[-1])), **tried[c]})

        for part, x, y, g in _own(batches, recipe.size):
            made = recipe.fit(whole[0, 0] - g[0])
            if made.matrix is None:  # so is every row's
                yield from predicted(made, part, x, y, g)
            else:
                ones = [(recipe.fit(whole[0, 0] - g[i]), slice(i, i + 1)) for i in range(len(part))]
                yield pd.concat([out for made, i in ones for out in predicted(made, part[i], x[i], y[i], g[i])])

    schema = "row_id string, fold long, task string, y_true double, y_pred double, coef array<double>, alpha_or_c double, l1_ratio double, penalty_weight double"
    return save(placed.mapInPandas(run, schema), "loo-models").select("row_id", "task", "y_true", "y_pred", "coef", *PARAMS, "fold")


def inner(df: DataFrame, cfg: Config, cluster_map: DataFrame | None = None) -> DataFrame:
    """``fold, cand_id, alpha_or_c, l1_ratio, penalty_weight, score`` with ``inner_folds`` of one row each: negative mean squared errors."""
    rows, recipe = _prepared(df, cfg, cluster_map)
    placed = save(splits.kfold(rows, int(cfg.outer_folds), cfg.seed), "loo-rows")
    k, spark, t = int(cfg.outer_folds), df.sparkSession, len(recipe.tasks)
    assigned = placed.withColumn("repeat", F.lit(0).cast("bigint")).withColumn("inner", F.lit(0).cast("bigint"))
    have = spark.sparkContext.broadcast(_collected(assigned, recipe.size, k))
    tried = fitting.candidates(cfg, cfg.n_candidates or 20, 42)

    def fitted(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pairs:
            for f in pdf["fold"]:
                train = [sum(m for (g, _, _, kind), m in have.value.items() if g != f and kind == q) for q in (0, 1)]
                made = recipe.fit(train[0])
                train = [made.moments(m) for m in train]
                yield pd.DataFrame({"fold": [f], "made": [pickle.dumps((made, train, [solve(*train, t, made.n_covs, p).coef for p in tried]))]})

    models = save(spark.createDataFrame([(f,) for f in range(k)], "fold long").repartition(k).mapInPandas(fitted, "fold long, made binary"), "loo-starts")
    starts = spark.sparkContext.broadcast({r.fold: r.made for r in models.collect()})  # a row a fold, of the cells' size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {f: pickle.loads(m) for f, m in starts.value.items()}
        sse, n = np.zeros((k, len(tried))), np.zeros(k)
        for part, _, _, g in _own(batches, recipe.size):
            fold, w = part["fold"].to_numpy(), part["w"].to_numpy(dtype=float)[:, None, None]
            for f, (made, train, start) in known.items():
                mine = fold != f
                own, n[f] = made.moments(g[mine]), n[f] + mine.sum()
                for i, p in enumerate(tried):
                    m = solve(train[0] - own, train[1] - w[mine] * own, t, made.n_covs, p, start[i])
                    sse[f, i] += squared_errors(own, m).mean(1).sum()
        at = np.indices(sse.shape).reshape(2, -1)
        yield pd.DataFrame({"fold": at[0], "cand_id": at[1], "sse": sse.ravel(), "n": n[at[0]]})

    sums = placed.select("fold", "design", "y", "w").mapInPandas(run, "fold long, cand_id long, sse double, n double").groupBy("fold", "cand_id").agg((-F.sum("sse") / F.sum("n")).alias("score"))
    table = spark.createDataFrame([(i, *(p[c] for c in PARAMS)) for i, p in enumerate(tried)], "cand_id long, alpha_or_c double, l1_ratio double, penalty_weight double")
    return sums.join(F.broadcast(table), "cand_id").select("fold", "cand_id", *PARAMS, "score")


def best(scored: DataFrame) -> DataFrame:
    """Each fold's parameters."""
    return scored.join(stats.best_candidate(scored).select("fold", "cand_id"), ["fold", "cand_id"]).select("fold", *PARAMS)
