"""Folds, search and models on dense blocks: what a task of the engine runs.  NumPy only."""

from __future__ import annotations

import hashlib
import warnings
from dataclasses import dataclass, field, replace

import numpy as np

from plover.functions import reducers, solvers


@dataclass
class Block:
    """Complete rows in dense form.  ``y``: (N, T) numbers, or (N,) class numbers of ``classes``."""

    ids: list[str]
    x: np.ndarray
    cov: np.ndarray
    y: np.ndarray
    w: np.ndarray | None
    names: list[str]
    cov_names: list[str]
    outcomes: list[str]
    classes: list = field(default_factory=list)
    cluster_map: dict[str, str] | None = None

    def take(self, at: np.ndarray) -> Block:
        return replace(self, ids=[self.ids[i] for i in at], x=self.x[at], cov=self.cov[at], y=self.y[at], w=None if self.w is None else self.w[at])

    @property
    def tasks(self) -> list[str]:
        """Labels of the rows of a coefficient matrix."""
        if self.classes:
            return [str(c) for c in self.classes] if len(self.classes) > 2 else ["single"]
        return list(self.outcomes) if len(self.outcomes) > 1 else ["single"]


def order(ids: list[str], seed) -> np.ndarray:
    return np.array(sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"{seed}|{ids[i]}".encode()).hexdigest(), ids[i])), dtype=int)


def folds(ids: list[str], y: np.ndarray | None, k: int | str, seed) -> np.ndarray:
    """Fold numbers: k-fold, stratified where ``y`` holds classes, or leave-one-out."""
    n, at = len(ids), order(ids, seed)
    if isinstance(k, str) and k.lower() == "loo":
        out = np.empty(n, dtype=int)
        out[at] = np.arange(n)
        return out
    if y is not None:
        at = at[np.argsort(y[at], kind="stable")]
        out = np.empty(n, dtype=int)
        out[at] = np.arange(n) % int(k)
        return out
    out = np.empty(n, dtype=int)
    for j, part in enumerate(np.array_split(at, int(k))):
        out[part] = j
    return out


def candidates(cfg, n: int, seed: int) -> list[dict[str, float]]:
    """``n`` draws of the search space."""
    rng, b = np.random.RandomState(seed), cfg.bounds
    lo, hi = b.alpha
    if cfg.is_classification:
        lo, hi = 1 / hi, 1 / lo
    log = lambda a, z: float(np.exp(rng.uniform(np.log(a), np.log(z))))
    return [{"alpha_or_c": log(lo, hi), "l1_ratio": float(rng.uniform(*b.l1)), "penalty_weight": log(*b.penalty_weight) if cfg.covariate_method == "incorporate" else 1.0} for _ in range(n)]


def design(cfg, cov: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, int]:
    """The design matrix and the number of its leading covariates."""
    if cfg.covariate_method == "incorporate" and cov.shape[1]:
        return np.column_stack([cov, x]), cov.shape[1]
    return x, 0


def fit_model(cfg, d: np.ndarray, n_covs: int, y: np.ndarray, k: int, params: dict[str, float], w: np.ndarray | None) -> solvers.Fitted:
    """Scaler, covariate scaler, penalised model."""
    m, s = solvers.scaler(d)
    s = s.copy()
    s[:n_covs] *= params["penalty_weight"]
    z = (d - m) / s
    if cfg.is_classification:
        if len(np.unique(y)) < 2:
            raise ValueError("a training set of one class")
        b, b0, ok = solvers.logistic_enet(z, y, k, params["alpha_or_c"], params["l1_ratio"], w)
        return solvers.Fitted(m, s, b, b0, ok)
    q = np.ones(len(z)) / len(z) if w is None else w / w.sum()
    zm, ym = q @ z, q @ y
    zc, yc = z - zm, y - ym
    g, c = zc.T @ (zc * q[:, None]), zc.T @ (yc * q[:, None])
    b, ok = solvers.enet_gram(g, c[:, 0] if y.shape[1] == 1 else c, params["alpha_or_c"], params["l1_ratio"])
    b = b[:, None] if b.ndim == 1 else b
    return solvers.Fitted(m, s, b.T, ym - zm @ b, ok)


def probabilities(linear: np.ndarray) -> np.ndarray:
    if linear.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(linear, -500, 500)))
        return np.column_stack([1 - p, p])
    return solvers.softmax(linear)


def inner_score(cfg, model: solvers.Fitted, d: np.ndarray, y: np.ndarray, loo: bool) -> float:
    """Negative RMSE (mean squared error for leave-one-out), or negative log-loss."""
    z = model.linear(d)
    if cfg.is_classification:
        p = np.clip(probabilities(z)[np.arange(len(y)), y], 1e-15, 1 - 1e-15)
        return float(np.mean(np.log(p)))
    e = ((y - z) ** 2).mean(0)
    return -float(np.mean(e if loo else np.sqrt(e)))


def search_scores(cfg, tr: Block, d: np.ndarray, n_covs: int, y: np.ndarray, tried: list[dict[str, float]]) -> list[float]:
    """Mean inner score of each candidate, all splits counting the same."""
    k = len(tr.classes)
    loo = isinstance(cfg.inner_folds, str)
    splits = [folds(tr.ids, tr.y if cfg.is_classification else None, cfg.inner_folds, f"{cfg.seed}/{r}") for r in range(1 if loo else cfg.inner_repeats)]
    out = []
    for params in tried:
        got = []
        for f in splits:
            for j in np.unique(f):
                a, b = np.flatnonzero(f != j), np.flatnonzero(f == j)
                try:
                    model = fit_model(cfg, d[a], n_covs, y[a], k, params, None if tr.w is None else tr.w[a])
                    got.append(inner_score(cfg, model, d[b], y[b], loo))
                except (ValueError, np.linalg.LinAlgError):
                    got.append(-np.inf)
        out.append(float(np.mean(got)))
    return out


@dataclass
class FoldModel:
    """A fold's reducer and model, and what is needed to predict and to report."""

    fold: int
    params: dict[str, float]
    reducer: object
    model: solvers.Fitted
    n_covs: int
    nuisance: tuple | None
    coef: np.ndarray  # (tasks, features), on standardised reduced features, taken back
    reduced: np.ndarray

    def linear(self, cfg, x: np.ndarray, cov: np.ndarray) -> np.ndarray:
        return self.model.linear(design(cfg, cov, self.reducer.transform(x))[0])


def residualise(cfg, tr: Block, *blocks: Block) -> tuple[list[np.ndarray], tuple | None]:
    """Outcomes less what the training rows' covariates predict (for ``pre_regress`` regression)."""
    if cfg.covariate_method != "pre_regress" or cfg.is_classification or not tr.cov.shape[1]:
        return [b.y for b in (tr, *blocks)], None
    fit = solvers.ols(tr.cov, tr.y)
    return [b.y - b.cov @ fit[0] - fit[1] for b in (tr, *blocks)], fit


def fit_fold(cfg, tr: Block, fold: int, params: dict[str, float] | None, seed: int = 42, weighted: bool = True) -> FoldModel:
    """Reducer, nuisance model and penalised model of a training set; searches for parameters if none are given."""
    reducer = reducers.fit_reducer(tr.x, tr.names, cfg, tr.cluster_map)
    (y,), nuisance = residualise(cfg, tr)
    d, n_covs = design(cfg, tr.cov, reducer.transform(tr.x))
    tr = tr if weighted else replace(tr, w=None)
    if params is None:
        tried = candidates(cfg, cfg.n_candidates or 20, seed)
        scores = search_scores(cfg, tr, d, n_covs, y, tried)
        params = tried[int(np.argmax(scores))]
    model = fit_model(cfg, d, n_covs, y, len(tr.classes), params, tr.w)
    reduced = model.coef[:, n_covs:]
    return FoldModel(fold, params, reducer, model, n_covs, nuisance, reducer.backproject(reduced), reduced)


def predict_fold(cfg, model: FoldModel, te: Block) -> tuple[np.ndarray, np.ndarray]:
    """Outcomes as scored (residuals where they were taken), and predictions: numbers, or class probabilities."""
    z = model.linear(cfg, te.x, te.cov)
    y = te.y if model.nuisance is None else te.y - te.cov @ model.nuisance[0] - model.nuisance[1]
    return y, probabilities(z) if cfg.is_classification else z


def auc(pos: np.ndarray, score: np.ndarray) -> float:
    n1, n0 = int(pos.sum()), int((~pos).sum())
    if not n1 or not n0:
        return float("nan")
    return float((solvers.rank_average(score)[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def pooled_score(cfg, y: np.ndarray, p: np.ndarray, k: int) -> float:
    """R2 about the pooled mean (mean over tasks), or ROC AUC (mean over classes, one against the rest)."""
    if cfg.is_classification:
        return auc(y == 1, p[:, 1]) if k == 2 else float(np.nanmean([auc(y == c, p[:, c]) for c in range(k)]))
    sst = ((y - y.mean(0)) ** 2).sum(0)
    with np.errstate(all="ignore"):
        return float(np.mean(1 - ((y - p) ** 2).sum(0) / sst))


def cv_score(cfg, b: Block, seed: int, weighted: bool = False) -> float:
    """The pooled score of a whole nested cross-validation, its search seeded with ``seed``."""
    f = folds(b.ids, b.y if cfg.is_classification else None, cfg.outer_folds, cfg.seed)
    ys, ps = [], []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for k in np.unique(f):
            model = fit_fold(cfg, b.take(np.flatnonzero(f != k)), int(k), None, seed, weighted)
            y, p = predict_fold(cfg, model, b.take(np.flatnonzero(f == k)))
            ys.append(y)
            ps.append(p)
    return pooled_score(cfg, np.concatenate(ys), np.concatenate(ps), len(b.classes))
