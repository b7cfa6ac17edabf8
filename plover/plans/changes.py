"""What a training set does to its columns before the penalised model is fitted, from moments alone.

Removing the covariates' part of the outcomes and replacing features by principal components of their clusters are both
affine in the columns (1, covariates, features, outcomes).  A training set's moments hold all that fits them: means, variances and
correlations.  So a change is one matrix M, and moments G of any set of rows become M G M': no second pass over the rows, for a fold, a
drawn sample or a permutation.

Covariates may be collinear or constant: their slopes are those of least norm on standardised covariates.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.config import Config
from plover.functions import reducers, solvers
from plover.operators import ingest

RANK = 1e-10  # eigenvalues of the covariates' correlations below this share of the largest are rounding noise
CONSTANT = 1e-13  # a variance below this share of the squared mean is rounding noise


def served(cfg: Config) -> bool:
    """Whether moments hold all that an analysis needs: no classes, ranks, independent components or single-row folds."""
    if cfg.is_classification or isinstance(cfg.outer_folds, str) or isinstance(cfg.inner_folds, str):
        return False
    return cfg.reduction in ("none", "apriori") or (cfg.reduction == "cluster_pca" and cfg.distance == "pearson")


def standardised(plain: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, sds (ddof 0) and correlations of some columns; a constant one has sd 1 and correlations of zero."""
    n = plain[0, 0]
    m = plain[0, at] / n
    c = plain[at, at] / n - np.outer(m, m)
    v = np.diag(c)
    flat = v <= CONSTANT * m * m
    s = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, v)))
    r = c / np.outer(s, s)
    r[flat], r[:, flat] = 0.0, 0.0
    return m, s, r


def nuisance(plain: np.ndarray, n_covs: int, n_tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Slopes (covariates, tasks) and intercepts of the outcomes on the covariates by least squares."""
    q, y = slice(1, 1 + n_covs), slice(len(plain) - n_tasks, len(plain))
    m, s, r = standardised(plain, q)
    ym = plain[0, y] / plain[0, 0]
    e, v = np.linalg.eigh(r)
    keep = e > RANK * max(e.max(initial=0.0), 1e-300)
    cross = (plain[q, y] / plain[0, 0] - np.outer(m, ym)) / s[:, None]
    cross[np.diag(r) == 0] = 0.0
    slopes = (v[:, keep] / e[keep]) @ (v[:, keep].T @ cross) / s[:, None]
    return slopes, ym - m @ slopes


@dataclass
class Change:
    """``matrix`` takes (1, covariates, features, outcomes) to (1, design, outcomes); None changes nothing."""

    matrix: np.ndarray | None
    reducer: object
    n_covs: int  # covariates that lead the changed design
    n_tasks: int

    def moments(self, g: np.ndarray) -> np.ndarray:
        return g if self.matrix is None else self.matrix @ g @ self.matrix.T

    def raw(self, model: solvers.Fitted) -> tuple[np.ndarray, np.ndarray]:
        """A model's slopes (tasks, unchanged design) and intercepts, or those of a stack of models."""
        b = model.coef / model.scale[..., None, :]
        b0 = model.intercept - (b @ model.mean[..., None])[..., 0]
        if self.matrix is None:
            return b, b0
        whole = b @ self.matrix[1 : 1 + b.shape[-1], : self.matrix.shape[1] - self.n_tasks]
        return whole[..., 1:], b0 + whole[..., 0]

    def taken(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Slopes (tasks, unchanged design) and intercepts of what is taken from the outcomes; None if nothing is."""
        if self.matrix is None:
            return None
        part = -self.matrix[-self.n_tasks :, : self.matrix.shape[1] - self.n_tasks]
        return (part[:, 1:], part[:, 0]) if part.any() else None

    def reduced(self, model: solvers.Fitted) -> np.ndarray:
        return model.coef[..., self.n_covs :]

    def features(self, model: solvers.Fitted) -> np.ndarray:
        """Coefficients of standardised (reduced) features, taken back to features."""
        return self.reducer.backproject(self.reduced(model))


@dataclass(frozen=True)
class Recipe:
    """How to fit a :class:`Change`: the configuration, the features' names, and clusters for the a-priori reduction."""

    cfg: Config
    names: list[str]
    clusters: dict[str, str] | None = None

    @property
    def n_covs(self) -> int:
        return len(self.cfg.roles.covariates) if self.cfg.covariate_method != "none" else 0

    @property
    def tasks(self) -> list[str]:
        return list(self.cfg.roles.outcomes) if len(self.cfg.roles.outcomes) > 1 else ["single"]

    @property
    def size(self) -> int:
        return 1 + self.n_covs + len(self.names) + len(self.tasks)

    def fit(self, plain: np.ndarray, reducer: object | None = None) -> Change:
        """The change that a set of rows asks for, from its unweighted moments; ``reducer`` is one that moments can't fit."""
        cfg, q, p, t = self.cfg, self.n_covs, len(self.names), len(self.tasks)
        removes = cfg.covariate_method == "pre_regress" and q > 0
        stays = 0 if cfg.covariate_method == "pre_regress" else q
        if cfg.reduction == "none" and not removes:
            return Change(None, reducers.Identity(self.names), stays, t)
        if cfg.reduction == "none":
            reducer = reducers.Identity(self.names)
        elif reducer is None:
            reducer = reducers.from_correlations(*standardised(plain, slice(1 + q, 1 + q + p)), int(plain[0, 0]), self.names, cfg, self.clusters)
        a = reducer.affine()
        k = len(a)
        m = np.zeros((1 + stays + k + t, self.size))
        m[0, 0] = 1
        m[1 : 1 + stays, 1 : 1 + stays] = np.eye(stays)
        m[1 + stays : 1 + stays + k, 0] = a[:, 0]
        m[1 + stays : 1 + stays + k, 1 + q : 1 + q + p] = a[:, 1:]
        m[1 + stays + k :, 1 + q + p :] = np.eye(t)
        if removes:
            slopes, intercepts = nuisance(plain, q, t)
            m[1 + stays + k :, 0] = -intercepts
            m[1 + stays + k :, 1 : 1 + q] = -slopes.T
        return Change(m, reducer, stays, t)


def independent(cfg: Config, names: list[str]) -> Recipe:
    """The recipe of an analysis on a given number of independent components, which passes over rows fit (``plover.plans.ica``)."""
    if not isinstance(cfg.ica_components, int) or not served(replace(cfg, reduction="none")):
        raise ValueError("independent components by passes serve regression with k folds and a given number of components")
    return Recipe(cfg, names)


def recipe(df: DataFrame, cfg: Config, names: list[str], cluster_map: DataFrame | None = None) -> Recipe:
    """The recipe of an analysis; the map's rows for its features are checked and collected, a row a feature."""
    if not served(cfg):
        raise ValueError("moments serve regression with k folds, without reductions by ranks or to independent components")
    clusters = None
    if cfg.reduction == "apriori":
        if cluster_map is None:
            raise ValueError("the apriori reduction needs a cluster map")
        mine = df.sparkSession.createDataFrame([(f,) for f in names], "feature string")
        ingest.check_coverage(mine, cluster_map)
        clusters = {r.feature: r.cluster for r in cluster_map.join(F.broadcast(mine), "feature", "left_semi").collect()}
    return Recipe(cfg, names, clusters)
