"""Feature reduction of dense blocks, fitted on training rows: clusters with one principal component each, or ICA."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from plover.functions import solvers


def auto_size(p: int, n: int) -> int:
    return max(3, int(math.ceil(math.log2(p) * (100 / n) ** 0.25)))


@dataclass
class Identity:
    names_in: list[str]

    @property
    def names(self) -> list[str]:
        return self.names_in

    def transform(self, x: np.ndarray) -> np.ndarray:
        return x

    def affine(self) -> np.ndarray:
        return np.eye(len(self.names_in), len(self.names_in) + 1, 1)

    def backproject(self, coef: np.ndarray) -> np.ndarray:
        return coef

    def loadings(self) -> list[tuple[str, str, float]]:
        return []


@dataclass
class ClusterPCA:
    """Groups of columns; several columns give their first component, one column passes through, unscaled."""

    names_in: list[str]
    groups: list[tuple[str, np.ndarray]]
    names: list[str] = field(default_factory=list)
    parts: list[tuple] = field(default_factory=list)

    def fit(self, x: np.ndarray) -> ClusterPCA:
        return self._fit(lambda at: (*solvers.scaler(x[:, at]), solvers.first_component(x[:, at])))

    def fit_correlations(self, mean: np.ndarray, scale: np.ndarray, r: np.ndarray) -> ClusterPCA:
        """The same from means, sds and correlations of all columns."""
        return self._fit(lambda at: (mean[at], scale[at], solvers.leading_axis(r[np.ix_(at, at)])))

    def _fit(self, part) -> ClusterPCA:
        for label, at in self.groups:
            if len(at) == 1:
                self.names.append(self.names_in[at[0]])
                self.parts.append((at, None, None, np.ones(1)))
            elif len(at):
                self.names.append(f"Cluster_{label}")
                self.parts.append((at, *part(at)))
        return self

    def affine(self) -> np.ndarray:
        """(components, 1 + columns): the transformation as a matrix on (1, columns)."""
        out = np.zeros((len(self.parts), 1 + len(self.names_in)))
        for k, (at, m, s, v) in enumerate(self.parts):
            out[k, 1 + at] = v if m is None else v / s
            out[k, 0] = 0.0 if m is None else -(m / s) @ v
        return out

    def transform(self, x: np.ndarray) -> np.ndarray:
        cols = [x[:, at[0]] if m is None else (x[:, at] - m) / s @ v for at, m, s, v in self.parts]
        return np.column_stack(cols) if cols else np.empty((len(x), 0))

    def backproject(self, coef: np.ndarray) -> np.ndarray:
        out = np.zeros((*coef.shape[:-1], len(self.names_in)))
        for k, (at, _, _, v) in enumerate(self.parts):
            out[..., at] += coef[..., k : k + 1] * v
        return out

    def loadings(self) -> list[tuple[str, str, float]]:
        return [(n, self.names_in[j], float(w)) for n, (at, _, _, v) in zip(self.names, self.parts, strict=True) for j, w in zip(at, v, strict=True)]


@dataclass
class ICA:
    names_in: list[str]
    mean: np.ndarray
    scale: np.ndarray
    center: np.ndarray
    unmixing: np.ndarray
    mixing: np.ndarray

    @property
    def names(self) -> list[str]:
        return [f"IC_{k + 1}" for k in range(len(self.unmixing))]

    def transform(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale - self.center) @ self.unmixing.T

    def affine(self) -> np.ndarray:
        a = self.unmixing / self.scale
        return np.column_stack([-(a @ self.mean + self.unmixing @ self.center), a])

    def backproject(self, coef: np.ndarray) -> np.ndarray:
        return coef @ self.mixing.T  # activation pattern

    def loadings(self) -> list[tuple[str, str, float]]:
        return []

    def mixing_rows(self) -> list[tuple[str, str, float]]:
        return [(f, n, float(self.mixing[j, k])) for j, f in enumerate(self.names_in) for k, n in enumerate(self.names)]


def cluster_groups(x: np.ndarray, names: list[str], min_size: int | str, metric: str, signed: bool, noise: str = "pca") -> list[tuple[str, np.ndarray]]:
    """Density clusters of columns; noise is one group named ``Noise``, or each column its own."""
    return grouped(solvers.distance_matrix(x, metric, signed), len(x), names, min_size, noise)


def grouped(distance: np.ndarray, n: int, names: list[str], min_size: int | str, noise: str = "pca") -> list[tuple[str, np.ndarray]]:
    """The groups of :func:`cluster_groups` from distances of columns of ``n`` rows."""
    size = auto_size(len(distance), n) if min_size == "auto" else int(min_size)
    label = solvers.hdbscan(distance, size)
    out = []
    for k in sorted(set(label.tolist())):
        at = np.flatnonzero(label == k)
        if k >= 0:
            out.append((str(k), at))
        elif noise == "pca":
            out.append(("Noise", at))
        else:
            out += [(names[j], np.array([j])) for j in at]
    return out


def mapped_groups(names: list[str], cluster_map: dict[str, str] | None) -> list[tuple[str, np.ndarray]]:
    of = [(cluster_map or {}).get(n) for n in names]
    if None in of:
        raise ValueError(f"feature without a cluster: {names[of.index(None)]}")
    return [(c, np.array([j for j, o in enumerate(of) if o == c])) for c in sorted(set(of))]


def from_correlations(mean: np.ndarray, scale: np.ndarray, r: np.ndarray, n: int, names: list[str], cfg, cluster_map: dict[str, str] | None = None) -> ClusterPCA:
    """The cluster reducer of ``cfg`` from means, sds and Pearson correlations of ``n`` rows."""
    if cfg.reduction == "apriori":
        groups = mapped_groups(names, cluster_map)
    else:
        groups = grouped(solvers.correlation_distance(r, cfg.sign_handling != "unsigned"), n, names, cfg.min_cluster_size, cfg.noise)
    return ClusterPCA(names, groups).fit_correlations(mean, scale, r)


def fit_reducer(x: np.ndarray, names: list[str], cfg, cluster_map: dict[str, str] | None = None):
    """The reducer that ``cfg`` asks for, fitted on ``x``."""
    if cfg.reduction == "none":
        return Identity(names)
    if cfg.reduction == "cluster_pca":
        groups = cluster_groups(x, names, cfg.min_cluster_size, cfg.distance, cfg.sign_handling != "unsigned", cfg.noise)
        return ClusterPCA(names, groups).fit(x)
    if cfg.reduction == "apriori":
        return ClusterPCA(names, mapped_groups(names, cluster_map)).fit(x)
    m, s = solvers.scaler(x)
    k = cfg.ica_components
    if k == "auto":
        k = min(solvers.parallel_analysis(x, level=cfg.ci_level, standardize=cfg.standardize_parallel), *x.shape)
    return ICA(names, m, s, *solvers.fast_ica((x - m) / s, int(k), cfg.ica_max_iter, seed=cfg.ica_seed))
