"""Configuration of an analysis: frozen, validated, with the documented defaults."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, fields
from typing import Any

LOG = logging.getLogger("plover")

REDUCTIONS = ("none", "cluster_pca", "apriori", "ica")
COVARIATE_METHODS = ("none", "incorporate", "pre_regress")
DISTANCES = ("pearson", "spearman")
MIN_BOOTSTRAPS = 50


@dataclass(frozen=True)
class Roles:
    """Which column plays which role."""

    row_id: str
    outcome: str | tuple[str, ...]
    feature_substring: str
    covariates: tuple[str, ...] = ()
    weight: str | None = None

    @property
    def outcomes(self) -> tuple[str, ...]:
        return (self.outcome,) if isinstance(self.outcome, str) else tuple(self.outcome)


@dataclass(frozen=True)
class Bounds:
    l1: tuple[float, float]
    alpha: tuple[float, float]
    penalty_weight: tuple[float, float] = (1e-3, 1.0)


@dataclass(frozen=True)
class Config:
    roles: Roles
    analysis_type: str = "regression"
    analysis_mode: str = "correlate"
    covariate_method: str = "none"
    reduction: str = "none"
    data_file: str | None = None
    output_dir: str | None = None
    cluster_map_file: str | None = None
    min_cluster_size: int | str = "auto"
    distance: str = "spearman"
    sign_handling: str = "unsigned"
    noise: str = "pca"
    ica_components: int | str = "auto"
    ica_max_iter: int = 1000
    ica_seed: int = 42
    standardize_parallel: bool = False
    model_params: dict[str, float] = field(default_factory=dict)
    outer_folds: int | str = 10
    inner_folds: int | str = 3
    inner_repeats: int = 1
    n_candidates: int | None = None
    seed: int = 42
    n_permutations: int = 10_000
    n_bootstraps: int = 500
    n_block_permutations: int = 500
    ci_level: float = 0.95
    save_distributions: bool = True
    weighted_null: bool = False
    blocks: dict[str, str | list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.analysis_type not in ("regression", "classification"):
            raise ValueError(f"unknown analysis type: {self.analysis_type}")
        if self.reduction not in REDUCTIONS:
            raise ValueError(f"unknown feature reduction method: {self.reduction}")
        if self.covariate_method not in COVARIATE_METHODS:
            raise ValueError(f"unknown covariate method: {self.covariate_method}")
        if self.distance not in DISTANCES:
            raise ValueError(f"unknown distance metric: {self.distance}")
        if not 0 < self.ci_level < 1:
            raise ValueError("ci_level lies between 0 and 1")
        lo, hi = self.bounds.l1
        if not 0 < lo < hi <= 1:
            raise ValueError("bounds of the L1 ratio: 0 < min < max <= 1")

    @property
    def bounds(self) -> Bounds:
        """Bounds of the search, by mode; any mode but ``predict`` behaves as ``correlate``."""
        mode = "predict" if self.analysis_mode == "predict" else "correlate"
        l1 = (0.01, 0.99) if mode == "predict" else (0.001, 0.2)
        p = self.model_params
        return Bounds(
            (p.get(f"l1_min_{mode}", l1[0]), p.get(f"l1_max_{mode}", l1[1])),
            (p.get(f"alpha_min_{mode}", 0.001), p.get(f"alpha_max_{mode}", 100.0)),
            (p.get("covariate_penalty_weight_min", 0.001), p.get("covariate_penalty_weight_max", 1.0)),
        )

    @property
    def is_classification(self) -> bool:
        return self.analysis_type == "classification"

    @property
    def metric(self) -> str:
        return "roc_auc" if self.is_classification else "r2"

    @property
    def fold_bootstraps(self) -> int:
        return max(self.n_bootstraps, MIN_BOOTSTRAPS)

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Config:
        """From the nested mapping of a YAML file; unknown keys are ignored, null ones take the default."""
        part = lambda k: raw.get(k) or {}
        paths, cols, clus, ica, model, cv, stats = map(part, ("paths", "data_cols", "clustering_params", "ica_params", "model_params", "cv_params", "stats_params"))
        if cv.get("n_random_search_iter") is None:
            raise ValueError("cv_params.n_random_search_iter is required")
        outcome = cols["post_score_col"]
        roles = Roles(cols["subject_id_col"], tuple(outcome) if isinstance(outcome, list) else outcome, cols["brain_feature_substr"], tuple(cols.get("covariate_cols") or ()), cols.get("sample_weight_col"))
        boots = stats.get("n_fold_bootstraps")
        if boots is None and stats.get("n_bootstraps") is not None:
            LOG.warning("n_bootstraps is deprecated: use n_fold_bootstraps")
            boots = stats["n_bootstraps"]
        given = {
            "analysis_type": raw.get("analysis_type"), "analysis_mode": raw.get("analysis_mode"), "covariate_method": raw.get("covariate_method"), "reduction": raw.get("feature_reduction_method"),
            "data_file": paths.get("data_file"), "output_dir": paths.get("output_dir"), "cluster_map_file": paths.get("apriori_clustering_file"),
            "min_cluster_size": clus.get("min_cluster_size"), "distance": clus.get("distance_metric"), "sign_handling": clus.get("sign_handling"),
            "ica_components": ica.get("n_components"), "ica_max_iter": ica.get("max_iter"), "ica_seed": ica.get("random_state"),
            "model_params": {k: v for k, v in model.items() if isinstance(v, (int, float))}, "outer_folds": cv.get("n_outer_folds"), "inner_folds": cv.get("n_inner_folds"), "inner_repeats": cv.get("n_inner_repeats"),
            "n_candidates": cv.get("n_random_search_iter"), "seed": cv.get("random_state"), "n_permutations": stats.get("n_permutations"), "n_bootstraps": boots,
            "n_block_permutations": stats.get("n_block_permutations"), "ci_level": stats.get("ci_level"), "save_distributions": stats.get("save_distributions"), "blocks": raw.get("block_permutation_tests"),
        }
        known = {f.name for f in fields(cls)}
        return cls(roles=roles, **{k: v for k, v in given.items() if v is not None and k in known})


def load_config(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return Config.from_dict(yaml.safe_load(f))
