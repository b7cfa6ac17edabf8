"""Scoring of a stream of rows by an ensemble of fold models."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plover.config import Config
from plover.plans.runs import predict_ensemble


def score_stream(rows: DataFrame, models: DataFrame, cfg: Config) -> DataFrame:
    """Predictions for a streaming frame ``row_id, features, cov``; stateless, so it needs no watermark."""
    if not rows.isStreaming:
        raise ValueError("a streaming frame is asked for")
    return predict_ensemble(models, rows, cfg)
