"""Knobs of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    keep_top_fraction: float = 0.80
    min_bm25: float = 0.05
    mmr_lambda: float = 0.7
    mmr_top_k: int = 60
    drift_high: float = 0.50
    drift_low: float = 0.05
    keep_calibration: int = 20
    dedup_threshold: float = 0.85
    heatmap_lookback: int = 8
    heatmap_ratio: float = 2.0
    heatmap_min_mentions: int = 2
    emergence_min_score: int = 4
    emergence_top: int = 10
    emergence_min_df: int = 3
    emergence_max_df: float = 0.6
    purge_runs: int = 8
    purge_zeros: int = 8
    purge_cap: int = 5
    promote_count: int = 5
    promote_runs: int = 2
    promote_cap: int = 10
    hot_factor: float = 1.5
    cold_factor: float = 0.5
    hot_percent: int = 10
    cold_zeros: int = 3
    judge_score: int = 4
    judge_confidence: float = 0.5
    judge_cap: int = 50
    batch_size: int = 30
    few_shot: int = 3
    feedback_keep: int = 500
    patent_cap: int = 20
    patent_min_score: int = 3
    patent_ttl_days: int = 60
    profile_step: float = 0.5
    recent_days: int = 90
    seen_max: int = 1_000_000
    archive_cap: int = 5000
    min_score: int = 2


DEFAULT = Config()
