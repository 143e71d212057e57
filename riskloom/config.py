"""Settings of the engine. The thresholds are fixed values of the credit-risk method."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    fill_rate: float = 0.85
    hard_missing: float = 0.98
    near_constant: float = 0.999
    least_variance: float = 1e-8
    least_std: float = 1e-12
    near_unique: float = 0.98
    outcome_score: float = 0.60
    label_quality: float = 0.50
    prevalence: tuple[float, float] = (0.005, 0.30)
    strict_prevalence: tuple[float, float] = (0.005, 0.40)
    event_quantile: float = 0.95
    dedup_jaccard: float = 0.90
    dominance: float = 0.60
    dominance_floor: float = 0.002
    severe_weight: float = 0.50
    correlation: float = 0.95
    correlation_inclusive: float = 0.97
    one_hot_levels: int = 8
    rare_count: int = 50
    bins: int = 10
    ks_points: int = 50
    window_weights: dict[str, float] = field(default_factory=lambda: {"1m": 1.00, "3m": 0.95, "6m": 0.90, "12m": 0.85, "lt": 0.80, "unknown": 0.90})
    risk_quantiles: tuple[float, float] = (0.50, 0.995)
    rarity: tuple[float, float] = (1e-3, 8.0)
    suspicion: dict[str, float] = field(default_factory=lambda: {"auc": 0.90, "mi": 0.20, "iv": 1.5, "ks": 0.70, "jaccard": 0.95, "phi": 0.95})
    exact_match: float = 0.995


DEFAULTS = Settings()
