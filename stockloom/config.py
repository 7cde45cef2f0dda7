"""Default thresholds. Each dataclass is passed to operators as plain literals."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class AnalyzerConfig:
    low_stock_buffer_percent: float = 0
    stockout_risk_days: float = 7
    overstock_days: float = 45
    overstock_threshold_multiplier: float = 3
    dead_stock_recent_days: int = 30
    dead_stock_max_recent_quantity: float = 0
    high_demand_percentile: float = 0.75
    slow_moving_percentile: float = 0.25
    shelf_life_clearance_multiplier: float = 1.0


@dataclass(frozen=True)
class RecommendationConfig:
    reorder_cover_days: float = 7
    stockout_high_priority_days: float = 3
    stockout_medium_priority_days: float = 7
    transfer_source_buffer_multiplier: float = 1.5
    discount_days_of_stock: float = 45
    clearance_shelf_life_multiplier: float = 1.0
    supplier_reliability_threshold: float = 0.90
    supplier_delivery_days_threshold: float = 4


def overlay(config, **overrides):
    """Defaults with the given fields replaced."""
    return replace(config, **overrides)
