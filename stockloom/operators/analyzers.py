"""Inventory analyzers over one shared base of stock and sales metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.config import AnalyzerConfig
from stockloom.functions.exprs import cover_days, evidence, fill_missing, threshold_or_product, velocity_with_fallback, whole
from stockloom.schemas import ANALYSIS_COLUMNS
from stockloom.sources.tables import select_existing

DEFAULTS = AnalyzerConfig()


def analysis_base(inventory: DataFrame, summary: DataFrame) -> DataFrame:
    """Current inventory with sales metrics, effective threshold, velocity and cover days."""
    df = inventory.join(summary, ["product_id", "store_id"], "left")
    if "inventory_reorder_threshold" not in df.columns:  # stock derived from the ledger has none
        df = df.withColumn("inventory_reorder_threshold", F.lit(0).cast("long"))
    df = fill_missing(df).withColumns(
        {
            "effective_reorder_threshold": threshold_or_product(
                "inventory_reorder_threshold", "reorder_threshold", only_zero=True
            ),
            "shelf_life_days": whole("shelf_life_days"),
            "recent_daily_sales_velocity": velocity_with_fallback(
                "recent_7_day_quantity_sold", "recent_30_day_quantity_sold"
            ),
        }
    )
    return df.withColumn("days_of_stock_remaining", cover_days("stock_level", "recent_daily_sales_velocity"))


def velocity_cutoffs(base: DataFrame, *percentiles: float) -> Column:
    """Exact interpolated percentiles of the positive velocities as one array, null when there are none.

    Velocities are whole quantities over 7 or 30, so the distinct values are few; they are counted
    first and the percentile is taken over (value, count) pairs.
    """
    counted = (
        base.filter("recent_daily_sales_velocity > 0")
        .groupBy(F.col("recent_daily_sales_velocity").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    points = F.array(*(F.lit(float(p)) for p in percentiles))
    return counted.agg(F.percentile("v", points, F.col("n")).alias("cut")).scalar()


def velocity_cutoff(base: DataFrame, percentile: float) -> Column:
    return velocity_cutoffs(base, percentile)[0]


def low_stock_rule(c: AnalyzerConfig) -> Column:
    limit = F.col("effective_reorder_threshold") * (1 + c.low_stock_buffer_percent / 100)
    return (F.col("effective_reorder_threshold") > 0) & (F.col("stock_level") <= limit)


def stockout_risk_rule(c: AnalyzerConfig) -> Column:
    return (
        (F.col("stock_level") > 0)
        & (F.col("recent_daily_sales_velocity") > 0)
        & (F.col("days_of_stock_remaining") <= c.stockout_risk_days)
    )


def overstock_rule(c: AnalyzerConfig) -> Column:
    thr = F.col("effective_reorder_threshold")
    by_threshold = (thr > 0) & (F.col("stock_level") >= thr * c.overstock_threshold_multiplier)
    by_cover = (F.col("recent_daily_sales_velocity") > 0) & (F.col("days_of_stock_remaining") >= c.overstock_days)
    return by_threshold | by_cover


def dead_stock_rule(c: AnalyzerConfig) -> Column:
    days, shelf = F.col("days_of_stock_remaining"), F.col("shelf_life_days")
    quiet = F.col("recent_30_day_quantity_sold") <= c.dead_stock_max_recent_quantity
    pressure = (shelf > 0) & (days > 0) & (days >= shelf * c.shelf_life_clearance_multiplier)
    return (F.col("stock_level") > 0) & (quiet | pressure)


def high_demand_rule(cutoff: Column) -> Column:
    v = F.col("recent_daily_sales_velocity")
    return (v > 0) & (v >= cutoff)


def slow_moving_rule(cutoff: Column) -> Column:
    v = F.col("recent_daily_sales_velocity")
    return (F.col("stock_level") > 0) & ((v == 0) | (v <= cutoff))


def _described(df: DataFrame, reason: str, trigger: str, **pairs) -> DataFrame:
    out = df.withColumns({"reason": F.lit(reason), "trigger": F.lit(trigger), "evidence": evidence(df, **pairs)})
    return select_existing(out, ANALYSIS_COLUMNS)


def low_stock_items(base: DataFrame, c: AnalyzerConfig = DEFAULTS) -> DataFrame:
    return _described(
        base.filter(low_stock_rule(c)),
        "stock is at or below the configured reorder point",
        f"stock_level <= reorder_threshold_with_buffer_{c.low_stock_buffer_percent}_percent",
        stock="stock_level",
        reorder_threshold="effective_reorder_threshold",
    )


def stockout_risk_items(base: DataFrame, c: AnalyzerConfig = DEFAULTS) -> DataFrame:
    return _described(
        base.filter(stockout_risk_rule(c)),
        "current stock may not cover recent sales velocity",
        f"days_of_stock_remaining <= {c.stockout_risk_days}",
        days_of_stock="days_of_stock_remaining",
        recent_daily_velocity="recent_daily_sales_velocity",
    )


def overstock_items(base: DataFrame, c: AnalyzerConfig = DEFAULTS) -> DataFrame:
    return _described(
        base.filter(overstock_rule(c)),
        "stock is high compared with reorder point or sales velocity",
        f"stock >= reorder_threshold * {c.overstock_threshold_multiplier} "
        f"or days_of_stock_remaining >= {c.overstock_days}",
        stock="stock_level",
        reorder_threshold="effective_reorder_threshold",
        days_of_stock="days_of_stock_remaining",
    )


def dead_stock_candidates(base: DataFrame, c: AnalyzerConfig = DEFAULTS) -> DataFrame:
    return _described(
        base.filter(dead_stock_rule(c)),
        "stock has low recent movement or may outlast shelf life",
        f"recent_{c.dead_stock_recent_days}_day_quantity <= {c.dead_stock_max_recent_quantity} "
        f"or days_of_stock_remaining >= shelf_life_days * {c.shelf_life_clearance_multiplier}",
        stock="stock_level",
        recent_30_day_sales="recent_30_day_quantity_sold",
        shelf_life_days="shelf_life_days",
        days_of_stock="days_of_stock_remaining",
    )


def high_demand_items(base: DataFrame, c: AnalyzerConfig = DEFAULTS) -> DataFrame:
    cutoff = velocity_cutoff(base, c.high_demand_percentile)
    return _described(
        base.filter(high_demand_rule(cutoff)),
        "recent sales velocity is high relative to this dataset",
        f"recent_daily_sales_velocity >= percentile_{c.high_demand_percentile}",
        recent_daily_velocity="recent_daily_sales_velocity",
        cutoff=cutoff,
    )


def slow_moving_items(base: DataFrame, c: AnalyzerConfig = DEFAULTS) -> DataFrame:
    cutoff = velocity_cutoff(base, c.slow_moving_percentile)
    return _described(
        base.filter(slow_moving_rule(cutoff)),
        "recent sales velocity is low relative to this dataset",
        f"recent_daily_sales_velocity <= percentile_{c.slow_moving_percentile}",
        recent_daily_velocity="recent_daily_sales_velocity",
        cutoff=cutoff,
    )


ANALYZERS = {
    "low_stock_items": low_stock_items,
    "stockout_risk_items": stockout_risk_items,
    "overstock_items": overstock_items,
    "dead_stock_candidates": dead_stock_candidates,
    "high_demand_items": high_demand_items,
    "slow_moving_items": slow_moving_items,
}


def flagged_base(base: DataFrame, c: AnalyzerConfig = DEFAULTS) -> DataFrame:
    """The base with one boolean per analyzer, so all six rules are evaluated in one pass."""
    both = base.withColumn("_cuts", velocity_cutoffs(base, c.high_demand_percentile, c.slow_moving_percentile))
    flags = {
        "low_stock_items": low_stock_rule(c),
        "stockout_risk_items": stockout_risk_rule(c),
        "overstock_items": overstock_rule(c),
        "dead_stock_candidates": dead_stock_rule(c),
        "high_demand_items": high_demand_rule(F.col("_cuts")[0]),
        "slow_moving_items": slow_moving_rule(F.col("_cuts")[1]),
    }
    return both.withColumns({f"is_{name}": F.coalesce(rule, F.lit(False)) for name, rule in flags.items()}).drop("_cuts")


def inventory_analysis(base: DataFrame, c: AnalyzerConfig = DEFAULTS) -> DataFrame:
    """All six outputs as (dataset, row): every base row is expanded to the sets it belongs to."""
    names = list(ANALYZERS)
    member = F.filter(
        F.array(*[F.when(F.col(f"is_{n}"), F.lit(n)) for n in names]), lambda x: x.isNotNull()
    )
    flagged = flagged_base(base, c).withColumn("dataset", F.explode(member))
    return select_existing(flagged, ["dataset", *ANALYSIS_COLUMNS])


def analyzer_counts(base: DataFrame, c: AnalyzerConfig = DEFAULTS) -> DataFrame:
    """(dataset, row_count) of every analyzer in one aggregation, zeros included."""
    names = list(ANALYZERS)
    counts = flagged_base(base, c).agg(*[F.count_if(F.col(f"is_{n}")).alias(n) for n in names])
    return counts.unpivot([], names, "dataset", "row_count")
