"""Filtered one-row summaries over datasets and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def filtered(df: DataFrame, product_id: str = "", store_id: str = "", supplier_id: str = "") -> DataFrame:
    """Optional equality filters on the columns that exist."""
    for column, value in (("product_id", product_id), ("store_id", store_id), ("supplier_id", supplier_id)):
        if value and column in df.columns:
            df = df.filter(F.col(column) == value)
    return df


def _sum(column: str):
    return F.coalesce(F.sum(column).cast("double"), F.lit(0.0))


def _money(column: str):
    return F.coalesce(F.sum(F.col(column).cast("decimal(20,2)")).cast("double"), F.lit(0.0))


ROWS = lambda: F.count(F.lit(1))


def inventory_data(inventory: DataFrame, **scope) -> DataFrame:
    return filtered(inventory, **scope).agg(
        ROWS().alias("row_count"),
        _sum("stock_level").alias("total_stock_level"),
        F.countDistinct("store_id").alias("store_count"),
        F.countDistinct("product_id").alias("product_count"),
    )


def sales_totals(summary: DataFrame, **scope) -> DataFrame:
    return filtered(summary, **scope).agg(
        ROWS().alias("row_count"),
        _sum("total_quantity_sold").alias("total_quantity_sold"),
        _money("total_revenue").alias("total_revenue"),
        F.countDistinct("store_id").alias("store_count"),
    )


def product_totals(performance: DataFrame, **scope) -> DataFrame:
    return filtered(performance, **scope).agg(
        ROWS().alias("row_count"),
        F.countDistinct("product_id").alias("product_count"),
        _sum("total_quantity_sold").alias("total_quantity_sold"),
        _sum("current_stock_level").alias("current_stock_level"),
    )


def counts_by_type(recs: DataFrame, **scope) -> DataFrame:
    return filtered(recs, **scope).groupBy("recommendation_type").agg(ROWS().alias("row_count"))


def quantity_total(recs: DataFrame, **scope) -> DataFrame:
    return filtered(recs, **scope).agg(
        ROWS().alias("row_count"), _sum("suggested_quantity").alias("suggested_quantity_total")
    )


def row_counts(df: DataFrame, **scope) -> DataFrame:
    return filtered(df, **scope).agg(
        ROWS().alias("row_count"),
        F.countDistinct("product_id").alias("product_count"),
        F.countDistinct("store_id").alias("store_count"),
    )


def top_categories(inventory: DataFrame, limit: int = 5, **scope) -> DataFrame:
    return (
        filtered(inventory, **scope)
        .groupBy(F.coalesce("category", F.lit("")).alias("category"))
        .agg(ROWS().alias("row_count"))
        .orderBy(F.desc("row_count"), "category")
        .limit(limit)
    )


def top_stock_rows(inventory: DataFrame, limit: int = 10, **scope) -> DataFrame:
    return (
        filtered(inventory, **scope)
        .orderBy(F.desc("stock_level"), "product_id", "store_id")
        .limit(limit)
        .select(
            "product_id", "product_name", "category", "store_id", "store_name", "stock_level",
            "inventory_reorder_threshold", "selling_price",
        )
    )


_SALES = ["total_quantity_sold", "total_revenue", "recent_7_day_quantity_sold", "recent_30_day_quantity_sold", "last_sale_date"]


def sales_rows(inventory: DataFrame, performance: DataFrame) -> DataFrame:
    """Inventory rows with their product's sales totals, which therefore repeat for every store."""
    return inventory.join(performance.select("product_id", *_SALES), "product_id", "left")


def sales_per_store_row(inventory: DataFrame, performance: DataFrame, **scope) -> DataFrame:
    return filtered(sales_rows(inventory, performance), **scope).agg(
        ROWS().alias("row_count"),
        F.countDistinct("product_id").alias("product_count"),
        F.countDistinct("store_id").alias("store_count"),
        _sum("total_quantity_sold").alias("total_quantity_sold"),
        _money("total_revenue").alias("total_revenue"),
    )


def top_sales_rows(inventory: DataFrame, performance: DataFrame, limit: int = 10, **scope) -> DataFrame:
    return (
        filtered(sales_rows(inventory, performance), **scope)
        .orderBy(F.desc("recent_7_day_quantity_sold"), F.desc("total_quantity_sold"), "product_id", "store_id")
        .limit(limit)
        .select("product_id", "product_name", "store_id", "store_name", "category", *_SALES)
    )


def supplier_risk_counts(recs: DataFrame, **scope) -> DataFrame:
    return filtered(recs, **scope).agg(
        ROWS().alias("row_count"), F.count_if(F.lower("priority") == "high").alias("high_priority_count")
    )


def procurement_counts(recs: DataFrame, **scope) -> DataFrame:
    return filtered(recs, **scope).agg(
        ROWS().alias("row_count"),
        F.countDistinct("product_id").alias("product_count"),
        F.countDistinct("store_id").alias("store_count"),
        _sum("suggested_quantity").alias("suggested_quantity_total"),
    )
