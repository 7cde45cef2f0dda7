"""Service-level stock views: alerts, product-store view, KPIs and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.functions.exprs import (
    at_least_zero,
    priority_rank,
    shortage_priority,
    suggested_reorder,
    text,
    threshold_or_product,
    whole,
)
from stockloom.operators.datasets import KEYS, latest

ALL_STORES = "All Stores"


def sales_velocity_30d(sales: DataFrame) -> DataFrame:
    """Quantity sold per product and store since 30 days before the newest sale, and its daily rate."""
    newest = latest(sales, "date")
    return (
        sales.filter(F.col("date") >= F.date_sub(newest, 30))
        .dropna(subset=KEYS)
        .groupBy(*KEYS)
        .agg(F.sum(whole("quantity_sold")).alias("recent_30_day_quantity_sold"))
        .withColumn("recent_daily_sales_velocity", F.col("recent_30_day_quantity_sold") / F.lit(30.0))
    )


def low_stock_alerts(
    inventory: DataFrame, products: DataFrame, stores: DataFrame, sales: DataFrame, suppliers: DataFrame
) -> DataFrame:
    """Rows at or below their threshold (which may be 0), with shortage, reorder size and urgency."""
    dim = products.select(
        "product_id", "product_name", "category", "supplier_id", F.col("reorder_threshold").alias("product_threshold")
    )
    velocity = sales_velocity_30d(sales).select(*KEYS, "recent_daily_sales_velocity")
    # Stock is filtered before the velocity and store joins, so only low rows are carried on.
    low = (
        inventory.withColumn("current_quantity", whole("stock_level"))
        .withColumnRenamed("reorder_threshold", "store_threshold")
        .join(dim, "product_id", "left")
        .withColumn("reorder_threshold", threshold_or_product("store_threshold", "product_threshold", only_zero=False))
        .filter(F.col("current_quantity") <= F.col("reorder_threshold"))
    )
    v = F.coalesce("recent_daily_sales_velocity", F.lit(0.0))
    return (
        low.join(stores.select("store_id", "store_name", "city"), "store_id", "left")
        .join(suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left")
        .join(velocity, KEYS, "left")
        .select(
            "product_id",
            "product_name",
            "category",
            "store_id",
            "store_name",
            "city",
            "supplier_id",
            "supplier_name",
            "current_quantity",
            "reorder_threshold",
            at_least_zero(F.col("reorder_threshold") - F.col("current_quantity")).alias("shortage_quantity"),
            suggested_reorder("current_quantity", "reorder_threshold", v).alias("suggested_reorder_quantity"),
            v.alias("recent_daily_sales_velocity"),
            shortage_priority("current_quantity", "reorder_threshold").alias("priority"),
        )
        .orderBy(priority_rank("priority"), F.desc("shortage_quantity"), "current_quantity", *KEYS)
    )


def stock_status(qty, thr, velocity) -> Column:
    q, t, v = F.col(qty), F.col(thr), F.col(velocity)
    slow_surplus = (v <= 0.2) & (q >= t * 1.5) & (t > 0)
    return (
        F.when((t > 0) & (q >= t * 2), "Overstock")
        .when(q <= t, "Low Stock")
        .when(slow_surplus, "Overstock")
        .otherwise("Healthy")
    )


def _advice() -> Column:
    name = text("product_name", F.col("product_id"))
    return (
        F.when(
            F.col("stock_status") == "Low Stock",
            F.concat(
                F.lit("Replenish "), name, F.lit("; shortage is "), F.col("shortage_quantity"),
                F.lit(" units and suggested reorder is "), F.col("suggested_reorder_quantity"), F.lit(" units."),
            ),
        )
        .when(
            (F.col("stock_status") == "Overstock") & (F.col("recent_daily_sales_velocity") <= 0.2),
            F.concat(
                F.lit("Review "), name, F.lit(" for discount, clearance, or transfer; surplus is "),
                F.col("surplus_quantity"), F.lit(" units with slow movement."),
            ),
        )
        .when(
            F.col("stock_status") == "Overstock",
            F.concat(
                F.lit("Consider transfer or promotion for "), name, F.lit("; surplus is "),
                F.col("surplus_quantity"), F.lit(" units."),
            ),
        )
        .otherwise(F.concat(name, F.lit(" is within a healthy stock range.")))
    )


def store_inventory_view(
    inventory: DataFrame, products: DataFrame, stores: DataFrame, suppliers: DataFrame, sales: DataFrame
) -> DataFrame:
    """One row per product and store with values, shortage, surplus, status, priority and advice."""
    dim = products.select(
        "product_id", "product_name", "category", "cost_price", "selling_price", "supplier_id",
        F.col("reorder_threshold").alias("product_threshold"),
    )
    money = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(12,2)"))
    q, t = F.col("current_quantity"), F.col("reorder_threshold")
    return (
        inventory.withColumn("current_quantity", whole("stock_level"))
        .withColumnRenamed("reorder_threshold", "inventory_reorder_threshold")
        .join(dim, "product_id", "left")
        .join(suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left")
        .join(stores.select("store_id", "store_name", "city", "capacity"), "store_id", "left")
        .join(sales_velocity_30d(sales), KEYS, "left")
        .withColumns(
            {
                "reorder_threshold": threshold_or_product(
                    "inventory_reorder_threshold", "product_threshold", only_zero=False
                ),
                "recent_30_day_quantity_sold": whole("recent_30_day_quantity_sold"),
                "recent_daily_sales_velocity": F.coalesce("recent_daily_sales_velocity", F.lit(0.0)),
                "product_name": F.coalesce("product_name", "product_id"),
                "category": F.coalesce("category", F.lit("")),
                "store_name": F.coalesce("store_name", "store_id"),
                "city": F.coalesce("city", F.lit("")),
                "capacity": whole("capacity"),
                "supplier_name": F.coalesce("supplier_name", F.lit("")),
                "estimated_inventory_value": q * money("selling_price"),
                "cost_inventory_value": q * money("cost_price"),
            }
        )
        .withColumns(
            {
                "shortage_quantity": at_least_zero(t - q),
                "suggested_reorder_quantity": at_least_zero(t * 2 - q),
                "surplus_quantity": at_least_zero(q - t),
                "stock_status": stock_status("current_quantity", "reorder_threshold", "recent_daily_sales_velocity"),
            }
        )
        .withColumn(
            "priority",
            F.when(q <= F.greatest(t * 0.5, F.lit(0.0)), "High")
            .when(F.col("stock_status").isin("Low Stock", "Overstock"), "Medium")
            .otherwise("Low"),
        )
        .withColumn("advice", _advice())
        .drop("product_threshold")
    )


def for_store(view: DataFrame, store_id: str | None) -> DataFrame:
    return view if not store_id or store_id == ALL_STORES else view.filter(F.col("store_id") == store_id)


def store_kpis(view: DataFrame, by: list[str] = ()) -> DataFrame:
    """Totals of a scope, or per group. An empty scope gives zeros."""
    quiet = (F.col("current_quantity") > 0) & (F.col("recent_30_day_quantity_sold") <= 0)
    return view.groupBy(*by).agg(
        F.coalesce(F.sum("current_quantity"), F.lit(0)).alias("total_quantity"),
        F.countDistinct("product_id").alias("product_count"),
        F.count_if(F.col("stock_status") == "Low Stock").alias("low_stock_count"),
        F.count_if(F.col("stock_status") == "Overstock").alias("overstock_count"),
        F.count_if(quiet).alias("slow_dead_count"),
        F.coalesce(F.sum("estimated_inventory_value").cast("double"), F.lit(0.0)).alias("inventory_value"),
    )


def understock_items(view: DataFrame) -> DataFrame:
    return view.filter(F.col("stock_status") == "Low Stock").orderBy("priority", F.desc("shortage_quantity"), *KEYS)


def overstock_rows(view: DataFrame) -> DataFrame:
    slow = F.col("recent_daily_sales_velocity") <= 0.2
    return (
        view.filter(F.col("stock_status") == "Overstock")
        .withColumn("suggested_action", F.when(slow, "Discount / clearance review").otherwise("Transfer or promotion"))
        .orderBy(F.desc("surplus_quantity"), F.desc("current_quantity"), *KEYS)
    )


def store_comparison(view: DataFrame) -> DataFrame:
    return (
        view.groupBy("store_id", "store_name", "city")
        .agg(
            F.sum("current_quantity").alias("inventory_quantity"),
            F.countDistinct("product_id").alias("product_count"),
            F.count_if(F.col("stock_status") == "Low Stock").alias("low_stock_count"),
            F.count_if(F.col("stock_status") == "Overstock").alias("overstock_count"),
            F.sum("estimated_inventory_value").cast("double").alias("inventory_value"),
        )
        .orderBy(F.desc("inventory_quantity"), "store_id")
    )


def category_summary(view: DataFrame, by_store: bool = False) -> DataFrame:
    keys = ["store_name", "category"] if by_store else ["category"]
    return (
        view.groupBy(*keys)
        .agg(
            F.sum("current_quantity").alias("inventory_quantity"),
            F.sum("estimated_inventory_value").cast("double").alias("inventory_value"),
            F.countDistinct("product_id").alias("product_count"),
        )
        .orderBy(F.desc("inventory_quantity"), *keys)
    )


def recommendations_for_store(recs: DataFrame, store_id: str | None) -> DataFrame:
    if store_id and store_id != ALL_STORES:
        recs = recs.filter((F.col("store_id") == store_id) | (F.col("alternative_store_id") == store_id))
    return recs.orderBy(priority_rank("priority"), "recommendation_id")


def store_texts(view: DataFrame, recs: DataFrame | None = None) -> DataFrame:
    """One sentence per store from its KPIs, most urgent shortage and largest surplus."""
    low, over = F.col("stock_status") == "Low Stock", F.col("stock_status") == "Overstock"
    first_low = F.min(F.when(low, F.struct("priority", -F.col("shortage_quantity"), "product_id", "product_name")))
    first_over = F.min(
        F.when(over, F.struct(-F.col("surplus_quantity"), -F.col("current_quantity"), "product_id", "product_name"))
    )
    facts = view.groupBy("store_id", "store_name").agg(
        F.count_if(low).alias("low_n"),
        F.count_if(over).alias("over_n"),
        F.countDistinct("product_id").alias("product_n"),
        first_low.getField("product_name").alias("low_name"),
        first_over.getField("product_name").alias("over_name"),
    )
    if recs is not None:
        stores = F.array_distinct(F.array("store_id", "alternative_store_id"))
        weight = (F.col("weight") if "weight" in recs.columns else F.lit(1)).alias("weight")  # of a digest, or one a record
        linked = recs.select(F.explode(stores).alias("store_id"), weight).groupBy("store_id").agg(F.sum("weight").alias("rec_n")).filter("rec_n > 0")
        facts = facts.join(linked, "store_id", "left")
    else:
        facts = facts.withColumn("rec_n", F.lit(None).cast("long"))
    parts = [
        F.concat("store_name", F.lit(" has "), "low_n", F.lit(" low-stock items")),
        F.concat("over_n", F.lit(" overstocked products")),
        F.concat(F.lit("and "), "product_n", F.lit(" active products.")),
        F.concat("low_name", F.lit(" needs replenishment.")),
        F.concat("over_name", F.lit(" may be considered for transfer, discount, or clearance.")),
        F.concat("rec_n", F.lit(" active recommendations are linked to this scope.")),
    ]
    return facts.select("store_id", F.concat_ws(" ", *parts).alias("summary_text"))


def status_counts(view: DataFrame) -> DataFrame:
    return view.groupBy("stock_status").agg(F.count("product_id").alias("row_count"))


def top_bottom_stock(view: DataFrame, ascending: bool, limit: int = 10) -> DataFrame:
    first = F.asc("current_quantity") if ascending else F.desc("current_quantity")
    return view.orderBy(first, "product_name", "store_id").limit(limit)


def inventory_distribution(inventory: DataFrame, products: DataFrame) -> DataFrame:
    return (
        inventory.join(products.select("product_id", "category"), "product_id", "left")
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.sum(whole("stock_level")).alias("stock_level"))
        .orderBy(F.desc("stock_level"), "category")
    )


def inventory_table(view: DataFrame) -> DataFrame:
    return view.orderBy("stock_status", "category", "product_name", "store_id")
