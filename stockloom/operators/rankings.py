"""Parameterised answers: rankings, scoped stock lists, supplier and inventory answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stockloom.functions.exprs import whole
from stockloom.operators import stock_views as sv, transfers as tr
from stockloom.operators.datasets import KEYS
from stockloom.operators.sales import in_time_scope


def in_stores(df: DataFrame, store_ids=()) -> DataFrame:
    return df.filter(F.col("store_id").isin(*store_ids)) if store_ids else df


def in_category(df: DataFrame, category: str) -> DataFrame:
    return df.filter(F.lower(F.trim("category")) == category.strip().lower()) if category else df


def sales_ranking(
    sales: DataFrame,
    entity: str = "product",
    metric: str = "quantity",
    ascending: bool = False,
    store_ids=(),
    category: str = "",
    time_scope: str = "",
    limit: int = 5,
) -> DataFrame:
    """Best or worst products or categories by units or revenue within a scope."""
    rows = in_time_scope(in_category(in_stores(sales, store_ids), category), time_scope)
    if entity == "category":
        keys, name = ["category"], "category"
        rows = rows.filter(F.trim("category") != "")
    else:
        keys, name = ["product_id", "product_name"] + (["category"] if category else []), "product_name"
    column = "sales_value" if metric == "revenue" else "quantity_sold"
    first = F.asc(column) if ascending else F.desc(column)
    return (
        rows.groupBy(*keys)
        .agg(F.sum("quantity_sold").alias("quantity_sold"), F.sum("sales_value").alias("sales_value"))
        .orderBy(first, name)
        .limit(max(1, limit))
    )


def ranked_products(sales: DataFrame, group: str, ascending: bool, limit: int = 5, store_ids=(), category: str = "") -> DataFrame:
    """The best or worst products of every store or category. The rank limit prunes before the shuffle."""
    units = (
        in_category(in_stores(sales, store_ids), category)
        .groupBy(group, "product_id", "product_name")
        .agg(F.sum("quantity_sold").alias("quantity_sold"))
    )
    first = F.asc("quantity_sold") if ascending else F.desc("quantity_sold")
    place = F.row_number().over(Window.partitionBy(group).orderBy(first, "product_name"))
    return units.withColumn("place", place).filter(F.col("place") <= max(1, limit))


def sales_summary_by_store(sales: DataFrame, store_ids=()) -> DataFrame:
    """Units and value per store with the best product of the whole scope on every row."""
    rows = in_stores(sales, store_ids)
    top = (
        rows.groupBy("product_id", "product_name")
        .agg(F.sum("quantity_sold").alias("units"))
        .agg(F.min_by(F.struct("product_name", "units"), F.struct(-F.col("units"), "product_name")).alias("t"))
    )
    per_store = rows.groupBy("store_id", "store_name", "city").agg(
        F.sum("quantity_sold").alias("total_units_sold"), F.sum("sales_value").alias("total_sales_value")
    )
    return per_store.join(top).select(  # one row
        "store_id", "store_name", "city", "total_units_sold", "total_sales_value",
        F.col("t.product_name").alias("top_product"), F.col("t.units").alias("top_product_units"),
    )


def low_stock_by_store(low_stock: DataFrame, store_ids=()) -> DataFrame:
    """Count of low rows per store and the first three names."""
    rows = in_stores(low_stock, store_ids)
    place = F.row_number().over(Window.partitionBy("store_id").orderBy("product_id"))
    names = (
        rows.withColumn("place", place)
        .filter("place <= 3")
        .groupBy("store_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "product_name"))).alias("first"))
    )
    counts = rows.groupBy("store_id", "store_name").agg(F.count(F.lit(1)).alias("low_stock_count"))
    return counts.join(names, "store_id").select(
        "store_id", "store_name", "low_stock_count",
        F.array_join(F.transform("first", lambda x: x["product_name"]), ", ").alias("first_products"),
    )


def understock_in(view: DataFrame, store_ids=()) -> DataFrame:
    return sv.understock_items(in_stores(view, store_ids))


def overstock_in(view: DataFrame, store_ids=()) -> DataFrame:
    return sv.overstock_rows(in_stores(view, store_ids))


def category_inventory_in(view: DataFrame, store_ids=()) -> DataFrame:
    return sv.category_summary(in_stores(view, store_ids))


def transfer_answer(analysis: DataFrame, kind: str, limit: int = 5) -> DataFrame:
    """Top shortages, surpluses or opportunities."""
    limit = max(1, limit)
    if kind == "shortage":
        return tr.top_shortages(analysis, limit)
    if kind == "surplus":
        return tr.top_surpluses(analysis, limit)
    return tr.top_opportunities(tr.transfer_opportunities(analysis), limit)


def exclusive_in(exclusive: DataFrame, store_ids=()) -> DataFrame:
    return exclusive.filter(F.col("exclusive_store_id").isin(*store_ids)) if store_ids else exclusive


def surplus_in(surplus: DataFrame, product_ids=(), store_ids=()) -> DataFrame:
    rows = in_stores(surplus, store_ids)
    return rows.filter(F.col("product_id").isin(*product_ids)) if product_ids else rows


def alternatives_in(alternatives: DataFrame, products=(), stores=()) -> DataFrame:
    """Alternatives whose low or offered side matches the given names."""
    if products:
        alternatives = alternatives.filter(
            F.col("low_stock_product").isin(*products) | F.col("alternative_product").isin(*products)
        )
    if stores:
        alternatives = alternatives.filter(F.col("low_stock_store").isin(*stores) | F.col("alternative_store").isin(*stores))
    return alternatives


def product_units(sales: DataFrame, product_ids=(), store_ids=()) -> DataFrame:
    rows = in_stores(sales, store_ids)
    rows = rows.filter(F.col("product_id").isin(*product_ids)) if product_ids else rows
    return rows.groupBy("product_id", "product_name").agg(F.sum("quantity_sold").alias("total_units_sold"))


def riskiest_supplier(suppliers: DataFrame, performance: DataFrame, product_ids=()) -> DataFrame:
    """Lowest reliability, then longest delivery, with the products it affects. A product scope without a
    supplier falls back to all suppliers."""
    rank = F.struct(F.coalesce("reliability_score", F.lit(0.0)), -whole("avg_delivery_days"), "supplier_id")
    pool = suppliers.withColumn("outside", F.lit(0))
    if product_ids:
        mine = performance.filter(F.col("product_id").isin(*product_ids)).select("supplier_id").distinct()
        pool = suppliers.join(mine.withColumn("inside", F.lit(0)), "supplier_id", "left").withColumn(
            "outside", F.coalesce("inside", F.lit(1))
        )
    worst = pool.agg(
        F.min_by(
            F.struct("supplier_id", "supplier_name", "reliability_score", "avg_delivery_days"), F.struct("outside", rank)
        ).alias("s")
    ).select("s.*")
    affected = performance.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("affected_products"), F.min("product_name").alias("example_product")
    )
    return worst.join(affected, "supplier_id", "left").select(
        "supplier_id", "supplier_name", "reliability_score", "avg_delivery_days",
        F.coalesce("affected_products", F.lit(0)).alias("affected_products"), "example_product",
    )


def inventory_total(inventory: DataFrame, store_ids=(), product_ids=()) -> DataFrame:
    rows = surplus_in(inventory, product_ids, store_ids)
    return rows.agg(F.coalesce(F.sum(whole("stock_level")), F.lit(0)).alias("total_stock"), F.count(F.lit(1)).alias("row_count"))


def inventory_top_rows(inventory: DataFrame, products: DataFrame, store_ids=(), product_ids=(), limit: int = 10) -> DataFrame:
    names = products.select("product_id", "product_name", "category")
    return (
        surplus_in(inventory, product_ids, store_ids)
        .join(names, "product_id", "left")
        .orderBy(F.desc("stock_level"), *KEYS)
        .limit(limit)
    )
