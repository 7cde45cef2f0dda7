"""Sales analytics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from stockloom.functions.exprs import branch_label, ratio, whole
from stockloom.operators.datasets import latest
from stockloom.session import published


@dataclass(frozen=True)
class SalesFilters:
    store_ids: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    product_ids: tuple[str, ...] = ()
    start_date: str | None = None
    end_date: str | None = None


def sales_dataset(sales: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Sales with store, city, product, category, value and branch label."""
    price = F.coalesce("selling_price", F.lit(0).cast("decimal(12,2)"))
    return (
        sales.withColumns({"quantity_sold": whole("quantity_sold"), "selling_price": price})
        .withColumn("sales_value", F.col("quantity_sold") * F.col("selling_price"))
        .join(stores.select("store_id", "store_name", "city"), "store_id", "left")
        .join(products.select("product_id", "product_name", "category"), "product_id", "left")
        .withColumns(
            {
                "store_name": F.coalesce("store_name", "store_id"),
                "city": F.coalesce("city", F.lit("")),
                "product_name": F.coalesce("product_name", "product_id"),
                "category": F.coalesce("category", F.lit("Uncategorized")),
            }
        )
        .withColumn("branch_label", branch_label("city", "store_name"))
    )


def filtered_sales(df: DataFrame, f: SalesFilters) -> DataFrame:
    """IN lists and an inclusive date range; empty filters keep everything."""
    for column, values in (("store_id", f.store_ids), ("category", f.categories), ("product_id", f.product_ids)):
        if values:
            df = df.filter(F.col(column).isin(*values))
    if f.start_date:
        df = df.filter(F.col("date") >= F.lit(f.start_date).cast("date"))
    if f.end_date:
        df = df.filter(F.col("date") < F.date_add(F.lit(f.end_date).cast("date"), 1))
    return df


def branch_options(stores: DataFrame) -> DataFrame:
    city = F.coalesce("city", F.lit(""))
    name = F.coalesce("store_name", "store_id")
    return stores.select(branch_label(city, name).alias("label"), "store_id", city.alias("city"), name.alias("store_name")).orderBy(
        "city", "store_name", "store_id"
    )


def _measures() -> list:
    return [
        F.sum("quantity_sold").alias("quantity_sold"),
        F.sum("sales_value").alias("sales_value"),
        F.countDistinct("sale_id").alias("order_count"),
    ]


def branch_sales_summary(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("store_id", "branch_label", "city", "store_name")
        .agg(*_measures())
        .orderBy(F.desc("sales_value"), "store_id")
    )


def sales_trend(df: DataFrame, frequency: str = "D") -> DataFrame:
    """Per day, or per week starting on Monday."""
    start = F.col("date") if frequency == "D" else F.date_trunc("week", "date").cast("date")
    return df.filter(F.col("date").isNotNull()).groupBy(start.alias("date")).agg(*_measures()).orderBy("date")


def product_sales(df: DataFrame) -> DataFrame:
    return df.groupBy("product_id", "product_name", "category").agg(*_measures())


def sales_product_performance(df: DataFrame, limit: int | None = 10) -> DataFrame:
    ranked = product_sales(df).orderBy(F.desc("quantity_sold"), F.desc("sales_value"), "product_id")
    return ranked.limit(limit) if limit else ranked


def category_sales(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("category")
        .agg(F.sum("quantity_sold").alias("quantity_sold"), F.sum("sales_value").alias("sales_value"))
        .orderBy(F.desc("sales_value"), "category")
    )


def product_velocity(filtered: DataFrame, all_sales: DataFrame) -> DataFrame:
    """Product sales since 30 days before the newest of all sales (all rows when there are none), per day."""
    since = F.date_sub(latest(all_sales, "date"), 30)
    none_recent = filtered.agg((F.count_if(F.col("date") >= since) == 0).alias("none")).scalar()
    recent = filtered.filter(none_recent | (F.col("date") >= since))
    return product_sales(recent).withColumn("daily_sales_velocity", F.col("quantity_sold") / F.lit(30.0))


def overview_metrics(filtered: DataFrame, all_sales: DataFrame) -> DataFrame:
    """One row of headline figures; the least product is the least of the ten best.

    Sales are summed once per day and product; everything but the number of orders follows from those sums.
    """
    product = ["product_id", "product_name", "category"]
    sums = [F.sum("quantity_sold").alias("quantity_sold"), F.sum("sales_value").alias("sales_value")]
    days = published(filtered.groupBy("date", *product).agg(*sums))
    best = days.groupBy(*product).agg(*sums).orderBy(F.desc("quantity_sold"), F.desc("sales_value"), "product_id").limit(10)
    products = best.agg(
        F.min_by("product_name", F.struct(-F.col("quantity_sold"), -F.col("sales_value"), "product_id")).alias("top"),
        F.min_by("product_name", F.struct("quantity_sold", "product_name")).alias("least"),
    )
    daily = days.filter("date IS NOT NULL").groupBy("date").agg(F.sum("sales_value").alias("sales_value"))
    first7 = daily.orderBy("date").limit(7).agg((F.sum("sales_value").cast("double") / F.count(F.lit(1))).alias("m"))
    last7 = daily.orderBy(F.desc("date")).limit(7).agg(
        (F.sum("sales_value").cast("double") / F.count(F.lit(1))).alias("m"), F.count(F.lit(1)).alias("n")
    )
    since = F.date_sub(latest(all_sales, "date"), 30)
    none_recent = days.agg((F.count_if(F.col("date") >= since) == 0).alias("none")).scalar()
    recent_days = days.filter(none_recent | (F.col("date") >= since))
    fastest = recent_days.groupBy(*product).agg(*sums).agg(
        F.min_by("product_name", F.struct(-F.col("quantity_sold"), -F.col("sales_value"), "product_id")).alias("fastest")
    )
    recent, base = F.col("recent"), F.col("baseline")
    trend = (
        F.when(F.col("days") < 2, "Flat")
        .when(recent > base * 1.05, "Up")
        .when(recent < base * 0.95, "Down")
        .otherwise("Flat")
    )
    none = F.lit("No sales")
    totals = filtered.agg(
        F.coalesce(F.sum("sales_value").cast("double"), F.lit(0.0)).alias("total_sales"),
        F.countDistinct("sale_id").alias("total_orders"),
    )
    return (
        totals.join(products)  # every side is one row
        .join(fastest)
        .join(first7.select(F.col("m").alias("baseline")))
        .join(last7.select(F.col("m").alias("recent"), F.col("n").alias("days")))
        .select(
            "total_sales",
            "total_orders",
            F.coalesce("top", none).alias("top_product"),
            F.coalesce("least", none).alias("least_product"),
            F.when(F.col("total_orders") == 0, "No trend").otherwise(trend).alias("revenue_trend"),
            F.coalesce("fastest", none).alias("fastest_moving_product"),
        )
    )


def inventory_sales_comparison(filtered: DataFrame, inventory: DataFrame, limit: int = 12) -> DataFrame:
    """Product velocity against the stock of the stores in scope; the fastest first."""
    in_scope = inventory.join(filtered.select("store_id").distinct(), "store_id", "left_semi")
    stock = in_scope.groupBy("product_id").agg(
        F.sum(whole("stock_level")).alias("stock_level"), F.sum(whole("reorder_threshold")).alias("reorder_threshold")
    )
    return (
        product_velocity(filtered, filtered)
        .join(stock, "product_id", "left")
        .withColumns({"stock_level": whole("stock_level"), "reorder_threshold": whole("reorder_threshold")})
        .withColumn("days_of_stock_remaining", ratio("stock_level", "daily_sales_velocity"))
        .orderBy(F.desc("daily_sales_velocity"), F.desc("sales_value"), "product_id")
        .limit(limit)
    )


def top_product_per_store(df: DataFrame) -> DataFrame:
    """Best-selling product name of each store; ties go to the first name."""
    units = df.groupBy("store_id", "product_name").agg(F.sum("quantity_sold").alias("units"))
    best = F.min_by(F.struct("product_name", "units"), F.struct(-F.col("units"), "product_name")).alias("b")
    return units.groupBy("store_id").agg(best).select(
        "store_id", F.col("b.product_name").alias("top_product"), F.col("b.units").alias("top_product_units")
    )


def branch_comparison(df: DataFrame, inventory: DataFrame, store_ids: tuple[str, ...] = ()) -> DataFrame:
    view = df.filter(F.col("store_id").isin(*store_ids)) if store_ids else df
    low = (
        inventory.filter(whole("stock_level") <= whole("reorder_threshold"))
        .groupBy("store_id")
        .agg(F.count(F.lit(1)).alias("low"))
    )
    return (
        branch_sales_summary(view)
        .join(top_product_per_store(view), "store_id", "left")
        .join(low, "store_id", "left")
        .select(
            "branch_label",
            F.col("sales_value").alias("total_sales"),
            "order_count",
            "top_product",
            "top_product_units",
            F.coalesce("low", F.lit(0)).alias("low_stock_risk"),
        )
        .orderBy(F.desc("total_sales"), "branch_label")
    )


def sales_insights(filtered: DataFrame, all_filtered: DataFrame, comparison: DataFrame) -> DataFrame:
    """Up to four sentences: strongest branch, fastest and slowest product, branch most at risk."""
    branch = branch_sales_summary(all_filtered).agg(
        F.min_by("store_name", F.struct(-F.col("sales_value"), "store_id")).alias("branch")
    )
    category = category_sales(all_filtered).agg(
        F.min_by("category", F.struct(-F.col("sales_value"), "category")).alias("category")
    )
    product = product_sales(filtered).agg(
        F.min_by(
            F.struct("product_name", "quantity_sold"),
            F.struct(-F.col("quantity_sold"), -F.col("sales_value"), "product_id"),
        ).alias("best"),
        F.min_by("product_name", F.struct("quantity_sold", "product_name")).alias("weakest"),
    )
    risk = comparison.agg(
        F.min_by(
            F.struct("branch_label", "low_stock_risk"), F.struct(-F.col("low_stock_risk"), "branch_label")
        ).alias("risk")
    )
    especially = F.coalesce(F.concat(F.lit(", especially in "), "category", F.lit(" products")), F.lit(""))
    lines = [
        F.concat("branch", F.lit(" currently shows the strongest sales activity"), especially, F.lit(".")),
        F.concat(
            "best.product_name", F.lit(" is the fastest seller in the selected scope with "),
            F.format_number("best.quantity_sold", 0), F.lit(" units sold."),
        ),
        F.concat("weakest", F.lit(" has slower movement and may need pricing, placement, or reorder review.")),
        F.when(
            F.col("risk.low_stock_risk") > 0,
            F.concat(
                "risk.branch_label", F.lit(" has "), "risk.low_stock_risk",
                F.lit(" low-stock risk items while serving active demand."),
            ),
        ),
    ]
    found = F.filter(F.array(*lines), lambda x: x.isNotNull())
    none = F.lit(
        "There is not enough sales activity in the selected filters to generate a confident branch insight."
    )
    one_row = branch.join(category).join(product).join(risk)  # every side is one row
    shown = F.when(F.size(found) == 0, F.array(none)).otherwise(found)
    return one_row.select(F.posexplode(shown).alias("position", "insight"))


def in_time_scope(sales: DataFrame, scope: str) -> DataFrame:
    """`last_7_days` are the seven calendar days ending at the newest sale, `today` its day."""
    newest = latest(sales, "date")
    if scope == "last_7_days":
        return sales.filter(F.col("date").between(F.date_sub(newest, 6), newest))
    if scope == "today":
        return sales.filter(F.col("date") == newest)
    return sales
