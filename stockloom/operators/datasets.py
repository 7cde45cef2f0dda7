"""Core datasets: current inventory, sales summary, product performance, store summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stockloom.functions.exprs import fill_missing, signed_quantity, whole

KEYS = ["product_id", "store_id"]


def latest(df: DataFrame, column: str):
    """The largest value of a column as a scalar subquery."""
    return df.agg(F.max(column).alias("latest")).scalar()


def snapshot_is_current(inventory: DataFrame, transactions: DataFrame) -> DataFrame:
    """One boolean row: is the inventory table at least as new as the ledger?"""
    inv = inventory.agg(F.max("last_updated").alias("inventory_date"), F.count(F.lit(1)).alias("inventory_rows"))
    txn_date = latest(transactions, "date")
    return inv.select(
        F.when((F.col("inventory_rows") == 0) | F.col("inventory_date").isNull(), F.lit(False))
        .when(txn_date.isNull(), F.lit(True))
        .otherwise(F.col("inventory_date") >= txn_date)
        .alias("is_current")
    )


def inventory_from_transactions(transactions: DataFrame) -> DataFrame:
    """Latest snapshot rows of the ledger plus all later signed movements per product and store."""
    snapshots = transactions.filter(F.col("transaction_type") == "inventory_snapshot")
    snap_date = latest(snapshots, "date")
    base = snapshots.filter(F.col("date") == snap_date).select(
        *KEYS, whole("quantity").alias("base_stock"), F.col("date").alias("snapshot_date")
    )
    # Without a snapshot every movement counts.
    no_snapshot = snapshots.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    later = transactions.filter(no_snapshot | (F.col("date") > snap_date))
    moves = (
        later.dropna(subset=KEYS)
        .groupBy(*KEYS)
        .agg(
            F.sum(signed_quantity("transaction_type", "quantity")).alias("stock_change"),
            F.max("date").alias("last_movement"),
        )
    )
    nothing_later = later.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    return base.join(moves, KEYS, "full").select(
        *KEYS,
        (F.coalesce("base_stock", F.lit(0)) + F.coalesce("stock_change", F.lit(0))).alias("stock_level"),
        F.when(nothing_later, F.col("snapshot_date")).otherwise(F.col("last_movement")).alias("last_updated"),
    )


def enrich_inventory(inventory: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Inventory with product and store details; its own threshold is kept apart."""
    inv = inventory.withColumnRenamed("reorder_threshold", "inventory_reorder_threshold")
    return fill_missing(inv.join(products, "product_id", "left").join(stores, "store_id", "left"))


def current_inventory(
    inventory: DataFrame, products: DataFrame, stores: DataFrame, transactions: DataFrame
) -> DataFrame:
    """The inventory table when it is current, else the ledger fold. The choice is one boolean row,
    read when the plan is built, so the table that is not needed is never scanned for rows."""
    if snapshot_is_current(inventory, transactions).first()["is_current"]:
        stock = inventory.withColumn("stock_level", whole("stock_level"))
    else:
        stock = inventory_from_transactions(transactions)
    return enrich_inventory(stock, products, stores)


def sales_summary(sales: DataFrame) -> DataFrame:
    """Totals, trailing 7 and 30 day quantities per product and store, with product and store totals.

    The product total is a window over a product's own rows, one per store at most. Store totals would
    make very large windows, so they are summed on the map side; one row per store is broadcast, as the pairs
    would be shuffled into as few partitions as there are stores otherwise.
    """
    rows = sales.dropna(subset=KEYS)
    newest = latest(sales, "date")
    qty = whole("quantity_sold")
    cents = F.coalesce((F.col("selling_price") * 100).cast("long"), F.lit(0))

    def trailing(days: int):
        inside = F.col("date") >= F.date_sub(newest, days)
        return F.coalesce(F.sum(F.when(inside, qty)), F.lit(0))

    pairs = rows.groupBy(*KEYS).agg(
        F.sum(qty).alias("total_quantity_sold"),
        (F.sum(qty * cents) / F.lit(100.0)).alias("total_revenue"),
        F.max("date").alias("last_sale_date"),
        trailing(7).alias("recent_7_day_quantity_sold"),
        trailing(30).alias("recent_30_day_quantity_sold"),
    )
    of_product = F.sum("total_quantity_sold").over(Window.partitionBy("product_id"))
    of_store = rows.groupBy("store_id").agg(F.sum(qty).alias("store_total_quantity_sold"))
    return (
        pairs.withColumn("product_total_quantity_sold", of_product)
        .join(F.broadcast(of_store), "store_id")
        .select(
            *KEYS,
            "total_quantity_sold",
            "total_revenue",
            "last_sale_date",
            "product_total_quantity_sold",
            "store_total_quantity_sold",
            "recent_7_day_quantity_sold",
            "recent_30_day_quantity_sold",
        )
    )


def product_performance(
    products: DataFrame, summary: DataFrame, inventory: DataFrame, suppliers: DataFrame
) -> DataFrame:
    """Products with sales totals, stock on hand and supplier signals."""
    sold = summary.groupBy("product_id").agg(
        F.sum("total_quantity_sold").alias("total_quantity_sold"),
        F.sum(F.col("total_revenue").cast("decimal(20,2)")).cast("double").alias("total_revenue"),
        F.sum("recent_7_day_quantity_sold").alias("recent_7_day_quantity_sold"),
        F.sum("recent_30_day_quantity_sold").alias("recent_30_day_quantity_sold"),
        F.max("last_sale_date").alias("last_sale_date"),
    )
    stock = inventory.groupBy("product_id").agg(F.sum("stock_level").alias("current_stock_level"))
    joined = (
        products.join(sold, "product_id", "left")
        .join(stock, "product_id", "left")
        .join(suppliers, "supplier_id", "left")
    )
    return fill_missing(joined)


def store_inventory_summary(inventory: DataFrame, stores: DataFrame) -> DataFrame:
    """Stock against capacity per store; a store over capacity has a negative remainder."""
    stock = inventory.groupBy("store_id").agg(F.sum("stock_level").alias("total_inventory"))
    total = F.coalesce("total_inventory", F.lit(0))
    cap = F.coalesce("capacity", F.lit(0))
    used = F.when(cap > 0, total / cap.cast("double") * 100).otherwise(F.lit(0.0))
    return fill_missing(
        stores.join(stock, "store_id", "left").select(
            "store_id",
            "store_name",
            "city",
            cap.alias("capacity"),
            total.alias("total_inventory"),
            (cap - total).alias("remaining_capacity"),
            F.coalesce(used, F.lit(0.0)).alias("capacity_used_percent"),
        )
    )


def inventory_quantity_cascade(inventory: DataFrame, transactions: DataFrame) -> DataFrame:
    """Stock total from the inventory table, else from snapshot rows, else from signed movements."""
    inv = inventory.agg(F.count("stock_level").alias("inv_rows"), F.sum("stock_level").alias("inv_sum"))
    is_snap = F.col("transaction_type") == "inventory_snapshot"
    minus = F.col("transaction_type").isin("sale", "transfer_out")
    q = whole("quantity")
    txn = transactions.agg(
        F.count_if(is_snap).alias("snap_rows"),
        F.sum(F.when(is_snap, q)).alias("snap_sum"),
        F.count(F.lit(1)).alias("txn_rows"),
        F.sum(F.when(minus, -q).otherwise(q)).alias("txn_sum"),
    )
    both = inv.join(txn)  # one row each
    source = (
        F.when(F.col("inv_rows") > 0, "inventory").when(F.col("snap_rows") > 0, "snapshot").otherwise("transactions")
    )
    value = (
        F.when(F.col("inv_rows") > 0, F.col("inv_sum"))
        .when(F.col("snap_rows") > 0, F.col("snap_sum"))
        .otherwise(F.coalesce("txn_sum", F.lit(0)))
    )
    return both.select(value.alias("inventory_quantity"), source.alias("quantity_source"))
