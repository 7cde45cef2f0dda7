"""Queries over the core datasets and analyzers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from stockloom.operators import analyzers as an, datasets as ds
from stockloom.plans.catalog import query
from stockloom.schemas import RAW_TABLES
from stockloom.session import shared_folder
from stockloom.sources import sinks, tables

_ANALYSIS = """product_id, product_name, category, store_id, store_name, city, stock_level, effective_reorder_threshold,
 recent_7_day_quantity_sold, recent_30_day_quantity_sold, recent_daily_sales_velocity, days_of_stock_remaining,
 shelf_life_days, supplier_id, CAST(last_sale_date AS VARCHAR) last_sale_date"""


def _null_sql(name):
    one = "SELECT '{0}' table_name, '{1}' column_name, count(*) FILTER (WHERE {1} IS NULL) null_count FROM rt_{0}"
    return " UNION ALL ".join(one.format(name, c) for c in _REQUIRED[name].split())


_REQUIRED = {
    "products": "product_id product_name category cost_price selling_price shelf_life_days reorder_threshold supplier_id",
    "stores": "store_id store_name city capacity",
    "suppliers": "supplier_id supplier_name avg_delivery_days reliability_score",
    "inventory": "product_id store_id stock_level reorder_threshold last_updated",
    "sales": "sale_id date product_id store_id quantity_sold selling_price",
    "transactions": "transaction_id date transaction_type product_id store_id quantity source remarks",
}


@query("validate_table", " UNION ALL ".join(_null_sql(n) for n in _REQUIRED))
def _validate(ws):
    out = None
    for name, schema in RAW_TABLES.items():
        one = tables.null_counts(getattr(ws, name), schema.names).select(F.lit(name).alias("table_name"), "column_name", "null_count")
        out = one if out is None else out.unionByName(one)
    return out


def _place(ws, name):
    return f"{shared_folder(ws.spark)}/round_trips/{name}-{uuid.uuid4().hex}"


@query("overwrite_round_trip", """
SELECT product_id, store_id, stock_level, CAST(last_updated AS VARCHAR) last_updated FROM rt_inventory WHERE stock_level > 0""")
def _overwrite(ws):
    """A table written twice under one name, by store: only the second content is left."""
    path = _place(ws, "overwrite")
    rows = ws.inventory.select("product_id", "store_id", "stock_level", "last_updated")
    sinks.overwrite(rows, path, ["store_id"])
    sinks.overwrite(rows.filter("stock_level > 0"), path, ["store_id"])
    return ws.spark.read.schema(rows.schema).parquet(path)


@query("append_log_round_trip", """
SELECT transaction_id, CAST(date AS VARCHAR) date, quantity, '' checked_by FROM rt_transactions
UNION ALL SELECT transaction_id, CAST(date AS VARCHAR), -quantity, '' FROM rt_transactions WHERE quantity > 40""")
def _append(ws):
    """Two appends to one log; a text column of the layout that the rows lack is blank."""
    path = _place(ws, "append")
    layout = T.StructType([ws.transactions.schema[c] for c in ("transaction_id", "date", "quantity")] + [T.StructField("checked_by", T.StringType())])
    rows = ws.transactions.select("transaction_id", "date", "quantity")
    sinks.append_log(rows, path, layout)
    sinks.append_log(rows.filter("quantity > 40").withColumn("quantity", -F.col("quantity")), path, layout)
    return ws.spark.read.schema(layout).parquet(path)


@query("export_csv_round_trip", """
SELECT product_id, product_name, category, CAST(selling_price AS DOUBLE) selling_price, shelf_life_days FROM rt_products""")
def _csv(ws):
    path = _place(ws, "csv")
    rows = ws.products.select("product_id", "product_name", "category", "selling_price", "shelf_life_days")
    sinks.export_csv(rows, path)
    return ws.spark.read.schema(rows.schema).option("header", True).csv(path)


@query("records_export", """
SELECT product_id, supplier_id, CAST(to_json({'product_id': product_id, 'store_id': store_id, 'stock_level': stock_level,
 'last_updated': CAST(last_updated AS VARCHAR)}) AS VARCHAR) AS record FROM v_current""")
def _records(ws):
    picked = ws.current_inventory.select("product_id", "supplier_id", "store_id", "stock_level", "last_updated")
    cleaned = sinks.clean_records(picked)
    body = F.struct("product_id", "store_id", "stock_level", "last_updated")
    return cleaned.select("product_id", "supplier_id", F.to_json(body).alias("record"))


@query("data_summary", """
SELECT (SELECT count(*) FROM v_current) current_inventory_rows, (SELECT count(*) FROM v_pairs) sales_summary_rows,
 (SELECT count(*) FROM rt_products) product_performance_rows, (SELECT count(*) FROM rt_stores) store_inventory_summary_rows,
 (SELECT CAST(sum(stock_level) AS BIGINT) FROM v_current) inventory_units,
 (SELECT CAST(sum(CAST(total_revenue AS DECIMAL(20,2))) AS DOUBLE) FROM v_pairs) sales_revenue""")
def _data_summary(ws):
    inv = ws.current_inventory.agg(
        F.count(F.lit(1)).alias("current_inventory_rows"), F.sum("stock_level").alias("inventory_units")
    )
    sold = ws.sales_summary.agg(
        F.count(F.lit(1)).alias("sales_summary_rows"),
        F.sum(F.col("total_revenue").cast("decimal(20,2)")).cast("double").alias("sales_revenue"),
    )
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).scalar().alias(name)
    return inv.join(sold).select(  # two one-row frames
        "current_inventory_rows",
        "sales_summary_rows",
        count(ws.product_performance, "product_performance_rows"),
        count(ws.store_inventory_summary, "store_inventory_summary_rows"),
        "inventory_units",
        "sales_revenue",
    )


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' dataset, count(*) row_count FROM rt_{t}" for t in RAW_TABLES)


@query("table_counts", _COUNTS)
def _table_counts(ws):
    return tables.table_counts({t: getattr(ws, t) for t in RAW_TABLES})


@query("table_health", f"""
SELECT n available_count, CAST(6 AS BIGINT) total_count,
 CASE WHEN n = 6 THEN 'Healthy' WHEN n >= 4 THEN 'Watch' ELSE 'Needs Attention' END status,
 concat(CASE WHEN n = 6 THEN 'Healthy' WHEN n >= 4 THEN 'Watch' ELSE 'Needs Attention' END, ' (', n, '/6)') health_label
FROM (SELECT count(*) FILTER (WHERE row_count > 0) n FROM ({_COUNTS}) c) h""")
def _health(ws):
    return tables.table_health(tables.table_counts({t: getattr(ws, t) for t in RAW_TABLES}), len(RAW_TABLES))


@query("analyzer_counts", """
SELECT 'low_stock_items' dataset, count(*) row_count FROM v_low UNION ALL SELECT 'stockout_risk_items', count(*) FROM v_stockout
UNION ALL SELECT 'overstock_items', count(*) FROM v_over UNION ALL SELECT 'dead_stock_candidates', count(*) FROM v_dead
UNION ALL SELECT 'high_demand_items', count(*) FROM v_high UNION ALL SELECT 'slow_moving_items', count(*) FROM v_slow""")
def _analyzer_counts(ws):
    return an.analyzer_counts(ws.shared_base)


@query("snapshot_is_current", """
SELECT (SELECT max(last_updated) FROM rt_inventory) >= (SELECT max(date) FROM rt_transactions) is_current""")
def _snapshot(ws):
    return ds.snapshot_is_current(ws.inventory, ws.transactions)


@query("inventory_from_transactions", """
WITH d AS (SELECT max(date) sd FROM rt_transactions WHERE transaction_type = 'inventory_snapshot'),
b AS (SELECT product_id, store_id, quantity FROM rt_transactions, d WHERE transaction_type = 'inventory_snapshot' AND date = sd),
m AS (SELECT product_id, store_id, max(date) lm, CAST(sum(CASE
   WHEN transaction_type IN ('purchase', 'restock', 'transfer_in', 'return', 'inventory_in') THEN quantity
   WHEN transaction_type IN ('sale', 'transfer_out', 'damage', 'waste', 'return_to_supplier') THEN -quantity ELSE 0 END) AS BIGINT) ch
  FROM rt_transactions, d WHERE date > sd GROUP BY product_id, store_id)
SELECT coalesce(b.product_id, m.product_id) product_id, coalesce(b.store_id, m.store_id) store_id,
 coalesce(quantity, 0) + coalesce(ch, 0) stock_level, CAST(lm AS VARCHAR) last_updated
FROM b FULL JOIN m ON b.product_id = m.product_id AND b.store_id = m.store_id""")
def _ledger(ws):
    return ds.inventory_from_transactions(ws.transactions)


_CURRENT = """
SELECT product_id, store_id, stock_level, inventory_reorder_threshold, CAST(last_updated AS VARCHAR) last_updated, product_name,
 category, CAST(coalesce(cost_price, 0) AS DOUBLE) cost_price, CAST(coalesce(selling_price, 0) AS DOUBLE) selling_price,
 shelf_life_days, reorder_threshold, supplier_id, store_name, city, capacity FROM v_current"""


@query("enrich_inventory", _CURRENT)
def _enrich(ws):
    return ds.enrich_inventory(ws.inventory, ws.products, ws.stores)


@query("current_inventory", _CURRENT)
def _current(ws):
    return ws.current_inventory


@query("sales_summary", """
SELECT product_id, store_id, total_quantity_sold, total_revenue, CAST(last_sale_date AS VARCHAR) last_sale_date,
 product_total_quantity_sold, store_total_quantity_sold, recent_7_day_quantity_sold, recent_30_day_quantity_sold FROM v_summary""")
def _summary(ws):
    return ws.sales_summary


@query("product_performance", """
SELECT * REPLACE (CAST(last_sale_date AS VARCHAR) AS last_sale_date, CAST(cost_price AS DOUBLE) AS cost_price,
 CAST(selling_price AS DOUBLE) AS selling_price) FROM v_perf""")
def _perf(ws):
    return ws.product_performance


@query("store_inventory_summary", """
SELECT s.store_id, store_name, city, capacity, coalesce(t, 0) total_inventory, capacity - coalesce(t, 0) remaining_capacity,
 CASE WHEN capacity > 0 THEN coalesce(t, 0) / CAST(capacity AS DOUBLE) * 100 ELSE 0 END capacity_used_percent
FROM rt_stores s LEFT JOIN (SELECT store_id, CAST(sum(stock_level) AS BIGINT) t FROM v_current GROUP BY store_id) i ON i.store_id = s.store_id""")
def _store_summary(ws):
    return ws.store_inventory_summary


@query("inventory_quantity_cascade", """
SELECT CAST(sum(stock_level) AS BIGINT) inventory_quantity, 'inventory' quantity_source FROM rt_inventory""")
def _cascade(ws):
    return ds.inventory_quantity_cascade(ws.inventory, ws.transactions)


@query("ledger_quantity", """
SELECT CAST(sum(quantity) AS BIGINT) inventory_quantity, 'snapshot' quantity_source FROM rt_transactions
WHERE transaction_type = 'inventory_snapshot'""")
def _cascade_ledger(ws):
    return ds.inventory_quantity_cascade(ws.inventory.filter(F.lit(False)), ws.transactions)


@query("analysis_base", f"SELECT {_ANALYSIS}, total_quantity_sold FROM v_base")
def _base(ws):
    cols = [c for c in an.ANALYSIS_COLUMNS if c not in ("reason", "trigger", "evidence")]
    return ws.base.select(*cols, "total_quantity_sold")


_PICK = [c for c in an.ANALYSIS_COLUMNS if c != "evidence"]


@query("low_stock_items", f"""
SELECT {_ANALYSIS}, 'stock is at or below the configured reorder point' reason,
 'stock_level <= reorder_threshold_with_buffer_0_percent' "trigger",
 concat('stock=', stock_level, ', reorder_threshold=', effective_reorder_threshold) evidence FROM v_low""")
def _low(ws):
    return ws.low_stock


@query("stockout_risk_items", f"""
SELECT {_ANALYSIS}, 'current stock may not cover recent sales velocity' reason, 'days_of_stock_remaining <= 7' "trigger"
FROM v_stockout""")
def _stockout(ws):
    return ws.stockout.select(*_PICK)


@query("overstock_items", f"""
SELECT {_ANALYSIS}, 'stock is high compared with reorder point or sales velocity' reason,
 'stock >= reorder_threshold * 3 or days_of_stock_remaining >= 45' "trigger" FROM v_over""")
def _over(ws):
    return ws.overstock.select(*_PICK)


@query("dead_stock_candidates", f"""
SELECT {_ANALYSIS}, 'stock has low recent movement or may outlast shelf life' reason,
 'recent_30_day_quantity <= 0 or days_of_stock_remaining >= shelf_life_days * 1.0' "trigger" FROM v_dead""")
def _dead(ws):
    return ws.dead_stock.select(*_PICK)


@query("high_demand_items", f"""
SELECT {_ANALYSIS}, 'recent sales velocity is high relative to this dataset' reason,
 'recent_daily_sales_velocity >= percentile_0.75' "trigger" FROM v_high""")
def _high(ws):
    return ws.high_demand.select(*_PICK)


@query("slow_moving_items", f"""
SELECT {_ANALYSIS}, 'recent sales velocity is low relative to this dataset' reason,
 'recent_daily_sales_velocity <= percentile_0.25' "trigger" FROM v_slow""")
def _slow(ws):
    return ws.slow_moving.select(*_PICK)


_TAGGED = " UNION ALL ".join(
    f"SELECT '{name}' dataset, product_id, store_id, stock_level, recent_daily_sales_velocity, days_of_stock_remaining FROM {v}"
    for name, v in zip(an.ANALYZERS, ["v_low", "v_stockout", "v_over", "v_dead", "v_high", "v_slow"])
)


@query("inventory_analysis", _TAGGED)
def _analysis(ws):
    return an.inventory_analysis(ws.shared_base).select(
        "dataset", "product_id", "store_id", "stock_level", "recent_daily_sales_velocity", "days_of_stock_remaining"
    )
