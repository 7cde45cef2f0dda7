"""Streaming jobs over the given tables, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.plans.catalog import query
from stockloom.sources.star import StarTables
from stockloom.streaming import jobs


class StreamTables(StarTables):
    """The retail tables with order lines arriving as a stream; dimensions stay static."""

    def parquet(self, name):
        if name == "lineitem":
            return jobs.stream_table(self.spark, self.sf_dir, name)
        return super().parquet(name)

    @property
    def order_lines(self):
        return self.joined_lines()


def _events(ws):
    rows = jobs.stream_table(ws.spark, ws.sf_dir, "events")
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("value").cast("long").alias("quantity"),
        F.concat_ws("|", "user_id", "event_type").alias("alert_key"),
    )


def _sales(ws):
    sales = StreamTables(ws.spark, ws.sf_dir).sales
    return sales.select(F.col("date").cast("timestamp").alias("ts"), "product_id", "store_id", F.col("quantity_sold").alias("quantity"))


_WINDOW = ["window_start", "window_end"]


def _windows(source, keys, days, slide, origin):
    picked = "".join(f"{k}, " for k in keys)
    return f"""
SELECT strftime(s, '%Y-%m-%d 00:00:00') window_start, strftime(s + INTERVAL {days} DAY, '%Y-%m-%d 00:00:00') window_end, {picked}
 CAST(sum(quantity) AS BIGINT) quantity, count(*) row_count
FROM (SELECT *, unnest(generate_series(last - INTERVAL {days - slide} DAY, last, INTERVAL {slide} DAY)) s FROM (
  SELECT *, TIMESTAMP '{origin}' + INTERVAL ({slide}) DAY * CAST(floor(date_diff('second', TIMESTAMP '{origin}', ts) / ({slide} * 86400E0)) AS BIGINT) last FROM {source}) a) b
GROUP BY ALL"""


_SALES = "(SELECT CAST(date AS TIMESTAMP) ts, product_id, store_id, quantity_sold quantity FROM rt_sales)"


@query("stream_sales_velocity", f"SELECT *, quantity / 7E0 daily_velocity FROM ({_windows(_SALES, ['product_id', 'store_id'], 7, 1, '1970-01-01')}) v")
def _velocity(ws):
    return jobs.run_velocity(_sales(ws), ["product_id", "store_id"], 7)


@query("stream_store_velocity_30d", f"SELECT *, quantity / 30E0 daily_velocity FROM ({_windows(_SALES, ['store_id'], 30, 1, '1970-01-01')}) v")
def _store_velocity(ws):
    return jobs.run_upserts(jobs.sales_velocity(_sales(ws), ["store_id"], 30), [*_WINDOW, "store_id"])


@query("stream_sales_trend_daily", _windows(_SALES, [], 1, 1, "1970-01-01"))
def _daily(ws):
    return jobs.run_upserts(jobs.sales_trend(_sales(ws), "D"), _WINDOW)


@query("stream_sales_trend_weekly", _windows(_SALES, [], 7, 7, "1970-01-05"))
def _weekly(ws):
    return jobs.run_upserts(jobs.sales_trend(_sales(ws), "W"), _WINDOW)


@query("stream_new_alerts", "SELECT DISTINCT concat_ws('|', user_id, event_type) alert_key FROM events")
def _alerts(ws):
    return jobs.run_to_table(jobs.new_alerts(_events(ws)).select("alert_key"))


@query("stream_apply_orders", """
WITH RECURSIVE q AS (SELECT r.*, coalesce(i.stock_level, 0) stock_level, row_number() OVER (PARTITION BY r.product_id, r.store_id ORDER BY order_date, order_seq, line_seq, quantity) rn
 FROM rt_order_requests r LEFT JOIN rt_inventory i ON i.product_id = r.product_id AND i.store_id = r.store_id),
walk AS (SELECT *, quantity <= stock_level accepted, CASE WHEN quantity <= stock_level THEN stock_level - quantity ELSE stock_level END remaining_stock FROM q WHERE rn = 1
 UNION ALL SELECT q.*, q.quantity <= w.remaining_stock, CASE WHEN q.quantity <= w.remaining_stock THEN w.remaining_stock - q.quantity ELSE w.remaining_stock END
 FROM walk w JOIN q ON q.product_id = w.product_id AND q.store_id = w.store_id AND q.rn = w.rn + 1)
SELECT product_id, store_id, CAST(order_date AS VARCHAR) order_date, order_seq, line_seq, quantity, accepted, remaining_stock FROM walk""")
def _orders(ws):
    requests = StreamTables(ws.spark, ws.sf_dir).order_requests.withColumn("line_seq", F.col("line_seq").cast("long"))
    return jobs.run_to_table(jobs.apply_orders(requests, ws.inventory), store=jobs.ROCKSDB)


@query("stream_ledger", """
SELECT product_id, store_id, CAST(sum(CASE
  WHEN transaction_type IN ('purchase', 'restock', 'transfer_in', 'return', 'inventory_in') THEN quantity
  WHEN transaction_type IN ('sale', 'transfer_out', 'damage', 'waste', 'return_to_supplier') THEN -quantity ELSE 0 END) AS BIGINT) stock_level,
 CAST(max(date) AS VARCHAR) last_updated FROM rt_transactions GROUP BY product_id, store_id""")
def _ledger(ws):
    return jobs.ledger_stock(StreamTables(ws.spark, ws.sf_dir).transactions)
