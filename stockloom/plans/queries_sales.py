"""Queries over sales analytics."""

from __future__ import annotations

from stockloom.operators import sales as sa
from stockloom.plans.catalog import query
from stockloom.plans.oracle import view

view("v_sd", """
SELECT s.sale_id, s.date, s.product_id, s.store_id, s.quantity_sold, s.selling_price, s.quantity_sold * s.selling_price sales_value,
 coalesce(t.store_name, s.store_id) store_name, coalesce(t.city, '') city, coalesce(p.product_name, s.product_id) product_name,
 coalesce(p.category, 'Uncategorized') category,
 CASE WHEN coalesce(t.city, '') <> '' THEN concat(t.city, ' - ', t.store_name) ELSE coalesce(t.store_name, s.store_id) END branch_label
FROM rt_sales s LEFT JOIN rt_stores t ON t.store_id = s.store_id LEFT JOIN rt_products p ON p.product_id = s.product_id""")
_M = """CAST(sum(quantity_sold) AS BIGINT) quantity_sold, CAST(sum(sales_value) AS DOUBLE) sales_value, count(DISTINCT sale_id) order_count"""
view("v_branch", f"SELECT store_id, branch_label, city, store_name, {_M} FROM v_sd GROUP BY ALL")
view("v_prod", f"SELECT product_id, product_name, category, {_M} FROM v_sd GROUP BY ALL")
view("v_catsales", """
SELECT category, CAST(sum(quantity_sold) AS BIGINT) quantity_sold, CAST(sum(sales_value) AS DOUBLE) sales_value FROM v_sd GROUP BY category""")
view("v_pvel", f"""
SELECT *, quantity_sold / 30E0 daily_sales_velocity FROM (SELECT product_id, product_name, category, {_M} FROM v_sd
WHERE date >= (SELECT max(date) - 30 FROM v_sd) GROUP BY ALL) t""")
view("v_bcmp", """
SELECT branch_label, sales_value total_sales, order_count, top_product, top_product_units, coalesce(low, 0) low_stock_risk FROM v_branch b
LEFT JOIN (SELECT store_id, product_name top_product, units top_product_units FROM (SELECT store_id, product_name,
  CAST(sum(quantity_sold) AS BIGINT) units, row_number() OVER (PARTITION BY store_id ORDER BY sum(quantity_sold) DESC, product_name) rn
  FROM v_sd GROUP BY store_id, product_name) r WHERE rn = 1) t ON t.store_id = b.store_id
LEFT JOIN (SELECT store_id, count(*) low FROM rt_inventory WHERE stock_level <= reorder_threshold GROUP BY store_id) l ON l.store_id = b.store_id""")


def _sd(ws):
    return sa.sales_dataset(ws.sales, ws.stores, ws.products)


@query("sales_dataset", """
SELECT sale_id, CAST(date AS VARCHAR) date, product_id, store_id, quantity_sold, CAST(selling_price AS DOUBLE) selling_price,
 CAST(sales_value AS DOUBLE) sales_value, store_name, city, product_name, category, branch_label FROM v_sd""")
def _dataset(ws):
    return _sd(ws)


_FILTERS = sa.SalesFilters(
    store_ids=("S1", "S2", "S3", "S7"), categories=("Brand#1", "Brand#2", "Brand#3"), start_date="1996-01-01",
    end_date="2001-10-31",
)


@query("filtered_sales", """
SELECT sale_id, CAST(date AS VARCHAR) date, product_id, store_id, category, quantity_sold FROM v_sd
WHERE store_id IN ('S1', 'S2', 'S3', 'S7') AND category IN ('Brand#1', 'Brand#2', 'Brand#3')
 AND date BETWEEN DATE '1996-01-01' AND DATE '2001-10-31'""")
def _filtered(ws):
    return sa.filtered_sales(_sd(ws), _FILTERS).select(
        "sale_id", "date", "product_id", "store_id", "category", "quantity_sold"
    )


@query("branch_options", "SELECT concat(city, ' - ', store_name) label, store_id, city, store_name FROM rt_stores")
def _options(ws):
    return sa.branch_options(ws.stores)


@query("overview_metrics", """
WITH t10 AS (SELECT * FROM v_prod ORDER BY quantity_sold DESC, sales_value DESC, product_id LIMIT 10),
d AS (SELECT date, sum(sales_value) v FROM v_sd GROUP BY date),
f AS (SELECT CAST(sum(v) AS DOUBLE) / count(*) m FROM (SELECT v FROM d ORDER BY date LIMIT 7) x),
l AS (SELECT CAST(sum(v) AS DOUBLE) / count(*) m, count(*) n FROM (SELECT v FROM d ORDER BY date DESC LIMIT 7) y)
SELECT (SELECT CAST(sum(sales_value) AS DOUBLE) FROM v_sd) total_sales, (SELECT count(DISTINCT sale_id) FROM v_sd) total_orders,
 (SELECT product_name FROM t10 ORDER BY quantity_sold DESC, sales_value DESC, product_id LIMIT 1) top_product,
 (SELECT product_name FROM t10 ORDER BY quantity_sold, product_name LIMIT 1) least_product,
 CASE WHEN l.n < 2 THEN 'Flat' WHEN l.m > f.m * 1.05E0 THEN 'Up' WHEN l.m < f.m * 0.95E0 THEN 'Down' ELSE 'Flat' END revenue_trend,
 (SELECT product_name FROM v_pvel ORDER BY daily_sales_velocity DESC, quantity_sold DESC, sales_value DESC, product_id LIMIT 1)
  fastest_moving_product
FROM f, l""")
def _overview(ws):
    sd = _sd(ws)
    return sa.overview_metrics(sd, sd)


@query("branch_sales_summary", "SELECT * FROM v_branch")
def _branch(ws):
    return sa.branch_sales_summary(_sd(ws))


@query("sales_trend_daily", f"SELECT CAST(d AS VARCHAR) date, quantity_sold, sales_value, order_count FROM (SELECT date d, {_M} FROM v_sd GROUP BY date) t")
def _daily(ws):
    return sa.sales_trend(_sd(ws), "D")


@query("sales_trend_weekly", f"""
SELECT CAST(CAST(d AS DATE) AS VARCHAR) date, quantity_sold, sales_value, order_count
FROM (SELECT date_trunc('week', date) d, {_M} FROM v_sd GROUP BY 1) t""")
def _weekly(ws):
    return sa.sales_trend(_sd(ws), "W")


@query("sales_product_performance", "SELECT * FROM v_prod ORDER BY quantity_sold DESC, sales_value DESC, product_id LIMIT 10")
def _products(ws):
    return sa.sales_product_performance(_sd(ws))


@query("product_sales", "SELECT * FROM v_prod")
def _product_sales(ws):
    return sa.product_sales(_sd(ws))


@query("category_sales", "SELECT * FROM v_catsales")
def _categories(ws):
    return sa.category_sales(_sd(ws))


@query("product_velocity", "SELECT * FROM v_pvel")
def _velocity(ws):
    sd = _sd(ws)
    return sa.product_velocity(sd, sd)


@query("inventory_sales_comparison", """
SELECT v.*, coalesce(st, 0) stock_level, coalesce(th, 0) reorder_threshold, coalesce(st, 0) / daily_sales_velocity days_of_stock_remaining
FROM v_pvel v LEFT JOIN (SELECT product_id, CAST(sum(stock_level) AS BIGINT) st, CAST(sum(reorder_threshold) AS BIGINT) th
 FROM rt_inventory WHERE store_id IN (SELECT store_id FROM v_sd) GROUP BY product_id) i ON i.product_id = v.product_id
ORDER BY daily_sales_velocity DESC, sales_value DESC, v.product_id LIMIT 12""")
def _inv_sales(ws):
    return sa.inventory_sales_comparison(_sd(ws), ws.inventory)


@query("branch_comparison", "SELECT * FROM v_bcmp")
def _bcmp(ws):
    return sa.branch_comparison(_sd(ws), ws.inventory)


@query("sales_insights", """
SELECT CAST(0 AS BIGINT) "position", concat((SELECT store_name FROM v_branch ORDER BY sales_value DESC, store_id LIMIT 1),
 ' currently shows the strongest sales activity, especially in ',
 (SELECT category FROM v_catsales ORDER BY sales_value DESC, category LIMIT 1), ' products.') insight
UNION ALL SELECT 1, (SELECT concat(product_name, ' is the fastest seller in the selected scope with ', format('{:,}', quantity_sold), ' units sold.')
 FROM v_prod ORDER BY quantity_sold DESC, sales_value DESC, product_id LIMIT 1)
UNION ALL SELECT 2, (SELECT concat(product_name, ' has slower movement and may need pricing, placement, or reorder review.')
 FROM v_prod ORDER BY quantity_sold, product_name LIMIT 1)
UNION ALL SELECT 3, (SELECT concat(branch_label, ' has ', low_stock_risk, ' low-stock risk items while serving active demand.')
 FROM v_bcmp ORDER BY low_stock_risk DESC, branch_label LIMIT 1)""")
def _insights(ws):
    sd = _sd(ws)
    return sa.sales_insights(sd, sd, sa.branch_comparison(sd, ws.inventory))


@query("time_scope_last_7_days", """
SELECT sale_id, CAST(date AS VARCHAR) date, product_id, store_id, quantity_sold FROM rt_sales
WHERE date >= (SELECT max(date) - 6 FROM rt_sales)""")
def _scope7(ws):
    return sa.in_time_scope(ws.sales, "last_7_days").select("sale_id", "date", "product_id", "store_id", "quantity_sold")


@query("time_scope_today", """
SELECT sale_id, CAST(date AS VARCHAR) date, product_id, store_id, quantity_sold FROM rt_sales
WHERE date = (SELECT max(date) FROM rt_sales)""")
def _today(ws):
    return sa.in_time_scope(ws.sales, "today").select("sale_id", "date", "product_id", "store_id", "quantity_sold")
