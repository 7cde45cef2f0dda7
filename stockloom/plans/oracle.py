"""Plain SQL definitions for the checks, written apart from the DataFrame code.

`compose` prefixes a query with the named views it mentions, so that each
check is one self-contained statement over the given tables.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
_WORD = re.compile(r"[a-z_][a-z0-9_]*")


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip().rstrip(";")


def compose(sql: str) -> str:
    order: list[str] = []

    def need(text: str) -> None:
        for word in dict.fromkeys(_WORD.findall(text)):
            if word in VIEWS and word not in order:
                need(VIEWS[word])
                if word not in order:
                    order.append(word)

    need(sql)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


# --- retail tables over the star schema -----------------------------------------------------

view("rt_stores", """
SELECT concat('S', n_nationkey) store_id, n_name store_name, r_name city,
 CAST(45000 + 5000 * (n_nationkey % 7) AS BIGINT) capacity
FROM nation JOIN region ON n_regionkey = r_regionkey""")
view("rt_suppliers", """
SELECT concat('SUP', s_suppkey) supplier_id, s_name supplier_name, CAST(1 + s_suppkey % 6 AS BIGINT) avg_delivery_days,
 (80 + s_suppkey % 20) / 100.0E0 reliability_score
FROM supplier""")
view("rt_products", """
SELECT concat('P', p_partkey) product_id, concat(p_name, ' ', p_partkey) product_name, p_brand category,
 CAST(floor(p_retailprice * 70E0) / 100E0 AS DECIMAL(12,2)) cost_price, CAST(p_retailprice AS DECIMAL(12,2)) selling_price,
 CAST(p_size AS BIGINT) shelf_life_days, CAST(5 + p_partkey % 26 AS BIGINT) reorder_threshold, concat('SUP', ps) supplier_id
FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) ps FROM lineitem GROUP BY l_partkey) m ON p_partkey = l_partkey""")
view("rt_lines", """
SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
view("rt_sales", """
SELECT concat('SALE', l_orderkey) sale_id, CAST(l_shipdate AS DATE) date, concat('P', l_partkey) product_id,
 concat('S', c_nationkey) store_id, CAST(l_quantity AS BIGINT) quantity_sold,
 CAST(floor(l_extendedprice * 100E0 / l_quantity) / 100E0 AS DECIMAL(12,2)) selling_price
FROM rt_lines""")
view("rt_inventory", """
SELECT concat('P', pk) product_id, concat('S', nk) store_id,
 CAST(CASE WHEN pk % 10 = 0 AND nk <> mn THEN 0 ELSE (pk * 7 + nk * 13) % 97 END AS BIGINT) stock_level,
 CAST(CASE WHEN (pk + nk) % 3 = 0 THEN 0 ELSE 5 + (pk + 2 * nk) % 26 END AS BIGINT) reorder_threshold,
 CAST('2001-11-04' AS DATE) last_updated
FROM (SELECT pk, nk, min(nk) OVER (PARTITION BY pk) mn FROM
 (SELECT DISTINCT l_partkey pk, c_nationkey nk FROM rt_lines) k) t""")
view("rt_transactions", """
SELECT concat('TXN', l_orderkey, '-', l_linenumber) transaction_id, CAST(l_shipdate AS DATE) date,
 CASE WHEN CAST(l_shipdate AS DATE) = CAST('1998-06-01' AS DATE) THEN 'inventory_snapshot'
  WHEN l_linenumber = 1 THEN 'purchase' WHEN l_linenumber = 2 THEN 'transfer_in' WHEN l_linenumber = 3 THEN 'transfer_out'
  WHEN l_linenumber = 4 THEN 'damage' WHEN l_linenumber = 5 THEN 'procurement' WHEN l_returnflag = 'R' THEN 'return'
  ELSE 'sale' END transaction_type,
 concat('P', l_partkey) product_id, concat('S', c_nationkey) store_id, CAST(l_quantity AS BIGINT) quantity,
 'synthetic' source, l_linestatus remarks
FROM rt_lines""")
view("rt_decisions", """
SELECT event_id decision_seq, printf('REC%05d', 1 + CASE WHEN event_id % 10 < 5 THEN event_id // 5 * 7919 % greatest(o + a, 1)
  ELSE event_id // 5 * 7919 % greatest(o, 1) + CASE WHEN event_id // 5 * 7919 % greatest(o, 1) >= f THEN a ELSE 0 END END) recommendation_id, ts decided_at,
 CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'approved' END decision,
 CASE event_type WHEN 'purchase' THEN 'worked' WHEN 'signup' THEN 'improved sales' WHEN 'view' THEN 'executed'
  WHEN 'click' THEN 'ineffective' ELSE 'failed' END outcome_status
FROM events, (SELECT count(*) FILTER (WHERE recommendation_type <> 'alternative_option') o, count(*) FILTER (WHERE recommendation_type = 'alternative_option') a,
 count(*) FILTER (WHERE recommendation_type IN ('discount', 'clearance', 'transfer', 'exclusive_availability')) f FROM r_agents) n""")
view("rt_order_requests", """
SELECT CAST(l_shipdate AS DATE) order_date, l_orderkey order_seq, CAST(l_linenumber AS BIGINT) line_seq,
 concat('P', l_partkey) product_id, concat('S', c_nationkey) store_id, CAST(l_quantity AS BIGINT) quantity
FROM rt_lines""")
view("rt_questions", """
SELECT event_id question_id, CASE event_id % 41
 WHEN 0 THEN concat('Top 5 selling products in NATION_', user_id % 25)
 WHEN 1 THEN concat('Which items are low stock in NATION_', user_id % 25, '?')
 WHEN 2 THEN 'Show transfer opportunities'
 WHEN 3 THEN 'Which products are exclusively available?'
 WHEN 4 THEN 'What alternatives can we offer instead'
 WHEN 5 THEN 'Riskiest supplier?'
 WHEN 6 THEN concat('least sold Brand#', 1 + user_id % 25, ' products')
 WHEN 7 THEN concat('Total inventory for S', user_id % 25)
 WHEN 8 THEN 'why'
 WHEN 9 THEN 'hello there'
 WHEN 10 THEN 'any good movies'
 WHEN 11 THEN 'Any surplus stock today?'
 WHEN 12 THEN 'Category wise inventory please'
 WHEN 13 THEN 'Where is the highest inventory'
 WHEN 14 THEN concat('What is overstock in NATION_', user_id % 25)
 WHEN 15 THEN 'Show me understock rows'
 WHEN 16 THEN 'Why did the agent suggest this?'
 WHEN 17 THEN concat('Worst seling items in NATION_', user_id % 25)
 WHEN 18 THEN concat('worst selling in NATION_', user_id % 25 % 5)
 WHEN 19 THEN 'worst selling Brand#13'
 WHEN 20 THEN concat('Higest sold items in NATION_', user_id % 25 % 7)
 WHEN 21 THEN concat('highest solt in NATION_', user_id % 25 % 7)
 WHEN 22 THEN 'highest sold Brand#22'
 WHEN 23 THEN 'Compare the stores'
 WHEN 24 THEN concat('How does P', 1 + user_id % 25, ' perform?')
 WHEN 25 THEN concat('lowst 4 products by revenue for P', 1 + user_id % 25 % 9)
 WHEN 26 THEN 'highest sales in hyderabadd'
 WHEN 28 THEN 'Which branches have the highest shortage'
 WHEN 29 THEN 'Which branch has excess stock, top 3'
 WHEN 30 THEN concat('Extra stock of P', 10 + user_id % 25, ' in NATION_', user_id % 25 % 4)
 WHEN 31 THEN concat('Alternatives for P', 30 + user_id % 25)
 WHEN 32 THEN concat('alternative product in NATION_', 3 + user_id % 25 % 9)
 WHEN 33 THEN concat('Which supplier is riskiest for P', 40 + user_id % 25)
 WHEN 34 THEN concat('How much stock of P', 60 + user_id % 25, ' is in NATION_', 3 + user_id % 25 % 5)
 WHEN 35 THEN concat('Sales in NATION_', user_id % 25)
 WHEN 36 THEN 'top selling category by sales value today'
 WHEN 37 THEN concat('understock in NATION_', user_id % 25)
 WHEN 38 THEN concat('Category inventory in NATION_', user_id % 25)
 WHEN 39 THEN concat('Only available in NATION_', user_id % 25 % 6)
 WHEN 40 THEN 'fastest moving items in Asia'
 ELSE 'Lowest 3 items by revenue this week' END question
FROM events""")

# --- core datasets ---------------------------------------------------------------------------

view("v_current", """
SELECT i.product_id, i.store_id, i.stock_level, i.reorder_threshold AS inventory_reorder_threshold, i.last_updated,
 coalesce(p.product_name, '') product_name, coalesce(p.category, '') category, p.cost_price, p.selling_price,
 coalesce(p.shelf_life_days, 0) shelf_life_days, coalesce(p.reorder_threshold, 0) reorder_threshold,
 coalesce(p.supplier_id, '') supplier_id, coalesce(s.store_name, '') store_name, coalesce(s.city, '') city,
 coalesce(s.capacity, 0) capacity
FROM rt_inventory i LEFT JOIN rt_products p ON i.product_id = p.product_id LEFT JOIN rt_stores s ON i.store_id = s.store_id""")
view("v_pairs", """
SELECT product_id, store_id, CAST(sum(quantity_sold) AS BIGINT) total_quantity_sold,
 CAST(sum(quantity_sold * selling_price) AS DOUBLE) total_revenue, max(date) last_sale_date,
 CAST(coalesce(sum(quantity_sold) FILTER (WHERE date >= mx - 7), 0) AS BIGINT) recent_7_day_quantity_sold,
 CAST(coalesce(sum(quantity_sold) FILTER (WHERE date >= mx - 30), 0) AS BIGINT) recent_30_day_quantity_sold
FROM rt_sales, (SELECT max(date) mx FROM rt_sales) m GROUP BY product_id, store_id""")
view("v_summary", """
SELECT *, CAST(sum(total_quantity_sold) OVER (PARTITION BY product_id) AS BIGINT) product_total_quantity_sold,
 CAST(sum(total_quantity_sold) OVER (PARTITION BY store_id) AS BIGINT) store_total_quantity_sold
FROM v_pairs""")
view("v_perf", """
SELECT p.product_id, p.product_name, p.category, p.cost_price, p.selling_price, p.shelf_life_days, p.reorder_threshold,
 coalesce(p.supplier_id, '') supplier_id, coalesce(q, 0) total_quantity_sold, coalesce(r, 0) total_revenue,
 coalesce(q7, 0) recent_7_day_quantity_sold, coalesce(q30, 0) recent_30_day_quantity_sold, ld last_sale_date,
 coalesce(st, 0) current_stock_level, coalesce(u.supplier_name, '') supplier_name,
 coalesce(u.avg_delivery_days, 0) avg_delivery_days, coalesce(u.reliability_score, 0) reliability_score
FROM rt_products p
LEFT JOIN (SELECT product_id, CAST(sum(total_quantity_sold) AS BIGINT) q, CAST(sum(CAST(total_revenue AS DECIMAL(20,2))) AS DOUBLE) r,
  CAST(sum(recent_7_day_quantity_sold) AS BIGINT) q7, CAST(sum(recent_30_day_quantity_sold) AS BIGINT) q30, max(last_sale_date) ld
  FROM v_pairs GROUP BY product_id) s ON s.product_id = p.product_id
LEFT JOIN (SELECT product_id, CAST(sum(stock_level) AS BIGINT) st FROM v_current GROUP BY product_id) i ON i.product_id = p.product_id
LEFT JOIN rt_suppliers u ON u.supplier_id = p.supplier_id""")
view("v_base", """
SELECT b.*, CASE WHEN v > 0 THEN stock_level / v ELSE 0 END days_of_stock_remaining, v recent_daily_sales_velocity FROM (
 SELECT c.*, CASE WHEN inventory_reorder_threshold = 0 THEN reorder_threshold ELSE inventory_reorder_threshold END effective_reorder_threshold,
  coalesce(recent_7_day_quantity_sold, 0) recent_7_day_quantity_sold, coalesce(recent_30_day_quantity_sold, 0) recent_30_day_quantity_sold,
  last_sale_date, coalesce(total_quantity_sold, 0) total_quantity_sold,
  CASE WHEN coalesce(recent_7_day_quantity_sold, 0) = 0 THEN coalesce(recent_30_day_quantity_sold, 0) / 30E0
   ELSE recent_7_day_quantity_sold / 7E0 END v
 FROM v_current c LEFT JOIN v_pairs p ON c.product_id = p.product_id AND c.store_id = p.store_id) b""")
view("v_low", "SELECT * FROM v_base WHERE effective_reorder_threshold > 0 AND stock_level <= effective_reorder_threshold")
view("v_stockout", """
SELECT * FROM v_base WHERE stock_level > 0 AND recent_daily_sales_velocity > 0 AND days_of_stock_remaining <= 7""")
view("v_over", """
SELECT * FROM v_base WHERE (effective_reorder_threshold > 0 AND stock_level >= 3 * effective_reorder_threshold)
 OR (recent_daily_sales_velocity > 0 AND days_of_stock_remaining >= 45)""")
view("v_dead", """
SELECT * FROM v_base WHERE stock_level > 0 AND (recent_30_day_quantity_sold <= 0
 OR (shelf_life_days > 0 AND days_of_stock_remaining > 0 AND days_of_stock_remaining >= shelf_life_days))""")
view("v_high", """
SELECT * FROM v_base WHERE recent_daily_sales_velocity > 0 AND recent_daily_sales_velocity >=
 (SELECT quantile_cont(recent_daily_sales_velocity, 0.75) FROM v_base WHERE recent_daily_sales_velocity > 0)""")
view("v_slow", """
SELECT * FROM v_base WHERE stock_level > 0 AND (recent_daily_sales_velocity = 0 OR recent_daily_sales_velocity <=
 (SELECT quantile_cont(recent_daily_sales_velocity, 0.25) FROM v_base WHERE recent_daily_sales_velocity > 0))""")
