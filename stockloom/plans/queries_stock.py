"""Queries over stock views, transfers and alternatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.operators import stock_views as sv, transfers as tr
from stockloom.plans.catalog import query
from stockloom.plans.oracle import view

view("v_vel", """
SELECT product_id, store_id, CAST(sum(quantity_sold) AS BIGINT) q30, sum(quantity_sold) / 30E0 vel FROM rt_sales
WHERE date >= (SELECT max(date) - 30 FROM rt_sales) GROUP BY product_id, store_id""")
view("v_inv", """
SELECT i.product_id, i.store_id, i.stock_level q, i.reorder_threshold inv_thr,
 CASE WHEN i.reorder_threshold > 0 THEN i.reorder_threshold ELSE coalesce(p.reorder_threshold, 0) END thr, p.product_name,
 p.category, p.supplier_id, p.cost_price, p.selling_price, s.store_name, s.city, s.capacity, u.supplier_name,
 coalesce(v.q30, 0) q30, coalesce(v.vel, 0) vel
FROM rt_inventory i LEFT JOIN rt_products p ON p.product_id = i.product_id LEFT JOIN rt_stores s ON s.store_id = i.store_id
LEFT JOIN rt_suppliers u ON u.supplier_id = p.supplier_id
LEFT JOIN v_vel v ON v.product_id = i.product_id AND v.store_id = i.store_id""")
view("v_alerts", """
SELECT product_id, product_name, category, store_id, store_name, city, supplier_id, supplier_name, q current_quantity,
 thr reorder_threshold, greatest(thr - q, 0) shortage_quantity,
 CAST(CASE WHEN vel > 0 THEN greatest(2 * thr - q, 0, trunc(thr + ceil(vel * 14) - q)) ELSE greatest(2 * thr - q, 0) END AS BIGINT)
  suggested_reorder_quantity, vel recent_daily_sales_velocity,
 CASE WHEN q <= 0 THEN 'High' WHEN thr <= 0 THEN 'Medium' WHEN q / CAST(thr AS DOUBLE) <= 0.5 THEN 'High' WHEN q < thr THEN 'Medium'
  ELSE 'Low' END priority
FROM v_inv WHERE q <= thr""")
view("v_status", """
SELECT *, CASE WHEN thr > 0 AND q >= 2 * thr THEN 'Overstock' WHEN q <= thr THEN 'Low Stock'
  WHEN vel <= 0.2E0 AND q >= 1.5E0 * thr AND thr > 0 THEN 'Overstock' ELSE 'Healthy' END stock_status FROM v_inv""")
view("v_view", """
SELECT product_id, store_id, q current_quantity, inv_thr inventory_reorder_threshold, thr reorder_threshold, product_name, category,
 supplier_id, supplier_name, store_name, city, capacity, CAST(cost_price AS DOUBLE) cost_price, CAST(selling_price AS DOUBLE) selling_price,
 q30 recent_30_day_quantity_sold, vel recent_daily_sales_velocity, q * selling_price value_dec,
 CAST(q * selling_price AS DOUBLE) estimated_inventory_value, CAST(q * cost_price AS DOUBLE) cost_inventory_value,
 greatest(thr - q, 0) shortage_quantity, greatest(2 * thr - q, 0) suggested_reorder_quantity, greatest(q - thr, 0) surplus_quantity,
 stock_status, CASE WHEN q <= greatest(thr * 0.5E0, 0) THEN 'High' WHEN stock_status IN ('Low Stock', 'Overstock') THEN 'Medium' ELSE 'Low' END priority,
 CASE WHEN stock_status = 'Low Stock' THEN concat('Replenish ', product_name, '; shortage is ', greatest(thr - q, 0),
   ' units and suggested reorder is ', greatest(2 * thr - q, 0), ' units.')
  WHEN stock_status = 'Overstock' AND vel <= 0.2E0 THEN concat('Review ', product_name,
   ' for discount, clearance, or transfer; surplus is ', greatest(q - thr, 0), ' units with slow movement.')
  WHEN stock_status = 'Overstock' THEN concat('Consider transfer or promotion for ', product_name, '; surplus is ', greatest(q - thr, 0), ' units.')
  ELSE concat(product_name, ' is within a healthy stock range.') END advice
FROM v_status""")


@query("sales_velocity_30d", """
SELECT product_id, store_id, q30 recent_30_day_quantity_sold, vel recent_daily_sales_velocity FROM v_vel""")
def _velocity(ws):
    return sv.sales_velocity_30d(ws.sales)


@query("low_stock_alerts", "SELECT * FROM v_alerts")
def _alerts(ws):
    return ws.low_stock_alerts


_VIEW_COLUMNS = """product_id store_id current_quantity inventory_reorder_threshold reorder_threshold product_name category
 supplier_id supplier_name store_name city capacity cost_price selling_price recent_30_day_quantity_sold
 recent_daily_sales_velocity estimated_inventory_value cost_inventory_value shortage_quantity suggested_reorder_quantity
 surplus_quantity stock_status priority advice""".split()


@query("store_inventory_view", "SELECT * EXCLUDE (value_dec) FROM v_view")
def _view(ws):
    return ws.store_view.select(*_VIEW_COLUMNS)


_KPIS = """CAST(sum(current_quantity) AS BIGINT) total_quantity, count(DISTINCT product_id) product_count,
 count(*) FILTER (WHERE stock_status = 'Low Stock') low_stock_count, count(*) FILTER (WHERE stock_status = 'Overstock') overstock_count,
 count(*) FILTER (WHERE current_quantity > 0 AND recent_30_day_quantity_sold <= 0) slow_dead_count,
 CAST(sum(value_dec) AS DOUBLE) inventory_value"""


@query("store_kpis", f"SELECT {_KPIS} FROM v_view")
def _kpis(ws):
    return sv.store_kpis(ws.store_view)


@query("store_kpis_by_store", f"SELECT store_id, {_KPIS} FROM v_view GROUP BY store_id")
def _kpis_by_store(ws):
    return sv.store_kpis(ws.store_view, ["store_id"])


@query("store_kpis_one_store", f"SELECT {_KPIS} FROM v_view WHERE store_id = 'S3'")
def _kpis_one(ws):
    return sv.store_kpis(sv.for_store(ws.store_view, "S3"))


@query("understock_items", """
SELECT product_id, store_id, priority, shortage_quantity, suggested_reorder_quantity, advice FROM v_view WHERE stock_status = 'Low Stock'""")
def _understock(ws):
    return sv.understock_items(ws.store_view).select(
        "product_id", "store_id", "priority", "shortage_quantity", "suggested_reorder_quantity", "advice"
    )


@query("view_overstock_items", """
SELECT product_id, store_id, priority, surplus_quantity, CASE WHEN recent_daily_sales_velocity <= 0.2E0
 THEN 'Discount / clearance review' ELSE 'Transfer or promotion' END suggested_action, advice FROM v_view WHERE stock_status = 'Overstock'""")
def _overstock(ws):
    return sv.overstock_rows(ws.store_view).select(
        "product_id", "store_id", "priority", "surplus_quantity", "suggested_action", "advice"
    )


@query("store_comparison", """
SELECT store_id, store_name, city, CAST(sum(current_quantity) AS BIGINT) inventory_quantity, count(DISTINCT product_id) product_count,
 count(*) FILTER (WHERE stock_status = 'Low Stock') low_stock_count, count(*) FILTER (WHERE stock_status = 'Overstock') overstock_count,
 CAST(sum(value_dec) AS DOUBLE) inventory_value FROM v_view GROUP BY store_id, store_name, city""")
def _comparison(ws):
    return sv.store_comparison(ws.store_view)


_CAT = """CAST(sum(current_quantity) AS BIGINT) inventory_quantity, CAST(sum(value_dec) AS DOUBLE) inventory_value,
 count(DISTINCT product_id) product_count"""


@query("category_summary", f"SELECT category, {_CAT} FROM v_view GROUP BY category")
def _category(ws):
    return sv.category_summary(ws.store_view)


@query("category_summary_by_store", f"SELECT store_name, category, {_CAT} FROM v_view GROUP BY store_name, category")
def _category_store(ws):
    return sv.category_summary(ws.store_view, by_store=True)


@query("status_counts", "SELECT stock_status, count(*) row_count FROM v_view GROUP BY stock_status")
def _status(ws):
    return sv.status_counts(ws.store_view)


@query("top_stock", """
SELECT product_id, store_id, product_name, current_quantity FROM v_view
ORDER BY current_quantity DESC, product_name, store_id LIMIT 10""")
def _top(ws):
    return sv.top_bottom_stock(ws.store_view, False).select("product_id", "store_id", "product_name", "current_quantity")


@query("bottom_stock", """
SELECT product_id, store_id, product_name, current_quantity FROM v_view
ORDER BY current_quantity, product_name, store_id LIMIT 10""")
def _bottom(ws):
    return sv.top_bottom_stock(ws.store_view, True).select("product_id", "store_id", "product_name", "current_quantity")


@query("inventory_distribution", """
SELECT category, CAST(sum(q) AS BIGINT) stock_level FROM v_inv WHERE category IS NOT NULL GROUP BY category""")
def _distribution(ws):
    return sv.inventory_distribution(ws.inventory, ws.products)


@query("inventory_table", """
SELECT product_name, category, store_name, city, current_quantity, reorder_threshold, stock_status, priority FROM v_view""")
def _table(ws):
    return sv.inventory_table(ws.store_view).select(
        "product_name", "category", "store_name", "city", "current_quantity", "reorder_threshold", "stock_status", "priority"
    )


# --- transfers --------------------------------------------------------------------------------

view("v_ta", """
SELECT *, target_short + vel * 3 + CASE WHEN dleft <= 7 THEN 10 ELSE 0 END shortage_score,
 surplus + CASE WHEN vel <= 1 THEN 5 ELSE 0 END + CASE WHEN dleft >= 30 THEN 5 ELSE 0 END surplus_score FROM (
SELECT product_id, store_id, product_name, category, store_name, city, q stock_level, inv_thr, q30, vel,
 CASE WHEN vel > 0 THEN q / vel ELSE 999E0 END dleft, greatest(inv_thr - q, 0) short, inv_thr + vel * 7 target_level,
 greatest(inv_thr + vel * 7 - q, 0E0) target_short, greatest(q - (inv_thr + vel * 14), 0E0) surplus FROM v_inv) t""")
view("v_short", "SELECT * FROM v_ta WHERE target_short > 0 OR stock_level <= inv_thr OR (dleft <= 7 AND vel > 0)")
view("v_surp", "SELECT * FROM v_ta WHERE surplus > 0 AND stock_level > inv_thr")
view("v_opp", """
SELECT t.product_id, t.product_name, t.category, s.store_id source_store_id, s.store_name source_store_name, s.city source_city,
 t.store_id target_store_id, t.store_name target_store_name, t.city target_city,
 CAST(least(round_even(greatest(t.short, t.target_short), 0), round_even(s.surplus, 0)) AS BIGINT) suggested_quantity,
 CASE WHEN t.stock_level <= t.inv_thr OR t.dleft <= 7 THEN 'High' ELSE 'Medium' END priority, s.stock_level source_stock,
 CAST(round_even(s.surplus, 0) AS BIGINT) source_surplus, round_even(s.vel * 100, 0) / 100 source_velocity, t.stock_level target_stock,
 t.inv_thr target_threshold, round_even(t.vel * 100, 0) / 100 target_velocity, round_even(t.dleft * 10, 0) / 10 target_days_remaining,
 round_even((t.shortage_score + s.surplus_score) * 100, 0) / 100 opportunity_score
FROM v_short t JOIN LATERAL (SELECT * FROM v_surp s WHERE s.product_id = t.product_id AND s.store_id <> t.store_id
 ORDER BY surplus_score DESC, surplus DESC, store_id LIMIT 1) s ON true
WHERE least(round_even(greatest(t.short, t.target_short), 0), round_even(s.surplus, 0)) > 0""")
_TA = """product_id, store_id, stock_level, inv_thr reorder_threshold, q30 recent_30_day_quantity_sold,
 vel recent_daily_sales_velocity, dleft days_of_inventory_remaining, short shortage_quantity, target_level target_stock_level,
 target_short target_shortage_quantity, surplus surplus_quantity, shortage_score, surplus_score"""
_TA_COLUMNS = """product_id store_id stock_level reorder_threshold recent_30_day_quantity_sold recent_daily_sales_velocity
 days_of_inventory_remaining shortage_quantity target_stock_level target_shortage_quantity surplus_quantity shortage_score
 surplus_score""".split()


@query("transfer_analysis", f"SELECT {_TA} FROM v_ta")
def _ta(ws):
    return ws.transfer_analysis.select(*_TA_COLUMNS)


@query("shortages", f"SELECT {_TA} FROM v_short")
def _shortages(ws):
    return tr.shortages(ws.transfer_analysis).select(*_TA_COLUMNS)


@query("surpluses", f"SELECT {_TA} FROM v_surp")
def _surpluses(ws):
    return tr.surpluses(ws.transfer_analysis).select(*_TA_COLUMNS)


@query("top_shortages", f"SELECT {_TA} FROM v_short ORDER BY shortage_score DESC, vel DESC, product_id, store_id LIMIT 5")
def _top_short(ws):
    return tr.top_shortages(ws.transfer_analysis).select(*_TA_COLUMNS)


@query("top_surpluses", f"SELECT {_TA} FROM v_surp ORDER BY surplus_score DESC, surplus DESC, product_id, store_id LIMIT 5")
def _top_surplus(ws):
    return tr.top_surpluses(ws.transfer_analysis).select(*_TA_COLUMNS)


@query("transfer_opportunities", "SELECT * FROM v_opp")
def _opportunities(ws):
    return ws.opportunities


@query("top_transfer_opportunities", """
SELECT * FROM v_opp ORDER BY priority, opportunity_score DESC, suggested_quantity DESC, product_id, target_store_id LIMIT 5""")
def _top_opportunities(ws):
    return tr.top_opportunities(ws.opportunities)


view("v_excl", """
SELECT i.product_id, i.product_name, i.category, i.store_id exclusive_store_id, i.store_name exclusive_store_name, i.city,
 i.q available_quantity, CAST(i.selling_price AS DOUBLE) selling_price,
 concat(i.product_name, ' is available only at ', i.store_name, ' with ', i.q, ' units.') business_note,
 concat('Promote ', i.product_name, ' as an alternative ', i.category, ' option from ', i.store_name,
  ' when similar products are low elsewhere.') alternative_recommendation,
 (SELECT string_agg(store_name, ' | ' ORDER BY store_id) FROM rt_stores s WHERE s.store_id <> i.store_id) unavailable_store_names,
 n inventory_store_rows
FROM v_inv i JOIN (SELECT product_id, count(DISTINCT store_id) n FROM v_inv GROUP BY product_id
 HAVING count(DISTINCT CASE WHEN q > 0 THEN store_id END) = 1) e ON e.product_id = i.product_id
WHERE i.q > 0""")


@query("exclusive_items", "SELECT * FROM v_excl")
def _exclusive(ws):
    return ws.exclusive_items


@query("low_stock_scope", """
SELECT product_id, store_id, q stock_level, inv_thr effective_reorder_threshold FROM v_inv WHERE q <= inv_thr""")
def _scope(ws):
    return tr.low_stock_scope(ws.inventory, ws.products, ws.stores).select(
        "product_id", "store_id", "stock_level", "effective_reorder_threshold"
    )


view("v_cand", """
SELECT i.product_id, i.store_id, i.product_name, i.store_name, i.category, i.q available_quantity,
 e.product_id IS NOT NULL is_exclusive
FROM v_inv i LEFT JOIN v_excl e ON e.product_id = i.product_id AND e.exclusive_store_id = i.store_id WHERE i.q > 0""")


@query("alternative_candidates", "SELECT * FROM v_cand")
def _candidates(ws):
    return ws.alternative_candidates


# Low rows of one product see the same candidates, so the check ranks once per product.
view("v_alt_product", """
SELECT p.product_id low_product, c.*, row_number() OVER (PARTITION BY p.product_id
 ORDER BY is_exclusive DESC, available_quantity DESC, c.product_name, c.store_id) rn
FROM (SELECT DISTINCT product_id, category FROM v_low) p JOIN v_cand c ON c.category = p.category AND c.product_id <> p.product_id
QUALIFY rn <= 3""")
_ALT = """l.product_id low_stock_product_id, l.product_name low_stock_product, l.store_id low_stock_store_id,
 l.store_name low_stock_store, a.product_id alternative_product_id, a.product_name alternative_product, a.store_id alternative_store_id,
 a.store_name alternative_store, a.available_quantity, l.category, a.is_exclusive,
 CASE WHEN a.is_exclusive THEN concat(a.product_name, ' is exclusively available at ', a.store_name, ' with ', a.available_quantity, ' units.')
  ELSE concat(a.product_name, ' is available in the same ', l.category, ' category at ', a.store_name, '.') END reason,
 CASE WHEN a.is_exclusive THEN 'high' ELSE 'medium' END priority"""


# The whole relation, counted pair by pair: low rows of one product share their alternatives.
@query("alternative_products", """
SELECT l.product_id low_stock_product_id, l.product_name low_stock_product, l.store_id low_stock_store_id, l.store_name low_stock_store,
 l.category, coalesce(n, 0) alternative_total, coalesce(e, 0) exclusive_total, coalesce(d, 0) alternative_product_total
FROM v_low l LEFT JOIN (SELECT p.product_id, count(*) n, count(*) FILTER (WHERE is_exclusive) e, count(DISTINCT c.product_id) d
 FROM (SELECT DISTINCT product_id, category FROM v_low) p JOIN v_cand c ON c.category = p.category AND c.product_id <> p.product_id
 GROUP BY p.product_id) t ON t.product_id = l.product_id""")
def _all_alternatives(ws):
    return tr.alternative_products(ws.low_stock, ws.alternative_candidates)


@query("top_alternative_products", f"SELECT {_ALT} FROM v_low l JOIN v_alt_product a ON a.low_product = l.product_id")
def _alternatives(ws):
    return tr.top_alternative_products(ws.low_stock, ws.alternative_candidates, 3)


view("v_surplus_stock", """
SELECT product_id, product_name, category, store_id, store_name, city, q current_quantity, thr reorder_threshold,
 q - thr surplus_quantity, CASE WHEN q / CAST(thr AS DOUBLE) >= 3 THEN 'High' ELSE 'Medium' END opportunity_level,
 CASE WHEN q / CAST(thr AS DOUBLE) >= 3 THEN 'High' ELSE 'Medium' END priority,
 concat(product_name, ' has ', q, ' units at ', store_name, ', above the ', thr, ' unit threshold.') reason
FROM v_inv WHERE thr > 0 AND q >= 2 * thr""")


@query("surplus_stock", "SELECT * FROM v_surplus_stock")
def _surplus_stock(ws):
    return ws.surplus_stock


view("v_avail", """
WITH healthy AS (SELECT * FROM v_inv WHERE q > 0 AND (thr <= 0 OR q >= 2 * thr)),
opt AS (SELECT p.product_id low_product, h.product_name, h.store_name, h.q, row_number() OVER (PARTITION BY p.product_id
  ORDER BY h.q DESC, h.product_name, h.store_id) rn
 FROM (SELECT DISTINCT product_id, category FROM v_alerts) p JOIN healthy h ON h.category = p.category AND h.product_id <> p.product_id
 QUALIFY rn <= 3)
SELECT a.product_name low_stock_product, a.store_name low_stock_store, s.product_name alternative_product, s.store_name alternative_store,
 s.current_quantity available_quantity, 'same_product_transfer' alternative_type,
 concat('Consider transferring ', a.product_name, ' from ', s.store_name, ' to ', a.store_name, '.') suggested_action,
 concat(s.store_name, ' has surplus ', a.product_name, ' with ', s.current_quantity, ' units available.') reason
FROM v_alerts a JOIN v_surplus_stock s ON s.product_id = a.product_id AND s.store_id <> a.store_id
UNION ALL
SELECT a.product_name, a.store_name, o.product_name, o.store_name, o.q, 'category_alternative',
 concat('Offer ', o.product_name, ' from ', o.store_name, ' as an alternative to ', a.product_name, '.'),
 concat(o.product_name, ' has strong stock in the same ', a.category, ' category.')
FROM v_alerts a JOIN opt o ON o.low_product = a.product_id""")


@query("alternative_availability", "SELECT * FROM v_avail")
def _availability(ws):
    return ws.alternative_availability


@query("surplus_alert_text", """
SELECT concat((SELECT count(*) FROM v_surplus_stock), ' items have surplus stock across ',
 (SELECT count(DISTINCT store_id) FROM v_surplus_stock), ' stores. ', low_stock_product, ' is low in ', low_stock_store, ', but ',
 available_quantity, ' units of ', alternative_product, ' are available at ', alternative_store, '.') alert_text
FROM (SELECT * FROM v_avail ORDER BY CASE alternative_type WHEN 'same_product_transfer' THEN 0 ELSE 1 END, available_quantity DESC,
 alternative_product, low_stock_product, low_stock_store, alternative_store LIMIT 1) t""")
def _alert_text(ws):
    return tr.surplus_alert_text(ws.surplus_stock, ws.alternative_availability)


view("v_imb", """
SELECT t.store_id, t.store_name, total_stock_level, coalesce(l, 0) low_stock_count, coalesce(o, 0) overstock_count,
 abs(coalesce(o, 0) - coalesce(l, 0)) imbalance_score
FROM (SELECT store_id, store_name, CAST(sum(stock_level) AS BIGINT) total_stock_level FROM v_current GROUP BY store_id, store_name) t
LEFT JOIN (SELECT store_id, count(*) l FROM v_low GROUP BY store_id) a ON a.store_id = t.store_id
LEFT JOIN (SELECT store_id, count(*) o FROM v_over GROUP BY store_id) b ON b.store_id = t.store_id""")


@query("store_imbalance", "SELECT * FROM v_imb")
def _imbalance(ws):
    return tr.store_imbalance(ws.current_inventory, ws.low_stock, ws.overstock)


@query("store_imbalance_summary", """
SELECT count(*) store_count, count(*) FILTER (WHERE imbalance_score > 0) imbalanced_store_count,
 count(*) FILTER (WHERE low_stock_count > 0) stores_with_low_stock, count(*) FILTER (WHERE overstock_count > 0) stores_with_overstock
FROM v_imb""")
def _imbalance_summary(ws):
    return tr.imbalance_summary(tr.store_imbalance(ws.current_inventory, ws.low_stock, ws.overstock))
