"""Queries over recommendations, agents and tool summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.operators import analyzers as an, recommend as rc, tools as tl
from stockloom.plans.catalog import query
from stockloom.plans.oracle import view

_BLANK_ALT = "'' alternative_product_id, '' alternative_product_name, '' alternative_store_id, '' alternative_store_name"
_NO_AVAILABLE = "CAST(NULL AS BIGINT) available_quantity"
_NO_QTY = "CAST(NULL AS BIGINT) suggested_quantity"
_COVER = """CASE WHEN days_of_stock_remaining <= 3 THEN 'high' WHEN days_of_stock_remaining <= 7 THEN 'medium' ELSE 'low' END priority"""

view("r_reorder", f"""
SELECT 'reorder' recommendation_type, product_id, product_name, store_id, '' store_name, {_BLANK_ALT}, {_NO_AVAILABLE}, {_COVER},
 concat('Reorder ', n, ' units.') "action", 'Stock is below the reorder point after recent demand is considered.' reason,
 concat('stock=', stock_level, ', reorder_threshold=', effective_reorder_threshold) evidence, n suggested_quantity
FROM (SELECT *, CAST(round_even(effective_reorder_threshold + recent_daily_sales_velocity * 7 - stock_level, 0) AS BIGINT) n FROM v_low) t
WHERE n > 0""")
view("r_source", """
SELECT * FROM (SELECT product_id, store_id, store_name, s, row_number() OVER (PARTITION BY product_id ORDER BY s DESC, store_id) rn
 FROM (SELECT *, stock_level - 1.5E0 * CASE WHEN inventory_reorder_threshold = 0 THEN reorder_threshold ELSE inventory_reorder_threshold END s
  FROM v_current) a WHERE s > 0) b WHERE rn = 1""")
view("r_transfer", f"""
SELECT 'transfer' recommendation_type, l.product_id, l.product_name, l.store_id, l.store_name, {_BLANK_ALT}, {_NO_AVAILABLE},
 'medium' priority, concat('Transfer ', n, ' units from ', s.store_id, ' to ', l.store_id, '.') "action",
 'One store is below reorder point while another store has surplus stock.' reason,
 concat('source_store=', s.store_name, ', source_store_id=', s.store_id, ', destination_store=', l.store_name, ', destination_store_id=',
  l.store_id, ', source_surplus=', s.s, ', destination_stock=', CAST(l.stock_level AS DOUBLE), ', destination_threshold=',
  CAST(l.effective_reorder_threshold AS DOUBLE)) evidence, n suggested_quantity
FROM v_low l JOIN r_source s ON s.product_id = l.product_id AND s.store_id <> l.store_id,
 LATERAL (SELECT least(l.effective_reorder_threshold - l.stock_level, CAST(round_even(s.s, 0) AS BIGINT)) n) q
WHERE n > 0""")
view("r_exclusive", f"""
SELECT 'exclusive_availability' recommendation_type, product_id, product_name, exclusive_store_id store_id, exclusive_store_name store_name,
 {_BLANK_ALT}, available_quantity, 'medium' priority,
 concat('Promote ', product_name, ' as exclusively available at ', exclusive_store_name, ' with ', available_quantity, ' units.') "action",
 business_note reason, concat('category=', category, ', exclusive_store=', exclusive_store_name, ', exclusive_store_id=', exclusive_store_id,
  ', available_quantity=', available_quantity, ', unavailable_stores=', unavailable_store_names, ', unavailable_elsewhere=true') evidence,
 {_NO_QTY} FROM v_excl""")
view("r_every_alt", """
SELECT p.product_id low_product, c.*
FROM (SELECT DISTINCT product_id, category FROM v_low) p
JOIN (SELECT * FROM v_cand QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY is_exclusive DESC, available_quantity DESC,
 product_name, store_id) = 1) c ON c.category = p.category AND c.product_id <> p.product_id""")
view("r_alternative", f"""
SELECT 'alternative_option' recommendation_type, l.product_id, l.product_name, l.store_id, l.store_name,
 a.product_id alternative_product_id, a.product_name alternative_product_name, a.store_id alternative_store_id,
 a.store_name alternative_store_name, a.available_quantity, CASE WHEN is_exclusive THEN 'high' ELSE 'medium' END priority,
 concat('Offer ', a.product_name, ' from ', a.store_name, ' as an alternative to ', l.product_name, ' for ', l.store_name, '.') "action",
 concat(a.product_name, ' is', CASE WHEN is_exclusive THEN ' exclusively' ELSE '' END, ' available at ', a.store_name, ' with ',
  a.available_quantity, ' units in the same ', l.category, ' category.') reason,
 concat('low_stock_product=', l.product_name, ', low_stock_store=', l.store_name, ', alternative_product=', a.product_name,
  ', alternative_store=', a.store_name, ', category=', l.category, ', available_quantity=', a.available_quantity, ', is_exclusive=',
  CASE WHEN is_exclusive THEN 'True' ELSE 'False' END) evidence, {_NO_QTY}
FROM v_low l JOIN r_every_alt a ON a.low_product = l.product_id""")
view("r_discount", f"""
SELECT 'discount' recommendation_type, product_id, product_name, store_id, '' store_name, {_BLANK_ALT}, {_NO_AVAILABLE},
 'medium' priority, 'Consider a discount to improve sell-through.' "action",
 'Inventory coverage is high compared with recent sales velocity.' reason, {_NO_QTY}
FROM (SELECT product_id, product_name, store_id, days_of_stock_remaining FROM v_slow UNION
 SELECT product_id, product_name, store_id, days_of_stock_remaining FROM v_over) t WHERE days_of_stock_remaining >= 45""")
view("r_clearance", f"""
SELECT 'clearance' recommendation_type, product_id, product_name, store_id, '' store_name, {_BLANK_ALT}, {_NO_AVAILABLE},
 CASE WHEN shelf_life_days > 0 AND days_of_stock_remaining >= shelf_life_days THEN 'high' ELSE 'medium' END priority,
 'Plan clearance for the affected stock.' "action", 'Stock has weak recent movement or may exceed shelf life.' reason, {_NO_QTY}
FROM v_dead WHERE (shelf_life_days > 0 AND days_of_stock_remaining >= shelf_life_days) OR recent_30_day_quantity_sold = 0""")
view("r_supplier", f"""
SELECT 'supplier_risk_alert' recommendation_type, product_id, product_name, '' store_id, '' store_name, {_BLANK_ALT}, {_NO_AVAILABLE},
 CASE WHEN coalesce(u.reliability_score, 0) < 0.9E0 THEN 'high' ELSE 'medium' END priority,
 'Review supplier performance before placing the next replenishment order.' "action",
 'Supplier reliability or delivery time crosses the configured risk threshold.' reason,
 concat('supplier_id=', p.supplier_id, ', supplier_name=', coalesce(u.supplier_name, ''), ', reliability_score=',
  coalesce(u.reliability_score, 0E0), ', avg_delivery_days=', CAST(coalesce(u.avg_delivery_days, 0) AS DOUBLE)) evidence, {_NO_QTY}
FROM v_perf p LEFT JOIN rt_suppliers u ON u.supplier_id = p.supplier_id
WHERE coalesce(u.reliability_score, 0) < 0.9E0 OR coalesce(u.avg_delivery_days, 0) >= 4""")
view("r_overstock", f"""
SELECT 'overstock_alert' recommendation_type, product_id, product_name, store_id, '' store_name, {_BLANK_ALT}, {_NO_AVAILABLE},
 'medium' priority, 'Review replenishment and sell-through plan for this stock.' "action",
 'stock is high compared with reorder point or sales velocity' reason, {_NO_QTY} FROM v_over""")
view("r_stockout", f"""
SELECT 'stockout_prevention_alert' recommendation_type, product_id, product_name, store_id, '' store_name, {_BLANK_ALT}, {_NO_AVAILABLE},
 {_COVER}, 'Take replenishment action before projected stockout.' "action",
 'current stock may not cover recent sales velocity' reason, {_NO_QTY} FROM v_stockout""")

_VIEW_OF = dict(zip(rc.TYPE_ORDER, ["r_reorder", "r_transfer", "r_exclusive", "r_alternative", "r_discount", "r_clearance",
                                    "r_supplier", "r_overstock", "r_stockout"]))
_BASIC = """recommendation_type, product_id, product_name, store_id, store_name, alternative_product_id, alternative_product_name,
 alternative_store_id, alternative_store_name, available_quantity, priority, "action", reason, suggested_quantity"""
_BASIC_COLUMNS = [c.strip().strip('"') for c in _BASIC.split(",")]
_RANKED = " UNION ALL ".join(f"SELECT {i} type_rank, {_BASIC} FROM {_VIEW_OF[t]}" for i, t in enumerate(rc.TYPE_ORDER))
view("r_all", f"""
SELECT concat('REC', lpad(CAST(n AS VARCHAR), CAST(greatest(5, length(CAST(n AS VARCHAR))) AS INTEGER), '0')) recommendation_id, * EXCLUDE (n, type_rank) FROM (
 SELECT row_number() OVER (ORDER BY type_rank, product_id, store_id, alternative_product_id) n, * FROM ({_RANKED}) u) t""")

_TEXT_EVIDENCE = ("reorder", "transfer", "exclusive_availability", "alternative_option", "supplier_risk_alert")
_NAMES = {
    "reorder": "rec_reorder", "transfer": "rec_transfer", "exclusive_availability": "rec_exclusive",
    "alternative_option": "rec_alternative", "discount": "rec_discount", "clearance": "rec_clearance",
    "supplier_risk_alert": "rec_supplier_risk", "overstock_alert": "rec_overstock_alert",
    "stockout_prevention_alert": "rec_stockout_alert",
}


def _register_generator(kind: str) -> None:
    with_text = kind in _TEXT_EVIDENCE
    columns = _BASIC_COLUMNS + (["evidence"] if with_text else [])
    extra = ", evidence" if with_text else ""

    @query(_NAMES[kind], f"SELECT {_BASIC}{extra} FROM {_VIEW_OF[kind]}")
    def _generator(ws):
        return ws.records(kind).select(*columns)


for _kind in rc.TYPE_ORDER:
    _register_generator(_kind)


# As pairs, without the places that the records of a run have.
@query("all_alternative_records", f"SELECT {_BASIC}, evidence FROM r_alternative")
def _every_alternative(ws):
    return rc.all_alternatives(ws.low_stock, ws.alternative_candidates).select(*_BASIC_COLUMNS, "evidence")


@query("build_recommendations", f"SELECT recommendation_id, {_BASIC} FROM r_all")
def _build(ws):
    ws = ws.run
    return ws.recommendations.select("recommendation_id", *_BASIC_COLUMNS)


# --- agents -----------------------------------------------------------------------------------

view("v_supctx", """
SELECT p.product_id, p.supplier_id, u.supplier_name, u.reliability_score, u.avg_delivery_days,
 coalesce(u.reliability_score < 0.9E0 OR u.avg_delivery_days >= 4, false) supplier_is_risky
FROM v_perf p LEFT JOIN rt_suppliers u ON u.supplier_id = p.supplier_id""")
view("r_procurement", """
SELECT r.* REPLACE (CASE WHEN c.supplier_is_risky THEN 'high' ELSE r.priority END AS priority,
  CASE WHEN c.supplier_is_risky THEN 'Stock is below the reorder point and supplier risk may delay replenishment.' ELSE r.reason END AS reason,
  CASE WHEN c.supplier_is_risky THEN concat(r."action", ' Review supplier timing before placing the order.') ELSE r."action" END AS "action",
  concat(r.evidence, ', supplier_name=', coalesce(c.supplier_name, 'unknown'), ', reliability_score=', c.reliability_score,
   ', avg_delivery_days=', CAST(c.avg_delivery_days AS DOUBLE)) AS evidence)
FROM r_reorder r JOIN v_supctx c ON c.product_id = r.product_id""")
_AGENT_TYPES = [(a, t) for a, types in rc.AGENT_TYPES.items() for t in types]
_AGENT_UNION = " UNION ALL ".join(
    f"SELECT {i} type_rank, '{a}' source_agent, {_BASIC} FROM {'r_procurement' if t == 'reorder' else _VIEW_OF[t]}"
    for i, (a, t) in enumerate(_AGENT_TYPES)
)
view("r_agents", f"""
SELECT concat('REC', lpad(CAST(n AS VARCHAR), CAST(greatest(5, length(CAST(n AS VARCHAR))) AS INTEGER), '0')) recommendation_id, * EXCLUDE (n) FROM (
 SELECT row_number() OVER (ORDER BY type_rank, product_id, store_id, alternative_product_id) n, * EXCLUDE (type_rank)
 FROM ({_AGENT_UNION}) u) t""")


@query("supplier_context", "SELECT * FROM v_supctx")
def _context(ws):
    return ws.supplier_context


@query("procurement_recs", f"SELECT {_BASIC}, evidence, 'procurement_agent' source_agent FROM r_procurement")
def _procurement(ws):
    return ws.procurement_records.select(*_BASIC_COLUMNS, "evidence", "source_agent")


@query("standardize_recs", f"SELECT recommendation_id, source_agent, 'pending' status, {_BASIC} FROM r_agents")
def _standardized(ws):
    ws = ws.run
    return ws.agent_recommendations.select("recommendation_id", "source_agent", "status", *_BASIC_COLUMNS)


@query("sequential_ids", """
SELECT concat('SEQ', lpad(CAST(row_number() OVER (ORDER BY product_id, store_id) AS VARCHAR), 6, '0')) row_id, product_id, store_id
FROM rt_inventory""")
def _sequence(ws):
    from stockloom.functions.ids import sequential_ids

    return sequential_ids(ws.inventory.select("product_id", "store_id"), ["product_id", "store_id"], "SEQ", 6, "row_id")


@query("next_prefixed_ids", """
SELECT concat('SALE', lpad(CAST(m + row_number() OVER (ORDER BY store_id) AS VARCHAR), CAST(greatest(6, length(CAST(m AS VARCHAR))) AS INTEGER), '0')) sale_id,
 store_id FROM rt_stores, (SELECT max(CAST(replace(sale_id, 'SALE', '') AS BIGINT)) m FROM rt_sales) x""")
def _next_ids(ws):
    from stockloom.functions.ids import next_prefixed_ids

    return next_prefixed_ids(ws.stores.select("store_id"), ["store_id"], ws.sales, "sale_id", "SALE")


view("v_review", """
SELECT recommendation_id, outcome_status <> 'failed' keep_recommendation,
 CASE WHEN outcome_status = 'ineffective' THEN 'hold' WHEN outcome_status = 'worked' THEN 'clearance' END selected_strategy,
 CASE WHEN outcome_status = 'improved sales' THEN 'high' END priority
FROM (SELECT *, row_number() OVER (PARTITION BY recommendation_id ORDER BY decided_at DESC, decision_seq DESC) rn FROM rt_decisions) d WHERE rn = 1""")


@query("decision_overlay", """
SELECT r.recommendation_id, coalesce(d.selected_strategy, r.recommendation_type) recommendation_type, product_id, store_id,
 coalesce(d.priority, r.priority) priority, "action", reason
FROM r_agents r LEFT JOIN v_review d ON d.recommendation_id = r.recommendation_id
WHERE coalesce(keep_recommendation, true) AND coalesce(selected_strategy, '') <> 'hold'""")
def _overlay(ws):
    ws = ws.run
    status = F.col("outcome_status")
    latest = F.max_by("outcome_status", F.struct("decided_at", "decision_seq")).alias("outcome_status")
    text_null = F.lit(None).cast("string")
    review = ws.decisions.groupBy("recommendation_id").agg(latest).select(
        "recommendation_id",
        (status != "failed").alias("keep_recommendation"),
        F.when(status == "ineffective", "hold").when(status == "worked", "clearance").alias("selected_strategy"),
        F.when(status == "improved sales", "high").alias("priority"),
        text_null.alias("action"),
        text_null.alias("reason"),
        text_null.alias("evidence"),
    )
    return rc.decision_overlay(ws.agent_recommendations, review, joined_with=ws.joined_recommendations).select(
        "recommendation_id", "recommendation_type", "product_id", "store_id", "priority", "action", "reason"
    )


@query("candidate_context_pricing", """
WITH r AS (SELECT recommendation_type, product_id, store_id FROM r_discount UNION ALL SELECT recommendation_type, product_id, store_id FROM r_clearance)
SELECT r.*, CASE WHEN s.product_id IS NOT NULL THEN s.days_of_stock_remaining WHEN o.product_id IS NOT NULL THEN o.days_of_stock_remaining
  ELSE d.days_of_stock_remaining END days_of_stock_remaining,
 coalesce(s.recent_daily_sales_velocity, o.recent_daily_sales_velocity) recent_daily_sales_velocity,
 coalesce(d.recent_30_day_quantity_sold, s.recent_30_day_quantity_sold) recent_30_day_quantity_sold,
 coalesce(s.stock_level, o.stock_level, d.stock_level) stock_level, d.shelf_life_days
FROM r LEFT JOIN v_slow s ON s.product_id = r.product_id AND s.store_id = r.store_id
LEFT JOIN v_over o ON o.product_id = r.product_id AND o.store_id = r.store_id
LEFT JOIN v_dead d ON d.product_id = r.product_id AND d.store_id = r.store_id""")
def _pricing_context(ws):
    ws = ws.run
    recs = rc.union_all([ws.records("discount"), ws.records("clearance")])
    return rc.pricing_context(
        recs.select("recommendation_type", "product_id", "store_id"), ws.slow_moving, ws.overstock, ws.dead_stock
    )


@query("candidate_context_transfer", """
SELECT r.product_id, r.store_id, r.suggested_quantity, l.stock_level, l.effective_reorder_threshold, l.recent_daily_sales_velocity,
 l.days_of_stock_remaining FROM r_transfer r LEFT JOIN v_low l ON l.product_id = r.product_id AND l.store_id = r.store_id""")
def _transfer_context(ws):
    ws = ws.run
    recs = ws.records("transfer").select("product_id", "store_id", "suggested_quantity")
    return rc.transfer_context(recs, ws.low_stock)


@query("candidate_context_risk", """
WITH r AS (SELECT recommendation_type, product_id, store_id FROM r_supplier UNION ALL SELECT recommendation_type, product_id, store_id FROM r_overstock
 UNION ALL SELECT recommendation_type, product_id, store_id FROM r_stockout)
SELECT r.*, coalesce(s.days_of_stock_remaining, o.days_of_stock_remaining) days_of_stock_remaining,
 coalesce(s.recent_daily_sales_velocity, o.recent_daily_sales_velocity) recent_daily_sales_velocity,
 coalesce(s.stock_level, o.stock_level) stock_level, p.supplier_id, p.supplier_name, p.reliability_score, p.avg_delivery_days
FROM r LEFT JOIN v_stockout s ON s.product_id = r.product_id AND s.store_id = r.store_id
LEFT JOIN v_over o ON o.product_id = r.product_id AND o.store_id = r.store_id
LEFT JOIN v_perf p ON p.product_id = r.product_id""")
def _risk_context(ws):
    ws = ws.run
    recs = rc.union_all([ws.records(t) for t in rc.RISK_TYPES]).select("recommendation_type", "product_id", "store_id")
    return rc.risk_context(recs, ws.stockout, ws.overstock, ws.product_performance)


view("v_counts", """
SELECT 'low_stock_items' dataset, count(*) row_count FROM v_low UNION ALL SELECT 'stockout_risk_items', count(*) FROM v_stockout
UNION ALL SELECT 'overstock_items', count(*) FROM v_over UNION ALL SELECT 'high_demand_items', count(*) FROM v_high""")
view("v_n", """
SELECT max(row_count) FILTER (WHERE dataset = 'low_stock_items') low, max(row_count) FILTER (WHERE dataset = 'stockout_risk_items') so,
 max(row_count) FILTER (WHERE dataset = 'overstock_items') ov, max(row_count) FILTER (WHERE dataset = 'high_demand_items') hd FROM v_counts""")
view("v_agent_outputs", """
SELECT 'inventory_agent' agent_name, low + so + ov + hd finding_count, CASE WHEN so > 0 OR low > 0 THEN 'high'
  WHEN low + so + ov + hd > 0 THEN 'medium' ELSE 'info' END priority_level,
 concat(concat_ws('. ', CASE WHEN hd > 0 THEN concat(hd, ' high demand items') END, CASE WHEN low > 0 THEN concat(low, ' low stock items') END,
  CASE WHEN so > 0 THEN concat(so, ' stockout risks') END), '.') latest_insight FROM v_n
UNION ALL
SELECT source_agent, count(*), CASE WHEN count(*) FILTER (WHERE priority = 'high') > 0 THEN 'high'
  WHEN count(*) FILTER (WHERE priority = 'medium') > 0 THEN 'medium' ELSE 'low' END, min_by(reason, recommendation_id)
FROM r_agents GROUP BY source_agent""")


@query("agent_outputs", "SELECT * FROM v_agent_outputs")
def _agent_outputs(ws):
    ws = ws.run
    return rc.agent_outputs(ws.agent_digest, ws.analyzer_counts)


view("v_orchestrator", """
SELECT 'Healthy (12/12)' database_health, t total_recommendations, h high_priority_alerts,
 concat(low, ' low stock items. ', so, ' stockout risks. ', ov, ' overstock rows. ', hd, ' high demand items. ', t, ' active recommendations.') summary
FROM v_n, (SELECT count(*) t, count(*) FILTER (WHERE priority = 'high') h FROM r_agents) r""")


@query("orchestrator_summary", "SELECT * FROM v_orchestrator")
def _orchestrator(ws):
    ws = ws.run
    return rc.orchestrator_summary(ws.agent_digest, ws.analyzer_counts, ws.health)


@query("focus_products", "SELECT product_id FROM v_low UNION SELECT product_id FROM v_high")
def _focus(ws):
    ws = ws.run
    return rc.focus_products(ws.low_stock, ws.high_demand)


# --- tool summaries ---------------------------------------------------------------------------


@query("tool_inventory_data", """
SELECT count(*) row_count, CAST(sum(stock_level) AS DOUBLE) total_stock_level, count(DISTINCT store_id) store_count,
 count(DISTINCT product_id) product_count FROM v_current""")
def _tool_inventory(ws):
    return tl.inventory_data(ws.current_inventory)


@query("tool_inventory_data_one_store", """
SELECT count(*) row_count, CAST(sum(stock_level) AS DOUBLE) total_stock_level, count(DISTINCT store_id) store_count,
 count(DISTINCT product_id) product_count FROM v_current WHERE store_id = 'S4'""")
def _tool_inventory_store(ws):
    return tl.inventory_data(ws.current_inventory, store_id="S4")


@query("tool_sales_trend", """
SELECT count(*) row_count, CAST(sum(total_quantity_sold) AS DOUBLE) total_quantity_sold,
 CAST(sum(CAST(total_revenue AS DECIMAL(20,2))) AS DOUBLE) total_revenue, count(DISTINCT store_id) store_count FROM v_pairs""")
def _tool_sales(ws):
    return tl.sales_totals(ws.sales_summary)


@query("tool_product_performance", """
SELECT count(*) row_count, count(DISTINCT product_id) product_count, CAST(sum(total_quantity_sold) AS DOUBLE) total_quantity_sold,
 CAST(sum(current_stock_level) AS DOUBLE) current_stock_level FROM v_perf""")
def _tool_products(ws):
    return tl.product_totals(ws.product_performance)


@query("tool_analyze_risk", """
SELECT recommendation_type, count(*) row_count FROM r_all
WHERE recommendation_type IN ('supplier_risk_alert', 'overstock_alert', 'stockout_prevention_alert') GROUP BY 1""")
def _tool_risk(ws):
    return tl.counts_by_type(rc.union_all([ws.records(t) for t in rc.RISK_TYPES]))


@query("tool_recommend_discount", """
SELECT recommendation_type, count(*) row_count FROM r_all WHERE recommendation_type IN ('discount', 'clearance') GROUP BY 1""")
def _tool_discount(ws):
    clearance = rc.clearance(an.dead_stock_candidates(ws.shared_base))  # of the base that the discounts have written
    return tl.counts_by_type(rc.union_all([ws.records("discount"), clearance]))


@query("tool_recommend_transfer", """
SELECT count(*) row_count, CAST(coalesce(sum(suggested_quantity), 0) AS DOUBLE) suggested_quantity_total FROM r_transfer""")
def _tool_transfer(ws):
    return tl.quantity_total(ws.records("transfer"))


@query("tool_recommend_procurement", """
SELECT count(*) row_count, CAST(sum(suggested_quantity) AS DOUBLE) suggested_quantity_total FROM r_reorder""")
def _tool_reorder(ws):
    return tl.quantity_total(ws.records("reorder"))


@query("inventory_tool_summary", """
SELECT category, count(*) row_count FROM v_current GROUP BY category ORDER BY row_count DESC, category LIMIT 5""")
def _tool_categories(ws):
    return tl.top_categories(ws.current_inventory)


@query("inventory_tool_rows", """
SELECT product_id, product_name, category, store_id, store_name, stock_level, inventory_reorder_threshold,
 CAST(selling_price AS DOUBLE) selling_price FROM v_current ORDER BY stock_level DESC, product_id, store_id LIMIT 10""")
def _tool_rows(ws):
    return tl.top_stock_rows(ws.current_inventory)


_ROW_COUNTS = "SELECT count(*) row_count, count(DISTINCT product_id) product_count, count(DISTINCT store_id) store_count FROM "


@query("low_stock_tool", _ROW_COUNTS + "v_low")
def _low_tool(ws):
    return tl.row_counts(ws.low_stock)


@query("dead_stock_tool", _ROW_COUNTS + "v_dead")
def _dead_tool(ws):
    return tl.row_counts(ws.dead_stock)


view("v_sales_rows", """
SELECT c.product_id, c.product_name, c.store_id, c.store_name, c.category, p.total_quantity_sold, p.total_revenue,
 p.recent_7_day_quantity_sold, p.recent_30_day_quantity_sold, CAST(p.last_sale_date AS VARCHAR) last_sale_date
FROM v_current c LEFT JOIN v_perf p ON p.product_id = c.product_id""")


@query("sales_tool_summary_per_store_row", """
SELECT count(*) row_count, count(DISTINCT product_id) product_count, count(DISTINCT store_id) store_count,
 CAST(sum(total_quantity_sold) AS DOUBLE) total_quantity_sold, CAST(sum(CAST(total_revenue AS DECIMAL(20,2))) AS DOUBLE) total_revenue
FROM v_sales_rows""")
def _sales_tool(ws):
    return tl.sales_per_store_row(ws.current_inventory, ws.product_performance)


@query("sales_tool_rows", """
SELECT * FROM v_sales_rows ORDER BY recent_7_day_quantity_sold DESC, total_quantity_sold DESC, product_id, store_id LIMIT 10""")
def _sales_tool_rows(ws):
    return tl.top_sales_rows(ws.current_inventory, ws.product_performance)


@query("supplier_risk_tool", """
SELECT count(*) row_count, count(*) FILTER (WHERE priority = 'high') high_priority_count FROM r_supplier""")
def _supplier_tool(ws):
    return tl.supplier_risk_counts(ws.records("supplier_risk_alert"))


@query("procurement_tool", """
SELECT count(*) row_count, count(DISTINCT product_id) product_count, count(DISTINCT store_id) store_count,
 CAST(sum(suggested_quantity) AS DOUBLE) suggested_quantity_total FROM r_reorder""")
def _procurement_tool(ws):
    return tl.procurement_counts(ws.records("reorder"))
