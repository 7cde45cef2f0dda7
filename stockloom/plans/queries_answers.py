"""Queries over rankings, question classification and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.functions import exprs as ex, text as tx
from stockloom.operators import actions as ac, answers as aw, context as cx, questions as qu, rankings as rk, recommend as rc, record_search as rs, retrieval as rt, sales as sa, stock_views as sv
from stockloom.plans.catalog import query
from stockloom.plans.oracle import view
from stockloom.plans.queries_actions import _ID_ORDER, _PLACED, _WALK, ORDER, _checked, _no_orders
from stockloom.schemas import CUSTOMER_ORDERS, RECOMMENDATIONS
from stockloom.session import published
from stockloom.sources.fingerprint import content_fingerprint

STORES = ("S1", "S6", "S11")
_IN = "store_id IN ('S1', 'S6', 'S11')"


def _sd(ws):
    return sa.sales_dataset(ws.sales, ws.stores, ws.products)


_SUMS = "CAST(sum(quantity_sold) AS BIGINT) quantity_sold, CAST(sum(sales_value) AS DOUBLE) sales_value"


@query("sales_ranking", f"""
SELECT product_id, product_name, {_SUMS} FROM v_sd GROUP BY ALL ORDER BY quantity_sold DESC, product_name LIMIT 5""")
def _ranking(ws):
    return rk.sales_ranking(_sd(ws))


@query("sales_ranking_category_revenue", f"""
SELECT category, {_SUMS} FROM v_sd WHERE {_IN} GROUP BY ALL ORDER BY sales_value, category LIMIT 3""")
def _ranking_category(ws):
    return rk.sales_ranking(_sd(ws), entity="category", metric="revenue", ascending=True, store_ids=STORES, limit=3)


@query("sales_ranking_week", f"""
SELECT product_id, product_name, category, {_SUMS} FROM v_sd WHERE lower(category) = 'brand#3' AND date >= (SELECT max(date) - 6 FROM v_sd WHERE lower(category) = 'brand#3')
GROUP BY ALL ORDER BY quantity_sold, product_name LIMIT 50""")
def _ranking_week(ws):
    return rk.sales_ranking(_sd(ws), ascending=True, category="Brand#3", time_scope="last_7_days", limit=50)


def _ranked_sql(group, order):
    return f"""
SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY quantity_sold {order}, product_name) place
FROM (SELECT {group}, product_id, product_name, CAST(sum(quantity_sold) AS BIGINT) quantity_sold FROM v_sd GROUP BY ALL) t QUALIFY place <= 5"""


@query("top_sold_by_store", _ranked_sql("store_id", "DESC"))
def _top_store(ws):
    return rk.ranked_products(_sd(ws), "store_id", ascending=False)


@query("least_sold_by_store", _ranked_sql("store_id", "ASC"))
def _least_store(ws):
    return rk.ranked_products(_sd(ws), "store_id", ascending=True)


@query("top_sold_by_category", _ranked_sql("category", "DESC"))
def _top_category(ws):
    return rk.ranked_products(_sd(ws), "category", ascending=False)


@query("least_sold_by_category", _ranked_sql("category", "ASC"))
def _least_category(ws):
    return rk.ranked_products(_sd(ws), "category", ascending=True)


@query("sales_summary_by_store", """
SELECT store_id, store_name, city, CAST(sum(quantity_sold) AS BIGINT) total_units_sold, CAST(sum(sales_value) AS DOUBLE) total_sales_value,
 max(n) top_product, max(u) top_product_units FROM v_sd, (SELECT product_name n, CAST(sum(quantity_sold) AS BIGINT) u FROM v_sd
 GROUP BY product_id, product_name ORDER BY u DESC, n LIMIT 1) t GROUP BY ALL""")
def _store_summary(ws):
    return rk.sales_summary_by_store(_sd(ws))


@query("low_stock_by_store", """
SELECT store_id, store_name, count(*) low_stock_count, string_agg(product_name, ', ' ORDER BY product_id) FILTER (WHERE rn <= 3) first_products
FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY product_id) rn FROM v_low) t GROUP BY ALL""")
def _low(ws):
    return rk.low_stock_by_store(ws.low_stock)


@query("scoped_understock", f"""
SELECT product_id, store_id, priority, shortage_quantity FROM v_view WHERE stock_status = 'Low Stock' AND {_IN}""")
def _under(ws):
    return rk.understock_in(ws.store_view, STORES).select("product_id", "store_id", "priority", "shortage_quantity")


@query("scoped_overstock", f"""
SELECT product_id, store_id, surplus_quantity, current_quantity FROM v_view WHERE stock_status = 'Overstock' AND {_IN}""")
def _over(ws):
    return rk.overstock_in(ws.store_view, STORES).select("product_id", "store_id", "surplus_quantity", "current_quantity")


@query("scoped_category_inventory", f"""
SELECT category, CAST(sum(current_quantity) AS BIGINT) inventory_quantity, CAST(sum(value_dec) AS DOUBLE) inventory_value,
 count(DISTINCT product_id) product_count FROM v_view WHERE {_IN} GROUP BY category""")
def _category(ws):
    return rk.category_inventory_in(ws.store_view, STORES)


@query("scoped_store_comparison", f"""
SELECT store_id, CAST(sum(current_quantity) AS BIGINT) inventory_quantity, count(DISTINCT product_id) product_count FROM v_view WHERE {_IN} GROUP BY store_id""")
def _stores(ws):
    return sv.store_comparison(rk.in_stores(ws.store_view, STORES)).select("store_id", "inventory_quantity", "product_count")


@query("transfer_answer", """
SELECT product_id, target_store_id, source_store_id, suggested_quantity, priority, opportunity_score FROM v_opp
ORDER BY priority, opportunity_score DESC, suggested_quantity DESC, product_id, target_store_id LIMIT 10""")
def _transfer_answer(ws):
    return rk.transfer_answer(ws.transfer_analysis, "opportunity", 10).select(
        "product_id", "target_store_id", "source_store_id", "suggested_quantity", "priority", "opportunity_score"
    )


@query("exclusive_answer", "SELECT product_id, exclusive_store_id, available_quantity FROM v_excl WHERE exclusive_store_id IN ('S1', 'S6', 'S11')")
def _exclusive(ws):
    return rk.exclusive_in(ws.exclusive_items, STORES).select("product_id", "exclusive_store_id", "available_quantity")


@query("surplus_answer", f"SELECT product_id, store_id, current_quantity, surplus_quantity FROM v_surplus_stock WHERE {_IN}")
def _surplus(ws):
    return rk.surplus_in(ws.surplus_stock, store_ids=STORES).select("product_id", "store_id", "current_quantity", "surplus_quantity")


@query("alternative_answer", """
SELECT low_stock_product, low_stock_store, alternative_product, alternative_store, available_quantity, alternative_type FROM v_avail
WHERE low_stock_store IN ('NATION_1', 'NATION_6') OR alternative_store IN ('NATION_1', 'NATION_6')""")
def _alternative(ws):
    return rk.alternatives_in(ws.alternative_availability, stores=("NATION_1", "NATION_6")).select(
        "low_stock_product", "low_stock_store", "alternative_product", "alternative_store", "available_quantity", "alternative_type"
    )


@query("product_sales_answer", f"""
SELECT product_id, product_name, CAST(sum(quantity_sold) AS BIGINT) total_units_sold FROM v_sd WHERE {_IN} GROUP BY ALL""")
def _product(ws):
    return rk.product_units(_sd(ws), store_ids=STORES)


@query("riskiest_supplier", """
SELECT u.supplier_id, u.supplier_name, u.reliability_score, u.avg_delivery_days, count(p.product_id) affected_products, min(p.product_name) example_product
FROM (SELECT * FROM rt_suppliers ORDER BY reliability_score, avg_delivery_days DESC, supplier_id LIMIT 1) u
LEFT JOIN rt_products p ON p.supplier_id = u.supplier_id GROUP BY ALL""")
def _riskiest(ws):
    return rk.riskiest_supplier(ws.suppliers, ws.product_performance)


@query("inventory_total_answer", f"SELECT CAST(sum(stock_level) AS BIGINT) total_stock, count(*) row_count FROM rt_inventory WHERE {_IN}")
def _total(ws):
    return rk.inventory_total(ws.inventory, STORES)


@query("inventory_top_rows", f"""
SELECT i.product_id, i.store_id, stock_level, product_name, category FROM rt_inventory i JOIN rt_products p ON p.product_id = i.product_id
WHERE {_IN} ORDER BY stock_level DESC, i.product_id, i.store_id LIMIT 10""")
def _top_rows(ws):
    return rk.inventory_top_rows(ws.inventory, ws.products, STORES).select("product_id", "store_id", "stock_level", "product_name", "category")


# --- text and questions -----------------------------------------------------------------------

_HAS = lambda t, words: "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"
_STARTS = lambda t, words: "(" + " OR ".join(f"{t} = '{w}' OR starts_with({t}, '{w} ')" for w in words) + ")"


def _class_sql(column, table, key):
    return f"""
SELECT {key}, CASE WHEN t = '' THEN 'unclear' WHEN {_STARTS('t', ['hi', 'hello', 'hai', 'hey', 'hii', 'good morning', 'good evening'])} THEN 'greeting'
 WHEN len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) <= 3 AND {_STARTS('t', ['why', 'how', 'explain', 'what about', 'and', 'then'])} THEN 'follow_up'
 WHEN {_HAS('t', ['least', 'lowest', 'worst', 'most', 'highest', 'best', 'top', 'low stock', 'sales', 'sold', 'product', 'store', 'city', 'inventory'])} THEN 'analytical_query'
 WHEN {_HAS('t', ['stock', 'supplier', 'recommendation', 'reorder', 'transfer', 'discount'])} THEN 'business_query'
 WHEN {_HAS('t', ['movie', 'weather', 'song', 'cricket', 'football', 'actor', 'actress', 'joke'])} THEN 'irrelevant' ELSE 'unclear' END message_class
FROM (SELECT *, lower(trim({column})) t FROM {table}) x"""


@query("classify_messages", _class_sql("question", "rt_questions", "question_id"))
def _classes(ws):
    return ws.questions.select("question_id", tx.message_class("question").alias("message_class"))


@query("classify_conversation_turns", _class_sql("text", "conversations", "conv_id, turn"))
def _turn_classes(ws):
    return ws.parquet("conversations").select("conv_id", "turn", tx.message_class("text").alias("message_class"))


# The phrases that the rules look for, in the check's own words.
_ROUTES = ["transfer", "stock balancing", "shortage", "excess stock", "surplus", "extra stock", "more stock", "redistribut", "source store",
           "target store", "low stock branch", "stockout risk", "stock out risk", "exclusive", "only available", "alternative", "offer instead"]
_MOVES = ["transfer", "stock balanc", "shortage", "excess stock", "surplus", "redistribut", "source store", "target store", "low stock branch",
          "stockout risk", "stock out risk", "branch has excess", "store has excess"]
_SPARE = ["extra stock", "surplus stock", "surplus products", "products have surplus", "store has surplus", "has more stock", "more stock for",
          "available in higher quantity"]
_RANKED = ["top selling", "least selling", "best selling", "most sold", "least sold", "highest sales", "lowest sales", "highest selling",
           "lowest selling", "fastest moving", "top products by revenue", "top items by revenue"]
_ONLY = ["exclusive", "only available", "only in", "alternative product", "alternatives", "offer instead"]


@query("transfer_routing", f"""
SELECT question_id, {_HAS('lower(question)', _ROUTES)} routed FROM rt_questions""")
def _routed(ws):
    return ws.questions.select("question_id", tx.routed_to_transfer("question").alias("routed"))


@query("normalize_text", r"""
SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) normal FROM documents""")
def _normal(ws):
    return ws.parquet("documents").select("doc_id", tx.normalized("text").alias("normal"))


@query("token_set", r"""
SELECT doc_id, count(DISTINCT token) distinct_tokens, count(*) tokens FROM (SELECT doc_id,
 unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) token FROM documents) t WHERE token <> '' GROUP BY doc_id""")
def _tokens(ws):
    return ws.parquet("documents").select(
        "doc_id", F.size(tx.token_set("text")).cast("long").alias("distinct_tokens"), F.size(tx.tokens("text")).cast("long").alias("tokens")
    ).filter("tokens > 0")


@query("requested_limit", r"""
SELECT question_id, CAST(greatest(1, least(10, CAST(coalesce(nullif(regexp_extract(t, '\btop\s+(\d+)\b', 1), ''),
 nullif(regexp_extract(t, '\bleast\s+(\d+)\b', 1), ''), nullif(regexp_extract(t, '\blowest\s+(\d+)\b', 1), ''),
 nullif(regexp_extract(t, '\bhighest\s+(\d+)\b', 1), ''), nullif(regexp_extract(t, '\b(\d+)\s+(?:items|item|products|product)\b', 1), ''), '5') AS BIGINT))) AS BIGINT) requested_limit
FROM (SELECT question_id, array_to_string(list_transform(string_split(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE w WHEN 'solt' THEN 'sold' WHEN 'seling' THEN 'selling' WHEN 'higest' THEN 'highest' WHEN 'lowst' THEN 'lowest' WHEN 'hyderabadd' THEN 'hyderabad' WHEN 'vijaywada' THEN 'vijayawada' ELSE w END), ' ') t FROM rt_questions) q""")
def _limit(ws):
    return ws.questions.select("question_id", tx.requested_limit(tx.normalized("question")).alias("requested_limit"))


view("q_text", r"SELECT DISTINCT array_to_string(list_transform(string_split(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE w WHEN 'solt' THEN 'sold' WHEN 'seling' THEN 'selling' WHEN 'higest' THEN 'highest' WHEN 'lowst' THEN 'lowest' WHEN 'hyderabadd' THEN 'hyderabad' WHEN 'vijaywada' THEN 'vijayawada' ELSE w END), ' ') normal FROM rt_questions")
view("q_store_alias", r"""
SELECT DISTINCT store_id entity, trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) alias FROM (SELECT store_id, store_id n FROM rt_stores
 UNION ALL SELECT store_id, store_name FROM rt_stores UNION ALL SELECT store_id, city FROM rt_stores) t""")
view("q_product_alias", r"""
SELECT DISTINCT product_id entity, trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) alias FROM (SELECT product_id, product_id n FROM rt_products
 UNION ALL SELECT product_id, product_name FROM rt_products) t""")
view("q_category_alias", r"""
SELECT category entity, concat(trim(regexp_replace(lower(category), '[^a-z0-9]+', ' ', 'g')), s) alias FROM (SELECT DISTINCT category FROM rt_products) c,
 (SELECT unnest(['', ' product', ' products', ' item', ' items']) s) x""")


def _linked_view(name, alias, cutoff):
    view(f"{name}_exact", f"SELECT DISTINCT normal, entity, alias FROM q_text, {alias} WHERE contains(normal, alias)")
    view(f"{name}_close", f"""
SELECT DISTINCT normal, entity, alias, score FROM (SELECT normal, c, entity, alias, 1 - levenshtein(c, alias) / CAST(greatest(length(c), length(alias)) AS DOUBLE) score,
 dense_rank() OVER (PARTITION BY normal, c ORDER BY 1 - levenshtein(c, alias) / CAST(greatest(length(c), length(alias)) AS DOUBLE) DESC, alias) rn FROM
 (SELECT DISTINCT normal, c FROM (SELECT normal, unnest(list_append(string_split(normal, ' '), normal)) c FROM q_text) w
  WHERE normal NOT IN (SELECT normal FROM {name}_exact)) a, {alias} b
 WHERE 1 - levenshtein(c, alias) / CAST(greatest(length(c), length(alias)) AS DOUBLE) >= {cutoff}) t WHERE rn <= 5""")
    view(name, f"SELECT DISTINCT normal, entity FROM {name}_exact UNION SELECT DISTINCT normal, entity FROM {name}_close")


_linked_view("q_store", "q_store_alias", "0.82E0")
_linked_view("q_product", "q_product_alias", "0.84E0")
_linked_view("q_cat", "q_category_alias", "0.80E0")
view("q_category", """
SELECT normal, arg_min(entity, (-len(string_split(alias, ' ')), entity)) category FROM q_cat_exact GROUP BY normal
UNION ALL SELECT normal, arg_min(entity, (-score, alias)) FROM q_cat_close GROUP BY normal""")


def _texts(ws):
    return ws.questions.select(tx.normalized("question").alias("normal")).distinct()


@query("link_stores", "SELECT * FROM q_store")
def _link_stores(ws):
    return qu.linked(_texts(ws), qu.store_aliases(ws.stores), qu.STORE_CUTOFF)


@query("link_products", "SELECT * FROM q_product")
def _link_products(ws):
    return qu.linked(_texts(ws), qu.product_aliases(ws.products), qu.PRODUCT_CUTOFF)


@query("link_categories", "SELECT normal, category AS entity FROM q_category")
def _link_categories(ws):
    return qu.linked_category(_texts(ws), qu.category_aliases(ws.products))


def _scope_sql(word):
    return f"""CASE WHEN category <> '' THEN '{word}_sold_product_by_category'
  WHEN store_matches > 0 AND {_HAS('t', ['top ', 'items', 'products'])} THEN '{word}_sold_products_ranked_by_store'
  WHEN store_matches > 0 THEN '{word}_sold_product_by_store' ELSE 'product_performance' END"""


view("q_class", rf"""
SELECT question_id, question, normal, store_matches, product_matches, category, CASE
 WHEN {_HAS('t', _ONLY)} THEN CASE WHEN {_HAS('t', ['alternative', 'instead', 'offer'])} THEN 'alternative_options' ELSE 'exclusive_availability' END
 WHEN {_HAS('t', _SPARE)} THEN 'surplus_stock'
 WHEN {_HAS('t', ['category wise inventory', 'category inventory', 'category wise stock'])} THEN 'category_inventory'
 WHEN {_HAS('t', ['highest inventory', 'highest stock', 'most inventory'])} THEN 'store_inventory_comparison'
 WHEN contains(t, 'overstock') THEN 'store_overstock' WHEN contains(t, 'understock') THEN 'store_understock'
 WHEN {_HAS('t', [*_MOVES, 'needs transfer', 'need transfer'])} AND NOT {_HAS('t', ['agent', 'why did'])} THEN 'transfer_analysis'
 WHEN {_HAS('t', ['recommend', 'suggest', 'agent', 'why did'])} THEN 'recommendation_question'
 WHEN contains(t, 'supplier') THEN 'supplier_risk'
 WHEN {_HAS('t', _MOVES)} THEN 'transfer_analysis'
 WHEN {_HAS('t', _RANKED)} OR ((regexp_matches(t, '\btop\s+\d+\b') OR regexp_matches(t, '\b(least|lowest)\s+\d+\b'))
  AND {_HAS('t', ['selling', 'sold', 'sales', 'revenue', 'items', 'product'])}) THEN 'sales_ranking'
 WHEN {_HAS('t', ['least sold', 'lowest sold', 'worst selling', 'least selling'])} THEN {_scope_sql('least')}
 WHEN {_HAS('t', ['top selling', 'best selling', 'highest sold', 'most sold'])} THEN {_scope_sql('top')}
 WHEN store_matches > 0 AND {_HAS('t', ['highest sales', 'top sales', 'most sales'])} THEN 'top_sold_products_ranked_by_store'
 WHEN category <> '' AND {_HAS('t', ['highest sales', 'top sales', 'most sales'])} THEN 'top_sold_product_by_category'
 WHEN category <> '' AND {_HAS('t', ['lowest sales', 'least sales'])} THEN 'least_sold_product_by_category'
 WHEN {_HAS('t', ['low stock', 'below reorder'])} THEN 'low_stock_by_store'
 WHEN contains(t, 'compare') AND contains(t, 'store') THEN 'sales_summary_by_store'
 WHEN contains(t, 'sales') AND NOT (contains(t, 'product') AND {_HAS('t', ['performance', 'performing'])}) THEN 'sales_summary_by_store'
 WHEN {_HAS('t', ['perform', 'sales of'])} THEN 'product_performance'
 WHEN contains(t, 'inventory') OR contains(t, 'stock') THEN 'general_inventory_question' ELSE '' END intent,
 CASE WHEN {_HAS('t', ['least', 'lowest', 'worst selling'])} THEN 'ascending' ELSE 'descending' END direction,
 CASE WHEN {_HAS('t', ['revenue', 'sales value', 'sales amount'])} THEN 'revenue' ELSE 'quantity' END metric
FROM (SELECT q.question_id, q.question, x.normal, x.normal t, coalesce(s.n, 0) store_matches, coalesce(p.n, 0) product_matches, coalesce(c.category, '') category
 FROM (SELECT question_id, question, array_to_string(list_transform(string_split(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE w WHEN 'solt' THEN 'sold' WHEN 'seling' THEN 'selling' WHEN 'higest' THEN 'highest' WHEN 'lowst' THEN 'lowest' WHEN 'hyderabadd' THEN 'hyderabad' WHEN 'vijaywada' THEN 'vijayawada' ELSE w END), ' ') normal FROM rt_questions) q
 JOIN q_text x ON x.normal = q.normal LEFT JOIN (SELECT normal, count(*) n FROM q_store GROUP BY normal) s ON s.normal = x.normal
 LEFT JOIN (SELECT normal, count(*) n FROM q_product GROUP BY normal) p ON p.normal = x.normal LEFT JOIN q_category c ON c.normal = x.normal) z""")


def _classified(ws):
    return qu.classified_questions(ws.questions, ws.stores, ws.products)


@query("classify_questions", "SELECT question_id, store_matches, product_matches, category, intent, direction, metric FROM q_class")
def _classify(ws):
    return _classified(ws).select(
        "question_id", "store_matches", "product_matches", "category", "intent", "direction", "metric"
    )


_NUM = lambda v: f"format('{{:,}}', CAST({v} AS BIGINT))"
_MONEY = lambda v: f"concat(format('{{:,}}', CAST(floor({v}) AS BIGINT)), '.', lpad(CAST(CAST(({v} - floor({v})) * 100 AS BIGINT) AS VARCHAR), 2, '0'))"

# The check works text by text, with the links themselves as scopes.
view("q_par", rf"""
SELECT c.normal, c.intent, c.direction = 'ascending' ascending, c.metric, c.category, e.entity, coalesce(s.n, 0) store_n, coalesce(p.n, 0) product_n,
 coalesce(s.label, '') label, coalesce(s.said, s.label, '') asked_label, p.first_product,
 CASE WHEN {_HAS('c.normal', ['this week', 'last 7 days', 'past 7 days'])} THEN 6 WHEN contains(c.normal, 'today') THEN 0 END span,
 CAST(greatest(1, least(10, coalesce(CAST(coalesce(nullif(regexp_extract(c.normal, '\btop\s+(\d+)\b', 1), ''),
  nullif(regexp_extract(c.normal, '\bleast\s+(\d+)\b', 1), ''), nullif(regexp_extract(c.normal, '\blowest\s+(\d+)\b', 1), ''),
  nullif(regexp_extract(c.normal, '\bhighest\s+(\d+)\b', 1), ''), nullif(regexp_extract(c.normal, '\b(\d+)\s+(?:items|item|products|product)\b', 1), '')) AS BIGINT),
  CASE WHEN c.intent = 'sales_ranking' AND e.entity = 'category' AND NOT regexp_matches(c.normal, '\b\d+\b') THEN 1 ELSE 5 END))) AS BIGINT) lim,
 CASE WHEN {_HAS('c.normal', ['surplus', 'excess stock'])} THEN 'surplus'
  WHEN {_HAS('c.normal', ['shortage', 'stockout risk', 'stock out risk', 'low stock branch'])} THEN 'shortage' ELSE 'opportunity' END kind
FROM (SELECT DISTINCT normal, intent, direction, metric, category FROM q_class) c
JOIN (SELECT normal, max(CASE WHEN contains(normal, 'category') AND category = '' THEN 'category' ELSE 'product' END) entity FROM q_class GROUP BY normal) e ON e.normal = c.normal
LEFT JOIN (SELECT normal, count(*) n, CASE WHEN count(*) = 1 THEN min(store_name) WHEN count(DISTINCT city) = 1 THEN min(city) ELSE 'the matched stores' END label,
 min(CASE WHEN contains(normal, lower(city)) THEN city END) said FROM q_store JOIN rt_stores ON store_id = entity GROUP BY normal) s ON s.normal = c.normal
LEFT JOIN (SELECT normal, count(*) n, arg_min(product_name, product_id) first_product FROM q_product JOIN rt_products ON product_id = entity GROUP BY normal) p ON p.normal = c.normal""")
view("q_pair", """
SELECT a.normal, s.store_id, p.product_id FROM q_par a
JOIN (SELECT normal, entity store_id FROM q_store UNION ALL SELECT normal, NULL FROM q_par WHERE store_n = 0) s ON s.normal = a.normal
JOIN (SELECT normal, entity product_id FROM q_product UNION ALL SELECT normal, NULL FROM q_par WHERE product_n = 0) p ON p.normal = a.normal""")
view("q_cell", """
SELECT store_id, product_id, product_name, category, date, CAST(sum(quantity_sold) AS BIGINT) q, sum(sales_value) v FROM v_sd GROUP BY ALL""")
view("q_sold", """
SELECT normal, product_id, product_name, category of_category, CAST(sum(q) AS BIGINT) q, sum(v) v, max(newest) newest FROM (
 SELECT *, max(date) OVER (PARTITION BY normal) newest FROM (
  SELECT a.normal, a.span, a.intent, c.* FROM q_par a JOIN q_store s ON s.normal = a.normal JOIN q_cell c ON c.store_id = s.entity
  WHERE intent IN ('sales_ranking', 'least_sold_product_by_store', 'top_sold_product_by_store', 'least_sold_products_ranked_by_store', 'top_sold_products_ranked_by_store',
   'sales_summary_by_store', 'product_performance') AND (intent <> 'sales_ranking' OR a.category = '' OR lower(trim(c.category)) = lower(trim(a.category)))
  UNION ALL SELECT a.normal, a.span, a.intent, c.* FROM q_par a JOIN q_cell c ON (intent = 'product_performance' AND store_n = 0) OR (intent = 'sales_ranking' AND store_n = 0 AND
   (a.category = '' OR lower(trim(c.category)) = lower(trim(a.category)))) OR (intent IN ('least_sold_product_by_category', 'top_sold_product_by_category')
   AND lower(trim(c.category)) = lower(trim(a.category)))) r) t
WHERE intent <> 'sales_ranking' OR span IS NULL OR date >= newest - span GROUP BY ALL""")
view("q_ranked", """
SELECT *, count(*) OVER (PARTITION BY normal) n FROM (SELECT a.*, t.name, t.of_category, t.q, t.v, t.newest, row_number() OVER (PARTITION BY a.normal ORDER BY
  CASE WHEN down THEN CASE WHEN money THEN v ELSE q END ELSE -CASE WHEN money THEN v ELSE q END END, t.name, t.product_id) place
 FROM (SELECT *, CASE WHEN intent = 'sales_ranking' THEN ascending ELSE starts_with(intent, 'least') END down, intent = 'sales_ranking' AND metric = 'revenue' money,
   intent = 'sales_ranking' AND entity = 'category' whole, CASE WHEN intent IN ('sales_ranking', 'least_sold_products_ranked_by_store', 'top_sold_products_ranked_by_store') THEN lim ELSE 1 END most
  FROM q_par) a
 JOIN (SELECT normal, false whole, product_id, product_name AS name, of_category, q, v, newest FROM q_sold
  UNION ALL SELECT normal, true, '', of_category, of_category, CAST(sum(q) AS BIGINT), sum(v), max(newest) FROM q_sold WHERE trim(of_category) <> '' GROUP BY normal, of_category) t
  ON t.normal = a.normal AND t.whole = a.whole WHERE a.intent NOT IN ('sales_summary_by_store', 'product_performance')) r WHERE place <= most""")
view("q_line_sales", rf"""
SELECT normal, place, concat(place, '. **', name, '** - ', CASE WHEN money THEN concat({_MONEY('v')}, ' sales value (', {_NUM('q')}, ' units sold)') ELSE concat({_NUM('q')}, ' units sold') END) line
 FROM q_ranked WHERE intent = 'sales_ranking'
UNION ALL SELECT normal, 0, concat(CASE WHEN contains(normal, 'fastest moving') THEN 'Fastest moving' WHEN down THEN 'Lowest' ELSE 'Top' END, ' ', n, ' selling ',
  CASE WHEN whole THEN 'categories' WHEN category <> '' THEN concat(category, ' products') ELSE 'items' END, CASE WHEN store_n > 0 THEN concat(' in ', asked_label) ELSE '' END,
  CASE span WHEN 6 THEN concat(' for the week ending ', (SELECT max(newest) FROM q_ranked z WHERE z.normal = q_ranked.normal)) WHEN 0 THEN concat(' on ', (SELECT max(newest) FROM q_ranked z WHERE z.normal = q_ranked.normal)) ELSE '' END,
  ' by ', CASE WHEN money THEN 'revenue' ELSE 'units sold' END, ':') FROM q_ranked WHERE intent = 'sales_ranking' AND place = 1
UNION ALL SELECT normal, place, concat(place, '. ', name, ' - ', q, ' units') FROM q_ranked WHERE intent IN ('least_sold_products_ranked_by_store', 'top_sold_products_ranked_by_store')
UNION ALL SELECT normal, 0, concat('The ', CASE WHEN down THEN 'least' ELSE 'top' END, ' ', n, ' selling items in ', label, ' are:') FROM q_ranked
 WHERE intent IN ('least_sold_products_ranked_by_store', 'top_sold_products_ranked_by_store') AND place = 1
UNION ALL SELECT normal, 0, concat('The ', CASE WHEN down THEN 'least sold' ELSE 'top selling' END, ' product in ', label, ' is ', name, ', with ', q, ' units sold in the current sales data.')
 FROM q_ranked WHERE intent IN ('least_sold_product_by_store', 'top_sold_product_by_store')
UNION ALL SELECT normal, 0, concat('The ', CASE WHEN down THEN 'least' ELSE 'most' END, ' sold ', trim(of_category), ' product is ', name, ', with ', q, ' units sold.')
 FROM q_ranked WHERE intent IN ('least_sold_product_by_category', 'top_sold_product_by_category')
UNION ALL SELECT a.normal, 0, concat('Sales in ', label, ' total ', CAST(sum(q) AS BIGINT), ' units in the current sales data, worth about ', {_MONEY('sum(v)')}, '.')
 FROM q_par a JOIN q_sold t ON t.normal = a.normal WHERE a.intent = 'sales_summary_by_store' GROUP BY a.normal, label
UNION ALL SELECT normal, 0, concat(product_name, ' has sold ', q, ' units in ', CASE WHEN store_n > 0 THEN label ELSE 'the available sales data' END, '.')
 FROM (SELECT a.*, t.product_name, t.q, row_number() OVER (PARTITION BY a.normal ORDER BY q DESC, t.product_id) rn FROM q_par a JOIN q_product l ON l.normal = a.normal
  JOIN q_sold t ON t.normal = a.normal AND t.product_id = l.entity WHERE a.intent = 'product_performance') b WHERE rn = 1""")


def _listed(intent, table, columns, order, limit, line, head, store="store_id", product=None):
    """Lines of a list in the scope of each text, with their heading."""
    on = f"(a.store_n = 0 OR EXISTS (SELECT 1 FROM q_store s WHERE s.normal = a.normal AND s.entity = r.{store}))"
    if product:
        on += f" AND (a.product_n = 0 OR EXISTS (SELECT 1 FROM q_product p WHERE p.normal = a.normal AND p.entity = r.{product}))"
    rows = f"(SELECT a.normal, a.label, a.store_n, a.lim, {columns}, row_number() OVER (PARTITION BY a.normal ORDER BY {order}) place FROM q_par a JOIN {table} r ON {on} WHERE a.intent = '{intent}')"
    return f"""SELECT normal, place, concat(place, '. {line}) line FROM {rows} b WHERE place <= {limit}
UNION ALL SELECT DISTINCT normal, 0, {head} FROM {rows} b"""


_ALL = "CASE WHEN store_n > 0 THEN label ELSE 'all stores' END"
view("q_line_stock", "\nUNION ALL ".join([
    _listed("exclusive_availability", "v_excl", "product_name, exclusive_store_name, available_quantity", "available_quantity DESC, product_name, product_id", "lim",
            "**', product_name, '** is only available at ', exclusive_store_name, ' with ', available_quantity, ' units.'",
            f"concat('Exclusive store availability in ', {_ALL}, ':')", "exclusive_store_id"),
    _listed("surplus_stock", "v_surplus_stock", "product_name, store_name, current_quantity, surplus_quantity", "opportunity_level, surplus_quantity DESC, product_name, store_id", "lim",
            "**', product_name, '** at ', store_name, ' has ', current_quantity, ' units, with ', surplus_quantity, ' units above threshold.'",
            "'Stores and products with extra stock:'", product="product_id"),
    _listed("store_understock", "(SELECT * FROM v_view WHERE stock_status = 'Low Stock')", "product_name, current_quantity, reorder_threshold", "priority, shortage_quantity DESC, product_id, store_id", "8",
            "**', product_name, '** has ', current_quantity, ' units against threshold ', reorder_threshold, '.'", f"concat('Understocked items in ', {_ALL}, ':')"),
    _listed("store_overstock", "(SELECT * FROM v_view WHERE stock_status = 'Overstock')", "product_name, current_quantity, surplus_quantity", "surplus_quantity DESC, current_quantity DESC, product_id, store_id", "8",
            "**', product_name, '** has ', current_quantity, ' units; surplus is ', surplus_quantity, ' units.'", f"concat('Overstocked items in ', {_ALL}, ':')"),
]) + f"""
UNION ALL SELECT normal, place, CASE place WHEN 0 THEN concat('Category-wise inventory in ', {_ALL}, ':') ELSE concat(place, '. **', category, '**: ', units, ' units.') END
 FROM (SELECT a.normal, a.label, a.store_n, r.category, CAST(sum(r.current_quantity) AS BIGINT) units, row_number() OVER (PARTITION BY a.normal ORDER BY sum(r.current_quantity) DESC, r.category) place
  FROM q_par a JOIN v_view r ON a.store_n = 0 OR EXISTS (SELECT 1 FROM q_store s WHERE s.normal = a.normal AND s.entity = r.store_id)
  WHERE a.intent = 'category_inventory' GROUP BY a.normal, a.label, a.store_n, r.category
  UNION ALL SELECT normal, label, store_n, '', 0, 0 FROM q_par WHERE intent = 'category_inventory') t WHERE place <= 8
UNION ALL SELECT normal, 0, concat(store_name, ' has the highest inventory with ', units, ' units.') FROM q_par, (SELECT store_name, CAST(sum(current_quantity) AS BIGINT) units
  FROM v_view GROUP BY store_id, store_name ORDER BY units DESC, store_id LIMIT 1) t WHERE intent = 'store_inventory_comparison'
UNION ALL SELECT a.normal, 0, concat(a.label, ' has ', count(*), CASE WHEN count(*) = 1 THEN ' low-stock item' ELSE ' low-stock items' END, ' in the current data.')
 FROM q_par a JOIN q_store s ON s.normal = a.normal JOIN v_low l ON l.store_id = s.entity WHERE a.intent = 'low_stock_by_store' GROUP BY a.normal, a.label
UNION ALL SELECT a.normal, 0, concat('There are ', CAST(sum(i.stock_level) AS BIGINT), ' units in ', CASE WHEN store_n > 0 THEN label ELSE 'the current inventory data' END, '.')
 FROM q_par a JOIN q_pair x ON x.normal = a.normal JOIN rt_inventory i ON (x.store_id IS NULL OR i.store_id = x.store_id) AND (x.product_id IS NULL OR i.product_id = x.product_id)
 WHERE a.intent = 'general_inventory_question' GROUP BY a.normal, label, store_n""")
view("q_line_other", """
SELECT normal, place, concat(place, '. If **', low_stock_product, '** is low at ', low_stock_store, ', offer **', alternative_product, '** as a ',
  CASE alternative_type WHEN 'same_product_transfer' THEN 'transfer source' ELSE 'category alternative' END, ' from ', alternative_store, ' with ', available_quantity, ' units.') line
 FROM (SELECT a.normal, a.lim, r.*, row_number() OVER (PARTITION BY a.normal ORDER BY alternative_type DESC, available_quantity DESC, alternative_product, low_stock_product, low_stock_store, alternative_store) place
  FROM q_par a JOIN v_avail r ON (a.product_n = 0 OR EXISTS (SELECT 1 FROM q_product p JOIN rt_products d ON d.product_id = p.entity WHERE p.normal = a.normal AND d.product_name IN (r.low_stock_product, r.alternative_product)))
   AND (a.store_n = 0 OR EXISTS (SELECT 1 FROM q_store s JOIN rt_stores d ON d.store_id = s.entity WHERE s.normal = a.normal AND d.store_name IN (r.low_stock_store, r.alternative_store)))
  WHERE a.intent = 'alternative_options') t WHERE place <= lim
UNION ALL SELECT normal, place, concat(place, '. **', product_name, '** at ', store_name, ' - ', CAST(round_even(surplus, 0) AS BIGINT), ' units available above transfer buffer')
 FROM q_par, (SELECT *, row_number() OVER (ORDER BY surplus_score DESC, surplus DESC, product_id, store_id) place FROM v_surp) t WHERE intent = 'transfer_analysis' AND kind = 'surplus' AND place <= lim
UNION ALL SELECT normal, place, concat(place, '. **', product_name, '** at ', store_name, ' - ', stock_level, ' units on hand, threshold ', inv_thr, ', ',
  CAST(round_even(dleft * 10, 0) / 10 AS DECIMAL(20, 1)), ' days remaining')
 FROM q_par, (SELECT *, row_number() OVER (ORDER BY shortage_score DESC, vel DESC, product_id, store_id) place FROM v_short) t WHERE intent = 'transfer_analysis' AND kind = 'shortage' AND place <= lim
UNION ALL SELECT normal, place, concat(place, '. Transfer **', product_name, '**', chr(10), '   From: ', source_store_name, chr(10), '   To: ', target_store_name, chr(10),
  '   Suggested Quantity: ', suggested_quantity, ' units', chr(10), '   Priority: ', priority)
 FROM q_par, (SELECT *, row_number() OVER (ORDER BY priority, opportunity_score DESC, suggested_quantity DESC, product_id, target_store_id) place FROM v_opp) t
 WHERE intent = 'transfer_analysis' AND kind = 'opportunity' AND place <= lim
UNION ALL SELECT normal, 0, concat('The riskiest supplier in the current data is ', supplier_name, '.') FROM (
 SELECT a.normal, u.supplier_name, row_number() OVER (PARTITION BY a.normal ORDER BY l.supplier_id IS NULL, u.reliability_score, u.avg_delivery_days DESC, u.supplier_id) rn
 FROM q_par a CROSS JOIN rt_suppliers u LEFT JOIN (SELECT DISTINCT normal, supplier_id FROM q_product JOIN rt_products ON product_id = entity) l
  ON l.normal = a.normal AND l.supplier_id = u.supplier_id WHERE a.intent = 'supplier_risk') t WHERE rn = 1""")
view("q_answer", r"""
WITH lines AS (SELECT normal, place, line FROM q_line_sales UNION ALL SELECT normal, place, line FROM q_line_stock UNION ALL SELECT normal, place, line FROM q_line_other),
heads AS (SELECT a.normal, 0 place, CASE WHEN intent = 'alternative_options' THEN 'Alternative options for low-stock items:' WHEN kind = 'surplus' THEN 'Highest surplus stock signals:'
  WHEN kind = 'shortage' THEN 'Highest shortage risk branches:' WHEN contains(a.normal, 'top') OR contains(a.normal, 'best') THEN 'Top transfer opportunities:' ELSE 'Recommended transfer opportunities:' END line
 FROM q_par a WHERE intent IN ('alternative_options', 'transfer_analysis') AND a.normal IN (SELECT normal FROM q_line_other)),
told AS (SELECT normal, string_agg(line, chr(10) ORDER BY place) answer FROM (SELECT * FROM lines UNION ALL SELECT * FROM heads) t GROUP BY normal)
SELECT a.normal, CASE WHEN a.intent = 'sales_ranking' AND store_n = 0 AND category = '' AND regexp_matches(a.normal, '\b(in|at|for)\s+[a-z][a-z0-9\s]{2,}$')
  THEN 'I could not find enough sales records for that location in the current dataset.' ELSE coalesce(t.answer, CASE
 WHEN intent = 'sales_ranking' THEN 'I could not find enough sales records for that location in the current dataset.'
 WHEN store_n = 0 AND (contains(intent, 'by_store')) THEN 'I couldn''t match that store or city yet. Can you check whether it exists in the stores?'
 WHEN intent = 'low_stock_by_store' THEN concat('I don''t see any low-stock items in ', label, ' right now.')
 WHEN contains(intent, 'by_store') THEN concat('I couldn''t find sales data for ', label, ' yet.')
 WHEN contains(intent, 'by_category') THEN concat('I found sales data, but not for the ', category, ' category.')
 WHEN intent = 'product_performance' AND product_n > 0 THEN concat('I couldn''t find sales data for ', first_product, ' in that scope yet.')
 WHEN intent = 'transfer_analysis' THEN 'No major transfer imbalance is currently detected across stores.'
 WHEN intent = 'exclusive_availability' THEN concat('I do not see any products exclusively available in ', CASE WHEN store_n > 0 THEN label ELSE 'the current data' END, ' right now.')
 WHEN intent = 'surplus_stock' THEN 'I do not see any products with major surplus stock in that scope right now.'
 WHEN intent = 'alternative_options' THEN 'I do not see a same-category alternative option for the matched low-stock item right now.'
 WHEN intent = 'store_understock' THEN concat('I do not see understocked items in ', CASE WHEN store_n > 0 THEN label ELSE 'all stores' END, ' right now.')
 WHEN intent = 'store_overstock' THEN concat('I do not see overstocked items in ', CASE WHEN store_n > 0 THEN label ELSE 'all stores' END, ' right now.')
 WHEN intent = 'general_inventory_question' THEN 'I couldn''t find inventory rows for that product or store yet.' ELSE '' END) END answer
FROM q_par a LEFT JOIN told t ON t.normal = a.normal""")


@query("question_table", """
SELECT question_id, question, c.intent, a.answer FROM q_class c JOIN q_answer a ON a.normal = c.normal""")
def _question_table(ws):
    return aw.question_table(ws, ws.questions)


_PRINTED = {
    "products": "product_id product_name category cost_price selling_price shelf_life_days reorder_threshold supplier_id",
    "stores": "store_id store_name city capacity",
    "suppliers": "supplier_id supplier_name avg_delivery_days reliability_score",
    "inventory": "product_id store_id stock_level reorder_threshold last_updated",
    "sales": "sale_id date product_id store_id quantity_sold selling_price",
    "transactions": "transaction_id date transaction_type product_id store_id quantity source remarks",
}


# --- retrieval --------------------------------------------------------------------------------


def _documents(ws):
    return rt.all_documents(
        {
            "inventory": (ws.inventory, ["product_id", "store_id"]),
            "products": (ws.products, ["product_id"]),
            "stores": (ws.stores, ["store_id"]),
            "suppliers": (ws.suppliers, ["supplier_id"]),
        }
    )


view("d_docs", r"""
SELECT 'inventory' dataset, 0 dataset_order, concat(product_id, '|', store_id) row_key, concat('dataset: inventory', chr(10), 'row_key: ', product_id, '|', store_id, chr(10), 'product_id: ', product_id, chr(10), 'store_id: ', store_id,
 chr(10), 'stock_level: ', stock_level, chr(10), 'reorder_threshold: ', reorder_threshold, chr(10), 'last_updated: ', last_updated) AS text,
 concat_ws(' ', product_id, store_id, stock_level, reorder_threshold, last_updated) values_text FROM rt_inventory
UNION ALL SELECT 'products', 1, product_id, concat_ws(chr(10), 'dataset: products', 'row_key: ' || product_id, 'product_id: ' || product_id, 'product_name: ' || product_name, 'category: ' || category,
 'cost_price: ' || cost_price, 'selling_price: ' || selling_price, 'shelf_life_days: ' || shelf_life_days, 'reorder_threshold: ' || reorder_threshold,
 'supplier_id: ' || supplier_id), concat_ws(' ', product_id, product_name, category, cost_price, selling_price, shelf_life_days, reorder_threshold, supplier_id) FROM rt_products
UNION ALL SELECT 'stores', 2, store_id, concat_ws(chr(10), 'dataset: stores', 'row_key: ' || store_id, 'store_id: ' || store_id, 'store_name: ' || store_name, 'city: ' || city, 'capacity: ' || capacity),
 concat_ws(' ', store_id, store_name, city, capacity) FROM rt_stores
UNION ALL SELECT 'suppliers', 3, supplier_id, concat_ws(chr(10), 'dataset: suppliers', 'row_key: ' || supplier_id, 'supplier_id: ' || supplier_id, 'supplier_name: ' || supplier_name,
 'avg_delivery_days: ' || avg_delivery_days, 'reliability_score: ' || reliability_score), concat_ws(' ', supplier_id, supplier_name, avg_delivery_days, reliability_score) FROM rt_suppliers""")


@query("row_documents", "SELECT dataset, row_key, text FROM d_docs")
def _docs(ws):
    return _documents(ws).select("dataset", "row_key", "text")


@query("hash_embeddings", r"""
WITH t AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) token FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(token), 3, 2) || substr(md5(token), 1, 2) AS BIGINT) % 384 "position",
 CASE WHEN CAST('0x' || substr(md5(token), 5, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END s FROM t WHERE token <> ''),
w AS (SELECT doc_id, "position", CAST(sum(s) AS BIGINT) total FROM h GROUP BY ALL HAVING sum(s) <> 0)
SELECT doc_id, "position", total / sqrt(CAST(sum(total * total) OVER (PARTITION BY doc_id) AS DOUBLE)) weight FROM w""")
def _hash(ws):
    return rt.hash_weights(ws.parquet("documents"), "doc_id", "text")


@query("hash_embeddings_dense", r"""
WITH t AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) token FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(token), 3, 2) || substr(md5(token), 1, 2) AS BIGINT) % 384 "position",
 CASE WHEN CAST('0x' || substr(md5(token), 5, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END s FROM t WHERE token <> ''),
w AS (SELECT doc_id, "position", CAST(sum(s) AS BIGINT) total FROM h GROUP BY ALL HAVING sum(s) <> 0),
x AS (SELECT doc_id, "position", total / sqrt(CAST(sum(total * total) OVER (PARTITION BY doc_id) AS DOUBLE)) weight FROM w)
SELECT d.doc_id, p.p "position", CAST(round_even(CAST(CAST(coalesce(weight, 0) AS FLOAT) AS DOUBLE) * 1e6, 0) AS BIGINT) millionths
FROM documents d CROSS JOIN (SELECT unnest(range(384)) p) p LEFT JOIN x ON x.doc_id = d.doc_id AND x."position" = p.p""")
def _dense(ws):
    dense = rt.hash_embeddings(ws.parquet("documents"), "doc_id", "text").select("doc_id", F.posexplode("embedding").alias("position", "w"))
    return dense.select("doc_id", F.col("position").cast("long").alias("position"), F.rint(F.col("w").cast("double") * 1e6).cast("long").alias("millionths"))


@query("vector_search", """
WITH q AS (SELECT vec_id query_id, embedding e FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, vec_id, round_even(list_sum(list_transform(list_zip(e, embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))) * 1e9, 0) / 1e9 dist FROM q, embeddings)
SELECT query_id, place, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) place FROM d) t WHERE place <= 16""")
def _vectors(ws):
    vectors = ws.parquet("embeddings")
    return rt.vector_search(vectors.filter("vec_id % 20 = 0"), vectors, 16, "vec_id", "vec_id").select("query_id", "place", "vec_id")


def _question_texts(ws):
    """Distinct questions, named by their normalised text."""
    return ws.questions.groupBy(tx.normalized("question").alias("question_id")).agg(F.min("question").alias("question"))


_TOK = lambda c: f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> ''))"
_QANY = lambda words: "len(list_intersect(qt, [" + ", ".join(f"'{w}'" for w in words) + "])) > 0"
view("d_q", rf"""
SELECT question_id, question, {_TOK('question')} qt FROM (SELECT array_to_string(list_transform(string_split(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE w WHEN 'solt' THEN 'sold' WHEN 'seling' THEN 'selling' WHEN 'higest' THEN 'highest' WHEN 'lowst' THEN 'lowest' WHEN 'hyderabadd' THEN 'hyderabad' WHEN 'vijaywada' THEN 'vijayawada' ELSE w END), ' ') question_id,
 min(question) question FROM rt_questions GROUP BY 1) t""")
view("d_hits", rf"""
SELECT question_id, dataset, dataset_order, row_key, overlap, overlap + CASE WHEN dataset = 'inventory' THEN 2 ELSE 0 END
 + CASE WHEN {_QANY(['order', 'orders', 'changed', 'latest'])} AND dataset = 'inventory' THEN 5 ELSE 0 END
 + CASE WHEN {_QANY(['stock', 'inventory', 'store'])} AND dataset = 'inventory' THEN 3 ELSE 0 END
 + CASE WHEN {_QANY(['supplier', 'suppliers', 'risky'])} AND dataset = 'suppliers' THEN 5 ELSE 0 END score
FROM (SELECT question_id, any_value(qt) qt, dataset, dataset_order, row_key, count(*) overlap
 FROM (SELECT question_id, qt, unnest(qt) token FROM d_q) q JOIN (SELECT dataset, dataset_order, row_key, unnest({_TOK('text')}) token FROM d_docs) d USING (token)
 GROUP BY question_id, dataset, dataset_order, row_key) h""")
view("d_top", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, dataset_order, row_key) place FROM d_hits) t WHERE place <= 12""")


def _hits(ws):
    return rt.keyword_search(_question_texts(ws), _documents(ws), 12)


@query("keyword_search", "SELECT question_id, place, dataset, row_key, overlap, CAST(score AS BIGINT) score FROM d_top")
def _keyword(ws):
    return _hits(ws)


view("d_plan", rf"""
SELECT question_id, question, qt, list_slice(list_distinct_ordered, 1, 5) likely, {_QANY(['compare', 'vs', 'versus'])} comparison_requested FROM (
 SELECT *, list_filter(flat, lambda x, i: list_position(flat, x) = i) list_distinct_ordered FROM (SELECT *, flatten([
  CASE WHEN {_QANY(['store', 'stores'])} THEN ['store_inventory_summary', 'sales_summary', 'recommendations'] ELSE [] END,
  CASE WHEN {_QANY(['sales', 'trend', 'dropping', 'underperforming'])} THEN ['sales', 'sales_summary', 'agent_outputs'] ELSE [] END,
  CASE WHEN {_QANY(['supplier', 'suppliers', 'risky'])} THEN ['suppliers', 'recommendations', 'agent_outputs'] ELSE [] END,
  CASE WHEN {_QANY(['reorder', 'procurement', 'next'])} THEN ['recommendations', 'stockout_risk_items', 'low_stock_items'] ELSE [] END,
  CASE WHEN {_QANY(['compare', 'vs', 'versus'])} THEN ['sales_summary', 'store_inventory_summary', 'recommendations'] ELSE [] END]) flat FROM d_q) a) b""")


@query("retrieval_plan", "SELECT question_id, array_to_string(likely, ',') likely_datasets, comparison_requested FROM d_plan")
def _plan(ws):
    return rt.retrieval_plan(_question_texts(ws)).select(
        "question_id", F.array_join("likely_datasets", ",").alias("likely_datasets"), "comparison_requested"
    )


# The ten tables that questions are answered from, with recommendations as the agents return them and placed orders.
view("d_evidence", """
SELECT recommendation_type, product_id, store_id, '' alternative_product_id, evidence FROM r_transfer
UNION ALL SELECT recommendation_type, product_id, store_id, '', evidence FROM r_exclusive UNION ALL SELECT recommendation_type, product_id, store_id, '', evidence FROM r_supplier
UNION ALL SELECT recommendation_type, product_id, store_id, '', evidence FROM r_procurement
UNION ALL SELECT recommendation_type, product_id, store_id, alternative_product_id, evidence FROM r_alternative
UNION ALL SELECT 'discount', o.product_id, o.store_id, '', CASE WHEN s.product_id IS NULL THEN concat('stock=', o.stock_level, ', reorder_threshold=', o.effective_reorder_threshold,
  ', days_of_stock=', round_even(o.days_of_stock_remaining * 100, 0) / 100) ELSE concat('recent_daily_velocity=', round_even(s.recent_daily_sales_velocity * 100, 0) / 100, ', cutoff=',
  round_even((SELECT quantile_cont(recent_daily_sales_velocity, 0.25) FROM v_base WHERE recent_daily_sales_velocity > 0) * 100, 0) / 100) END
 FROM v_base o LEFT JOIN v_slow s ON s.product_id = o.product_id AND s.store_id = o.store_id
UNION ALL SELECT 'overstock_alert', product_id, store_id, '', concat('stock=', stock_level, ', reorder_threshold=', effective_reorder_threshold, ', days_of_stock=',
  round_even(days_of_stock_remaining * 100, 0) / 100) FROM v_over
UNION ALL SELECT 'clearance', product_id, store_id, '', concat('stock=', stock_level, ', recent_30_day_sales=', recent_30_day_quantity_sold, ', shelf_life_days=', shelf_life_days,
  ', days_of_stock=', round_even(days_of_stock_remaining * 100, 0) / 100) FROM v_dead
UNION ALL SELECT 'stockout_prevention_alert', product_id, store_id, '', concat('days_of_stock=', round_even(days_of_stock_remaining * 100, 0) / 100, ', recent_daily_velocity=',
  round_even(recent_daily_sales_velocity * 100, 0) / 100) FROM v_stockout""")
view("d_orders", _WALK + f"""
SELECT concat('ORD', lpad(CAST({_PLACED} AS VARCHAR), 6, '0')) order_id, strftime(order_date, '%Y-%m-%d 00:00:00') order_date, walk.store_id, store_name, city, walk.product_id, product_name,
 quantity quantity_ordered, selling_price unit_price, CAST(quantity * selling_price AS DECIMAL(12, 2)) total_amount, 'placed' status
FROM walk JOIN rt_stores s ON s.store_id = walk.store_id JOIN rt_products p ON p.product_id = walk.product_id WHERE accepted""")
_RUN_TIME = "'2001-11-05 08:00:00' run_time"
_TABLES = {
    "inventory": ("SELECT * FROM rt_inventory", "product_id store_id", _PRINTED["inventory"]),
    "products": ("SELECT * FROM rt_products", "product_id", _PRINTED["products"]),
    "sales": ("SELECT * FROM rt_sales", _PRINTED["sales"], _PRINTED["sales"]),
    "stores": ("SELECT * FROM rt_stores", "store_id", _PRINTED["stores"]),
    "suppliers": ("SELECT * FROM rt_suppliers", "supplier_id", _PRINTED["suppliers"]),
    "transactions": ("SELECT * FROM rt_transactions", "transaction_id", _PRINTED["transactions"]),
    "recommendations": ("SELECT a.*, e.evidence, 'pending' status FROM r_agents a LEFT JOIN d_evidence e USING (recommendation_type, product_id, store_id, alternative_product_id)",
                        "recommendation_id", " ".join(RECOMMENDATIONS.names)),
    "agent_outputs": (f"SELECT {_RUN_TIME}, * FROM v_agent_outputs", "agent_name", "run_time agent_name finding_count priority_level latest_insight"),
    "orchestrator_summary": (f"""SELECT {_RUN_TIME}, o.*, m_risk.headline top_risk, m_chance.headline top_opportunity, low_stock_alert,
 concat(total_recommendations, ' recommendations are active, with ', high_priority_alerts, ' high-priority alerts. Top risk: ', m_risk.headline) executive_summary,
 concat('Top opportunity: ', m_chance.headline, ' Prioritize the highest-risk items first, then move on the strongest commercial opportunity.') executive_recommendation
FROM v_orchestrator o, m_risk, m_chance, m_alert""", "run_time",
                             "run_time database_health total_recommendations high_priority_alerts summary low_stock_alert top_risk top_opportunity executive_summary executive_recommendation"),
    "customer_orders": ("SELECT * FROM d_orders", "order_id", " ".join(CUSTOMER_ORDERS.names)),
}


def _table_sql(place, name):
    sql, key, columns = _TABLES[name]
    texts = {c: f'trim(CAST("{c}" AS VARCHAR))' for c in columns.split()}
    lines = ", ".join(f"CASE WHEN {t} <> '' THEN concat('{c}: ', {t}) END" for c, t in texts.items())
    row_key = "concat_ws('|', " + ", ".join(f'CAST("{c}" AS VARCHAR)' for c in key.split()) + ")"
    return f"""SELECT '{name}' dataset, {place} dataset_order, {row_key} row_key, concat_ws(chr(10), 'dataset: {name}', 'row_key: ' || {row_key}, {lines}) AS text,
 concat_ws(' ', {', '.join(texts.values())}) values_text FROM ({sql}) t"""


view("d_ten", "\nUNION ALL ".join(_table_sql(i, n) for i, n in enumerate(_TABLES)))
view("d_asked", "SELECT list(DISTINCT token) words FROM (SELECT unnest(qt) token FROM d_q) t")
view("d_profiles", f"""
SELECT dataset, dataset_order, row_key, list_sort(list_distinct(flatten(list(found)))) profile FROM (SELECT dataset, dataset_order, row_key, list_intersect({_TOK('text')}, words) found FROM d_ten, d_asked) t
GROUP BY ALL HAVING len(profile) > 0""")
_BONUS = " + ".join(
    ["CASE WHEN dataset IN ('customer_orders', 'orchestrator_summary', 'agent_outputs', 'recommendations') THEN 3 WHEN dataset IN ('inventory', 'sales') THEN 2 ELSE 0 END"]
    + [f"CASE WHEN {_QANY(words)} AND dataset IN ({names}) THEN {points} ELSE 0 END" for words, names, points in [
        (["agent", "orchestrator", "summary", "risk", "suggested", "responsible"], "'agent_outputs', 'orchestrator_summary', 'recommendations'", 6),
        (["order", "orders", "changed", "latest"], "'customer_orders', 'inventory', 'sales', 'transactions'", 5), (["reorder", "procurement", "purchase"], "'recommendations'", 4),
        (["stock", "inventory", "store"], "'inventory'", 3), (["supplier", "suppliers", "risky"], "'suppliers', 'recommendations', 'agent_outputs'", 5),
        (["recommendation", "recommendations", "dead", "discount", "transfer", "clearance"], "'recommendations', 'agent_outputs', 'orchestrator_summary'", 4)]]
)
# Only the first 12 documents of a dataset with the same asked words can be among the first 12 of a question, and so of these sets of words.
view("d_bonus", f"SELECT question_id, qt, dataset, {_BONUS} bonus FROM d_q, (SELECT unnest([{', '.join(repr(n) for n in _TABLES)}]) dataset) t")
view("d_sets", "SELECT row_number() OVER () id, dataset, dataset_order, profile, min(row_key, 12) keys FROM d_profiles GROUP BY dataset, dataset_order, profile")
view("d_ten_top", """
WITH sets AS MATERIALIZED (SELECT * FROM d_sets), bonus AS MATERIALIZED (SELECT * FROM d_bonus),
pairs AS (SELECT question_id, id, count(*) overlap FROM (SELECT question_id, unnest(qt) token FROM d_q) q JOIN (SELECT id, unnest(profile) token FROM sets) p USING (token) GROUP BY question_id, id),
best AS (SELECT question_id, unnest(arg_min({'id': id, 'score': overlap + bonus}, (-overlap - bonus, dataset_order, keys[1]), 12)) b FROM pairs JOIN sets USING (id) JOIN bonus USING (question_id, dataset)
 GROUP BY question_id)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, dataset_order, row_key) place FROM (
 SELECT question_id, dataset, dataset_order, unnest(keys) row_key, b.score score FROM best JOIN sets ON sets.id = b.id) t QUALIFY place <= 12""")


def _ten_tables(ws):
    """Documents of all tables that questions are answered from but the alternatives among the recommendations, written once."""
    run = ws.run
    at = F.lit(run.RECORDED_AT).alias("run_time")
    if not hasattr(run, "answer_documents"):
        summary = rc.orchestrator_summary(run.agent_digest, run.analyzer_counts, run.health)
        executive = cx.executive_summary(summary, run.agent_digest, ws.low_stock_alerts)
        summary = executive.join(summary.select("database_health", "summary"))  # one row each
        asked = _checked(ws).filter("quantity IS NOT NULL")  # a request without quantity places no order
        orders = ac.order_rows(ac.applied_orders(asked, ORDER), _no_orders(ws), _ID_ORDER)
        tables = {
            "sales": ws.sales, "transactions": ws.transactions, "agent_outputs": rc.agent_outputs(run.agent_digest, run.analyzer_counts).select(at, "*"),
            "orchestrator_summary": summary.select(at, "*"), "customer_orders": orders,
        }
        tables |= {"inventory": ws.inventory, "products": ws.products, "stores": ws.stores, "suppliers": ws.suppliers, "recommendations": run.numbered_recommendations}
        run.answer_documents = published(rt.all_documents({n: (tables[n].select(*columns.split()), key.split()) for n, (_, key, columns) in _TABLES.items()}))
    return run.answer_documents


@query("rerank_documents", rf"""
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY new_score DESC, place) new_place, dataset, row_key, new_score FROM (
 SELECT h.question_id, place, dataset, row_key, CAST(CASE WHEN list_contains(likely, dataset) THEN 6 ELSE 0 END + len(list_intersect(qt, vt))
  + CASE WHEN comparison_requested AND dataset = 'recommendations' THEN 3 ELSE 0 END AS BIGINT) new_score
 FROM d_ten_top h JOIN d_plan p USING (question_id) JOIN (SELECT dataset, row_key, list_distinct(flatten(list({_TOK('values_text')}))) vt FROM d_ten
  WHERE (dataset, row_key) IN (SELECT (dataset, row_key) FROM d_ten_top) GROUP BY ALL) d USING (dataset, row_key)) t""")
def _rerank(ws):
    questions, docs, run = _question_texts(ws), _ten_tables(ws), ws.run
    order = list(_TABLES).index("recommendations")
    alternatives = run.alternative_profiles(rt.asked_words(questions), 12, order)
    hits = published(rt.keyword_search(questions, docs, 12, more=alternatives))
    named = run.named_recommendations(hits.filter(F.col("dataset") == "recommendations").select(F.col("row_key").alias("recommendation_id")))
    docs = docs.filter("dataset <> 'recommendations'").unionByName(rs.record_documents(named, order))
    return rt.rerank_documents(hits, docs, rt.retrieval_plan(questions))


@query("evidence_table", """
SELECT question_id, place, dataset source_dataset, coalesce(coalesce(i.product_id, p.product_id), '') source_product_id, coalesce(coalesce(i.store_id, s.store_id), '') source_store_id,
 p.product_name, s.city, CAST(i.stock_level AS VARCHAR) stock_level
FROM d_top h LEFT JOIN rt_inventory i ON dataset = 'inventory' AND row_key = concat(i.product_id, '|', i.store_id)
LEFT JOIN rt_products p ON dataset = 'products' AND row_key = p.product_id LEFT JOIN rt_stores s ON dataset = 'stores' AND row_key = s.store_id WHERE place <= 8""")
def _evidence(ws):
    return rt.evidence_table(_hits(ws), _documents(ws), ["product_name", "city", "stock_level"])


@query("dataset_counts", "SELECT question_id, dataset, count(*) document_count FROM d_top GROUP BY question_id, dataset")
def _dataset_counts(ws):
    return rt.dataset_counts(_hits(ws))


def _print_sql(name):
    values = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _PRINTED[name].split())
    return f"""SELECT '{name}' dataset, count(*) row_count,
 CAST(coalesce(sum(CAST(CAST('0x' || md5({values})[1:15] AS UBIGINT) AS HUGEINT)), 0) AS VARCHAR) fingerprint FROM rt_{name}"""


@query("source_fingerprint", " UNION ALL ".join(_print_sql(n) for n in _PRINTED))
def _fingerprint(ws):
    return content_fingerprint({n: getattr(ws, n).select(*columns.split()) for n, columns in _PRINTED.items()})


@query("conversation_window", rf"""
WITH c AS (SELECT conv_id, turn, role, trim(coalesce(text, '')) t FROM conversations),
w AS (SELECT conv_id, turn, t, list_filter(list(CASE WHEN t = '' THEN NULL ELSE role || ': ' || t END) OVER (PARTITION BY conv_id ORDER BY turn
 ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) h FROM c),
x AS (SELECT conv_id, turn, t, coalesce(array_to_string(h, chr(10)), '') history, coalesce(len(h), 0) n FROM w)
SELECT conv_id, turn, history, n history_turns, CASE WHEN history <> '' AND len(list_filter(string_split(trim(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda y: y <> '')) <= 3
 AND {_STARTS('lower(t)', ['why', 'how', 'explain', 'what about', 'and', 'then'])} THEN 'Current user question: ' || t || chr(10) || 'Recent conversation context:' || chr(10) || history
 ELSE t END retrieval_query FROM x""")
def _window(ws):
    return rt.conversation_window(ws.parquet("conversations"))


# --- small expressions ------------------------------------------------------------------------


@query("alert_keys", "SELECT product_id, store_id, concat_ws('|', product_id, store_id, current_quantity, priority) alert_key FROM v_alerts")
def _keys(ws):
    return ws.low_stock_alerts.select("product_id", "store_id", ex.alert_key().alias("alert_key"))


@query("reorder_sizes", """
SELECT product_id, store_id, current_quantity, reorder_threshold, suggested_reorder_quantity, priority FROM v_alerts""")
def _sizes(ws):
    return ws.low_stock_alerts.select(
        "product_id", "store_id", "current_quantity", "reorder_threshold", "suggested_reorder_quantity", "priority"
    )


@query("clean_sentences", r"""
SELECT conv_id, turn, CASE WHEN t = '' THEN 'None.' WHEN regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END said, concat(upper(role[1]), role[2:]) role_label
FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) t FROM conversations) c""")
def _sentences(ws):
    return ws.parquet("conversations").select(
        "conv_id", "turn", ex.sentence("text", "None.").alias("said"), ex.title_or_info("role").alias("role_label")
    )
