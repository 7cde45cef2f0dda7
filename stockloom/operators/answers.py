"""Answers to a table of questions by one dispatch join.

Each classified question stands for a tuple of parameters: intent, store scope, product scope, category, direction,
metric, ranked entity, limit and time scope. Equal tuples are one `ask`. Scopes are named by an order-free hash of
their ids and kept as link tables (scope, id), never as arrays. Every family of intents aggregates its rows once per
distinct scope: sales cells and stock rows meet the scopes in equi-joins on the store, product or category, are
summed or ranked per scope, and give the lines of an answer. Rankings are cut by `row_number <= k` before they are
shuffled. In the end every question meets the answer of its tuple in one equi-join.

Asks without a store or product scope read totals or the first rows of a list, so no list is copied per question.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.functions import text as tx
from stockloom.operators import questions as qu, sales as sa, transfers as tr
from stockloom.operators.datasets import KEYS
from stockloom.session import published

#: Most lines of a ranking, and of a list of the stock view.
MOST, SHOWN = 10, 8

SOLD_IN_STORE = ["least_sold_product_by_store", "top_sold_product_by_store"]
SOLD_IN_STORE_RANKED = ["least_sold_products_ranked_by_store", "top_sold_products_ranked_by_store"]
SOLD_IN_CATEGORY = ["least_sold_product_by_category", "top_sold_product_by_category"]
SALES_INTENTS = ["sales_ranking", *SOLD_IN_STORE, *SOLD_IN_STORE_RANKED, *SOLD_IN_CATEGORY, "sales_summary_by_store", "product_performance"]

# Answers when nothing fits.
NO_SALES = "I could not find enough sales records for that location in the current dataset."
NO_STORE = "I couldn't match that store or city yet. Can you check whether it exists in the stores?"
NO_MOVES = "No major transfer imbalance is currently detected across stores."
NO_SURPLUS = "I do not see any products with major surplus stock in that scope right now."
NO_ALTERNATIVE = "I do not see a same-category alternative option for the matched low-stock item right now."
NO_INVENTORY = "I couldn't find inventory rows for that product or store yet."


def _scope_key(entity: str) -> Column:
    """A name for a set of ids that does not depend on their order."""
    return F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64(entity).cast("decimal(38,0)")))


def _scopes(links: DataFrame, name: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(normal, scope, number of ids) and (scope, id)."""
    per_text = links.groupBy("normal").agg(_scope_key("entity").alias(name), F.count(F.lit(1)).alias(f"{name}_size"))
    members = links.join(per_text, "normal").select(name, F.col("entity").alias(column)).distinct()
    return per_text, members


def asked(questions: DataFrame, stores: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """`texts` (normal, intent, ask), `asks` (one row per tuple of parameters), `store_scopes`, `product_scopes`."""
    texts = questions.select(tx.normalized("question").alias("normal")).distinct()
    # links are costly and read several times; there are a few per text
    texts = published(texts)
    store_links = published(qu.linked(texts, qu.store_aliases(stores), qu.STORE_CUTOFF))
    product_links = published(qu.linked(texts, qu.product_aliases(products), qu.PRODUCT_CUTOFF))
    category = published(qu.linked_category(texts, qu.category_aliases(products)).withColumnRenamed("entity", "category"))
    per_store, store_scopes = _scopes(store_links, "store_scope", "store_id")
    per_product, product_scopes = _scopes(product_links, "product_scope", "product_id")

    t = F.col("normal")
    places = stores.select(F.col("store_id").alias("entity"), "store_name", "city")
    named = store_links.join(places, "entity").withColumn("said", t.contains(tx.normalized("city")) & (tx.normalized("city") != ""))
    labels = named.groupBy("normal").agg(
        F.when(F.count(F.lit(1)) == 1, F.min("store_name")).when(F.count_distinct("city") == 1, F.min("city")).otherwise("the matched stores").alias("label"),
        F.min(F.when(F.col("said"), F.col("city"))).alias("said_city"),
    )
    first_product = product_links.join(products.select(F.col("product_id").alias("entity"), "product_name"), "entity").groupBy("normal").agg(
        F.min_by("product_name", "entity").alias("first_product")
    )
    rows = reduce(lambda a, b: a.join(b, "normal", "left"), [per_store, per_product, category, labels, first_product], texts)
    blank = ["store_scope", "product_scope", "category", "label", "first_product"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in blank})
    has_store, has_category = F.col("store_scope") != "", F.col("category") != ""
    rows = rows.withColumns(
        {
            "intent": tx.question_intent(t, has_store, has_category),
            "ascending": tx.ranking_direction(t) == "ascending",
            "metric": tx.ranking_metric(t),
            "entity": tx.ranking_entity(t, has_category),
            "time_scope": tx.time_scope(t),
            "asked_label": F.coalesce("said_city", "label"),
        }
    )
    default = F.when((F.col("entity") == "category") & ~t.rlike(r"\b\d+\b"), 1).otherwise(5)
    variant = (
        F.when(F.col("intent") == "transfer_analysis", tx.transfer_kind(t))
        .when((F.col("intent") == "sales_ranking") & ~has_store & ~has_category & tx.names_a_place(t), "elsewhere")
        .when(t.contains("fastest moving"), "fastest")
        .otherwise("")
    )
    rows = rows.withColumns(
        {
            "requested_limit": F.when(F.col("intent") == "sales_ranking", tx.requested_limit(t, default=default)).otherwise(tx.requested_limit(t)),
            "variant": variant,
        }
    )
    fields = ["intent", "store_scope", "product_scope", "category", "ascending", "metric", "entity", "time_scope", "requested_limit", "variant", "label", "asked_label", "first_product"]
    rows = rows.withColumn("ask", F.concat_ws("|", *fields))
    return {
        "texts": rows.select("normal", "intent", "ask"),
        "asks": rows.select("ask", *fields).distinct(),
        "store_scopes": store_scopes,
        "product_scopes": product_scopes,
    }


# --- building blocks --------------------------------------------------------------------------


def _line(place: Column, *parts) -> list[Column]:
    """ask, place and text of one line; text parts are literals or columns."""
    return [F.col("ask"), place.cast("long").alias("place"), F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("line")]


def _of(*intents: str) -> Column:
    return F.col("intent").isin(*intents)


def _headed(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """The lines under the headings (place 0) of the asks that have any."""
    return lines.unionByName(heads.join(lines.select("ask").distinct(), "ask", "left_semi"))


def _first(rows: DataFrame, order: list[Column], limit: Column, most: int = MOST, key: str = "ask") -> DataFrame:
    """The first rows of every key, with their place; at most `limit` of them."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).filter((F.col("place") <= most) & (F.col("place") <= limit))


def _in_scope(rows: DataFrame, asks: DataFrame, scopes: dict[str, DataFrame], order: list[Column] | None = None) -> DataFrame:
    """The rows in the scope of every ask: by store, by product, by both, or all. With `order`, an ask without a
    scope sees the first MOST rows only."""
    by_store, by_product = F.col("store_scope") != "", F.col("product_scope") != ""
    in_stores = rows.join(asks.filter(by_store & ~by_product).join(scopes["store_scopes"], "store_scope"), "store_id")
    in_products = rows.join(asks.filter(~by_store & by_product).join(scopes["product_scopes"], "product_scope"), "product_id")
    both = asks.filter(by_store & by_product).join(scopes["store_scopes"], "store_scope").join(scopes["product_scopes"], "product_scope")
    in_both = rows.join(both, KEYS)
    whole = rows.orderBy(*order).limit(MOST) if order else rows
    everywhere = whole.withColumn("store_scope", F.lit("")).join(asks.filter(~by_store & ~by_product), "store_scope")
    return reduce(DataFrame.unionByName, [in_stores, in_products, in_both, everywhere])


def _scope_name(otherwise: str) -> Column:
    return F.when(F.col("store_scope") != "", F.col("label")).otherwise(otherwise)


# --- sales ------------------------------------------------------------------------------------


def _totals(sold: DataFrame, asks: DataFrame, scopes: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Asks with the name of their sales scope, and (scope, product) totals with the newest day of the scope."""
    by_category = _of("sales_ranking", *SOLD_IN_CATEGORY)
    asks = asks.filter(_of(*SALES_INTENTS)).withColumns(
        {
            "in_store": F.when(_of(*SOLD_IN_CATEGORY), "").otherwise(F.col("store_scope")),
            "in_category": F.when(by_category & (F.col("category") != ""), F.lower(F.trim("category"))).otherwise("*"),
            "in_time": F.when(_of("sales_ranking"), F.col("time_scope")).otherwise(""),
        }
    ).withColumn("scope", F.concat_ws("|", "in_store", "in_category", "in_time"))
    wanted = asks.select("scope", "in_store", "in_category", "in_time").distinct()
    members = scopes["store_scopes"].withColumnRenamed("store_scope", "in_store").withColumnRenamed("store_id", "in_store_id")
    wanted = wanted.join(members, "in_store", "left").withColumn("in_store_id", F.coalesce("in_store_id", F.lit("*"))).drop("in_store")

    def cells(keys: list[str]) -> DataFrame:
        """Sums by store and by all stores, by category and by all categories."""
        grain = [*keys, "product_id", "product_name", "category"]
        sums = [F.sum("quantity_sold").alias("quantity_sold"), F.sum("sales_value").alias("sales_value")]
        stores = sold.groupBy(*grain, "store_id").agg(*sums).withColumnRenamed("store_id", "in_store_id")
        stores = stores if keys else published(stores)
        both = stores.unionByName(stores.groupBy(*grain).agg(*sums).withColumn("in_store_id", F.lit("*")))
        return both.withColumn("in_category", F.explode(F.array(F.lower(F.trim("category")), F.lit("*"))))

    on = ["in_store_id", "in_category"]
    ever = cells([]).join(wanted.filter("in_time = ''"), on).withColumn("newest", F.lit(None).cast("date"))
    dated = cells(["date"]).join(wanted.filter("in_time <> ''"), on)
    newest = dated.groupBy("scope").agg(F.max("date").alias("newest"))
    inside = F.col("date") >= F.date_sub("newest", F.when(F.col("in_time") == "today", 0).otherwise(6))
    recent = dated.join(newest, "scope").filter(inside).drop("date")
    totals = ever.unionByName(recent).groupBy("scope", "product_id", "product_name", "category").agg(
        F.sum("quantity_sold").alias("quantity_sold"), F.sum("sales_value").alias("sales_value"), F.max("newest").alias("newest")
    )
    return asks, totals


def _ranked(asks: DataFrame, totals: DataFrame) -> DataFrame:
    """The first rows of every ranking that is asked for: one ranking per scope, entity, metric and direction."""
    asks = asks.filter(_of("sales_ranking", *SOLD_IN_STORE, *SOLD_IN_STORE_RANKED, *SOLD_IN_CATEGORY)).withColumns(
        {
            "ascending": F.when(_of("sales_ranking"), F.col("ascending")).otherwise(F.col("intent").startswith("least")),
            "metric": F.when(_of("sales_ranking"), F.col("metric")).otherwise("quantity"),
            "entity": F.when(_of("sales_ranking"), F.col("entity")).otherwise("product"),
            "requested_limit": F.when(_of(*SOLD_IN_STORE, *SOLD_IN_CATEGORY), 1).otherwise(F.col("requested_limit")),
        }
    ).withColumn("ranking", F.concat_ws("|", "scope", "entity", "metric", "ascending"))
    kinds = asks.select("ranking", "scope", "entity", "metric", "ascending").distinct()
    by_product = totals.select("scope", F.lit("product").alias("entity"), F.col("product_name").alias("name"), "product_id", "category", "quantity_sold", "sales_value", "newest")
    by_category = totals.filter(F.trim("category") != "").groupBy("scope", "category").agg(
        F.sum("quantity_sold").alias("quantity_sold"), F.sum("sales_value").alias("sales_value"), F.max("newest").alias("newest")
    )
    by_category = by_category.select(
        "scope", F.lit("category").alias("entity"), F.col("category").alias("name"), F.lit("").alias("product_id"), "category", "quantity_sold", "sales_value", "newest"
    )
    rows = by_product.unionByName(by_category).join(kinds, ["scope", "entity"])
    value = F.when(F.col("metric") == "revenue", F.col("sales_value")).otherwise(F.col("quantity_sold"))
    order = [F.when(F.col("ascending"), value).otherwise(-value), F.col("name"), F.col("product_id")]
    first = _first(rows, order, F.lit(MOST), key="ranking").drop("scope", "entity", "metric", "ascending").withColumnRenamed("category", "of_category")
    return first.join(asks, "ranking").filter(F.col("place") <= F.col("requested_limit"))


def _sales_answers(sold: DataFrame, asks: DataFrame, scopes: dict[str, DataFrame]) -> DataFrame:
    asks, totals = _totals(sold, asks, scopes)
    unmatched = (F.col("variant") == "elsewhere") | (_of(*SOLD_IN_STORE, *SOLD_IN_STORE_RANKED, "sales_summary_by_store") & (F.col("store_scope") == ""))
    asks = asks.filter(~unmatched)
    rows = _ranked(asks, totals)
    place, name, units = F.col("place"), F.col("name"), F.col("quantity_sold")
    many = F.format_number(units, 0)
    lists = rows.filter(_of("sales_ranking"))
    by_value = F.concat(F.format_number("sales_value", 2), F.lit(" sales value ("), many, F.lit(" units sold)"))
    lines = lists.select(*_line(place, place, ". **", name, "** - ", F.when(F.col("metric") == "revenue", by_value).otherwise(F.concat(many, F.lit(" units sold")))))
    counts = lists.groupBy("ask").agg(F.count(F.lit(1)).alias("n"), F.max("newest").alias("newest"))
    about = lists.filter("place = 1").drop("newest").join(counts, "ask")
    about = about.withColumn("all_of", F.when(F.col("entity") == "category", "categories").when(F.col("category") != "", F.concat("category", F.lit(" products"))).otherwise("items"))
    when = F.when(F.col("time_scope") == "last_7_days", F.concat(F.lit(" for the week ending "), F.col("newest").cast("string"))).when(
        F.col("time_scope") == "today", F.concat(F.lit(" on "), F.col("newest").cast("string"))
    )
    word = F.when(F.col("variant") == "fastest", "Fastest moving").when(F.col("ascending"), "Lowest").otherwise("Top")
    scope = F.concat("all_of", F.when(F.col("store_scope") != "", F.concat(F.lit(" in "), "asked_label")).otherwise(""), F.coalesce(when, F.lit("")))
    heads = about.select(*_line(F.lit(0), word, " ", F.col("n"), " selling ", scope, " by ", F.when(F.col("metric") == "revenue", "revenue").otherwise("units sold"), ":"))

    ranked = rows.filter(_of(*SOLD_IN_STORE_RANKED))
    lines = lines.unionByName(ranked.select(*_line(place, place, ". ", name, " - ", units, " units")))
    numbers = ranked.groupBy("ask", "label", "ascending").agg(F.count(F.lit(1)).alias("n"))
    which = F.when(F.col("ascending"), "least").otherwise("top")
    heads = heads.unionByName(numbers.select(*_line(F.lit(0), "The ", which, " ", F.col("n"), " selling items in ", F.col("label"), " are:")))

    sold_in_store = rows.filter(_of(*SOLD_IN_STORE))
    which = F.when(F.col("ascending"), "least sold").otherwise("top selling")
    lines = lines.unionByName(
        sold_in_store.select(*_line(F.lit(0), "The ", which, " product in ", F.col("label"), " is ", name, ", with ", units, " units sold in the current sales data."))
    )
    which = F.when(F.col("ascending"), "least").otherwise("most")
    lines = lines.unionByName(
        rows.filter(_of(*SOLD_IN_CATEGORY)).select(*_line(F.lit(0), "The ", which, " sold ", F.trim("of_category"), " product is ", name, ", with ", units, " units sold."))
    )
    sums = asks.filter(_of("sales_summary_by_store")).join(totals.drop("category"), "scope").groupBy("ask", "label").agg(
        F.sum("quantity_sold").alias("units"), F.sum("sales_value").alias("value")
    )
    said = sums.select(
        *_line(F.lit(0), "Sales in ", F.col("label"), " total ", F.col("units"), " units in the current sales data, worth about ", F.format_number("value", 2), ".")
    )
    performers = asks.filter(_of("product_performance") & (F.col("product_scope") != "")).join(scopes["product_scopes"], "product_scope")
    best = performers.join(totals.drop("category"), ["scope", "product_id"])
    best = _first(best, [F.desc("quantity_sold"), F.asc("product_id")], F.lit(1))
    said = said.unionByName(best.select(*_line(F.lit(0), F.col("product_name"), " has sold ", units, " units in ", _scope_name("the available sales data"), ".")))
    return lines.unionByName(heads).unionByName(said)


# --- stock ------------------------------------------------------------------------------------


def _stock_answers(ws, asks: DataFrame, scopes: dict[str, DataFrame]) -> DataFrame:
    """Exclusive, surplus, understock and overstock lists, category stock, best stocked store, low stock and totals."""
    place, product = F.col("place"), F.col("product_name")
    limit = F.col("requested_limit")
    no_products = asks.withColumn("product_scope", F.lit(""))
    out = []

    exclusive = ws.exclusive_items.withColumnRenamed("exclusive_store_id", "store_id")
    order = [F.desc("available_quantity"), F.asc("product_name"), F.asc("product_id")]
    columns = [*KEYS, "product_name", "exclusive_store_name", "available_quantity"]
    mine = no_products.filter(_of("exclusive_availability"))
    rows = _first(_in_scope(published(exclusive.select(*columns)), mine, scopes, order), order, limit)
    lines = rows.select(*_line(place, place, ". **", product, "** is only available at ", F.col("exclusive_store_name"), " with ", F.col("available_quantity"), " units."))
    out.append(_headed(lines, mine.select(*_line(F.lit(0), "Exclusive store availability in ", _scope_name("all stores"), ":"))))

    order = [F.asc("opportunity_level"), F.desc("surplus_quantity"), F.asc("product_name"), F.asc("store_id")]
    columns = [*KEYS, "product_name", "store_name", "current_quantity", "surplus_quantity", "opportunity_level"]
    mine = asks.filter(_of("surplus_stock"))
    rows = _first(_in_scope(published(ws.surplus_stock.select(*columns)), mine, scopes, order), order, limit)
    have = [" has ", F.col("current_quantity"), " units, with ", F.col("surplus_quantity"), " units above threshold."]
    lines = rows.select(*_line(place, place, ". **", product, "** at ", F.col("store_name"), *have))
    out.append(_headed(lines, mine.select(*_line(F.lit(0), "Stores and products with extra stock:"))))

    measures = ["product_name", "store_name", "category", "current_quantity", "reorder_threshold", "priority", "shortage_quantity", "surplus_quantity", "stock_status"]
    view = published(ws.store_view.select(*KEYS, *measures))  # read by every list below, scope by scope
    order = [F.asc("priority"), F.desc("shortage_quantity"), *map(F.asc, KEYS)]
    columns = [*KEYS, "product_name", "current_quantity", "reorder_threshold", "priority", "shortage_quantity"]
    mine = no_products.filter(_of("store_understock"))
    low = view.filter(F.col("stock_status") == "Low Stock").select(*columns)
    rows = _first(_in_scope(low, mine, scopes, order), order, F.lit(SHOWN))
    lines = rows.select(*_line(place, place, ". **", product, "** has ", F.col("current_quantity"), " units against threshold ", F.col("reorder_threshold"), "."))
    out.append(_headed(lines, mine.select(*_line(F.lit(0), "Understocked items in ", _scope_name("all stores"), ":"))))

    order = [F.desc("surplus_quantity"), F.desc("current_quantity"), *map(F.asc, KEYS)]
    columns = [*KEYS, "product_name", "current_quantity", "surplus_quantity"]
    mine = no_products.filter(_of("store_overstock"))
    over = view.filter(F.col("stock_status") == "Overstock").select(*columns)
    rows = _first(_in_scope(over, mine, scopes, order), order, F.lit(SHOWN))
    lines = rows.select(*_line(place, place, ". **", product, "** has ", F.col("current_quantity"), " units; surplus is ", F.col("surplus_quantity"), " units."))
    out.append(_headed(lines, mine.select(*_line(F.lit(0), "Overstocked items in ", _scope_name("all stores"), ":"))))

    # small sums per store first: what a scope adds up are a few rows per store
    mine = no_products.filter(_of("category_inventory"))
    cells = view.groupBy("store_id", "category").agg(F.sum("current_quantity").alias("units")).withColumnRenamed("category", "of_category")
    sums = _in_scope(cells.withColumn("product_id", F.lit("")), mine, scopes).groupBy("ask", "of_category").agg(F.sum("units").alias("units"))
    rows = _first(sums, [F.desc("units"), F.asc("of_category")], F.lit(SHOWN))
    lines = rows.select(*_line(place, place, ". **", F.col("of_category"), "**: ", F.col("units"), " units."))
    out.append(_headed(lines, mine.select(*_line(F.lit(0), "Category-wise inventory in ", _scope_name("all stores"), ":"))))

    best = view.groupBy("store_id", "store_name").agg(F.sum("current_quantity").alias("units")).agg(
        F.min_by(F.struct("store_name", "units"), F.struct(-F.col("units"), "store_id")).alias("best")
    )
    said = best.filter("best is not null").withColumn("intent", F.lit("store_inventory_comparison")).join(asks.select("ask", "intent"), "intent")
    out.append(said.select(*_line(F.lit(0), F.col("best.store_name"), " has the highest inventory with ", F.col("best.units"), " units.")))

    mine = no_products.filter(_of("low_stock_by_store") & (F.col("store_scope") != ""))
    counts = ws.low_stock.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))
    counts = mine.join(scopes["store_scopes"], "store_scope").join(counts, "store_id").groupBy("ask", "label").agg(F.sum("n").alias("n"))
    items = F.when(F.col("n") == 1, " low-stock item").otherwise(" low-stock items")
    out.append(counts.select(*_line(F.lit(0), F.col("label"), " has ", F.col("n"), items, " in the current data.")))

    mine = asks.filter(_of("general_inventory_question"))
    levels = view.select(*KEYS, F.col("current_quantity").alias("units"))
    whole = levels.agg(F.sum("units").alias("units")).filter("units is not null")
    whole = whole.withColumn("store_scope", F.lit("")).join(mine.filter("store_scope = '' and product_scope = ''"), "store_scope")
    some = _in_scope(levels, mine.filter("store_scope <> '' or product_scope <> ''"), scopes)
    sums = some.groupBy("ask", "store_scope", "label").agg(F.sum("units").alias("units"))
    sums = sums.unionByName(whole.select(*sums.columns))
    out.append(sums.select(*_line(F.lit(0), "There are ", F.col("units"), " units in ", _scope_name("the current inventory data"), ".")))
    return reduce(DataFrame.unionByName, out)


def _alternative_answers(ws, asks: DataFrame, scopes: dict[str, DataFrame], stores: DataFrame, products: DataFrame) -> DataFrame:
    """Alternatives whose low or offered side is named; a row that fits on both sides counts once."""
    sides = ["low_stock_product", "low_stock_store", "alternative_product", "alternative_store"]
    rows = published(ws.alternative_availability.select(*sides, "available_quantity", "alternative_type"))
    order = [F.desc("alternative_type"), F.desc("available_quantity"), F.asc("alternative_product"), *map(F.asc, ["low_stock_product", "low_stock_store", "alternative_store"])]
    mine = asks.filter(_of("alternative_options"))
    named_stores = scopes["store_scopes"].join(stores.select("store_id", "store_name"), "store_id").select("store_scope", F.col("store_name").alias("_store")).distinct()
    named_products = scopes["product_scopes"].join(products.select("product_id", "product_name"), "product_id").select("product_scope", F.col("product_name").alias("_product")).distinct()

    def either(found: DataFrame, low: str, offered: str, names: DataFrame, name: str, keys: list[str]) -> DataFrame:
        as_low = found.join(names.withColumnRenamed(name, low), [*keys, low])
        as_offered = found.join(names.withColumnRenamed(name, offered), [*keys, offered])
        return as_low.unionByName(as_offered.filter(~F.col(low).eqNullSafe(F.col(offered))).select(*as_low.columns)).distinct()

    by_store, by_product = F.col("store_scope") != "", F.col("product_scope") != ""
    in_products = either(rows, "low_stock_product", "alternative_product", mine.filter(by_product).join(named_products, "product_scope").select("ask", "store_scope", "requested_limit", "_product"), "_product", [])
    in_stores = either(rows, "low_stock_store", "alternative_store", mine.filter(by_store & ~by_product).join(named_stores, "store_scope").select("ask", "store_scope", "requested_limit", "_store"), "_store", [])
    in_both = either(in_products.filter(by_store), "low_stock_store", "alternative_store", named_stores, "_store", ["store_scope"])
    everywhere = rows.orderBy(*order).limit(MOST).withColumn("store_scope", F.lit("")).join(
        mine.filter(~by_store & ~by_product).select("ask", "store_scope", "requested_limit"), "store_scope"
    )
    parts = [in_products.filter(~by_store), in_stores, in_both, everywhere]
    found = _first(reduce(DataFrame.unionByName, parts), order, F.col("requested_limit"))
    kind = F.when(F.col("alternative_type") == "same_product_transfer", "transfer source").otherwise("category alternative")
    place = F.col("place")
    lines = found.select(
        *_line(
            place, place, ". If **", F.col("low_stock_product"), "** is low at ", F.col("low_stock_store"), ", offer **", F.col("alternative_product"), "** as a ", kind,
            " from ", F.col("alternative_store"), " with ", F.col("available_quantity"), " units.",
        )
    )
    return _headed(lines, mine.select(*_line(F.lit(0), "Alternative options for low-stock items:")))


def _transfer_answers(ws, asks: DataFrame) -> DataFrame:
    """The first shortages, surpluses or opportunities of all stores."""
    place, product, store = F.col("place"), F.col("product_name"), F.col("store_name")
    mine = asks.filter(_of("transfer_analysis")).select("ask", "variant", "requested_limit")
    by = lambda order: Window.partitionBy("kind").orderBy(*order)

    def few(rows: DataFrame, kinds: list[str], order: list[Column]) -> DataFrame:
        """MOST rows, each with its place, for the asks of these kinds."""
        ten = rows.withColumn("kind", F.lit("")).withColumn("place", F.row_number().over(by(order))).drop("kind")
        asks_of = mine.filter(F.col("variant").isin(*kinds)).withColumn("_one", F.lit(1))
        return ten.withColumn("_one", F.lit(1)).join(asks_of, "_one").filter(F.col("place") <= F.col("requested_limit"))

    whole = lambda c: F.rint(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).cast("long")
    days = (F.rint(F.col("days_of_inventory_remaining") * 10) / 10).cast("decimal(20,1)")
    order = [F.desc("surplus_score"), F.desc("surplus_quantity"), *map(F.asc, KEYS)]
    rows = few(tr.top_surpluses(ws.transfer_analysis, MOST), ["surplus"], order)
    lines = rows.select(*_line(place, place, ". **", product, "** at ", store, " - ", whole("surplus_quantity"), " units available above transfer buffer"))
    out = [_headed(lines, mine.filter("variant = 'surplus'").select(*_line(F.lit(0), "Highest surplus stock signals:")))]
    order = [F.desc("shortage_score"), F.desc("recent_daily_sales_velocity"), *map(F.asc, KEYS)]
    rows = few(tr.top_shortages(ws.transfer_analysis, MOST), ["shortage"], order)
    hand = [" - ", whole("stock_level"), " units on hand, threshold ", whole("reorder_threshold"), ", ", days, " days remaining"]
    lines = rows.select(*_line(place, place, ". **", product, "** at ", store, *hand))
    out.append(_headed(lines, mine.filter("variant = 'shortage'").select(*_line(F.lit(0), "Highest shortage risk branches:"))))
    order = [F.asc("priority"), F.desc("opportunity_score"), F.desc("suggested_quantity"), F.asc("product_id"), F.asc("target_store_id")]
    rows = few(tr.top_opportunities(ws.opportunities, MOST), ["top", "recommended"], order)
    text = F.concat(
        place, F.lit(". Transfer **"), product, F.lit("**\n   From: "), "source_store_name", F.lit("\n   To: "), "target_store_name",
        F.lit("\n   Suggested Quantity: "), "suggested_quantity", F.lit(" units\n   Priority: "), "priority",
    )
    lines = rows.select(*_line(place, text))
    heads = mine.filter(F.col("variant").isin("top", "recommended")).select(*_line(F.lit(0), F.initcap("variant"), " transfer opportunities:"))
    out.append(_headed(lines, heads))
    return reduce(DataFrame.unionByName, out)


def _supplier_answers(ws, asks: DataFrame, scopes: dict[str, DataFrame]) -> DataFrame:
    """The least reliable supplier of the named products, or of all when they have none."""
    worst = F.struct(F.coalesce("reliability_score", F.lit(0.0)), -F.coalesce(F.col("avg_delivery_days").cast("long"), F.lit(0)), "supplier_id")
    suppliers = ws.suppliers.select("supplier_id", "supplier_name", worst.alias("rank"))
    mine = asks.filter(_of("supplier_risk")).select("ask", "product_scope", "intent")
    links = scopes["product_scopes"].join(ws.products.select("product_id", "supplier_id"), "product_id").select("product_scope", "supplier_id").distinct()
    scoped = mine.join(links, "product_scope").join(suppliers, "supplier_id").groupBy("ask").agg(F.min_by("supplier_name", "rank").alias("mine"))
    overall = suppliers.agg(F.min_by("supplier_name", "rank").alias("all")).filter("all is not null").withColumn("intent", F.lit("supplier_risk"))
    named = mine.join(scoped, "ask", "left").join(overall, "intent")
    return named.select(*_line(F.lit(0), "The riskiest supplier in the current data is ", F.coalesce("mine", "all"), "."))


def _without_rows() -> Column:
    """What an ask is told when its scope holds nothing."""
    store = F.col("store_scope") != ""
    return (
        F.when(_of("sales_ranking"), NO_SALES)
        .when(_of(*SOLD_IN_STORE, *SOLD_IN_STORE_RANKED, "sales_summary_by_store", "low_stock_by_store") & ~store, NO_STORE)
        .when(_of(*SOLD_IN_STORE, *SOLD_IN_STORE_RANKED, "sales_summary_by_store"), F.concat(F.lit("I couldn't find sales data for "), "label", F.lit(" yet.")))
        .when(_of(*SOLD_IN_CATEGORY), F.concat(F.lit("I found sales data, but not for the "), "category", F.lit(" category.")))
        .when(
            _of("product_performance") & (F.col("product_scope") != ""),
            F.concat(F.lit("I couldn't find sales data for "), "first_product", F.lit(" in that scope yet.")),
        )
        .when(_of("transfer_analysis"), NO_MOVES)
        .when(_of("exclusive_availability"), F.concat(F.lit("I do not see any products exclusively available in "), _scope_name("the current data"), F.lit(" right now.")))
        .when(_of("surplus_stock"), NO_SURPLUS)
        .when(_of("alternative_options"), NO_ALTERNATIVE)
        .when(_of("store_understock"), F.concat(F.lit("I do not see understocked items in "), _scope_name("all stores"), F.lit(" right now.")))
        .when(_of("store_overstock"), F.concat(F.lit("I do not see overstocked items in "), _scope_name("all stores"), F.lit(" right now.")))
        .when(_of("low_stock_by_store"), F.concat(F.lit("I don't see any low-stock items in "), "label", F.lit(" right now.")))
        .when(_of("general_inventory_question"), NO_INVENTORY)
        .otherwise("")
    )


def answers(ws, parts: dict[str, DataFrame]) -> DataFrame:
    """ask, answer for every tuple of parameters."""
    asks = parts["asks"]
    families = [
        _sales_answers(sa.sales_dataset(ws.sales, ws.stores, ws.products), asks, parts),
        _stock_answers(ws, asks, parts),
        _alternative_answers(ws, asks, parts, ws.stores, ws.products),
        _transfer_answers(ws, asks),
        _supplier_answers(ws, asks, parts),
    ]
    # a few lines per ask; written family by family, since one plan of all would be optimised over and over
    lines = reduce(DataFrame.unionByName, map(published, families))
    # at most MOST + 1 lines each
    joined = lines.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    told = joined.select("ask", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("found"))
    return asks.join(told, "ask", "left").select("ask", F.coalesce("found", _without_rows()).alias("answer"))


def question_table(ws, questions: DataFrame) -> DataFrame:
    """question_id, question, intent, answer: every question meets the answer of its parameters."""
    # the parameters are read by every family of answers: they are linked and written once
    parts = {name: published(df) for name, df in asked(questions, ws.stores, ws.products).items()}
    known = parts["texts"].join(answers(ws, parts), "ask").select("normal", "intent", "answer")
    rows = questions.select("question_id", "question", tx.normalized("question").alias("normal"))
    return rows.join(known, "normal").select("question_id", "question", "intent", "answer")
