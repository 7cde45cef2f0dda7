"""Stock transfers between stores, exclusive items and alternatives for low stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.functions.exprs import at_least_zero, cover_days, round2, round_even, text, threshold_or_product, whole
from stockloom.functions.ids import running_totals, sequential_numbers
from stockloom.operators.datasets import KEYS
from stockloom.operators.stock_views import sales_velocity_30d

SURPLUS_MULTIPLIER = 2


def prepared_inventory(
    inventory: DataFrame, stores: DataFrame, products: DataFrame, product_fallback: bool = False
) -> DataFrame:
    """Inventory with names, category and city; ids stand in for missing names."""
    dim = products.select(
        "product_id", "product_name", "category", F.col("reorder_threshold").alias("product_threshold")
    )
    thr = (
        threshold_or_product("reorder_threshold", "product_threshold", only_zero=False)
        if product_fallback
        else whole("reorder_threshold")
    )
    return (
        inventory.join(dim, "product_id", "left")
        .join(stores.select("store_id", "store_name", "city"), "store_id", "left")
        .select(
            *KEYS,
            whole("stock_level").alias("stock_level"),
            thr.alias("reorder_threshold"),
            F.coalesce("product_name", "product_id").alias("product_name"),
            F.coalesce("category", F.lit("")).alias("category"),
            F.coalesce("store_name", "store_id").alias("store_name"),
            F.coalesce("city", F.lit("")).alias("city"),
        )
    )


def transfer_analysis(inventory: DataFrame, sales: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Shortage and surplus signals: 7 days of cover for a target, 14 for a source."""
    stock, thr, v = F.col("stock_level"), F.col("reorder_threshold"), F.col("recent_daily_sales_velocity")
    days = F.col("days_of_inventory_remaining")
    floor0 = lambda c: F.greatest(c, F.lit(0.0))
    return (
        prepared_inventory(inventory, stores, products)
        .join(sales_velocity_30d(sales), KEYS, "left")
        .withColumns(
            {
                "recent_30_day_quantity_sold": whole("recent_30_day_quantity_sold"),
                "recent_daily_sales_velocity": F.coalesce(v, F.lit(0.0)),
            }
        )
        .withColumns(
            {
                "days_of_inventory_remaining": cover_days("stock_level", "recent_daily_sales_velocity", 999.0),
                "shortage_quantity": at_least_zero(thr - stock),
                "target_stock_level": thr + v * 7,
                "target_shortage_quantity": floor0(thr + v * 7 - stock),
                "surplus_quantity": floor0(stock - (thr + v * 14)),
            }
        )
        .withColumns(
            {
                "shortage_score": F.col("target_shortage_quantity") + v * 3 + F.when(days <= 7, 10).otherwise(0),
                "surplus_score": F.col("surplus_quantity")
                + F.when(v <= 1, 5).otherwise(0)
                + F.when(days >= 30, 5).otherwise(0),
            }
        )
    )


def shortages(analysis: DataFrame) -> DataFrame:
    v = F.col("recent_daily_sales_velocity")
    return analysis.filter(
        (F.col("target_shortage_quantity") > 0)
        | (F.col("stock_level") <= F.col("reorder_threshold"))
        | ((F.col("days_of_inventory_remaining") <= 7) & (v > 0))
    )


def surpluses(analysis: DataFrame) -> DataFrame:
    return analysis.filter((F.col("surplus_quantity") > 0) & (F.col("stock_level") > F.col("reorder_threshold")))


def top_shortages(analysis: DataFrame, limit: int = 5) -> DataFrame:
    return (
        shortages(analysis).orderBy(F.desc("shortage_score"), F.desc("recent_daily_sales_velocity"), *KEYS).limit(limit)
    )


def top_surpluses(analysis: DataFrame, limit: int = 5) -> DataFrame:
    return surpluses(analysis).orderBy(F.desc("surplus_score"), F.desc("surplus_quantity"), *KEYS).limit(limit)


def best_source(sources: DataFrame, *order: Column) -> DataFrame:
    """The first source row of every product in the given order, as columns `source_*`.

    A map-side aggregation, so a product stocked by many stores never becomes one large group. A row
    cannot be short and have a surplus at once, so the best source is never the target itself.
    """
    kept = [c for c in sources.columns if c != "product_id"]
    best = F.min_by(F.struct(*kept), F.struct(*order)).alias("s")
    return sources.groupBy("product_id").agg(best).select(
        "product_id", *[F.col(f"s.{c}").alias(f"source_{c}") for c in kept]
    )


def transfer_opportunities(analysis: DataFrame) -> DataFrame:
    """Every target with the best-scored surplus store of the same product; sources are not decremented."""
    sources = surpluses(analysis).select(
        *KEYS, "store_name", "city", "stock_level", "surplus_quantity", "surplus_score",
        F.col("recent_daily_sales_velocity").alias("velocity"),
    )
    best = best_source(sources, -F.col("surplus_score"), -F.col("surplus_quantity"), F.col("store_id"))
    needed = F.greatest(F.col("shortage_quantity").cast("double"), "target_shortage_quantity")
    days = F.col("days_of_inventory_remaining")
    high = (F.col("stock_level") <= F.col("reorder_threshold")) | (days <= 7)
    quantity = F.least(round_even(needed), round_even("source_surplus_quantity"))
    return (
        shortages(analysis)
        .join(best, "product_id")
        .withColumn("suggested_quantity", quantity)
        .filter(F.col("suggested_quantity") > 0)
        .select(
            "product_id",
            "product_name",
            "category",
            "source_store_id",
            "source_store_name",
            "source_city",
            F.col("store_id").alias("target_store_id"),
            F.col("store_name").alias("target_store_name"),
            F.col("city").alias("target_city"),
            "suggested_quantity",
            F.when(high, "High").otherwise("Medium").alias("priority"),
            F.col("source_stock_level").alias("source_stock"),
            round_even("source_surplus_quantity").alias("source_surplus"),
            round2("source_velocity").alias("source_velocity"),
            F.col("stock_level").alias("target_stock"),
            F.col("reorder_threshold").alias("target_threshold"),
            round2("recent_daily_sales_velocity").alias("target_velocity"),
            (F.rint(days * 10) / 10).alias("target_days_remaining"),
            round2(F.col("shortage_score") + F.col("source_surplus_score")).alias("opportunity_score"),
        )
    )


def top_opportunities(opportunities: DataFrame, limit: int = 5) -> DataFrame:
    return opportunities.orderBy(
        "priority", F.desc("opportunity_score"), F.desc("suggested_quantity"), "product_id", "target_store_id"
    ).limit(limit)


def exclusive_items(inventory: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Products with positive stock in exactly one store."""
    inv = prepared_inventory(inventory, stores, products)
    held = F.when(F.col("stock_level") > 0, F.col("store_id"))
    per_product = inv.groupBy("product_id").agg(
        F.min(held).alias("first_store"),
        F.max(held).alias("last_store"),
        F.countDistinct("store_id").alias("inventory_store_rows"),
    ).filter(F.col("first_store") == F.col("last_store"))
    # The store dimension as one sorted array: a list of the other stores is part of every output row.
    directory = stores.agg(F.array_sort(F.collect_set(F.struct("store_id", "store_name"))).alias("all")).scalar()
    others = F.filter(F.col("directory"), lambda s: s["store_id"] != F.col("store_id"))
    name, at, cat = F.col("product_name"), F.col("store_name"), F.col("category")
    return (
        inv.filter(F.col("stock_level") > 0)
        .join(per_product, "product_id")
        .join(products.select("product_id", "selling_price"), "product_id", "left")
        .withColumn("directory", directory)
        .select(
            "product_id",
            "product_name",
            "category",
            F.col("store_id").alias("exclusive_store_id"),
            at.alias("exclusive_store_name"),
            "city",
            F.col("stock_level").alias("available_quantity"),
            "selling_price",
            F.concat(name, F.lit(" is available only at "), at, F.lit(" with "), "stock_level", F.lit(" units.")).alias(
                "business_note"
            ),
            F.concat(
                F.lit("Promote "), name, F.lit(" as an alternative "), cat, F.lit(" option from "), at,
                F.lit(" when similar products are low elsewhere."),
            ).alias("alternative_recommendation"),
            F.array_join(F.transform(others, lambda s: s["store_name"]), " | ").alias("unavailable_store_names"),
            "inventory_store_rows",
        )
        .orderBy(F.desc("available_quantity"), "product_name")
    )


def low_stock_scope(
    inventory: DataFrame, products: DataFrame, stores: DataFrame, low_stock: DataFrame | None = None
) -> DataFrame:
    """Given low rows under common names, else inventory rows at or below their own threshold."""
    if low_stock is None:
        inv = prepared_inventory(inventory, stores, products)
        out = inv.withColumn("effective_reorder_threshold", F.col("reorder_threshold"))
        return out.filter(F.col("stock_level") <= F.col("effective_reorder_threshold"))
    if "stock_level" not in low_stock.columns and "current_quantity" in low_stock.columns:
        low_stock = low_stock.withColumn("stock_level", F.col("current_quantity"))
    if "effective_reorder_threshold" not in low_stock.columns and "reorder_threshold" in low_stock.columns:
        low_stock = low_stock.withColumn("effective_reorder_threshold", F.col("reorder_threshold"))
    return low_stock


def ranked_in_category(candidates: DataFrame, order: list, per_product: int, keep: int) -> DataFrame:
    """The first `keep` candidates of every category, at most `per_product` rows of one product.

    Both ranks have a limit, so Spark prunes each group before the shuffle and a large category is
    reduced on the map side.
    """
    within = Window.partitionBy("category", "product_id").orderBy(*order)
    across = Window.partitionBy("category").orderBy(*order)
    return (
        candidates.withColumn("product_rank", F.row_number().over(within))
        .filter(F.col("product_rank") <= per_product)
        .drop("product_rank")
        .withColumn("category_rank", F.row_number().over(across))
        .filter(F.col("category_rank") <= keep)
    )


def with_category_options(low: DataFrame, ranked: DataFrame, fields: list[str], top_n: int) -> DataFrame:
    """Each low row with its first `top_n` options of the category that are another product.

    The options of a category are one short array (`ranked` holds a fixed number per category), joined
    once per low row; no pairs are formed before the choice.
    """
    item = F.struct("category_rank", *fields)
    options = ranked.groupBy("category").agg(F.array_sort(F.collect_list(item)).alias("options"))
    other = F.filter(F.col("options"), lambda o: o["product_id"] != F.col("low_product_id"))
    return (
        low.join(options, F.col("low_category") == F.col("category"))
        .withColumn("option", F.explode(F.slice(other, 1, top_n)))
        .drop("options", "category")
    )


def alternative_candidates(inventory: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Stocked rows that can stand in for another product of their category, with the exclusive flag."""
    inv = prepared_inventory(inventory, stores, products).filter((F.col("stock_level") > 0) & (F.col("category") != ""))
    single = inv.groupBy("product_id").agg(
        (F.min("store_id") == F.max("store_id")).alias("is_exclusive")
    )
    return inv.join(single, "product_id").select(
        *KEYS, "product_name", "store_name", "category", "is_exclusive", F.col("stock_level").alias("available_quantity")
    )


def _alternative_order() -> list[Column]:
    return [F.desc("is_exclusive"), F.desc("available_quantity"), F.asc("product_name"), F.asc("store_id")]


def _low_rows(low_stock: DataFrame) -> DataFrame:
    return low_stock.select(
        F.col("product_id").alias("low_product_id"),
        text("product_name", F.col("product_id")).alias("low_stock_product"),
        F.col("store_id").alias("low_store_id"),
        text("store_name", F.col("store_id")).alias("low_stock_store"),
        text("category").alias("low_category"),
    )


def alternative_products(low_stock: DataFrame, candidates: DataFrame) -> DataFrame:
    """The whole relation "low row - alternative" in factored form: every low row with its category and the
    exact numbers of its alternatives, which are the candidates of that category with another product.

    The pairs grow with the square of a category, so they are never stored: the two factors are this table
    and `candidates`, and `alternative_pairs` joins them where pairs are asked for.
    """
    exclusive = F.count_if("is_exclusive")
    own = candidates.groupBy("category", "product_id").agg(F.count(F.lit(1)).alias("own"), exclusive.alias("own_exclusive"))
    whole_category = own.groupBy("category").agg(
        F.sum("own").alias("all"), F.sum("own_exclusive").alias("all_exclusive"), F.count(F.lit(1)).alias("products")
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return (
        _low_rows(low_stock)
        .join(whole_category.withColumnRenamed("category", "low_category"), "low_category", "left")
        .join(own.withColumnsRenamed({"category": "low_category", "product_id": "low_product_id"}), ["low_category", "low_product_id"], "left")
        .select(
            F.col("low_product_id").alias("low_stock_product_id"),
            "low_stock_product",
            F.col("low_store_id").alias("low_stock_store_id"),
            "low_stock_store",
            F.col("low_category").alias("category"),
            (n("all") - n("own")).alias("alternative_total"),
            (n("all_exclusive") - n("own_exclusive")).alias("exclusive_total"),
            (n("products") - F.when(F.col("own") > 0, 1).otherwise(0)).cast("long").alias("alternative_product_total"),
        )
    )


def best_of_product(candidates: DataFrame) -> DataFrame:
    """The first row of each product in each category, in the order of alternatives."""
    order = Window.partitionBy("category", "product_id").orderBy(*_alternative_order())
    return candidates.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")


def alternative_pairs(low_stock: DataFrame, candidates: DataFrame, salts: int = 16) -> DataFrame:
    """All pairs of the relation, one row each; the candidates of a category are dealt over `salts` keys."""
    dealt = candidates.withColumn("salt", F.pmod(F.xxhash64(*KEYS), F.lit(salts)).cast("int"))
    low = _low_rows(low_stock).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = (F.col("low_category") == F.col("category")) & (low["salt"] == dealt["salt"])
    return low.join(dealt, same & (F.col("low_product_id") != F.col("product_id"))).drop("salt")


#: Low rows and products of a block of pairs; together they bound the pairs that one join key makes.
LOW_BLOCK, PRODUCT_BLOCK = 4096, 512


def numbered_factors(low_stock: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The relation of low rows and alternative products as two tables, from which every pair gets a dense place
    in (low product, low store, alternative product) order without a sort of the pairs.

    Products, each by its best row, are numbered by category and id. A low row knows the first number of its
    category, its own product's number and how many pairs come before it. Low rows without a pair leave. Rows
    that repeat a product and store have their own places, one after the other. `exclusive` counts the pairs with
    an exclusive product.
    """
    best = sequential_numbers(best_of_product(candidates), ["category", "product_id"], "number")
    low = _low_rows(low_stock)
    whole_category = best.groupBy(F.col("category").alias("low_category")).agg(
        F.min("number").alias("first"), F.count(F.lit(1)).alias("products"), F.count_if("is_exclusive").alias("exclusive")
    )
    own = best.select(
        F.col("category").alias("low_category"), F.col("product_id").alias("low_product_id"), F.col("number").alias("own"), F.col("is_exclusive").alias("own_exclusive")
    )
    low = low.join(whole_category, "low_category").join(own, ["low_category", "low_product_id"], "left")
    less = lambda c: F.when(c, 1).otherwise(0)
    low = low.withColumns(
        {"pairs": F.col("products") - less(F.col("own").isNotNull()), "exclusive": F.col("exclusive") - less(F.col("own_exclusive"))}
    ).drop("own_exclusive").filter("pairs > 0")
    lows = low.groupBy(F.col("low_category").alias("category")).agg(F.ceil(F.count(F.lit(1)) / LOW_BLOCK).cast("int").alias("low_blocks"))
    low = low.join(lows.withColumnRenamed("category", "low_category"), "low_category")
    low = running_totals(low, ["low_product_id", "low_store_id"], "pairs", "before")
    blocks = low.select(F.col("low_category").alias("category"), "low_blocks").distinct()  # of the numbered rows, which are not made again
    return low, best.join(blocks, "category")


def _product_block(c) -> Column:
    return F.floor(c / PRODUCT_BLOCK).cast("long")


def numbered_pairs(low: DataFrame, best: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """All pairs of the factors with their `place`, from 1. Both sides of a category are cut into blocks by counts,
    and each block of low rows meets each block of products under its own key, however large the category.

    `marks` holds a `mark` for some places, each once. They wait at the low row and product block of their pair, at most one
    for each product of the block, so the pairs themselves are not joined with them."""
    block = _product_block
    left = low.select(
        "*",
        F.pmod(F.xxhash64("low_product_id", "low_store_id"), F.col("low_blocks")).cast("int").alias("_low"),
        F.explode(F.sequence(block(F.col("first")), block(F.col("first") + F.col("products") - 1))).alias("_product"),
    ).drop("low_blocks")
    if marks is not None:
        waiting = pairs_at(low, best, marks).groupBy("before", block(F.col("number")).alias("_product"))
        waiting = waiting.agg(F.map_from_entries(F.collect_list(F.struct("number", "mark"))).alias("_marks"))
        left = left.join(waiting, ["before", "_product"], "left")
    right = best.select("*", F.explode(F.sequence(F.lit(0), F.col("low_blocks") - 1)).alias("_low"), block(F.col("number")).alias("_product")).drop("low_blocks")
    same = (F.col("low_category") == F.col("category")) & (left["_low"] == right["_low"]) & (left["_product"] == right["_product"])
    pairs = left.join(right, same & (F.col("low_product_id") != F.col("product_id"))).drop("_low", "_product")
    if marks is not None:
        pairs = pairs.withColumn("mark", F.col("_marks")[F.col("number")]).drop("_marks")
    later = F.when(F.col("own") < F.col("number"), 1).otherwise(0)
    return pairs.withColumn("place", F.col("before") + F.col("number") - F.col("first") + 1 - later)


def pairs_of_stores(low: DataFrame, best: DataFrame) -> DataFrame:
    """Rows (store_id, weight) whose weights add up, store by store, to the pairs that have it on either side: those of its low
    rows, those of its products, less those with both. Low rows of a category meet all its products but their own."""
    low = low.filter(F.col("low_product_id").isNotNull()).withColumnRenamed("low_category", "category")
    n = F.count(F.lit(1))
    lows, products = low.groupBy("category").agg(n.alias("lows")), best.select("category", "number", "store_id")
    own = low.filter(F.col("own").isNotNull()).groupBy(F.col("own").alias("number")).agg(n.alias("same"))
    of_low = low.groupBy(F.col("low_store_id").alias("store_id")).agg(F.sum("pairs").alias("weight"))
    of_product = products.join(lows, "category").join(own, "number", "left").groupBy("store_id").agg(
        F.sum(F.col("lows") - F.coalesce("same", F.lit(0))).alias("weight")
    )
    low_cells = low.groupBy("category", F.col("low_store_id").alias("store_id")).agg(n.alias("lows"))
    cells = low_cells.join(products.groupBy("category", "store_id").agg(n.alias("products")), ["category", "store_id"])
    both = cells.select("store_id", (-F.col("lows") * F.col("products")).alias("weight"))
    itself = low.join(products.select(F.col("number").alias("own"), "store_id"), "own").filter(F.col("low_store_id") == F.col("store_id"))
    parts = [of_low, of_product, both, itself.select("store_id", F.lit(1).alias("weight"))]
    rows = [df.select("store_id", F.col("weight").cast("long").alias("weight")) for df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def pairs_at(low: DataFrame, best: DataFrame, places: DataFrame) -> DataFrame:
    """The pairs at the given places (columns `place` and others), as `numbered_pairs` has them, without making the rest.

    The places of a low row are a range. Ranges meet places in buckets of a width between one and two times the
    pairs of the row, so a range lies in two buckets at most and a bucket holds three ranges of its width at most.
    The place in the range is the number of the product.
    """
    width = F.pow(F.lit(2.0), F.length(F.bin("pairs"))).cast("long")
    bucket = lambda place: F.floor(place / F.col("width")).cast("long")
    ranges = low.filter(F.col("low_product_id").isNotNull()).withColumn("width", width)
    widths = ranges.agg(F.collect_set("width").alias("w")).scalar()
    ranges = ranges.withColumn("bucket", F.explode(F.sequence(bucket(F.col("before") + 1), bucket(F.col("before") + F.col("pairs")))))
    asked = places.withColumn("_widths", widths).withColumn("width", F.explode("_widths")).drop("_widths")
    inside = (F.col("place") > F.col("before")) & (F.col("place") <= F.col("before") + F.col("pairs"))
    found = asked.withColumn("bucket", bucket(F.col("place"))).join(ranges, ["width", "bucket"]).filter(inside).drop("width", "bucket", "low_blocks")
    number = F.col("first") + F.col("place") - F.col("before") - 1
    found = found.withColumn("number", number + F.when(F.col("own") <= number, 1).otherwise(0))
    return found.join(best.drop("low_blocks"), "number")


def leading_low_rows(low: DataFrame, limit: int, starts: list[int], shift: Column) -> DataFrame:
    """Low rows whose pairs hold, of the places from each start on, the first `limit` with an exclusive product and
    the first `limit` with another one; places count after `shift`.

    One row may begin before the start and have its pairs of a kind there; each of the next has one at least.
    """
    kinds = F.explode(F.array(
        *[F.when(n > 0, F.struct(F.lit(k).alias("kind"), F.lit(s).cast("long").alias("start")))
          for s in starts for k, n in enumerate((F.col("exclusive"), F.col("pairs") - F.col("exclusive")))]
    ))
    rows = low.withColumn("_last", F.col("before") + F.col("pairs") + shift).withColumn("_k", kinds)
    first = Window.partitionBy("_k").orderBy("before")
    kept = rows.filter("_k.start <= _last").withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= limit + 1)
    return kept.drop("_last", "_k", "_place").dropDuplicates(["before"])


def top_alternative_products(
    low_stock: DataFrame, candidates: DataFrame, top_n: int, one_per_product: bool = False
) -> DataFrame:
    """A report of the `top_n` best same-category alternatives of every low row: exclusive first, then by stock.

    The order of candidates depends on the low row only through "another product". A product fills at most
    `top_n` places (one when only its best row counts), so the first `2 * top_n` (or `top_n + 1`)
    candidates of a category are enough for every low row.
    """
    per_product = 1 if one_per_product else top_n
    ranked = ranked_in_category(candidates, _alternative_order(), per_product, top_n + per_product)
    low = _low_rows(low_stock)
    fields = ["product_id", "product_name", "store_id", "store_name", "available_quantity", "is_exclusive"]
    o = lambda f: F.col(f"option.{f}")
    reason = F.when(
        o("is_exclusive"),
        F.concat(
            o("product_name"), F.lit(" is exclusively available at "), o("store_name"), F.lit(" with "),
            o("available_quantity"), F.lit(" units."),
        ),
    ).otherwise(
        F.concat(
            o("product_name"), F.lit(" is available in the same "), "low_category", F.lit(" category at "),
            o("store_name"), F.lit("."),
        )
    )
    return with_category_options(low, ranked, fields, top_n).select(
        F.col("low_product_id").alias("low_stock_product_id"),
        "low_stock_product",
        F.col("low_store_id").alias("low_stock_store_id"),
        "low_stock_store",
        o("product_id").alias("alternative_product_id"),
        o("product_name").alias("alternative_product"),
        o("store_id").alias("alternative_store_id"),
        o("store_name").alias("alternative_store"),
        o("available_quantity").alias("available_quantity"),
        F.col("low_category").alias("category"),
        o("is_exclusive").alias("is_exclusive"),
        reason.alias("reason"),
        F.when(o("is_exclusive"), "high").otherwise("medium").alias("priority"),
    )


def surplus_stock(inventory: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Rows with at least twice their threshold; three times is a High opportunity."""
    inv = prepared_inventory(inventory, stores, products, product_fallback=True)
    q, t = F.col("stock_level"), F.col("reorder_threshold")
    level = F.when(q >= t * 3, "High").otherwise("Medium")
    return (
        inv.filter((t > 0) & (q >= t * SURPLUS_MULTIPLIER))
        .select(
            "product_id",
            "product_name",
            "category",
            "store_id",
            "store_name",
            "city",
            q.alias("current_quantity"),
            t.alias("reorder_threshold"),
            (q - t).alias("surplus_quantity"),
            level.alias("opportunity_level"),
            level.alias("priority"),
            F.concat(
                "product_name", F.lit(" has "), q, F.lit(" units at "), "store_name", F.lit(", above the "), t,
                F.lit(" unit threshold."),
            ).alias("reason"),
        )
        .orderBy("opportunity_level", F.desc("surplus_quantity"), "product_name", "store_id")
    )


def alternative_availability(
    inventory: DataFrame, products: DataFrame, stores: DataFrame, low_stock: DataFrame
) -> DataFrame:
    """Same-product surplus in other stores plus the three best stocked products of the category."""
    low = _low_rows(low_stock)
    surplus = surplus_stock(inventory, products, stores).select(
        "product_id",
        F.col("store_id").alias("source_id"),
        F.col("product_name").alias("alternative_product"),
        F.col("store_name").alias("alternative_store"),
        F.col("current_quantity").alias("available_quantity"),
    )
    same = low.join(
        surplus, (F.col("low_product_id") == F.col("product_id")) & (F.col("low_store_id") != F.col("source_id"))
    ).withColumn("alternative_type", F.lit("same_product_transfer"))

    inv = prepared_inventory(inventory, stores, products, product_fallback=True)
    q, t = F.col("stock_level"), F.col("reorder_threshold")
    healthy = inv.filter((q > 0) & ((t <= 0) | (q >= t * SURPLUS_MULTIPLIER)) & (F.col("category") != ""))
    order = [F.desc("stock_level"), F.asc("product_name"), F.asc("store_id")]
    ranked = ranked_in_category(healthy, order, 3, 6)
    fields = ["product_id", "product_name", "store_name", "stock_level"]
    category = with_category_options(low, ranked, fields, 3).withColumns(
        {
            "alternative_product": F.col("option.product_name"),
            "alternative_store": F.col("option.store_name"),
            "available_quantity": F.col("option.stock_level"),
            "alternative_type": F.lit("category_alternative"),
        }
    )
    keys = ["low_stock_product", "low_stock_store", "alternative_product", "alternative_store", "alternative_type"]
    columns = [*keys, "low_category", "available_quantity"]
    best = F.max(F.struct("available_quantity", "low_category")).alias("best")
    rows = same.select(*columns).unionByName(category.select(*columns)).groupBy(*keys).agg(best)
    is_transfer = F.col("alternative_type") == "same_product_transfer"
    qty, product = F.col("best.available_quantity"), F.col("low_stock_product")
    alt, at = F.col("alternative_product"), F.col("alternative_store")
    return rows.select(
        "low_stock_product",
        "low_stock_store",
        "alternative_product",
        "alternative_store",
        qty.alias("available_quantity"),
        "alternative_type",
        F.when(
            is_transfer,
            F.concat(F.lit("Consider transferring "), product, F.lit(" from "), at, F.lit(" to "), "low_stock_store", F.lit(".")),
        )
        .otherwise(F.concat(F.lit("Offer "), alt, F.lit(" from "), at, F.lit(" as an alternative to "), product, F.lit(".")))
        .alias("suggested_action"),
        F.when(is_transfer, F.concat(at, F.lit(" has surplus "), product, F.lit(" with "), qty, F.lit(" units available.")))
        .otherwise(F.concat(alt, F.lit(" has strong stock in the same "), "best.low_category", F.lit(" category.")))
        .alias("reason"),
    )


def surplus_alert_text(surplus: DataFrame, alternatives: DataFrame) -> DataFrame:
    """One sentence on surplus and availability: counts and the first row of each list."""
    s = surplus.agg(
        F.count(F.lit(1)).alias("surplus_n"),
        F.countDistinct("store_id").alias("store_n"),
        F.min_by(
            "product_name", F.struct("opportunity_level", -F.col("surplus_quantity"), "product_name", "store_id")
        ).alias("surplus_name"),
    )
    kind_rank = F.when(F.col("alternative_type") == "same_product_transfer", 0).otherwise(1)
    a = alternatives.agg(
        F.count(F.lit(1)).alias("alt_n"),
        F.min_by(
            F.struct("low_stock_product", "low_stock_store", "available_quantity", "alternative_product", "alternative_store"),
            F.struct(
                kind_rank, -F.col("available_quantity"), "alternative_product", "low_stock_product", "low_stock_store",
                "alternative_store",
            ),
        ).alias("top"),
    )
    head = F.when(
        F.col("surplus_n") > 0,
        F.concat("surplus_n", F.lit(" items have surplus stock across "), "store_n", F.lit(" stores.")),
    )
    tail = F.when(
        F.col("alt_n") > 0,
        F.concat(
            "top.low_stock_product", F.lit(" is low in "), "top.low_stock_store", F.lit(", but "),
            "top.available_quantity", F.lit(" units of "), "top.alternative_product", F.lit(" are available at "),
            "top.alternative_store", F.lit("."),
        ),
    ).when(
        F.col("surplus_n") > 0,
        F.concat("surplus_name", F.lit(" has surplus stock and can be considered for transfer or promotion.")),
    )
    joined = F.concat_ws(" ", head, tail)
    none = F.lit("No major surplus or alternative availability detected right now.")
    return s.join(a).select(F.when(joined == "", none).otherwise(joined).alias("alert_text"))  # one row each


def store_imbalance(inventory: DataFrame, low_stock: DataFrame, overstock: DataFrame) -> DataFrame:
    """Stores by the gap between their overstocked and low rows."""
    totals = inventory.groupBy("store_id", "store_name").agg(F.sum(whole("stock_level")).alias("total_stock_level"))
    low = low_stock.groupBy("store_id").agg(F.count(F.lit(1)).alias("low_stock_count"))
    over = overstock.groupBy("store_id").agg(F.count(F.lit(1)).alias("overstock_count"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        totals.join(low, "store_id", "left")
        .join(over, "store_id", "left")
        .select(
            "store_id",
            "store_name",
            "total_stock_level",
            n("low_stock_count").alias("low_stock_count"),
            n("overstock_count").alias("overstock_count"),
            F.abs(n("overstock_count") - n("low_stock_count")).alias("imbalance_score"),
        )
        .orderBy(F.desc("imbalance_score"), F.desc("total_stock_level"), "store_id")
    )


def imbalance_summary(imbalance: DataFrame) -> DataFrame:
    return imbalance.agg(
        F.count(F.lit(1)).alias("store_count"),
        F.count_if(F.col("imbalance_score") > 0).alias("imbalanced_store_count"),
        F.count_if(F.col("low_stock_count") > 0).alias("stores_with_low_stock"),
        F.count_if(F.col("overstock_count") > 0).alias("stores_with_overstock"),
    )
