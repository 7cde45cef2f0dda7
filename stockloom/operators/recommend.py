"""Recommendation generators, their grouping by agent and run summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.config import RecommendationConfig
from stockloom.functions.exprs import (
    cover_priority,
    priority_rank,
    prefixed,
    round2,
    round_even,
    text,
    threshold_or_product,
    whole,
)
from stockloom.functions.ids import sequential_numbers, text_rank
from stockloom.operators import transfers as tr
from stockloom.operators.datasets import KEYS
from stockloom.schemas import RECOMMENDATIONS
from stockloom.session import published
from stockloom.sources.tables import align_to_schema

DEFAULTS = RecommendationConfig()

# Order in which the generators are concatenated, and the agents' order.
TYPE_ORDER = [
    "reorder",
    "transfer",
    "exclusive_availability",
    "alternative_option",
    "discount",
    "clearance",
    "supplier_risk_alert",
    "overstock_alert",
    "stockout_prevention_alert",
]
AGENT_TYPES = {
    "pricing_agent": ["discount", "clearance"],
    "transfer_agent": ["transfer", "exclusive_availability", "alternative_option"],
    "risk_agent": ["supplier_risk_alert", "overstock_alert", "stockout_prevention_alert"],
    "procurement_agent": ["reorder"],
}
RISK_TYPES = AGENT_TYPES["risk_agent"]
OPPORTUNITY_TYPES = [
    "reorder", "discount", "stock_transfer", "transfer", "clearance", "exclusive_availability", "alternative_option",
]
_BODY = [f for f in RECOMMENDATIONS.names if f != "recommendation_id"]
_FIELDS = {f.name: f.dataType for f in RECOMMENDATIONS.fields}


def _concat(*parts) -> Column:
    """Literal texts and {column} names in one text; null reads as blank."""
    out = []
    for p in parts:
        c = p if isinstance(p, Column) else (F.col(p[1:-1]) if p.startswith("{") else F.lit(p))
        out.append(F.coalesce(c.cast("string"), F.lit("")))
    return F.concat(*out)


def _records(df: DataFrame, kind: str, keep: tuple = (), **values) -> DataFrame:
    """Rows in the record layout: given columns or literals, blanks and nulls elsewhere. Columns of `keep` stay."""
    values = {
        "recommendation_type": F.lit(kind),
        "source_agent": F.lit("recommendation_engine"),
        "status": F.lit("pending"),
        **values,
    }
    for name in ("product_id", "product_name", "store_id"):
        values.setdefault(name, F.coalesce(F.col(name), F.lit("")))
    out = []
    for name in _BODY:
        dtype = _FIELDS[name]
        default = F.lit("") if dtype.typeName() == "string" else F.lit(None)
        value = values.get(name, default)
        out.append((value if isinstance(value, Column) else F.lit(value)).cast(dtype).alias(name))
    return df.select(*out, *keep)


def _decimals(c) -> Column:
    """A number as text with its fraction, at most two digits."""
    return round2(c).cast("string")


def reorder(low_stock: DataFrame, c: RecommendationConfig = DEFAULTS) -> DataFrame:
    target = F.col("effective_reorder_threshold") + F.col("recent_daily_sales_velocity") * c.reorder_cover_days
    rows = low_stock.withColumn("quantity", round_even(target - F.col("stock_level"))).filter("quantity > 0")
    return _records(
        rows,
        "reorder",
        priority=cover_priority("days_of_stock_remaining", c),
        action=_concat("Reorder ", "{quantity}", " units."),
        reason="Stock is below the reorder point after recent demand is considered.",
        evidence=F.col("evidence"),
        suggested_quantity=F.col("quantity"),
    )


def transfer(inventory: DataFrame, low_stock: DataFrame, c: RecommendationConfig = DEFAULTS) -> DataFrame:
    """Low rows with the store of the largest surplus above 1.5 thresholds; sources are not decremented."""
    thr = threshold_or_product("inventory_reorder_threshold", "reorder_threshold", only_zero=True)
    sources = (
        inventory.withColumn("surplus", F.col("stock_level") - thr * F.lit(float(c.transfer_source_buffer_multiplier)))
        .filter("surplus > 0")
        .select("product_id", "store_id", "store_name", "surplus")
    )
    best = tr.best_source(sources, -F.col("surplus"), F.col("store_id"))
    needed = F.col("effective_reorder_threshold") - F.col("stock_level")
    rows = (
        low_stock.filter(needed > 0)
        .join(best, "product_id")
        .withColumn("quantity", F.least(needed, round_even("source_surplus")))
        .filter("quantity > 0")
    )
    return _records(
        rows,
        "transfer",
        store_name=F.col("store_name"),
        priority="medium",
        action=_concat("Transfer ", "{quantity}", " units from ", "{source_store_id}", " to ", "{store_id}", "."),
        reason="One store is below reorder point while another store has surplus stock.",
        evidence=_concat(
            "source_store=", text("source_store_name", F.col("source_store_id")),
            ", source_store_id=", "{source_store_id}",
            ", destination_store=", text("store_name", F.col("store_id")),
            ", destination_store_id=", "{store_id}",
            ", source_surplus=", _decimals("source_surplus"),
            ", destination_stock=", _decimals("stock_level"),
            ", destination_threshold=", _decimals("effective_reorder_threshold"),
        ),
        suggested_quantity=F.col("quantity"),
    )


def exclusive(exclusive_items: DataFrame) -> DataFrame:
    return _records(
        exclusive_items,
        "exclusive_availability",
        store_id=F.col("exclusive_store_id"),
        store_name=F.col("exclusive_store_name"),
        available_quantity=F.col("available_quantity"),
        priority="medium",
        action=_concat(
            "Promote ", "{product_name}", " as exclusively available at ", "{exclusive_store_name}", " with ",
            "{available_quantity}", " units.",
        ),
        reason=F.col("business_note"),
        evidence=_concat(
            "category=", "{category}", ", exclusive_store=", "{exclusive_store_name}",
            ", exclusive_store_id=", "{exclusive_store_id}", ", available_quantity=", "{available_quantity}",
            ", unavailable_stores=", "{unavailable_store_names}", ", unavailable_elsewhere=true",
        ),
    )


def all_alternatives(low_stock: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best row of every alternative product of a low row. The records grow with the square of a category."""
    return _alternative_records(_named_pairs(tr.alternative_pairs(low_stock, tr.best_of_product(candidates))))


def _named_pairs(rows: DataFrame) -> DataFrame:
    names = {"low_product_id": "low_stock_product_id", "low_store_id": "low_stock_store_id", "product_id": "alternative_product_id",
             "product_name": "alternative_product", "store_id": "alternative_store_id", "store_name": "alternative_store"}
    return rows.withColumnsRenamed(names).withColumn("priority", F.when(F.col("is_exclusive"), "high").otherwise("medium"))


def alternative_records(pairs: DataFrame, agent: str | None, *keep: str) -> DataFrame:
    """Records of pairs of the factors."""
    records = _alternative_records(_named_pairs(pairs), *keep)
    return tagged(records, agent) if agent else records


def _alternative_records(rows: DataFrame, *keep: str) -> DataFrame:
    return _records(
        rows,
        "alternative_option",
        keep,
        product_id=F.col("low_stock_product_id"),
        product_name=F.col("low_stock_product"),
        store_id=F.col("low_stock_store_id"),
        store_name=F.col("low_stock_store"),
        alternative_product_id=F.col("alternative_product_id"),
        alternative_product_name=F.col("alternative_product"),
        alternative_store_id=F.col("alternative_store_id"),
        alternative_store_name=F.col("alternative_store"),
        available_quantity=F.col("available_quantity"),
        priority=F.col("priority"),
        action=_concat(
            "Offer ", "{alternative_product}", " from ", "{alternative_store}", " as an alternative to ",
            "{low_stock_product}", " for ", "{low_stock_store}", ".",
        ),
        reason=_concat(
            "{alternative_product}", " is", F.when(F.col("is_exclusive"), " exclusively").otherwise(""),
            " available at ", "{alternative_store}", " with ", "{available_quantity}", " units in the same ",
            "{category}", " category.",
        ),
        evidence=_concat(
            "low_stock_product=", "{low_stock_product}", ", low_stock_store=", "{low_stock_store}",
            ", alternative_product=", "{alternative_product}", ", alternative_store=", "{alternative_store}",
            ", category=", "{category}", ", available_quantity=", "{available_quantity}",
            ", is_exclusive=", F.when(F.col("is_exclusive"), "True").otherwise("False"),
        ),
    )


def discount(slow_moving: DataFrame, overstock: DataFrame, c: RecommendationConfig = DEFAULTS) -> DataFrame:
    """Slow or overstocked pairs with long cover; a pair in both sets keeps its slow-moving row.

    A slow-moving row without long cover still bars the overstocked row of its pair, but needs no texts for that.
    """
    long_cover = F.col("days_of_stock_remaining") >= c.discount_days_of_stock
    texts = [F.when(long_cover, F.col(t)).alias(t) for t in ("product_name", "evidence")]
    cols = [*KEYS, "days_of_stock_remaining", *texts]
    rows = slow_moving.select(*cols, F.lit(0).alias("from")).unionByName(overstock.filter(long_cover).select(*cols, F.lit(1).alias("from")))
    first = F.min_by(F.struct("days_of_stock_remaining", "product_name", "evidence"), "from").alias("r")
    kept = rows.groupBy(*KEYS).agg(first).select(*KEYS, "r.*")
    return _records(
        kept.filter(long_cover),
        "discount",
        priority="medium",
        action="Consider a discount to improve sell-through.",
        reason="Inventory coverage is high compared with recent sales velocity.",
        evidence=F.col("evidence"),
    )


def clearance(dead_stock: DataFrame, c: RecommendationConfig = DEFAULTS) -> DataFrame:
    shelf = F.col("shelf_life_days")
    pressure = (shelf > 0) & (F.col("days_of_stock_remaining") >= shelf * c.clearance_shelf_life_multiplier)
    return _records(
        dead_stock.filter(pressure | (F.col("recent_30_day_quantity_sold") == 0)),
        "clearance",
        priority=F.when(pressure, "high").otherwise("medium"),
        action="Plan clearance for the affected stock.",
        reason="Stock has weak recent movement or may exceed shelf life.",
        evidence=F.col("evidence"),
    )


def supplier_risk(performance: DataFrame, suppliers: DataFrame, c: RecommendationConfig = DEFAULTS) -> DataFrame:
    """Products whose supplier is unreliable or slow; a missing supplier counts as unreliable."""
    own = performance.select("product_id", "product_name", "supplier_id")
    sup = suppliers.select("supplier_id", "supplier_name", "reliability_score", "avg_delivery_days")
    joined = own.join(sup, "supplier_id", "left").withColumns(
        {
            "reliability_score": F.coalesce("reliability_score", F.lit(0.0)),
            "avg_delivery_days": whole("avg_delivery_days"),
        }
    )
    unreliable = F.col("reliability_score") < c.supplier_reliability_threshold
    return _records(
        joined.filter(unreliable | (F.col("avg_delivery_days") >= c.supplier_delivery_days_threshold)),
        "supplier_risk_alert",
        store_id="",
        priority=F.when(unreliable, "high").otherwise("medium"),
        action="Review supplier performance before placing the next replenishment order.",
        reason="Supplier reliability or delivery time crosses the configured risk threshold.",
        evidence=_concat(
            "supplier_id=", "{supplier_id}", ", supplier_name=", "{supplier_name}",
            ", reliability_score=", _decimals("reliability_score"),
            ", avg_delivery_days=", _decimals("avg_delivery_days"),
        ),
    )


def overstock_alert(overstock: DataFrame) -> DataFrame:
    return _records(
        overstock,
        "overstock_alert",
        priority="medium",
        action="Review replenishment and sell-through plan for this stock.",
        reason=F.col("reason"),
        evidence=F.col("evidence"),
    )


def stockout_alert(stockout: DataFrame, c: RecommendationConfig = DEFAULTS) -> DataFrame:
    return _records(
        stockout,
        "stockout_prevention_alert",
        priority=cover_priority("days_of_stock_remaining", c),
        action="Take replenishment action before projected stockout.",
        reason=F.col("reason"),
        evidence=F.col("evidence"),
    )


def type_rank(column="recommendation_type", order: list[str] = TYPE_ORDER) -> Column:
    rank = F.lit(len(order))
    for i, kind in enumerate(order):
        rank = F.when(F.col(column) == kind, i).otherwise(rank)
    return rank


def record_order(order: list[str] = TYPE_ORDER) -> list:
    """Total order of records: generator, product, store, alternative product."""
    return [type_rank(order=order), "product_id", "store_id", "alternative_product_id"]


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def alternative_total(low: DataFrame) -> Column:
    """Number of alternative records of the factors, as a scalar subquery."""
    return low.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("n")).scalar()


def with_places(records: DataFrame, order: list[str] = TYPE_ORDER) -> DataFrame:
    """Records without alternatives, numbered from 1 in record order; what follows the alternatives is `after` them.
    They are written once, with their numbers in the partitions, and every later reader scans them."""
    after = type_rank(order=order) > order.index("alternative_option")
    return sequential_numbers(records, record_order(order), "place", keep=published).withColumn("after", after)


def with_ids(records: DataFrame, low: DataFrame, best: DataFrame, agent: str | None = None) -> DataFrame:
    """All records of a run with dense REC ids in record order: numbered records and those of the alternatives.

    The alternatives grow with the square of a category, so they are neither sorted nor stored. They come from
    their factors, whose pairs know their place among themselves; the other records are moved apart by their total.
    """
    return _placed(_moved(records, low), records, tr.numbered_pairs(low, best), agent)


def _moved(records: DataFrame, low: DataFrame) -> DataFrame:
    """Numbered records with their places among all records."""
    return records.withColumn("place", F.col("place") + F.when(F.col("after"), alternative_total(low)).otherwise(0))


def without_alternatives(records: DataFrame, low: DataFrame) -> DataFrame:
    """The records of `with_ids` that are no alternatives."""
    return _moved(records, low).select(prefixed("REC", "place", 5).alias("recommendation_id"), *_BODY)


def before_alternatives(records: DataFrame) -> Column:
    return records.agg(F.count_if(~F.col("after")).alias("n")).scalar()


def _placed(others: DataFrame, records: DataFrame, pairs: DataFrame, agent: str | None, *keep: str) -> DataFrame:
    """Records of numbered rows and of pairs of the factors under their ids."""
    pairs = pairs.withColumn("place", F.col("place") + before_alternatives(records))
    alternatives = alternative_records(pairs, agent, "place", *keep)
    both = others.select("place", *_BODY, *keep).unionByName(alternatives.select("place", *_BODY, *keep))
    return both.select(prefixed("REC", "place", 5).alias("recommendation_id"), *_BODY, *keep)


def named_places(rows: DataFrame, *keep: str) -> DataFrame:
    """The places that ids name, and columns to keep."""
    place = F.regexp_extract("recommendation_id", "^REC([0-9]+)$", 1).try_cast("long")
    named = rows.select("recommendation_id", place.alias("place"), *keep).filter(prefixed("REC", "place", 5) == F.col("recommendation_id"))
    return named.select("place", *keep)


def _inside_alternatives(places: DataFrame, records: DataFrame) -> DataFrame:
    return places.withColumn("place", F.col("place") - before_alternatives(records)).filter("place > 0")


def named_records(ids: DataFrame, records: DataFrame, low: DataFrame, best: DataFrame, agent: str | None = None) -> DataFrame:
    """The records of `with_ids` that `ids` names, each once. An id is a place, and a place leads to its pair of
    factors, so no other alternatives are made."""
    asked = named_places(ids).distinct()
    others = _moved(records, low).join(asked, "place", "left_semi")
    return _placed(others, records, tr.pairs_at(low, best, _inside_alternatives(asked, records)), agent)


def joined_records(rows: DataFrame, records: DataFrame, low: DataFrame, best: DataFrame, agent: str | None = None) -> DataFrame:
    """All records of `with_ids`, left-joined with rows of one row per id. The rows of alternatives go to the places of
    their pairs among the factors, so the alternatives are not shuffled."""
    fields = [c for c in rows.columns if c != "recommendation_id"]
    marks = named_places(rows.withColumn("mark", F.struct(*fields)), "mark")
    others = _moved(records, low).join(marks, "place", "left")
    pairs = tr.numbered_pairs(low, best, _inside_alternatives(marks, records))
    return _placed(others, records, pairs, agent, "mark").select("*", *[F.col(f"mark.{c}").alias(c) for c in fields]).drop("mark")


#: Where ids become longer: they are texts, and REC100000 comes before REC99999.
_LONGER_IDS = [1, *(10**k for k in range(5, 19))]


def record_digest(records: DataFrame, low: DataFrame, best: DataFrame, agent: str | None = None, limit: int = 10) -> DataFrame:
    """All records in a form for counts, first texts and best rows, which grows with the factors and not with their pairs.

    `weight` tells how many records a row counts for. The numbered records count for one. The alternatives of a low
    row with one priority are one row without id, texts and alternative. Those with the `limit` first ids of each
    priority are there with their texts, and count for none, as they are counted already.
    """
    others = _moved(records, low).withColumn("weight", F.lit(1).cast("long"))
    few = tr.leading_low_rows(low, limit, _LONGER_IDS, before_alternatives(records)).withColumn("low_blocks", F.lit(1))
    pairs = tr.numbered_pairs(few, best.withColumn("low_blocks", F.lit(1))).withColumn("weight", F.lit(0).cast("long"))
    texts = _placed(others, records, pairs, agent, "weight")
    by_priority = F.explode(F.array(
        F.struct(F.lit("high").alias("priority"), F.col("exclusive").alias("weight")),
        F.struct(F.lit("medium").alias("priority"), (F.col("pairs") - F.col("exclusive")).alias("weight")),
    ))
    counted = low.filter(F.col("low_product_id").isNotNull()).withColumn("_p", by_priority).filter("_p.weight > 0")
    sums = _records(
        counted.select("*", F.col("_p.priority").alias("priority"), F.col("_p.weight").cast("long").alias("weight")), "alternative_option", ("weight",),
        product_id=F.col("low_product_id"), product_name=F.col("low_stock_product"), store_id=F.col("low_store_id"),
        store_name=F.col("low_stock_store"), priority=F.col("priority"),
    )
    if agent:
        sums = tagged(sums, agent)
    return texts.unionByName(sums.withColumn("recommendation_id", F.lit(None).cast("string")).select(*texts.columns))


def store_digest(records: DataFrame, low: DataFrame, best: DataFrame) -> DataFrame:
    """All records in a form for counts by store or alternative store, which grows with the factors and not with their pairs.
    The alternatives are rows of one store, whose weights add up to the number of those that name it."""
    others = records.select("store_id", "alternative_store_id", F.lit(1).cast("long").alias("weight"))
    return others.unionByName(tr.pairs_of_stores(low, best).withColumn("alternative_store_id", F.col("store_id")))


def id_rank(records: DataFrame, low: DataFrame) -> Column:
    """The place of a record's id among all ids as texts. Low rows without product have places but no records; they are
    the first of the low rows."""
    pairs, unused = F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("low_product_id").isNull(), F.col("pairs"))), F.lit(0))
    others, first = records.agg(F.count(F.lit(1)), F.count_if(~F.col("after"))).first()
    pairs, unused = low.agg(pairs.cast("long"), unused.cast("long")).first()
    until = lambda total: text_rank(F.substring("recommendation_id", 4, 18).cast("long"), total, 5)
    every = until(others + pairs)
    return every - (until(first + unused) - until(first)) if unused else every


def record_weight(recs: DataFrame) -> Column:
    """How many records a row counts for: one, except in a digest."""
    return F.col("weight") if "weight" in recs.columns else F.lit(1).cast("long")


def with_texts(recs: DataFrame) -> DataFrame:
    """Rows that are records of their own, which those of a digest without id are not."""
    return recs.filter(F.col("recommendation_id").isNotNull()) if "weight" in recs.columns else recs


def of_store(store_id: str, records: DataFrame, low: DataFrame, best: DataFrame, agent: str | None = None) -> DataFrame:
    """The records of `with_ids` whose store or alternative store is the given one. Low rows of the store meet all
    products, the others only the products whose best row is there."""
    here = lambda c: F.col(c).eqNullSafe(F.lit(store_id))
    others = _moved(records, low).filter(here("store_id") | here("alternative_store_id"))
    own = tr.numbered_pairs(low.filter(here("low_store_id")), best)
    pairs = own.unionByName(tr.numbered_pairs(low.filter(~here("low_store_id")), best.filter(here("store_id"))))
    return _placed(others, records, pairs, agent)


# --- agents -----------------------------------------------------------------------------------


def tagged(records: DataFrame, agent: str) -> DataFrame:
    return records.withColumn("source_agent", F.lit(agent))


def supplier_context(performance: DataFrame, suppliers: DataFrame, c: RecommendationConfig = DEFAULTS) -> DataFrame:
    """Products with supplier signals; here a missing supplier is not risky."""
    sup = suppliers.dropDuplicates(["supplier_id"]).select(
        "supplier_id",
        "supplier_name",
        F.coalesce("reliability_score", F.lit(0.0)).alias("reliability_score"),
        whole("avg_delivery_days").alias("avg_delivery_days"),
    )
    risky = (F.col("reliability_score") < c.supplier_reliability_threshold) | (
        F.col("avg_delivery_days") >= c.supplier_delivery_days_threshold
    )
    own = performance.select("product_id", "supplier_id").dropDuplicates(["product_id"])
    return own.join(sup, "supplier_id", "left").withColumn("supplier_is_risky", F.coalesce(risky, F.lit(False)))


def procurement(
    low_stock: DataFrame,
    context: DataFrame,
    hints: DataFrame | None = None,
    c: RecommendationConfig = DEFAULTS,
) -> DataFrame:
    """Reorders with supplier evidence and, per product and store, memory and learning hints."""
    ctx = context.select(
        "product_id", "supplier_name", "reliability_score", "avg_delivery_days", "supplier_is_risky",
        F.lit(True).alias("known"),
    )
    rows = reorder(low_stock, c).join(ctx, "product_id", "left")
    if hints is not None:
        rows = rows.join(hints.select(*KEYS, "memory_hint", "learning_hint"), KEYS, "left")
    else:
        rows = rows.withColumns({"memory_hint": F.lit(""), "learning_hint": F.lit("")})
    extra = _concat(
        "supplier_name=", text("supplier_name", "unknown"), ", reliability_score=", _decimals("reliability_score"),
        ", avg_delivery_days=", _decimals("avg_delivery_days"),
    )
    part = lambda label, col: F.when(F.coalesce(F.col(col), F.lit("")) != "", F.concat(F.lit(label), F.col(col)))
    evidence = F.concat_ws(
        ", ", F.nullif(F.trim("evidence"), F.lit("")), extra, part("memory=", "memory_hint"), part("learning=", "learning_hint")
    )
    risky = F.coalesce("supplier_is_risky", F.lit(False))
    out = rows.withColumns(
        {
            "evidence": F.when(F.col("known"), evidence).otherwise(F.col("evidence")),
            "priority": F.when(risky, "high").otherwise(F.col("priority")),
            "reason": F.when(
                risky, "Stock is below the reorder point and supplier risk may delay replenishment."
            ).otherwise(F.col("reason")),
            "action": F.when(
                risky, F.concat("action", F.lit(" Review supplier timing before placing the order."))
            ).otherwise(F.col("action")),
        }
    )
    return tagged(out.select(*_BODY), "procurement_agent")


AGENT_ORDER = [t for types in AGENT_TYPES.values() for t in types]


def standardized(records: DataFrame) -> DataFrame:
    """Full layout, blank status as pending, numbered in the order pricing, transfer, risk, procurement."""
    status = F.when(text("status") == "", "pending").otherwise(F.col("status"))
    return with_places(align_to_schema(records, RECOMMENDATIONS).withColumn("status", status), AGENT_ORDER)


def decision_overlay(
    candidates: DataFrame, decisions: DataFrame, key: str = "recommendation_id", joined_with: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Apply reviewed decisions: drop what is not kept or on hold, override given fields.

    `joined_with` gives the candidates joined with rows of one row per key, where that is known without a join by key."""
    fields = ["priority", "action", "reason", "evidence"]
    d = decisions.select(
        key, "keep_recommendation", "selected_strategy", *[F.col(f).alias(f"new_{f}") for f in fields]
    )
    strategy = F.coalesce("selected_strategy", F.lit(""))
    joined = joined_with(d) if joined_with else candidates.join(d, key, "left")
    return (
        joined.filter(F.coalesce("keep_recommendation", F.lit(True)) & ~strategy.isin("hold", "monitor"))
        .withColumns(
            {
                "recommendation_type": F.coalesce(F.nullif(strategy, F.lit("")), "recommendation_type"),
                **{f: F.coalesce(f"new_{f}", f) for f in fields},
            }
        )
        .select(*candidates.columns)
    )


def candidate_context(recs: DataFrame, sources: list[tuple[str, DataFrame]], fields: dict[str, list[str]]) -> DataFrame:
    """Records with analyzer features. For each field the named sources are tried in order, and the first
    source that has the row decides, even if its value is null."""
    out = recs
    for name, df in sources:
        wanted = [f for f, order in fields.items() if name in order]
        keys = [k for k in KEYS if k in df.columns]
        packed = df.select(*keys, F.struct(*wanted).alias(f"_{name}"))
        out = out.join(packed, keys, "left")
    picked = {}
    for field, order in fields.items():
        value = F.lit(None)
        for name in reversed(order):
            value = F.when(F.col(f"_{name}").isNotNull(), F.col(f"_{name}.{field}")).otherwise(value)
        picked[field] = value
    return out.withColumns(picked).drop(*[f"_{name}" for name, _ in sources])


def pricing_context(recs: DataFrame, slow: DataFrame, over: DataFrame, dead: DataFrame) -> DataFrame:
    return candidate_context(
        recs,
        [("slow", slow), ("over", over), ("dead", dead)],
        {
            "days_of_stock_remaining": ["slow", "over", "dead"],
            "recent_daily_sales_velocity": ["slow", "over"],
            "recent_30_day_quantity_sold": ["dead", "slow"],
            "stock_level": ["slow", "over", "dead"],
            "shelf_life_days": ["dead"],
        },
    )


def transfer_context(recs: DataFrame, low: DataFrame) -> DataFrame:
    fields = ["stock_level", "effective_reorder_threshold", "recent_daily_sales_velocity", "days_of_stock_remaining"]
    return candidate_context(recs, [("low", low)], {f: ["low"] for f in fields})


def risk_context(recs: DataFrame, stockout: DataFrame, over: DataFrame, performance: DataFrame) -> DataFrame:
    stock = ["days_of_stock_remaining", "recent_daily_sales_velocity", "stock_level"]
    supplier = ["supplier_id", "supplier_name", "reliability_score", "avg_delivery_days"]
    return candidate_context(
        recs,
        [("stockout", stockout), ("over", over), ("product", performance)],
        {**{f: ["stockout", "over"] for f in stock}, **{f: ["product"] for f in supplier}},
    )


# --- run summaries ----------------------------------------------------------------------------


def priority_label(rank: Column) -> Column:
    return F.when(rank == 0, "high").when(rank == 1, "medium").when(rank == 2, "low").otherwise("info")


def first_text(column: str) -> Column:
    """First non-blank text in id order."""
    filled = F.trim(F.coalesce(column, F.lit(""))) != ""
    return F.min_by(F.when(filled, F.trim(column)), F.when(filled, F.col("recommendation_id")))


NO_RUN = "Run agents to generate latest analysis."


def agent_outputs(recs: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per agent: findings, highest priority and latest insight."""
    per_agent = recs.groupBy(F.col("source_agent").alias("agent_name")).agg(
        F.sum(record_weight(recs)).alias("finding_count"),
        F.min(priority_rank("priority")).alias("rank"),
        first_text("reason").alias("reason"),
        first_text("action").alias("action"),
    )
    agents = F.explode(F.array(*[F.lit(a) for a in AGENT_TYPES])).alias("agent_name")
    every = counts.agg(F.count(F.lit(1)).alias("n")).select(agents)
    rows = every.join(per_agent, "agent_name", "left").select(
        "agent_name",
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        priority_label(F.coalesce("rank", F.lit(9))).alias("priority_level"),
        F.coalesce("reason", "action", F.lit(NO_RUN)).alias("latest_insight"),
    )
    n = lambda name: F.coalesce(F.sum(F.when(F.col("dataset") == name, F.col("row_count"))), F.lit(0))
    inv = counts.agg(
        n("low_stock_items").alias("low"),
        n("stockout_risk_items").alias("out"),
        n("overstock_items").alias("over"),
        n("high_demand_items").alias("high"),
    )
    total = F.col("low") + F.col("out") + F.col("over") + F.col("high")
    parts = F.concat_ws(
        ". ",
        F.when(F.col("high") > 0, F.concat("high", F.lit(" high demand items"))),
        F.when(F.col("low") > 0, F.concat("low", F.lit(" low stock items"))),
        F.when(F.col("out") > 0, F.concat("out", F.lit(" stockout risks"))),
    )
    inventory = inv.select(
        F.lit("inventory_agent").alias("agent_name"),
        total.alias("finding_count"),
        F.when((F.col("out") > 0) | (F.col("low") > 0), "high").when(total > 0, "medium").otherwise("info").alias("priority_level"),
        F.when(parts == "", F.lit(NO_RUN)).otherwise(F.concat(parts, F.lit("."))).alias("latest_insight"),
    )
    return inventory.unionByName(rows)


def orchestrator_summary(recs: DataFrame, counts: DataFrame, health: DataFrame) -> DataFrame:
    """One row: totals, high alerts, database health and the summary sentence."""
    n = record_weight(recs)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    r = recs.agg(
        total(n).alias("total_recommendations"),
        total(F.when(F.lower("priority") == "high", n)).alias("high_priority_alerts"),
    )
    n = lambda name: F.coalesce(F.sum(F.when(F.col("dataset") == name, F.col("row_count"))), F.lit(0))
    inv = counts.agg(
        n("low_stock_items").alias("low"),
        n("stockout_risk_items").alias("out"),
        n("overstock_items").alias("over"),
        n("high_demand_items").alias("high"),
    )
    part = lambda c, label: F.when(F.col(c) > 0, F.concat(F.col(c), F.lit(label)))
    parts = F.concat_ws(
        ". ",
        part("low", " low stock items"),
        part("out", " stockout risks"),
        part("over", " overstock rows"),
        part("high", " high demand items"),
        part("total_recommendations", " active recommendations"),
    )
    return r.join(inv).join(health.select("health_label")).select(  # one row each
        F.col("health_label").alias("database_health"),
        "total_recommendations",
        "high_priority_alerts",
        F.when(parts == "", F.lit(NO_RUN)).otherwise(F.concat(parts, F.lit("."))).alias("summary"),
    )


def focus_products(low_stock: DataFrame, high_demand: DataFrame) -> DataFrame:
    ids = low_stock.select("product_id").union(high_demand.select("product_id"))
    return ids.filter(F.coalesce("product_id", F.lit("")) != "").distinct().orderBy("product_id")
