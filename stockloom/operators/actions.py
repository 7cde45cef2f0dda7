"""State changes as batch jobs: orders, price actions, stock moves, decisions and alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.functions.exprs import alert_key, text, whole
from stockloom.functions.ids import next_prefixed_ids
from stockloom.operators.datasets import KEYS
from stockloom.operators.folds import ORDER_STEP, PRICE_STEP, ordered_fold
from stockloom.operators.graphs import components
from stockloom.schemas import (
    ALERT_LOG, CUSTOMER_ORDERS, DECISIONS, PRICE_UPDATES, PROCUREMENT_ORDERS, RISK_ACTIONS, SALES, TRANSACTIONS, TRANSFER_ACTIONS, extended,
)
from stockloom.session import published
from stockloom.sources.tables import align_to_schema


# --- orders -----------------------------------------------------------------------------------


def store_products(inventory: DataFrame, products: DataFrame, store_id: str) -> DataFrame:
    dim = products.select("product_id", "product_name", "category", F.coalesce("selling_price", F.lit(0)).alias("selling_price"))
    return (
        inventory.filter(F.col("store_id") == store_id)
        .join(dim, "product_id", "left")
        .select(
            "product_id", "product_name", "category", whole("stock_level").alias("stock_level"), "selling_price",
            "store_id", "reorder_threshold", "last_updated",
        )
        .orderBy("product_name", "product_id")
    )


def checked_orders(requests: DataFrame, inventory: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Requests with stock, price and the first failing check (`ok` when all pass)."""
    inv = inventory.select(*KEYS, whole("stock_level").alias("available_quantity"))
    dim = products.select("product_id", "product_name", "category", F.col("selling_price").alias("unit_price"))
    known = stores.select("store_id", "store_name", "city")
    code = (
        F.when(~(F.col("quantity") > 0), "invalid_quantity")
        .when(F.col("store_name").isNull(), "unknown_store")
        .when(F.col("available_quantity").isNull(), "not_in_store")
        .when(F.col("product_name").isNull(), "unknown_product")
        .when(F.col("quantity") > F.col("available_quantity"), "insufficient_stock")
        .otherwise("ok")
    )
    return (
        requests.join(inv, KEYS, "left")
        .join(known, "store_id", "left")
        .join(dim, "product_id", "left")
        .withColumn("check_code", code)
        .withColumn("total_amount", F.when(code == "ok", F.col("quantity") * F.col("unit_price")))
    )


def applied_orders(checked: DataFrame, order: list[str]) -> DataFrame:
    """Orders in sequence per product and store: accepted while stock lasts, a rejected one takes nothing.

    Requests failing a check alone can never pass later. A pair whose stock covers all that is asked of it
    accepts everything, and holds at most as many requests as it has stock, so running sums settle it; only
    the contended pairs are folded. The checked requests are read four times, so they are written first.
    """
    checked = published(checked)
    passed = checked.filter(F.col("check_code") == "ok")
    asked = passed.groupBy(*KEYS).agg(F.sum("quantity").alias("_asked"))
    marked = passed.join(asked, KEYS).withColumn("_easy", F.col("_asked") <= F.col("available_quantity")).drop("_asked")
    so_far = Window.partitionBy(*KEYS).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    easy = marked.filter("_easy").drop("_easy").withColumn("state_after", F.col("available_quantity") - F.sum("quantity").over(so_far))
    easy = easy.withColumn("state_before", F.col("state_after") + F.col("quantity"))
    hard = ordered_fold(marked.filter("NOT _easy").drop("_easy"), KEYS, order, "available_quantity", "quantity", ORDER_STEP)
    folded = hard.unionByName(easy)
    accepted = F.col("state_after") < F.col("state_before")
    done = folded.select(
        *checked.columns,
        accepted.alias("accepted"),
        F.col("state_after").alias("remaining_stock"),
    ).withColumn("check_code", F.when(F.col("accepted"), "ok").otherwise("insufficient_stock"))
    failed = checked.filter(F.col("check_code") != "ok").withColumns(
        {"accepted": F.lit(False), "remaining_stock": F.lit(None).cast("long")}
    )
    return done.unionByName(failed)


def order_rows(applied: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Accepted orders as customer order rows, numbered after the existing ones."""
    rows = applied.filter("accepted").select(
        *[c for c in order if c not in ("product_id", "store_id")],
        F.col("order_date").cast("timestamp").alias("placed_at"),
        "store_id", "store_name", "city", "product_id", "product_name",
        F.col("quantity").alias("quantity_ordered"), "unit_price", "total_amount",
        F.lit("placed").alias("status"), "remaining_stock",
    )
    numbered = next_prefixed_ids(rows, order, existing, "order_id", "ORD")
    return align_to_schema(
        numbered.withColumn("order_date", F.col("placed_at")), extended(CUSTOMER_ORDERS, remaining_stock="long")
    )


def sale_rows(orders: DataFrame, existing: DataFrame) -> DataFrame:
    rows = orders.select(
        "order_id", F.to_date("order_date").alias("date"), "product_id", "store_id",
        F.col("quantity_ordered").alias("quantity_sold"), F.col("unit_price").alias("selling_price"),
    )
    return align_to_schema(next_prefixed_ids(rows, ["order_id"], existing, "sale_id", "SALE"), SALES)


def order_ledger(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id",
        F.to_date("order_date").alias("date"),
        F.lit("sale").alias("transaction_type"),
        "product_id",
        "store_id",
        F.col("quantity_ordered").alias("quantity"),
        F.lit("customer_order").alias("source"),
        F.concat(F.lit("Customer order "), "order_id").alias("remarks"),
    )


def inventory_after_orders(inventory: DataFrame, applied: DataFrame) -> DataFrame:
    used = applied.filter("accepted").groupBy(*KEYS).agg(F.sum("quantity").alias("used"), F.max("order_date").alias("day"))
    return inventory.join(used, KEYS, "left").select(
        *KEYS,
        (whole("stock_level") - F.coalesce("used", F.lit(0))).alias("stock_level"),
        "reorder_threshold",
        F.coalesce(F.to_date("day"), "last_updated").alias("last_updated"),
    )


def recent_orders(orders: DataFrame, limit: int = 20) -> DataFrame:
    return orders.orderBy(F.desc("order_date"), F.desc("order_id")).limit(limit)


# --- validation -------------------------------------------------------------------------------


def required_text(column: str, label: str) -> Column:
    return F.when(text(column) == "", F.lit(f"{label} is required before approval."))


def positive_whole(column: str, label: str) -> Column:
    value = F.rint(F.coalesce(F.col(column).try_cast("double"), F.lit(-1.0)))
    return F.when(value <= 0, F.lit(f"{label} must be greater than zero."))


def percent_range(column: str) -> Column:
    value = F.coalesce(F.col(column).try_cast("double"), F.lit(-1.0))
    return F.when((value <= 0) | (value >= 100), F.lit("Discount percentage must be between 0 and 100."))


def with_errors(actions: DataFrame, *checks: Column) -> DataFrame:
    """The first failing check as `error`, blank when the row is valid."""
    return actions.withColumn("error", F.coalesce(*checks, F.lit("")))


# --- price actions ----------------------------------------------------------------------------


def applied_price_actions(actions: DataFrame, products: DataFrame, order: list[str]) -> DataFrame:
    """Discounts and clearances in sequence per product; several compound. Prices move in whole cents,
    halves to even. Invalid percents and unknown products change nothing."""
    basis = F.rint(F.coalesce(F.col("discount_percent").try_cast("double"), F.lit(-1.0)) * 100).cast("long")
    price = products.select("product_id", (F.col("selling_price") * 100).cast("long").alias("cents"))
    rows = actions.join(price, "product_id", "left").withColumns({"basis": basis, "cents": F.coalesce("cents", F.lit(0))})
    folded = ordered_fold(rows, ["product_id"], order, "cents", "basis", PRICE_STEP)
    valid = (F.col("basis") > 0) & (F.col("basis") < 10000)
    new_cents = F.rint(F.col("state_before") * (10000 - F.col("basis")) / 10000.0)
    error = (
        F.when(~valid, "Discount percentage must be between 0 and 100.")
        .when(F.col("state_before") == 0, "Product was not found.")
        .when(new_cents <= 0, "Discounted price must remain above zero.")
        .otherwise("")
    )
    return folded.select(
        *actions.columns,
        (F.col("state_before") / 100.0).alias("old_price"),
        (F.col("state_after") / 100.0).alias("new_price"),
        error.alias("error"),
    )


def products_after_prices(products: DataFrame, applied: DataFrame, order: list[str]) -> DataFrame:
    last = applied.filter("error = ''").groupBy("product_id").agg(F.max_by("new_price", F.struct(*order)).alias("price"))
    new = F.coalesce(F.col("price").cast("decimal(12,2)"), "selling_price").cast("decimal(12,2)")
    return products.join(last, "product_id", "left").withColumn("selling_price", new).drop("price")


# --- stock moves ------------------------------------------------------------------------------


def _moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk the moves of each group of stores in order; the state is the stock of the stores met so far."""
    group, stock = None, {}
    for pdf in batches:
        accepted, available = [], []
        columns = (pdf[c] for c in ("product_id", "component", "source_store_id", "target_store_id", "quantity", "source_stock", "target_stock"))
        for p, c, src, tgt, qty, src0, tgt0 in zip(*columns):
            if (p, c) != group:
                group, stock = (p, c), {}
            has = None if src is None else stock.setdefault(src, src0)
            ok = src is None or (not pd.isna(has) and has >= qty)
            if ok:
                if src is not None:
                    stock[src] = has - qty
                before = stock.setdefault(tgt, tgt0)
                stock[tgt] = qty + (0 if pd.isna(before) else before)
            accepted.append(ok)
            available.append(None if has is None or pd.isna(has) else int(has))
        yield pdf.assign(accepted=accepted, available=pd.array(available, "Int64"))


#: A product with more moves than this is walked by groups of stores.
SPLIT = 10_000


def applied_moves(moves: DataFrame, inventory: DataFrame, order: list[str], split: int = SPLIT) -> DataFrame:
    """Valid moves of stock in sequence per product, with `accepted` and, for walked ones, the `available` stock.

    A move without a source store brings stock in and is always accepted; one with a source is accepted when the
    source has the stock at its turn. A product whose sources hold all that is ever asked of them never refuses,
    whatever the order; the others are walked in order as a stream of rows with the stock of the stores met as the
    only state. Moves between stores that no move connects never meet, so a product of more than `split` moves is
    walked by its connected groups of stores, each in its own task, and groups without a short source not at all.
    """
    src = inventory.select("product_id", F.col("store_id").alias("source_store_id"), whole("stock_level").alias("source_stock"))
    tgt = inventory.select("product_id", F.col("store_id").alias("target_store_id"), whole("stock_level").alias("target_stock"))
    asked = moves.groupBy("product_id", "source_store_id").agg(F.sum("quantity").alias("asked"), F.count(F.lit(1)).alias("n"))
    judged = asked.join(src, ["product_id", "source_store_id"], "left").withColumn(
        "short", F.col("source_store_id").isNotNull() & (F.col("source_stock").isNull() | (F.col("asked") > F.col("source_stock")))
    )
    products = judged.groupBy("product_id").agg(F.bool_or("short").alias("short"), (F.sum("n") > split).alias("hot"))
    contended = published(products.filter("short").select("product_id", "hot"))  # one row per product
    hot = contended.filter("hot").select("product_id")
    marked = moves.join(contended.filter("NOT hot").select("product_id", F.lit("").alias("component")), "product_id", "left")
    if not hot.isEmpty():
        crowded = moves.join(hot, "product_id", "left_semi")
        edges = crowded.select(
            F.col("product_id").alias("space"), F.coalesce("source_store_id", "target_store_id").alias("a"), F.col("target_store_id").alias("b")
        ).distinct()
        found = components(edges)
        lacking = judged.filter("short").join(hot, "product_id", "left_semi").select(F.col("product_id").alias("space"), F.col("source_store_id").alias("node"))
        lacking = found.join(lacking, ["space", "node"]).select("space", "component").distinct()
        groups = found.join(lacking, ["space", "component"]).select(
            F.col("space").alias("product_id"), F.col("node").alias("target_store_id"), F.col("component").alias("group")
        )
        marked = marked.join(groups, ["product_id", "target_store_id"], "left").withColumn("component", F.coalesce("component", "group")).drop("group")
    easy = marked.filter("component is null").withColumns({"accepted": F.lit(True), "available": F.lit(None).cast("long")})
    walk = (
        marked.filter("component is not null")
        .join(src, ["product_id", "source_store_id"], "left")
        .join(tgt, ["product_id", "target_store_id"], "left")
    )
    schema = extended(walk.schema, accepted="boolean", available="long")
    keys = ["product_id", "component"]
    walked = walk.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(_moves, schema)
    columns = [*moves.columns, "accepted", "available"]
    return easy.select(*columns).unionByName(walked.select(*columns))


def checked_transfers(actions: DataFrame) -> DataFrame:
    """Transfers with the first failing check of their values."""
    return with_errors(
        actions,
        positive_whole("quantity", "Transfer quantity"),
        required_text("source_store_id", "Source store"),
        required_text("target_store_id", "Target store"),
        F.when(F.col("source_store_id") == F.col("target_store_id"), "Source and target stores must be different."),
    )


def applied_transfers(actions: DataFrame, inventory: DataFrame, order: list[str]) -> DataFrame:
    """Transfers in sequence per product: accepted when the source has the stock at its turn."""
    checked = checked_transfers(actions)
    done = applied_moves(checked.filter("error = ''"), inventory, order).drop("available")
    done = done.withColumn("error", F.when(F.col("accepted"), "").otherwise("Source store does not have the stock."))
    return done.unionByName(checked.filter("error <> ''").withColumn("accepted", F.lit(False)))


def inventory_after_moves(inventory: DataFrame, deltas: DataFrame, products: DataFrame, day: str) -> DataFrame:
    """Inventory with summed (product, store, delta) rows; new rows take the product's threshold, or the `threshold` of
    their first row by `place` where the rows have one."""
    given = F.min_by("threshold", "place") if "threshold" in deltas.columns else F.lit(None).cast("long")
    total = deltas.groupBy(*KEYS).agg(F.sum("delta").alias("delta"), given.alias("threshold"))
    thr = products.select("product_id", F.col("reorder_threshold").alias("product_threshold"))
    return (
        inventory.withColumn("known", F.lit(True))
        .join(total, KEYS, "full")
        .join(thr, "product_id", "left")
        .select(
            *KEYS,
            (whole("stock_level") + F.coalesce("delta", F.lit(0))).alias("stock_level"),
            F.when(F.col("known"), F.col("reorder_threshold")).otherwise(F.coalesce("threshold", whole("product_threshold"))).alias("reorder_threshold"),
            F.when(F.col("delta").isNotNull(), F.lit(day).cast("date")).otherwise(F.col("last_updated")).alias("last_updated"),
        )
    )


def transfer_deltas(applied: DataFrame) -> DataFrame:
    both = F.array(
        F.struct(F.col("source_store_id").alias("store_id"), (-F.col("quantity")).alias("delta")),
        F.struct(F.col("target_store_id").alias("store_id"), F.col("quantity").alias("delta")),
    )
    return applied.filter("accepted").select("product_id", F.explode(both).alias("d")).select("product_id", "d.*")


def reorder_deltas(actions: DataFrame) -> DataFrame:
    return actions.filter("error = ''").select(*KEYS, F.col("quantity").alias("delta"))


def transfer_ledger(applied: DataFrame, ref: str = "recommendation_id") -> DataFrame:
    side = lambda kind, here, word, other: F.struct(
        F.lit(kind).alias("transaction_type"),
        F.col(here).alias("store_id"),
        F.concat(F.lit(f"Approved transfer {word} "), other, F.lit(" for recommendation "), ref).alias("remarks"),
    )
    rows = F.explode(
        F.array(
            side("transfer_out", "source_store_id", "to", "target_store_id"),
            side("transfer_in", "target_store_id", "from", "source_store_id"),
        )
    )
    return applied.filter("accepted").select(ref, "product_id", "quantity", rows.alias("m")).select(
        ref, "m.transaction_type", "product_id", "m.store_id", "quantity", "m.remarks"
    )


def reorder_ledger(actions: DataFrame, ref: str = "recommendation_id") -> DataFrame:
    return actions.filter("error = ''").select(
        ref,
        F.lit("procurement").alias("transaction_type"),
        "product_id",
        "store_id",
        "quantity",
        F.concat(F.lit("Approved reorder for recommendation "), ref).alias("remarks"),
    )


def ledger_rows(rows: DataFrame, existing: DataFrame, order: list[str], day: str) -> DataFrame:
    """Ledger rows with defaults and ids after the largest existing number."""
    filled = rows if "source" in rows.columns else rows.withColumn("source", F.lit("recommendation_execution"))
    if "date" not in filled.columns:
        filled = filled.withColumn("date", F.lit(day).cast("date"))
    return align_to_schema(next_prefixed_ids(filled, order, existing, "transaction_id", "TXN"), TRANSACTIONS)


def risk_action_log(recs: DataFrame, executed_at: str, note: str = "") -> DataFrame:
    """Mitigation rows; a blank action text is refused."""
    rows = with_errors(recs, required_text("action", "Mitigation action")).filter("error = ''")
    return align_to_schema(
        rows.select(
            F.concat(F.lit("RSK-"), "recommendation_id").alias("risk_action_id"),
            "recommendation_id", "recommendation_type", "product_id", "product_name", "store_id",
            F.trim("action").alias("mitigation_action"),
            "priority",
            F.lit(note).alias("manager_note"),
            F.lit("mitigated").alias("status"),
            F.lit(executed_at).cast("timestamp").alias("executed_at"),
        ),
        RISK_ACTIONS,
    )


# --- decisions --------------------------------------------------------------------------------


def updated_status(recs: DataFrame, decisions: DataFrame, joined_with: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records with the status, note, reason and time of their decision, others unchanged. `joined_with` gives the records
    joined with rows of one row per id, where that is known without a join by id."""
    d = decisions.select(
        "recommendation_id", F.col("status").alias("new_status"), "manager_note", "decision_reason", "status_updated_at"
    )
    blank = lambda c: F.coalesce(c, F.lit(""))
    joined = joined_with(d) if joined_with else recs.join(d, "recommendation_id", "left")
    return joined.withColumns(
        {
            "status": F.coalesce("new_status", "status"),
            "manager_note": blank("manager_note"),
            "decision_reason": blank("decision_reason"),
        }
    ).drop("new_status")


def decision_log(decided: DataFrame) -> DataFrame:
    """Decision rows in the log layout; edited values are kept as JSON text."""
    edited = F.col("edited_values_json") if "edited_values_json" in decided.columns else F.lit("{}")
    return align_to_schema(
        decided.withColumns({"decision_id": F.concat(F.lit("DEC-"), "recommendation_id"), "edited_values_json": edited}),
        DECISIONS,
    )


#: What a manager can change before approving; a null value means not changed.
EDITABLE = ["discount_percent", "suggested_quantity", "source_store", "target_store", "action_text", "priority", "manager_note"]


def edited_json(prefix: str = "") -> Column:
    """The changed values as JSON; values that were not changed are left out."""
    return F.to_json(F.struct(*(F.col(prefix + c).alias(c) for c in EDITABLE)))


# Which executor handles a type.
EXECUTOR_OF_TYPE = {
    "discount": "price", "clearance": "price", "stock_transfer": "transfer", "transfer": "transfer", "reorder": "reorder",
    "supplier_risk_alert": "risk", "overstock_alert": "risk", "stockout_prevention_alert": "risk",
    "exclusive_availability": "risk", "alternative_option": "risk",
}


def executor_of(column="recommendation_type") -> Column:
    out = F.lit("unsupported")
    for kind, executor in EXECUTOR_OF_TYPE.items():
        out = F.when(F.col(column) == kind, executor).otherwise(out)
    return out


def approve_batch(
    context: DataFrame, edits: DataFrame, inventory: DataFrame, products: DataFrame, ledger: DataFrame, day: str
) -> dict[str, DataFrame]:
    """Execute approved recommendations (rows of the recommendation context), one after the other by id.

    `edits` holds recommendation_id and the values a manager changed (EDITABLE, as text); they replace the proposed
    ones. Stock moves of all kinds, reorders and transfers, are one sequence per product, and so are price changes.
    A recommendation that fails a check, or finds too little stock at its turn, changes nothing and stays pending.
    Returns the new tables, action logs, the status, decision and outcome rows, and one result row per recommendation.
    """
    at = F.lit(f"{day} 00:00:00").cast("timestamp")
    key = ["recommendation_id"]
    changed = edits.select("recommendation_id", *(F.col(c).alias(f"_{c}") for c in EDITABLE))
    or_else = lambda c, proposed: F.coalesce(F.col(f"_{c}"), proposed)
    rows = context.join(changed, "recommendation_id", "left").withColumns(
        {
            "executor": executor_of(),
            "action_text": or_else("action_text", F.col("action")),
            "manager_note": F.trim(or_else("manager_note", F.lit(""))),
            "edited_values_json": edited_json("_"),
            "priority": F.trim(or_else("priority", F.col("priority"))),
        }
    )
    rows = published(rows)  # read by every executor below
    logged = ["recommendation_id", "recommendation_type", "product_id", "product_name", "store_id", "manager_note"]
    reason = F.trim("action_text").alias("reason")

    offers = rows.filter("executor = 'price'").select(
        *logged, "action_text", reason, or_else("discount_percent", F.col("recommended_discount_percent").cast("string")).alias("discount_percent")
    )
    offers = with_errors(offers, percent_range("discount_percent"), required_text("action_text", "Action text"))
    priced = applied_price_actions(offers.filter("error = ''").drop("error"), products, key)
    refused = offers.filter("error <> ''").withColumns({"old_price": F.lit(None).cast("double"), "new_price": F.lit(None).cast("double")})
    priced = priced.unionByName(refused.select(*priced.columns)).withColumn("discount_percent", F.rint(F.col("discount_percent").try_cast("double") * 100) / 100)

    quantity = F.rint(or_else("suggested_quantity", F.col("suggested_quantity").cast("string")).try_cast("double")).cast("long")
    extra = ["supplier_id", "supplier_name", "threshold", "priority"]
    stock_rows = rows.withColumn("quantity", quantity)
    reorders = stock_rows.filter("executor = 'reorder'").select(
        *logged, *extra, reason, "quantity", F.lit(None).cast("string").alias("source_store_id"), F.trim(or_else("target_store", F.col("store_id"))).alias("target_store_id")
    )
    reorders = with_errors(reorders, positive_whole("quantity", "Reorder quantity"), required_text("target_store_id", "Store"))
    transfers = stock_rows.filter("executor = 'transfer'").select(
        *logged, *extra, reason, "quantity",
        F.trim(or_else("source_store", F.col("source_store_id"))).alias("source_store_id"),
        F.trim(or_else("target_store", F.col("target_store_id"))).alias("target_store_id"),
    )
    checked = reorders.unionByName(checked_transfers(transfers).select(*reorders.columns))
    moved = published(applied_moves(checked.filter("error = ''"), inventory, key))
    missing = F.when(F.col("available").isNull(), "Source store inventory row is missing for this product.").otherwise(
        F.concat(F.lit("Transfer would create negative stock at the source store. Available: "), "available", F.lit(", requested: "), "quantity", F.lit("."))
    )
    stock = moved.withColumn("error", F.when(F.col("accepted"), "").otherwise(missing)).drop("available")
    stock = stock.unionByName(checked.filter("error <> ''").withColumn("accepted", F.lit(False)).select(*stock.columns))
    is_transfer = F.col("recommendation_type").isin(*[t for t, e in EXECUTOR_OF_TYPE.items() if e == "transfer"])
    orders, shifts = stock.filter(~is_transfer), stock.filter(is_transfer)
    side = lambda store, delta, threshold: F.struct(store.alias("store_id"), delta.alias("delta"), threshold.alias("threshold"))
    no_threshold = F.lit(None).cast("long")
    changes = F.when(
        is_transfer, F.array(side(F.col("source_store_id"), -F.col("quantity"), no_threshold), side(F.col("target_store_id"), F.col("quantity"), no_threshold))
    ).otherwise(F.array(side(F.col("target_store_id"), F.col("quantity"), F.col("threshold").cast("long"))))
    deltas = stock.filter("accepted").select("product_id", F.col("recommendation_id").alias("place"), F.explode(changes).alias("d")).select("product_id", "place", "d.*")
    entries = transfer_ledger(shifts).unionByName(reorder_ledger(orders.withColumn("store_id", F.col("target_store_id"))))

    risks = with_errors(rows.filter("executor = 'risk'"), required_text("action_text", "Mitigation action"))
    unsupported = rows.filter("executor = 'unsupported'")
    result = lambda df, error, summary: df.select("recommendation_id", error.alias("error"), summary.alias("action_summary"))
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    percent = F.format_string("%.2f", "discount_percent")
    price_text = F.when(
        F.col("recommendation_type") == "clearance",
        say("Applied clearance pricing to ", F.format_string("%.2f", "new_price"), " after ", percent, "% markdown."),
    ).otherwise(
        say("Updated selling price from ", F.format_string("%.2f", "old_price"), " to ", F.format_string("%.2f", "new_price"),
            " (", percent, "% discount).")
    )
    results = (
        result(priced, F.col("error"), price_text)
        .unionByName(result(orders, F.col("error"), say("Added ", F.col("quantity"), " units to store ", F.col("target_store_id"), " through procurement.")))
        .unionByName(result(shifts, F.col("error"), say("Transferred ", F.col("quantity"), " units from ", F.col("source_store_id"), " to ", F.col("target_store_id"), ".")))
        .unionByName(result(risks, F.col("error"), say("Logged mitigation action: ", F.trim("action_text"))))
        .unionByName(result(unsupported, say("Unsupported recommendation type '", F.col("recommendation_type"), "'."), F.lit("")))
    )
    ok = F.col("error") == ""
    results = published(results.withColumn("action_summary", F.when(ok, F.col("action_summary")).otherwise(F.col("error"))))
    done = rows.join(results.filter(ok), "recommendation_id")
    decided = done.withColumns({"decision": F.lit("approved"), "decided_at": at, "rejection_reason": F.lit(""), "execution_status": F.lit("executed")})
    price_rows = priced.filter(ok).withColumn("executed_at", at)
    return {
        "products": products_after_prices(products, priced, key),
        "inventory": inventory_after_moves(inventory, deltas, products, day),
        "ledger": ledger_rows(entries, ledger, ["recommendation_id", "transaction_type"], day),
        "price_updates": align_to_schema(
            price_rows.withColumns({"update_id": F.concat(F.lit("PRC-"), "recommendation_id"), "action_type": F.lit("discount")}), PRICE_UPDATES
        ),
        "clearance_actions": price_rows.filter("recommendation_type = 'clearance'").select(
            F.concat(F.lit("CLR-"), "recommendation_id").alias("clearance_id"), "recommendation_id", "product_id", "product_name", "store_id", "old_price",
            F.col("discount_percent").alias("clearance_discount_percent"), "new_price", "reason", "manager_note", "executed_at",
        ),
        "transfer_actions": align_to_schema(
            shifts.filter("accepted").withColumns({"transfer_id": F.concat(F.lit("TRN-"), "recommendation_id"), "executed_at": at}), TRANSFER_ACTIONS
        ),
        "procurement_orders": align_to_schema(
            orders.filter("accepted").withColumns({"procurement_id": F.concat(F.lit("PO-"), "recommendation_id"), "store_id": F.col("target_store_id"), "executed_at": at}),
            PROCUREMENT_ORDERS,
        ),
        "risk_actions": align_to_schema(
            risks.filter(ok).withColumns(
                {"risk_action_id": F.concat(F.lit("RSK-"), "recommendation_id"), "mitigation_action": F.trim("action_text"), "status": F.lit("mitigated"), "executed_at": at}
            ),
            RISK_ACTIONS,
        ),
        "status": done.select(
            "recommendation_id", F.lit("approved").alias("status"), "manager_note",
            F.trim(F.coalesce("_action_text", "reason")).alias("decision_reason"), at.alias("status_updated_at"),
        ),
        "decisions": decision_log(decided),
        "outcomes": done.select(
            "recommendation_id", "recommendation_type", "product_id", "product_name", "store_id", F.col("action_summary").alias("action_taken"),
            F.lit("executed").alias("outcome_status"), F.col("manager_note").alias("outcome_note"), at.alias("recorded_at"),
        ),
        "results": results.select(
            "recommendation_id", F.when(ok, "approved").otherwise("pending").alias("status"),
            F.when(ok, "executed").otherwise("failed").alias("execution_status"), "action_summary",
        ),
    }


def reject_batch(recs: DataFrame, rejections: DataFrame) -> DataFrame:
    """Rejections need a reason; nothing is executed."""
    reason = F.col("rejection_reason")
    joined = with_errors(
        recs.join(rejections.select("recommendation_id", "rejection_reason"), "recommendation_id"),
        required_text("rejection_reason", "Rejection reason"),
    )
    ok = F.col("error") == ""
    return joined.select(
        "recommendation_id",
        "recommendation_type",
        F.when(ok, "rejected").otherwise(F.col("status")).alias("status"),
        F.when(ok, "not_executed").otherwise("").alias("execution_status"),
        F.when(ok, reason).otherwise("").alias("decision_reason"),
        "error",
    )


# --- alerts -----------------------------------------------------------------------------------


def new_alerts(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts whose key was never sent."""
    sent = log.filter("email_sent").select("alert_key").distinct()
    return alerts.withColumn("alert_key", alert_key()).join(sent, "alert_key", "left_anti")


def alert_signature(alerts: DataFrame) -> DataFrame:
    """Order-free signature of an alert set: rows are hashed one by one and the hashes added up, so no
    task ever holds the whole set as text."""
    fields = ["product_id", "store_id", "current_quantity", "suggested_reorder_quantity", "priority"]
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    digest = F.sha2(row, 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
    sums = [part(i).cast("string") for i in range(8)]
    return alerts.agg(F.count(F.lit(1)).alias("alert_rows"), F.sha2(F.concat_ws(":", *sums), 256).alias("sums")).select(
        "alert_rows", F.when(F.col("alert_rows") == 0, "").otherwise(F.col("sums")).alias("signature")
    )


def latest_sent(log: DataFrame) -> DataFrame:
    """The rows of the newest sent batch."""
    sent = log.filter("email_sent")
    return sent.filter(F.col("timestamp") == sent.agg(F.max("timestamp").alias("t")).scalar())


def alert_log_rows(alerts: DataFrame, timestamp: str, email_sent: bool, delivery_status: str = "", error: str = "") -> DataFrame:
    status = delivery_status or ("sent" if email_sent else "skipped")
    return align_to_schema(
        alerts.withColumns(
            {
                "timestamp": F.lit(timestamp).cast("timestamp"),
                "alert_key": alert_key(),
                "email_sent": F.lit(email_sent),
                "delivery_status": F.lit(status),
                "error_message": F.lit(error),
            }
        ),
        ALERT_LOG,
    )
