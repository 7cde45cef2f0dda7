"""Recommendation context and explanation, agent cards and executive texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.functions.exprs import (
    discount_percent,
    discounted,
    parse_evidence,
    priority_rank,
    round2,
    round_even,
    sentence,
    title_or_info,
    truthy,
    truthy_text,
)
from stockloom.operators.recommend import OPPORTUNITY_TYPES, RISK_TYPES, first_text, record_weight, with_texts

# Which analyzer output explains a recommendation type.
ANALYSIS_OF_TYPE = {
    "discount": "overstock_items",
    "clearance": "dead_stock_candidates",
    "reorder": "low_stock_items",
    "transfer": "low_stock_items",
    "stock_transfer": "low_stock_items",
    "stockout_prevention_alert": "stockout_risk_items",
    "overstock_alert": "overstock_items",
}


def _dataset_of(kind: str) -> Column:
    name = F.lit(None)
    for t, d in ANALYSIS_OF_TYPE.items():
        name = F.when(F.col(kind) == t, d).otherwise(name)
    return name


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _resolved(prefix: str, given: Column, df: DataFrame, stores: DataFrame) -> DataFrame:
    """Store id and name of a text that is an id or a name; unknown texts stand for both."""
    by_id = stores.select(F.col("store_id").alias("_given"), F.col("store_name").alias("_name_by_id"))
    by_name = stores.groupBy(F.col("store_name").alias("_given")).agg(F.min("store_id").alias("_id_by_name"))
    return (
        df.withColumn("_given", given)
        .join(by_id, "_given", "left")
        .join(by_name, "_given", "left")
        .withColumn(f"{prefix}_store_id", F.when(F.col("_name_by_id").isNull(), F.coalesce("_id_by_name", "_given")).otherwise(F.col("_given")))
        .withColumn(f"{prefix}_store_name", F.coalesce("_name_by_id", "_given"))
        .drop("_given", "_name_by_id", "_id_by_name")
    )


def recommendation_context(
    recs: DataFrame,
    products: DataFrame,
    stores: DataFrame,
    suppliers: DataFrame,
    inventory: DataFrame,
    current_inventory: DataFrame,
    analysis: DataFrame,
) -> DataFrame:
    """Each recommendation with product, store, supplier, stock and the analyzer row of its type.

    `analysis` is the tagged union of the analyzer outputs; one equi-join on (dataset, product, store)
    finds the row that fits the type.
    """
    p = products.select(
        "product_id",
        F.col("supplier_id").alias("p_supplier"),
        F.col("selling_price").alias("current_price"),
        F.col("shelf_life_days").alias("p_shelf"),
        F.col("reorder_threshold").alias("p_threshold"),
        F.col("category").alias("p_category"),
    )
    s = stores.select("store_id", F.col("store_name").alias("s_name"))
    i = inventory.select(
        "product_id", "store_id", F.col("stock_level").alias("i_stock"), F.col("reorder_threshold").alias("i_threshold")
    )
    c = current_inventory.select("product_id", "store_id", F.col("stock_level").alias("c_stock"))
    a = analysis.filter(F.col("dataset").isin(*sorted(set(ANALYSIS_OF_TYPE.values())))).select(
        "dataset",
        "product_id",
        "store_id",
        F.col("supplier_id").alias("a_supplier"),
        F.col("store_name").alias("a_store_name"),
        F.col("stock_level").alias("a_stock"),
        F.col("effective_reorder_threshold").alias("a_threshold"),
        F.col("recent_daily_sales_velocity").alias("a_velocity"),
        F.col("recent_30_day_quantity_sold").alias("a_q30"),
        F.col("days_of_stock_remaining").alias("a_days"),
        F.col("shelf_life_days").alias("a_shelf"),
        F.col("category").alias("a_category"),
    )
    rows = (
        recs.withColumns({"evidence_map": parse_evidence("evidence"), "dataset": _dataset_of("recommendation_type")})
        .join(p, "product_id", "left")
        .join(s, "store_id", "left")
        .join(i, ["product_id", "store_id"], "left")
        .join(c, ["product_id", "store_id"], "left")
        .join(a, ["dataset", "product_id", "store_id"], "left")
    )
    ev = lambda k: F.col("evidence_map")[k]
    rows = rows.withColumn("supplier_id", truthy_text("p_supplier", "a_supplier", ev("supplier_id"))).join(
        suppliers.select(
            "supplier_id", "supplier_name",
            F.col("reliability_score").alias("u_reliability"), F.col("avg_delivery_days").alias("u_delivery"),
        ),
        "supplier_id",
        "left",
    )
    rows = _resolved("source", truthy_text(ev("source_store_id"), ev("source_store")), rows, stores)
    rows = _resolved(
        "target", truthy_text(ev("destination_store_id"), ev("destination_store"), "store_id"), rows, stores
    )
    percent = discount_percent("action", "recommendation_type")
    double = lambda *cols: truthy(*[F.col(x).cast("double") if isinstance(x, str) else _number(x) for x in cols], default=0.0)
    return rows.select(
        "recommendation_id",
        "recommendation_type",
        "product_id",
        "product_name",
        "store_id",
        "priority",
        "action",
        "reason",
        "evidence",
        "source_agent",
        F.coalesce("s_name", F.lit("")).alias("store_name"),
        "supplier_id",
        F.coalesce("supplier_name", F.lit("")).alias("supplier_name"),
        round_even(double("i_stock", "c_stock", "a_stock")).alias("current_stock"),
        round_even(double("i_threshold", "a_threshold", "p_threshold")).alias("threshold"),
        F.coalesce(F.col("current_price").cast("double"), F.lit(0.0)).alias("current_price"),
        percent.alias("recommended_discount_percent"),
        F.coalesce(discounted("current_price", percent), F.lit(0.0)).alias("discounted_price"),
        round_even(double("suggested_quantity", ev("suggested_quantity"), ev("quantity"))).alias("suggested_quantity"),
        "source_store_id",
        "source_store_name",
        "target_store_id",
        truthy_text("target_store_name", "s_name", "a_store_name", "target_store_id").alias("target_store_name"),
        double("a_velocity", ev("recent_daily_velocity")).alias("recent_daily_velocity"),
        round_even(double("a_q30")).alias("recent_30_day_sales"),
        round2(double("a_days", ev("days_of_stock"))).alias("days_of_stock"),
        round_even(double("p_shelf", "a_shelf")).alias("shelf_life_days"),
        double("u_reliability", ev("reliability_score")).alias("reliability_score"),
        double("u_delivery", ev("avg_delivery_days")).alias("avg_delivery_days"),
        "alternative_product_name",
        "alternative_store_name",
        round_even(double("available_quantity", ev("available_quantity"))).alias("available_quantity"),
        truthy_text("p_category", "a_category", ev("category")).alias("category"),
        (F.lower(F.coalesce(ev("is_exclusive"), F.lit(""))) == "true").alias("is_exclusive"),
    )


def _say(*parts) -> Column:
    out = [F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) if p.startswith("{") else F.lit(p) for p in parts]
    return F.concat(*out)


def recommendation_explanation(context: DataFrame) -> DataFrame:
    """Rule texts that explain a recommendation to its reviewer."""
    kind = F.col("recommendation_type")
    is_transfer = kind.isin("transfer", "stock_transfer")
    place = truthy_text("store_name", "store_id")
    rate = F.format_string("%.2f", "recent_daily_velocity")

    def by_type(discount, clearance, transfer, exclusive, alternative, reorder, other) -> Column:
        return (
            F.when(kind == "discount", discount)
            .when(kind == "clearance", clearance)
            .when(is_transfer, transfer)
            .when(kind == "exclusive_availability", exclusive)
            .when(kind == "alternative_option", alternative)
            .when(kind == "reorder", reorder)
            .otherwise(other)
        )

    factors = by_type(
        F.concat(
            F.lit("Slow movement, overstock pressure, recent sales velocity of "), rate,
            _say(" units/day, stock level of ", "{current_stock}", ", and shelf life of ", "{shelf_life_days}", " days were considered."),
        ),
        _say(
            "Current stock is ", "{current_stock}", ", recent 30-day movement is ", "{recent_30_day_sales}",
            " units, and shelf life pressure is ", "{shelf_life_days}", " days.",
        ),
        _say(
            "Target stock is ", "{current_stock}", " against threshold ", "{threshold}", ". The transfer suggestion is ",
            "{suggested_quantity}", " units from ", "{source_store_name}", ".",
        ),
        _say(
            "{product_name}", " has ", "{available_quantity}", " units available at ", "{store_name}",
            " and no positive stock in other stores.",
        ),
        _say(
            "{product_name}", " is low at ", "{store_name}", ", while ", "{alternative_product_name}", " has ",
            "{available_quantity}", " units at ", "{alternative_store_name}", ".",
        ),
        _say(
            "Current stock is ", "{current_stock}", ", reorder threshold is ", "{threshold}",
            ", and the suggested replenishment is ", "{suggested_quantity}", " units.",
        ),
        F.concat(
            F.lit("Priority, supporting evidence, and related product or supplier signals were reviewed. Evidence: "),
            F.coalesce(F.nullif("evidence", F.lit("")), F.lit("not provided")),
        ),
    )
    impact = by_type(
        *map(
            F.lit,
            [
                "Approving will lower the selling price of the product and record a price update.",
                "Approving will lower the selling price of the product and record a clearance action.",
                "Approving will move stock between the stores, add two ledger rows and record a transfer.",
                "Approving records a promotion without changing stock.",
                "Approving records the alternative offer without moving stock.",
                "Approving will add stock to the store, add a ledger row and record a procurement order.",
                "Approving will mark the alert as mitigated and record the mitigation.",
            ],
        )
    )
    improvement = by_type(
        *map(
            F.lit,
            [
                "Lower pricing should improve sell-through and reduce excess holding time.",
                "Clearance should accelerate sell-through and reduce expiry or dead-stock exposure.",
                "Balancing stock should reduce lost sales at the target store without waiting for fresh procurement.",
                "The item can be promoted as a store-specific option when nearby alternatives are limited.",
                "The alternative can protect sales when the original low-stock item cannot be fulfilled quickly.",
                "Replenishment should restore coverage and lower the chance of missed demand.",
                "Operational follow-up should reduce escalation risk and improve traceability.",
            ],
        )
    )
    risk = by_type(
        F.lit("Excess inventory may continue tying up working capital and shelf space."),
        F.lit("The item may remain stuck in inventory or age out before it sells."),
        F.lit("The destination store may stock out while surplus stock sits elsewhere."),
        F.lit("The business may miss a chance to redirect demand toward available inventory."),
        F.lit("Customers may see an unavailable item without a substitute offer."),
        F.lit("The store could continue running below safe coverage and move closer to stockout."),
        F.concat(
            F.lit("The "), F.replace(kind, F.lit("_"), F.lit(" ")),
            F.lit(" may worsen without a documented mitigation step."),
        ),
    )
    why = F.concat(
        "product_name", F.lit(" at "), F.when(place == "", "the relevant scope").otherwise(place),
        F.lit(" was flagged because "),
        F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("the underlying metrics crossed the configured threshold")),
        F.lit("."),
    )
    return context.select(
        "recommendation_id",
        why.alias("why_generated"),
        factors.alias("factors_analyzed"),
        impact.alias("expected_business_impact"),
        improvement.alias("sales_inventory_improvement"),
        risk.alias("risk_if_ignored"),
        F.coalesce(F.nullif("priority", F.lit("")), F.lit("medium")).alias("confidence_level"),
        "source_agent",
        F.coalesce(
            F.nullif("evidence", F.lit("")), F.lit("No evidence string is available for this recommendation.")
        ).alias("supporting_evidence"),
    )


NO_RISK = "No major risk stands out in the latest run."
NO_OPPORTUNITY = "No standout commercial opportunity is available yet."


def _headline(recs: DataFrame, types: list[str], column: str, otherwise: str, none: str) -> DataFrame:
    """Sentence about the best-ranked row of some types."""
    best = with_texts(recs).filter(F.col("recommendation_type").isin(*types)).agg(
        F.min_by(
            F.struct("product_name", column, "recommendation_type"),
            F.struct(priority_rank("priority"), "recommendation_id"),
        ).alias("b")
    )
    name, body = F.trim("b.product_name"), F.trim(f"b.{column}")
    kind = F.initcap(F.replace(F.col("b.recommendation_type"), F.lit("_"), F.lit(" ")))
    raw = (
        F.when((name != "") & (body != ""), F.concat(name, F.lit(": "), body))
        .when(body != "", body)
        .when(F.col("b").isNotNull(), F.concat(kind, F.lit(otherwise)))
    )
    return best.select(sentence(raw, none).alias("headline"))


def top_risk(recs: DataFrame) -> DataFrame:
    return _headline(recs, RISK_TYPES, "reason", " needs attention", NO_RISK)


def top_opportunity(recs: DataFrame) -> DataFrame:
    return _headline(recs, OPPORTUNITY_TYPES, "action", " is the strongest current opportunity", NO_OPPORTUNITY)


def agent_top3(recs: DataFrame, limit: int = 3) -> DataFrame:
    """The best-ranked records of every agent; the rank limit prunes before the shuffle."""
    w = Window.partitionBy("source_agent").orderBy(priority_rank("priority"), "recommendation_id")
    return with_texts(recs).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select(
        "source_agent", "place", "recommendation_id", "recommendation_type", "product_name", "store_id", "priority",
        "action", "reason",
    )


def top_alerts(alerts: DataFrame, limit: int = 5) -> DataFrame:
    """Most urgent low stock alerts in their own order."""
    return alerts.orderBy(
        priority_rank("priority"), F.desc("shortage_quantity"), "current_quantity", "product_id", "store_id"
    ).limit(limit).select(
        "product_name", "store_name", "store_id", "current_quantity", "reorder_threshold", "suggested_reorder_quantity", "priority"
    )


def low_stock_alert_text(alerts: DataFrame) -> DataFrame:
    order = F.struct(
        F.when(F.col("priority") == "High", 0).otherwise(1), priority_rank("priority"), -F.col("shortage_quantity"),
        "current_quantity", "product_id", "store_id",
    )
    facts = alerts.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(F.nullif("product_id", F.lit(""))).alias("products"),
        F.countDistinct(F.nullif("store_id", F.lit(""))).alias("stores"),
        F.min_by(F.struct("product_name", "store_name", "current_quantity"), order).alias("f"),
    )
    plural = lambda c: F.when(F.col(c) == 1, "").otherwise("s")
    said = F.concat(
        "products", F.lit(" product"), plural("products"), F.lit(" are below reorder threshold across "), "stores",
        F.lit(" store"), plural("stores"), F.lit(". Highest priority: "), "f.product_name", F.lit(" at "), "f.store_name",
        F.lit(" has only "), "f.current_quantity", F.lit(" units left."),
    )
    none = F.lit("No critical low-stock alerts right now.")
    return facts.select(F.when(F.col("n") == 0, none).otherwise(said).alias("low_stock_alert"))


# Card labels of the agents.
AGENT_LABELS = {
    "inventory_agent": ("Inventory", "Stock & demand", "blue"),
    "pricing_agent": ("Pricing", "Discount strategy", "purple"),
    "transfer_agent": ("Transfer / Supply", "Store balancing", "teal"),
    "risk_agent": ("Risk", "Risk monitoring", "orange"),
    "procurement_agent": ("Procurement", "Reorder planning", "green"),
}


def _label(place: int) -> Column:
    out = F.initcap(F.replace("agent_name", F.lit("_"), F.lit(" "))) if place == 0 else F.lit(["", "Agent summary", "blue"][place])
    for agent, labels in AGENT_LABELS.items():
        out = F.when(F.col("agent_name") == agent, labels[place]).otherwise(out)
    return out


def agent_cards(outputs: DataFrame, recs: DataFrame, surplus: DataFrame, alternatives: DataFrame) -> DataFrame:
    """One card per agent: labels, count, priority, summary and next action."""
    kind = F.col("recommendation_type")
    moves = kind.isin("transfer", "stock_transfer")
    first_of = lambda cond: F.min_by(F.when(cond, F.col("action")), F.when(cond, F.col("recommendation_id")))
    facts = recs.groupBy(F.col("source_agent").alias("agent_name")).agg(
        first_text("reason").alias("reason"),
        first_text("action").alias("action"),
        F.coalesce(F.sum(F.when(moves, record_weight(recs))), F.lit(0)).cast("long").alias("transfer_n"),
        first_of(kind == "alternative_option").alias("alternative_action"),
        first_of(moves).alias("transfer_action"),
    )
    s = surplus.agg(
        F.count(F.lit(1)).alias("surplus_n"),
        F.min_by("store_name", F.struct("opportunity_level", -F.col("surplus_quantity"), "product_name", "store_id")).alias("top_store"),
    )
    alt = alternatives.agg(F.count(F.lit(1)).alias("alternative_n"))
    n, insight = F.col("finding_count"), F.trim("latest_insight")
    counted = F.when(
        ~F.contains(insight, n.cast("string")), F.concat(n, F.lit(" findings were flagged. "), insight)
    ).otherwise(insight)
    plain = F.when(insight == "", F.concat(n, F.lit(" findings were flagged in the latest run."))).otherwise(counted)
    transfer_summary = F.concat(
        "transfer_n", F.lit(" transfer opportunities detected. "), "surplus_n", F.lit(" surplus stock items and "),
        "alternative_n", F.lit(" alternative availability options are active. Top source store: "),
        F.coalesce("top_store", F.lit("no source store")), F.lit("."),
    )
    is_transfer = (F.col("agent_name") == "transfer_agent") & F.col("transfer_n").isNotNull()
    summary = F.when(n == 0, "No new findings are available yet.").when(is_transfer, transfer_summary).otherwise(plain)
    action = (
        F.when(n == 0, "Run the agents to refresh the latest view.")
        .when(is_transfer, F.concat_ws(" ", "alternative_action", "transfer_action"))
        .otherwise(F.coalesce("action", "reason", F.lit("Review the latest items and act on the highest priority rows first.")))
    )
    return (
        outputs.join(facts, "agent_name", "left")
        .join(s)  # one row
        .join(alt)  # one row
        .select(
            "agent_name",
            _label(0).alias("display_name"),
            _label(1).alias("role_label"),
            _label(2).alias("accent"),
            "finding_count",
            title_or_info("priority_level").alias("priority_level"),
            sentence(summary, "The latest run produced new findings.").alias("summary"),
            sentence(action, "Review the highest priority rows first.").alias("recommended_action"),
            F.lit("fallback").alias("summary_source"),
        )
    )


def executive_summary(summary: DataFrame, recs: DataFrame, alerts: DataFrame) -> DataFrame:
    risk, chance = F.col("top_risk"), F.col("top_opportunity")
    one_row = (
        summary.join(top_risk(recs).withColumnRenamed("headline", "top_risk"))  # one row each
        .join(top_opportunity(recs).withColumnRenamed("headline", "top_opportunity"))
        .join(low_stock_alert_text(alerts))
    )
    text = F.concat(
        "total_recommendations", F.lit(" recommendations are active, with "), "high_priority_alerts",
        F.lit(" high-priority alerts. Top risk: "), risk,
    )
    advice = F.concat(
        F.lit("Top opportunity: "), chance,
        F.lit(" Prioritize the highest-risk items first, then move on the strongest commercial opportunity."),
    )
    return one_row.select(
        "total_recommendations", "high_priority_alerts", "top_risk", "top_opportunity", "low_stock_alert",
        sentence(text, "The latest run is ready for review.").alias("executive_summary"),
        sentence(
            advice, "Review the latest recommendations and act on the highest-priority items first."
        ).alias("executive_recommendation"),
    )
