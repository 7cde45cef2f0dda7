"""Recommendation, decision and outcome memory, learning insights and review lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.functions.exprs import prefixed, priority_rank, text
from stockloom.functions.ids import sequential_ids
from stockloom.operators.recommend import record_weight, with_texts
from stockloom.schemas import DECISION_MEMORY, LEARNING_INSIGHTS, OUTCOME_MEMORY, RECOMMENDATION_MEMORY, extended
from stockloom.sources.tables import align_to_schema

MEMORY_KEYS = ["product_id", "store_id", "recommendation_type"]

# Outcome words, tested as substrings and in this order.
POSITIVE_TERMS = ["worked", "success", "improved", "good", "effective"]
NEGATIVE_TERMS = ["failed", "poor", "bad", "declined", "ineffective"]


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def recommendation_memory_rows(
    batch: DataFrame, existing: DataFrame, recorded_at: str, number: Column | None = None, keep: list[str] = ()
) -> DataFrame:
    """New memory rows of a batch, numbered after the existing rows. Columns of `keep` stay.

    `number` is the place of a row in the order of the batch, where that is known without a sort of the rows."""
    kept = {c: batch.schema[c].dataType.simpleString() for c in keep}
    rows = align_to_schema(
        batch.withColumn("recorded_at", F.lit(recorded_at).cast("timestamp")), extended(RECOMMENDATION_MEMORY, **kept)
    )
    if number is not None:
        rest = [c for c in rows.columns if c != "memory_id"]
        return rows.select(prefixed("MEMREC", number + row_count(existing), 6).alias("memory_id"), *rest)
    order = ["recommendation_id", "product_id", "store_id"]
    return sequential_ids(rows, order, "MEMREC", 6, "memory_id", row_count(existing))


def decision_memory_rows(decisions: DataFrame, recs: DataFrame, existing: DataFrame) -> DataFrame:
    """A batch of decisions with the details of their recommendations."""
    detail = recs.select("recommendation_id", "recommendation_type", "product_id", "product_name", "store_id", "source_agent")
    rows = align_to_schema(
        decisions.withColumnRenamed("decided_at", "recorded_at").join(detail, "recommendation_id"), DECISION_MEMORY
    )
    return sequential_ids(rows, ["recorded_at", "recommendation_id", "decision"], "MEMDEC", 6, "memory_id", row_count(existing))


def outcome_memory_rows(outcomes: DataFrame, recs: DataFrame, existing: DataFrame) -> DataFrame:
    detail = recs.select("recommendation_id", "recommendation_type", "product_id", "product_name", "store_id")
    rows = align_to_schema(outcomes.join(detail, "recommendation_id"), OUTCOME_MEMORY)
    order = ["recorded_at", "recommendation_id", "outcome_status"]
    return sequential_ids(rows, order, "MEMOUT", 6, "memory_id", row_count(existing))


def filtered_memory(df: DataFrame, product_id: str = "", store_id: str = "", recommendation_type: str = "") -> DataFrame:
    for column, value in zip(MEMORY_KEYS, (product_id, store_id, recommendation_type)):
        if value and column in df.columns:
            df = df.filter(F.col(column) == value)
    return df


def newest_per_key(df: DataFrame, limit: int, keys: list[str] = MEMORY_KEYS) -> DataFrame:
    """The newest rows of every key. The rank limit is applied before the shuffle as well."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("recorded_at"), F.desc("memory_id"))
    return df.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= limit)


def _history(recent: DataFrame, column: str, label: str) -> DataFrame:
    """`value:count` items per key, most frequent first, ties by value."""
    counts = recent.groupBy(*MEMORY_KEYS, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "value")))
    listed = F.transform(items, lambda x: F.concat(x["value"], F.lit(":"), (-x["rank"]).cast("string")))
    return counts.groupBy(*MEMORY_KEYS).agg(F.array_join(listed, ", ").alias(label))


def memory_context(recs: DataFrame, decisions: DataFrame, outcomes: DataFrame, limit: int = 5) -> DataFrame:
    """For every product, store and type: newest history counts and a hint text. Of the recommendations only the number
    is told, so they may be a digest."""
    newest = F.least(F.sum(record_weight(recs)), F.lit(limit).cast("long")).alias("recent_recommendations")
    r5 = recs.groupBy(*MEMORY_KEYS).agg(newest).filter("recent_recommendations > 0")
    d5, o5 = (newest_per_key(df, limit) for df in (decisions, outcomes))
    latest_o = o5.filter("recency = 1").select(
        *MEMORY_KEYS, text("outcome_status").alias("last_status"), text("outcome_note").alias("last_note")
    )
    latest_d = d5.filter("recency = 1").select(
        *MEMORY_KEYS,
        text("decision").alias("last_decision"),
        F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("last_time"),
    )
    count = lambda df, name: df.groupBy(*MEMORY_KEYS).agg(F.count(F.lit(1)).alias(name))
    joined = (
        r5.join(count(d5, "recent_decisions"), MEMORY_KEYS, "full")
        .join(count(o5, "recent_outcomes"), MEMORY_KEYS, "full")
        .join(_history(d5, "decision", "decision_history"), MEMORY_KEYS, "left")
        .join(_history(o5, "outcome_status", "outcome_history"), MEMORY_KEYS, "left")
        .join(latest_o, MEMORY_KEYS, "left")
        .join(latest_d, MEMORY_KEYS, "left")
    )
    status, note = F.col("last_status"), F.col("last_note")
    hint = F.concat_ws(
        "; ",
        F.concat(F.lit("decision_history="), "decision_history"),
        F.concat(F.lit("outcome_history="), "outcome_history"),
        F.when(
            (status != "") | (note != ""),
            F.concat(
                F.lit("latest_outcome="),
                F.when(status == "", "unknown").otherwise(status),
                F.when(note == "", "").otherwise(F.concat(F.lit(" ("), note, F.lit(")"))),
            ),
        ),
        F.when(
            F.col("last_decision") != "",
            F.concat(
                F.lit("latest_decision="), "last_decision", F.coalesce(F.concat(F.lit(" at "), "last_time"), F.lit(""))
            ),
        ),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        *MEMORY_KEYS,
        zero("recent_recommendations"),
        zero("recent_decisions"),
        zero("recent_outcomes"),
        F.coalesce("decision_history", F.lit("")).alias("decision_history"),
        F.coalesce("outcome_history", F.lit("")).alias("outcome_history"),
        hint.alias("memory_hint"),
    )


def system_memory_summary(recs: DataFrame, decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.coalesce(F.sum(record_weight(df)), F.lit(0)).cast("long").alias(name))
    return (  # one row each
        n(recs, "recommendation_history_count")
        .join(n(decisions, "decision_history_count"))
        .join(n(outcomes, "outcome_history_count"))
    )


def newest_rows(df: DataFrame, limit: int = 10) -> DataFrame:
    return df.orderBy(F.desc("recorded_at"), F.desc("memory_id")).limit(limit)


def latest_per_recommendation(df: DataFrame, time: str, tie: str, fields: list[str]) -> DataFrame:
    """Newest row of every recommendation id, as a map-side aggregation."""
    last = F.max_by(F.struct(*fields), F.struct(time, tie)).alias("r")
    return df.filter(F.col("recommendation_id").isNotNull()).groupBy("recommendation_id").agg(last).select(
        "recommendation_id", *[F.col(f"r.{f}").alias(f) for f in fields]
    )


def feedback_rows(
    recs: DataFrame, decisions: DataFrame, outcomes: DataFrame, joined_with: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Recommendation memory with its latest decision and latest outcome.

    `joined_with` gives the memory joined with rows of one row per id, where that is known without a join by id."""
    d = latest_per_recommendation(
        decisions.withColumn("decision_recorded_at", F.col("recorded_at")),
        "recorded_at", "memory_id", ["decision_recorded_at", "decision"],
    )
    o = latest_per_recommendation(
        outcomes.withColumn("outcome_recorded_at", F.col("recorded_at")),
        "recorded_at", "memory_id", ["outcome_recorded_at", "action_taken", "outcome_status", "outcome_note"],
    )
    blank = {c: F.coalesce(c, F.lit("")) for c in ("decision", "action_taken", "outcome_status", "outcome_note")}
    if joined_with:
        return joined_with(d.join(o, "recommendation_id", "full")).withColumns(blank)
    return recs.join(d, "recommendation_id", "left").join(o, "recommendation_id", "left").withColumns(blank)


def _contains_any(column: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | column.contains(w)
    return found


def learning_insights(feedback: DataFrame, recorded_at: str) -> DataFrame:
    """One insight per feedback row with a decision or an outcome. Positive words are tested first, as
    substrings, so "ineffective" reads as a success."""
    status = F.lower(F.trim("outcome_status"))
    kind = F.trim("recommendation_type")
    action = text("action_taken", F.trim("decision"))
    named = F.when(kind == "", "Recommendation").otherwise(kind)
    this = F.when(kind == "", "this action").otherwise(kind)
    after = F.when(action == "", "").otherwise(F.concat(F.lit(" after action '"), action, F.lit("'")))
    worked, failed = _contains_any(status, POSITIVE_TERMS), _contains_any(status, NEGATIVE_TERMS)
    insight = (
        F.when(worked, F.concat(named, F.lit(" appears to have worked"), after, F.lit(".")))
        .when(failed, F.concat(named, F.lit(" appears to have worked poorly"), after, F.lit(".")))
        .otherwise("No strong learning signal is available yet.")
    )
    note = F.trim("outcome_note")
    adjustment = (
        F.when(worked, F.concat(F.lit("keep using "), this, F.lit(" when similar signals appear")))
        .when(failed, F.concat(F.lit("avoid repeating "), this, F.lit(" in the same context")))
        .otherwise("monitor future results before changing strategy")
    )
    rows = feedback.filter((F.col("decision") != "") | (F.col("outcome_status") != "")).select(
        "memory_id",
        F.lit(recorded_at).cast("timestamp").alias("recorded_at"),
        kind.alias("recommendation_type"),
        "product_id",
        "product_name",
        "store_id",
        action.alias("action_taken"),
        "outcome_status",
        F.when(worked, "worked").when(failed, "failed").otherwise("neutral").alias("learning_label"),
        F.when(note == "", insight).otherwise(F.concat(insight, F.lit(" Outcome note: "), note)).alias("insight"),
        adjustment.alias("recommended_adjustment"),
        F.lit("heuristic").alias("source"),
    )
    return sequential_ids(rows, ["memory_id"], "LEARN", 6, "insight_id").select(*LEARNING_INSIGHTS.names)


def learning_context(insights: DataFrame, limit: int = 5) -> DataFrame:
    """For every key: how many of its first insights are kept and the hint from the first one."""
    first = Window.partitionBy(*MEMORY_KEYS).orderBy("insight_id")
    kept = insights.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit)
    hint = F.trim(
        F.concat(
            F.trim("insight"),
            F.when(text("recommended_adjustment") == "", "").otherwise(
                F.concat(F.lit(" Recommended adjustment: "), F.trim("recommended_adjustment"))
            ),
        )
    )
    return kept.groupBy(*MEMORY_KEYS).agg(
        F.count(F.lit(1)).alias("recent_learning_insights"),
        F.max(F.when(F.col("place") == 1, hint)).alias("learning_hint"),
    )


def learning_summary(insights: DataFrame) -> DataFrame:
    return insights.groupBy("learning_label").agg(F.count(F.lit(1)).alias("insight_count"))


def reorder_hints(context: DataFrame, learning: DataFrame) -> DataFrame:
    """Memory and learning hints of reorders per product and store."""
    m = context.filter(F.col("recommendation_type") == "reorder").select("product_id", "store_id", "memory_hint")
    ln = learning.filter(F.col("recommendation_type") == "reorder").select("product_id", "store_id", "learning_hint")
    return m.join(ln, ["product_id", "store_id"], "full")


# --- review lists -----------------------------------------------------------------------------


def apply_latest_decisions(
    recs: DataFrame, decisions: DataFrame, tie: str = "decision", joined_with: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The latest decision overrides the status; notes come from the decision, else from the record.

    `joined_with` gives the records joined with rows of one row per id, where that is known without a join by id."""
    notes = ["manager_note", "rejection_reason", "action_summary", "execution_status"]
    present = [c for c in notes if c in decisions.columns]
    d = latest_per_recommendation(decisions, "decided_at", tie, ["decision", *present])
    own = [c for c in present if c in recs.columns]
    if joined_with:
        joined = joined_with(d.withColumnsRenamed({c: f"new_{c}" for c in own}))
        joined = joined.withColumnsRenamed({c: f"own_{c}" for c in own}).withColumnsRenamed({f"new_{c}": c for c in own})
    else:
        joined = recs.withColumnsRenamed({c: f"own_{c}" for c in own}).join(d, "recommendation_id", "left")
    return joined.withColumns(
        {"status": F.coalesce("decision", "status"), **{c: F.coalesce(c, f"own_{c}") for c in own}}
    ).drop("decision", *[f"own_{c}" for c in own])


def filter_recommendations(
    recs: DataFrame, types=(), products=(), stores=(), priorities=(), statuses=()
) -> DataFrame:
    chosen = {
        "recommendation_type": types, "product_name": products, "store_id": stores, "priority": priorities, "status": statuses,
    }
    for column, values in chosen.items():
        if values:
            recs = recs.filter(F.col(column).isin(*values))
    return recs


# Card titles by recommendation type.
CARD_GROUPS = {
    "Pricing & Clearance": ["discount", "clearance"],
    "Stock Transfer": ["stock_transfer", "transfer", "exclusive_availability", "alternative_option"],
    "Procurement": ["reorder"],
    "Risk Alerts": ["supplier_risk_alert", "overstock_alert", "stockout_prevention_alert"],
}


def card_title(column="recommendation_type") -> Column:
    title = F.lit(None)
    for name, types in CARD_GROUPS.items():
        title = F.when(F.col(column).isin(*types), name).otherwise(title)
    return title


def recommendation_cards(recs: DataFrame) -> DataFrame:
    filled = F.coalesce("action", F.lit("")) != ""
    n = record_weight(recs)
    n_if = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    return (
        recs.withColumn("title", card_title())
        .filter(F.col("title").isNotNull())
        .groupBy("title")
        .agg(
            F.sum(n).alias("row_count"),
            F.countDistinct(F.nullif("product_id", F.lit(""))).alias("product_count"),
            n_if(F.lower("status") == "pending").alias("pending_count"),
            n_if(F.lower("priority") == "high").alias("high_count"),
            F.coalesce(
                F.min_by(F.when(filled, F.col("action")), F.when(filled, F.col("recommendation_id"))),
                F.lit("No current action available."),
            ).alias("first_action"),
        )
    )


def latest_recommendations(recs: DataFrame, limit: int = 10) -> DataFrame:
    return with_texts(recs).orderBy(priority_rank("priority"), "recommendation_id").limit(limit).select(
        "recommendation_id", "recommendation_type", "product_name", "store_id", "priority", "action", "reason",
        "source_agent", "status",
    )


def distinct_options(df: DataFrame, column: str) -> DataFrame:
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return df.select(value.alias("option")).filter("option <> ''").distinct().orderBy("option")
