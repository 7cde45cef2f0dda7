"""Records of a run through their factors: digests, named records and records of a store equal those of all records."""

import re

import pytest
from pyspark.sql import functions as F

from stockloom.functions.ids import text_rank
from stockloom.operators import context as cx, memory as me, recommend as rc, record_search as rs, retrieval as rt, stock_views as sv, transfers as tr
from stockloom.schemas import RECOMMENDATIONS
from stockloom.session import published
from stockloom.sources.tables import align_to_schema

AGENT = "transfer_agent"


@pytest.fixture(scope="module")
def run(spark):
    """Some 110,000 alternatives, so that ids of two lengths occur, with a low row that comes twice and one without product."""
    rows = [(f"P{i:03d}", f"S{j}", f"name{i}", f"store{j}", "AB"[i % 5 == 0], i % 97 == 90, (i * 7 + j * 5) % 11 + 1) for i in range(400) for j in range(2)]
    cand = spark.createDataFrame(rows, "product_id string, store_id string, product_name string, store_name string, category string, is_exclusive boolean, available_quantity long")
    low_rows = [(f"P{i:03d}", f"name{i}", "S0", "store0", "AB"[i % 5 == 0]) for i in range(400)] + [("P001", "name1", "S0", "store0", "A"), (None, None, "S1", "store1", "B")]
    low = spark.createDataFrame(low_rows, "product_id string, product_name string, store_id string, store_name string, category string")
    kinds = [("pricing_agent", "clearance", "high"), ("risk_agent", "overstock_alert", "medium"), (AGENT, "transfer", "medium")]
    others = spark.createDataFrame(
        [(a, t, p, f"P{i:03d}", f"name{i}", f"S{i % 2}", f"{t} {i}", f"why {i}") for a, t, p in kinds for i in range(5)],
        "source_agent string, recommendation_type string, priority string, product_id string, product_name string, store_id string, action string, reason string",
    )
    others = others.withColumns({"status": F.lit("pending"), "alternative_product_id": F.lit(""), "alternative_store_id": F.lit("")})
    places = published(rc.standardized(align_to_schema(others, RECOMMENDATIONS)))
    factors = [published(df) for df in tr.numbered_factors(low, cand)]
    return places, *factors, published(rc.with_ids(places, *factors, agent=AGENT))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_digest_counts_and_texts_equal_those_of_all_records(spark, run):
    places, low, best, every = run
    assert every.count() > 100_000
    digest = rc.record_digest(places, low, best, AGENT)
    assert digest.count() < 30_000  # best rows of each priority come from a few low rows
    counts = spark.createDataFrame([("low_stock_items", 3)], "dataset string, row_count long")
    health = spark.createDataFrame([("fine",)], "health_label string")
    for f in (
        lambda r: rc.agent_outputs(r, counts), lambda r: rc.orchestrator_summary(r, counts, health), cx.agent_top3, cx.top_opportunity,
        me.recommendation_cards, me.latest_recommendations, lambda r: me.distinct_options(r, "product_name"), lambda r: cx.agent_top3(r, 10),
    ):
        assert rows_of(f(digest)) == rows_of(f(every))


def test_named_records_are_found_without_the_others(spark, run):
    places, low, best, every = run
    ids = every.select("recommendation_id").filter(F.xxhash64("recommendation_id") % 50 == 0)
    odd = spark.createDataFrame([("REC000001",), ("REC99999999",), ("REC00000",), ("none",), (None,), ("REC00001",), ("REC00001",)], "recommendation_id string")
    ids = published(ids.unionByName(odd))
    got = rc.named_records(ids, places, low, best, AGENT)
    want = rows_of(every.join(ids, "recommendation_id", "left_semi").select(*got.columns))
    assert len(want) > 1000 and rows_of(got) == want


def test_records_of_a_store(spark, run):
    places, low, best, every = run
    got = rc.of_store("S1", places, low, best, AGENT)
    assert rows_of(got) == rows_of(sv.recommendations_for_store(every, "S1").select(*got.columns))


def test_numbered_records_are_written_once(spark):
    rows = [("transfer", f"P{i % 7}", f"S{i % 3}") for i in range(50)] + [("discount", None, "S1"), ("stockout_prevention_alert", "P1", "S1")] * 2
    records = align_to_schema(spark.createDataFrame(rows, "recommendation_type string, product_id string, store_id string").repartition(5), RECOMMENDATIONS)
    placed = rc.with_places(records)
    assert placed.inputFiles()  # a table whose scans read the asked columns, where a checkpoint has none
    got = sorted((r.place, rc.TYPE_ORDER.index(r.recommendation_type), r.product_id or "", r.store_id, r.after) for r in placed.collect())
    assert [r[0] for r in got] == list(range(1, 55))
    assert [r[1:4] for r in got] == sorted(r[1:4] for r in got)
    assert all(r[4] == (r[1] > rc.TYPE_ORDER.index("alternative_option")) for r in got)


def test_factors_make_the_low_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(name):
        seen.add(1)
        return name

    cand = spark.createDataFrame([(f"P{i}", "S0", f"n{i}", "s0", "AB"[i % 2], False, i) for i in range(8)],
        "product_id string, store_id string, product_name string, store_name string, category string, is_exclusive boolean, available_quantity long")
    low = spark.createDataFrame([("P1", "n1", "S0", "s0", "B"), ("P3", "n3", "S0", "s0", "B"), ("P9", "n9", "S0", "s0", None)], "product_id string, product_name string, store_id string, store_name string, category string")
    low, best = tr.numbered_factors(low.withColumn("product_name", F.udf(count, "string")("product_name")), cand)
    before = seen.value
    assert sorted((r.product_id, r.low_blocks) for r in best.collect()) == [("P1", 1), ("P3", 1), ("P5", 1), ("P7", 1)]
    assert seen.value == before
    assert sorted((r.low_product_id, r.pairs, r.before) for r in low.collect()) == [("P1", 3, 0), ("P3", 3, 3)]


def test_rows_of_ids_reach_all_records_without_a_join_by_id(spark, run):
    places, low, best, every = run
    decided = every.select("recommendation_id").filter(F.xxhash64("recommendation_id") % 50 == 0)
    odd = spark.createDataFrame([("REC000001",), ("REC99999999",), ("REC00000",), ("none",), (None,)], "recommendation_id string")
    events = published(decided.unionByName(odd)).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    text = F.when(F.col("n") == 2, F.concat(F.lit("d"), F.col("recommendation_id"))).otherwise("old")
    events = events.select("recommendation_id", F.col("n").alias("decided_at"), text.alias("decision"))
    whole = lambda rows: rc.joined_records(rows, places, low, best, AGENT)
    got = me.apply_latest_decisions(every, events, "decision", whole)
    want = me.apply_latest_decisions(every, events, "decision")
    columns = [c for c in want.columns if c in ("recommendation_id", "recommendation_type", "product_id", "store_id", "priority", "status", "alternative_product_id")]
    assert rows_of(got.select(*columns)) == rows_of(want.select(*columns))
    assert want.filter("status LIKE 'dREC%'").count() > 1000 and want.filter("status = 'pending'").count() > 100_000
    joins_by_id = lambda df: "Join [recommendation_id" in df.select(*columns)._jdf.queryExecution().executedPlan().toString()
    assert joins_by_id(want) and not joins_by_id(got)


def test_search_finds_alternatives_by_their_factors(spark, run, monkeypatch):
    k = 3
    places, low, best, every = run
    texts = ["offer name5 for store0", "P001 low", "exclusively available name90 at store1", "REC00030 rec100007 REC99999 medium", "clearance why 3", "P100 P105 high S0", "name0", "rec0000 none"]
    questions = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "question_id long, question string")
    want = rows_of(rt.keyword_search(questions, rs.record_documents(every, 6), k))
    assert len(want) == k * (len(texts) - 1) and any("alternative" not in r for r in want)
    numbered = rs.record_documents(rc.without_alternatives(places, low), 6)
    alternatives = rs.alternative_profiles(rt.asked_words(questions), low, best, rc.before_alternatives(places), k, 6, AGENT)
    assert alternatives.count() < 20_000
    for often in (1, 1_000_000):  # common words only save work
        monkeypatch.setattr(rt, "COMMON", often)
        assert rows_of(rt.keyword_search(questions, numbered, k, more=alternatives)) == want


def test_ids_rank_as_texts_without_a_sort(spark):
    for total in (1, 9, 10, 99, 100, 1234, 100_000):
        ids = [f"{i:02d}" for i in range(1, total + 1)]
        got = spark.range(1, total + 1).select("id", text_rank(F.col("id"), total, 2).alias("n")).collect()
        ranks = {text: n for n, text in enumerate(sorted(ids), 1)}
        assert all(r.n == ranks[f"{r.id:02d}"] for r in got)
    large = spark.range(1).select(*[text_rank(F.lit(n), 10**12, 5).alias(f"n{n}") for n in (1, 10**12)]).first()
    assert tuple(large) == (1, len(set(range(5, 14))) + 9999)


def test_memory_of_records_by_their_factors(spark, run):
    places, low, best, every = run
    n = every.count()
    number = rc.id_rank(places, low)
    want = me.recommendation_memory_rows(every, every.limit(0), "2001-11-05 08:00:00")
    got = me.recommendation_memory_rows(every, every.limit(0), "2001-11-05 08:00:00", number)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and n == want.count()
    named = every.filter(F.xxhash64("recommendation_id") % 50 == 0).select("recommendation_id")
    decided = named.select(F.concat(F.lit("MEM"), "recommendation_id").alias("memory_id"), "recommendation_id", F.lit("2001-11-06").cast("timestamp").alias("recorded_at"),
                           F.lit("approved").alias("decision"))
    outcomes = decided.filter(F.xxhash64("recommendation_id") % 100 == 0).drop("decision").withColumns(
        {"action_taken": F.lit("applied"), "outcome_status": F.lit("worked"), "outcome_note": F.lit("")})

    def joined(rows):
        return me.recommendation_memory_rows(rc.joined_records(rows, places, low, best, AGENT), every.limit(0), "2001-11-05 08:00:00", number, rows.columns[1:])

    columns = ["memory_id", "recommendation_id", "product_id", "decision", "action_taken", "outcome_status", "decision_recorded_at"]
    whole, feedback = me.feedback_rows(want, decided, outcomes).select(*columns), me.feedback_rows(got, decided, outcomes, joined).select(*columns)
    assert feedback.exceptAll(whole).count() == 0 and whole.exceptAll(feedback).count() == 0
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    by_id = re.compile(r"Join \[recommendation_id[^\n]*LeftOuter")
    assert by_id.search(plan(whole)) and not by_id.search(plan(feedback))


def test_memory_counts_and_store_counts_of_digests(spark, run):
    places, low, best, every = run
    digest = rc.record_digest(places, low, best, AGENT)
    detail = every.limit(0).select("recommendation_id", *me.MEMORY_KEYS)
    none = detail.select(F.lit("").alias("memory_id"), F.lit(None).cast("timestamp").alias("recorded_at"), *me.MEMORY_KEYS, *[F.lit("").alias(c) for c in ("decision", "outcome_status", "outcome_note")])
    assert rows_of(me.memory_context(digest, none, none)) == rows_of(me.memory_context(every, none, none))
    assert me.system_memory_summary(digest, none, none).first() == me.system_memory_summary(every, none, none).first()
    view = spark.createDataFrame([(s, f"store{s}", "P1", "one", "Low Stock", "High", 1, 1, 1) for s in ("S0", "S1", "S2")],
        "store_id string, store_name string, product_id string, product_name string, stock_status string, priority string, shortage_quantity long, surplus_quantity long, current_quantity long")
    assert rows_of(sv.store_texts(view, rc.store_digest(places, low, best))) == rows_of(sv.store_texts(view, every))


def test_overlay_reaches_all_records_without_a_join_by_id(spark, run):
    places, low, best, every = run
    ids = every.select("recommendation_id").filter(F.xxhash64("recommendation_id") % 50 == 0)
    kind = F.pmod(F.xxhash64("recommendation_id", F.lit(1)), F.lit(4))
    review = ids.select("recommendation_id", (kind != 0).alias("keep_recommendation"), F.when(kind == 1, "hold").when(kind == 2, "clearance").alias("selected_strategy"),
                        F.when(kind == 3, "low").alias("priority"), *[F.lit(None).cast("string").alias(c) for c in ("action", "reason", "evidence")])
    review = published(review)
    columns = ["recommendation_id", "recommendation_type", "product_id", "store_id", "priority", "action", "reason"]
    want = rc.decision_overlay(every, review).select(*columns)
    got = rc.decision_overlay(every, review, joined_with=lambda rows: rc.joined_records(rows, places, low, best, AGENT)).select(*columns)
    assert 100_000 < want.count() < every.count() and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert "Join [recommendation_id" not in got._jdf.queryExecution().executedPlan().toString()
