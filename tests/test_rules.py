"""Edge rules on tiny hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockloom import schemas as sc
from stockloom.config import AnalyzerConfig, overlay
from stockloom.functions import exprs as ex, text as tx
from stockloom.functions.ids import next_prefixed_ids, sequential_ids
from stockloom.operators import actions as ac, analyzers as an, datasets as ds, memory as me, recommend as rc, stock_views as sv, transfers as tr
from stockloom.sources import sinks, tables

D = dt.date


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def values(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


TXN = "date date, transaction_type string, product_id string, store_id string, quantity long"


def test_ledger_without_snapshot_counts_every_movement(spark):
    txn = frame(spark, TXN, (D(2024, 1, 1), "purchase", "P1", "S1", 10), (D(2024, 1, 2), "sale", "P1", "S1", 4),
                (D(2024, 1, 3), "procurement", "P1", "S1", 99))
    assert values(ds.inventory_from_transactions(txn)) == [("P1", "S1", 6, D(2024, 1, 3))]


def test_ledger_with_snapshot_only_keeps_its_date(spark):
    txn = frame(spark, TXN, (D(2024, 1, 1), "sale", "P9", "S1", 5), (D(2024, 1, 2), "inventory_snapshot", "P1", "S1", 7))
    assert values(ds.inventory_from_transactions(txn)) == [("P1", "S1", 7, D(2024, 1, 2))]


def test_ledger_joins_snapshot_and_later_rows(spark):
    txn = frame(spark, TXN, (D(2024, 1, 1), "inventory_snapshot", "P0", "S1", 50), (D(2024, 1, 2), "inventory_snapshot", "P1", "S1", 7),
                (D(2024, 1, 2), "sale", "P1", "S1", 3), (D(2024, 1, 3), "sale", "P2", "S1", 3))
    assert values(ds.inventory_from_transactions(txn), "product_id", "stock_level") == [("P1", 7), ("P2", -3)]


def test_snapshot_flag(spark):
    inv = frame(spark, "last_updated date", (D(2024, 1, 5),))
    flag = lambda i, t: ds.snapshot_is_current(i, t).first()[0]
    assert flag(inv, frame(spark, "date date", (D(2024, 1, 5),))) is True
    assert flag(inv, frame(spark, "date date", (D(2024, 1, 6),))) is False
    assert flag(inv, frame(spark, "date date", (None,))) is True
    assert flag(inv.limit(0), frame(spark, "date date", (D(2024, 1, 5),))) is False


def test_sales_windows_include_both_ends(spark):
    sales = frame(spark, "sale_id string, date date, product_id string, store_id string, quantity_sold long, selling_price decimal(12,2)",
                  ("A", D(2024, 1, 31), "P", "S", 1, None), ("B", D(2024, 1, 24), "P", "S", 2, None), ("C", D(2024, 1, 23), "P", "S", 4, None),
                  ("D", D(2024, 1, 1), "P", "S", 8, None), ("E", None, "P", "S", 16, None))
    row = ds.sales_summary(sales).first()
    assert (row.recent_7_day_quantity_sold, row.recent_30_day_quantity_sold, row.total_quantity_sold) == (3, 15, 31)


def test_store_capacity_zero(spark):
    stores = frame(spark, sc.STORES, ("S1", "A", "C", 0), ("S2", "B", "C", 10))
    inv = frame(spark, "store_id string, stock_level long", ("S1", 5), ("S2", 15))
    assert values(ds.store_inventory_summary(inv, stores), "store_id", "remaining_capacity", "capacity_used_percent") == [
        ("S1", -5, 0.0), ("S2", -5, 150.0)]


def base(spark, *rows):
    inv = frame(spark, "product_id string, store_id string, stock_level long, inventory_reorder_threshold long, reorder_threshold long, shelf_life_days long",
                *[(r[0], "S1", r[1], r[2], r[3], 10) for r in rows])
    summary = frame(spark, "product_id string, store_id string, total_quantity_sold long, recent_7_day_quantity_sold long, recent_30_day_quantity_sold long",
                    *[(r[0], "S1", 1, r[4], r[5]) for r in rows])
    return an.analysis_base(inv, summary)


def test_velocity_falls_back_to_30_days(spark):
    b = base(spark, ("P1", 10, 20, 5, 15, 20), ("P2", 24, 0, 5, 0, 72), ("P3", 9, 0, 0, 0, 0))
    assert values(b, "product_id", "effective_reorder_threshold", "recent_daily_sales_velocity", "days_of_stock_remaining") == [
        ("P1", 20, 15 / 7, 10 / (15 / 7)), ("P2", 5, 2.4, 10.0), ("P3", 0, 0.0, 0.0)]
    assert values(an.low_stock_items(b), "product_id") == [("P1",)]
    assert values(an.low_stock_items(b, overlay(AnalyzerConfig(), low_stock_buffer_percent=400)), "product_id") == [("P1",), ("P2",)]


def test_no_velocity_means_no_high_demand_but_slow_rows(spark):
    b = base(spark, ("P1", 10, 20, 5, 0, 0), ("P2", 0, 20, 5, 0, 0))
    assert an.high_demand_items(b).count() == 0
    assert values(an.slow_moving_items(b), "product_id") == [("P1",)]


def test_counts_equal_flags(spark):
    b = base(spark, ("P1", 10, 20, 5, 15, 20), ("P2", 24, 0, 5, 0, 72), ("P3", 900, 1, 0, 1, 2))
    counts = dict(values(an.analyzer_counts(b)))
    tagged = {r[0]: r[1] for r in an.inventory_analysis(b).groupBy("dataset").count().collect()}
    assert {k: v for k, v in counts.items() if v} == tagged


@pytest.mark.parametrize("qty,thr,v,want", [(1, 15, 2.4667, 49), (1, 15, 0.0, 29), (40, 15, 0.1, 0), (0, 0, 0.5, 7)])
def test_suggested_reorder(spark, qty, thr, v, want):
    df = frame(spark, "q long, t long, v double", (qty, thr, v))
    assert df.select(ex.suggested_reorder("q", "t", "v")).first()[0] == want


@pytest.mark.parametrize("qty,thr,want", [(0, 9, "High"), (3, 0, "Medium"), (5, 10, "High"), (6, 10, "Medium"), (10, 10, "Low"), (3, -1, "Medium")])
def test_shortage_priority(spark, qty, thr, want):
    assert frame(spark, "q long, t long", (qty, thr)).select(ex.shortage_priority("q", "t")).first()[0] == want


def test_parse_evidence_last_key_wins(spark):
    df = frame(spark, "e string", ("a=1, b = 2=3 , nothing, a=4",), (None,))
    assert [r[0] for r in df.select(ex.parse_evidence("e")).collect()] == [{"a": "4", "b": "2=3"}, {}]


def test_discounts_round_half_even_on_cents(spark):
    df = frame(spark, "c long, d double", (5, 50.0), (15, 50.0), (1000, 12.5))
    df = df.select((F.col("c") / 100).cast("decimal(12,2)").alias("p"), "d")
    assert [r[0] for r in df.select(ex.discounted("p", "d")).collect()] == [0.02, 0.08, 8.75]


def test_supplier_missing_is_risky_only_in_alerts(spark):
    perf = frame(spark, "product_id string, product_name string, supplier_id string", ("P1", "A", "SX"), ("P2", "B", "S1"))
    sup = frame(spark, sc.SUPPLIERS, ("S1", "Good", 2, 0.99))
    assert values(rc.supplier_risk(perf, sup), "product_id", "priority") == [("P1", "high")]
    assert values(rc.supplier_context(perf, sup), "product_id", "supplier_is_risky") == [("P1", False), ("P2", False)]


def test_transfers_do_not_decrement_the_source(spark):
    inv = frame(spark, "product_id string, store_id string, store_name string, stock_level long, inventory_reorder_threshold long, reorder_threshold long",
                ("P", "S1", "a", 20, 10, 0), ("P", "S2", "b", 4, 10, 0), ("P", "S3", "c", 1, 10, 0), ("P", "S4", "d", 20, 10, 0))
    low = frame(spark, "product_id string, product_name string, store_id string, store_name string, stock_level long, effective_reorder_threshold long",
                ("P", "x", "S2", "b", 4, 10), ("P", "x", "S3", "c", 1, 10))
    out = values(rc.transfer(inv, low), "store_id", "suggested_quantity", "action")
    assert out == [("S2", 5, "Transfer 5 units from S1 to S2."), ("S3", 5, "Transfer 5 units from S1 to S3.")]


def test_alternatives_equal_brute_force(spark):
    import itertools
    rows = [(f"P{i}", f"S{j}", f"name{i}", f"store{j}", "AB"[i % 2], i == 7, (i * 7 + j * 5) % 11 + 1) for i, j in itertools.product(range(12), range(4))]
    cand = frame(spark, "product_id string, store_id string, product_name string, store_name string, category string, is_exclusive boolean, available_quantity long", *rows)
    low_rows = [(f"P{i}", f"name{i}", "S0", "store0", "AB"[i % 2]) for i in range(12)]
    low = frame(spark, "product_id string, product_name string, store_id string, store_name string, category string", *low_rows)
    for one in (False, True):
        got = tr.top_alternative_products(low, cand, top_n=4, one_per_product=one)
        want = []
        for p, _, s, _, c in low_rows:
            ranked = sorted((r for r in rows if r[4] == c and r[0] != p), key=lambda r: (not r[5], -r[6], r[2], r[1]))
            seen, kept = set(), []
            for r in ranked:
                if one and r[0] in seen:
                    continue
                seen.add(r[0])
                kept.append(r)
            want += [(p, r[0], r[1]) for r in kept[:4]]
        assert values(got, "low_stock_product_id", "alternative_product_id", "alternative_store_id") == sorted(want)


    pairs = [(p, r[0], r[1], r[5]) for p, _, _, _, c in low_rows for r in rows if r[4] == c and r[0] != p]
    assert values(tr.alternative_pairs(low, cand), "low_product_id", "product_id", "store_id", "is_exclusive") == sorted(pairs)
    totals = values(tr.alternative_products(low, cand), "low_stock_product_id", "alternative_total", "exclusive_total", "alternative_product_total")
    assert totals == sorted((p, sum(x[0] == p for x in pairs), sum(x[0] == p and x[3] for x in pairs), len({x[1] for x in pairs if x[0] == p})) for p, *_ in low_rows)


def test_all_alternatives_are_recorded_once_per_product(spark):
    cand = frame(spark, "product_id string, store_id string, product_name string, store_name string, category string, is_exclusive boolean, available_quantity long",
                 *((f"P{p}", f"S{s}", f"name{p}", f"store{s}", "A", False, 10 * p + s) for p in range(9) for s in range(3)))
    low = frame(spark, "product_id string, product_name string, store_id string, store_name string, category string", ("P0", "name0", "S0", "store0", "A"), ("P1", "name1", "S1", "store1", "A"))
    got = values(rc.all_alternatives(low, cand), "product_id", "alternative_product_id", "alternative_store_id", "available_quantity", "priority")
    assert got == sorted((low_id, f"P{p}", "S2", 10 * p + 2, "medium") for low_id in ("P0", "P1") for p in range(9) if f"P{p}" != low_id)


def test_sequential_ids_are_dense_over_partitions(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k")).repartition(13)
    out = sequential_ids(df, ["k"], "X", 5, "row_id", start=7).orderBy("k").collect()
    assert [r.row_id for r in out] == [f"X{i:05d}" for i in range(8, 1008)]


def test_next_ids_skip_what_is_not_a_number(spark):
    old = frame(spark, "order_id string", ("ORD000041",), ("ORDx",), (None,))
    new = frame(spark, "n long", (2,), (1,))
    assert values(next_prefixed_ids(new, ["n"], old, "order_id", "ORD")) == [("ORD000042", 1), ("ORD000043", 2)]


def test_ineffective_reads_as_worked(spark):
    f = frame(spark, "memory_id string, recommendation_type string, product_id string, product_name string, store_id string, decision string, action_taken string, outcome_status string, outcome_note string",
              ("M1", "discount", "P", "n", "S", "approved", "", "Ineffective", ""), ("M2", "discount", "P", "n", "S", "approved", "", "poor", "x"), ("M3", "", "P", "n", "S", "", "", "", ""))
    out = values(me.learning_insights(f, "2024-01-01 00:00:00"), "insight_id", "learning_label", "insight")
    assert out == [("LEARN000001", "worked", "discount appears to have worked after action 'approved'."),
                   ("LEARN000002", "failed", "discount appears to have worked poorly after action 'approved'. Outcome note: x")]


def test_requested_limit_and_typos(spark):
    df = frame(spark, "q string", ("Top 3 seling items",), ("show 25 products",), ("top 0",), ("nothing",))
    t = tx.normalized("q")
    assert [tuple(r) for r in df.select(t, tx.requested_limit(t)).collect()] == [
        ("top 3 selling items", 3), ("show 25 products", 10), ("top 0", 1), ("nothing", 5)]


def test_validation_and_alignment(spark, tmp_path):
    path = str(tmp_path / "stores.csv")
    with open(path, "w") as f:
        f.write("store_id,capacity,store_name\nS1,12,One\nS2,many,Two\n")
    df = tables.read_table(spark, path, sc.STORES, "csv")
    assert values(df) == [("S1", "One", "", 12), ("S2", "Two", "", None)]
    with pytest.raises(ValueError, match="capacity=1"):
        tables.validate_table(df, ["store_id", "capacity"])
    with pytest.raises(ValueError, match="missing required columns"):
        tables.validate_table(df, ["nope"])
    assert tables.read_or_empty(spark, str(tmp_path / "none"), sc.STORES).count() == 0


def test_sinks(spark, tmp_path):
    df = frame(spark, "a double, d date", (float("nan"), D(2024, 1, 2)), (float("inf"), None), (1.5, None))
    assert sorted(r[0] for r in sinks.records_json(df).collect()) == ['{"a":1.5}', '{"d":"2024-01-02"}', "{}"]
    log = frame(spark, "alert_key string, timestamp timestamp", ("k", dt.datetime(2024, 1, 2)))
    for _ in range(2):
        sinks.append_log(log, str(tmp_path / "log"), sc.ALERT_LOG, "timestamp")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_empty_view_gives_zero_kpis(spark):
    columns = "product_id string, current_quantity long, recent_30_day_quantity_sold long, stock_status string"
    view = frame(spark, columns + ", estimated_inventory_value decimal(20,2)")
    assert tuple(sv.store_kpis(view).first()) == (0, 0, 0, 0, 0, 0.0)


def test_alert_signature_ignores_order(spark):
    cols = "product_id string, store_id string, current_quantity long, suggested_reorder_quantity long, priority string"
    rows = [("P1", "S1", 1, 2, "High"), ("P2", "S1", 3, 4, "Low")]
    one, two = frame(spark, cols, *rows), frame(spark, cols, *rows[::-1])
    assert values(ac.alert_signature(one)) == values(ac.alert_signature(two))
    assert values(ac.alert_signature(one.limit(1))) != values(ac.alert_signature(one))
    assert values(ac.alert_signature(one.limit(0))) == [(0, "")]
