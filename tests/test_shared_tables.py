"""Tables that are made once, and windows of very many keys."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from stockloom.operators import actions as ac, datasets as ds, recommend as rc
from stockloom.plans.workspace import Workspace
from stockloom.sources.star import StarTables
from stockloom.streaming import jobs

LINES = """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string,
 l_linestatus string, l_shipdate timestamp"""


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _star(spark, folder):
    day = dt.datetime(1998, 1, 2)
    # order 1 twice, customer 7 twice and with a null nation, a line without an order, an order without a customer
    line = lambda o, p, n, q: (o, p, 1, n, q, 10.0 * q, "N", "O", day)
    spark.createDataFrame([line(1, 10, 1, 2.0), line(1, 10, 1, 2.0), line(2, 20, 1, 3.0), line(2, None, 2, 4.0), line(9, 10, 1, 5.0), line(3, 10, 1, 6.0)], LINES).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (1, 7), (2, 8), (3, 99), (4, None)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(7, 3), (7, None), (8, 4)], "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    return StarTables(spark, folder)


def test_lines_meet_their_stores_once_for_all_tables(spark, tmp_path):
    star = _star(spark, str(tmp_path))
    lines = star.parquet("lineitem").join(star.parquet("orders"), F.expr("l_orderkey = o_orderkey")).join(star.parquet("customer"), F.expr("o_custkey = c_custkey"))
    want = sorted(map(str, lines.select("l_orderkey", "l_partkey", "c_nationkey", "l_quantity").collect()))
    assert sorted(map(str, star.order_lines.select("l_orderkey", "l_partkey", "c_nationkey", "l_quantity").collect())) == want
    assert len(want) == 10
    for table in (star.sales, star.transactions, star.order_requests, star.inventory):
        assert "Join" not in _plan(table)
    assert sorted((r.product_id, r.store_id) for r in star.inventory.filter("product_id IS NOT NULL AND store_id IS NOT NULL").collect()) == [("P10", "S3"), ("P20", "S4")]
    again = StarTables(spark, str(tmp_path))
    assert again.order_lines.inputFiles() == star.order_lines.inputFiles()
    spark.createDataFrame([(9, 8)], "o_orderkey long, o_custkey long").write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert StarTables(spark, str(tmp_path)).order_lines.count() == 11  # a changed source is read again


def test_sales_are_not_shuffled_by_store(spark):
    day = dt.date(2024, 1, 1)
    sales = spark.createDataFrame(
        [("P1", "S1", day, 2, 1.0), ("P1", "S1", day, 3, 1.0), ("P2", "S1", day, None, 1.0), ("P2", "S2", day, 4, None), (None, "S1", day, 9, 1.0)],
        "product_id string, store_id string, date date, quantity_sold long, selling_price double",
    )
    out = ds.sales_summary(sales)
    rows = {(r.product_id, r.store_id): (r.total_quantity_sold, r.product_total_quantity_sold, r.store_total_quantity_sold) for r in out.collect()}
    assert rows == {("P1", "S1"): (5, 5, 5), ("P2", "S1"): (0, 4, 5), ("P2", "S2"): (4, 4, 4)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in ds.sales_summary(sales)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_requests_are_checked_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(quantity):
        seen.add(1)
        return quantity

    rows = [("P1", "S1", 1, 4, 5, "ok"), ("P1", "S1", 2, 4, 5, "ok"), ("P2", "S1", 1, 1, 5, "ok"), ("P3", "S1", 1, 1, None, "not_in_store")]
    checked = spark.createDataFrame(rows, "product_id string, store_id string, seq long, quantity long, available_quantity long, check_code string")
    checked = checked.withColumn("quantity", F.udf(count, "long")("quantity"))
    out = ac.applied_orders(checked, ["seq"])
    got = {(r.product_id, r.seq): (r.accepted, r.remaining_stock, r.check_code) for r in out.collect()}
    assert got == {("P1", 1): (True, 1, "ok"), ("P1", 2): (False, 1, "insufficient_stock"), ("P2", 1): (True, 4, "ok"), ("P3", 1): (False, None, "not_in_store")}
    assert seen.value == len(rows)


def test_velocity_windows_over_batches_late_rows_and_a_restart(spark, tmp_path):
    folder, base = str(tmp_path / "in.parquet"), str(tmp_path / "out")
    sent = []

    def arrive(*rows):
        for day, key, quantity in rows:
            sent.append((day, key, quantity))
            ts = dt.datetime(2024, 1, day, 12) if day else None
            spark.createDataFrame([(ts, key, quantity)], "ts timestamp, k string, quantity long").coalesce(1).write.mode("append").parquet(folder)
        for i, name in enumerate(sorted((f for f in os.listdir(folder) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{folder}/{f}"))):
            os.utime(f"{folder}/{name}", (1_700_000_000 + 100 * i,) * 2)

    def run():
        out = jobs.run_velocity(jobs.stream_table(spark, str(tmp_path), "in", files_per_trigger=1), ["k"], 7, base)
        return sorted((str(r.window_start)[:10], str(r.window_end)[:10], r.k or "", r.quantity, r.row_count, r.daily_velocity) for r in out.collect())

    def want():
        first = dt.date(2024, 1, 1)
        totals = {}
        for day, key, quantity in sent:
            for s in range(day - 7, day) if day else ():
                old = totals.get((s, key or ""), (0, 0))
                totals[s, key or ""] = (old[0] + (quantity or 0), old[1] + 1)
        at = lambda n: str(first + dt.timedelta(days=n))
        return sorted((at(s), at(s + 7), k, q, n, q / 7.0) for (s, k), (q, n) in totals.items())

    arrive((1, "a", 1), (10, "a", 2), (12, "a", 4), (12, "b", 8), (12, None, 16), (None, "a", 32), (12, "a", None))
    assert run() == want()
    assert run() == want()  # nothing new
    arrive((28, "a", 64), (2, "a", 128), (11, "b", 256))  # two rows weeks late
    assert run() == want()


BASE = """product_id string, store_id string, product_name string, stock_level long, effective_reorder_threshold long, recent_daily_sales_velocity double,
 days_of_stock_remaining double"""


def test_discounts_make_the_base_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(stock):
        seen.add(1)
        return stock

    # slow and overstocked, overstocked only, neither, slow only, no velocity
    rows = [("P1", "S1", "a", 90, 10, 0.5, 180.0), ("P2", "S1", "b", 900, 10, 9.0, 100.0), ("P3", "S1", "c", 5, 10, 8.0, 0.6), ("P4", "S1", "d", 5, 10, 0.1, 20.0), ("P5", "S1", "e", 5, 10, 0.0, None)]
    ws = Workspace(None)
    ws.base = spark.createDataFrame(rows, BASE).withColumn("stock_level", F.udf(count, "long")("stock_level"))
    got = sorted((r.product_id, r.product_name, r.evidence != "") for r in ws.records("discount").collect())
    assert got == [("P1", "a", True), ("P2", "b", True)]
    assert seen.value == len(rows)


def test_a_slow_row_with_short_cover_bars_its_pair(spark):
    schema = "product_id string, store_id string, product_name string, days_of_stock_remaining double, evidence string"
    slow = spark.createDataFrame([("P1", "S1", "a", 1.0, "slow"), ("P2", "S1", "b", 900.0, "slow"), ("P3", None, "c", None, "slow"), ("P5", "S1", None, 900.0, None)], schema)
    over = spark.createDataFrame([(p, s, "o", 900.0, "over") for p, s in (("P1", "S1"), ("P2", "S1"), ("P3", None), ("P4", "S1"), ("P5", "S1"), (None, "S1"))] + [("P6", "S1", "o", 1.0, "over")], schema)
    got = sorted((r.product_id, r.product_name, r.evidence) for r in rc.discount(slow, over).collect())
    assert got == [("", "o", "over"), ("P2", "b", "slow"), ("P4", "o", "over"), ("P5", "", None)]


def test_products_find_their_supplier_once(spark, tmp_path):
    star = _star(spark, str(tmp_path))
    part = [(10, "bolt", "Brand#1", 10.5, 3), (20, "nut", "Brand#2", 2.0, None), (30, None, "Brand#1", 1.0, 4), (10, "bolt", "Brand#1", 10.5, 3)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert "Join" not in _plan(star.products)
    got = sorted((r.product_id, r.product_name or "", r.supplier_id or "") for r in star.products.collect())
    assert got == [("P10", "bolt 10", "SUP1"), ("P10", "bolt 10", "SUP1"), ("P20", "nut 20", "SUP1"), ("P30", "", "")]
    assert StarTables(spark, str(tmp_path)).products.inputFiles() == star.products.inputFiles()
