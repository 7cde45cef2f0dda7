"""Moves of stock by connected groups of stores, against the serial walk, and components against a plain search."""

import random

from pyspark.sql import functions as F

from stockloom.operators import actions as ac, graphs

MOVES = "product_id string, source_store_id string, target_store_id string, quantity long, seq long"


def _walk(moves, stock):
    now, accepted = dict(stock), {}
    for product, src, tgt, quantity, seq in sorted(moves, key=lambda m: m[4]):
        ok = src is None or now.get((product, src), -1) >= quantity
        if ok:
            if src is not None:
                now[product, src] -= quantity
            now[product, tgt] = now.get((product, tgt), 0) + quantity
        accepted[seq] = ok
    return accepted


def test_a_hot_product_is_walked_by_groups_of_stores(spark):
    random.seed(3)
    stores = [f"S{k}" for k in range(1000)]
    stock = {("P1", s): random.randrange(0, 30) for s in stores[:-20]} | {("P2", s): 10**6 for s in stores[:5]}
    moves = []
    for seq in range(20_000):
        group = random.randrange(100)
        a, b = random.sample(range(10), 2)
        src = None if seq % 9 == 0 else f"S{group * 10 + a}"
        moves.append(("P1", src, f"S{group * 10 + b}", random.randrange(1, 20), seq))
    moves += [("P2", "S1", f"S{k % 3 + 2}", 1, 20_000 + k) for k in range(50)]
    inventory = spark.createDataFrame([(*k, q) for k, q in stock.items()], "product_id string, store_id string, stock_level long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the data are tiny
    done = ac.applied_moves(spark.createDataFrame(moves, MOVES).repartition(5), inventory, ["seq"])
    rows = done.select("seq", "accepted", "available", F.spark_partition_id().alias("task")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.seq: r.accepted for r in rows} == _walk(moves, stock)
    # several tasks share the product
    assert len({r.task for r in rows if r.seq < 20_000}) > 2


def test_a_chain_of_stores_is_one_group(spark):
    moves = [("P1", f"S{k:04}", f"S{k + 1:04}", 1, k) for k in range(300)]
    inventory = spark.createDataFrame([("P1", "S0000", 1)], "product_id string, store_id string, stock_level long")
    done = ac.applied_moves(spark.createDataFrame(moves, MOVES).repartition(3), inventory, ["seq"], split=100).collect()
    assert all(r.accepted for r in done) and len(done) == 300  # the one unit travels down the chain
    backwards = [(p, a, b, q, 300 - s) for p, a, b, q, s in moves]
    done = ac.applied_moves(spark.createDataFrame(backwards, MOVES), inventory, ["seq"], split=100).collect()
    assert [r.seq for r in done if r.accepted] == [300]


def test_components_of_many_graphs(spark):
    random.seed(4)
    edges = [(f"g{random.randrange(3)}", f"n{random.randrange(60):02}", f"n{random.randrange(60):02}") for _ in range(80)]
    edges += [("chain", f"n{k:03}", f"n{k + 1:03}") for k in range(100)] + [("chain", "z", "z")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for space, a, b in edges:
        x, y = find((space, a)), find((space, b))
        root[max(x, y)] = min(x, y)
    got = graphs.components(spark.createDataFrame(edges, "space string, a string, b string")).collect()
    assert {(r.space, r.node): r.component for r in got} == {k: find(k)[1] for k in root}
    assert graphs.components(spark.createDataFrame([], "space string, a string, b string")).collect() == []
