"""Registered queries against their SQL checks at the smallest scale.

A choice over all areas runs by default; STOCKLOOM_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry_module
from compare import compare, connect

SF = "/root/testdata/sf0.001"
CHOICE = """validate_table records_export table_health analyzer_counts inventory_from_transactions sales_summary
 product_performance low_stock_items high_demand_items inventory_analysis low_stock_alerts store_inventory_view
 category_summary_by_store transfer_opportunities exclusive_items alternative_products top_alternative_products alternative_availability
 overview_metrics sales_insights build_recommendations procurement_recs_with_memory memory_context learning_insights
 recommendation_context agent_cards executive_summary apply_orders apply_price_actions apply_transfers
 inventory_after_transfers approve_batch approve_batch_inventory approve_batch_ledger approve_batch_decisions
 approve_batch_outcomes approve_batch_current_inventory approve_batch_low_stock question_table new_alerts top_sold_by_store link_stores link_products classify_questions hash_embeddings
 vector_search rerank_documents conversation_window stream_sales_velocity stream_apply_orders stream_ledger""".split()

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
NAMES = list(QUERIES) if os.environ.get("STOCKLOOM_ALL") else CHOICE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, QUERIES[name], ORACLES[name], SF) == ""
    else:
        assert QUERIES[name](spark, SF).count() >= 0


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() == 924


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
