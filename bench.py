"""Time the headline queries on one local session and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stockloom.operators import recommend as rc  # noqa: E402
from stockloom.plans import catalog  # noqa: E402
from stockloom.plans.workspace import Run, Workspace  # noqa: E402
from stockloom.session import local_session  # noqa: E402
from stockloom.sources.star import StarTables  # noqa: E402

HEADLINE = [
    "sales_summary",
    "current_inventory",
    "low_stock_items",
    "inventory_analysis",
    "high_demand_items",
    "low_stock_alerts",
    "store_inventory_view",
    "category_summary_by_store",
    "transfer_opportunities",
    "exclusive_items",
    "alternative_products",
    "alternative_availability",
    "rec_discount",
    "overview_metrics",
    "branch_comparison",
    "inventory_sales_comparison",
    "apply_orders",
    "apply_price_actions",
    "apply_transfers",
    "hash_embeddings",
    "vector_search",
    "classify_questions",
    "conversation_window",
    "stream_sales_trend_daily",
]


def drain(df) -> None:
    """Compute every row and column without bringing them to the driver."""
    df.write.mode("overwrite").format("noop").save()


def agent_run(spark, sf_dir: str) -> None:
    """A whole agent run on tables published afresh: datasets, analyzers, recommendations, summaries."""
    run = Run(StarTables(spark, sf_dir))
    drain(run.agent_recommendations)
    drain(rc.agent_outputs(run.agent_recommendations, run.analyzer_counts))
    drain(rc.orchestrator_summary(run.agent_recommendations, run.analyzer_counts, run.health))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    catalog.load_all()
    drain(Workspace.from_star(spark, sf_dir).sales)  # warm the session and the file cache
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        drain(catalog.run(name, spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    start = time.perf_counter()
    agent_run(spark, sf_dir)
    seconds["agent_run"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "retail_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
