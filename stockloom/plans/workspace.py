"""Named datasets over one set of raw tables, each built lazily once per workspace."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.operators import analyzers as an, datasets as ds, memory as me, recommend as rc, record_search as rs, stock_views as sv, transfers as tr
from stockloom.sources import tables as tb
from stockloom.sources.fingerprint import file_state
from stockloom.session import published
from stockloom.sources.star import StarTables


class Workspace:
    """`raw` is any object with products, stores, suppliers, inventory, sales and transactions."""

    def __init__(self, raw):
        self.raw = raw
        self._records: dict[str, DataFrame] = {}

    @classmethod
    def from_star(cls, spark: SparkSession, sf_dir: str) -> "Workspace":
        return cls(StarTables(spark, sf_dir))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name == "raw":
            raise AttributeError(name)
        return getattr(self.raw, name)

    @cached_property
    def run(self) -> "Run":
        """The same datasets for a whole agent run: shared inputs are written once and read back. A later
        query of the application reuses the run while the source files are unchanged."""
        return run_of(self.raw)

    @cached_property
    def current_inventory(self) -> DataFrame:
        r = self.raw
        return ds.current_inventory(r.inventory, r.products, r.stores, r.transactions)

    @cached_property
    def sales_summary(self) -> DataFrame:
        return ds.sales_summary(self.raw.sales)

    @cached_property
    def product_performance(self) -> DataFrame:
        r = self.raw
        return ds.product_performance(r.products, self.sales_summary, self.current_inventory, r.suppliers)

    @cached_property
    def store_inventory_summary(self) -> DataFrame:
        return ds.store_inventory_summary(self.current_inventory, self.raw.stores)

    @cached_property
    def base(self) -> DataFrame:
        return an.analysis_base(self.current_inventory, self.sales_summary)

    @cached_property
    def shared_base(self) -> DataFrame:
        """The base for operators that pass over it twice, for a cut-off and for the rows: written once."""
        return published(self.base)

    @cached_property
    def low_stock(self) -> DataFrame:
        return an.low_stock_items(self.base)

    @cached_property
    def stockout(self) -> DataFrame:
        return an.stockout_risk_items(self.base)

    @cached_property
    def overstock(self) -> DataFrame:
        return an.overstock_items(self.base)

    @cached_property
    def dead_stock(self) -> DataFrame:
        return an.dead_stock_candidates(self.base)

    @cached_property
    def high_demand(self) -> DataFrame:
        return an.high_demand_items(self.shared_base)

    @cached_property
    def slow_moving(self) -> DataFrame:
        return an.slow_moving_items(self.shared_base)

    @cached_property
    def low_stock_alerts(self) -> DataFrame:
        r = self.raw
        return sv.low_stock_alerts(r.inventory, r.products, r.stores, r.sales, r.suppliers)

    @cached_property
    def store_view(self) -> DataFrame:
        r = self.raw
        return sv.store_inventory_view(r.inventory, r.products, r.stores, r.suppliers, r.sales)

    @cached_property
    def transfer_analysis(self) -> DataFrame:
        r = self.raw
        return tr.transfer_analysis(r.inventory, r.sales, r.stores, r.products)

    @cached_property
    def opportunities(self) -> DataFrame:
        return tr.transfer_opportunities(self.transfer_analysis)

    @cached_property
    def exclusive_items(self) -> DataFrame:
        r = self.raw
        return tr.exclusive_items(r.inventory, r.products, r.stores)

    @cached_property
    def alternative_candidates(self) -> DataFrame:
        r = self.raw
        return tr.alternative_candidates(r.inventory, r.products, r.stores)

    @cached_property
    def surplus_stock(self) -> DataFrame:
        r = self.raw
        return tr.surplus_stock(r.inventory, r.products, r.stores)

    @cached_property
    def alternative_availability(self) -> DataFrame:
        r = self.raw
        return tr.alternative_availability(r.inventory, r.products, r.stores, self.low_stock_alerts)

    # --- recommendations ---

    def records(self, kind: str) -> DataFrame:
        """One generator's records."""
        if kind not in self._records:
            self._records[kind] = getattr(self, f"_make_{kind}")()
        return self._records[kind]

    def _make_reorder(self) -> DataFrame:
        return rc.reorder(self.low_stock)

    def _make_transfer(self) -> DataFrame:
        return rc.transfer(self.current_inventory, self.low_stock)

    def _make_exclusive_availability(self) -> DataFrame:
        return rc.exclusive(self.exclusive_items)

    def _make_alternative_option(self) -> DataFrame:
        return rc.all_alternatives(self.low_stock, self.alternative_candidates)

    def _make_discount(self) -> DataFrame:
        # Both sets come from the written base, which the slow rows need for their cut-off.
        return rc.discount(self.slow_moving, an.overstock_items(self.shared_base))

    def _make_clearance(self) -> DataFrame:
        return rc.clearance(self.dead_stock)

    def _make_supplier_risk_alert(self) -> DataFrame:
        return rc.supplier_risk(self.product_performance, self.raw.suppliers)

    def _make_overstock_alert(self) -> DataFrame:
        return rc.overstock_alert(self.overstock)

    def _make_stockout_prevention_alert(self) -> DataFrame:
        return rc.stockout_alert(self.stockout)

    @cached_property
    def alternative_factors(self) -> tuple[DataFrame, DataFrame]:
        """Low rows and products, whose pairs are the alternative records."""
        return tr.numbered_factors(self.low_stock, self.alternative_candidates)

    @cached_property
    def recommendations(self) -> DataFrame:
        kinds = [t for t in rc.TYPE_ORDER if t != "alternative_option"]
        return rc.with_ids(rc.with_places(rc.union_all([self.records(t) for t in kinds])), *self.alternative_factors)

    @cached_property
    def supplier_context(self) -> DataFrame:
        return rc.supplier_context(self.product_performance, self.raw.suppliers)

    @cached_property
    def procurement_records(self) -> DataFrame:
        return rc.procurement(self.low_stock, self.supplier_context)

    def agent_records(self, agent: str) -> DataFrame:
        if agent == "procurement_agent":
            return self.procurement_records
        return rc.tagged(rc.union_all([self.records(t) for t in rc.AGENT_TYPES[agent] if t != "alternative_option"]), agent)

    @cached_property
    def agent_places(self) -> DataFrame:
        """The numbered records of all agents but the alternatives."""
        return rc.standardized(rc.union_all([self.agent_records(a) for a in rc.AGENT_TYPES]))

    @cached_property
    def agent_recommendations(self) -> DataFrame:
        return rc.with_ids(self.agent_places, *self.alternative_factors, agent="transfer_agent")

    @cached_property
    def agent_digest(self) -> DataFrame:
        """All records of the agents for counts, first texts and best rows."""
        return rc.record_digest(self.agent_places, *self.alternative_factors, agent="transfer_agent")

    @cached_property
    def store_digest(self) -> DataFrame:
        """All records of the agents for counts by store."""
        return rc.store_digest(self.agent_places, *self.alternative_factors)

    def named_recommendations(self, ids: DataFrame) -> DataFrame:
        """The records of the agents that `ids` names."""
        return rc.named_records(ids, self.agent_places, *self.alternative_factors, agent="transfer_agent")

    def joined_recommendations(self, rows: DataFrame) -> DataFrame:
        """All records of the agents, left-joined with rows of one row per id."""
        return rc.joined_records(rows, self.agent_places, *self.alternative_factors, agent="transfer_agent")

    @cached_property
    def numbered_recommendations(self) -> DataFrame:
        """The records of the agents but the alternatives."""
        return rc.without_alternatives(self.agent_places, self.alternative_factors[0])

    def alternative_profiles(self, asked: DataFrame, k: int, order: int) -> DataFrame:
        """The alternatives that a search for the asked words can return."""
        return rs.alternative_profiles(asked, *self.alternative_factors, rc.before_alternatives(self.agent_places), k, order, agent="transfer_agent")

    def store_recommendations(self, store_id: str) -> DataFrame:
        return rc.of_store(store_id, self.agent_places, *self.alternative_factors, agent="transfer_agent")

    @cached_property
    def decisions(self) -> DataFrame:
        """The decision history; that of a star schema names records of the whole run."""
        if not isinstance(self.raw, StarTables):
            return self.raw.decisions
        run = self.run
        counts = run.agent_places.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("after")).alias("first"))
        one = lambda c: counts.select(c).scalar()
        return self.raw.decisions(one("first"), rc.alternative_total(run.alternative_factors[0]), one("n"))

    @cached_property
    def analyzer_counts(self) -> DataFrame:
        return an.analyzer_counts(self.shared_base)

    @cached_property
    def health(self) -> DataFrame:
        """Health over the raw tables and the analyzer outputs."""
        raw = ["inventory", "products", "sales", "stores", "suppliers", "transactions"]
        counts = tb.table_counts({t: getattr(self.raw, t) for t in raw}).unionByName(self.analyzer_counts)
        return tb.table_health(counts, len(raw) + len(an.ANALYZERS))

    # --- memory ---

    RECORDED_AT = "2001-11-05 08:00:00"

    @cached_property
    def recommendation_memory(self) -> DataFrame:
        return self._remembered(self.agent_recommendations)

    def _remembered(self, recs: DataFrame, *keep: str) -> DataFrame:
        """Memory rows of records of the agents, each under the number that its id has among all ids as texts."""
        number = rc.id_rank(self.agent_places, self.alternative_factors[0])
        return me.recommendation_memory_rows(recs, recs.limit(0), self.RECORDED_AT, number, keep)

    @cached_property
    def decision_memory(self) -> DataFrame:
        recs = self.named_recommendations(self.decisions)
        return me.decision_memory_rows(self.decisions.select("recommendation_id", "decided_at", "decision"), recs, recs.limit(0))

    @cached_property
    def outcome_memory(self) -> DataFrame:
        """Outcomes of the decision history; failures carry a note."""
        recs = self.named_recommendations(self.decisions)
        outcomes = self.decisions.select(
            "recommendation_id",
            F.col("decided_at").alias("recorded_at"),
            F.when(F.col("decision") == "approved", "applied").otherwise("").alias("action_taken"),
            "outcome_status",
            F.when(F.col("outcome_status") == "failed", "manual check").otherwise("").alias("outcome_note"),
        )
        return me.outcome_memory_rows(outcomes, recs, recs.limit(0))

    @cached_property
    def feedback(self) -> DataFrame:
        def joined(rows: DataFrame) -> DataFrame:
            return self._remembered(self.joined_recommendations(rows), *[c for c in rows.columns if c != "recommendation_id"])

        return me.feedback_rows(self.recommendation_memory, self.decision_memory, self.outcome_memory, joined)

    @cached_property
    def decided_feedback(self) -> DataFrame:
        """The feedback of records with a decision or an outcome, which alone give insights."""
        return me.feedback_rows(self._remembered(self.named_recommendations(self.decisions)), self.decision_memory, self.outcome_memory)

    @cached_property
    def insights(self) -> DataFrame:
        return me.learning_insights(self.decided_feedback, self.RECORDED_AT)

    @cached_property
    def analysis(self) -> DataFrame:
        return an.inventory_analysis(self.shared_base)


class Run(Workspace):
    """A workspace whose shared inputs are published tables, so that the many branches of a run read
    finished columns instead of repeating the joins and aggregations below them."""

    @cached_property
    def current_inventory(self) -> DataFrame:
        return published(Workspace.current_inventory.func(self))

    @cached_property
    def sales_summary(self) -> DataFrame:
        return published(Workspace.sales_summary.func(self))

    @cached_property
    def base(self) -> DataFrame:
        return published(Workspace.base.func(self))

    @cached_property
    def shared_base(self) -> DataFrame:
        return self.base

    @property
    def run(self) -> "Run":
        return self

    @cached_property
    def alternative_factors(self) -> tuple[DataFrame, DataFrame]:
        low, best = Workspace.alternative_factors.func(self)
        return published(low), published(best)


_RUNS: dict[tuple[str, str], tuple[tuple, Run]] = {}


def run_of(raw) -> Run:
    """The run over these tables, rebuilt when a source file changed."""
    if not isinstance(raw, StarTables):
        return Run(raw)
    key = (raw.spark.sparkContext.applicationId, raw.sf_dir)
    state = tuple(file_state(raw.spark, raw.sf_dir).first())
    if key not in _RUNS or _RUNS[key][0] != state:
        _RUNS[key] = (state, Run(raw))
    return _RUNS[key][1]
