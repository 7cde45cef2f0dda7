"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "s": T.StringType(),
    "l": T.LongType(),
    "d": T.DoubleType(),
    "p": T.DecimalType(12, 2),
    "dt": T.DateType(),
    "ts": T.TimestampType(),
    "b": T.BooleanType(),
}


def _schema(text: str) -> T.StructType:
    fields = (item.split(":") for item in text.split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


def extended(schema: T.StructType, **fields: str) -> T.StructType:
    """A new schema with more fields; `StructType.add` would change the given one."""
    more = [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in fields.items()]
    return T.StructType([*schema.fields, *more])


PRODUCTS = _schema(
    "product_id:s product_name:s category:s cost_price:p selling_price:p "
    "shelf_life_days:l reorder_threshold:l supplier_id:s"
)
STORES = _schema("store_id:s store_name:s city:s capacity:l")
SUPPLIERS = _schema("supplier_id:s supplier_name:s avg_delivery_days:l reliability_score:d")
INVENTORY = _schema("product_id:s store_id:s stock_level:l reorder_threshold:l last_updated:dt")
SALES = _schema("sale_id:s date:dt product_id:s store_id:s quantity_sold:l selling_price:p")
TRANSACTIONS = _schema(
    "transaction_id:s date:dt transaction_type:s product_id:s store_id:s quantity:l source:s remarks:s"
)
CUSTOMER_ORDERS = _schema(
    "order_id:s order_date:ts store_id:s store_name:s city:s product_id:s product_name:s "
    "quantity_ordered:l unit_price:p total_amount:p status:s"
)
RECOMMENDATIONS = _schema(
    "recommendation_id:s recommendation_type:s product_id:s product_name:s store_id:s store_name:s "
    "alternative_product_id:s alternative_product_name:s alternative_store_id:s alternative_store_name:s "
    "available_quantity:l priority:s action:s reason:s evidence:s suggested_quantity:l source_agent:s status:s"
)
RECOMMENDATION_MEMORY = _schema(
    "memory_id:s recorded_at:ts recommendation_id:s recommendation_type:s product_id:s product_name:s "
    "store_id:s priority:s action:s reason:s evidence:s suggested_quantity:l source_agent:s status:s"
)
DECISION_MEMORY = _schema(
    "memory_id:s recorded_at:ts recommendation_id:s recommendation_type:s product_id:s product_name:s "
    "store_id:s decision:s source_agent:s"
)
OUTCOME_MEMORY = _schema(
    "memory_id:s recorded_at:ts recommendation_id:s recommendation_type:s product_id:s product_name:s "
    "store_id:s action_taken:s outcome_status:s outcome_note:s"
)
LEARNING_INSIGHTS = _schema(
    "insight_id:s recorded_at:ts recommendation_type:s product_id:s product_name:s store_id:s "
    "action_taken:s outcome_status:s learning_label:s insight:s recommended_adjustment:s source:s"
)
DECISIONS = _schema(
    "decision_id:s recommendation_id:s decision:s decided_at:ts recommendation_type:s product_id:s "
    "product_name:s store_id:s source_agent:s manager_note:s rejection_reason:s edited_values_json:s "
    "execution_status:s action_summary:s"
)
PRICE_UPDATES = _schema(
    "update_id:s recommendation_id:s action_type:s product_id:s product_name:s store_id:s old_price:p "
    "discount_percent:d new_price:p reason:s manager_note:s executed_at:ts"
)
TRANSFER_ACTIONS = _schema(
    "transfer_id:s recommendation_id:s product_id:s product_name:s source_store_id:s target_store_id:s "
    "quantity:l reason:s manager_note:s executed_at:ts"
)
PROCUREMENT_ORDERS = _schema(
    "procurement_id:s recommendation_id:s product_id:s product_name:s store_id:s supplier_id:s "
    "supplier_name:s quantity:l priority:s reason:s manager_note:s executed_at:ts"
)
RISK_ACTIONS = _schema(
    "risk_action_id:s recommendation_id:s recommendation_type:s product_id:s product_name:s store_id:s "
    "mitigation_action:s priority:s manager_note:s status:s executed_at:ts"
)
ALERT_LOG = _schema(
    "timestamp:ts alert_key:s product_id:s store_id:s current_quantity:l suggested_reorder_quantity:l "
    "priority:s email_sent:b delivery_status:s error_message:s"
)

RAW_TABLES = {
    "products": PRODUCTS,
    "stores": STORES,
    "suppliers": SUPPLIERS,
    "inventory": INVENTORY,
    "sales": SALES,
    "transactions": TRANSACTIONS,
}

# Columns every analyzer output keeps, in this order.
ANALYSIS_COLUMNS = (
    "product_id product_name category store_id store_name city stock_level "
    "effective_reorder_threshold recent_7_day_quantity_sold recent_30_day_quantity_sold "
    "recent_daily_sales_velocity days_of_stock_remaining shelf_life_days supplier_id "
    "last_sale_date reason trigger evidence"
).split()
