"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from stockloom.sources.tables import align_to_schema


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a named output; the commit protocol publishes complete files only."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_log(df: DataFrame, path: str, schema: T.StructType, day_from: str | None = None) -> None:
    """Append rows in the log's fixed layout, by day when a timestamp column is named."""
    rows = align_to_schema(df, schema)
    if day_from:
        rows = rows.withColumn("log_day", F.to_date(day_from))
        rows.repartition("log_day").write.mode("append").partitionBy("log_day").parquet(path)  # one file a day
    else:
        rows.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def clean_records(df: DataFrame) -> DataFrame:
    """Infinite and not-a-number values become null, dates become ISO text."""
    out = {}
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            inf = F.lit(float("inf"))
            out[field.name] = F.when(F.isnan(c) | (F.abs(c) == inf), F.lit(None)).otherwise(c)
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[field.name] = c.cast("string")
    return df.withColumns(out) if out else df


def records_json(df: DataFrame, limit: int | None = None, order_by: list | None = None) -> DataFrame:
    """One JSON text per cleaned row."""
    cleaned = clean_records(df)
    if order_by:
        cleaned = cleaned.orderBy(*order_by)
    if limit is not None:
        cleaned = cleaned.limit(limit)
    return cleaned.select(F.to_json(F.struct(*[F.col(c) for c in cleaned.columns])).alias("record"))
