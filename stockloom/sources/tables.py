"""Readers, schema alignment and validation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stockloom.functions.exprs import to_date_or_null
from stockloom.schemas import RAW_TABLES


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, columns matched by name; unparsable values become null."""
    names = spark.read.option("header", True).csv(path).columns
    typed = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(typed).option("header", True).csv(path)
    return align_to_schema(raw, schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return align_to_schema(spark.read.format(fmt).load(path), schema)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """An absent table is an empty frame of the schema."""
    try:
        return read_table(spark, path, schema, fmt)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def load_raw(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """The six raw tables of a folder."""
    suffix = "csv" if fmt == "csv" else "parquet"
    return {n: read_table(spark, f"{folder}/{n}.{suffix}", s, fmt) for n, s in RAW_TABLES.items()}


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the schema: missing text columns are blank, other missing columns null."""
    out = []
    for field in schema.fields:
        if field.name not in df.columns:
            blank = F.lit("") if isinstance(field.dataType, T.StringType) else F.lit(None)
            out.append(blank.cast(field.dataType).alias(field.name))
        elif df.schema[field.name].dataType == field.dataType:
            out.append(F.col(field.name))
        elif isinstance(field.dataType, T.DateType):
            out.append(to_date_or_null(field.name).alias(field.name))
        else:
            out.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
    return df.select(*out)


def select_existing(df: DataFrame, preferred: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Preferred columns that exist, in that order, optionally renamed."""
    out = df.select(*[c for c in preferred if c in df.columns])
    return out.withColumnsRenamed(rename) if rename else out


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def null_counts(df: DataFrame, required: list[str]) -> DataFrame:
    """One row (column_name, null_count) per required column, from one pass over the data."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.unpivot([], list(required), "column_name", "null_count")


def validate_table(df: DataFrame, required: list[str], date_columns: list[str] = ()) -> DataFrame:
    """The frame with strict dates; raises on missing columns or nulls in required ones."""
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    bad = null_counts(df, required).filter("null_count > 0").collect()  # one row per required column at most
    if bad:
        raise ValueError("null values in required columns: " + ", ".join(f"{r[0]}={r[1]}" for r in bad))
    return df.withColumns({c: F.to_date(F.col(c).cast("string")) for c in date_columns})


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, row_count) for every named frame, a zero for an empty one."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("dataset"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def table_health(counts: DataFrame, total: int) -> DataFrame:
    """Healthy when all tables have rows, Watch when at most two lack them."""
    n = F.count_if(F.col("row_count") > 0)
    label = F.when(n == total, "Healthy").when(n >= total - 2, "Watch").otherwise("Needs Attention")
    return counts.agg(n.alias("available_count"), label.alias("status")).select(
        "available_count",
        F.lit(total).cast("long").alias("total_count"),
        "status",
        F.format_string("%s (%d/%d)", "status", "available_count", F.lit(total)).alias("health_label"),
    )
