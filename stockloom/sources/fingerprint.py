"""Fingerprints that tell whether sources changed since a derived table was built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _order_free(*columns):
    """Sum of row hashes: the same for any order and partitioning of the rows."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")


def file_state(spark: SparkSession, folder: str) -> DataFrame:
    """One row (files, state) from names, times and sizes only; no content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return files.agg(F.count(F.lit(1)).alias("files"), _order_free("path", "modificationTime", "length").alias("state"))


def content_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, row_count, fingerprint) of the rows of every table, free of row order: the sum of 60 bits of
    the MD5 of each row's values as text, nulls as empty."""
    out = None
    for name, df in tables.items():
        row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
        bits = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
        one = df.agg(
            F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(bits).cast("string"), F.lit("0")).alias("fingerprint")
        ).select(F.lit(name).alias("dataset"), "row_count", "fingerprint")
        out = one if out is None else out.unionByName(one)
    return out
