"""Dense numbers inside groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def numbered(rows: DataFrame, group: str, order: list[Column], name: str, blocks: int, size: Column | None = None) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... inside every value of `group`, in the order of an MD5 of `order`. With `size`,
    the sum of the sizes before.

    The hash range is cut into `blocks` equal parts; rows are numbered inside (group, part) and moved
    by the sizes of the parts before, so a group that holds most rows is numbered by many tasks. The
    numbers do not depend on `blocks`. Only rows equal in all of `order` can tie.
    """
    rows = rows.withColumn("_hash", F.md5(F.concat_ws("/", *(c.cast("string") for c in order)).cast("binary")))
    rows = rows.withColumn("_part", F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * blocks / 2**32).cast("int"))
    sizes = rows.groupBy(group, "_part").agg(F.sum(F.lit(1) if size is None else size).alias("_size"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(group, "_part").orderBy("_hash", *order)
    if size is None:
        placed = rows.withColumn("_place", F.row_number().over(inside) - 1)
    else:
        earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.withColumn("_place", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    starts = starts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), "_start")
    joined = placed.join(starts, placed[group].eqNullSafe(F.col("_group")) & (placed["_part"] == F.col("_of")), "left")
    return joined.withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_hash", "_part", "_place", "_group", "_of", "_start")
