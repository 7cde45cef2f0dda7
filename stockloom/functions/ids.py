"""Dense sequential ids without a single-partition window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.functions.exprs import prefixed
from stockloom.session import checkpointed

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def sequential_numbers(
    df: DataFrame, order: list, column: str, start: Column | int = 0, keep: Callable[[DataFrame], DataFrame] = checkpointed
) -> DataFrame:
    """Number rows 1, 2, ... in a total order, after `start`.

    Rows are range-sorted once and written to a checkpoint, which fixes the partitions; each row then
    knows its partition and place, and only one count per partition is summed up. Wide rows that are read
    more than once are better kept by `published`, whose scans read the asked columns only.
    """
    fixed = keep(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS)
    counts = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    first = F.lit(start) if isinstance(start, int) else start
    number = F.col("_before") + F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1) + 1 + first
    return (
        fixed.join(F.broadcast(offsets), part == F.col("_part"))
        .withColumn(column, number.cast("long"))
        .drop("_place", "_part", "_before")
    )


def running_totals(df: DataFrame, order: list, amount: str, column: str) -> DataFrame:
    """The sum of `amount` over all rows before each row of a total order.

    As above: the rows are range-sorted once, sums run inside partitions, and one sum per partition is added up.
    """
    fixed = checkpointed(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("_part", F.shiftright("_place", _ROW_BITS))
    sums = fixed.groupBy("_part").agg(F.sum(amount).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_before") + F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return fixed.join(F.broadcast(offsets), "_part").withColumn(column, total.cast("long")).drop("_place", "_part", "_before")


def sequential_ids(
    df: DataFrame, order: list, prefix: str, width: int, column: str, start: Column | int = 0
) -> DataFrame:
    """Ids such as REC00001 in a total order, as the first column."""
    out = sequential_numbers(df.drop(column), order, "_number", start)
    rest = [c for c in df.columns if c != column]
    return out.select(prefixed(prefix, "_number", width).alias(column), *rest)


def text_rank(number: Column, total: int, width: int) -> Column:
    """The place of id `number` when the ids 1 to `total`, padded to `width` digits, are sorted as texts, where longer ids
    stand between shorter ones. For each length of an id the shorter and equal ones up to its first digits come before it,
    and the longer ones that begin with a smaller number."""
    size = F.greatest(F.length(number.cast("string")), F.lit(width))
    lengths = range(width, max(len(str(total)), width) + 1)
    tens = F.array(*[F.lit(10**i).cast("long") for i in range(len(str(total)) + 1)])
    power = lambda n: F.element_at(tens, n + 1)
    out = F.lit(0).cast("long")
    for n in lengths:
        least = 1 if n == width else 10 ** (n - 1)
        bound = F.when(size >= n, F.call_function("div", number, power(size - n))).otherwise(number * power(n - size) - 1)
        out = out + F.greatest(F.lit(0), F.least(bound, F.lit(min(total, 10**n - 1))) - least + 1)
    return out


def last_number(existing: DataFrame, column: str, prefix: str) -> Column:
    """Largest numeric suffix among existing ids, 0 when there is none, as a scalar subquery."""
    suffix = F.replace(F.coalesce(F.col(column), F.lit("")), F.lit(prefix), F.lit("")).try_cast("long")
    return existing.agg(F.coalesce(F.max(suffix), F.lit(0)).alias("last")).scalar()


def id_width(prefix: str) -> int:
    return 7 if prefix == "TXN" else 6


def next_prefixed_ids(new: DataFrame, order: list, existing: DataFrame, column: str, prefix: str) -> DataFrame:
    """Ids continuing after the largest existing one."""
    return sequential_ids(new, order, prefix, id_width(prefix), column, last_number(existing, column, prefix))
