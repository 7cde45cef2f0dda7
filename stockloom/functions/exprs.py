"""Scalar building blocks shared by the operators. All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Movement types of the stock ledger.
INBOUND_TYPES = ["purchase", "restock", "transfer_in", "return", "inventory_in"]
OUTBOUND_TYPES = ["sale", "transfer_out", "damage", "waste", "return_to_supplier"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c, default=0) -> Column:
    """Numeric value of any column; null or non-numeric gives the default."""
    return F.coalesce(col(c).try_cast("double"), F.lit(default).cast("double"))


def whole(c, default=0) -> Column:
    """Long value of any column; null or non-numeric gives the default."""
    return F.coalesce(col(c).try_cast("long"), F.lit(default).cast("long"))


def text(c, fallback="") -> Column:
    """Trimmed text; blank or null gives the fallback."""
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.coalesce(F.nullif(F.trim(col(c).cast("string")), F.lit("")), fb)


def truthy(*cols, default=None) -> Column:
    """First value that is neither null, blank nor zero."""
    out = [F.nullif(col(c), F.lit(0)) for c in cols]
    return F.coalesce(*out, F.lit(default)) if default is not None else F.coalesce(*out)


def truthy_text(*cols) -> Column:
    """First non-blank text, else an empty text."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in cols], F.lit(""))


def to_date_or_null(c) -> Column:
    return F.try_to_date(col(c).cast("string")) if hasattr(F, "try_to_date") else col(c).try_cast("date")


def fill_missing(df: DataFrame) -> DataFrame:
    """Numbers become 0 and texts blank where null; dates stay null."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    zeros = {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in numbers}
    blanks = {c: F.coalesce(F.col(c), F.lit("")) for c in texts}
    return df.withColumns({**zeros, **blanks})


def ratio(a, b, default=0.0) -> Column:
    """a / b as double, the default where b is zero or null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(default))


def at_least_zero(c) -> Column:
    return F.greatest(col(c), F.lit(0).cast("long"))


def round_even(c) -> Column:
    """Whole number, halves to even."""
    return F.rint(col(c).cast("double")).cast("long")


def round2(c) -> Column:
    """Two decimals, halves to even on the scaled value."""
    return F.rint(col(c).cast("double") * 100) / 100


def signed_quantity(kind, qty) -> Column:
    q = whole(qty)
    return (
        F.when(col(kind).isin(INBOUND_TYPES), q)
        .when(col(kind).isin(OUTBOUND_TYPES), -q)
        .otherwise(F.lit(0).cast("long"))
    )


def threshold_or_product(store_thr, product_thr, only_zero: bool) -> Column:
    """Store threshold with the product's as fallback: where it is 0, or where it is not above 0."""
    s, p = whole(store_thr), whole(product_thr)
    return F.when((s == 0) if only_zero else ~(s > 0), p).otherwise(s)


def velocity_with_fallback(q7, q30) -> Column:
    return F.when(col(q7) == 0, col(q30) / F.lit(30.0)).otherwise(col(q7) / F.lit(7.0))


def cover_days(stock, velocity, none_value=0.0) -> Column:
    v = col(velocity)
    return F.when(v > 0, F.try_divide(col(stock).cast("double"), v)).otherwise(F.lit(none_value))


def cover_priority(days, config) -> Column:
    d = col(days)
    return (
        F.when(d <= config.stockout_high_priority_days, "high")
        .when(d <= config.stockout_medium_priority_days, "medium")
        .otherwise("low")
    )


def shortage_priority(qty, thr) -> Column:
    q, t = col(qty), col(thr)
    return (
        F.when(q <= 0, "High")
        .when(t <= 0, "Medium")
        .when(q * 2 <= t, "High")
        .when(q < t, "Medium")
        .otherwise("Low")
    )


def suggested_reorder(qty, thr, velocity) -> Column:
    """Twice the threshold, or threshold plus a 14-day cover when there is movement."""
    q, t, v = col(qty), col(thr), col(velocity)
    base = at_least_zero(F.ceil(t * 2 - q))
    cover = at_least_zero((t + F.ceil(v * 14) - q).cast("long"))
    return F.when(v > 0, F.greatest(base, cover)).otherwise(base)


def priority_rank(c) -> Column:
    p = F.lower(F.coalesce(col(c), F.lit("")))
    return F.when(p == "high", 0).when(p == "medium", 1).when(p == "low", 2).otherwise(3)


def number_text(c, dtype: T.DataType) -> Column:
    """Integers as they are, fractions to two decimals."""
    if isinstance(dtype, (T.LongType, T.IntegerType, T.StringType)):
        return col(c).cast("string")
    return round2(c).cast("string")


def evidence(df: DataFrame, **pairs) -> Column:
    """`name=value` items joined by comma; values are column names or columns of the frame."""
    parts = []
    for name, c in pairs.items():
        dtype = df.schema[c].dataType if isinstance(c, str) else T.DoubleType()
        parts.append(F.concat(F.lit(f"{name}="), number_text(c, dtype)))
    return F.concat_ws(", ", *parts)


def parse_evidence(c) -> Column:
    """`k=v, k=v` text as a map: items without `=` are skipped, the last value of a key wins."""
    items = F.filter(F.split(F.coalesce(col(c), F.lit("")), ","), lambda p: F.instr(p, "=") > 0)
    key = lambda p: F.trim(F.substring_index(p, "=", 1))
    val = lambda p: F.trim(F.substr(p, F.instr(p, "=") + F.lit(1)))
    # Keep an item only if no later item has its key, so the map never sees a duplicate.
    keys = F.transform(items, key)
    last = F.filter(
        F.transform(items, lambda p, i: F.struct(key(p).alias("k"), val(p).alias("v"), i.alias("i"))),
        lambda s: ~F.exists(F.slice(keys, s["i"] + 2, F.size(keys)), lambda k: k == s["k"]),
    )
    return F.map_from_entries(F.transform(last, lambda s: F.struct(s["k"], s["v"])))


def discount_percent(action, kind) -> Column:
    """First `n%` of the action text; 10 for a discount and 20 for anything else when there is none."""
    found = F.regexp_extract(F.coalesce(col(action), F.lit("")), r"(\d+(?:\.\d+)?)\s*%", 1)
    return F.coalesce(found.try_cast("double"), F.when(col(kind) == "discount", 10.0).otherwise(20.0))


def discounted(price, percent) -> Column:
    """Price less percent in whole cents, halves to even, computed on integers."""
    cents = (col(price) * 100).cast("long")
    basis = F.lit(10000) - F.rint(col(percent) * 100).cast("long")
    return F.rint(cents * basis / F.lit(10000.0)) / 100


def branch_label(city, store) -> Column:
    c = F.coalesce(col(city), F.lit(""))
    return F.when(F.trim(c) != "", F.concat_ws(" - ", c, col(store))).otherwise(col(store))


def prefixed(prefix: str, number_col, width: int) -> Column:
    return F.format_string(f"{prefix}%0{width}d", col(number_col))


def alert_key(product="product_id", store="store_id", qty="current_quantity", priority="priority") -> Column:
    return F.concat_ws("|", *[F.trim(F.coalesce(col(c).cast("string"), F.lit(""))) for c in (product, store, qty, priority)])


def sentence(c, fallback: str) -> Column:
    """Blanks squeezed, closed by a full stop; blank gives the fallback."""
    t = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))
    return F.when(t == "", F.lit(fallback)).when(t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def title_or_info(c) -> Column:
    t = F.initcap(F.lower(F.trim(F.coalesce(col(c), F.lit("")))))
    return F.when(t == "", F.lit("Info")).otherwise(t)
