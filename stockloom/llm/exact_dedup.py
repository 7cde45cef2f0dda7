"""Exact duplicates by skew-safe combining.

Texts are equal when they are identical after every ASCII white-space character is deleted.
Copies are combined in three steps, each of which groups by digest *and* whole content, so two
contents that share a digest are never merged: inside each map task (the partial aggregation),
then per (digest, salt), then per digest over the winners of the salts. A group of any size thus
reaches a reducer as at most one row per map task and salt.

Edge cases: a null text counts as empty, so null, empty and all-blank texts form one group. Among
equal texts the longest original stays, then the smallest doc_id; a null doc_id loses to any other.
Rows that repeat the doc_id and length of the row that stays are told apart by nothing, so one of
them stays. An empty table gives an empty result; further columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.session import published

SALTS = 16
#: Space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = " \t\n\x0b\x0c\r"

_STEP = Decimal(10**20)
_TOP = Decimal(2**63)


def content(text: Column) -> Column:
    """The text without its blanks; null counts as empty."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One number that orders rows by length, then by falling doc_id; null doc_ids come last."""
    place = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(Decimal(0)).cast("decimal(21,0)"))
    return (n_chars.cast("decimal(10,0)") * F.lit(_STEP).cast("decimal(21,0)") + place).cast("decimal(38,0)")


def _keyed(docs: DataFrame, digest: Callable[[Column], Column], *more) -> DataFrame:
    named = docs.select(
        *more,
        content(F.col("text")).alias("_content"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("_n"),
        F.col("doc_id").cast("long").alias("_id"),
    )
    return named.withColumn("_digest", digest(F.col("_content")))


def copy_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per distinct content: _digest, _content, keep_id, keep_n, group_size."""
    rows = _keyed(docs, digest).select(
        "_digest",
        "_content",
        (F.spark_partition_id() % salts).alias("_salt"),
        _rank(F.col("_n"), F.col("_id")).alias("_rank"),
    )
    salted = rows.groupBy("_digest", "_salt", "_content").agg(F.count("*").alias("_size"), F.max("_rank").alias("_rank"))
    whole = salted.groupBy("_digest", "_content").agg(F.sum("_size").alias("group_size"), F.max("_rank").alias("_rank"))
    place = (F.col("_rank") % F.lit(_STEP).cast("decimal(21,0)")).cast("decimal(20,0)")
    return whole.select(
        "_digest",
        "_content",
        F.when(place > 0, (F.lit(_TOP).cast("decimal(20,0)") - place).cast("long")).alias("keep_id"),
        F.floor(F.col("_rank") / F.lit(_STEP).cast("decimal(21,0)")).cast("int").alias("keep_n"),
        "group_size",
    )


def _with_groups(docs: DataFrame, digest, salts: int, *more) -> DataFrame:
    """The rows with their group. Groups of one need no partner, so only real groups are joined, each under
    every salt, so that the rows of a large group meet it in many tasks."""
    groups = copy_groups(docs, digest, salts)
    slim = published(groups.drop("_content"))
    shared = slim.groupBy("_digest").count().filter("count > 1")
    rows = _keyed(docs, digest, *more)
    if shared.isEmpty():
        keys, many = ["_digest"], slim.filter("group_size > 1")
        rows = rows.drop("_content")
    else:  # different contents with one digest: the content itself has to decide
        keys, many = ["_digest", "_content"], groups.filter("group_size > 1")
    return (
        rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
        .join(many.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge"), [*keys, "_salt"], "left")
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")))
        .withColumn("_stays", F.col("group_size").isNull() | (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == F.col("keep_n"))))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    )


def copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    text_sha256 is the digest of the content in lower-case hexadecimal digits.
    """
    known = {} if digest is sha256 else {"_sha": sha256(content(F.col("text")))}
    rows = _with_groups(docs, digest, salts, *(c.alias(name) for name, c in known.items()))
    rows = rows.select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", "_stays", F.col("_sha" if known else "_digest").alias("text_sha256"), "_n"
    )
    # equal rows become one with their number, so that exactly one of them stays
    alike = rows.groupBy(*rows.columns).agg(F.count("*").alias("_times"))
    return alike.select(
        "doc_id", "keep_id", "group_size", "_stays", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_k")
    ).select("doc_id", "keep_id", "group_size", (F.col("_stays") & (F.col("_k") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """The rows that stay, with the columns they came with."""
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    stay = _with_groups(packed, digest, salts, "_row").filter("_stays")
    repeated = _keyed(docs, digest).groupBy("_id", "_n", "_digest").count().filter("count > 1")
    if not repeated.isEmpty():
        stay = stay.dropDuplicates(["_id", "_n", "_digest"] + (["_content"] if "_content" in stay.columns else []))
    return stay.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
