"""Search over the records of a run: the words of alternatives come from their factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.functions import text as tx
from stockloom.functions.exprs import prefixed
from stockloom.functions.ids import sequential_numbers
from stockloom.operators import recommend as rc, retrieval as rt, transfers as tr
from stockloom.schemas import RECOMMENDATIONS

DATASET = "recommendations"


def record_documents(records: DataFrame, order: int) -> DataFrame:
    return rt.row_documents(DATASET, records.select(*RECOMMENDATIONS.names), ["recommendation_id"], order)


def _low_texts(low: DataFrame) -> DataFrame:
    """What a low row adds to the texts of its alternatives."""
    rows = low.select("before", F.col("low_product_id").alias("product_id"), F.col("low_stock_product").alias("product_name"),
                      F.col("low_store_id").alias("store_id"), F.col("low_stock_store").alias("store_name"))
    lines = [F.when(F.trim(c) != "", F.concat(F.lit(f"{c}: "), c)) for c in rows.columns[1:]]
    return rows.select("before", F.concat_ws("\n", *lines).alias("text"))


def _product_texts(best: DataFrame, agent: str | None) -> DataFrame:
    """The texts of alternatives without their low row and id."""
    blank = {c: F.lit("") for c in ("low_product_id", "low_stock_product", "low_store_id", "low_stock_store")}
    records = rc.alternative_records(best.withColumns(blank), agent, "number").withColumn("recommendation_id", F.lit(""))
    docs = rt.row_documents(DATASET, records.select("number", *RECOMMENDATIONS.names), ["recommendation_id"], columns=RECOMMENDATIONS.names, keep=["number"])
    return docs.select("number", F.concat("text", F.lit("\nrecommendation_id")).alias("text"))


def _with_words(rows: DataFrame, texts: DataFrame, asked: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with the number of their set of asked words, and the sets. Words hold no blanks."""
    found = texts.select(key, F.explode(tx.token_set("text")).alias("token")).join(asked, "token", "left_semi")
    found = found.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("token")), " ").alias("_words"))  # words of one row
    rows = rows.join(found, key, "left").withColumn("_words", F.coalesce("_words", F.lit("")))
    sets = sequential_numbers(rows.select("_words").distinct(), ["_words"], name)
    return rows.join(sets, "_words").drop("_words"), sets.withColumnRenamed("_words", f"{name}_words")


def alternative_profiles(
    asked: DataFrame, low: DataFrame, best: DataFrame, shift: Column, k: int, order: int, agent: str | None = None
) -> DataFrame:
    """For every set of asked words the alternatives with the `k` first ids, as `retrieval.profiles` has them of all documents.

    The words of an alternative are those of its low row, those of its product and its id. Low rows of a category with the
    same words are a group, and so are its products; ids are texts, so groups of low rows are cut where ids become longer.
    Two products or more give every low row a pair, so the first k low rows of a group and the first k + 1 products
    hold the first k pairs. A single product has no pair with its own low rows, so it meets the first k low rows of each
    of the first k + 1 products. Low rows whose ids are of two lengths or are asked for by id meet all products.
    """
    ids = asked.filter(F.col("token").rlike("^rec[0-9]+$")).select(F.upper("token").alias("recommendation_id"), F.col("token").alias("mark"))
    marks = rc.named_places(ids, "mark").withColumn("place", F.col("place") - shift).filter("place > 0")
    low, low_sets = _with_words(low.filter(F.col("low_product_id").isNotNull()), _low_texts(low), asked, "before", "low_set")
    best, sets = _with_words(best, _product_texts(best, agent), asked, "number", "product_set")
    digits = lambda place: F.length(prefixed("", place, 5))
    low = low.withColumns({"_id": digits(F.col("before") + 1 + shift), "_last": digits(F.col("before") + F.col("pairs") + shift)})
    named = tr.pairs_at(low, best, marks).select("before").distinct().withColumn("_named", F.lit(True))
    low = low.join(named, "before", "left")
    alike = (F.col("_id") == F.col("_last")) & F.col("_named").isNull()
    whole = tr.numbered_pairs(low.filter(~alike).drop("_id", "_last", "_named"), best, marks)

    group = ["low_category", "low_set", "_id"]
    of = lambda *keys: Window.partitionBy(*group, *keys)
    some = low.filter(alike).withColumn("_nth", F.row_number().over(of("low_product_id").orderBy("before"))).filter(F.col("_nth") <= k)
    some = some.withColumn("_product_nth", F.dense_rank().over(of().orderBy("low_product_id"))).filter(F.col("_product_nth") <= k + 1)
    some = some.withColumn("_near", F.row_number().over(of().orderBy("before")) <= k)
    same = Window.partitionBy("category", "product_set")
    few = best.withColumn("_nth", F.row_number().over(same.orderBy("number"))).filter(F.col("_nth") <= k + 1).drop("_nth")
    few = few.withColumn("_alone", F.count(F.lit(1)).over(same) == 1)  # of k + 1 rows at most
    pairs = tr.numbered_pairs(some.drop("_id", "_last", "_named", "_nth", "_product_nth"), few).filter("_near OR _alone")
    fields = ["place", "low_set", "product_set"]
    both = pairs.select(*fields, F.lit(None).cast("string").alias("mark")).unionByName(whole.select(*fields, "mark"))

    both = both.withColumn("place", F.col("place") + shift).withColumn("_id", digits("place"))
    first = Window.partitionBy("low_set", "product_set", "mark", "_id").orderBy("place")
    kept = both.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= k)
    kept = kept.join(low_sets, "low_set").join(sets, "product_set")
    words = F.split(F.concat_ws(" ", "low_set_words", "product_set_words", "mark"), " ")
    profile = F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))
    return kept.select(
        F.lit(DATASET).alias("dataset"), F.lit(order).alias("dataset_order"), prefixed("REC", "place", 5).alias("row_key"), profile.alias("profile")
    ).filter(F.size("profile") > 0)
