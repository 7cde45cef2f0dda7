"""Row documents, hash embeddings, nearest vectors and keyword retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stockloom.functions import text as tx
from stockloom.functions.ids import sequential_numbers
from stockloom.session import published

DIMENSION = 384
DOCUMENTS, QUERIES = 8192, 1024  # rows of a block, about; they bound the memory of a task
COMMON = 8  # a word in one of so many profiles is common


def row_documents(name: str, df: DataFrame, key: list[str], order: int = 0, columns: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """Each row as `column: value` lines of its non-blank values, with metadata and JSON. `columns` are those of the
    text, if not all, and columns of `keep` stay."""
    columns = columns or df.columns
    as_text = {c: F.trim(F.col(c).cast("string")) for c in columns}
    line = lambda c: F.when(as_text[c] != "", F.concat(F.lit(f"{c}: "), as_text[c]))
    meta = lambda c: (F.coalesce(as_text[c], F.lit("")) if c in columns else F.lit("")).alias(c)
    present = [F.when(as_text[c] != "", as_text[c]).alias(c) for c in columns]
    row_key = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    return df.select(
        F.lit(name).alias("dataset"),
        F.lit(order).alias("dataset_order"),
        row_key.alias("row_key"),
        F.concat_ws("\n", F.lit(f"dataset: {name}"), F.concat(F.lit("row_key: "), row_key), *[line(c) for c in columns]).alias("text"),
        meta("product_id"),
        meta("product_name"),
        meta("store_id"),
        meta("recommendation_type"),
        F.to_json(F.struct(*present)).alias("row_json"),
        F.concat_ws(" ", *[as_text[c] for c in columns]).alias("values_text"),
        *keep,
    )


def all_documents(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    out = None
    for i, (name, (df, key)) in enumerate(tables.items()):
        docs = row_documents(name, df, key, i)
        out = docs if out is None else out.unionByName(docs)
    return out


def hash_weights(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse unit vectors (key, position, weight): every token adds +1 or -1 at a position that its
    md5 gives. Token counts are summed on the map side."""
    first3 = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 6), 16, 10).cast("long")
    byte = lambda i: F.shiftright("first3", 16 - 8 * i).bitwiseAND(255)
    sums = (
        docs.select(key, F.explode(tx.tokens(text)).alias("token"))
        .select(key, first3.alias("first3"))
        .groupBy(key, "first3")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(key, ((byte(0) + byte(1) * 256) % DIMENSION).alias("position"))
        .agg(F.sum(F.when(byte(2) % 2 == 0, F.col("n")).otherwise(-F.col("n"))).alias("total"))
        .filter("total <> 0")
    )
    norm = F.sqrt(F.sum(F.col("total") * F.col("total")).over(Window.partitionBy(key)).cast("double"))  # of at most 384 rows
    return sums.select(key, "position", (F.col("total") / norm).alias("weight"))


def hash_embeddings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Dense vectors; a text without tokens is all zeros."""
    packed = hash_weights(docs, key, text).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("position", "weight"))).alias("w")  # at most 384 entries
    )
    dense = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(DIMENSION - 1).cast("long")),
        lambda i: F.coalesce(F.col("w")[i], F.lit(0.0)).cast("float"),
    )
    return docs.select(key).join(packed, key, "left").select(key, dense.alias("embedding"))


def _nearest_in_block(k: int, doc_key: str):
    """The k nearest documents of a block for every query of a block: one matrix product, then an exact
    order of those that are not beyond the kth distance."""

    def run(key, docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(queries):
            return pd.DataFrame({"query_id": queries["_id"].iloc[:0], doc_key: docs["_id"].iloc[:0], "distance": np.empty(0)})
        d, q = (np.stack(x["_vector"].to_numpy()).astype(np.float64) for x in (docs, queries))
        far = (d * d).sum(axis=1)[None, :] + (q * q).sum(axis=1)[:, None] - 2.0 * (q @ d.T)
        far = np.rint(np.maximum(far, 0) * 1e9) / 1e9
        limit = np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, min(k, far.shape[1]) - 1]
        row, column = np.nonzero(far <= limit[:, None])
        hits = pd.DataFrame(
            {"query_id": queries["_id"].to_numpy()[row], doc_key: docs["_id"].to_numpy()[column], "distance": far[row, column], "_query": row}
        )
        return hits.sort_values(["_query", "distance", doc_key], kind="stable").groupby("_query").head(k).drop(columns="_query")

    return run


def vector_search(queries: DataFrame, docs: DataFrame, k: int, query_key: str, doc_key: str, column: str = "embedding") -> DataFrame:
    """Exact k nearest documents of every query by squared distance.

    Both sides stay distributed: they are dealt into blocks of about DOCUMENTS and QUERIES rows, every block
    of documents meets every block of queries once and keeps k rows per query, and the ranks are taken over
    those. Ids keep their types.
    """
    blocks = lambda df, size: df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("n")).scalar()
    n, m = blocks(docs, DOCUMENTS), blocks(queries, QUERIES)
    dealt = lambda key, count: F.pmod(F.xxhash64(key), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    left = docs.select(dealt(doc_key, n).alias("block"), every(m).alias("ask"), F.col(doc_key).alias("_id"), F.col(column).alias("_vector"))
    right = queries.select(every(n).alias("block"), dealt(query_key, m).alias("ask"), F.col(query_key).alias("_id"), F.col(column).alias("_vector"))
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema[query_key].dataType),
            T.StructField(doc_key, docs.schema[doc_key].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    found = left.groupBy("block", "ask").cogroup(right.groupBy("block", "ask")).applyInPandas(_nearest_in_block(k, doc_key), schema)
    nearest = Window.partitionBy("query_id").orderBy("distance", doc_key)
    return found.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k)


# Which question words favour which datasets, and by how much.
RECENCY_BONUS = {3: ["customer_orders", "orchestrator_summary", "agent_outputs", "recommendations"], 2: ["inventory", "sales"]}
INTENT_BONUS = [
    (["agent", "orchestrator", "summary", "risk", "suggested", "responsible"], ["agent_outputs", "orchestrator_summary", "recommendations"], 6),
    (["order", "orders", "changed", "latest"], ["customer_orders", "inventory", "sales", "transactions"], 5),
    (["reorder", "procurement", "purchase"], ["recommendations", "low_stock_items", "stockout_risk_items"], 4),
    (["stock", "inventory", "store"], ["inventory", "current_inventory", "low_stock_items", "store_inventory_summary"], 3),
    (["supplier", "suppliers", "risky"], ["suppliers", "recommendations", "agent_outputs"], 5),
    (["recommendation", "recommendations", "dead", "discount", "transfer", "clearance"],
     ["recommendations", "dead_stock_candidates", "agent_outputs", "orchestrator_summary"], 4),
]
PLAN_RULES = [
    (["store", "stores"], ["store_inventory_summary", "sales_summary", "recommendations"]),
    (["sales", "trend", "dropping", "underperforming"], ["sales", "sales_summary", "agent_outputs"]),
    (["supplier", "suppliers", "risky"], ["suppliers", "recommendations", "agent_outputs"]),
    (["reorder", "procurement", "next"], ["recommendations", "stockout_risk_items", "low_stock_items"]),
    (["compare", "vs", "versus"], ["sales_summary", "store_inventory_summary", "recommendations"]),
]
COMPARISON_DATASETS = ["sales_summary", "store_inventory_summary", "current_inventory", "recommendations"]


def _overlaps(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def dataset_bonuses(question_tokens: Column) -> Column:
    """Points of every favoured dataset for a question, as a map made once per question."""
    names = list(dict.fromkeys(n for group in [*RECENCY_BONUS.values(), *(r[1] for r in INTENT_BONUS)] for n in group))

    def points(name: str) -> Column:
        total = F.lit(sum(p for p, group in RECENCY_BONUS.items() if name in group))
        for words, group, extra in INTENT_BONUS:
            if name in group:
                total = total + F.when(_overlaps(question_tokens, words), extra).otherwise(0)
        return total.cast("long")

    return F.create_map(*[x for n in names for x in (F.lit(n), points(n))])


def _best_hits(scored: DataFrame, k: int, question_key: str) -> DataFrame:
    best = Window.partitionBy(question_key).orderBy(F.desc("score"), "dataset_order", "row_key")
    return (
        scored.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k)
        .select(question_key, "place", "dataset", "row_key", "overlap", "score")
    )


def asked_words(questions: DataFrame, question: str = "question") -> DataFrame:
    """The words of all questions, each once."""
    return questions.select(F.explode(tx.token_set(question)).alias("token")).distinct()


def profiles(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Documents with their words that occur in any question."""
    words = docs.select("dataset", "dataset_order", "row_key", F.explode(tx.token_set("text")).alias("token"))
    return words.join(asked, "token", "left_semi").groupBy("dataset", "dataset_order", "row_key").agg(
        F.array_sort(F.collect_set("token")).alias("profile")  # words of one document
    )


def keyword_search(
    questions: DataFrame, docs: DataFrame, k: int, question_key: str = "question_id", question: str = "question", more: DataFrame | None = None
) -> DataFrame:
    """Documents that share words with a question, by shared words plus dataset bonuses; the first k.

    A score depends on the dataset and on the document's words that occur in any question, nothing else. So
    documents with the same such words are one profile, of which only the first k can ever be asked for.
    Words in many profiles of a dataset are its common words, and profiles with the same common words are one class. A
    document without another word of the question has the score of its class, of which again the first k are enough.
    Profiles meet the questions in an equi-join on their other words; every profile has a document, so the first k
    profiles of a question are enough. What is common only tells how much work is done.
    `more` has further documents, or the first k of each of their profiles, in the form of `profiles`.
    """
    q = questions.select(question_key, tx.token_set(question).alias("q_tokens"))
    asked = q.select(question_key, F.explode("q_tokens").alias("token"))
    matched = profiles(docs, asked.select("token").distinct())
    if more is not None:
        matched = matched.unionByName(more)
    order = Window.partitionBy("dataset", "dataset_order", "profile").orderBy("row_key")
    kept = published(matched.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k))  # it is scanned for each of the parts below
    one, group = ["dataset", "dataset_order", "profile"], ["dataset", "dataset_order", "common"]
    words = kept.filter("nth = 1").select(*one, F.explode("profile").alias("token"))
    total = kept.filter("nth = 1").groupBy("dataset").agg(F.count(F.lit(1)).alias("total"))
    often = words.groupBy("dataset", "token").agg(F.count(F.lit(1)).alias("n")).join(total, "dataset")
    words = words.join(often.select("dataset", "token", (F.col("n") * COMMON >= F.col("total")).alias("is_common")), ["dataset", "token"])
    common = F.array_sort(F.collect_set(F.when(F.col("is_common"), F.col("token")))).alias("common")
    classes = published(words.groupBy(*one).agg(common))

    shared = classes.select(*group).distinct().withColumn("token", F.explode("common")).join(asked, "token")
    shared = shared.groupBy(question_key, *group).agg(F.count(F.lit(1)).alias("shared"))
    first = Window.partitionBy(*group).orderBy("row_key")
    leading = kept.join(classes, one).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k)
    plain = leading.join(shared, group).select(question_key, "dataset", "dataset_order", "row_key", F.col("shared").alias("overlap"))

    heads = kept.filter("nth = 1").select(*one, "row_key")
    others = words.filter(~F.col("is_common")).join(asked, "token").groupBy(question_key, *one).agg(F.count(F.lit(1)).alias("others"))
    others = others.join(classes, one).join(shared, [question_key, *group], "left").join(heads, one)
    bonuses = q.select(question_key, dataset_bonuses(F.col("q_tokens")).alias("bonuses"))
    score = F.col("overlap") + F.coalesce(F.col("bonuses")[F.col("dataset")], F.lit(0))
    scored = lambda rows: rows.join(bonuses, question_key).withColumn("score", score).drop("bonuses")
    others = scored(others.withColumn("overlap", F.col("others") + F.coalesce("shared", F.lit(0))))
    best = Window.partitionBy(question_key).orderBy(F.desc("score"), "dataset_order", "row_key")
    others = others.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).drop("nth", "row_key").join(kept, one)

    columns = [question_key, "dataset", "dataset_order", "row_key"]
    found = others.select(*columns, "overlap", "score").unionByName(scored(plain).select(*columns, "overlap", "score"))
    return _best_hits(found.groupBy(*columns).agg(F.max("overlap").alias("overlap"), F.max("score").alias("score")), k, question_key)


def retrieval_plan(questions: DataFrame, question: str = "question") -> DataFrame:
    """First five likely datasets of a question and whether it asks for a comparison."""
    t = tx.token_set(question)
    lists = F.array(
        *[F.when(_overlaps(t, words), F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>")) for words, names in PLAN_RULES]
    )
    return questions.withColumns(
        {
            "likely_datasets": F.slice(F.array_distinct(F.flatten(lists)), 1, 5),
            "comparison_requested": _overlaps(t, ["compare", "vs", "versus"]),
            "target_entities": F.array().cast("array<string>"),  # the rules name none, a model may
        }
    )


def rerank_documents(
    hits: DataFrame, docs: DataFrame, plans: DataFrame, question_key: str = "question_id", question: str = "question"
) -> DataFrame:
    """Retrieved documents in a new order: likely dataset, shared words, words of the target entities and comparison
    datasets count. Rows of one key are one document, as in the search."""
    entities = F.array_distinct(F.flatten(F.transform("target_entities", tx.tokens)))
    p = plans.select(question_key, "likely_datasets", "comparison_requested", entities.alias("e_tokens"), tx.token_set(question).alias("q_tokens"))
    asked = docs.join(hits.select("dataset", "row_key").distinct(), ["dataset", "row_key"])
    own = asked.select("dataset", "row_key", tx.token_set("values_text").alias("_tokens"))
    d = own.groupBy("dataset", "row_key").agg(F.array_distinct(F.flatten(F.collect_set("_tokens"))).alias("d_tokens"))
    score = (
        F.when(F.array_contains("likely_datasets", F.col("dataset")), 6).otherwise(0)
        + F.size(F.array_intersect("q_tokens", "d_tokens"))
        + 2 * F.size(F.array_intersect("e_tokens", "d_tokens"))
        + F.when(F.col("comparison_requested") & F.col("dataset").isin(*COMPARISON_DATASETS), 3).otherwise(0)
    )
    again = Window.partitionBy(question_key).orderBy(F.desc("new_score"), "place")
    return (
        hits.join(p, question_key)
        .join(d, ["dataset", "row_key"])
        .withColumn("new_score", score.cast("long"))
        .withColumn("new_place", F.row_number().over(again))
        .select(question_key, "new_place", "dataset", "row_key", "new_score")
    )


def evidence_table(hits: DataFrame, docs: DataFrame, fields: list[str], limit: int = 8, question_key: str = "question_id") -> DataFrame:
    """The first documents of a question with chosen fields of their rows."""
    d = docs.select("dataset", "row_key", "row_json", "product_id", "store_id")
    picked = [F.get_json_object("row_json", f"$.{f}").alias(f) for f in fields]
    return (
        hits.filter(F.col("place") <= limit)
        .join(d, ["dataset", "row_key"])
        .select(
            question_key, "place", F.col("dataset").alias("source_dataset"),
            F.col("product_id").alias("source_product_id"), F.col("store_id").alias("source_store_id"), *picked,
        )
    )


def dataset_counts(hits: DataFrame, question_key: str = "question_id") -> DataFrame:
    return hits.groupBy(question_key, "dataset").agg(F.count(F.lit(1)).alias("document_count"))


def is_follow_up(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (F.size(tx.tokens(t)) <= 3) & tx.starts_as(t, tx.FOLLOW_UPS)


def conversation_window(turns: DataFrame, last: int = 4) -> DataFrame:
    """Each turn with the lines of the turns before it, and the query a short follow-up expands to.

    Turns get dense numbers in (conversation, turn) order; every turn sends its line to the next `last`
    numbers and an equi-join on the number brings them together, so that one very long conversation is
    spread like any other rows.
    """
    body = F.trim(F.coalesce("text", F.lit("")))
    numbered = sequential_numbers(
        turns.select("conv_id", "turn", "role", body.alias("text")), ["conv_id", "turn"], "number"
    )
    sent = (
        numbered.filter("text <> ''")
        .select(
            "conv_id",
            F.struct("number", F.concat("role", F.lit(": "), "text").alias("line")).alias("item"),
            F.explode(F.sequence(F.col("number") + 1, F.col("number") + last)).alias("number"),
        )
        .groupBy("number", "conv_id")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))  # at most `last` items
    )
    lines = F.transform(F.coalesce("items", F.array().cast("array<struct<number:bigint,line:string>>")), lambda i: i["line"])
    history = F.array_join(lines, "\n")
    expand = is_follow_up(F.col("text")) & (history != "")
    query = F.when(
        expand, F.concat(F.lit("Current user question: "), "text", F.lit("\nRecent conversation context:\n"), history)
    ).otherwise(F.col("text"))
    return numbered.join(sent, ["number", "conv_id"], "left").select(
        "conv_id", "turn", history.alias("history"), F.size(lines).alias("history_turns"), query.alias("retrieval_query")
    )
