"""Text normalisation, tokens and keyword rules as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stockloom.functions.exprs import col

# Typing errors put right word by word.
TYPOS = {
    "solt": "sold",
    "seling": "selling",
    "higest": "highest",
    "lowst": "lowest",
    "hyderabadd": "hyderabad",
    "vijaywada": "vijayawada",
}


def normalized(c) -> Column:
    """Lower-case letters, digits and single blanks, with known typing errors put right."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9]+", " ")), " ")
    fixes = F.create_map(*[F.lit(x) for pair in TYPOS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(fixes[w], w)), " ")


def tokens(c) -> Column:
    """Lower-case runs of letters and digits of any script, with repeats."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def token_set(c) -> Column:
    return F.array_distinct(tokens(c))


def has_any(c: Column, phrases) -> Column:
    """Any phrase as a substring."""
    found = F.lit(False)
    for p in phrases:
        found = found | c.contains(p)
    return found


def starts_as(c: Column, words) -> Column:
    """Equal to a word, or a word followed by a blank at the start."""
    found = F.lit(False)
    for w in words:
        found = found | (c == w) | c.startswith(f"{w} ")
    return found


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def requested_limit(text: Column, default: int = 5, maximum: int = 10) -> Column:
    """`top N`, `least N`, `lowest N`, `highest N`, else `N items`; clamped to 1..maximum."""
    patterns = [r"\btop\s+(\d+)\b", r"\bleast\s+(\d+)\b", r"\blowest\s+(\d+)\b", r"\bhighest\s+(\d+)\b",
                r"\b(\d+)\s+(?:items|item|products|product)\b"]
    first = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])
    asked = F.coalesce(first.try_cast("long"), F.when(first.isNotNull(), F.lit(maximum).cast("long")), F.lit(default).cast("long"))
    return F.greatest(F.lit(1).cast("long"), F.least(asked, F.lit(maximum).cast("long")))


# --- message classes --------------------------------------------------------------------------

# Keyword lists of the message and question rules.
GREETINGS = ["hi", "hello", "hai", "hey", "hii", "good morning", "good evening"]
FOLLOW_UPS = ["why", "how", "explain", "what about", "and", "then"]
ANALYTICAL_WORDS = [
    "least", "lowest", "worst", "most", "highest", "best", "top", "low stock", "sales", "sold", "product", "store", "city",
    "inventory",
]
BUSINESS_WORDS = [
    "inventory", "stock", "sales", "supplier", "suppliers", "recommendation", "recommendations", "store", "stores",
    "product", "products", "reorder", "transfer", "discount",
]
IRRELEVANT_WORDS = [
    "movie", "movies", "weather", "song", "songs", "cricket", "football", "actor", "actress", "joke",
]
TRANSFER_ROUTE_TERMS = [
    "transfer", "stock balancing", "shortage", "excess stock", "surplus", "extra stock", "more stock", "surplus stock",
    "redistribution", "redistribute", "source store", "target store", "low stock branch", "stockout risk", "stock out risk",
    "exclusive", "only available", "alternative", "alternatives", "offer instead",
]
RANKING_PHRASES = [
    "top selling", "least selling", "best selling", "most sold", "least sold", "highest sales", "lowest sales",
    "highest selling", "lowest selling", "fastest moving", "top products by revenue", "top items by revenue",
]
RANKING_NOUNS = ["selling", "sold", "sales", "revenue", "items", "products", "product"]
TRANSFER_PHRASES = [
    "transfer", "stock balancing", "stock balance", "shortage", "excess stock", "surplus", "redistribution", "redistribute",
    "source store", "target store", "low stock branch", "needs transfer", "need transfer", "stockout risk", "stock out risk",
    "branch has excess", "store has excess",
]
AVAILABILITY_PHRASES = [
    "exclusive", "exclusively available", "only available", "only in", "alternative product", "alternative products",
    "alternatives", "offer instead", "what can we offer instead",
]
SURPLUS_PHRASES = [
    "extra stock", "surplus stock", "surplus products", "products have surplus", "store has surplus", "has more stock",
    "more stock for", "available in higher quantity",
]


def message_class(c) -> Column:
    t = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return (
        F.when(t == "", "unclear")
        .when(starts_as(t, GREETINGS), "greeting")
        .when((word_count(t) <= 3) & starts_as(t, FOLLOW_UPS), "follow_up")
        .when(has_any(t, ANALYTICAL_WORDS), "analytical_query")
        .when(has_any(t, BUSINESS_WORDS), "business_query")
        .when(has_any(t, IRRELEVANT_WORDS), "irrelevant")
        .otherwise("unclear")
    )


def routed_to_transfer(c) -> Column:
    return has_any(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), TRANSFER_ROUTE_TERMS)


def is_sales_ranking(t: Column) -> Column:
    counted = t.rlike(r"\btop\s+\d+\b") | t.rlike(r"\b(least|lowest)\s+\d+\b")
    return has_any(t, RANKING_PHRASES) | (counted & has_any(t, RANKING_NOUNS))


def question_intent(t: Column, has_store: Column, has_category: Column) -> Column:
    """Analytic intent of a normalised question; the first rule that fits decides, blank when none does."""
    sold = has_any(t, ["sold", "sales"])
    transfer = has_any(t, TRANSFER_PHRASES)
    plural = has_any(t, ["top ", "items", "products"])
    least = has_any(t, ["least sold", "lowest sold", "worst selling", "least selling"])
    most = has_any(t, ["top selling", "best selling", "highest sold", "most sold"])
    high_sales = has_any(t, ["highest sales", "top sales", "most sales"])
    by_scope = lambda word: (
        F.when(has_category, f"{word}_sold_product_by_category")
        .when(has_store & plural, f"{word}_sold_products_ranked_by_store")
        .when(has_store, f"{word}_sold_product_by_store")
        .otherwise("product_performance")
    )
    rules = [
        (
            has_any(t, AVAILABILITY_PHRASES),
            F.when(has_any(t, ["alternative", "alternatives", "instead", "offer"]), "alternative_options").otherwise(
                "exclusive_availability"
            ),
        ),
        (has_any(t, SURPLUS_PHRASES), F.lit("surplus_stock")),
        (has_any(t, ["category wise inventory", "category inventory", "category wise stock"]), F.lit("category_inventory")),
        (has_any(t, ["highest inventory", "highest stock", "most inventory"]), F.lit("store_inventory_comparison")),
        (has_any(t, ["overstock"]), F.lit("store_overstock")),
        (has_any(t, ["understock"]), F.lit("store_understock")),
        (transfer & ~has_any(t, ["agent", "why did"]), F.lit("transfer_analysis")),
        (has_any(t, ["recommendation", "recommend", "suggest", "agent", "why did"]), F.lit("recommendation_question")),
        (has_any(t, ["supplier"]), F.lit("supplier_risk")),
        (transfer, F.lit("transfer_analysis")),
        (is_sales_ranking(t), F.lit("sales_ranking")),
        (t.rlike(r"\bleast\s+\d+\b") & sold & has_store, F.lit("least_sold_products_ranked_by_store")),
        (t.rlike(r"\btop\s+\d+\b") & sold & has_store, F.lit("top_sold_products_ranked_by_store")),
        (least, by_scope("least")),
        (most, by_scope("top")),
        (has_store & high_sales, F.lit("top_sold_products_ranked_by_store")),
        (has_category & high_sales, F.lit("top_sold_product_by_category")),
        (has_category & has_any(t, ["lowest sales", "least sales"]), F.lit("least_sold_product_by_category")),
        (has_any(t, ["low stock", "below reorder"]), F.lit("low_stock_by_store")),
        (t.contains("compare") & t.contains("store"), F.lit("sales_summary_by_store")),
        (
            t.contains("sales") & ~(t.contains("product") & has_any(t, ["performance", "performing"])),
            F.lit("sales_summary_by_store"),
        ),
        (has_any(t, ["perform", "sales of"]), F.lit("product_performance")),
        (has_any(t, ["inventory", "stock"]), F.lit("general_inventory_question")),
    ]
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise("")


def ranking_direction(t: Column) -> Column:
    return F.when(has_any(t, ["least", "lowest", "worst selling"]), "ascending").otherwise("descending")


def ranking_metric(t: Column) -> Column:
    return F.when(has_any(t, ["revenue", "sales value", "sales amount"]), "revenue").otherwise("quantity")


def ranking_entity(t: Column, has_category: Column) -> Column:
    return F.when(t.contains("category") & ~has_category, "category").otherwise("product")


def time_scope(t: Column) -> Column:
    """The period that a question names; blank when none."""
    week = has_any(t, ["this week", "last 7 days", "past 7 days"])
    return F.when(week, "last_7_days").when(t.contains("today"), "today").otherwise("")


def transfer_kind(t: Column) -> Column:
    """Whether a question about transfers is after surpluses, shortages or (the top) opportunities."""
    return (
        F.when(has_any(t, ["surplus", "excess stock"]), "surplus")
        .when(has_any(t, ["shortage", "stockout risk", "stock out risk", "low stock branch"]), "shortage")
        .when(has_any(t, ["top", "best"]), "top")
        .otherwise("recommended")
    )


def names_a_place(t: Column) -> Column:
    """Whether the question ends with `in`, `at` or `for` and some words."""
    return t.rlike(r"\b(in|at|for)\s+[a-z][a-z0-9\s]{2,}$")
