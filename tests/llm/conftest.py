"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest

LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [
    "the quick brown fox jumps over the lazy dog",
    "The  quick brown\tfox jumps over the lazy dog",
    "the quick brown fox jumps over the lazy dog",
    "",
    None,
    " \n\t ",
    "word",
    "Word",
    "été à la plage, le soleil brille sur la mer",
    "été à la plage, le soleil brille sur la mer et le sable",
    LONG,
    LONG + "end",
    "x" * 20_000,
    "a b c d e f g h i j k l m n o p q r s t u v w x y z",
    "a b c d e f g h i j k l m n o p q r s t u v w x y zz",
    "日本語 の テキスト <|endoftext|> </s> 😀😀",
    "1234 5678 !!! ???",
    "nul\x00 char  and  spaces ",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row string, _id long, size int, n long, slot int, print string"


def _row(k, text, lang="en", source="s0"):
    return (k, text, lang, source, None if text is None else len(text), "x", 1, 2, 3, 4, "p")


@pytest.fixture(scope="session")
def odd_rows():
    rows = [_row(k, t, ["en", "fr", None][k % 3], ["s0", "s1", None, "s2"][k % 4]) for k, t in enumerate(TEXTS)]
    return [*rows, _row(None, TEXTS[0]), _row(None, None), _row(3, ""), rows[0], _row(-5, TEXTS[8])]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
