"""The corpus pipeline: quality, exact copies, near copies, mixing of sources, packing.

Every stage takes the session, the documents that the stage before it kept and the folder of the tables,
and works on all of them; its result is written as Parquet and read again for the next stage. All but
the last return the columns of `documents`. Nulls, empty texts, repeated rows and empty tables are
handled as the operators say; a row without text leaves in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from stockloom.session import published

#: Words of a shingle and percent of similarity of near copies.
SHINGLE, SIMILAR = 5, 80
#: Words of a block of the mix: long, so that documents stay whole or in few runs.
BLOCK = 256
TOKENIZER = "byte_bpe_50k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near_copies(docs, SHINGLE, SIMILAR)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole or in runs, as often as the mix of sources takes them."""
    return mixing.mixed(docs, block=BLOCK)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", good_quality),
    ("exact copies", without_copies),
    ("near copies", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Language models, signatures, draws and token ids are not SQL; a brute-force version checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = published(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
