"""The pipeline's stages, one after the other, and its registered queries against their SQL."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from compare import compare, connect
from stockloom.llm import exact_dedup, near_dedup, packing, quality
from stockloom.llm.queries import ORACLES, QUERIES
from stockloom.session import published

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    assert [n for n, _ in cp.STAGES] == ["quality", "exact copies", "near copies", "mixing", "packing"]
    now = docs
    for name, stage in cp.STAGES:
        before, now = now, published(stage(spark, now, SF))
        if name == "packing":
            break
        assert now.columns == docs.columns, name
        was = {r.doc_id: r for r in before.collect()}
        rows = now.collect()
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            want = {r.doc_id for r in quality.judged(before, labels).collect() if r.kept}
        elif name == "exact copies":
            want = {r.doc_id for r in exact_dedup.copies(before).collect() if r.kept}
        elif name == "near copies":
            want = {r.doc_id for r in near_dedup.near_copies(before, cp.SHINGLE).collect() if r.kept}
        else:
            for r in rows:
                assert r.source == was[r.doc_id].source and " ".join(r.text.split()) in " ".join(was[r.doc_id].text.split())
            continue
        assert Counter(r.doc_id for r in rows) == Counter(want) and all(r == was[r.doc_id] for r in rows), name
    assert Counter(r.doc_id for r in now.collect() if r.piece == 0) == Counter(r.doc_id for r in before.collect())
    got = Counter(tuple(r)[:5] for r in cp.run(spark, SF).collect())
    assert got == Counter(tuple(r)[:5] for r in now.collect())


def test_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd_docs, no_docs):
        now = published(table)
        for _, stage in cp.STAGES:
            before, now = now, published(stage(spark, now, str(tmp_path)))
        assert (now.count() > 0) == (table is odd_docs) and before.columns == table.columns
        assert now.columns == packing.pack(no_docs, packing_vocabulary()).columns


def packing_vocabulary():
    import public_tokenizers

    return public_tokenizers.path(cp.TOKENIZER)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    df = lambda s, d: QUERIES[name](s, d).selectExpr(*(f"CAST({c} AS LONG) {c}" if t == "int" else c for c, t in QUERIES[name](s, d).dtypes))
    sql = ORACLES[name]
    if name == "op8_topk_search":
        sql = sql.replace("rank::INTEGER", "rank::BIGINT")
    assert compare(spark, con, df, sql, SF) == ""


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: (n == "pipeline", int("0" + "".join(c for c in n.split("_")[0] if c.isdigit()))))] == [*(f"op{k}" for k in range(1, 11)), "pipeline"]
