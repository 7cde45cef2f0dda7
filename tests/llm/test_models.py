"""The quality model and language identification."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import language_id, quality

LABELS = "doc_id long, quality int, toxic int, text string"


def kneser_ney(texts):
    """log p of every n-gram end by the textbook recursion, over plain dictionaries."""
    n = quality.ORDER
    seqs = [[32] * (n - 1) + [ord(c) & 0x7FFF for c in " ".join(t.split())] for t in texts]
    counts = {n: Counter(tuple(s[k : k + n]) for s in seqs for k in range(len(s) - n + 1))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        a, b, d, e = (max(1, sum(v == m for v in c.values())) for m in (1, 2, 3, 4))
        y = a / (a + 2 * b)
        cut[k] = [min(max(x, 0.05), m - 0.05) for m, x in ((1, 1 - 2 * y * b / a), (2, 2 - 3 * y * d / b), (3, 3 - 4 * y * e / d))]
    total, lost = defaultdict(float), defaultdict(float)
    for k, c in counts.items():
        for g, v in c.items():
            total[k, g[:-1]] += v
            lost[k, g[:-1]] += cut[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        under = p(g[1:])
        if not total[k, g[:-1]]:
            return under
        v = counts[k][g]
        return ((v - cut[k][min(v, 3) - 1] if v else 0) + lost[k, g[:-1]] * under) / total[k, g[:-1]]

    return p


@pytest.mark.parametrize("entries", [10**6, 300])
def test_probabilities_equal_the_recursion(spark, odd_rows, entries):
    train = [r[1] for r in odd_rows if r[1] and len(r[1]) < 1000]
    p = kneser_ney(train)
    model = quality.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    tests = ["the lazy fox", "été 日本", "zzz ~~~ \U0001F680", "a", train[0], train[0], "", None, " \n"]
    docs = spark.createDataFrame(list(enumerate(tests[:5])) + [(5, tests[5]), (5, tests[5]), (6, ""), (7, None), (8, " \n")], "k long, text string")
    got = Counter((r.k, r.n_signs, round(r.log_p, 6)) for r in quality.log_probability(docs, model, entries).collect())
    want = Counter()
    for r in docs.collect():
        text = " ".join((r.text or "").split())
        s = [32] * (quality.ORDER - 1) + [ord(c) & 0x7FFF for c in text]
        log_p = sum(math.log(p(tuple(s[k : k + quality.ORDER]))) for k in range(len(text)))
        want[r.k, len(text), round(log_p, 6)] += 1
    assert got == want


def test_probabilities_sum_to_one():
    p = kneser_ney(["abc abd", "abcabc"])
    kinds = {ord(c) for c in "abcd "}
    assert math.isclose(sum(p((97, 98, c)) for c in kinds) + p((97, 98, 1)), 1.0, rel_tol=1e-9)


def test_junk_goes_and_trusted_text_stays(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judged(docs, labels).collect()
    good = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id: r.kept for r in rows}
    assert len(rows) == docs.count()
    assert np.mean([kept[d] for d, q in good.items() if q == 1]) > 0.98
    assert np.mean([not kept[d] for d, q in good.items() if q == 0]) > 0.8
    stay = quality.keep_good(docs, labels)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {d for d, k in kept.items() if k}


def test_rows_of_one_id_go_one_by_one(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = [r.text for r in docs.filter("length(text) > 300 AND lang = 'en'").limit(2).collect()]
    junk = "\u2603\u2604 \u2605\u2606\u2607 " * 40
    more = [(7_000_001, clean[0], "en", "x", 1), (7_000_001, junk, "en", "x", 1), (None, clean[1], "en", "x", 1), (None, junk, "en", "x", 1)]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, schema))
    kept = [(r.doc_id, r.text) for r in quality.keep_good(rows, labels).filter("doc_id = 7000001 OR doc_id IS NULL").collect()]
    assert sorted(kept, key=str) == sorted([(7_000_001, clean[0]), (None, clean[1])], key=str)


def test_the_threshold_is_the_quantile(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = {r.doc_id for r in docs.filter(~quality._trains(F.col("doc_id"))).collect()} & {r._trusted for r in quality._trusted_ids(labels).collect()}
    rows = quality.judged(docs, labels).collect()
    seen = sorted(r.perplexity for r in rows if r.doc_id in held and r.perplexity is not None)
    assert len(seen) > 10
    limit = seen[math.ceil(quality.QUANTILE * len(seen)) - 1]
    by_lang = Counter(r.lang for r in rows if r.doc_id in held)
    few = [r for r in rows if by_lang[r.lang] < quality.ENOUGH]
    assert few and all(math.isclose(r.threshold, limit) for r in few)


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    none = spark.createDataFrame([], LABELS)
    rows = quality.judged(odd_docs, none).collect()
    blank = [not (r[1] or "").split() for r in odd_rows]
    assert Counter((r.doc_id, r.kept) for r in rows) == Counter((r[0], not b) for r, b in zip(odd_rows, blank))
    assert all((r.perplexity is None) == (not r.kept) for r in rows)
    labels = spark.createDataFrame([(k, 1, 0, "x") for k in range(18)] + [(2, 0, 0, "x"), (None, 1, 0, "x"), (9, None, 1, "x")], LABELS)
    assert len(quality.judged(odd_docs, labels).collect()) == len(odd_rows)
    kept = quality.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() > 0
    assert quality.judged(no_docs, none).count() == 0 and quality.keep_good(no_docs, none).count() == 0


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert Counter(r.doc_id for r in rows) == Counter(lang.keys())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = np.mean([r.lang_pred == lang[r.doc_id] for r in held])
    assert right > 0.97
    assert abs(np.mean([r.score for r in held]) - right) < 0.05


def test_languages_of_odd_documents(odd_docs, odd_rows, no_docs):
    rows = language_id.identify(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    said = {(r.doc_id, r.lang_pred == "und") for r in rows}
    for doc_id, text in (r[:2] for r in odd_rows):
        if doc_id != 3:
            assert (doc_id, not any(c.isalpha() for c in text or "")) in said
    assert language_id.identify(no_docs).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd_docs, language_id.train(no_docs)).collect()} == {"und"}


def test_lang_is_no_input_of_a_prediction(docs):
    from pyspark.sql import functions as F

    model = language_id.train(docs)
    a = language_id.identify(docs, model).collect()
    b = language_id.identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), model).collect()
    assert sorted(a) == sorted(b)


def test_the_leader_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        y = k % 3
        at = np.unique(np.r_[rng.integers(0, 50, 5), 100 + y])
        rows.append((at, np.ones(len(at)), y))
    weights, bias = language_id.ftrl(rows, 128, 3, l1=0.5)
    assert (weights[110:] == 0).all() and (weights[:50] == 0).mean() > 0.2
    assert np.mean([(x @ weights[at] + bias).argmax() == y for at, x, y in rows]) == 1.0
