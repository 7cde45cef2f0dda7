"""Sharding, mixing, search and the URL filter against brute force."""

import math
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import mixing, sharding, topk_search, url_filter
from stockloom.llm.numbering import numbered


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_numbers_do_not_depend_on_blocks(spark, blocks):
    rows = spark.createDataFrame([(k % 3 if k % 5 else 0, k) for k in range(200)], "g int, k long")
    got = numbered(rows, "g", [F.col("k")], "at", blocks).collect()
    assert {(r.g, r.k): r["at"] for r in got} == {(r.g, r.k): r["at"] for r in numbered(rows, "g", [F.col("k")], "at", 1).collect()}
    for g in (0, 1, 2):
        assert sorted(r["at"] for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


def test_shards(odd_docs, odd_rows, no_docs):
    rows = sharding.shard(odd_docs, sharding.tree(8), sharding.tree(9)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert all(r.law == "key" and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8) for r in rows)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in rows}) == len({r.doc_id for r in rows})
    assert sharding.shard(no_docs, sharding.tree(8)).count() == 0


def test_weights_and_movement(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    leaves = [sharding.Leaf("a", "a1", 0, 1), sharding.Leaf("a", "a2", 1, 3), sharding.Leaf("b", "b1", 2, 2), sharding.Leaf("b", "b1", 3, 2)]
    heavier = [*leaves[:3], sharding.Leaf("b", "b1", 3, 6)]
    rows = keys.select(sharding.place(F.col("key"), leaves).alias("x"), sharding.place(F.col("key"), heavier).alias("y")).collect()
    share = Counter(r.x for r in rows)
    for leaf in leaves:
        assert abs(share[leaf.shard] / 20_000 - leaf.weight / 8) < 0.02
    # only subtrees whose weights changed gain or lose: nothing moves inside region a, nothing moves into it
    assert all(r.x == r.y for r in rows if r.y in (0, 1))
    assert all(r.x in (2, 3) or r.y in (2, 3) for r in rows if r.x != r.y)
    assert abs(Counter(r.y for r in rows)[3] / 20_000 - 6 / 12) < 0.02


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected_targets(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, low, high = sum(sizes.values()), 0.0, 1e12
    for _ in range(200):  # the level of the water
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * sizes[s], level * weight[s]) for s in order) < total else (low, level)
    return sizes, {s: min(3 * sizes[s], high * weight[s]) for s in order}


def test_targets_and_taken_words(odd_docs, odd_rows, no_docs):
    rows = mixing.taken(odd_docs, block=8).collect()
    sizes, goal = expected_targets([(r[0], r[1], r[3]) for r in odd_rows])
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r[0], words(r[1])) for r in odd_rows)
    for r in rows:
        of = [x[3] for x in odd_rows if (x[0], words(x[1])) == (r.doc_id, r["size"])]
        assert any(r.source_size == sizes[s] and math.isclose(r.target, goal[s], rel_tol=1e-9, abs_tol=1e-6) for s in of)
        assert 0 <= r.taken <= 3 * r["size"]
    assert mixing.taken(no_docs).count() == 0


def test_the_mix_meets_its_targets_and_repeats(docs):
    rows = mixing.taken(docs).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.taken(docs.repartition(5)).collect()))
    sums = defaultdict(int)
    for r in rows:
        assert r.taken <= 3 * r["size"]
        sums[r.source_size, r.target] += r.taken
    for (_, target), n in sums.items():
        assert abs(n - target) <= max(0.04 * target, 2 * mixing.BLOCK)


def test_the_mixed_rows_are_the_words_taken(docs):
    from stockloom.session import published

    mixed = published(mixing.mixed(docs, block=32))
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += words(r.text)
        assert r.n_chars == len(r.text)
    want = {r.doc_id: r.taken for r in mixing.taken(docs, block=32).collect() if r.taken}
    assert dict(got) == want


def test_mixing_odd_rows(odd_docs, odd_rows, no_docs):
    mixed = mixing.mixed(odd_docs, block=8)
    assert mixed.columns == odd_docs.columns
    n = sum(words(r.text) for r in mixed.collect())
    assert n == sum(r.taken for r in mixing.taken(odd_docs, block=8).collect()) > 0
    assert mixing.mixed(no_docs).count() == 0


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key)).tolist()) == list(range(n))


def expected_top(vectors, k, is_query):
    whole = {}
    for vec_id, v in vectors:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = [math.floor(256 * x) for x in v]
        packed = np.array(row, "<i4").tobytes()
        if vec_id not in whole or packed < whole[vec_id][1]:
            whole[vec_id] = (row, packed)
    out = []
    for q in whole:
        if is_query(q):
            scores = [(-sum(a * b for a, b in zip(whole[q][0], row)), o) for o, (row, _) in whole.items() if o != q and len(row) == len(whole[q][0])]
            out += [(q, rank, o, -s) for rank, (s, o) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("candidates,queries", [(8192, 1024), (7, 3)])
def test_search_of_odd_vectors(spark, candidates, queries):
    rng = np.random.default_rng(1)
    vectors = [(k, [float(x) for x in rng.normal(0, 0.2, 6)]) for k in range(120)]
    vectors += [(200 + k, [0.5] * 6) for k in range(40)] + [(500, [3.0] * 6), (500, [1.0] * 6), (501, [0.0] * 6), (502, [1.0, 2.0]), (504, [1.0, 1.0])]
    vectors += [(503, None), (None, [1.0] * 6), (505, [1.0] * 5 + [float("nan")]), (506, [1.0] * 5 + [float("inf")]), (507, [1.0] * 5 + [None]), (0, vectors[0][1])]
    table = spark.createDataFrame([(a, b, 1, "x") for a, b in vectors], "vec_id long, embedding array<float>, score int, vector string")
    exact = [(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b]) for a, b in vectors]
    got = topk_search.top_k(table, F.col("vec_id") % 2 == 0, candidates=candidates, queries=queries).collect()
    assert sorted(map(tuple, got)) == expected_top(exact, 5, lambda i: i % 2 == 0)
    assert topk_search.top_k(table.limit(0), F.col("vec_id") % 2 == 0).count() == 0


@pytest.mark.parametrize("candidates,queries", [(8192, 1024), (9, 4)])
def test_search_of_large_components(spark, candidates, queries):
    rng = np.random.default_rng(2)
    vectors = [(0, [600000.0, 1.0]), (1, [1.0, 2.0]), (50, [-3.0, 0.5])] + [(2 + k, [float(x) for x in rng.normal(0, 10.0 ** (k % 9), 2)]) for k in range(40)]
    vectors += [(60, [1e300, 1.0]), (61, [-1e308, 1e308]), (62, [2.0**30, 2.0**30]), (64, [float("-inf"), 1.0])]
    got = topk_search.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0, candidates=candidates, queries=queries).collect()
    rows = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i not in (61, 64)}
    rows[61] = [-int(sys.float_info.max), int(sys.float_info.max)]  # 256 times the component is no double
    as_long = lambda x: min(max(x, 1 - (1 << 63)), (1 << 63) - 1)
    want = []
    for q in rows:
        if q % 2 == 0:
            scores = sorted((-as_long(sum(a * b for a, b in zip(rows[q], row))), o) for o, row in rows.items() if o != q)
            want += [(q, rank, o, -s) for rank, (s, o) in enumerate(scores[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_the_threshold_ends_the_search_early():
    rows = np.zeros((5000, 4), np.int32)
    rows[:, 0] = np.arange(5000)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1:
                seen.append(len(at))
            return np.asarray(super().__getitem__(at))

    q, r, s = topk_search.threshold_search(rows.view(Counted), np.arange(5000), np.array([[1, 0, 0, 0]], np.int32), np.array([-1]), 3)
    assert r.tolist() == [4999, 4998, 4997]


RULES = [url_filter.Rule.parse(r) for r in ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")]


def expected_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best


PAGES = [
    (1, "http://a.net/x?q#f", ""),
    (2, "https://WWW.Example.NET/en/1", '<a href="http://good.io/p">x</a> <a href=//good2.io>y</a>'),
    (3, "http://example.com/de/#top", ""),
    (4, "http://shop.example.com", '<A HREF = "http://a.net/">bad</A>'),
    (5, "http://good.io/", '<a href="http://shop2.io/">'),
    (6, "http://linker.io/page", '<a href="http://a.net/1"><a href="http://example.com/de/2"><img src="https://a.net/i.png">'),
    (7, "http://x.org/fr/1", None),
    (8, "http://notnet/x", ""),
    (9, None, "<a href='http://a.net/'>"),
    (10, "no host", ""),
    (11, "HTTP://net/", ""),
    (12, "ftp://u@h:1/p?x=://y/", ""),
    (13, "x://a\nb/c\nd", ""),
    (None, "http://linker.io/other", None),
    (6, "http://linker.io/page", '<a href="http://good.io/">'),
]


def expected_blocked(pages, threshold=url_filter.THRESHOLD):
    seeds, links = {"trust": Counter(), "distrust": Counter()}, Counter()
    for _, url, html in pages:
        host, _, rule = expected_rule(url)
        if rule:
            seeds["trust" if rule.verdict == "allow" else "distrust"][host] += 1
        found = {re.sub(r"^[^@]*@|:\d*$", "", x).lower() for x in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html or "")}
        for dst in found:
            if host and dst and dst != host:
                links[host, dst] += 1
    score = {}
    for kind, edges in (("trust", links), ("distrust", Counter({(b, a): n for (a, b), n in links.items()}))):
        total = sum(seeds[kind].values())
        base = {h: n / total for h, n in seeds[kind].items()}
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        now = dict(base)
        for _ in range(url_filter.ROUNDS):
            new = defaultdict(float, {h: 0.15 * x for h, x in base.items()})
            for (a, b), n in edges.items():
                new[b] += 0.85 * now.get(a, 0.0) * n / out[a]
            now = new
        score[kind] = now
    mean = 1 / max(1, len(seeds["distrust"]))
    return {h for h, x in score["distrust"].items() if x > score["trust"].get(h, 0.0) and x >= threshold * mean}


def test_url_filter(spark):
    pages = spark.createDataFrame([(*p, "s", 0.5) for p in PAGES], "page_id long, url string, html string, host string, score double")
    got = Counter(map(tuple, url_filter.judge(pages, RULES).collect()))
    bad = expected_blocked(PAGES)
    assert "linker.io" in bad and "good.io" not in bad
    want = Counter()
    for page_id, url, _ in PAGES:
        host, path, rule = expected_rule(url)
        want[page_id, host, path, rule and rule.name, rule.verdict if rule else "block" if host in bad else "allow"] += 1
    assert got == want
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_scores_have_converged(spark):
    """On a chain towards a blocked host and on a graph with cycles, against the solved linear system."""
    chain = [(0, "http://h0.io/", "")] + [(k, f"http://h{k}.io/", f'<a href="http://h{k - 1}.io/">') for k in range(1, 12)]
    pages = spark.createDataFrame(chain, "page_id long, url string, html string")
    rules = [url_filter.Rule("block", "h0.io")]
    bad = {r.page_id for r in url_filter.judge(pages, rules).collect() if r.verdict == "block"}
    assert bad == {0} | {k for k in range(1, 12) if 0.15 * 0.85**k >= url_filter.THRESHOLD} == set(range(7))
    links = [("a", "b", 2), ("b", "c", 1), ("c", "a", 3), ("c", "d", 1), ("d", "e", 1), ("e", "d", 2), ("b", "e", 1)]
    names = "abcde"
    seeds = {("trust", "a"): 0.25, ("trust", "d"): 0.75, ("distrust", "e"): 1.0}
    got = url_filter.propagated(
        spark.createDataFrame(links, "src string, dst string, n long"),
        spark.createDataFrame([(*k, x) for k, x in seeds.items()], "kind string, host string, share double"),
    )
    got = {(r.kind, r.host): r.score for r in got.collect()}
    for kind in ("trust", "distrust"):
        step = np.zeros((5, 5))
        for a, b, n in links:
            a, b = (names.index(a), names.index(b)) if kind == "trust" else (names.index(b), names.index(a))
            step[b, a] += n
        step /= np.maximum(step.sum(0), 1)
        want = np.linalg.solve(np.eye(5) - 0.85 * step, 0.15 * np.array([seeds.get((kind, h), 0.0) for h in names]))
        assert np.allclose([got.get((kind, h), 0.0) for h in names], want, atol=1e-6)


def test_url_filter_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = url_filter.judge(pages, RULES).collect()
    for r, p in zip(sorted(rows, key=lambda r: r.page_id), sorted(pages.collect(), key=lambda p: p.page_id)):
        host, path, rule = expected_rule(p.url)
        assert (r.page_id, r.host, r.path, r.rule) == (p.page_id, host, path, rule and rule.name)
