"""Exact and near copies against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import components as cc
from stockloom.llm import exact_dedup as ex
from stockloom.llm import near_dedup as nd


def content(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[content(text)].append((len(text or ""), doc_id))
    out = []
    for c, members in groups.items():
        best = min(members, key=lambda m: (-m[0], m[1] is None, m[1] or 0))
        stays = 1
        for m in members:
            out.append((m[1], best[1], len(members), m == best and stays == 1, hashlib.sha256(c.encode()).hexdigest()))
            stays -= m == best
    return Counter(out)


@pytest.mark.parametrize("salts", [1, 16])
def test_exact_copies(odd_docs, odd_rows, salts):
    got = Counter(map(tuple, ex.copies(odd_docs, salts=salts).collect()))
    assert got == expected_copies([r[:2] for r in odd_rows])


def test_contents_that_share_a_digest(odd_docs, odd_rows):
    weak = lambda c: (F.char_length(c) % 3).cast("string")
    got = Counter(map(tuple, ex.copies(odd_docs, digest=weak).collect()))
    assert got == expected_copies([r[:2] for r in odd_rows])
    kept = ex.drop_copies(odd_docs, digest=weak)
    assert sorted(content(r.text) for r in kept.collect()) == sorted({content(r[1]) for r in odd_rows})


def test_kept_rows_keep_their_columns(odd_docs, odd_rows, no_docs):
    kept = ex.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert sorted(content(r[1]) for r in rows) == sorted({content(r[1]) for r in odd_rows})
    assert set(rows) <= set(odd_rows)
    assert ex.drop_copies(no_docs).count() == 0 and ex.copies(no_docs).count() == 0


def sets_of(rows, width):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
        out.append((doc_id, frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()))
    return out


def expected_near(rows, width):
    """(doc_id, shingles, component) of rows with an id, by comparing all pairs."""
    sets = [x for x in sets_of(rows, width) if x[0] is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return Counter((d, len(s), root(d), root(d) == d) for d, s in sets)


@pytest.mark.parametrize("width", [2, 5])
def test_near_copies(odd_docs, odd_rows, width):
    got = [tuple(r) for r in nd.near_copies(odd_docs, width).collect()]
    assert Counter(r for r in got if r[0] is not None) == expected_near([r[:2] for r in odd_rows], width)
    assert all(r[2] is None and r[3] for r in got if r[0] is None) and len(got) == len(odd_rows)


def test_near_copies_of_given_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter(map(tuple, nd.near_copies(docs).collect()))
    assert got == expected_near(rows, 2)
    assert sum(not r[3] for r in got) > 10


def _family(seed, n, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 10_000, 120)]
    for _ in range(n):
        words = list(base)
        for k in rng.integers(0, len(words), rng.integers(0, edits)):
            words[k] = f"e{rng.integers(0, 10**6)}"
        yield " ".join(words)


def test_large_families_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "FAMILY", 16)
    rows = [(k, t) for k, t in enumerate([*_family(1, 90, 9), *_family(2, 60, 14), *_family(3, 40, 3)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, nd.near_copies(docs).collect())) == expected_near(rows, 2)


def test_links_of_a_family_are_exact():
    sets = [np.array(sorted({hash(x) & (2**63 - 1) for x in s}), np.uint64) for _, s in sets_of(list(enumerate(_family(4, 80, 16))), 2)]
    got = nd.linked(sets)
    want = np.arange(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                want[want == want[a]] = want[b]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_keys_find_every_pair_within_the_distance():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    slots, most = nd.CHUNKS * nd.SLOTS, nd.CHUNKS * (nd.ERRORS + 1) - 1
    for _ in range(50):
        a = rng.integers(0, 1 << 16, slots).astype("<u2")
        b = a.copy()
        b[rng.choice(slots, most, replace=False)] ^= np.uint16(1)
        batch = pa.RecordBatch.from_pydict({"id": [1, 2], "sign": [a.tobytes(), b.tobytes()]})
        keys = defaultdict(set)
        for out in nd._keys([batch]):
            for key, who in zip(out.column("key").to_pylist(), out.column("id").to_pylist()):
                keys[key].add(who)
        assert any(len(w) == 2 for w in keys.values())


def test_dropping_near_copies(odd_docs, no_docs):
    kept = nd.drop_near_copies(odd_docs, 2)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert 14 not in ids and 13 in ids and ids[None] == 2 and 4 in ids
    assert nd.drop_near_copies(no_docs).count() == 0 and nd.near_copies(no_docs).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 200), (300, 200), (7, 7), (500, 400), (500, 400)]
    got = {r.id: r.root for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100, 400: 400, 500: 400}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0
