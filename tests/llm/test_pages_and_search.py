"""Main text of pages, the Merkle manifest and ranked search against plain versions."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from stockloom.llm import html_extract, lexical_search, merkle

SF = "/root/testdata/sf0.001"


# ---- main text


class _Tree(HTMLParser):
    """A plain tree of nested lists: [name, children]."""

    def __init__(self, text):
        super().__init__()
        self.root = ["#body", []]
        self.stack = [self.root]
        self.feed(text)
        self.close()

    def handle_starttag(self, name, attrs):
        if name in html_extract.VOID:
            return self.stack[-1][1].append([name, []])
        if name not in html_extract.INLINE and any(x[0] == "p" for x in self.stack):
            while self.stack.pop()[0] != "p":
                pass
        node = [name, []]
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, name):
        if any(x[0] == name for x in self.stack[1:]):
            while self.stack.pop()[0] != name:
                pass

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def _size(text):
    return len(" ".join(text.split()))


def _figures(node):
    """Characters, tags, linked characters, links of a node, recursively."""
    chars = tags = linked = links = 0
    for child in node[1]:
        if isinstance(child, str):
            chars += _size(child)
        else:
            c, t, lc, lt = _figures(child)
            chars, tags, linked, links = chars + c, tags + t, linked + lc, links + lt
    if node[0] == "a":
        linked, links = chars, links + 1
    return chars, tags + (node[0] != "#body"), linked, links


def _density(c, t, lc, lt, ratio):
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * max(lc, 1) + ratio * c + math.e)
    return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / math.log(base)


def plain_selection(text):
    """The elements that the densities select, as texts, for pages without left-out parts and articles."""
    root = _Tree(text).root
    whole = _figures(root)
    ratio = whole[2] / whole[0]
    dense = lambda n: _density(*_figures(n), ratio)

    def total(node):
        return sum(dense(c) if isinstance(c, list) else _density(_size(c), 1, _size(c) * (node[0] == "a"), node[0] == "a", ratio) for c in node[1])

    def blocks(node):
        if node[0] not in html_extract.INLINE and node[0] not in html_extract.VOID:
            yield node
        for child in node[1]:
            if isinstance(child, list):
                yield from blocks(child)

    def path(node, goal):
        if node is goal:
            return [node]
        for child in node[1]:
            if isinstance(child, list) and (found := path(child, goal)):
                return [node, *found]
        return []

    best = max(blocks(root), key=total)
    threshold = min(dense(n) for n in path(root, best))
    chosen = []

    def mark(node):
        if node is root or dense(node) >= threshold:
            chosen.append(max(blocks(node), key=total))
            for child in node[1]:
                if isinstance(child, list) and child[0] not in html_extract.INLINE and child[0] not in html_extract.VOID:
                    mark(child)

    mark(root)
    words = lambda n: [w for c in n[1] for w in (c.split() if isinstance(c, str) else words(c))]
    inside = lambda n: [n] + [x for c in n[1] if isinstance(c, list) for x in inside(c)]
    outer = [n for n in chosen if not any(n is not m and any(n is x for x in inside(m)) for m in chosen)]
    unique = [n for k, n in enumerate(outer) if not any(n is m for m in outer[:k])]
    return " ".join(w for n in sorted(unique, key=lambda n: [i for i, x in enumerate(inside(root)) if x is n][0]) for w in words(n))


SENTENCE = "Some words of a sentence that is long enough to count as prose in the body of a page. "


@pytest.mark.parametrize(
    "page",
    [
        f"<div><div><p>{SENTENCE * 4}</p><p>{SENTENCE * 2}</p><p>Short.</p></div><div><a href=a>one</a><a href=b>two</a></div></div>",
        f"<div><a href=x>Home</a> <a href=y>About us</a></div><section><div><p>{SENTENCE * 3}</p><p>{SENTENCE}<a href=k>link</a></p></div></section><div>tail</div>",
        f"<table><tr><td><a href=a>menu</a><a href=b>menu two</a></td><td><p>{SENTENCE * 5}</p><p>{SENTENCE * 5}</p></td></tr></table>",
        f"<div><p>{SENTENCE * 6}</p></div><div><p>{SENTENCE * 5}</p><p>{SENTENCE}</p></div><div><ul><li><a href=a>x</a></li><li><a href=b>y</a></li></ul></div>",
        f"<div>{SENTENCE * 3}<b>bold</b> {SENTENCE}</div><div><span>tiny</span></div>",
    ],
)
def test_densities_equal_a_plain_version(page):
    assert html_extract.main_text(page) == plain_selection(page)


def test_given_pages(spark):
    rows = html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    given = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(given)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", given[r["page_id"]]["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", article).replace("<b>", "")).split())
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), given[r["page_id"]]["url"])


def test_other_parts_leave():
    text = f"""<html><head><title>T</title><style>p{{x:1}}</style></head><body class="has-sidebar"><header><h1>Site</h1>{SENTENCE}</header>
    <div class="cookie-notice">{SENTENCE * 5}</div><nav><a href=a>menu</a></nav><div id="content"><h1>Head &amp; line</h1><div><p>{SENTENCE * 4}</p><p>It&#39;s
    a  <i>sh</i>ort&nbsp;one.</p><aside>{SENTENCE * 3}</aside><form>{SENTENCE}<input></form><p hidden>{SENTENCE}</p><script>if (a < b) "</p>"</script></div>
    <div class="ad-slot">{SENTENCE * 9}</div></div><section><h2>Comments (2)</h2><p>{SENTENCE * 7}</p></section><div class="comment-list">{SENTENCE}</div>
    <footer>{SENTENCE}</footer></body></html>"""
    assert html_extract.main_text(text) == " ".join(f"Head & line {SENTENCE * 4} It's a short one.".split())


@pytest.mark.parametrize("page", [None, "", " \n ", "<p></p>", "<script>x</script>", "<!-- never ends", "<nav>menu</nav>", "<", "<a"])
def test_pages_without_text(page):
    assert html_extract.main_text(page) in ("", page)


def test_odd_pages_end_in_time(spark):
    million = "word " * 400_000
    pages = ["<" * 100_000, '<a "' * 50_000, "<!--" * 50_000, "<div>" * 50_000 + "x", "<p>" * 50_000 + "x", "<li><b>" * 30_000 + "x", f"<p>{million}", million, "x" * 3_000_000]
    rows = [(k, None, p, 1, "c") for k, p in enumerate(pages)] + [(None, "u", None, 1, "c"), (1, "u", "<p>a<p>b", 1, "c"), (1, "u", "<p>a<p>b", 1, "c")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")
    got = html_extract.extract(table).collect()
    assert len(got) == len(rows)
    assert [r["text"] for r in got if r["url"] == "u"] == ["", "a b", "a b"]
    by = {r["page_id"]: r["text"] for r in got if r["url"] is None}
    assert by[3] == by[4] == by[5] == "x" and by[6] == by[7] == million.strip() and by[8] == "x" * 3_000_000 and by[2] == ""
    assert html_extract.extract(table.limit(0)).collect() == []


# ---- Merkle manifest


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """The result by the definition, one leaf after the other."""
    fields = lambda values: _sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
    groups = defaultdict(list)
    for r in rows:
        r = tuple(r[:5])
        text = r[1]
        shown = text.replace("\n", "") if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else text
        order = lambda t: (r[0], r[3], r[2], r[4], t)
        groups[r[3]].append((r[0], fields(order(text)), fields(order(shown))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([_sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
        return levels

    def walk(levels, place, shown):
        seen = []
        for level in levels[:-1]:
            first = place // 3 * 3
            run = level[first : first + 3]
            seen += run[: place - first] + run[place - first + 1 :]
            shown = _sha(*run[: place - first], shown, *run[place - first + 1 :])
            place //= 3
        return seen, shown

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees.append(tree([x[1] for x in groups[name]]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, name in enumerate(names):
        for place, (doc, leaf, shown) in enumerate(groups[name]):
            below, version = walk(trees[k], place, shown)
            above, version = walk(top, k, version)
            root = top[-1][0]
            out.append((doc, leaf, trees[k][-1][0], root, _sha(*below, *above), version, version == root))
    return out


def _manifest(docs, **more):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], shown, **more)


def _as_rows(got):
    key = lambda t: tuple((x is not None, x) if x is not None else (False, "") for x in t)
    return sorted((tuple(r) for r in got), key=lambda t: (str(t[0]), key(t[1:])))


@pytest.mark.parametrize("steps", [1, 2, 6])
def test_manifest_of_odd_rows(spark, odd_docs, odd_rows, steps):
    got = _manifest(odd_docs, steps=steps).drop("copied").collect()
    assert _as_rows(got) == _as_rows(plain_manifest(odd_rows))


@pytest.mark.parametrize("steps", [2, 4])
def test_manifest_of_documents(spark, docs, steps):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert _as_rows(_manifest(docs, steps=steps).drop("copied").collect()) == _as_rows(plain_manifest(rows))


def test_one_group_over_stages_and_many_groups(spark):
    big = [(k, f"a\n{k}", "en", "s", 3) for k in range(100)]
    many = [(k, f"a\n{k}", "en", f"s{k}", 3) for k in range(30)] + [(7, None, None, None, None)] * 3
    for rows in (big, many, big[:1]):
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
        assert _as_rows(_manifest(table, steps=1).drop("copied").collect()) == _as_rows(plain_manifest(rows))


def test_versions_share_untouched_nodes(spark):
    rows = [(k, f"a\n{k}", "en", "s", 3) for k in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for r in _manifest(table, steps=2, versions=True).collect():
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        assert r["verified"] == (not changed)
        assert (r["copied"] is None) == (not changed)
        if changed:  # one node a level: 100, 34, 12, 4, 2, 1
            assert len(r["copied"]) == 5 and r["copied"][-1] == r["folded_root"]


def test_manifest_of_nothing(no_docs):
    assert _manifest(no_docs).collect() == []


# ---- ranked search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k=20):
    """item_id to the k best (score, doc_id), every document scored."""
    words = lambda t: _TERM.findall((t or "").translate(_LOWER))
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    total, tokens = len(counts), sum(n for _, _, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(words(text))
    out = {}
    for item, terms in asked.items():
        scores = []
        for d, c, n in counts:
            m = 100 - 25 + 25 * n * total // tokens
            s = sum(
                times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m))
                for w, times in terms.items()
                if w in c
            )
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out[item] = [(-s, None if none else d) for s, none, d in sorted(scores)[:k]]
    return out


def _searched(docs, items, **more):
    out = defaultdict(list)
    for r in sorted(lexical_search.search(docs, items, **more).collect(), key=lambda r: r["rank"]):
        out[r["item_id"]].append((r["score"], r["doc_id"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


@pytest.mark.parametrize("block, limit, k", [(8192, 200_000, 20), (7, 200_000, 3), (64, 100, 20)])
def test_search_scores_like_all_documents(spark, docs, block, limit, k):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], k)
    got = _searched(docs.repartition(3), items, block=block, limit=limit, k=k)
    assert dict(got) == {i: rows for i, rows in want.items() if rows}


def test_search_odd_rows(spark, odd_docs, odd_rows):
    asked = [(1, "The quick FOX the"), (1, "dog"), (None, "été plage"), (2, ""), (3, None), (4, "absent"), (5, "日本語 a b c x" + "x" * 19_999), (6, "lorem end " * 3), (2, "word")]
    items = spark.createDataFrame([(i, t, 1) for i, t in asked], "item_id long, text string, n long")
    want = plain_search([(r[0], r[1]) for r in odd_rows], asked, 4)
    for block in (3, 100):
        assert dict(_searched(odd_docs, items, k=4, block=block)) == {i: rows for i, rows in want.items() if rows}


def test_search_ties_and_copies(spark):
    rows = [(k, "alpha beta") for k in range(500, 0, -1)] + [(k, "alpha") for k in range(600, 700)] + [(1000, "gamma")] * 3 + [(2000, "delta " * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "delta")], "item_id long, text string")
    assert dict(_searched(docs, items, block=50)) == plain_search(rows, [(1, "alpha beta"), (2, "beta gamma"), (3, "delta")])


def test_search_scores_few_documents(spark):
    """The bounds end the search early: one document stands out."""
    import numpy as np

    n = 5000
    doc = np.r_[np.arange(n), np.arange(0, n, 7)]
    term = np.r_[np.zeros(n, np.int64), np.ones(len(doc) - n, np.int64)]
    gain = np.where(term == 0, 10 + np.arange(len(doc)) % 50, 500)
    gain[1234] = 10_000
    best: list = []
    scored = lexical_search.Block(np.arange(n), doc, term, gain).search(np.array([0, 1]), np.array([1, 1]), best, 1)
    assert best == [(10_000, -1234)] and scored < n // 10


def test_search_of_nothing(spark, no_docs, docs):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_search.search(no_docs, items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []
