"""The registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from stockloom.llm import exact_dedup, html_extract, language_id, lexical_search, merkle, mixing, near_dedup, packing, quality, sharding, token_counts, topk_search, url_filter

SHARDS = 8
RULES = ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op1_exact_dedup",
    r"""WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY c) AS group_size,
      doc_id = first_value(doc_id) OVER w AS kept, sha256(c) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY c ORDER BY length(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), sharding.tree(SHARDS), sharding.tree(SHARDS + 1))


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), [url_filter.Rule.parse(r) for r in RULES])


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op7_near_dedup",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
    n AS (SELECT doc_id, len(sh) AS n FROM s),
    e AS (SELECT doc_id, unnest(sh) AS x FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 80 * (u.n + v.n - k)),
    both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
    SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
    FROM n JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, sf_dir, "documents"))


@query(
    "op8_topk_search",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op11_html_text")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


# the CRC-32 of a decimal number, bit by bit
_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


@query(
    "op12_merkle_manifest",
    r"""WITH RECURSIVE f AS (SELECT doc_id, source,
        concat(coalesce(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
          coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-')) AS head,
        text, CASE WHEN CRC % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown FROM documents),
    l AS MATERIALIZED (SELECT doc_id, source, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
        sha256(concat(head, coalesce(concat(strlen(shown), ':', shown), '-'))) AS shown FROM f),
    g AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) AS tree, count(*) AS n FROM l GROUP BY source),
    p AS MATERIALIZED (SELECT doc_id, leaf, shown, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS i
      FROM l JOIN g ON l.source IS NOT DISTINCT FROM g.source),
    low AS (SELECT 0 AS lvl, tree, i, n, leaf AS h FROM p
      UNION ALL SELECT lvl + 1, tree, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lvl, tree, i // 3, n),
    lows AS MATERIALIZED (SELECT * FROM low),
    sub AS MATERIALIZED (SELECT tree, h AS subroot FROM lows WHERE n = 1),
    high AS (SELECT 1000 AS lvl, tree - 1 AS i, (SELECT count(*) FROM g) AS n, subroot AS h FROM sub
      UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // 3, n),
    nodes AS MATERIALIZED (SELECT lvl, tree, i, n, h FROM lows UNION ALL SELECT lvl, 0, i, n, h FROM high),
    sib AS MATERIALIZED (SELECT x.lvl AS at, x.tree AS of, x.i AS k, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS b,
        coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS a
      FROM nodes x JOIN nodes y ON x.lvl = y.lvl AND x.tree = y.tree AND x.i // 3 = y.i // 3 GROUP BY ALL),
    walk AS (SELECT doc_id, leaf, shown, tree AS of_tree, 0 AS lvl, tree, i, n, shown AS h, '' AS proof, false AS done FROM p
      UNION ALL
      SELECT doc_id, leaf, shown, of_tree, CASE WHEN n > 1 THEN lvl + 1 ELSE 1000 END, CASE WHEN n > 1 THEN tree ELSE 0 END,
        CASE WHEN n > 1 THEN i // 3 ELSE tree - 1 END, CASE WHEN n > 1 THEN (n + 2) // 3 ELSE (SELECT count(*) FROM g) END,
        CASE WHEN n > 1 THEN sha256(concat(s.b, h, s.a)) ELSE h END, CASE WHEN n > 1 THEN concat(proof, s.b, s.a) ELSE proof END, n = 1 AND tree = 0
      FROM walk w LEFT JOIN sib s ON s.at = lvl AND s.of = tree AND s.k = i WHERE NOT done)
    SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
    FROM walk w JOIN sub ON sub.tree = w.of_tree, (SELECT h FROM high WHERE n = 1) r WHERE done""".replace("CRC", _CRC32.format("(doc_id::VARCHAR)")),
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], shown).drop("copied")


@query(
    "op13_lexical_search",
    r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
    c AS (SELECT count(*) FILTER (len(ws) > 0) AS total, sum(len(ws))::BIGINT AS tokens FROM d),
    p AS MATERIALIZED (SELECT row, w, count(*) AS tf FROM (SELECT row, unnest(ws) AS w FROM d) GROUP BY ALL),
    f AS (SELECT w, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY w, total),
    m AS (SELECT row, doc_id, 100 - 25 + ((25 * len(ws) * total) // tokens) AS m FROM d, c WHERE len(ws) > 0),
    a AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest(
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL),
    s AS (SELECT item_id, row, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM a JOIN f USING (w) JOIN p USING (w) JOIN m USING (row) GROUP BY ALL),
    r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN m USING (row) WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
