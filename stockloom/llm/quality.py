"""Quality by the perplexity of an interpolated modified Kneser-Ney character model.

The model counts character n-grams of up to ORDER characters in trusted text: documents whose labels say
quality 1 and not toxic. Counts, continuation counts, discounts and back-off weights are made by
aggregations and joins that are sharded by n-gram and by context. A document's log-probability is a sum
over its n-grams in which every table entry counts alone: an n-gram of length k that was seen adds
`gain` = log p_k - log(back-off) - log p_(k-1), and as the context of the next character it adds `back`,
the log of its back-off weight. So the model can be cut into shards of at most ENTRIES rows; each shard is
sent to the executors and joined with all documents, and the partial sums are added. A model below that
size is one shard, and then no document moves.

Half of the trusted documents, by a hash of the id, train the model; the other half sets the thresholds:
a document is rejected when its perplexity exceeds `slack` times the `quantile` of the trusted perplexities
of its language. Languages with fewer than ENOUGH such documents take the threshold of all.

Edge cases: white-space runs count as one space. A document without any other character has a null
perplexity and is rejected. Without trusted text nothing can be judged, so every other document is kept.
A null lang is a language of its own. A null doc_id is never trusted. Rows that repeat a doc_id are scored
each. Texts are read whole. An empty table gives an empty result; further columns are carried by
`keep_good` and ignored by `judged`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stockloom.session import published

ORDER = 4
#: Bits of a character in an n-gram; code points beyond are folded.
BITS = 15
#: Entries of a shard of the model.
ENTRIES = 4_000_000
QUANTILE = 0.99
#: Factor on the quantile; at 1.0 the quantile itself is the threshold.
SLACK = 1.0
ENOUGH = 50
#: Characters that are counted or scored together.
CHUNK = 1 << 21
#: Size of the table of scores by n-gram that a worker keeps, as a power of two.
MEMO_BITS = 21

_MASK = (1 << BITS) - 1


def symbols(text: str | None) -> np.ndarray:
    """Characters with single spaces; empty if there are no others."""
    return np.frombuffer(" ".join((text or "").split()).encode("utf-32-le", "replace"), np.uint32).astype(np.int64) & _MASK


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of full order that end at each character of each text, and the characters of each text.

    Every text starts after ORDER - 1 spaces.
    """
    pad = np.full(ORDER - 1, 32, np.int64)
    parts = [symbols(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate([x for p in parts for x in (pad, p)] + [np.array([], np.int64)])
    keys = flat.copy()
    for k in range(1, ORDER):
        keys[k:] |= flat[:-k] << (BITS * k)
    inside = np.ones(len(flat), bool)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    for k in range(ORDER - 1):
        inside[starts + k] = False
    return keys[inside], sizes


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about CHUNK characters, with the place of the first."""
    some, first, size = [], 0, 0
    for k, text in enumerate(texts):
        some.append(text.as_py())
        size += len(some[-1] or "")
        if size >= CHUNK:
            yield first, some
            some, first, size = [], k + 1, 0
    if some:
        yield first, some


def gram_counts(texts: DataFrame) -> DataFrame:
    """key, c of the n-grams of full order, summed per chunk before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in _chunks(batch.column("text")):
                keys, n = np.unique(grams(some)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "c"])

    return texts.select("text").mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _suffix(key: Column, length: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (BITS * length)) - 1))


def _context(key: Column) -> Column:
    return F.shiftright(key, BITS)


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of one order, from the numbers of n-grams seen one to four times."""
    row = counts.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (max(1, row[f"n{k}"]) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(x, 0.05), k - 0.05) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def fit(texts: DataFrame) -> DataFrame:
    """size, key, gain, back of every n-gram of 1 to ORDER characters; size 0 is the one row of the empty n-gram,
    whose `back` holds the log-probability of an unseen character."""
    counts = {ORDER: published(gram_counts(texts))}
    for n in range(ORDER - 1, 0, -1):  # how many different characters stand before an n-gram
        lower = counts[n + 1].groupBy(_suffix(F.col("key"), n).alias("key")).agg(F.count("*").alias("c"))
        counts[n] = published(lower)
    kinds = counts[1].count()
    base = float(np.log(1.0 / (kinds + 1)))
    below = None
    tables = []
    for n in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[n])
        rows = counts[n].select("key", "c", _context(F.col("key")).alias("context"))
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        contexts = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum(cut).alias("cut"))
        contexts = contexts.withColumn("back", F.log(F.col("cut") / F.col("total")))
        rows = rows.join(contexts.select("context", "total", "back"), "context").withColumn("own", (F.col("c") - cut) / F.col("total"))
        if n == 1:
            rows = rows.withColumn("under", F.lit(base))
        else:
            rows = rows.withColumn("_key", _suffix(F.col("key"), n - 1)).join(below, "_key")
        rows = rows.withColumn("log_p", F.log(F.col("own") + F.exp(F.col("back") + F.col("under"))))
        rows = published(rows.select("key", (F.col("log_p") - F.col("back") - F.col("under")).alias("gain"), "log_p"))
        below = rows.select(F.col("key").alias("_key"), F.col("log_p").alias("under"))
        first = F.lit(base) if n == 1 else F.lit(0.0)
        tables.append(rows.select(F.lit(n).alias("size"), "key", "gain", F.lit(0.0).alias("back")))
        tables.append(contexts.select(F.lit(n - 1).alias("size"), F.col("context").alias("key"), F.lit(0.0).alias("gain"), (F.col("back") + first).alias("back")))
    entries = tables[0]
    for t in tables[1:]:
        entries = entries.unionByName(t)
    return entries.groupBy("size", "key").agg(F.sum("gain").alias("gain"), F.sum("back").alias("back"))


class _Shard:
    """Sorted entries of one shard, and a direct-mapped table of what whole n-grams add up to."""

    def __init__(self, parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.parts = parts
        self.keys = np.full(1 << MEMO_BITS, -1, np.int64)
        self.values = np.zeros(1 << MEMO_BITS)

    def _look(self, n: int, keys: np.ndarray, what: int) -> np.ndarray | float:
        if n not in self.parts or not len(self.parts[n][0]):
            return 0.0
        known = self.parts[n][0]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, self.parts[n][what][at], 0.0)

    def _sum(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        for n in range(1, ORDER + 1):
            out += self._look(n, keys & ((1 << (BITS * n)) - 1), 1)
            out += self._look(n - 1, (keys >> BITS) & ((1 << (BITS * (n - 1))) - 1), 2)
        return out

    def score(self, keys: np.ndarray) -> np.ndarray:
        """The part of each n-gram's log-probability that this shard holds."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        out = self.values[slot]
        new = np.flatnonzero(self.keys[slot] != keys)
        if len(new):
            distinct, back = np.unique(keys[new], return_inverse=True)
            found = self._sum(distinct)
            out[new] = found[back]
            at = ((distinct.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
            self.keys[at] = distinct
            self.values[at] = found
            clash = self.keys[at] != distinct  # of several that meet in a slot the last one stays
            self.values[at[clash]] = found[np.searchsorted(distinct, self.keys[at[clash]])]
        return out


_SHARD: list[_Shard] = []


def _shard(parts: dict) -> _Shard:
    """The one shard that a worker holds at a time."""
    if not _SHARD or _SHARD[0].parts is not parts:
        _SHARD[:] = [_Shard(parts)]
    return _SHARD[0]


def log_probability(docs: DataFrame, model: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """The rows of `docs` with `n_signs` (characters) and `log_p`. `docs` has a text and slim other columns."""
    rows = model.count()
    shards = max(1, -(-rows // entries))
    out = None
    for k in range(shards):
        some = model if shards == 1 else model.filter(F.pmod(F.xxhash64("key", "size"), F.lit(shards)) == k)
        table = some.toArrow()  # at most about `entries` rows
        size, key, gain, back = (table.column(c).to_numpy() for c in ("size", "key", "gain", "back"))
        by = np.lexsort((key, size))
        size, key, gain, back = size[by], key[by], gain[by], back[by]
        parts = {int(n): (key[size == n], gain[size == n], back[size == n]) for n in np.unique(size)}
        sent = docs.sparkSession.sparkContext.broadcast(parts)

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shard = _shard(sent.value)
            for batch in batches:
                sums, sizes = [], []
                for _, texts in _chunks(batch.column("text")):
                    keys, n = grams(texts)
                    total = np.r_[0.0, np.cumsum(shard.score(keys))]
                    ends = np.cumsum(n)
                    sums.append(total[ends] - total[ends - n])
                    sizes.append(n)
                names = [c for c in batch.schema.names if c != "text"]
                columns = [*(batch.column(c) for c in names), pa.array(np.concatenate(sizes or [np.array([], np.int64)])), pa.array(np.concatenate(sums or [np.array([])]))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_signs", "log_p"])

        slim = [f for f in docs.schema.fields if f.name != "text"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim) + ", n_signs long, log_p double"
        part = docs.mapInArrow(score, schema)
        out = part if out is None else out.unionByName(part)
    if shards == 1:
        return out
    keys = [f.name for f in docs.schema.fields if f.name != "text"]
    # equal rows add up together and are parted again
    sums = out.groupBy(*keys, "n_signs").agg(F.sum("log_p").alias("log_p"), F.count("*").alias("_rows"))
    times = (F.col("_rows") / shards).cast("int")
    sums = sums.withColumn("_k", F.explode(F.sequence(F.lit(1), times))).withColumn("log_p", F.col("log_p") / times)
    return sums.drop("_k", "_rows")


def _trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids whose labels all say quality 1 and none toxic."""
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_trusted"))
    return said.agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 AND t = 0").select("_trusted")


def _trains(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(2)) == 0


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, entries: int = ENTRIES) -> DataFrame:
    """One row per document: doc_id, lang, n_signs, perplexity, threshold, kept."""
    return _judged(docs, labels, quantile, slack, entries).drop("text_hash")


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, slack: float, entries: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    trusted = published(_trusted_ids(labels))
    # trusted ids grow with the corpus, so they are merged with the texts at every size, never broadcast
    texts = rows.filter(_trains(F.col("doc_id"))).join(trusted.hint("merge"), F.col("doc_id") == F.col("_trusted"), "left_semi")
    model = published(fit(texts))
    salt = F.xxhash64("text").alias("text_hash")  # tells rows of one doc_id apart
    scored = log_probability(rows.select("doc_id", "lang", salt, "text"), model, entries)
    perplexity = F.when(F.col("n_signs") > 0, F.exp(-F.col("log_p") / F.col("n_signs")))
    scored = published(scored.select("doc_id", "lang", "text_hash", "n_signs", perplexity.alias("perplexity")))
    seen = scored.filter(~_trains(F.col("doc_id")) & F.col("perplexity").isNotNull())
    seen = published(seen.join(trusted, F.col("doc_id") == F.col("_trusted"), "left_semi").select("lang", "perplexity"))
    limit = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    by_lang = seen.groupBy("lang").agg(limit.alias("own"), F.count("*").alias("n")).filter(F.col("n") >= ENOUGH)
    by_lang = by_lang.select(F.col("lang").alias("_lang"), "own")
    whole = seen.agg(limit.alias("whole"))  # one row
    out = scored.join(by_lang, scored["lang"].eqNullSafe(F.col("_lang")), "left").crossJoin(F.broadcast(whole))
    out = out.withColumn("threshold", F.coalesce("own", "whole") * slack)
    kept = F.col("n_signs").isNotNull() & (F.col("n_signs") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_signs", "perplexity", "threshold", kept.alias("kept"), "text_hash")


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, entries: int = ENTRIES) -> DataFrame:
    """The documents that are kept, with the columns they came with. Rows that share a doc_id, or have none, go one
    by one, told apart by text and language."""
    bad = _judged(docs, labels, quantile, slack, entries).filter("NOT kept").select("doc_id", "text_hash", "lang").distinct()
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
        F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64("text").alias("_hash"),
        F.col("lang").cast("string").alias("_lang"),
        "text",
    )
    rows = rows.filter(F.coalesce("text", F.lit("")) != "")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")) & F.col("_lang").eqNullSafe(F.col("lang"))
    kept = rows.join(bad.hint("merge"), same, "left_anti")
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
