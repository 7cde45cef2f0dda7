"""Mixing sources to target weights.

The words of each source stand in one stream, document after document in the order of a hash, and the
stream is packed into blocks of fixed length. The mix is a row of slots in output shards of fixed size.
Every shard draws how many of its slots each source gets: the whole part of its quota, and the
remainders by a multinomial draw of the shard's own seed. The slots of a source are numbered over all
shards; slot j takes block perm(j mod n) of the source's n blocks, where perm is a pseudorandom
permutation of the indices that changes with every round j div n, and slots and blocks meet in a join
on (source, block). A round takes every block once, so no block is taken more than `most` times.

Edge cases: a null text has no words, a null source is a source of its own and the last. Documents
without words are taken zero times. Rows that repeat a doc_id are streamed each. An empty table gives
an empty result. Further columns are carried by `mixed` and ignored by `taken`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.llm.numbering import numbered
from stockloom.session import published

BLOCK = 64
#: Slots of an output shard.
SHARD = 4096
MOST = 3
SEED = 11
#: Parts per source in which the stream is laid out; they only spread the work.
PARTS = 128
#: Weights by the place of a source in code-point order, repeating.
WEIGHTS = (1, 2, 3)

_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight; a target stops at `most` times its size and the rest is shared again."""
    left, out, live = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while live:
        unit = left / sum(weights[k] for k in live)
        full = {k for k in live if unit * weights[k] > most * sizes[k]}
        if not full:
            for k in live:
                out[k] = unit * weights[k]
            break
        for k in full:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in full)
        live -= full
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for every key: a Feistel network on the next power of four,
    walked until it falls below size."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = _mix64(key.astype(np.uint64))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k, x = half[todo], mask[todo], key[todo], out[todo]
        left, right = x >> h, x & m
        for r in range(rounds):
            left, right = right, left ^ (_mix64(right ^ _mix64(k + np.uint64(r))) & m)
        x = (left << h) | right
        out[todo] = x
        todo = todo[x >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


class Mix:
    """The layout of all documents in streams, and what the mix takes of them."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST, weights=WEIGHTS, seed: int = SEED, parts: int = PARTS):
        self.block, self.spark = block, docs.sparkSession
        slim = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            n_words(F.col("text")).alias("size"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        )
        slim = published(slim)
        found = slim.groupBy("source").agg(F.sum("size").alias("n")).collect()  # one row per source
        found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        sizes = [int(r["n"]) for r in found]
        goal = targets(sizes, [float(weights[k % len(weights)]) for k in range(len(found))], most)
        blocks = [-(-n // block) for n in sizes]
        rows = [(r["source"], k, sizes[k], goal[k], blocks[k]) for k, r in enumerate(found)]
        self.sources = self.spark.createDataFrame(rows, "_name string, source_no int, source_size long, target double, blocks long")
        named = slim.join(self.sources, slim["source"].eqNullSafe(F.col("_name"))).drop("_name")
        order = [F.col("doc_id"), F.col("text_hash"), F.col("size")]
        self.docs = published(numbered(named, "source_no", order, "start", parts, F.col("size")))
        quota = np.array([b * g / n if n else 0.0 for b, g, n in zip(blocks, goal, sizes)])  # slots of each source
        self.slots = self._slots(quota, blocks, shard, most, seed)

    def _slots(self, quota: np.ndarray, blocks: list[int], shard: int, most: int, seed: int) -> DataFrame:
        """shard, source_no, block of every slot."""
        shards = max(1, -(-int(np.ceil(quota.sum())) // shard))
        each = quota / shards
        whole = np.floor(each).astype(np.int64)
        rest = each - whole
        n_rest = int(round(rest.sum()))
        limit, many = np.array(blocks, np.int64) * most, np.array(blocks, np.int64)
        if not len(quota) or quota.sum() == 0:
            return self.spark.createDataFrame([], "shard long, source_no int, block long")
        share = rest / rest.sum() if rest.sum() > 0 else np.full(len(rest), 1 / len(rest))

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in batch.column("id").to_pylist():
                    n = whole + np.random.default_rng([seed, at]).multinomial(n_rest, share)
                    columns = [np.full(len(n), at), np.arange(len(n), dtype=np.int32), n]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "source_no", "n"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                source, j = (batch.column(c).to_numpy() for c in ("source_no", "j"))
                inside = j < limit[source]  # a draw beyond `most` rounds is not used
                source, j, at = source[inside], j[inside], batch.column("shard").to_numpy()[inside]
                size = many[source]
                block = permuted(j % size, size, (j // size) * 1_000_003 + source + seed)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(source), pa.array(block)], ["shard", "source_no", "block"])

        drawn = self.spark.range(shards).mapInArrow(draw, "shard long, source_no int, n long")
        before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        drawn = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("n > 0")
        # the rows grow here, which no estimate foresees: a few shards per task, whatever their bytes now
        drawn = drawn.repartition(max(1, shards // 16), "shard")
        numbers = drawn.select("shard", "source_no", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("j"))
        return numbers.mapInArrow(choose, "shard long, source_no int, block long")

    def parts(self) -> DataFrame:
        """Every document's parts of blocks with the times that the mix takes them."""
        full = self.docs.filter("size > 0")
        last = F.floor((F.col("start") + F.col("size") - 1) / self.block).cast("long")
        cut = full.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / self.block).cast("long"), last)))
        begin = F.greatest("start", F.col("block") * self.block)
        end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block)
        cut = cut.select("doc_id", "text_hash", "source_no", "start", "block", (begin - F.col("start")).alias("from"), (end - begin).alias("words"))
        times = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        return cut.join(times.hint("merge"), ["source_no", "block"])  # as many rows as blocks: never broadcast


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    mix = Mix(docs, **options)
    per_doc = mix.parts().groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    worded = mix.docs.filter("size > 0").join(per_doc.hint("merge"), ["source_no", "start"], "left")
    blank = mix.docs.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return worded.select(*columns).unionByName(blank.select(*columns))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of documents: a document comes once for every round that takes any of it, in runs of
    neighbouring blocks; a run that is a whole document keeps its text, another joins its words by a space.
    n_chars, where the table has it, is set to the length of the new text."""
    mix = Mix(docs, **options)
    keys = ["_id", "_hash"]
    runs = mix.parts().groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "start").agg(
        F.collect_list(F.struct("from", "words", "times")).alias("_runs")  # of one document
    )
    runs = runs.groupBy(*keys).agg(F.flatten(F.collect_list("_runs")).alias("_runs"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    if mix.docs.count() > mix.docs.select("doc_id", "text_hash").distinct().count():
        rows = rows.dropDuplicates(keys)  # equal rows: their runs stand together
    rows = rows.join(runs.hint("merge"), rows["_id"].eqNullSafe(runs["_id"]) & (rows["_hash"] == runs["_hash"])).select("_row", "_runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = [], []
            for k, (text, parts) in enumerate(zip(batch.column("_row").field("text").to_pylist(), batch.column("_runs").to_pylist())):
                words = text.encode("utf-8", "surrogatepass").split()
                parts = sorted((p["from"], p["words"], p["times"]) for p in parts)
                for taken in range(1, max(p[2] for p in parts) + 1):
                    run: list[list[int]] = []
                    for begin, n, times in parts:
                        if times >= taken:
                            if run and run[-1][1] == begin:
                                run[-1][1] = begin + n
                            else:
                                run.append([begin, begin + n])
                    for begin, end in run:
                        at.append(k)
                        texts.append(text if begin == 0 and end >= len(words) else b" ".join(words[begin:end]).decode("utf-8", "surrogatepass"))
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(index), pa.array(texts, pa.string())], ["_row", "_text"])

    kind = rows.schema["_row"].dataType
    out = rows.mapInArrow(cut, f"_row {kind.simpleString()}, _text string")
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*((new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns))
