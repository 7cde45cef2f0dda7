"""Ranked lexical search by range-maximum tables over posting lists.

A term is a run of ASCII letters and digits and of all characters beyond ASCII, with A-Z lowered; on the UTF-8
bytes this is one translation and one split. A first pass over the whole texts keeps each document's length and
its counts of the terms that are asked for; lengths and document frequencies are added up from it. The scores are
integers.

The search runs over blocks of documents in the order of their ids. Each term's posting list in a block has a
sparse table of its impacts (what a posting adds to a score), so the largest impact of any interval of documents,
and the document that has it, takes two reads. The sum of these maxima bounds all scores of an interval. Starting
from the whole block, the intervals of the highest bounds are taken first: the document of the largest impact is
scored exactly and splits its interval in two. The search ends when no bound can enter the best k. What a block
found is the starting point of the next block of the task, so later blocks end sooner; an interval whose bound
equals the kth score stays open only if a smaller id could be in it. Tasks give k rows per item, salted windows
combine them.

Items are asked in slices of at most about LIMIT terms; a slice is counted before it is sent to the tasks, and
every slice meets all documents.

Edge cases: a null or empty text has no term and counts in neither N nor L. Rows with one item_id are one item with
the terms of all, null being an id like others; an item without terms has no result. Every row of the documents is
one document; a null doc_id comes after the others, and rows of equal id and score rank in any order. Terms of
weight 0 add nothing, and scores of 0 are left out. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stockloom.session import published

K = 20
#: Most documents and about as many postings of a block; with its tables they bound the memory of a task.
BLOCK = 8192
POSTINGS = 1 << 18
#: Blocks of a task, at most; small tables have a task for every 1024 documents.
BLOCKS = 16
#: Terms of the items of a slice.
LIMIT = 200_000
#: Intervals taken from the queue at once.
WIDTH = 48
SALTS = 16
#: Bits for the place of a document in a block; impacts stay below 2**36.
PLACE_BITS = 20
#: Stands for a null id, after all others.
LAST = (1 << 63) - 1

_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_BYTES).split() if text else []


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def normaliser(n: int, total: int, tokens: int) -> int:
    """m of a document with n terms."""
    return 75 + 25 * n * total // tokens


def impact(weight, tf, norm):
    """What a term adds to a score; numbers or arrays."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm))


class Block:
    """Posting lists of some documents with a sparse table over all of them. `ids` must rise."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, gain: np.ndarray):
        self.ids, self.size = ids, len(ids)
        some = gain > 0
        doc, term, gain = doc[some], term[some], gain[some]
        keys = term * (self.size + 1) + doc
        order = np.argsort(keys, kind="stable")
        self.keys, self.gain = keys[order], gain[order]
        # the larger impact wins, then the earlier document
        level = (self.gain << PLACE_BITS) | ((1 << PLACE_BITS) - 1 - doc[order])
        counts = np.bincount(term) if len(term) else np.zeros(1, np.int64)
        self.tables = np.empty((max(1, int(counts.max()).bit_length()), len(level)), np.int64)
        self.tables[0] = level
        for k in range(1, len(self.tables)):
            half, below = 1 << (k - 1), self.tables[k - 1]
            np.maximum(below[:-half], below[half:], out=self.tables[k, :-half])
            self.tables[k, -half:] = below[-half:]

    def _maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The table entry of the largest impact in every [low, high) of posting places; 0 where it is empty."""
        full = high > low
        step = np.frexp(np.maximum(high - low, 1))[1] - 1
        first = np.where(full, low, 0)
        last = np.where(full, high - (1 << step), 0)
        return np.where(full, np.maximum(self.tables[step, first], self.tables[step, last]), 0)

    def search(self, terms: np.ndarray, times: np.ndarray, best: list[tuple[int, int]], k: int, width: int = WIDTH) -> int:
        """Puts the best k of this block and of `best`, a heap of (score, -id), into `best`. Returns the documents scored."""
        if not len(self.keys):
            return 0
        base = terms * (self.size + 1)
        low, high = np.searchsorted(self.keys, base), np.searchsorted(self.keys, base + self.size)
        held = high > low
        terms, times, base, low, high = terms[held], times[held], base[held], low[held], high[held]
        if not len(terms):
            return 0
        queue: list[tuple] = []
        number = scored = 0

        def open_(bound: int, first: int) -> bool:
            if len(best) < k:
                return bound > 0
            score, negative = best[0]
            return bound > score or (bound == score and self.ids[first] < -negative)

        def put(starts, ends, lows, highs) -> None:
            nonlocal number
            top = self._maxima(lows, highs)
            adds = (top >> PLACE_BITS) * times
            bounds = adds.sum(axis=1)
            split = (1 << PLACE_BITS) - 1 - (top[np.arange(len(top)), adds.argmax(axis=1)] & ((1 << PLACE_BITS) - 1))
            for i, bound in enumerate(bounds.tolist()):
                if bound and open_(bound, starts[i]):
                    number += 1
                    heapq.heappush(queue, (-bound, number, starts[i], ends[i], split[i], lows[i].copy(), highs[i].copy()))

        put([0], [self.size], low[None, :], high[None, :])
        while queue:
            taken = []
            while queue and len(taken) < width:
                entry = heapq.heappop(queue)
                if open_(-entry[0], entry[2]):
                    taken.append(entry)
                elif len(best) == k and -entry[0] < best[0][0]:  # all that is left has no higher bound
                    queue.clear()
            if not taken:
                break
            split = np.array([e[4] for e in taken])
            lows, highs = np.stack([e[5] for e in taken]), np.stack([e[6] for e in taken])
            keys = base[None, :] + split[:, None]
            at = np.searchsorted(self.keys, keys)
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
            scores = np.where(hit, self.gain[np.minimum(at, len(self.keys) - 1)] * times, 0).sum(axis=1)
            scored += len(taken)
            for place, score in zip(split.tolist(), scores.tolist()):
                found = (score, -int(self.ids[place]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            starts = [e[2] for e in taken] + (split + 1).tolist()
            ends = split.tolist() + [e[3] for e in taken]
            put(starts, ends, np.concatenate([lows, at + hit]), np.concatenate([at, highs]))
        return scored


def _asked(items: DataFrame) -> DataFrame:
    """item (a dense number), item_id, term, times."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id"), batch.column("text")):
                counts = Counter(terms_of(text.as_py()))
                if counts:
                    columns = [pa.array([item.as_py()] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["item_id", "term", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(split, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _counted(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n, terms, tfs: the length of every document and its counts of the terms of a vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            lengths, terms, tfs, offsets = [], [], [], [0]
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                counts = Counter(map(number.get, words))
                counts.pop(None, None)
                lengths.append(len(words))
                terms.extend(counts.keys())
                tfs.extend(counts.values())
                offsets.append(len(terms))
            offsets = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def _cuts(sizes: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows for blocks, given the postings of each row."""
    upto, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = upto[start - 1] if start else 0
        end = min(start + block, max(start + 1, int(np.searchsorted(upto, before + POSTINGS, side="right"))))
        yield start, end
        start = end


def _best(counted: DataFrame, shared, total: int, tokens: int, k: int, block: int) -> DataFrame:
    """item, doc_id, score: the best k of every task for each item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        for batch in batches:
            for start, end in _cuts(np.diff(batch.column("terms").offsets.to_numpy()), block):
                part = batch.slice(start, end - start)
                ids = np.array([LAST if d is None else d for d in part.column("doc_id").to_pylist()], np.int64)
                norms = np.array([normaliser(n, total, tokens) for n in part.column("n").to_pylist()], np.int64)
                sizes = np.diff(part.column("terms").offsets.to_numpy())
                order = np.argsort(ids, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                row = np.repeat(np.arange(len(ids)), sizes)
                term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                docs = Block(ids[order], place[row], term, impact(weights[term], tf, norms[row]))
                for heap, (_, terms, times) in zip(best, asked):
                    docs.search(terms, times, heap, k)
        rows = [(item, None if -d == LAST else -d, score) for (item, _, _), heap in zip(asked, best) for score, d in heap]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    found = counted.mapInArrow(search, "item long, doc_id long, score long")
    return found.filter("score > 0")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item."""
    context = docs.sparkSession.sparkContext
    asked = published(_asked(items))
    slices = max(1, -(-asked.count() // limit))
    results = None
    for part in range(slices):
        # at most about `limit` rows
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == part).toArrow().to_pylist()
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        counted = published(_counted(docs, context.broadcast(vocabulary)))
        sums = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.size("terms") > 0)).first()
        total, tokens = int(sums[0]), int(sums[1])
        df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow().to_pandas().itertuples(index=False))
        weights = np.array([weight(total, int(df.get(i, 0))) for i in range(len(vocabulary))], np.int64)
        per_item: dict = {}
        for r in rows:
            per_item.setdefault(r["item_id"], []).append((vocabulary[bytes(r["term"])], r["times"]))
        numbers = sorted(per_item, key=lambda i: (i is None, i or 0))
        lists = [(j, *(np.array(c, np.int64) for c in zip(*per_item[i]))) for j, i in enumerate(numbers)]
        rows_held = int(sums[2])
        tasks = max(-(-rows_held // (BLOCKS * block)), min(4 * context.defaultParallelism, -(-rows_held // 1024)), 1)
        spread = counted.filter(F.size("terms") > 0).repartition(tasks)  # few bytes, much work
        found = _best(spread, context.broadcast((lists, weights)), total, tokens, k, block)
        names = docs.sparkSession.createDataFrame([(j, i) for j, i in enumerate(numbers)], "item long, item_id long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        for keys in (["item", salt], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
        out = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        results = out if results is None else results.unionByName(out)
    return results
