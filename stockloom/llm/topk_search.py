"""Exact top-k inner products by Fagin's threshold algorithm.

Components become floor(256 * x), so scores are integers. Vectors are dealt into blocks by a hash of
their id; every block of candidates meets every block of queries once, and keeps k rows per query, so
neither side passes through one task or the driver. Inside a block the candidates stand in one sorted
list per dimension. The lists are read in rounds from both ends, the low end serving negative weights;
rows met for the first time are scored exactly for all open queries. With v_d the last value read in
dimension d, no unread row can score above sum(q_d * v_d): a query is closed when this bound is below
its kth score. A bound equal to the kth score keeps it open, since an unread row of smaller id could tie.

Vectors with a component of 2^27 and more ("wide") stand in blocks of their own on both sides. Blocks whose
scores may not fit a long are scored with Python's integers; a score beyond a long is the nearest long.

Edge cases: vectors that are null, hold null, NaN or infinite components, or have no id take no part; a
component whose 256-fold is infinite counts as the largest double. Only vectors of the query's
length are its candidates. Rows that repeat an id count as one, the smallest vector. Fewer than k
candidates give all of them; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.session import published

K = 5
SCALE = 256
#: Rows of a block; they bound the memory of a task.
CANDIDATES = 8192
QUERIES = 1024
#: Values read from every list in the first round; each round reads twice as many.
DEPTH = 32
#: From this size on, components are wide and kept as doubles, which hold floor(256 * x) exactly.
WIDE = 1 << 27
#: Below every score.
NOTHING = -(1 << 63)


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, wide, size and the components as bytes (32-bit integers, doubles if wide), of the vectors that take part."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            with np.errstate(over="ignore"):
                values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            values = np.nan_to_num(values)
            ends = np.cumsum(sizes)
            rows = [values[e - n : e] for e, n in zip(ends, sizes)]
            wide = [bool((np.abs(r) >= WIDE).any()) for r in rows]
            kept = pa.array([r.astype("<f8" if w else "<i4").tobytes() for r, w in zip(rows, wide)], pa.binary())
            columns = [batch.column("vec_id"), pa.array(wide, pa.bool_()), pa.array(sizes, pa.int32()), kept]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "wide", "size", "vector"])

    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    whole = whole.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = whole.mapInArrow(convert, "vec_id long, wide boolean, size int, vector binary")
    return rows.groupBy("vec_id").agg(F.min(F.struct("wide", "size", "vector")).alias("v")).select("vec_id", "v.*")


def _matrix(vectors: pd.Series, wide: bool, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8" if wide else "<i4").reshape(len(vectors), size)


def _integers(values: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python's integers."""
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def _as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; those of Python's integers are cut to their range, above NOTHING."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([min(max(x, NOTHING + 1), -NOTHING - 1) for x in scores.ravel()], np.int64).reshape(scores.shape)


def threshold_search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, depth: int = DEPTH):
    """(query, row, score) of the k best rows of each query. `ids` must rise."""
    n, width = rows.shape
    largest = lambda x: int(np.abs(x.astype(np.float64)).max(initial=0))
    bound = largest(rows) * largest(queries) * max(width, 1)
    if bound < 1 << 62:
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        values, weights = rows.astype(kind), queries.astype(kind)
        edges, asked = rows.astype(np.int64), queries.astype(np.int64)
    else:
        values, weights = _integers(rows), _integers(queries)
        edges, asked = values, weights
    lists = np.argsort(rows, axis=0, kind="stable")  # rising values, equal ones by rising id
    own = np.searchsorted(ids, query_ids)
    own = np.where((own < n) & (ids[np.minimum(own, n - 1)] == query_ids), own, -1)
    open_, seen = np.arange(len(queries)), np.zeros(n, bool)
    best_score = np.full((len(queries), k), NOTHING)
    best_row = np.full((len(queries), k), -1)
    start = 0
    while len(open_) and start < n:
        stop = min(n, start + depth)
        depth *= 2
        fresh = np.zeros(n, bool)
        fresh[lists[start:stop]] = True
        fresh[lists[n - stop : n - start]] = True
        fresh = np.flatnonzero(fresh & ~seen)
        seen[fresh] = True
        for part in np.array_split(open_, -(-len(open_) // 128)):
            scores = _as_long(weights[part] @ values[fresh].T)
            found = np.broadcast_to(fresh, scores.shape)
            scores = np.where(found == own[part][:, None], NOTHING, scores)
            if scores.shape[1] > 4 * k:  # few can be among the best: those of the kth score and above
                at = np.partition(scores, -k, axis=1)[:, -k][:, None]
                hits, columns = np.nonzero((scores >= at) & (scores >= best_score[part][:, -1:]))
            else:
                hits, columns = np.nonzero(scores > NOTHING)
            q = np.r_[np.repeat(part, k), part[hits]]
            s = np.r_[best_score[part].ravel(), scores[hits, columns]]
            r = np.r_[best_row[part].ravel(), fresh[columns]]
            by = np.lexsort((np.where(r < 0, n, r), ~s, q))
            q, s, r = q[by], s[by], r[by]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            take = (first[:, None] + np.arange(k)).ravel()
            best_score[q[first]], best_row[q[first]] = s[take].reshape(-1, k), r[take].reshape(-1, k)
        low, high = edges[lists[stop - 1], np.arange(width)], edges[lists[n - stop], np.arange(width)]
        limit = np.where(queries[open_] > 0, high, low) * asked[open_]
        open_ = open_[_as_long(limit.sum(axis=1)) >= best_score[open_, -1]]
        start = stop
    q, place = np.nonzero(best_row >= 0)
    return q, best_row[q, place], best_score[q, place]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other vectors for every vector that `is_query` names."""
    table = published(quantized(vectors, scale))
    wide = F.col("wide")
    counts = table.agg(
        F.count_if(~wide).alias("n"), F.count_if(wide).alias("wide_n"),
        F.count_if(~wide & is_query).alias("q"), F.count_if(wide & is_query).alias("wide_q"),
    ).first()
    rows, asks = max(1, -(-counts["n"] // candidates)), max(1, -(-counts["q"] // queries))
    wide_rows, wide_asks = -(-counts["wide_n"] // candidates), -(-counts["wide_q"] // queries)

    def dealt(some: int, wide_some: int) -> Column:
        """The block of a vector; wide ones come after the others."""
        at = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n))).cast("int")
        return F.when(wide, at(wide_some) + some).otherwise(at(some))

    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["wide", "vec_id", "vector"]
    left = table.select("size", dealt(rows, wide_rows).alias("block"), all_of(asks + wide_asks).alias("ask"), *columns)
    right = table.filter(is_query).select("size", all_of(rows + wide_rows).alias("block"), dealt(asks, wide_asks).alias("ask"), *columns)

    def search(_, some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(asked) or not some["size"].iloc[0]:
            return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], np.int64)})
        some = some.sort_values("vec_id", kind="stable")
        ids, query_ids, size = some["vec_id"].to_numpy(), asked["vec_id"].to_numpy(), int(some["size"].iloc[0])
        of = lambda x: _matrix(x["vector"], bool(x["wide"].iloc[0]), size)
        q, r, s = threshold_search(of(some), ids, of(asked), query_ids, k)
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[r], "score": s})

    keys = ["size", "block", "ask"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
