"""Token counts by rank-synchronous array merging.

The vocabulary is a SentencePiece byte-pair model. A text is prefixed with one space, and every space
becomes the model's space mark. No piece holds the mark after another character, so a text falls apart
into pre-tokens (a run of spaces and the characters up to the next space) that can be merged alone.

Pre-tokens that a worker meets for the first time are merged together: their symbols lie in one flat
array with the number of the pre-token beside each symbol (ragged arrays). In every round each
pre-token finds its lowest-rank pair and all pre-tokens apply theirs at once; the symbols that survive
are counted. All occurrences of a pair are applied in one round, from the left up to the first that
makes a pair of lower rank than itself, which keeps the result equal to one merge at a time. Symbols outside the vocabulary cost their UTF-8 bytes (byte fallback).

Edge cases: a null text is empty, an empty text has no tokens, control strings such as `<s>` in a text
are ordinary text. Texts are taken whole; one without spaces is one long pre-token. Counts by
pre-token are kept per worker up to CACHE entries, which bounds memory and changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LIMIT = 4096
#: Pre-tokens remembered per worker; beyond it the memory is emptied.
CACHE = 500_000
#: Size of the table of pairs, as a power of two; the 32,000 pieces make about 60,000 pairs.
TABLE_BITS = 20
#: Symbols merged together in one batch of arrays.
BATCH_SYMBOLS = 1 << 20
#: Longer pre-tokens are not remembered.
LONG = 64

MARK = "▁"
_PRE_TOKEN = re.compile(" *[^ ]+| +$")


class Merger:
    """The merge table of a SentencePiece byte-pair model, and counts by pre-token."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rank: dict[str, int] = {}
        order = sorted(
            (k for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))),
            key=lambda k: (-model.get_score(k), k),
        )
        for k in order:
            rank[model.id_to_piece(k)] = len(rank)
        if any(MARK in piece.lstrip(MARK) for piece in rank):
            raise ValueError("the model has pieces that reach over a space")
        self.rank = rank
        self.size = np.int64(len(rank) + 1)  # the last number stands for a symbol outside the vocabulary
        left, right, to = [], [], []
        for piece, number in rank.items():
            for cut in range(1, len(piece)):
                a, b = rank.get(piece[:cut]), rank.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(number)
        left, right, to = (np.array(x, np.int64) for x in (left, right, to))
        keys = left * self.size + right
        self._index(keys, to)
        # joined pieces that are part of a piece of lower rank
        self.early = np.zeros(int(self.size) + 1, bool)
        self.early[left[to < left]] = True
        self.early[right[to < right]] = True
        self.known: dict[str, int] = {}

    def _index(self, keys: np.ndarray, to: np.ndarray) -> None:
        """An open-addressing table of the pairs, probed for whole arrays."""
        self.slots = np.full(1 << TABLE_BITS, -1, np.int64)
        self.joined = np.full(1 << TABLE_BITS, self.size, np.int64)
        self.probes = 0
        at = self._slot(keys)
        while len(keys):
            self.probes += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[free]  # of several that meet in a slot one stays
            placed = self.slots[at] == keys
            self.joined[at[placed]] = to[placed]
            keys, to, at = keys[~placed], to[~placed], (at[~placed] + 1) & (len(self.slots) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined piece of each pair, or the size of the vocabulary if there is none."""
        keys = left * self.size + right
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.joined[at], self.size)
        for k in range(1, self.probes):
            more = np.flatnonzero((found != keys) & (found >= 0))
            if not len(more):
                break
            at[more] = (at[more] + 1) & (len(self.slots) - 1)
            found[more] = self.slots[at[more]]
            some = found[more] == keys[more]
            out[more[some]] = self.joined[at[more[some]]]
        return out

    def _in_order(self, hit: np.ndarray, symbols: np.ndarray, owner: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The hits up to the first of each pre-token that makes a pair of lower rank than itself."""
        joined = pair[hit]
        before, after = np.maximum(hit - 1, 0), np.minimum(hit + 2, len(symbols) - 1)
        beside = np.r_[False, hit[1:] == hit[:-1] + 2] & np.r_[False, owner[hit][1:] == owner[hit][:-1]]
        left = self._pairs(np.where(beside, joined, symbols[before]), joined)
        right = self._pairs(joined, symbols[after])
        lower = (left < joined) & (hit > 0) & (owner[before] == owner[hit])
        lower |= (right < joined) & (hit + 2 < len(symbols)) & (owner[after] == owner[hit])
        seen = np.cumsum(lower) - lower
        first = np.flatnonzero(np.r_[True, owner[hit][1:] != owner[hit][:-1]])
        return hit[seen == np.repeat(seen[first], np.diff(np.r_[first, len(hit)]))]

    def merge(self, pre_tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        sizes = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        chars = np.frombuffer("".join(pre_tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, back = np.unique(chars, return_inverse=True)
        none = self.size - 1
        ids = np.array([self.rank.get(chr(c), none) for c in distinct], np.int64)
        cost = np.array([1 if i != none else 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF) for i, c in zip(ids, distinct.tolist())], np.int64)
        owner = np.repeat(np.arange(len(pre_tokens)), sizes)
        counts = np.bincount(owner, weights=cost[back], minlength=len(pre_tokens)).astype(np.int64)
        symbols = ids[back]
        inside = owner[:-1] == owner[1:]
        pair = np.full(len(symbols), self.size)  # of a symbol and its right neighbour
        pair[:-1][inside] = self._pairs(symbols[:-1][inside], symbols[1:][inside])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            best = np.minimum.reduceat(pair, starts)
            live = best < self.size
            if not live.all():  # pre-tokens without a pair are done
                keep = np.repeat(live, lengths)
                symbols, owner, pair, best, lengths = symbols[keep], owner[keep], pair[keep], best[live], lengths[live]
                if not len(symbols):
                    break
            hit = np.flatnonzero(pair == np.repeat(best, lengths))
            follows = np.zeros(len(hit), bool)
            follows[1:] = (hit[1:] == hit[:-1] + 1)
            if follows.any():  # of overlapping pairs every second one is applied, from the left
                run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(hit))))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            if self.early[pair[hit]].any():
                hit = self._in_order(hit, symbols, owner, pair)
            symbols[hit] = pair[hit]
            counts -= np.bincount(owner[hit], minlength=len(counts))
            alive = np.ones(len(symbols), bool)
            alive[hit + 1] = False
            at = np.cumsum(alive)[hit] - 1
            symbols, owner, pair = symbols[alive], owner[alive], pair[alive]
            for left in (at, at[at > 0] - 1):  # the pairs beside a joined symbol are new
                pair[left] = self.size
                left = left[left + 1 < len(symbols)]
                left = left[owner[left] == owner[left + 1]]
                pair[left] = self._pairs(symbols[left], symbols[left + 1])
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        words = [_split(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(set().union(*words) - self.known.keys())
        batch = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1) // BATCH_SYMBOLS
        bounds = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1], True]).tolist() if new else [0]
        passing: dict[str, int] = {}
        for start, end in pairwise(bounds):
            some = new[start:end]
            passing.update(zip(some, self.merge([MARK + w for w in some]).tolist()))
        long = {w: n for w, n in passing.items() if len(w) > LONG}
        self.known.update(passing)
        counts = [sum(map(self.known.__getitem__, some)) for some in words]
        for w in long:
            del self.known[w]
        return counts


def _split(text: str) -> list[str]:
    """Pre-tokens without the space mark that each of them begins with."""
    if "  " not in text and MARK not in text and text[-1] != " " and text[0] != " ":
        return text.split(" ")
    return [w[1:].replace(" ", MARK) for w in _PRE_TOKEN.findall(" " + text.replace(MARK, " "))]


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """One per worker and model file."""
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, chunk: int = 256) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. `model` is a path that every executor has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(model)
        for batch in batches:
            texts = batch.column("text")
            n = [x for k in range(0, len(texts), chunk) for x in merge.count(texts.slice(k, chunk).to_pylist())]
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = slim.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
