"""Best-fit packing of tokenized documents with exact complements.

Documents are tokenized, closed with an end token and cut into pieces of at most `width` tokens. The
plan needs no more than the number of pieces of each length, a table of at most `width` rows whatever
the corpus holds. Longest first, lengths whose gap is filled exactly by one, two or three available
lengths are consumed together, as often as their counts allow; what is left goes to the fullest
sequence that still has room (best fit), again for whole counts at once. The plan is a list of ranges
"pieces number i to j of this length go to sequences s, s + 1, ... at this offset"; every piece finds
its place from its length and its number among the pieces of that length.

Edge cases: a null text is empty, so it holds the end token alone. Only documents longer than a
sequence are cut; their first piece is the short one. Rows that repeat a doc_id are packed each. An
empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockloom.llm.numbering import numbered
from stockloom.session import published

WIDTH = 1024
END = 2
#: Parts per length in which pieces are numbered; they only spread the work.
PARTS = 64
#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of whole texts, equal to those of the tokenizers library for a byte-level vocabulary file.

    The file's vocabulary and added tokens are given to tiktoken, whose merging of the same ranks is
    several times cheaper; files that are not plain byte-level BPE are left to the tokenizers library, and so
    is every text whose white-space runs are too long for tiktoken's pattern matching.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        kind, model = spec["pre_tokenizer"] or {}, spec["model"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
        plain = plain and model["type"] == "BPE" and spec["normalizer"] is None and not (model.get("dropout") or model.get("ignore_merges"))
        plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.fast = None
        if plain:
            byte = {c: k for k, c in self._alphabet(sorted(pre_tokenizers.ByteLevel.alphabet()))}
            ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if token not in added}
            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    @staticmethod
    def _alphabet(chars: list[str]) -> list[tuple[int, str]]:
        """Bytes and the characters that stand for them: printable Latin-1 itself, the others in order from U+0100."""
        shown = [c for c in chars if ord(c) < 256]
        hidden = [k for k in range(256) if chr(k) not in shown]
        return [(ord(c), c) for c in shown] + [(k, chr(256 + n)) for n, k in enumerate(hidden)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.fast is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [np.array(self._ids(t), "<u4").tobytes() for t in texts]

    def _ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:  # a run of about a million blanks exhausts the backtracking stack of the pattern
            return self.tokenizer.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, width: int = WIDTH, end: int = END, chunk: int = 128) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. `tokenizer` is a path that every executor has."""
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            texts = batch.column("text")
            for k in range(0, len(texts), chunk):
                for at, ids in enumerate(encode(texts.slice(k, chunk).to_pylist()), k):
                    ids += tail
                    n = len(ids) // 4
                    start, stop, piece = 0, n if n <= width else n % width or width, 0
                    while start < n:
                        for column, value in zip(rows, (at, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                            column.append(value)
                        start, stop, piece = stop, stop + width, piece + 1
            doc = batch.column("doc_id").take(pa.array(rows[0], pa.int64()))
            numbers = [pa.array(x, t) for x, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([doc, *numbers], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Plan:
    """Ranges of pieces: (length, first number, numbers, pieces per sequence, first sequence, offset)."""

    def __init__(self):
        self.used: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def add(self, filling: list[tuple[int, int]], times: int) -> None:
        """`times` sequences, each holding the (length, copies) of the filling."""
        offset = 0
        for length, copies in filling:
            first = self.used.get(length, 0)
            self.used[length] = first + copies * times
            self.rows.append((length, first, copies * times, copies, self.sequences, offset))
            offset += length * copies
        self.sequences += times


def _fill(counts: np.ndarray, gap: int, most: int, parts: int) -> tuple[int, ...] | None:
    """Up to `parts` available lengths that fill the gap exactly; those that can be used most often first."""
    if parts >= 1 and gap <= most and counts[gap] > 0:
        return (gap,)
    if parts < 2:
        return None
    a = np.arange(1, gap // 2 + 1)
    b = gap - a
    ok = (b <= most) & (counts[a] > 0) & (counts[np.minimum(b, most)] > 0) & ((a != b) | (counts[a] > 1))
    if ok.any():
        k = np.where(ok, np.minimum(counts[a], counts[np.minimum(b, most)]) // np.where(a == b, 2, 1), 0).argmax()
        return (int(b[k]), int(a[k]))
    lengths = np.flatnonzero(counts[: min(gap, most) + 1]) if parts >= 3 else np.array([], np.int64)
    for d in lengths[::-1].tolist():  # the longest of the three first
        rest = gap - d
        low = lengths[(lengths <= rest // 2)]
        high = rest - low
        low, high = low[high <= d], high[high <= d]
        enough = (counts[high] > 0) & (counts[low] >= 1 + (low == high)) & (counts[high] >= 1 + (high == d))
        enough &= (low != d) | (counts[d] >= 1 + (low == d).astype(int) + (high == d))
        if enough.any():
            k = np.where(enough, np.minimum(counts[low], counts[high]), 0).argmax()
            return (d, int(high[k]), int(low[k]))
    return None


def plan(histogram: dict[int, int], width: int = WIDTH) -> _Plan:
    """Places for all pieces, given how many there are of each length: of the plans that look for single, for
    up to two and for up to three complements the one with the fewest sequences."""
    return min((_plan(histogram, width, parts) for parts in (3, 2, 1)), key=lambda p: p.sequences)


def _plan(histogram: dict[int, int], width: int, parts: int) -> _Plan:
    out = _Plan()
    counts = np.zeros(width + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    if counts[width]:
        out.add([(width, 1)], int(counts[width]))
    counts[width] = 0
    most = width - 1
    for length in range(most, 0, -1):
        while counts[length] > 0:
            counts[length] -= 1  # a complement may need this length again
            found = _fill(counts, width - length, most, parts)
            counts[length] += 1
            if found is None:
                break
            copies: dict[int, int] = {}
            for x in (length, *found):
                copies[x] = copies.get(x, 0) + 1
            times = min(int(counts[x]) // n for x, n in copies.items())
            for x, n in copies.items():
                counts[x] -= n * times
            out.add(list(copies.items()), times)
    # best fit for the rest: sequences begun, by the room they have left
    room: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(filling: list[tuple[int, int]], times: int, left: int) -> None:
        if times:
            room.setdefault(left, []).append((filling, times))

    for length in range(most, 0, -1):
        n = int(counts[length])
        while n:
            gap = min((g for g in room if g >= length), default=None)
            if gap is None:
                filling, times, gap = [], n, width
            else:
                filling, times = room[gap].pop()
                if not room[gap]:
                    del room[gap]
            each = gap // length
            whole = min(times, n // each)
            n -= whole * each
            put([*filling, (length, each)], whole, gap - each * length)
            more = min(n, each - 1) if times > whole else 0
            if more:
                n -= more
                put([*filling, (length, more)], 1, gap - more * length)
            if filling:
                put(filling, times - whole - bool(more), gap)
    for groups in room.values():
        for filling, times in groups:
            out.add(filling, times)
    return out


def pack(docs: DataFrame, tokenizer: str, width: int = WIDTH, end: int = END, parts: int = PARTS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = published(pieces(docs, tokenizer, width, end))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `width` rows
    ranges = np.array(sorted(plan(histogram, width).rows), np.int64).reshape(-1, 6)
    begins = (ranges[:, 0] << 48) + ranges[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "_number"))
            if not len(length):
                continue
            row = ranges[np.searchsorted(begins, (length << 48) + number, side="right") - 1]
            nth = number - row[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    return numbered(cut, "length", order, "_number", parts).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
