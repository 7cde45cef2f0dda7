"""Token counts and packing against the libraries."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stockloom.llm import packing, token_counts

PIECE = public_tokenizers.path("piece_bpe_32k.model")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def random_texts(n, alphabet, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_counts_equal_the_library(odd_docs, odd_rows, no_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sorted(map(tuple, token_counts.token_counts(odd_docs, PIECE).collect()), key=repr)
    want = []
    for doc_id, text in (r[:2] for r in odd_rows):
        n = len(model.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 4096))
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(no_docs, PIECE).count() == 0


def test_merging_of_random_texts():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = random_texts(2000, "abthe  in▁gs日é\n<>0_=-", 0) + ["e" * 999, "=-" * 500, "▁▁a", " ", "   "]
    assert token_counts.Merger(PIECE).count(texts) == [len(x) for x in model.encode(texts)]


def test_given_documents(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PIECE).collect()}
    assert got == {r.doc_id: len(model.encode(r.text)) for r in docs.collect()}


def test_ids_equal_the_library():
    library = Tokenizer.from_file(BYTE)
    texts = random_texts(2000, "ab '  s\n\t1é .<|>  ᠎٣", 1) + ["<|endoftext|> a<|endoftext|>", "\x1c \x1d a", "\x85\xa0 x"]
    got = packing.Encoder(BYTE).encode(texts)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_millions_of_blanks(spark, blank):
    text = "a " + blank * 2_000_000 + "b"
    encoder = packing.Encoder(BYTE)
    assert encoder.fast is not None
    ids = np.array(Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(["x", text]) == [encoder.encode(["x"])[0], ids]
    if blank == " ":
        rows = packing.pack(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), BYTE).collect()
        check_packing(rows, [(1, text), (2, "x")], 1024)


def test_other_vocabularies_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.Encoder(path)
    assert encoder.fast is None
    assert encoder.encode(["A cat"])[0] == np.array(Tokenizer.from_file(path).encode("A cat", add_special_tokens=False).ids, "<u4").tobytes()


def check_packing(rows, texts, width):
    """Every document's ids come back from its pieces, and every sequence is filled without gaps."""
    library = Tokenizer.from_file(BYTE)
    ids = defaultdict(list)
    for doc_id, text in texts:
        ids[doc_id].append([*library.encode(text or "", add_special_tokens=False).ids, 2])
    want = []
    for doc_id, copies in ids.items():
        for tokens in copies:
            n = len(tokens)
            cuts = [0, n] if n <= width else [0, *range(n % width or width, n + 1, width)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want.append((doc_id, k, a, b - a, zlib.crc32(np.array(tokens[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= width
    return len(sequences)


@pytest.mark.parametrize("width", [16, 1024])
def test_packing(odd_docs, odd_rows, no_docs, width):
    rows = packing.pack(odd_docs, BYTE, width, parts=3).collect()
    check_packing(rows, [r[:2] for r in odd_rows], width)
    assert packing.pack(no_docs, BYTE).count() == 0


def test_packing_of_given_documents(docs):
    rows = packing.pack(docs, BYTE).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 1024)
    assert n <= 1.03 * -(-sum(r.length for r in rows) // 1024) + 1


@pytest.mark.parametrize("histogram", [{}, {1: 5000}, {700: 10, 300: 5, 24: 3}, {513: 9}, {341: 100, 1: 3}, {1024: 3, 256: 7}, {k: k % 7 for k in range(1, 1025)}])
def test_plans_place_every_piece_once(histogram):
    made = packing.plan(histogram)
    filled = defaultdict(int)
    spans = defaultdict(list)
    for length, first, n, each, sequence, offset in made.rows:
        spans[length].append((first, n))
        for k in range(n):
            filled[sequence + k // each] += length
    assert all(v <= 1024 for v in filled.values())
    for length, n in histogram.items():
        at = 0
        for first, size in sorted(spans[length]):
            assert first == at
            at += size
        assert at == n
    total = sum(k * v for k, v in histogram.items())
    over = sum(v for k, v in histogram.items() if k > 512)
    assert made.sequences == len(filled) and made.sequences <= max(over, 1.25 * total / 1024 + 1)
