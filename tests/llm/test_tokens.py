"""Encoding, decoding and counting against the libraries themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe, common, pieces, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "  b", "\n", " ", "\t", "\u2003", "<|endoftext|>", "   ", "é", "中", "١", "½", "\x1c", "\x85", "\u00a0", "'s", "'LL", "don't", "!!", "\u200b", "🙂", "x" * 70, "ab" * 100, "1" * 90]


def samples() -> list[str]:
    rng = random.Random(5)
    out = ["", " ", "the cat sat", "Zürich\r\n\r\n  straße", "a" * 3000, " " * 500, "<|endoftext|>" * 3, "x  <|endoftext|>  y"]
    return out + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encode_and_decode_match_the_library(library):
    rows = samples()
    own = bpe.Bpe(PATH)
    want = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    got = own.encode(rows)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [own.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_one_tree_and_many_trees_agree(library):
    own = bpe.Bpe(PATH)
    words = [w.encode() for w in ("hello", "aaaaaaaaaaaaaaaa", "ababababab", "x", "zzyzx", "internationalization")]
    assert own.merge(words) == [own._merge_one(w) for w in words]


def test_counts_match_the_library(library):
    rows = samples()
    assert token_counts.PieceCounter(PATH).counts(rows) == [len(e) for e in library.encode_batch(rows, add_special_tokens=False)]


def test_counts_survive_a_full_memory(library, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_BYTES", 3)
    own = token_counts.PieceCounter(PATH)
    for _ in range(3):
        assert own.counts(["a b c d", "e f g"]) == [4, 3]
    codec, rows = bpe.Bpe(PATH), samples()
    want = codec.encode(rows)
    assert codec.encode(rows) == want == codec.encode(rows)


UNSPACED = "今天天气很好，我们去公园散步。ภาษาไทยไม่มีการเว้นวรรค2024年12月、日本語の文章もスペースなしで書きます！"


@pytest.mark.parametrize("limit", [0, 3, 48])
def test_texts_without_spaces_match_the_library(library, monkeypatch, limit):
    monkeypatch.setattr(pieces, "LONG", limit)
    rng = random.Random(limit)
    rows = [UNSPACED * 30, f"x {UNSPACED} y  {UNSPACED}\n\n{UNSPACED}\n \n z", "a" * 400 + "1" * 90 + "!?" * 60 + "'s'll" * 20, UNSPACED[:50] + "<|endoftext|>" + UNSPACED]
    rows += ["".join(rng.choice([*PARTS, *UNSPACED]) for _ in range(150)) for _ in range(60)] + samples()
    want = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    own = bpe.Bpe(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(rows)] == want
    assert token_counts.PieceCounter(PATH).counts(rows) == list(map(len, want))


def test_long_pieces_are_not_remembered():
    rng = random.Random(2)
    counter, codec = token_counts.PieceCounter(PATH), bpe.Bpe(PATH)
    for _ in range(20):
        rows = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(2000)) for _ in range(5)]
        counter.counts(rows)
        codec.encode(rows)
    assert counter.held < 10_000 and codec.held < 10_000


def test_batches_are_balanced_by_bytes():
    rows = ["é" * 10, "a" * 10, "中" * 10, "b" * 30]
    assert list(common.by_bytes(rows, 30)) == [(0, 2), (2, 3), (3, 4)]


def test_other_vocabularies():
    rows = ["Hello world", "", "ça va bien"]
    word = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.PieceCounter(word).counts(rows) == [len(e) for e in Tokenizer.from_file(word).encode_batch(rows, add_special_tokens=False)]
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=model).encode(rows)]
    assert token_counts.PieceModelCounter(model).counts(rows) == want


def test_queries_over_frames(spark, library):
    rows = [(1, "The cat"), (2, None), (2, ""), (None, "x <|endoftext|> y"), (5, "é" * 5000), (5, "é" * 5000)]
    df = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id long, text string, n_tokens string, ids int")
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.setdefault((i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()), 0)
        want[(i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    got = {}
    for r in bpe.roundtrip_digests(df, PATH).collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == want
    counted = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, PATH).collect()}
    assert counted == {(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, (len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows), strict=True)}
    encoded = bpe.encode_documents(df, PATH)
    assert {(r.doc_id, r.text) for r in bpe.decode_documents(encoded, PATH).collect()} == {(i, t or "") for i, t in rows}
    assert bpe.roundtrip_digests(df.limit(0), PATH).count() == 0 and token_counts.count_tokens(df.limit(0), PATH).count() == 0
