"""Aligned tokens against the libraries and byte offsets."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import align
from graphloom.llm.bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "  b", "\n", " ", "\t", " ", "<|endoftext|>", "   ", "é", "中", "١", "½", "\x1c", "\x85", " ", "'s", "don't", "!!", "🙂", "x" * 70, "ab" * 100, "▁", "<s>", "<0x41>", " the", " word", "\x00", " \n", " x", "</s><unk>"]


@pytest.fixture(scope="module")
def plain():
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    of_id, of_char = {i: t for t, i in a_lib.get_vocab().items()}, {c: b for b, c in enumerate(byte_alphabet())}

    def ends(tokens: list[bytes]) -> list[int]:
        out, at = [], 0
        for t in tokens:
            at += len(t)
            out.append(at)
        return out

    def run(text):
        """Tokens of both sides, groups as text, and linked ids."""
        if not text:
            return 0, 0, "", []
        a, b = a_lib.encode(f" {text}", add_special_tokens=False).ids, b_lib.encode(text)
        a_bytes = [bytes(of_char[c] for c in of_id[i]) for i in a]
        named = [b_lib.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in named]
        if not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            return 0, 0, "", []
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        links = [(x, y) for x, p in zip(a, a_ends, strict=True) for y, q in zip(b, b_ends, strict=True) if p == q] if len(a) < 300 else None
        shown, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            p, q = a_ends.index(end) + 1, b_ends.index(end) + 1
            shown.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        return len(a), len(b), ";".join(shown), links

    return run


def samples() -> list[str]:
    rng = random.Random(5)
    out = ["", " ", "  ", "▁", "a▁ ▁b", "the cat sat", " the  cat ", "Zürich\r\n\r\n  straße", "a" * 200, " " * 50]
    return out + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(500)]


def linked(own: align.Aligner, links: bytes) -> list[tuple[int, int]]:
    return [(int(own.pairs[i]) >> 32, int(own.pairs[i]) & 0xFFFFFFFF) for i in memoryview(links).cast("i")]


@pytest.mark.parametrize("known", [0, align.KNOWN_BYTES])
def test_groups_match_the_libraries(plain, monkeypatch, known):
    monkeypatch.setattr(align, "KNOWN_BYTES", known)
    own, rows = align.Aligner(A, B), samples()
    for a in range(0, len(rows), 40):
        for row, got in zip(rows[a : a + 40], own.align(rows[a : a + 40]), strict=True):
            n_a, n_b, shown, links = plain(row)
            assert got[:3] == (n_a, n_b, shown), row
            assert linked(own, got[3]) == links


def test_whole_texts_and_pieces_agree():
    own, rows = align.Aligner(A, B), samples()
    want = own.align(rows)
    own.forget()
    own.safe = False
    assert own.align(rows) == want


def test_transducer_states_and_bounds(monkeypatch):
    walk = align.Transducer([b"ab", b"c", b"abcd"], [b"a", b"bc", b"bcd", b"x"])
    assert walk.groups([0, 1, 2], [0, 1, 0, 2]) == [(2, 2), (3, 4)]
    assert walk.dangling == [b"", b"ab", b"b", b"c", b"abcd", b"bcd"]
    for a, b in (([0], [0]), ([0], [3]), ([], [0]), ([0, 1], [0, 1, 3])):
        with pytest.raises(align.Mismatch):
            walk.groups(a, b)
    monkeypatch.setattr(align, "KNOWN_STEPS", 1)
    assert walk.groups([0, 1], [0, 1]) == [(2, 2)] and not walk.steps and walk.groups([0, 1], [0, 1]) == [(2, 2)]


def test_query_matches_brute_force(spark, plain):
    rows = [(1, None), (None, "the cat"), (2, "the cat"), (2, "the cat"), (3, ""), *enumerate(samples()[:120], 10)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, links string, n_a int").repartition(5)
    found = [(i, *plain(t)) for i, t in rows]
    n = Counter(p for *_, links in found for p in links)
    most: dict[int, int] = {}
    for (_, b), k in n.items():
        most[b] = max(most.get(b, 0), k)
    want = []
    for i, n_a, n_b, shown, links in found:
        digest = hashlib.sha256(shown.encode()).hexdigest() if n_a else ""
        want.append((i, n_a, n_b, len(shown.split(";")) if n_a else 0, len(links), sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links), digest))
    got = align.alignment_digests(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {(r.a_id, r.b_id): r.n for r in align.link_counts(df, A, B).collect()} == dict(n)
    assert align.alignment_digests(df.limit(0), A, B).count() == 0 and align.link_counts(df.limit(0), A, B).count() == 0
    assert {r.groups for r in align.aligned(df, A, B).filter("doc_id = 2").collect()} == {plain("the cat")[2]}
