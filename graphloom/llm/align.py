"""Alignment of two tokenizers by a dangling-suffix transducer.

Two tokenizers cut the same bytes. Walking along both, the state is which of them leads and the bytes that the other
has not matched yet: a suffix of the leader's last token. The follower's next token either uses up some of these bytes,
or all of them, which closes a group, or goes beyond them, and then the other side leads. A step depends on
nothing but the state and the next token, so steps are remembered by both and bytes are compared once for each
such pair. Tokens are not empty, so each group ends with one token of each side: a link.

Where no token of either side can cross (before a single space between words), texts are cut into pieces. What a
worker knows about short pieces is remembered up to a bound in bytes. A piece that one of the tokenizers does not give back
byte by byte sends its text to be encoded whole.

Tokens that end together are each other's suffixes. The pairs that can be linked at all are therefore a property of
the two vocabularies (:attr:`Aligner.pairs`: one for each suffix of a token that is a token of the other side), however many
documents there are. Links are counted in such an array in each task, summed in Spark, and the summed array is
broadcast. Links are written once, as indices into the array, below the shared folder.

Edge cases: a null or empty text, and one whose tokens do not give back a space and the text on both sides (a text with
U+2581, which stands for a space there), has no tokens: zeros and an empty string. Special tokens' strings are plain text;
texts are read whole; rows with equal ids stay apart and count each; null ids stay; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import byte_alphabet
from graphloom.llm.common import by_bytes, materialize, texts, trim_memory, uncollected
from graphloom.llm.pieces import WHITE

#: Pieces of more characters are not remembered; the bytes and remembered steps that a worker keeps at most.
LONG, KNOWN_BYTES, KNOWN_STEPS = 64, 96 << 20, 1 << 20
#: What a remembered piece takes beside its strings.
ENTRY_BYTES = 340
BATCH_BYTES = 2 << 20
#: Texts whose links are counted at a time.
COUNTED_ROWS = 256
SPACE = "▁"

_UNSAFE = re.compile(f" (?=[{WHITE}]|$)")
_CUT = re.compile(f"(?<! ) (?=[^{WHITE}])")


class Mismatch(ValueError):
    """Two token sequences do not stand for the same bytes."""


class Transducer:
    """Steps between states, remembered. State 0 has nothing dangling; of the others, even ones have side A in the lead,
    odd ones side B."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.a_bytes, self.b_bytes = a_bytes, b_bytes
        self.shift = max(len(a_bytes), len(b_bytes)).bit_length()
        self.forget()

    def forget(self) -> None:
        """Drop states and steps."""
        self.steps: dict[int, int] = {}
        self.states: dict[bytes, int] = {}
        self.dangling: list[bytes] = [b""]

    def _state(self, dangling: bytes, b_leads: bool) -> int:
        at = self.states.setdefault(dangling, len(self.dangling))
        if at == len(self.dangling):
            self.dangling.append(dangling)
        return 2 * at + b_leads

    def _step(self, state: int, token: int) -> int:
        """The state after ``token``, of side A in state 0, else of the side that follows."""
        if state == 0:
            out = self._state(self.a_bytes[token], False)
        else:
            rest, b_leads = self.dangling[state >> 1], state & 1
            more = (self.a_bytes if b_leads else self.b_bytes)[token]
            if more == rest:
                out = 0
            elif rest.startswith(more):
                out = self._state(rest[len(more) :], bool(b_leads))
            elif more.startswith(rest):
                out = self._state(more[len(rest) :], not b_leads)
            else:
                raise Mismatch
        self.steps[state << self.shift | token] = out
        return out

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """``(end in a, end in b)`` of every group."""
        out, i, j, state, shift, get, step = [], 0, 0, 0, self.shift, self.steps.get, self._step
        try:
            while True:
                if state & 1 or not state:
                    if not state and i == len(a):
                        break
                    token = a[i]
                    i += 1
                else:
                    token = b[j]
                    j += 1
                after = get(state << shift | token)
                state = step(state, token) if after is None else after
                if not state:
                    out.append((i, j))
        except IndexError:
            raise Mismatch from None
        if j < len(b):
            raise Mismatch
        if len(self.steps) > KNOWN_STEPS:
            self.forget()
        return out


def suffix_pairs(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.ndarray:
    """``a << 32 | b`` in order, of all tokens of which one is a suffix of the other: what can end together."""
    out = []
    for left, right, swap in ((a_bytes, b_bytes, False), (b_bytes, a_bytes, True)):
        by_bytes: dict[bytes, list[int]] = {}
        for i, token in enumerate(right):
            by_bytes.setdefault(token, []).append(i)
        for i, token in enumerate(left):
            for k in range(len(token)):
                for j in by_bytes.get(token[k:], ()):
                    out.append(j << 32 | i if swap else i << 32 | j)
    return np.unique(np.array(out, np.int64))


class Aligner:
    """Two vocabularies: side A a ``.json`` file of the byte-level kind, side B a sentencepiece ``.model``."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_char = {c: b for b, c in enumerate(byte_alphabet())}
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        entries = {i: t.encode() if t in special else bytes(of_char[c] for c in t) for t, i in self.a.get_vocab().items()}
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.safe = plain and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.pairs = suffix_pairs(self.a_bytes, self.b_bytes)
        self.walk = Transducer(self.a_bytes, self.b_bytes)
        self.forget()

    def forget(self) -> None:
        """Drop the pieces known so far."""
        self.known: dict[str, tuple[int, int, str, bytes] | None] = {}
        self.older: dict[str, tuple[int, int, str, bytes] | None] = {}
        self.held = 0

    def encode(self, rows: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of both sides of texts behind a space, which side B adds itself."""
        left, right = [], []
        for start in range(0, len(rows), 1024):
            some = rows[start : start + 1024]
            left += [e.ids for e in self.a.encode_batch_fast([f" {x}" for x in some], add_special_tokens=False)]
            right += self.b.encode(some, num_threads=1)
        return left, right

    def entries(self, rows: list[str]) -> list[tuple[int, int, str, bytes] | None]:
        """What :meth:`align` tells of texts, encoded whole; None for texts with a mismatch."""
        left, right = self.encode(rows)
        a_bytes, groups = self.a_bytes, self.walk.groups
        made: list[tuple[int, int, str, int] | None] = []
        keys: list[int] = []
        for row, a, b in zip(rows, left, right, strict=True):
            try:
                if b"".join([a_bytes[t] for t in a])[1:] != row.encode():
                    raise Mismatch
                ends = groups(a, b)
            except Mismatch:
                made.append(None)
                continue
            shown, i, j = [], 0, 0
            for p, q in ends:
                last, end = a[p - 1], b[q - 1]
                keys.append(last << 32 | end)
                if p - i == q - j == 1:
                    shown.append(f"{last}|{end}")
                else:
                    shown.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
                i, j = p, q
            made.append((len(a), len(b), ";".join(shown), 4 * len(ends)))
        links, at = self.pairs.searchsorted(np.array(keys, np.int64)).astype("<i4").tobytes(), 0
        out: list[tuple[int, int, str, bytes] | None] = []
        for entry in made:
            if entry is None:
                out.append(None)
            else:
                out.append((*entry[:3], links[at : at + entry[3]]))
                at += entry[3]
        return out

    def _learn(self, wanted: set[str]) -> list[str]:
        """Know the pieces ``wanted``; those that are to be forgotten soon are returned."""
        older = self.older
        todo, long = [], []
        for piece in wanted.difference(self.known):
            if piece in older:
                self.known[piece] = entry = older[piece]
                self.held += self._size(piece, entry)
            else:
                todo.append(piece)
        for piece, entry in zip(todo, self.entries(todo), strict=True):
            self.known[piece] = entry
            if len(piece) > LONG:
                long.append(piece)
            else:
                self.held += self._size(piece, entry)
        return long

    @staticmethod
    def _size(piece: str, entry: tuple[int, int, str, bytes] | None) -> int:
        return ENTRY_BYTES + 4 * len(piece) + (len(entry[2]) + len(entry[3]) if entry else 0)

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a space and ``text``, each without the space it begins with."""
        if not self.safe:
            return [text]
        spaced = f" {text}"
        if not _UNSAFE.search(spaced):
            return text.split(" ")
        head, *words = _CUT.split(spaced)
        return [head[1:], *words] if head else words

    def align(self, rows: list[str]) -> list[tuple[int, int, str, bytes]]:
        """For each text the number of tokens of both sides, the groups (``a1,a2|b1;a3|b2,b3``), and the link that ends
        each group, as indices into :attr:`pairs` (32-bit, little-endian)."""
        if self.held > KNOWN_BYTES // 2:  # pieces met since the last time stay, those only known from before go
            self.older, self.known, self.held = self.known, {}, 0
        none, out = (0, 0, "", b""), []
        cut = [self._pieces(row) if row else [] for row in rows]
        long = self._learn(set().union(*cut))
        get = self.known.__getitem__
        for row, own in zip(rows, cut, strict=True):
            found = list(map(get, own))
            if None in found:
                found = [self.entries([row])[0] or none]
            if found:
                n_a, n_b, groups, links = zip(*found, strict=True)
                out.append((sum(n_a), sum(n_b), ";".join(groups), b"".join(links)))
            else:
                out.append(none)
        for piece in long:
            del self.known[piece]
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The process' aligner of two vocabulary files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_a, n_b, groups string, links binary)`` of every row, see :meth:`Aligner.align`."""
    return _aligned(docs, a_path, b_path, id_col, text_col, "groups", lambda groups: groups)


def _aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, name: str, shown) -> DataFrame:
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            rows = texts(batch)
            for a, b in by_bytes(rows, BATCH_BYTES):
                with uncollected():
                    n_a, n_b, groups, links = zip(*own.align(rows[a:b]), strict=True)
                columns = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(map(shown, groups), pa.string()), pa.array(links, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *columns], names=["id", "n_a", "n_b", name, "links"])
        own.forget()
        trim_memory()

    return narrow.mapInArrow(run, f"id {id_type}, n_a long, n_b long, {name} string, links binary").withColumnRenamed("id", id_col)


def _counted(links: DataFrame, n_pairs: int) -> np.ndarray:
    """How often each pair is linked. Tasks count into an array of fixed size; at most ``n_pairs`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_ROWS):
                some = batch.column("links").slice(start, COUNTED_ROWS).to_pylist()
                sums += np.bincount(np.frombuffer(b"".join(some), "<i4"), minlength=n_pairs)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["pair", "n"])

    rows = links.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_pairs, np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out


def link_counts(docs: DataFrame, a_path: str, b_path: str, *, text_col: str = "text") -> DataFrame:
    """``(a_id, b_id, n)``: how many links of all texts hold each pair of token ids."""
    pairs = aligner(a_path, b_path).pairs
    keyed = _aligned(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), a_path, b_path, "id", "text", "groups", lambda _: None)
    counts = _counted(keyed, len(pairs))
    at = np.flatnonzero(counts)
    return docs.sparkSession.createDataFrame(pa.table({"a_id": pairs[at] >> 32, "b_id": pairs[at] & 0xFFFFFFFF, "n": counts[at]}))


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row: tokens of both sides,
    groups, links, links whose pair is its B token's most frequent one over all texts (ties included), the
    frequencies of all links added up, and the SHA-256 of the groups (empty without tokens)."""
    pairs = aligner(a_path, b_path).pairs
    linked = materialize(_aligned(docs, a_path, b_path, id_col, text_col, "groups_sha256", lambda x: hashlib.sha256(x.encode()).hexdigest() if x else ""), "links")
    counts = _counted(linked, len(pairs))
    most = np.zeros(int((pairs & 0xFFFFFFFF).max()) + 1, np.int64)
    np.maximum.at(most, pairs & 0xFFFFFFFF, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == most[pairs & 0xFFFFFFFF]))
    kept = linked.withColumnRenamed(id_col, "id")
    kept = kept.select("id", "n_a", "n_b", "links", "groups_sha256")
    id_type = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column("links")]
            made = [[len(x) for x in own], [int(best[x].sum()) for x in own], [int(counts[x].sum()) for x in own]]
            n, n_best, total = (pa.array(c, pa.int64()) for c in made)
            columns = [batch.column("id"), batch.column("n_a"), batch.column("n_b"), n, n, n_best, total, batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
        trim_memory()

    ddl = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return kept.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
