"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

A word's leaves hold ``rank * size + position`` of the pair that starts there (or nothing), so the tree's
root yields the leftmost pair of the lowest rank. A merge changes three leaves, each a logarithmic point
update; the word is done when the root is empty. Short words are merged many at a time: their trees are the
rows of one numpy array. Words of more than :data:`WIDE` bytes have a tree of their own.

Texts are cut into pieces at safe boundaries. A worker remembers the ids of short pieces and words, up to a bound
in bytes; long pieces, such as those of scripts that write no spaces, are put together from their words each time.

Edge cases: a null text is the empty text (0 ids); special strings inside texts become their ids, as the
library does by default, and decode to themselves; ids outside the vocabulary decode to nothing; byte
sequences that are not UTF-8 decode to U+FFFD; rows with equal ids of documents stay apart; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes, texts, trim_memory
from graphloom.llm import pieces
from graphloom.llm.pieces import special_splitter, split_words, tokens_of

NONE = np.int64(1 << 62)
WIDE = 64
BLOCK = 1 << 15


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a vocabulary file: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """Encoder and decoder of a ``.json`` vocabulary of the byte-level kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        self.base = len(vocab) + len(spec["added_tokens"])
        self.bytes_of = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if all(c in to_byte for c in s)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: s.encode() for s, i in self.specials.items()})
        self.split = special_splitter(list(self.specials))
        self.of_byte = np.array([vocab[c] for c in alphabet], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        unique, first = np.unique(keys, return_index=True)
        self.keys, self.ranks = np.append(unique, NONE), np.append(first, 0).astype(np.int64)
        self.forget()

    # -- merging

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Leaves of pairs of ids; an id of -1 has no pair."""
        key = left * self.base + right
        i = np.searchsorted(self.keys, key)
        found = (self.keys[i] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[i] * size + at, NONE)

    def _merge_rows(self, words: list[bytes], size: int) -> list[bytes]:
        """Ids (little-endian uint32 bytes) of words of at most ``size`` bytes, a power of two."""
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        lengths = np.fromiter(map(len, words), np.int64, n)
        cols = np.arange(size)
        # a column on either side of the word for "no neighbour"
        ids = np.full((n, size + 2), -1, np.int64)
        ids[:, 1:-1] = np.where(cols < lengths[:, None], self.of_byte[raw], -1)
        after = np.tile(np.arange(1, size + 3, dtype=np.int64), (n, 1))
        after[:, -1] = size + 1
        before = np.tile(np.arange(-1, size + 1, dtype=np.int64), (n, 1))
        before[:, 0] = 0
        tree = np.full((n, 2 * size), NONE, np.int64)
        tree[:, size:] = self._leaf(ids[:, 1:-1].ravel(), ids[:, 2:].ravel(), np.tile(cols, n), size).reshape(n, size)
        for level in range(size.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at = root % size + 1  # positions count from 1 in ids
            gone = after[live, at]
            then = after[live, gone]
            prior = before[live, at]
            ids[live, at] = self.made[root // size]
            ids[live, gone] = -1
            after[live, at] = then
            before[live, then] = at
            here, left, right = ids[live, at], ids[live, prior], ids[live, then]
            for pos, leaf in (
                (gone, np.full(len(live), NONE)),
                (at, self._leaf(here, right, at - 1, size)),
                (prior, self._leaf(left, here, prior - 1, size)),
            ):
                rows, node = live, pos - 1 + size
                if pos is prior:
                    real = prior > 0
                    rows, node, leaf = live[real], node[real], leaf[real]
                tree[rows, node] = leaf
                node = node >> 1
                while len(node) and node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < NONE]
        keep = ids[:, 1:-1] >= 0
        flat = ids[:, 1:-1][keep].astype("<u4").tobytes()
        ends = (4 * np.cumsum(keep.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_one(self, word: bytes) -> bytes:
        """Ids of one word of any length, with plain lists as the tree."""
        n, none = len(word), int(NONE)
        size = 1 << (n - 1).bit_length()
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, base, made = self.rank_of, self.base, self.made.tolist()

        def leaf(i: int) -> int:
            j = after[i]
            rank = rank_of.get(ids[i] * base + ids[j]) if j < n else None
            return none if rank is None else rank * size + i

        tree = [none] * (2 * size)
        tree[size : size + n] = map(leaf, range(n))
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            node >>= 1
            while node:
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value
                node >>= 1

        while (root := tree[1]) < none:
            rank, at = divmod(root, size)
            gone = after[at]
            ids[at], ids[gone] = made[rank], -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word."""
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > WIDE:
                out[i] = self._merge_one(w)
            elif w:
                classes.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for size, members in classes.items():
            step = max(1, BLOCK // size)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    # -- texts

    def _learn_words(self, words: set[str]) -> None:
        new = list(words.difference(self.words))
        self.held += pieces.known_bytes(new)
        self.words.update(zip(new, self.merge([w.encode() for w in new]), strict=True))

    def _learn(self, known: dict[str, bytes], wanted: set[str], space: str) -> None:
        # letters alone, with the space before them, are one token of the pattern
        cut = {piece: [space + piece] if piece.isalpha() else tokens_of(space + piece) for piece in wanted}
        self._learn_words({w for ws in cut.values() for w in ws})
        self.held += pieces.known_bytes(wanted)
        get = self.words.__getitem__
        known.update((piece, b"".join(map(get, ws))) for piece, ws in cut.items())

    def _long(self, piece: str) -> bytes:
        """Ids of a long piece; its words are remembered if they are short."""
        words = tokens_of(piece)
        self._learn_words({w for w in words if len(w) <= pieces.LONG})
        rest = list({w for w in words if len(w) > pieces.LONG})
        own = dict(zip(rest, self.merge([w.encode() for w in rest]), strict=True))
        return b"".join([own[w] if len(w) > pieces.LONG else self.words[w] for w in words])

    def forget(self) -> None:
        """Drop the pieces and words known so far."""
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian uint32 bytes."""
        if self.held > pieces.KNOWN_BYTES:
            self.forget()
        parts, first, later = [], set(), set()
        for row in rows:
            segments = self.split.split(row) if self.split and self.split.search(row) else [row]
            own: list[bytes | tuple[str, list[str]]] = []
            for i, segment in enumerate(segments):
                if i % 2:
                    own.append(np.uint32(self.specials[segment]).tobytes())
                elif segment:
                    words = split_words(segment)
                    head = words.pop(0)
                    if len(segment) > pieces.LONG and (len(head) > pieces.LONG or max(map(len, words), default=0) > pieces.LONG):
                        self._cut(own, head, words, first, later)
                        continue
                    first.add(head)
                    later.update(words)
                    own.append((head, words))
            parts.append(own)
        self._learn(self.first, first.difference(self.first), "")
        self._learn(self.later, later.difference(self.later), " ")
        one, more = self.first.__getitem__, self.later.__getitem__
        return [b"".join(x if isinstance(x, bytes) else one(x[0]) + b"".join(map(more, x[1])) for x in own) for own in parts]

    def _cut(self, own: list[bytes | tuple[str, list[str]]], head: str, words: list[str], first: set[str], later: set[str]) -> None:
        """Add a segment with long pieces to ``own``: runs of short pieces, and ids of long ones."""
        run: list[str] = []
        if len(head) > pieces.LONG:
            own.append(self._long(head))
            head = ""
        for word in words:
            if len(word) <= pieces.LONG:
                run.append(word)
                continue
            own += [(head, run), self._long(f" {word}")]
            first.add(head)
            later.update(run)
            head, run = "", []
        own.append((head, run))
        first.add(head)
        later.update(run)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special ones included."""
        get = self.bytes_of
        return b"".join([get.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


DIGESTS = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
DIGESTS_DDL = "n_tokens long, ids_sha256 string, decoded_sha256 string"

_CODECS: dict[str, Bpe] = {}


def codec(path: str) -> Bpe:
    """The worker's codec for a vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = Bpe(path)
    return _CODECS[path]


def _run(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, row, fields: list[pa.Field], ddl: str) -> DataFrame:
    """Encode each text and give its ids and text to ``row``, which makes the output columns."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            rows = texts(batch)
            for a, b in by_bytes(rows, 4 << 20):
                made = [row(own, ids) for ids in own.encode(rows[a:b])]
                columns = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=True))],
                    names=["id", *(f.name for f in fields)],
                )
        own.forget()
        trim_memory()

    return narrow.mapInArrow(run, f"id {id_type}, {ddl}").withColumnRenamed("id", id_col)


def encode_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` of every row of ``docs``."""
    ids = pa.field("ids", pa.list_(pa.int32()))
    return _run(docs, vocabulary, id_col, text_col, lambda own, x: (np.frombuffer(x, "<i4"),), [ids], "ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)`` of rows of ids; null ids give a null text."""
    narrow = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            rows = [None if x is None else own.decode(np.array(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.string())], names=["id", "text"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def roundtrip_digests(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)``: ids and decoded text of every row, as digests."""

    def row(own: Bpe, ids: bytes) -> tuple[int, str, str]:
        decoded = own.decode(ids).encode()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _run(docs, vocabulary, id_col, text_col, row, DIGESTS, DIGESTS_DDL)


def encoded_digests(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of :func:`roundtrip_digests` and the ids themselves (``ids array<int>``)."""

    def row(own: Bpe, ids: bytes) -> tuple[int, str, str, np.ndarray]:
        decoded = own.decode(ids).encode()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), np.frombuffer(ids, "<i4")

    fields = [*DIGESTS, pa.field("ids", pa.list_(pa.int32()))]
    return _run(docs, vocabulary, id_col, text_col, row, fields, f"{DIGESTS_DDL}, ids array<int>")
