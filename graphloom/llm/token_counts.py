"""Token counts: lengths from batch encoding inside Arrow functions.

Texts are split at safe boundaries (:mod:`graphloom.llm.pieces`) for a ``.json`` vocabulary of the byte-level
kind: before words, and in long pieces (of scripts that write no spaces, say) wherever letters, digits and
others change. The pieces that a worker has not met yet go to the library in batches of about equal bytes, and only
their lengths are kept. A text's count is the sum over its pieces. Long pieces are not remembered, and the memory of
known lengths is emptied when it holds so many bytes (:data:`graphloom.llm.pieces.KNOWN_BYTES`); that changes speed
only, never a count. Other vocabularies get whole texts, in batches balanced by bytes.

Edge cases: a null text counts as empty (0 tokens); special strings inside texts count as one token each, as
the library does by default; texts of any length are split, never cut off; rows with equal ids stay apart;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes, n_bytes, texts, trim_memory
from graphloom.llm import pieces
from graphloom.llm.pieces import special_splitter, split_words

BATCH_BYTES = 1 << 20


class PieceCounter:
    """Counts tokens of texts with a ``.json`` vocabulary of the byte-level kind."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split = special_splitter([t["content"] for t in spec.get("added_tokens", [])])
        pre = spec.get("pre_tokenizer") or {}
        plain = not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.safe = pre.get("type") == "ByteLevel" and plain
        self.forget()

    def _learn(self, known: dict[str, int], wanted: set[str], space: str) -> None:
        todo = list(wanted)
        self.held += pieces.known_bytes(todo)
        for a, b in by_bytes(todo, BATCH_BYTES):
            batch = self.tokenizer.encode_batch_fast([space + x for x in todo[a:b]], add_special_tokens=False)
            known.update(zip(todo[a:b], map(len, batch), strict=True))

    def forget(self) -> None:
        """Drop the lengths known so far."""
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.held = 0

    def _long(self, parts: list[str]) -> int:
        """The tokens of long pieces, cut where the pattern cuts."""
        out = 0
        tokens = [t for p in parts for t in pieces.tokens_of(p)]
        short = {t for t in tokens if len(t) <= pieces.LONG}
        self._learn(self.first, short.difference(self.first), "")
        out += sum(self.first[t] for t in tokens if len(t) <= pieces.LONG)
        rest = [t for t in tokens if len(t) > pieces.LONG]
        for a, b in by_bytes(rest, BATCH_BYTES):
            out += sum(map(len, self.tokenizer.encode_batch_fast(rest[a:b], add_special_tokens=False)))
        return out

    def counts(self, rows: list[str]) -> list[int]:
        if not self.safe:
            out: list[int] = []
            for a, b in by_bytes(rows, BATCH_BYTES):
                out += [len(e) for e in self.tokenizer.encode_batch_fast(rows[a:b], add_special_tokens=False)]
            return out
        if self.held > pieces.KNOWN_BYTES:
            self.forget()
        parts, first, later = [], set(), set()
        for row in rows:
            segments = self.split.split(row) if self.split and self.split.search(row) else [row]
            own: list[tuple[str, list[str]]] = []
            extra = 0
            for i, segment in enumerate(segments):
                if i % 2:
                    extra += 1
                elif segment:
                    words = split_words(segment)
                    head = words.pop(0)
                    if len(segment) > pieces.LONG and (len(head) > pieces.LONG or max(map(len, words), default=0) > pieces.LONG):
                        long = [p for p in (head, *(f" {w}" for w in words if len(w) > pieces.LONG)) if len(p) > pieces.LONG]
                        head = head if len(head) <= pieces.LONG else ""
                        words = [w for w in words if len(w) <= pieces.LONG]
                        extra += self._long(long)
                    first.add(head)
                    later.update(words)
                    own.append((head, words))
            parts.append((extra, own))
        self._learn(self.first, first.difference(self.first), "")
        self._learn(self.later, later.difference(self.later), " ")
        one, more = self.first.__getitem__, self.later.__getitem__
        return [extra + sum(one(head) + sum(map(more, words)) for head, words in own) for extra, own in parts]


class PieceModelCounter:
    """Counts tokens with a sentencepiece ``.model``."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def forget(self) -> None:
        """Nothing is kept between texts."""

    def counts(self, rows: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in by_bytes(rows, BATCH_BYTES):
            out += [len(x) for x in self.model.encode(rows[a:b], num_threads=1)]
        return out


_COUNTERS: dict[str, PieceCounter | PieceModelCounter] = {}


def counter(path: str) -> PieceCounter | PieceModelCounter:
    """The worker's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceModelCounter(path) if path.endswith(".model") else PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` of every row of ``docs``. ``vocabulary`` is the path of
    a public tokenizer's file on the workers."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            rows = texts(batch)
            n: list[int] = []
            for a, b in by_bytes(rows, 4 * BATCH_BYTES):
                n += own.counts(rows[a:b])
            size = list(map(n_bytes, rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )
        own.forget()
        trim_memory()

    out = narrow.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
