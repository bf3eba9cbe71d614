"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every code point that is neither a letter nor a mark (as in the middle of Indic words)
becomes a space and runs of spaces become one.
The n-grams of one to three code points are hashed into a fixed number of buckets. Training sums bucket
counts by language in Spark, over all labelled rows, and keeps a matrix of log probabilities, whose size is
buckets times languages however many documents there are. The matrix is broadcast; scoring gathers its rows
for a whole batch of texts and adds them up per text.

Edge cases: a text that is null or has no letter gets ``und`` with score 0; a table without a labelled
training row teaches no language, and then every text gets ``und``; ties go to the language that sorts
first; rows with equal ids stay apart; texts of any length are read whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes, texts, trim_memory

BUCKETS = 1 << 15
#: Bound of the matrix' other side; more labels than this are an error, not languages.
MAX_LANGUAGES = 512
SMOOTHING = 0.5
BLOCK_CHARS = 1 << 18
UNKNOWN = "und"

_OTHER, _OTHER_ASCII = regex.compile(r"[^\p{L}\p{M}]+"), re.compile("[^A-Za-z]+")
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def clean(text: str) -> str:
    """Letters in lower case, anything between them as one space, spaces at both ends."""
    other = _OTHER_ASCII if text.isascii() else _OTHER
    return f" {other.sub(' ', text).lower().strip(' ')} "


def has_letter(cleaned: str) -> bool:
    return any(c.isalpha() for c in cleaned[:4]) or any(map(str.isalpha, cleaned))


def hashed_ngrams(cleaned: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, a row for each of n = 1..3, and the texts' start positions.
    N-grams that reach into the next text have the bucket ``BUCKETS``, which counts for nothing."""
    code = np.frombuffer("".join(cleaned).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, cleaned), np.int64, len(cleaned))
    ends = np.cumsum(lengths)
    h = np.empty((3, len(code)), np.int32)
    acc = np.zeros(len(code), np.uint32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for n in range(3):
        acc[: len(code) - n] = (acc[: len(code) - n] ^ code[n:]) * _MULTIPLIERS[n] + np.uint32(n)
        acc ^= acc >> np.uint32(15)
        h[n] = (acc * np.uint32(0x27D4EB2F)) >> shift
        for back in range(1, n + 1):
            h[n][(ends - back)[lengths >= back]] = BUCKETS
    return h, ends - lengths


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, ``log_prob[buckets + 1, languages]`` (last row 0) and ``log_prior``."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray

    def predict(self, rows: list[str]) -> tuple[list[str], list[float]]:
        """Language and posterior probability of each text."""
        out_lang, out_score = [UNKNOWN] * len(rows), [0.0] * len(rows)
        if not self.languages:
            return out_lang, out_score
        cleaned = [clean(r) for r in rows]
        used = [i for i, c in enumerate(cleaned) if has_letter(c)]
        if not used:
            return out_lang, out_score
        h, starts = hashed_ngrams([cleaned[i] for i in used])
        total = np.tile(self.log_prior, (len(used), 1))
        for k in range(len(self.languages)):
            column = self.log_prob[:, k]
            total[:, k] += np.add.reduceat(column[h[0]] + column[h[1]] + column[h[2]], starts)
        best = total.argmax(1)
        score = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        for i, b, s in zip(used, best.tolist(), score.tolist(), strict=True):
            out_lang[i], out_score[i] = self.languages[b], s
        return out_lang, out_score


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on every row of ``labelled`` with a language and a letter."""
    spark = labelled.sparkSession
    narrow = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            rows, langs = texts(batch), batch.column("lang").to_pylist()
            for a, b in by_bytes(rows, BLOCK_CHARS):
                by_lang: dict[str, list[str]] = {}
                for text, lang in zip(rows[a:b], langs[a:b], strict=True):
                    cleaned = clean(text)
                    if has_letter(cleaned):
                        by_lang.setdefault(lang, []).append(cleaned)
                for lang, own in by_lang.items():
                    h, _ = hashed_ngrams(own)
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS + 1, np.int64)
                    sums[lang] += np.bincount(h.ravel(), minlength=BUCKETS + 1)
                    docs[lang] = docs.get(lang, 0) + len(own)
        for lang, row in sums.items():
            row[BUCKETS] = docs[lang]  # the bucket that counts for nothing carries the number of texts
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], names=["lang", "bucket", "n"]
            )
        trim_memory()

    counted = narrow.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(r["lang"] for r in labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang")).distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = counted.toArrow()
    index = {lang: k for k, lang in enumerate(langs)}
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[rows["bucket"].to_numpy(), [index[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    taught = counts[BUCKETS] > 0
    counts = counts[:, taught]
    n_docs = counts[BUCKETS].copy()
    smoothed = counts[:BUCKETS] + SMOOTHING
    log_prob = np.zeros(counts.shape)
    log_prob[:BUCKETS] = np.log(smoothed / smoothed.sum(0))
    return LanguageModel(tuple(x for x, t in zip(langs, taught, strict=True) if t), log_prob, np.log(n_docs / max(1, n_docs.sum())))


def held_out(id_col: str) -> Column:
    """True for the fifth of ids that a model must not learn from; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, *carry, lang_pred, score)`` of every row of ``docs``; ``carry`` names further columns of
    ``docs`` that the result keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *kept)
    extra = [f"carry_{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = texts(batch)
            langs: list[str] = []
            scores: list[float] = []
            for a, b in by_bytes(rows, BLOCK_CHARS):
                more = own.predict(rows[a:b])
                langs += more[0]
                scores += more[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(batch.column(c) for c in extra), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["id", *extra, "lang_pred", "score"],
            )
        trim_memory()

    fields = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in ["id", *extra])
    out = narrow.mapInArrow(run, f"{fields}, lang_pred string, score double")
    return out.toDF(id_col, *carry, "lang_pred", "score")
