"""Runs of words: repetitions found from Lyndon arrays of two opposite orders.

A text is a sequence of words, each a number. For an order of the words, the next smaller suffix of every place
gives the longest Lyndon word that starts there; every run has Lyndon words of one of two opposite orders as its
roots. The arrays are made from left to right, without suffix arrays, trees or hashes, by comparing words alone:

* The places that can be the previous smaller suffix of a new one form a chain. How far suffixes on the chain
  agree is kept, so that going up the chain decides most comparisons without looking at a word; where
  two agreements are equally long, the comparison goes on behind them.
* The stretch that was matched furthest to the right repeats an earlier stretch. A comparison inside it was made
  before, in the earlier one: its result is taken over if it ended inside, or else goes on from the stretch's end. So
  no word is matched again, and the number of matched words is linear in the text's length.

A place whose Lyndon word is followed by the same words again is the root of a repetition; it is extended to the
left by less than its own length, and reported from the leftmost of its roots.

Edge cases: a null text has no words and no runs; texts are read whole; a null id counts as one that is not
planted (see :func:`planted`); rows with equal ids stay apart; an empty table gives an empty result; other columns are
not read. A text is one row and so one task's work, in time linear in its length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import trim_memory, uncollected

#: A run has at least so many words, and at least so many periods.
MIN_WORDS, MIN_PERIODS = 24, 3


def lyndon_array(x: list[int]) -> tuple[list[int], list[int], int]:
    """For each place the next one whose suffix is smaller (``len(x)``, if there is none), how many elements the two
    suffixes share, and the number of elements matched on the way. A suffix is smaller than one it begins."""
    n = len(x)
    following, shared = [n] * n, [0] * n
    previous, agreed = [-1] * n, [0] * n  # the nearest smaller suffix to the left, and what both share
    start = far = shift = matched = 0  # x[t] == x[t - shift] for start <= t < far
    for i in range(1, n):
        a, j = x[i], i - 1
        while j >= 0 and x[j] > a:
            following[j] = i
            j = previous[j]
        if j < 0 or x[j] < a:
            previous[i] = j
            continue
        length = 1
        while True:
            open_end = True
            if i < far:
                back = i - shift
                k = j - shift if j >= start else j
                known = shared[k] if following[k] == back else agreed[back] if previous[back] == k else -1
                if known >= 0:
                    if known < far - i:
                        length, open_end = known, False
                    elif far - i > length:
                        length = far - i
            if open_end:
                before = length
                while i + length < n and x[j + length] == x[i + length]:
                    length += 1
                matched += length - before
                if i + length > far:
                    start, far, shift = i, i + length, i - j
            if i + length < n and x[j + length] < x[i + length]:
                previous[i], agreed[i] = j, length
                break
            following[j], shared[j] = i, length
            both, j = agreed[j], previous[j]
            while j >= 0 and both > length:
                following[j], shared[j] = i, length
                both, j = agreed[j], previous[j]
            if j < 0:
                break
            if both < length:
                previous[i], agreed[i] = j, both
                break
    return following, shared, matched


def find_runs(x: list[int], min_length: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``x`` with at least ``min_length`` elements and ``min_periods``
    (two or more) periods, in order of start and period."""
    if min_periods < 2:
        raise ValueError("a run has two periods at least")
    n, found = len(x), set()
    if n < max(min_length, min_periods):
        return []
    places = np.arange(n)
    for y in (x, [-v for v in x]):
        following, shared, _ = lyndon_array(y)
        period = np.array(following) - places
        behind = np.array(shared)
        # of a run's leftmost root, less than a period stands before it
        enough = np.maximum(min_length, min_periods * period) - 2 * period + 1
        for i in np.flatnonzero((behind >= enough) & (behind > 0)).tolist():
            p, left = following[i] - i, 0
            if i >= p and following[i - p] == i and shared[i - p] == shared[i] + p:
                continue
            while left < p and left < i and x[i - 1 - left] == x[i + p - 1 - left]:
                left += 1
            length = left + p + shared[i]
            if left < p and length >= max(min_length, min_periods * p):
                found.add((i - left, length, p))
    return sorted(found)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, and for a tenth of the ids (by the CRC of their decimals) repeated from some place on with some
    period: the input that the query over ``documents`` is defined on."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def numbered(words: list[bytes]) -> list[int]:
    """Equal numbers for equal words."""
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def digest(words: list[bytes]) -> tuple:
    """``(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of a text's words: its runs,
    the one with most periods, and the text with each run cut down to its first period."""
    runs = find_runs(numbered(words))
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    if not runs:
        return 0, None, None, None, None, listed, hashlib.sha256(b" ".join(words)).hexdigest()
    best = runs[0]
    change = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        start, length, period = run
        change[start + period] += 1
        change[start + length] -= 1
        if length * best[2] > best[1] * period:  # runs come in order of start and period: ties keep the first
            best = run
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
    collapsed = hashlib.sha256(b" ".join([words[i] for i in kept])).hexdigest()
    return len(runs), *best, 1000 * best[1] // best[2], listed, collapsed


FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
DDL = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow, narrow.schema["id"].dataType.simpleString()


def word_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """``(id_col, start, length, period)``: a row for every run of the words (parted by ASCII white space) of every text."""
    narrow, id_type = _narrow(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text")):
                own = find_runs(numbered((text.as_py() or b"").split()), min_words, min_periods)
                at += [i] * len(own)
                found += own
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "start", "length", "period"])
        trim_memory()

    return narrow.mapInArrow(run, f"id {id_type}, start long, length long, period long").withColumnRenamed("id", id_col)


def run_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """``(id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of every row of
    ``docs``, see :func:`digest`; with ``plant``, of texts after :func:`planted`."""
    narrow, id_type = _narrow(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            with uncollected():
                for doc_id, text in zip(batch.column("id"), batch.column("text"), strict=True):
                    words = (text.as_py() or b"").split()
                    made.append(digest(planted(doc_id.as_py(), words) if plant else words))
            columns = list(zip(*made, strict=True)) or [()] * len(FIELDS)
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", *(name for name, _ in FIELDS)])
        trim_memory()

    return narrow.mapInArrow(run, f"id {id_type}, {DDL}").withColumnRenamed("id", id_col)
