"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are lower-cased and runs of white space become one space. Every item has one edit budget,
:data:`EDITS` of its length. If an item of ``m`` characters stands in a text with at most ``e`` edits, the place
shares at least ``m - q + 1 - q * e`` q-grams with the item, on diagonals (place in the text minus place in the
item) that lie within ``e`` of each other. Shared q-grams are counted in bands of ``2 * (e + 1)`` diagonals that
overlap by half, so some band holds all of them. Neighbouring bands that reach the bound form a region, which
is verified by an alignment banded to its diagonals.

Grams are :data:`Q` characters long, and shorter for items whose bound would fall below
:data:`LEAST_SHARED`, down to a bound of one, so every item has the whole edit budget.

Items shorter than :data:`WORD_CHARS` must stand as whole words: a place starts and ends at word boundaries. Of
these, items whose budget is no edit are looked up whole, by the hash of their length's strings, and compared.

The places of an item in a text are the ends where the alignment is within the budget and not worse than at the
ends beside it; of places that overlap, the one with fewest edits (then the first) stays.

The items' index is broadcast in shards of at most :data:`SHARD_CHARS` characters, one pass over the
texts for each shard, so its size on a worker is bounded however many items there are. A worker makes a shard's
index once.

Edge cases: items that are null or have nothing but white space are not searched; letters of scripts
without spaces between words are words by themselves; a null or empty text has no match; rows that repeat an id are searched each; an item that stands
in a text several times gives a row for each place, also where it overlaps with itself shifted (periodic items);
texts are searched whole; an empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import trim_memory
from graphloom.llm.hashing import prefix_hashes, spans, window_hashes

Q = 8
#: Items under this length must stand as whole words.
WORD_CHARS = 32
#: Edits allowed, as a share of an item's length.
EDITS = 0.1
#: Shared q-grams that the bound asks for at least; short items get shorter grams for it.
LEAST_SHARED = 6
#: Code points of scripts without spaces between words: Thai to Burmese, Khmer, and Chinese to Korean.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
SHARD_CHARS = 4 << 20
#: Diagonals that are aligned at a time.
ALIGNED = 1 << 16
FILTER_BITS = 22

SCHEMA = "item_id long, first_char long, end_char long, edits int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def edit_budget(m: int) -> int:
    return int(EDITS * m)


def gram_length(m: int) -> int:
    """The longest gram up to :data:`Q` that leaves the bound of an item of ``m`` characters at
    :data:`LEAST_SHARED`; for the shortest items, the longest that leaves it at one."""
    pieces = edit_budget(m) + 1
    return min(Q, (m + 1 - LEAST_SHARED) // pieces if m + 1 - LEAST_SHARED >= 4 * pieces else m // pieces)


def in_word(text: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter, digit or mark of a word that may go on beside it."""
    chars, at = np.unique(text, return_inverse=True)
    known = [not any(a <= c <= b for a, b in UNSPACED) and ((s := chr(c)).isalnum() or unicodedata.category(s)[0] == "M") for c in chars.tolist()]
    return np.array(known, bool)[at]


def word_edges(text: np.ndarray) -> np.ndarray:
    """Whether a word can begin or end at each of the ``len(text) + 1`` places."""
    edge = np.ones(len(text) + 1, bool)
    if len(text):
        word = in_word(text)
        edge[1:-1] = ~(word[1:] & word[:-1])
    return edge


class Apart:
    """Places ``(first, end, edits)`` that do not overlap, in the order in which they are offered."""

    def __init__(self) -> None:
        self.places: list[tuple[int, int, int]] = []

    def free(self, first: int, end: int) -> bool:
        i = bisect_right(self.places, (first, 1 << 62, 0))
        return (i == 0 or self.places[i - 1][1] <= first) and (i == len(self.places) or self.places[i][0] >= end)

    def add(self, first: int, end: int, edits: int) -> None:
        self.places.insert(bisect_right(self.places, (first, end, edits)), (first, end, edits))


def banded_edits(pattern: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool = False) -> np.ndarray:
    """For each diagonal in ``[low, high]``, the smallest edit distance of ``pattern`` to a substring of ``text``
    that ends on it, ``len(pattern)`` places after the diagonal, by alignments inside the band; the substring
    begins at any diagonal of the band, or at the text's start if ``anchored``. Ends outside the text have
    ``len(pattern) + 1``."""
    width = high - low + 1
    lane = np.arange(width)
    padded = np.full(width + len(pattern), 0xFFFFFFFF, np.uint32)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    big = len(pattern) + 1
    start = lane + low
    d = np.where((start >= 0) & (start <= len(text)), np.where(start > 0, start, 0) if anchored else 0, big)
    for i in range(1, len(pattern) + 1):
        step = d + (padded[i - 1 : i - 1 + width] != pattern[i - 1])
        step[:-1] = np.minimum(step[:-1], d[1:] + 1)
        d = np.minimum.accumulate(step - lane) + lane
    ends = lane + low + len(pattern)
    return np.minimum(np.where((ends >= 0) & (ends <= len(text)), d, big), big)


@dataclass
class ItemIndex:
    """Q-grams of all items of a shard, in hash order."""

    ids: list[int]
    codes: list[np.ndarray]
    q: int = Q

    def __post_init__(self) -> None:
        grams = [window_hashes(prefix_hashes(c), self.q) for c in self.codes]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        offset = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        self.item, self.offset = item[order].astype(np.int32), offset[order].astype(np.int32)
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([edit_budget(len(c)) for c in self.codes], np.int64)
        self.bound = self.length - self.q + 1 - self.q * self.budget

    def regions(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, lowest diagonal, highest diagonal)`` of bands that reach the bound."""
        h = window_hashes(prefix_hashes(text), self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return []
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        real = self.keys[i] == h[at]
        at, i = at[real], i[real]
        n = self.count[i]
        if not len(n):
            return []
        slot = np.repeat(self.first[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, diagonal = self.item[slot].astype(np.int64), np.repeat(at, n) - self.offset[slot]
        step = self.budget[item] + 1
        # diagonals count from the longest item's length below zero
        shift = int(self.length.max()) + 1
        half = (diagonal + shift) // step
        span = len(text) + 2 * shift + 2
        keys, votes = np.unique(item * span + half, return_counts=True)
        after = np.minimum(np.searchsorted(keys, keys + 1), len(keys) - 1)
        total = votes + np.where(keys[after] == keys + 1, votes[after], 0)
        bound = self.bound[keys // span]
        # a half band that reaches the bound alone makes the band that starts before it reach it too
        bands = np.unique(np.concatenate([keys[total >= bound], keys[votes >= bound] - 1]))
        out: list[tuple[int, int, int]] = []
        for key in bands.tolist():
            which, j = divmod(key, span)
            s = int(self.budget[which]) + 1
            low, high = j * s - shift, (j + 2) * s - shift - 1
            if out and out[-1][0] == which and low <= out[-1][2] + 1:
                out[-1] = (which, out[-1][1], high)
            else:
                out.append((which, low, high))
        return out

    def matches(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(item id, first, end, edits)`` of verified places, those of an item apart."""
        regions = self.regions(text)
        edge = word_edges(text) if any(self.length[which] < WORD_CHARS for which, _, _ in regions) else None
        ends: dict[int, list[tuple[int, int]]] = {}
        for which, low, high in regions:
            ends.setdefault(which, []).extend(self._ends(which, text, low, high, edge))
        out: list[tuple[int, int, int, int]] = []
        for which, found in ends.items():
            places = self._places(which, text, sorted(set(found)), edge)
            out += [(self.ids[which], *place) for place in places]
        return out

    def _ends(self, which: int, text: np.ndarray, low: int, high: int, edge: np.ndarray | None) -> list[tuple[int, int]]:
        """``(edits, end)`` of a region's ends that are within the budget and no worse than those beside them."""
        pattern, e = self.codes[which], int(self.budget[which])
        m, found = len(pattern), []
        for a in range(low - e, high + e + 1, ALIGNED):
            b = min(a + ALIGNED, high + e + 1)
            # an alignment within the budget stays within e diagonals of its end; one more on each side to compare with
            d = banded_edits(pattern, text, a - e - 1, b + e)[e : e + b - a + 2]
            own = d[1:-1]
            good = own <= e
            if m >= WORD_CHARS:
                good &= (own <= d[:-2]) & (own <= d[2:])
            at = np.flatnonzero(good)
            if m < WORD_CHARS:  # any end at a word's end counts
                at = at[edge[at + a + m]]
            found += zip(own[at].tolist(), (at + a + m).tolist(), strict=True)
        return found

    def _places(self, which: int, text: np.ndarray, ends: list[tuple[int, int]], edge: np.ndarray | None) -> list[tuple[int, int, int]]:
        """Places of the ends, best first, that do not overlap with better ones."""
        pattern, e = self.codes[which], int(self.budget[which])
        m, kept, later = len(pattern), Apart(), []
        for edits, end in ends:
            # the shortest place that can end here already overlaps
            if not kept.free(end - max(1, m - e), end):
                continue
            back = text[max(0, end - m - e) : end][::-1]
            d = banded_edits(pattern[::-1], back, -e, e, anchored=True)
            length = m - e + np.arange(2 * e + 1)
            if m < WORD_CHARS:
                d = np.where((length <= end) & edge[np.maximum(end - length, 0)], d, m + 1)
            best = int(d.min())
            if best > e:
                continue
            # of equally good beginnings, the first
            place = (end - int(length[np.flatnonzero(d == best)[-1]]), end, best)
            if best > edits:
                later.append(place)  # word boundaries made it worse: after those that are better
            elif kept.free(*place[:2]):
                kept.add(*place)
        for first, end, edits in sorted(later, key=lambda p: (p[2], p[1])):
            if kept.free(first, end):
                kept.add(first, end, edits)
        return kept.places


@dataclass
class WholeIndex:
    """Items that are searched without edits, by length and hash."""

    ids: list[int]
    codes: list[np.ndarray]

    def __post_init__(self) -> None:
        self.tables: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        for m in sorted({len(c) for c in self.codes}):
            own: dict[int, list[int]] = {}
            for k, c in enumerate(self.codes):
                if len(c) == m:
                    own.setdefault(int(spans(prefix_hashes(c), np.array([0]), np.array([m]))[0]), []).append(k)
            self.tables[m] = (np.array(sorted(own), np.uint64), own)

    def matches(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(item id, first, end, 0)`` of places that are whole words, those of an item apart."""
        if not self.tables or not len(text):
            return []
        edge = word_edges(text)
        starts, prefix = np.flatnonzero(edge), prefix_hashes(text)
        found: dict[int, Apart] = {}
        for m, (keys, own) in self.tables.items():
            at = starts[: np.searchsorted(starts, len(text) - m, "right")]
            at = at[edge[at + m]]
            h = spans(prefix, at, at + m)
            real = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
            for first, key in zip(at[real].tolist(), h[real].tolist(), strict=True):
                for which in own[key]:
                    kept = found.setdefault(which, Apart())
                    if np.array_equal(self.codes[which], text[first : first + m]) and kept.free(first, first + m):
                        kept.add(first, first + m, 0)
        return [(self.ids[which], *place) for which, kept in found.items() for place in kept.places]


def indexes(items: list[tuple[int, str]]) -> list[ItemIndex | WholeIndex]:
    """What finds the items: an index for each length of grams, and one of those that stand as they are."""
    kinds: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, t in items:
        # without a budget of edits, an item is a gram itself
        q = gram_length(len(t)) if edit_budget(len(t)) else 0
        kinds.setdefault(q, []).append((i, code_points(t)))
    return [ItemIndex([i for i, _ in own], [c for _, c in own], q) if q else WholeIndex([i for i, _ in own], [c for _, c in own]) for q, own in sorted(kinds.items())]


#: The worker's indexes of the shard that it met last.
_KNOWN: dict[str, list[ItemIndex | WholeIndex]] = {}


def known_indexes(key: str, items: list[tuple[int, str]]) -> list[ItemIndex | WholeIndex]:
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = indexes(items)
    return _KNOWN[key]


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id_col, item_id, first_char, end_char, edits)`` of every place of an item in a text; places count
    characters of the normalized text. ``id_col`` can have any type."""
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter(F.col("text").isNotNull())
    total = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    n_shards = max(1, -(-total // SHARD_CHARS))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    out = None
    for shard in range(n_shards):
        own = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)) == shard).collect()
        pairs = [(r["item_id"], normal(r["text"])) for r in own]
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(i, t) for i, t in pairs if t]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = known_indexes(*shared.value)
            for batch in batches:
                at: list[int] = []
                rows: list[tuple] = []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    codes = code_points(normal(text))
                    found = sorted((x for index in known for x in index.matches(codes)), key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))
                    at += [k] * len(found)
                    rows += found
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                    names=["id", "item_id", "first_char", "end_char", "edits"],
                )
            trim_memory()

        found = narrow.mapInArrow(run, f"id {id_type}, {SCHEMA}")
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("id", id_col)
