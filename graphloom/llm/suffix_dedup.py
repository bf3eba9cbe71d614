"""Removal of long byte strings that repeat across documents, by hash-compared suffix sorting.

A byte goes if it is covered by a string of ``K`` bytes that also starts in a document with a smaller id.
Sorting all suffixes of a corpus in one place is out of the question, so suffixes are brought together by
content, level by level, and only those that a cheaper level leaves open are sorted:

1. Every window of ``K`` bytes is assigned to its minimizer, the leftmost smallest hash among its grams of
   ``GRAM`` bytes. Equal windows have equal minimizers. Neighbouring windows of one minimizer form a run.
2. Gram hashes meet in buckets; grams of one document only are done with.
3. For the others, a 128-bit BLAKE2b digest of the run's bytes says whether the gram always stands in the same
   bytes; then all documents but the smallest lose the run.
4. The bytes of the remaining runs meet by gram. Their suffixes that start a window, at the same distance
   from the gram, are sorted: prefix polynomial hashes and binary search find the common extension of two
   suffixes, so a comparison is logarithmic, inside a mergesort whose comparisons are made for a whole level
   at once. The order is verified byte by byte; where hashes that collide have led it astray, the bytes
   themselves decide. Of a set of windows that share ``K`` bytes, all but the smallest document's go.

Polynomial hashes only bring bytes together: inside a pack, bytes are compared as such.

Documents are dealt to packs by their id's hash. Each pack combines what it sends
(one entry for each gram, or gram and run), so a passage that stands in a third of all documents is at most
one entry per pack in any task. A gram with very many different runs (a common line between
different neighbours) is sent window by window instead, dealt by the windows' own hashes. Packs and the buckets in
which they meet hold :data:`PACK_BYTES` at least and grow with the root of the input, so that a message from a pack to
a bucket is not much smaller than its head (10 MB each at 1 TB, 100 MB at 100 TB).

The texts are shuffled once: every level is one lazy plan over the same exchange, and answers go back to the
packs as bits.

Edge cases: a null text is empty; texts shorter than ``K`` lose nothing; rows with equal ids count as one
document (they do not remove each other's bytes); rows without an id lose nothing, remove nothing and stay out of the
packs; an empty table gives an empty result; matches never cross documents; columns that are not carried are not read.
"""

from __future__ import annotations

import hashlib
import math
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import trim_memory
from graphloom.llm.hashing import mix, prefix_hashes, spans, window_hashes

K, GRAM = 50, 25
PACK_BYTES = 3 << 20
BUCKET_BYTES = 3 << 20
#: Text is hashed in stretches of about so many bytes, for the processor's caches.
STRETCH = 256 << 10
#: A gram with more different runs than this is sent window by window.
MANY_RUNS = 4096

MESSAGE = "bucket int, pid int, kind int, n int, data binary"


class Runs:
    """Runs of the windows of a pack's documents: ``doc`` (position in the pack), ``first`` (of the run's
    windows, in its document), ``count`` of windows, ``gram`` hashes, ``lead`` (bytes before the gram)."""

    def __init__(self, texts: list[bytes], ids: np.ndarray) -> None:
        self.texts, self.ids = texts, ids
        parts: list[tuple[np.ndarray, ...]] = []
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) >= K:
                held.append(i)
                size += len(text)
            if held and (size >= STRETCH or i == len(texts) - 1):
                parts.append(self._stretch(held))
                held, size = [], 0
        if held:
            parts.append(self._stretch(held))
        empty = np.zeros(0, np.int64)
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [empty, empty, empty, empty.astype(np.uint64), empty]
        self.doc, self.first, self.count, self.gram, self.lead = columns

    def _stretch(self, docs: list[int]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(self.texts[i] for i in docs), np.uint8)
        prefix = prefix_hashes(data)
        h = window_hashes(prefix, GRAM)
        # leftmost smallest gram of K - GRAM + 1 from each place on, by doubling
        at = np.arange(len(h), dtype=np.int32)
        low, width, need = h, 1, K - GRAM + 1
        while width < need:
            step = min(width, need - width)
            n = len(low) - step
            first = low[:n] <= low[step:]
            low, at = np.where(first, low[:n], low[step:]), np.where(first, at[:n], at[step:])
            width += step
        lengths = np.array([len(self.texts[i]) for i in docs], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        # windows that reach over a document's end are none
        good = np.ones(len(at), bool)
        for e in ends[:-1].tolist():
            good[max(0, e - K + 1) : e] = False
        place = np.flatnonzero(good)
        anchor = at[place]
        new = np.ones(len(place), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(place)))
        begin, anchor = place[head], anchor[head].astype(np.int64)
        which = np.searchsorted(ends, begin, side="right")
        # minimizers are the smallest hashes, so buckets in hash order would be uneven; mixed again (one to one) they are even
        return np.array(docs, np.int64)[which], begin - starts[which], count, mix(h[anchor]), anchor - begin

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        """The bytes of each of these runs."""
        texts, first = self.texts, self.first[which]
        ends = first + self.count[which] + (K - 1)
        return [texts[d][a:b] for d, a, b in zip(self.doc[which].tolist(), first.tolist(), ends.tolist(), strict=True)]


def numbered(strings: list[bytes], in_order: bool = False) -> tuple[np.ndarray, list[bytes]]:
    """A number for each string, the same for the same bytes, and the bytes of each number. Where numbers must be those
    of another reading of the pack, whose documents may come in another order, they are in the strings' order."""
    distinct = sorted(set(strings)) if in_order else list(dict.fromkeys(strings))
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    return np.fromiter(map(number.__getitem__, strings), np.int64, len(strings)), distinct


def _trimmed(f, two: bool = False):
    """``f`` with the memory of the group before given back first, and its own after it: the worker may be idle next."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        trim_memory()
        out = f(pdf)
        trim_memory()
        return out

    def both(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        trim_memory()
        out = f(pdf, answers)
        trim_memory()
        return out

    return both if two else one


def _pack(pdf: pd.DataFrame) -> tuple[Runs, np.ndarray, np.ndarray]:
    """Runs of a pack, its distinct grams in order, and each run's gram's place among these."""
    runs = Runs([t or b"" for t in pdf["text"]], pdf["id"].to_numpy(np.int64))
    grams, slot = np.unique(runs.gram, return_inverse=True)
    return runs, grams, slot


def _group_min_max(slot: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each slot; every slot has one."""
    order = np.argsort(slot, kind="stable")
    first = np.searchsorted(slot[order], np.arange(n))
    v = values[order]
    return np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)


def _messages(pid: int, kind: int, bucket: np.ndarray, records: np.ndarray) -> pd.DataFrame:
    """A row for each bucket, of records that are in bucket order."""
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(head[1:], len(bucket)) if len(head) else head
    return pd.DataFrame(
        {"bucket": bucket[head].astype(np.int32), "pid": np.int32(pid), "kind": np.int32(kind), "n": (ends - head).astype(np.int32),
         "data": [records[a:b].tobytes() for a, b in zip(head, ends, strict=True)]}
    )


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in hash order."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


# -- level 2: which grams stand in more than one document

GRAM_ENTRY = np.dtype([("gram", "<u8"), ("many", "u1")])


def _send_grams(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, grams, slot = _pack(pdf)
        out = np.zeros(len(grams), GRAM_ENTRY)
        out["gram"] = grams
        if len(grams):
            low, high = _group_min_max(slot, runs.ids[runs.doc], len(grams))
            out["many"] = low != high
        return _messages(int(pdf["pid"].iloc[0]), 0, _bucket_of(grams, buckets), out)

    return run


def _records(pdf: pd.DataFrame, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of a bucket, and the row each comes from."""
    parts = [np.frombuffer(d, kind) for d in pdf["data"]]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _answers(pdf: pd.DataFrame, kind: int, codes: np.ndarray, origin: np.ndarray) -> pd.DataFrame:
    """The codes, sent back to the packs in the order of their records."""
    bounds = np.searchsorted(origin, np.arange(len(pdf) + 1))
    return pd.DataFrame(
        {"bucket": pdf["bucket"].to_numpy(), "pid": pdf["pid"].to_numpy(), "kind": np.int32(kind), "n": pdf["n"].to_numpy(),
         "data": [codes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]}
    )


def _meet_grams(pdf: pd.DataFrame) -> pd.DataFrame:
    rec, origin = _records(pdf, GRAM_ENTRY)
    _, slot, n = np.unique(rec["gram"], return_inverse=True, return_counts=True)
    codes = (n[slot] > 1) | (rec["many"] > 0)
    bounds = np.searchsorted(origin, np.arange(len(pdf) + 1))
    out = _answers(pdf, 1, codes, origin)
    out["data"] = [np.packbits(codes[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _shared(answers: pd.DataFrame, grams: np.ndarray) -> np.ndarray:
    """Which of a pack's grams stand in more than one document."""
    own = answers[answers["kind"] == 1].sort_values("bucket")
    bits = [np.unpackbits(np.frombuffer(d, np.uint8), count=n) for d, n in zip(own["data"], own["n"], strict=True)]
    out = np.concatenate([*bits, np.zeros(0, np.uint8)]).astype(bool)
    if len(out) != len(grams):
        raise ValueError("answers do not fit the pack")
    return out


# -- level 3: which of these grams stand in the same bytes everywhere

RUN_ENTRY = np.dtype([("gram", "<u8"), ("high", "<u8"), ("low", "<u8"), ("doc", "<i8"), ("runs", "<i4")])
DONE_HERE, DONE_ELSEWHERE, OPEN, OPEN_MANY = 1, 2, 3, 4


def _send_runs(buckets: int):
    def run(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"bucket": [], "pid": [], "kind": [], "n": [], "data": []})
        runs, grams, slot = _pack(pdf)
        shared = _shared(answers, grams)
        keep = np.flatnonzero(shared[slot]) if len(slot) else np.zeros(0, np.int64)
        n = int(shared.sum())
        out = np.zeros(n, RUN_ENTRY)
        if n:
            own = (np.cumsum(shared) - 1)[slot[keep]]
            out["gram"] = grams[shared]
            out["doc"] = _group_min_max(own, runs.ids[runs.doc[keep]], n)[0]
            number, raw = numbered(runs.bytes_of(keep))
            pairs = np.unique(own * len(raw) + number)
            out["runs"] = np.bincount(pairs // len(raw), minlength=n)
            # where a gram has several runs here, which of them is named does not matter
            named = (pairs % len(raw))[np.searchsorted(pairs // len(raw), np.arange(n))]
            digest = np.frombuffer(b"".join(blake2b(raw[k], digest_size=16).digest() for k in named.tolist()), "<u8").reshape(-1, 2)
            out["high"], out["low"] = digest[:, 0], digest[:, 1]
        return _messages(int(pdf["pid"].iloc[0]), 0, _bucket_of(out["gram"], buckets), out)

    return run


def _meet_runs(pdf: pd.DataFrame, many_runs: int) -> pd.DataFrame:
    rec, origin = _records(pdf, RUN_ENTRY)
    grams, slot = np.unique(rec["gram"], return_inverse=True)
    doc, _ = _group_min_max(slot, rec["doc"], len(grams))
    _, most = _group_min_max(slot, rec["runs"], len(grams))
    total = np.bincount(slot, rec["runs"])
    one = most == 1
    for half in ("high", "low"):
        least, largest = _group_min_max(slot, rec[half], len(grams))
        one &= least == largest
    one = one[slot]
    codes = np.where(one, np.where(rec["doc"] == doc[slot], DONE_HERE, DONE_ELSEWHERE), np.where(total[slot] > many_runs, OPEN_MANY, OPEN))
    return _answers(pdf, 2, codes.astype(np.uint8), origin)


def _codes(answers: pd.DataFrame, shared: np.ndarray) -> np.ndarray:
    """A code for each of a pack's grams, 0 for those of one document."""
    own = answers[answers["kind"] == 2].sort_values("bucket")
    out = np.zeros(len(shared), np.uint8)
    out[shared] = np.concatenate([*(np.frombuffer(d, np.uint8) for d in own["data"]), np.zeros(0, np.uint8)])
    return out


# -- level 4: the bytes of open runs

PIECE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("lead", "<i2"), ("bytes", f"S{2 * K - GRAM}"), ("length", "<i2")])


def _open_pieces(runs: Runs, slot: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces of a pack in key order, with the smallest document of each; for every (open run,
    window) or whole open run its piece, the run, and the window's place in the run (-1: the whole run)."""
    code = codes[slot] if len(slot) else np.zeros(0, np.uint8)
    whole, many = np.flatnonzero(code == OPEN), np.flatnonzero(code == OPEN_MANY)
    owner = [whole]
    window = [np.full(len(whole), -1)]
    # what tells pieces of one key apart: a number for the same bytes
    raws = runs.bytes_of(whole)
    key, sub = [runs.gram[whole]], [numbered(raws, in_order=True)[0]]
    windows: list[bytes] = []
    for r, raw in zip(many.tolist(), runs.bytes_of(many), strict=True):
        h = window_hashes(prefix_hashes(np.frombuffer(raw, np.uint8)), K)
        owner.append(np.full(len(h), r))
        window.append(np.arange(len(h)))
        key.append(h)
        windows += [raw[w : w + K] for w in range(len(h))]
    sub.append(numbered(windows, in_order=True)[0])
    raws += windows
    owner, window, key, sub = (np.concatenate(x) for x in (owner, window, key, sub))
    order = np.lexsort((runs.ids[runs.doc[owner]], sub, key))
    owner, window, key, sub = owner[order], window[order], key[order], sub[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
    piece = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    out = np.zeros(len(head), PIECE)
    out["key"], out["doc"] = key[head], runs.ids[runs.doc[owner[head]]]
    chosen = [raws[k] for k in order[head].tolist()]
    out["bytes"], out["length"] = chosen, [len(raw) for raw in chosen]
    out["lead"] = np.where(window[head] >= 0, 0, runs.lead[owner[head]])
    return out, piece, owner, window


def _send_pieces(buckets: int):
    def run(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"bucket": [], "pid": [], "kind": [], "n": [], "data": []})
        runs, grams, slot = _pack(pdf)
        codes = _codes(answers, _shared(answers, grams))
        pieces, _, _, _ = _open_pieces(runs, slot, codes)
        return _messages(int(pdf["pid"].iloc[0]), 0, _bucket_of(pieces["key"], buckets), pieces)

    return run


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int = K) -> np.ndarray:
    """How many bytes, up to ``limit``, the suffixes at ``a`` and ``b`` share: binary search on hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
    same = spans(prefix, a, a + limit) == spans(prefix, b, b + limit)
    low[same] = limit
    open_ = np.flatnonzero(~same)
    high[open_] = limit - 1
    while len(open_):
        mid = (low[open_] + high[open_] + 1) >> 1
        x, y = a[open_], b[open_]
        eq = spans(prefix, x, x + mid) == spans(prefix, y, y + mid)
        low[open_] = np.where(eq, mid, low[open_])
        high[open_] = np.where(eq, high[open_], mid - 1)
        open_ = open_[low[open_] < high[open_]]
    return low


def suffix_less(data: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
    """Whether the first ``K`` bytes at ``a`` sort before those at ``b`` (or equal them, where asked)."""
    n = common_extension(prefix, a, b)
    end = n >= K
    n = np.minimum(n, K - 1)
    return np.where(end, or_equal, data[a + n] < data[b + n])


def sort_suffixes(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray | None:
    """Order of suffixes by group, then by their first ``K`` bytes: a bottom-up mergesort in which all
    merges of a level are one batch. Each suffix finds its rank in the neighbouring run by binary search.
    None if hashes collide so that ranks contradict each other."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.searchsorted(g, g)  # a group's first place
    size = np.searchsorted(g, g, side="right") - first
    index = np.arange(len(g)) - first
    width, widest = 1, int(size.max(initial=0))
    while width < widest:
        mine = index // width
        pair = (mine & ~1) * width
        left = (mine & 1) == 0
        other = np.where(left, pair + width, pair)
        n_other = np.clip(size - other, 0, width)
        low, high = np.zeros(len(g), np.int64), n_other.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            them = order[first[live] + other[live] + mid]
            # equal suffixes of the left run come first
            before = suffix_less(data, prefix, start[them], start[order[live]], ~left[live])
            low[live] = np.where(before, mid + 1, low[live])
            high[live] = np.where(before, high[live], mid)
            live = live[low[live] < high[live]]
        to = first + pair + (index - mine * width) + low
        moved = np.full(len(order), -1, order.dtype)
        moved[to] = order
        if (moved < 0).any():
            return None
        order = moved
        width *= 2
    return order


def _in_order(data: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the ``K`` bytes at ``before`` equal those at ``after``, and whether they do not sort behind them."""
    rows = np.lib.stride_tricks.sliding_window_view(data, K)
    same, good = np.empty(len(before), bool), np.empty(len(before), bool)
    for a in range(0, len(before), 1 << 15):
        part = slice(a, a + (1 << 15))
        x, y = (np.ascontiguousarray(rows[at[part]]).view(f"S{K}")[:, 0] for at in (before, after))
        same[part] = x == y
        good[part] = x <= y
    return same, good


def _repeated(data: np.ndarray, start: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix, whether a suffix of its group with a smaller document has the same ``K`` bytes."""
    if not len(start):
        return np.zeros(0, bool)
    order = sort_suffixes(data, prefix_hashes(data), start, group)

    def neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, g = start[order], group[order]
        near = np.flatnonzero(g[1:] == g[:-1]) + 1
        return near, *_in_order(data, s[near - 1], s[near])

    near, same, good = neighbours(order) if order is not None else (None, None, np.zeros(1, bool))
    if not good.all():  # hashes collided: the bytes themselves decide
        raw = data[start[:, None] + np.arange(K)]
        order = np.lexsort((*raw.T[::-1], group))
        near, same, _ = neighbours(order)
    equal = np.zeros(len(start), bool)
    equal[near] = same
    place = np.cumsum(~equal) - 1
    least, _ = _group_min_max(place, doc[order], int(place[-1]) + 1)
    out = np.zeros(len(start), bool)
    out[order] = doc[order] > least[place]
    return out


def _meet_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    rec, origin = _records(pdf, PIECE)
    masks = np.zeros(len(rec), "<u4")
    order = np.argsort(rec["key"], kind="stable")
    key = rec["key"][order]
    edge = np.concatenate([[True], key[1:] != key[:-1]])
    size = np.diff(np.append(np.flatnonzero(edge), len(key)))
    met = order[np.repeat(size > 1, size)]
    step = 1 << 13  # pieces at a time, whole keys
    ends = np.cumsum(size[size > 1])
    a = 0
    while a < len(met):
        i = np.searchsorted(ends, a + step, side="left")
        b = int(ends[min(i, len(ends) - 1)])
        part = met[a:b]
        own = rec[part]
        # equal pieces meet as one, with the smallest document
        _, first, slot = np.unique(own[["key", "length", "bytes"]], return_index=True, return_inverse=True)
        least, _ = _group_min_max(slot, own["doc"], len(first))
        distinct = own[first]
        length = distinct["length"].astype(np.int64)
        width = PIECE["bytes"].itemsize
        data = distinct["bytes"].view(np.uint8) if distinct["bytes"].flags.c_contiguous else np.ascontiguousarray(distinct["bytes"]).view(np.uint8)
        n = length - K + 1
        piece = np.repeat(np.arange(len(first)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        _, keys = np.unique(distinct["key"], return_inverse=True)
        group = keys[piece] * 64 + (distinct["lead"].astype(np.int64)[piece] - offset + 32)
        gone = _repeated(data, piece * width + offset, np.unique(group, return_inverse=True)[1], least[piece])
        mask = np.zeros(len(first), np.uint32)
        np.bitwise_or.at(mask, piece[gone], np.uint32(1) << offset[gone].astype(np.uint32))
        every = ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        masks[part] = np.where(own["doc"] > least[slot], every[slot], mask[slot])
        a = b
    return _answers(pdf, 3, masks, origin)


# -- the result

RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _parts(text: bytes, cover: np.ndarray) -> list[bytes]:
    """What is left between the bytes that are covered."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], cover, [True]]).astype(np.int8)))
    return [text[a:b] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _apply(with_text: bool, carry: list[str]):
    names = ["id", *carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def run(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in names})
        runs, grams, slot = _pack(pdf)
        shared = _shared(answers, grams)
        codes = _codes(answers, shared)
        first, count = runs.first.astype(np.int64), runs.count.astype(np.int64)
        doc_id = runs.ids[runs.doc]
        code = codes[slot] if len(slot) else np.zeros(0, np.uint8)
        gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # documents that are not the smallest with a run that is the same everywhere
        if len(grams):
            least, _ = _group_min_max(slot, doc_id, len(grams))
            lose = np.flatnonzero((code == DONE_ELSEWHERE) | ((code == DONE_HERE) & (doc_id > least[slot])))
            gone.append((runs.doc[lose], first[lose], first[lose] + count[lose] + K - 1))
        pieces, piece, owner, window = _open_pieces(runs, slot, codes)
        own = answers[answers["kind"] == 3].sort_values("bucket")
        masks = np.concatenate([*(np.frombuffer(d, "<u4") for d in own["data"]), np.zeros(0, np.uint32)])
        if len(masks) != len(pieces):
            raise ValueError("answers do not fit the pack")
        if len(owner):
            later = doc_id[owner] > pieces["doc"][piece]
            n = np.where(window < 0, count[owner], 1)
            every = ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
            mask = np.where(later, every, masks[piece])
            base = first[owner] + np.maximum(window, 0)
            for bit in range(K - GRAM + 1):
                hit = np.flatnonzero(mask & np.uint32(1 << bit))
                gone.append((runs.doc[owner[hit]], base[hit] + bit, base[hit] + bit + K))
        doc, begin, end = (np.concatenate([g[i] for g in gone] + [np.zeros(0, np.int64)]).astype(np.int64) for i in range(3))
        order = np.argsort(doc, kind="stable")
        doc, begin, end = doc[order], begin[order], end[order]
        bounds = np.searchsorted(doc, np.arange(len(runs.texts) + 1))
        rows: list[tuple] = []
        for i, text in enumerate(runs.texts):
            a, b = bounds[i], bounds[i + 1]
            parts, removed, spans_ = [text], 0, 0
            if b > a:
                cover = np.cumsum(np.bincount(begin[a:b], minlength=len(text) + 1) - np.bincount(end[a:b], minlength=len(text) + 1))[: len(text)] > 0
                removed = int(cover.sum())
                spans_ = int((np.diff(cover.astype(np.int8), prepend=0) == 1).sum())
                parts = _parts(text, cover)
            # a character that a cut divides goes with the part that is removed
            kept = ("".join(p.decode("utf-8", "ignore") for p in parts),) if with_text else ()
            rows.append((len(text), removed, spans_, hashlib.sha256(b"".join(parts)).hexdigest(), *kept))
        out = pd.DataFrame(rows, columns=names[1 + len(carry) :])
        for c in ("id", *carry):
            out[c] = pdf[c].to_numpy()
        return out[names]

    return run


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    with_text: bool = False,
    pack_bytes: int | None = None,
    bucket_bytes: int | None = None,
    many_runs: int = MANY_RUNS,
) -> DataFrame:
    """``(id_col, *carry, n_bytes, n_removed, n_spans, kept_sha256[, kept string])`` of every row. ``carry`` names
    string columns of ``docs`` that the result keeps; ``kept`` is the text that is left, without characters of
    which a cut has taken some bytes. The sizes change how the work is dealt out, never the result."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0
    grown = math.isqrt(100 * total)
    packs = max(1, -(-total // (pack_bytes or max(PACK_BYTES, grown))))
    # about one minimizer for each 13 bytes, of 9 bytes in a message
    buckets = max(1, -(-total * 9 // 13 // (bucket_bytes or max(BUCKET_BYTES, grown))))
    names = [f"carry_{k}" for k in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    dealt = rows.filter("id IS NOT NULL").withColumn("pid", F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int"))
    by_pack = dealt.groupBy("pid")

    def meet(messages: DataFrame, f) -> DataFrame:
        return messages.groupBy("bucket").applyInPandas(_trimmed(f), MESSAGE).repartition("pid")

    def answered(known: DataFrame, f, schema: str = MESSAGE) -> DataFrame:
        return by_pack.cogroup(known.groupBy("pid")).applyInPandas(_trimmed(f, two=True), schema)

    shared = meet(by_pack.applyInPandas(_trimmed(_send_grams(buckets)), MESSAGE), _meet_grams)
    runs = meet(answered(shared, _send_runs(buckets)), lambda pdf: _meet_runs(pdf, many_runs))
    known = shared.union(runs)
    pieces = meet(answered(known, _send_pieces(buckets)), _meet_pieces)
    schema = ", ".join(["id long", *(f"{n} string" for n in names), RESULT, *(["kept string"] if with_text else [])])
    out = answered(known.union(pieces), _apply(with_text, names), schema)

    text: Column = F.coalesce("text", F.lit(b""))
    untouched = [F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256")]
    alone = rows.filter("id IS NULL").select("id", *names, *untouched, *([F.decode(text, "utf-8").alias("kept")] if with_text else []))
    return out.union(alone).withColumnsRenamed({"id": id_col, **dict(zip(names, carry, strict=True))})
