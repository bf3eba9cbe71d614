"""Secret scans by a linear-chain conditional random field.

Texts are cut into tokens: runs of letters and digits, and each other character but white space by itself. A token is
tagged as the begin of a secret, as inside of one, or as outside. Its scores come from its own shape (length, kinds
of characters and how they alternate, distinct characters), from the shapes and words of the three tokens before it and the
one behind, and from features of the whole file; scores of neighbouring tags are added, and Viterbi's algorithm finds the
best tags of the whole text. A text in which no token can gain anything by leaving the outside (by a bound on each token's
scores) has no other best path, and is passed over.

The field is trained by maximum likelihood on windows around the known patterns (:data:`BASE`) and on windows of
texts without any. These patterns are no features: what is learned are shapes and surroundings, so that secrets of other
forms are found too. In decoding, tokens of the patterns' values are observed: they cannot be outside. What is tagged is
then checked: in the stretches around tagged tokens (matches never leave them) the patterns' exact places are taken;
tagged spans that touch none of these are reported as :data:`FOUND`.

Training takes at most :data:`SAMPLE` windows of each kind, of :data:`WINDOW` tokens, from the texts with the smallest
hashes; that is its only bound. Scans read every text whole.

Edge cases: a null or empty text has no spans; a table without a known pattern trains a field without spans of its own, and
base spans stay; rows with equal ids stay apart, null ids stay; an empty table gives an empty result; other columns are not
read. Equal tables give equal spans in any partitioning.
"""

from __future__ import annotations

import hashlib
import re
from ast import literal_eval
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import texts, trim_memory

KEYWORD = r"(?:password|passwd|secret|token|api_?key)"
VALUE = "[A-Za-z0-9+/_.=-]+"
#: Kind, pattern (its last group, or the whole match, is the value) and the value's least length, in the order in
#: which kinds of one start are listed.
BASE = [
    ("assign", re.compile(rf"""{KEYWORD}["']?\x20*[:=]\x20*["']?({VALUE})""", re.IGNORECASE | re.ASCII), 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 16),
    ("hex", re.compile("[0-9a-f]+"), 32),
]
FOUND = "crf"
KINDS = [kind for kind, _, _ in BASE] + [FOUND]

#: No match of a pattern has another character.
_STRETCH = re.compile(r"""[A-Za-z0-9+/_.=\-"' :]+""")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_KEYWORDS = re.compile(f"(?={KEYWORD})", re.IGNORECASE | re.ASCII)
_KEY_TOKEN = re.compile("password|passwd|secret|token|apikey|api$", re.IGNORECASE | re.ASCII)
_HEX_TOKEN, _ACCESS_TOKEN = re.compile("[0-9a-f]{32}"), re.compile("AKIA[A-Z0-9]{12}")
_CORE = re.compile(VALUE)
#: What a text has, if one of the patterns stands in it (for Spark's own matcher).
MAYBE = r"(?i)password|passwd|secret|token|api_?key|akia|[0-9a-f]{32}"

#: Windows of each kind that training takes, their tokens, and the words that neighbours are known by.
SAMPLE, WINDOW, WORDS = 600, 48, 200
#: Steps of training, their length, and the weight of squared weights.
STEPS, RATE, RIDGE = 120, 0.2, 1e-3
#: Spans of fewer characters are not reported; tokens that a worker remembers.
LEAST_CHARS, KNOWN_TOKENS = 8, 1 << 18

OUT, BEGIN, INSIDE = range(3)
#: Roles of a token: itself, and the neighbour at this distance before (or behind) another.
OFFSETS = (0, 1, 2, 3, -1)
NEVER = -1e4
#: Inside comes only after begin or inside.
ALLOWED = np.array([[0.0, 0.0, NEVER], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
START = np.array([0.0, 0.0, NEVER])


#: Bounds between levels of a token's length and of its distinct characters.
LENGTHS, DISTINCT = (3, 6, 10, 16, 24, 32, 48), (4, 7, 10, 13)


def _level(x: float, steps: tuple) -> int:
    return bisect_right(steps, x)


def shape(token: str) -> tuple:
    """What the field sees of a token besides its word."""
    if not token[0].isalnum():
        return ("mark", token if token.isascii() else "")
    n = len(token)
    if token.isalpha():
        lower = token.islower()
        kinds = (lower or any(map(str.islower, token)), not lower and any(map(str.isupper, token)), False, not token.isascii())
        return ("run", _level(n, LENGTHS), kinds, 0, 0, _level(len(set(token)), DISTINCT))
    digits = sum(map(str.isdigit, token))
    kinds = (any(map(str.islower, token)), any(map(str.isupper, token)), digits > 0, not token.isascii())
    numeric = [c.isdigit() for c in token]
    turns = sum(a != b for a, b in zip(numeric, numeric[1:], strict=False))
    return ("run", _level(n, LENGTHS), kinds, _level(turns, (1, 2, 4, 8)), _level(digits / n, (0.01, 0.3, 0.7, 1.0)), _level(len(set(token)), DISTINCT))


def shape_features(seen: tuple) -> list[tuple]:
    """The indicators of a shape."""
    if seen[0] == "mark":
        return [("mark",), seen]
    _, length, kinds, turns, digits, distinct = seen
    return [("run",), ("length", length), ("kinds", kinds), ("turns", turns), ("digits", digits), ("distinct", distinct), ("long mixed", length >= 4 and turns >= 2)]


FILE_STEPS = (0.0005, 0.002, 0.008)


def file_features(text: str) -> list[int]:
    """Indicators of a whole text: how often marks of code and of prose stand in it, and its length."""
    n = max(1, len(text))
    at = [_level(text.count(c) / n, FILE_STEPS) for c in ('"', "=", ":", "{", "\n", ",")]
    return [4 * i + level for i, level in enumerate(at)] + [24 + _level(n, (200, 2000, 20000))]


FILE_FEATURES = 28


def base_spans(text: str, start: int = 0, end: int | None = None) -> list[tuple[str, int, int, int]]:
    """``(kind, start, end, start of the value)`` of the known patterns in a stretch of ``text``, leftmost and
    non-overlapping for each kind."""
    out = []
    for kind, pattern, least in BASE:
        for m in pattern.finditer(text, start, len(text) if end is None else end):
            at, stop = m.span(pattern.groups)
            if stop - at >= least:
                out.append((kind, m.start(), m.end(), at))
    return out


@dataclass
class Field:
    """A trained field: weights of indicators by role and tag, of words alike, of file features, of neighbouring tags."""

    index: dict[tuple, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((len(OFFSETS), 0, 3)))
    words: dict[str, int] = field(default_factory=dict)
    files: np.ndarray = field(default_factory=lambda: np.zeros((FILE_FEATURES, 3)))
    moves: np.ndarray = field(default_factory=lambda: ALLOWED.copy())
    start: np.ndarray = field(default_factory=lambda: START.copy())

    def features(self, seen: tuple, word: str) -> list[int]:
        """Indices of what is known about a token."""
        found = [self.index.get(f) for f in shape_features(seen)]
        if word in self.words:
            found.append(self.index.get(("word", word)))
        return [f for f in found if f is not None]


class Tagger:
    """A field in use: scores of kinds of tokens, which are few however many tokens there are."""

    def __init__(self, model: Field) -> None:
        self.model = model
        self.kinds: dict[tuple, int] = {}
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = [np.zeros((len(OFFSETS), 3))]
        moves, start = model.moves, model.start
        to = np.array([*moves[:, 1:].ravel(), *start[1:]]).max() - min(moves[OUT, OUT], start[OUT])
        self.gain = to + max(0.0, (moves[1:, OUT] - moves[OUT, OUT]).max())
        self.moves, self.start = moves.tolist(), start.tolist()
        self._table()

    def _table(self) -> None:
        self.scores = np.array(self.rows)
        self.most = np.ascontiguousarray((self.scores[:, :, 1:].max(2) - self.scores[:, :, 0]).T)

    def _kind(self, token: str) -> int:
        """Kind 0 is no token; even numbers are marked: what they hold may belong to a known pattern."""
        seen, word = shape(token), token.lower()
        word = word if word in self.model.words else ""
        marked = bool(_KEY_TOKEN.search(token) or len(token) >= 16 and (_HEX_TOKEN.search(token) or _ACCESS_TOKEN.search(token)))
        key = (seen, word, marked)
        at = self.kinds.get(key)
        if at is None:
            at = self.kinds[key] = len(self.rows) + (len(self.rows) % 2 == marked)
            row = self.model.weights[:, self.model.features(seen, word)].sum(1)
            self.rows += [row] * (at + 1 - len(self.rows))
        return at

    def kinds_of(self, tokens: list[str]) -> np.ndarray:
        """Numbers of the kinds of tokens."""
        known = self.known
        new = set(tokens).difference(known)
        if new:
            if len(known) > KNOWN_TOKENS:
                known.clear()
                new = set(tokens)
            before = len(self.rows)
            for token in new:
                known[token] = self._kind(token)
            if len(self.rows) > before:
                self._table()
        return np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, kind's number, end)`` of base spans and those the field adds, by start, then kind."""
        tokens = _TOKEN.findall(text)
        if not tokens:
            return []
        kinds = self.kinds_of(tokens)
        padded = np.zeros(len(kinds) + 4, np.int32)
        padded[3:-1] = kinds
        own = self.model.files[file_features(text)].sum(0)
        bound = sum(self.most[r][padded[3 - o : len(padded) - 1 - o]] for r, o in enumerate(OFFSETS))
        marked = bool(((kinds & 1) == 0).any())
        if not marked and bound.max() + max(own[1:]) - own[0] + self.gain < 0:
            return []
        places = [m.span() for m in _TOKEN.finditer(text)]
        starts = [p[0] for p in places]
        score = own + sum(self.scores[padded[3 - o : len(padded) - 1 - o], r] for r, o in enumerate(OFFSETS))
        if marked:
            score[self._observed(text, tokens, starts), OUT] = NEVER
        elif (score[:, 1:].max(1) - score[:, 0]).max() + self.gain < 0:
            return []
        return self._checked(text, places, self._best(score))

    @staticmethod
    def _observed(text: str, tokens: list[str], starts: list[int]) -> list[int]:
        """Tokens that the values of known patterns touch."""
        ranges = []
        for m in _KEYWORDS.finditer(text):
            found = BASE[0][1].match(text, m.start())
            if found and found.end(1) - found.start(1) >= BASE[0][2]:
                ranges.append(found.span(1))
        for i, token in enumerate(tokens):
            if len(token) >= 16 and (_HEX_TOKEN.search(token) or _ACCESS_TOKEN.search(token)):
                ranges.append((starts[i], starts[i] + len(token)))
        out: set[int] = set()
        for a, b in ranges:
            out.update(range(max(0, bisect_right(starts, a) - 1), bisect_right(starts, b - 1)))
        return sorted(out)

    def _best(self, score: np.ndarray) -> list[int]:
        """The tags of the best path."""
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.moves
        rows = score.tolist()
        o, b, n = (x + y for x, y in zip(rows[0], self.start, strict=True))
        back = []
        for e_o, e_b, e_i in rows[1:]:
            to_o, to_b, to_n = OUT, OUT, BEGIN
            best_o, best_b, best_n = o + oo, o + ob, b + bi
            if b + bo > best_o:
                best_o, to_o = b + bo, BEGIN
            if n + io > best_o:
                best_o, to_o = n + io, INSIDE
            if b + bb > best_b:
                best_b, to_b = b + bb, BEGIN
            if n + ib > best_b:
                best_b, to_b = n + ib, INSIDE
            if n + ii > best_n:
                best_n, to_n = n + ii, INSIDE
            o, b, n = best_o + e_o, best_b + e_b, best_n + e_i
            back.append((to_o, to_b, to_n))
        tag = max((o, -OUT), (b, -BEGIN), (n, -INSIDE))[1] * -1
        tags = [tag]
        for step in reversed(back):
            tag = step[tag]
            tags.append(tag)
        return tags[::-1]

    @staticmethod
    def _checked(text: str, places: list[tuple[int, int]], tags: list[int]) -> list[tuple[int, int, str]]:
        """The patterns' exact places around tagged tokens, and tagged spans elsewhere."""
        tagged: list[list[int]] = []
        for (a, b), tag in zip(places, tags, strict=True):
            if tag == BEGIN:
                tagged.append([a, b])
            elif tag == INSIDE:
                tagged[-1][1] = b
        if not tagged:
            return []
        found, k = [], 0
        for m in _STRETCH.finditer(text):
            a, b = m.span()
            while k < len(tagged) and tagged[k][1] <= a:
                k += 1
            if k == len(tagged):
                break
            if tagged[k][0] < b:
                found += base_spans(text, a, b)
        out = [(a, KINDS.index(kind), b) for kind, a, b, _ in found]
        taken = sorted((a, b) for a, _, b in out)
        for a, b in tagged:
            cores = [m.span() for m in _CORE.finditer(text, a, b)]
            if cores:
                a, b = cores[0][0], cores[-1][1]
                near = bisect_right(taken, (b - 1, len(text)))
                if b - a >= LEAST_CHARS and not any(e > a for _, e in taken[max(0, near - 3 * len(BASE)) : near]):
                    out.append((a, KINDS.index(FOUND), b))
        return sorted(out)


def _window(text: str, key: int) -> tuple | None:
    """A window of a text for training: shapes, words (empty, if long), tags, file features. It lies around one of the
    known patterns, chosen by ``key``, if there is any, else anywhere."""
    places = [m.span() for m in _TOKEN.finditer(text)]
    if not places:
        return None
    starts = [p[0] for p in places]
    tags = [OUT] * len(places)
    first = []
    for _, _, end, at in sorted(base_spans(text), key=lambda s: (s[3], s[2])):
        i, j = max(0, bisect_right(starts, at) - 1), bisect_right(starts, end - 1)
        first.append(i)
        if tags[i] == OUT:
            tags[i:j] = [BEGIN] + [INSIDE] * (j - i - 1)
    room = max(0, len(places) - WINDOW)
    if first:
        a = min(room, max(0, first[key % len(first)] - key // 7 % WINDOW))
    else:
        a = key % (room + 1)
    tokens = [text[i:j] for i, j in places[a : a + WINDOW]]
    tags = tags[a : a + WINDOW]
    if tags[0] == INSIDE:
        tags[0] = BEGIN
    return bool(first), [repr(shape(t)) for t in tokens], [t.lower() if len(t) <= 24 else "" for t in tokens], tags, file_features(text)


def windows(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE) -> list[tuple]:
    """Windows of at most ``sample`` texts in which a known pattern may stand, and of as many others: of each kind those
    with the smallest hashes. Copies count once."""
    hashed = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).filter("text IS NOT NULL").withColumn("maybe", F.col("text").rlike(MAYBE))
    out: list[tuple] = []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(h, _window(text, h & 0x7FFFFFFF)) for h, text in zip(batch.column("h").to_pylist(), texts(batch), strict=True)]
            rows = [(h, *w) for h, w in made if w]
            if rows:
                kinds = [pa.int64(), pa.bool_(), *(pa.list_(k) for k in (pa.string(), pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "has", "shapes", "words", "tags", "file"])

    ddl = "h long, has boolean, shapes array<string>, words array<string>, tags array<int>, file array<int>"
    chosen = hashed.select("maybe", "h").distinct()
    smallest = chosen.filter("maybe").orderBy("h").limit(sample).union(chosen.filter("NOT maybe").orderBy("h").limit(sample)).collect()
    last = {maybe: max((r.h for r in smallest if r.maybe == maybe), default=None) for maybe in (True, False)}
    wanted = F.lit(False)
    for maybe, h in last.items():
        if h is not None:
            wanted = wanted | ((F.col("h") <= h) & (F.col("maybe") == maybe))
    most = max((h for h in last.values() if h is not None), default=0)
    for r in hashed.filter(F.col("h") <= most).filter(wanted).select("text", "h").mapInArrow(cut, ddl).dropDuplicates(["h"]).collect():
        out.append(tuple(r))
    return sorted(out)


def train(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE) -> Field:
    """Fit a field to the windows of ``docs``."""
    return fit(windows(docs, text_col=text_col, sample=sample))


def fit(rows: list[tuple]) -> Field:
    """Maximum likelihood of the windows' tags with a ridge, by gradient steps (Adam's) of falling length."""
    model = Field()
    if not any(has for _, has, *_ in rows):
        return model
    near: Counter[str] = Counter()
    for _, _, _, words, tags, _ in rows:
        for i, tag in enumerate(tags):
            if tag == BEGIN:
                near.update({w for w in words[max(0, i - 3) : i] if w[:1].isalpha()})
    model.words = {w: i for i, (w, n) in enumerate(sorted(near.items(), key=lambda x: (-x[1], x[0]))[:WORDS]) if n >= 3}
    kinds: dict[tuple[str, str], int] = {}
    n_rows, size = len(rows), max(len(r[4]) for r in rows)
    at = np.zeros((n_rows, size + 4), np.int64)  # kind 0 is no token
    tags, mask, files = np.zeros((n_rows, size), np.int64), np.zeros((n_rows, size), bool), np.zeros((n_rows, FILE_FEATURES))
    for r, (_, _, shapes, words, own, file) in enumerate(rows):
        at[r, 3 : 3 + len(own)] = [kinds.setdefault((s, w if w in model.words else ""), len(kinds) + 1) for s, w in zip(shapes, words, strict=True)]
        tags[r, : len(own)], mask[r, : len(own)] = own, True
        files[r, file] = 1
    listed = [[*shape_features(literal_eval(s)), *([("word", w)] if w else [])] for s, w in kinds]
    for f in sorted({f for own in listed for f in own}, key=repr):
        model.index[f] = len(model.index)
    has = np.zeros((len(kinds) + 1, len(model.index)))
    for k, own in enumerate(listed, 1):
        has[k, [model.index[f] for f in own]] = 1
    roles = [at[:, 3 - o : 3 - o + size] for o in OFFSETS]
    params = [np.zeros((len(OFFSETS), len(model.index), 3)), np.zeros((FILE_FEATURES, 3)), np.zeros((3, 3)), np.zeros(3)]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, STEPS + 1):
        slopes = _slopes(params, has, roles, files, tags, mask)
        rate = RATE * (1 - (step - 1) / STEPS)
        for p, g, m, v in zip(params, slopes, first, second, strict=True):
            g = g / n_rows - RIDGE * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights, model.files = params[0], params[1]
    model.moves, model.start = params[2] + ALLOWED, params[3] + START
    return model


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _slopes(params: list[np.ndarray], has: np.ndarray, roles: list[np.ndarray], files: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    """Slopes of the log-likelihood: what is observed less what the field expects, by forward and backward sums."""
    weights, file_weights, moves, start = params[0], params[1], params[2] + ALLOWED, params[3] + START
    n, size = tags.shape
    score = np.repeat((files @ file_weights)[:, None], size, 1)
    for w, r in zip(weights, roles, strict=True):
        score += (has @ w)[r]
    ahead = np.empty((size, n, 3))
    ahead[0] = score[:, 0] + start
    for t in range(1, size):
        ahead[t] = np.where(mask[:, t, None], _total(ahead[t - 1][:, :, None] + moves, 1) + score[:, t], ahead[t - 1])
    whole = _total(ahead[-1], 1)[:, None]
    behind, pairs = np.zeros((n, 3)), np.zeros((3, 3))
    left = np.zeros((n, size, 3))
    for t in range(size - 1, -1, -1):
        here = mask[:, t, None]
        left[:, t] = np.where(here, np.exp(np.minimum(ahead[t] + behind - whole, 0)), 0)
        if t:
            joint = moves + (score[:, t] + behind)[:, None, :]
            pairs += (np.exp(np.minimum(ahead[t - 1][:, :, None] + joint - whole[:, :, None], 0)) * here[:, :, None]).sum(0)
            behind = np.where(here, _total(joint, 2), behind)
    observed = np.eye(3)[tags] * mask[:, :, None]
    seen = np.zeros((3, 3))
    np.add.at(seen, (tags[:, :-1][mask[:, 1:]], tags[:, 1:][mask[:, 1:]]), 1)
    change = observed - left
    flat = change.reshape(-1, 3)
    by_role = []
    for r in roles:
        sums = np.stack([np.bincount(r.ravel(), flat[:, y], len(has)) for y in range(3)], 1)
        by_role.append(has.T @ sums)
    return [np.stack(by_role), files.T @ change.sum(1), seen - pairs, change[:, 0].sum(0)]


def scan_secrets(docs: DataFrame, model: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_assign, n_access, n_hex, base_sha256, spans)`` of every row: how many base spans of each kind there
    are, the SHA-256 of base spans, and all spans, as ``kind:start:end`` by start and kind, comma-joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def row(spans: list[tuple[int, int, int]]) -> tuple:
        n = Counter(kind for _, kind, _ in spans)
        shown = [(kind, f"{KINDS[kind]}:{a}:{b}") for a, kind, b in spans]
        base = ",".join(s for kind, s in shown if KINDS[kind] != FOUND)
        return n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in shown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(shared.value)
        for batch in batches:
            made = [row(own.spans(text)) for text in texts(batch)]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            columns = list(zip(*made, strict=True)) or [()] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        trim_memory()

    ddl = f"id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return narrow.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
