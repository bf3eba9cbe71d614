"""Near-duplicates and repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import components, minhash, suffix_dedup


def shingles(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else frozenset([tuple(w)])


def brute_components(rows, words=2, percent=80):
    sets = {i: shingles(t, words) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def near_copies(n, seed, words=60, edits=8):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    rows = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    return rows


def test_near_duplicates_match_brute_force(spark):
    texts = near_copies(60, 1) + near_copies(40, 2) + [" ".join(random.Random(k).choices([f"v{j}" for j in range(900)], k=30)) for k in range(40)]
    texts += ["", None, " \t", "One", "one", "a b", "A  b\n", "a b c", texts[3], texts[3].upper()]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, component_id int")
    want, sizes = brute_components(rows)
    got = minhash.near_duplicates(df, words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_long_lists_are_searched_in_packs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PACK", 16)
    rows = list(enumerate(near_copies(90, 9, words=80, edits=14)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, words=2).collect()}
    assert got == brute_components(rows)[0]


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_different_texts_are_never_one_class(spark):
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, other.upper()), (4, f"{word} {other}"), (5, f"{other} {word}")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}


def test_links_are_confirmed_on_the_words(spark, monkeypatch):
    # hash functions that see nothing: every pair looks alike, and only the texts tell
    monkeypatch.setattr(minhash, "signature", lambda s: np.zeros(minhash.M, np.uint64))
    rows = list(enumerate(near_copies(12, 5) + near_copies(12, 6) + ["a b c", "d e f", "a b c d"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, words=2).collect()}
    assert got == brute_components(rows)[0]


def test_rows_of_one_id_and_different_texts(spark):
    a, b = near_copies(2, 11, edits=0)[0], near_copies(1, 12)[0]
    rows = [(1, a), (2, b), (5, a), (5, b), (5, b), (7, "x y z"), (7, "u v w")]
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect())
    assert got == [(1, 1), (2, 2), (5, 1), (5, 2), (5, 2), (7, 7), (7, 7)]


def test_long_texts_are_read_in_steps(monkeypatch):
    text = "one two  three\tfour five six seven " * 40 + thue_morse(300)
    whole = [minhash.shingle_hashes(text, k) for k in (1, 2, 5)]
    monkeypatch.setattr(minhash, "STEP", 11)
    for k, want in zip((1, 2, 5), whole, strict=True):
        assert (minhash.shingle_hashes(text, k) == want).all() and len(want) == len(shingles(text, k))
    assert len(minhash.shingle_hashes("a b", 5)) == 1 and len(minhash.shingle_hashes(" ", 5)) == 0


def test_near_duplicates_of_nothing_and_of_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(df, words=2).filter("doc_id IS NOT NULL").collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True)]
    assert minhash.near_duplicates(df, words=2).filter("doc_id IS NULL").first().kept
    assert minhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 9])
def test_components_of_chains_and_stars(spark, n):
    edges = [(k, k + 1) for k in range(n)] + [(100, 100 + k) for k in range(1, n + 1)] + [(7000, 7000)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, **{100 + k: 100 for k in range(n + 1)}}


def brute_repeats(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        if i is not None:
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < i:
                    cover[p] += 1
                    cover[p + 50] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeated_texts(seed):
    rng = random.Random(seed)
    letters = "abcdeé \n"
    passages = ["".join(rng.choices(letters, k=rng.randint(40, 160))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = ["".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts.insert(rng.randint(0, len(parts)), rng.choice([p, p[a:b]]))
        rows.append((rng.randint(-50, 50), "".join(parts)))
    periodic = "xyz" * 60
    return rows + [(60, periodic), (61, periodic + "q" + periodic), (62, "\0" * 120), (63, "a\0" + "\0" * 119), (64, ""), (65, None), (None, periodic), (61, periodic)]


@pytest.mark.parametrize("sizes", [{}, {"pack_bytes": 900, "bucket_bytes": 2000, "many_runs": 2}, {"pack_bytes": 2000, "many_runs": 0}])
def test_repeats_match_brute_force(spark, sizes):
    rows = repeated_texts(4)
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n_bytes int, kept string")
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, **sizes).collect()), key=str)
    assert got == brute_repeats(rows)


def test_pieces_do_not_depend_on_the_order_of_documents():
    rng = random.Random(9)
    rows = [(i, t.encode()) for i, t in repeated_texts(6) if i is not None and t]
    found = []
    for _ in range(3):
        rng.shuffle(rows)
        runs = suffix_dedup.Runs([t for _, t in rows], np.array([i for i, _ in rows]))
        grams, slot = np.unique(runs.gram, return_inverse=True)
        codes = np.where(grams % np.uint64(3) == 0, suffix_dedup.OPEN_MANY, suffix_dedup.OPEN).astype(np.uint8)
        found.append(suffix_dedup._open_pieces(runs, slot, codes)[0].tobytes())
    assert found[0] == found[1] == found[2]


def test_repeats_carry_columns_and_whole_characters(spark):
    shared = "0123456789" * 5
    rows = [(1, "é" + shared + "ü", "a"), (2, "x" + "é" + shared + "ü" + "\ufffdz", None), (None, shared, "c"), (3, "中" * 20, "d"), (4, "文" + "中" * 17 + "丐", "e"), (5, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r.doc_id: (r.source, r.n_removed, r.kept) for r in suffix_dedup.remove_repeats(df.withColumnRenamed("kept", "source"), carry=("source",), with_text=True).collect()}
    assert got[2] == (None, 54, "x\ufffdz")
    assert got[None] == ("c", 0, shared) and got[5] == ("f", 0, "") and got[1] == ("a", 0, rows[0][1])
    # the last character's first two bytes are those of the one in document 3
    assert got[4] == ("e", 53, "文")
    flat = suffix_dedup.remove_repeats(df.withColumnRenamed("kept", "source")).collect()
    assert {r.doc_id: r.n_removed for r in flat} == {i: x[1] for i, x in got.items()}


def test_colliding_hashes_are_decided_by_the_bytes(monkeypatch):
    rng = random.Random(3)
    data = np.frombuffer("".join(rng.choices("ab", k=300)).encode() * 3, np.uint8)
    start = np.arange(0, 840, 2)
    group, doc = start % 3, np.array([rng.randrange(9) for _ in start])
    want = []
    for s, g, d in zip(start, group, doc, strict=True):
        want.append(any(h == g and e < d and bytes(data[t : t + 50]) == bytes(data[s : s + 50]) for t, h, e in zip(start, group, doc, strict=True)))
    assert suffix_dedup._repeated(data, start, group, doc).tolist() == want and any(want)
    for wrong in (lambda p, a, b: np.zeros(len(a), np.uint64), lambda p, a, b: p[a] & np.uint64(1)):
        monkeypatch.setattr(suffix_dedup, "spans", wrong)
        assert suffix_dedup._repeated(data, start, group, doc).tolist() == want


def test_repeats_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(df).count() == 0


def test_suffix_sort_orders_by_content():
    rng = random.Random(1)
    data = np.frombuffer("".join(rng.choices("ab", k=2000)).encode(), np.uint8)
    start = np.arange(0, 1900, 3)
    prefix = suffix_dedup.prefix_hashes(data)
    order = suffix_dedup.sort_suffixes(data, prefix, start, np.zeros(len(start), int))
    content = [bytes(data[s : s + 50]) for s in start[order]]
    assert content == sorted(content)
    common = suffix_dedup.common_extension(prefix, start[:-1], start[1:])
    want = [next((k for k in range(50) if data[a + k] != data[b + k]), 50) for a, b in zip(start[:-1], start[1:], strict=True)]
    assert common.tolist() == want
