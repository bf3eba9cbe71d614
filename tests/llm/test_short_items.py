"""Short benchmark items stand as whole words; every item has one edit budget and gives all its places."""

import random

import pytest

import corpus_pipeline
from graphloom.llm import decontaminate

ITEMS = [(1, "Forty-two"), (2, "the  red\nfox"), (3, "42"), (4, "北京大学"), (5, " "), (6, None), (7, "what is the capital of france?"), (8, "42")]
DOCS = [
    (1, "the answer is forty-two.", {1}),
    (2, "forty-twos and the red foxes, 421", set()),
    (3, "See THE RED\tFOX", {2}),
    (4, "(42)", {3, 8}),
    (5, "他在北京大学学习", {4}),
    (6, "q: What is the capital of France? a: paris", {7}),
    (7, "what is the capitol of france?", {7}),
    (8, "", set()),
    (9, None, set()),
    (10, "42 42", {3, 8}),
]


def test_short_items_are_found_whole(spark):
    df = spark.createDataFrame([d[:2] for d in DOCS], "doc_id long, text string")
    rows = decontaminate.find_leaks(df, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, k) for i, _, found in DOCS for k in found}
    assert sorted((r.first_char, r.end_char, r.edits) for r in rows if r.doc_id == 10 and r.item_id == 3) == [(0, 2, 0), (3, 5, 0)]
    assert [(r.first_char, r.end_char) for r in rows if r.doc_id == 1] == [(14, 23)]


def test_short_items_leave_the_pipeline(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in DOCS], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [i for i, _, found in DOCS if not found]


@pytest.mark.parametrize("m", [32, 40, 50, 60, 61, 70])
def test_whole_edit_budget(spark, m):
    rng = random.Random(m)
    item = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=m))
    edits = m // 10
    at = [(2 * k + 1) * m // (2 * edits) for k in range(edits)]
    close = "".join("#" if k in at else c for k, c in enumerate(item))
    far = "".join("#" if k in [*at, 0, m - 1] else c for k, c in enumerate(item))
    df = spark.createDataFrame([(1, f"zz{close}zz"), (2, f"zz{far}zz")], "doc_id long, text string")
    got = decontaminate.find_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.edits) for r in got] == [(1, edits)]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("m", [10, 15, 20, 31])
def test_short_items_with_edits_match_brute_force(spark, m):
    rng = random.Random(m)
    letters = "abcd   "

    def words(n):
        t = "x" + "".join(rng.choices(letters, k=n)) + "y"
        return decontaminate.normal(t)

    items = []
    while len(items) < 6:
        t = words(m)[:m]
        if len(t) == m and t == t.strip():
            items.append((len(items), t))
    docs = []
    for i in range(40):
        p = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, m // 10 + 1)):
            k = rng.randrange(len(p))
            p[k : k + rng.randint(0, 1)] = rng.choice(letters)
        docs.append((i, decontaminate.normal(f"{words(10)}{rng.choice([' ', ''])}{''.join(p)}{rng.choice([' ', 'z'])}{words(10)}")))
    want = set()
    for i, t in docs:
        edges = [k for k in range(len(t) + 1) if k in (0, len(t)) or not (t[k - 1].isalnum() and t[k].isalnum())]
        for k, item in items:
            e = decontaminate.edit_budget(m)
            if any(plain_distance(item, t[a:b]) <= e for a in edges for b in edges if m - e <= b - a <= m + e):
                want.add((i, k))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 10
    texts, known = dict(docs), dict(items)
    assert all(plain_distance(known[r.item_id], texts[r.doc_id][r.first_char : r.end_char]) == r.edits for r in got)


def test_every_place_of_a_periodic_item(spark, monkeypatch):
    item = ("ab cd " * 8).strip()
    text = " ".join([item] * 4)
    df = spark.createDataFrame([(1, text), (2, "b" * 1000), (3, "zz " + text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "b" * 100)], "item_id long, text string")
    for size in (decontaminate.ALIGNED, 7):
        monkeypatch.setattr(decontaminate, "ALIGNED", size)
        index = decontaminate.indexes([(1, item), (2, "b" * 100)])
        places = [sorted(x for one in index for x in one.matches(decontaminate.code_points(r.text))) for r in df.collect()]
        assert places[0] == [(1, 48 * k, 48 * k + 47, 0) for k in range(4)]
        assert places[1] == [(2, 100 * k, 100 * k + 100, 0) for k in range(10)]
        assert places[2] == [(1, 48 * k + 3, 48 * k + 50, 0) for k in range(4)]
    rows = decontaminate.find_leaks(df, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.first_char, r.end_char, r.edits) for r in rows) == [(i, *p) for i, own in enumerate(places, 1) for p in own]


def test_bound_of_shared_grams():
    for m in range(10, 400):
        q, e = decontaminate.gram_length(m), decontaminate.edit_budget(m)
        assert 1 <= q <= 8 and m - q + 1 - q * e >= (6 if m >= 32 else 1)
    assert all(decontaminate.gram_length(m) == 8 for m in range(61, 400))
