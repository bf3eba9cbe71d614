"""Runs of words against brute force, and that matching words is linear."""

import hashlib
import random
import zlib

import pytest

from graphloom.llm import runs


def smaller_suffixes(x: list[int]) -> list[int]:
    return [next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x)) for i in range(len(x))]


def plain_runs(x: list[int], min_length: int, min_periods: int) -> list[tuple[int, int, int]]:
    n, out = len(x), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and x[i] == x[i + p]:
                i += 1
            y = x[s : i + p]
            if len(y) >= max(2 * p, min_length, min_periods * p) and not any(y[q:] == y[:-q] for q in range(1, p)):
                out.append((s, len(y), p))
            i += i == s
    return sorted(out)


def words_of(rng: random.Random) -> list[int]:
    k, n = rng.randint(1, 3), rng.randint(0, 45)
    x = [rng.randrange(k) for _ in range(n)]
    if x and rng.random() < 0.6:
        x = (x[: rng.randint(1, 9)] * 60)[:n]
        for _ in range(rng.randint(0, 2)):
            x[rng.randrange(n)] = rng.randrange(k)
    return x


def test_arrays_and_runs_match_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        x = words_of(rng)
        following, shared, matched = runs.lyndon_array(x)
        assert following == smaller_suffixes(x) and matched <= len(x)
        for i, j in enumerate(following):
            same = next((k for k in range(len(x) - j) if x[i + k] != x[j + k]), len(x) - j)
            assert shared[i] == same
        for limits in ((2, 2), (6, 3), (9, 4)):
            assert runs.find_runs(x, *limits) == plain_runs(x, *limits)


def fibonacci(n: int) -> list[int]:
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("x", [[0] * 20_000, fibonacci(20_000), [i.bit_count() & 1 for i in range(20_000)], ([0] * 140 + [1]) * 140, sum([[0] * i + [1] for i in range(200)], []), fibonacci(89) * 200])
def test_every_word_is_matched_once(x):
    for y in (x, [-v for v in x]):
        assert runs.lyndon_array(y)[2] <= len(y)


def test_two_periods_at_least():
    with pytest.raises(ValueError):
        runs.find_runs([1, 1], 1, 1)


def plain_digest(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        a, k = (h // 10) % n, 3 + (h // 10) % 8
        p = 1 + (n - a) // k
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 24, 3)
    drop = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    nums = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *nums, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (None, "a b " * 30), (3, " \t\n"), (4, "x " * 24), (5, "x " * 23), (4, "x " * 24), (7, "a\x85b c\x1fd " * 9)]
    rows += [(i, " ".join(rng.choice(["a", "b", "é", "c\n"]) for _ in range(rng.randint(1, 90)))) for i in range(10, 130)]
    rows += [(i, ("a b c d e f g " * 20 + "z " * 40) * 3) for i in range(300, 306)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, period string")
    got = runs.run_digests(df, plant=True)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_digest(*r) for r in rows), key=str)
    assert runs.run_digests(df.limit(0)).count() == 0 and runs.word_runs(df.limit(0)).count() == 0
    listed = runs.word_runs(df.filter("doc_id = 4"))
    assert sorted(map(tuple, listed.collect())) == [(4, 0, 24, 1)] * 2
