"""Secret scans: base spans against plain patterns, the field against enumeration, and what it adds."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from graphloom.llm import secret_scan as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PARTS = ["token", "secret", "Password", "api_key", "APIKEY", "passwd", "secretoken", " ", " ", "  ", "=", ":", '"', "'", ",", "\n", "abcdefgh", "abc", "ABC+/=12", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef" * 2, "deadbeef", "é", "x.y-z_w", " ", "ſecret", "toKen"]


def plain_base(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def prose(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(["the", "of", "land", "water.", "and,", "Been", "4711", "2024-01-02", "a@b.example"]) for _ in range(n)]


def corpus(n: int, seed: int = 1) -> list[str]:
    rng, out = random.Random(seed), []
    for i in range(n):
        words = prose(rng, rng.randint(20, 60))
        if i % 2:
            value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            words.insert(rng.randint(3, 15), f'{rng.choice(["token", "secret"])} = "{value}"')
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def model() -> S.Field:
    return S.fit([(i, *S._window(t, i)) for i, t in enumerate(corpus(200))])


@pytest.mark.parametrize("trained", [True, False])
def test_base_spans_stay_whatever_the_field(model, trained):
    rng, own = random.Random(2), S.Tagger(model if trained else S.Field())
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        got = [(S.KINDS[kind], a, b) for a, kind, b in own.spans(text)]
        assert [s for s in got if s[0] != S.FOUND] == plain_base(text), text
        taken = [s for s in got if s[0] != S.FOUND]
        for _, a, b in (s for s in got if s[0] == S.FOUND):
            assert b - a >= S.LEAST_CHARS and not any(a < e and s < b for _, s, e in taken)


def test_secrets_of_other_forms_are_found_and_prose_is_not(model):
    own, rng = S.Tagger(model), random.Random(5)
    found = 0
    for _ in range(50):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(28))
        text = " ".join([*prose(rng, 10), f'key = "{value}"', *prose(rng, 10)])
        found += any(text[a:b] == value and S.KINDS[k] == S.FOUND for a, k, b in own.spans(text))
        assert own.spans(" ".join(prose(rng, 80))) == []
    assert found >= 45


def test_best_path_against_enumeration(model):
    own, rng = S.Tagger(model), np.random.default_rng(3)
    for _ in range(30):
        score = rng.normal(size=(5, 3)) * 3
        value = {
            tags: own.start[tags[0]] + sum(score[t, y] for t, y in enumerate(tags)) + sum(own.moves[a][b] for a, b in itertools.pairwise(tags))
            for tags in itertools.product(range(3), repeat=5)
        }
        assert value[tuple(own._best(score))] == pytest.approx(max(value.values()))


def test_texts_passed_over_have_no_better_path(model):
    own, rng = S.Tagger(model), random.Random(9)
    for _ in range(200):
        text = " ".join(rng.choice(["ab12cd34ef56", '"', "=", "the", "key", "0a1b2c3d4e5f6a7b8c9d", ":"]) for _ in range(rng.randint(1, 25)))
        gain, own.gain = own.gain, 1e9
        want = own.spans(text)
        own.gain = gain
        assert own.spans(text) == want


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(1)
    has, n, size = np.vstack([np.zeros(4), rng.integers(0, 2, (5, 4))]).astype(float), 3, 4
    at = rng.integers(1, 6, (n, size + 4))
    roles = [at[:, 3 - o : 3 - o + size] for o in S.OFFSETS]
    tags = np.array([[0, 1, 2, 0], [1, 2, 2, 1], [0, 0, 0, 0]])
    mask = np.array([[1, 1, 1, 1], [1, 1, 1, 0], [1, 1, 0, 0]], bool)
    tags = tags * mask
    files = rng.integers(0, 2, (n, S.FILE_FEATURES)).astype(float)
    params = [rng.normal(size=(5, 4, 3)), rng.normal(size=(S.FILE_FEATURES, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)]

    def likelihood() -> float:
        out = 0.0
        for r in range(n):
            length = int(mask[r].sum())
            score = files[r] @ params[1] + sum((has @ w)[x[r]] for w, x in zip(params[0], roles, strict=True))
            moves, start = params[2] + S.ALLOWED, params[3] + S.START

            def path(y, score=score, moves=moves, start=start):
                return start[y[0]] + sum(score[t, v] for t, v in enumerate(y)) + sum(moves[a, b] for a, b in itertools.pairwise(y))

            every = np.array([path(y) for y in itertools.product(range(3), repeat=length)])
            out += path(tags[r, :length]) - every.max() - np.log(np.exp(every - every.max()).sum())
        return out

    slopes = S._slopes(params, has, roles, files, tags, mask)
    for p, g in zip(params, slopes, strict=True):
        for i in list(np.ndindex(*p.shape))[::7]:
            if p.ndim == 2 and p.shape == (3, 3) and i == (0, 2):
                continue
            p[i] += 1e-5
            up = likelihood()
            p[i] -= 2e-5
            down = likelihood()
            p[i] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(g[i], abs=1e-4)


def test_query_over_frames(spark):
    rows = [(i, t) for i, t in enumerate(corpus(120, 3))] + [(7, None), (None, ""), (1008, "token: abcdefgh"), (1008, "token: abcdefgh"), (9, "x " * 30_000 + "secret=12345678")]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, h int")
    got = [S.scan_secrets(df.repartition(k), S.train(df.repartition(k)), text_col="text") for k in (1, 5)]
    assert got[0].columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    tables = [sorted(map(tuple, g.collect()), key=str) for g in got]
    assert tables[0] == tables[1] and len(tables[0]) == len(rows)
    want = []
    for i, t in rows:
        base = plain_base(t or "")
        n = [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        want.append((i, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    assert sorted((r[:5] for r in tables[0]), key=str) == sorted(want, key=str)
    assert S.scan_secrets(df.limit(0), S.train(df.limit(0))).count() == 0
    assert {r.n_assign for r in S.scan_secrets(df.filter("doc_id = 1008"), S.train(df.filter("doc_id = 7 AND text IS NULL"))).collect()} == {1}
    assert len(S.windows(df, sample=5)) <= 10
