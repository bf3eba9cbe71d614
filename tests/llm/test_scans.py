"""License scans, WARC, top-k, decontamination, URL filters and language ID."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import pytest

from graphloom.llm import decontaminate, lang_id, licenses, topk, url_filters, warc
from graphloom.llm.queries import OP9_SQL, URL_RULES

DOCS = [
    (1, "The MIT License (MIT)", "x"),
    (2, None, "x"),
    (3, "", "x"),
    (4, "mit", "x"),
    (5, "mit license mit-license APACHE license, general public  LICENSE general public license", "x"),
    (6, "GNU lesser general, public license; all rights very reserved", "x"),
    (7, "émit license mit licensé Mit\nLicense", "x"),
    (8, "licensed under the apache license version 2 point 0", "x"),
    (8, "licensed under the apache license version 2 point 0", "x"),
    (8, "bsd license", "x"),
    (None, "mit license", "x"),
    (9, "word " * 30000 + "mit license", "x"),
]


def test_licenses_match_sql(spark):
    unique = [d for d in DOCS if d[0] != 8]
    df = spark.createDataFrame(unique, "doc_id long, text string, labels string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    con.execute("create view d as select cast(doc_id as bigint) as doc_id, text from documents")
    want = con.execute(licenses.scan_sql().replace("FROM documents", "FROM d").replace("USING (doc_id)", "ON docs.doc_id IS NOT DISTINCT FROM found.doc_id").replace("SELECT doc_id, CAST(len(w)", "SELECT docs.doc_id, CAST(len(w)")).fetchall()
    got = [tuple(r) for r in licenses.scan_licenses(df).collect()]
    key = lambda r: str(r[0])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_licenses_by_hand(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect() if r.doc_id != 8}
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels) == (5, 0, 9, "apache,gpl,mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].base_labels, got[2].score) == (0, 0, None, "", 0.0)
    assert (got[7].n_base, got[7].first_word) == (1, 4)
    assert "lgpl" in got[6].labels.split(",")
    assert (got[9].n_words, got[9].first_word) == (30002, 30000)
    eight = sorted((r.n_words, r.labels) for r in licenses.scan_licenses(df).collect() if r.doc_id == 8)
    assert [n for n, _ in eight] == [2, 9, 9] and eight[0][1] == "bsd" and "apache" in eight[1][1] and eight[1] == eight[2]
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(df, [licenses.Template("one", "x")])


def test_license_spans_are_aligned(spark, monkeypatch):
    mit = "permission is hereby granted free of charge to any person obtaining a copy"
    twice = " ".join(f"{w} {w}" for w in mit.split())
    texts = [
        (1, mit, True),
        (2, twice, False),  # drifts over all diagonals
        (3, mit.replace("hereby", "hereby freely"), True),
        (4, mit.replace("free of charge ", ""), False),
        (5, f"{mit} {mit}", True),
        (6, " ".join(reversed(mit.split())), False),
        (7, mit.replace("granted", "x y granted"), True),
        (10, mit.replace("granted", "x y z granted"), False),  # three edits of thirteen words
        (8, "to any person obtaining a copy permission is hereby granted free of charge", False),
        (9, "x " * 50 + mit + " y" * 50, True),
    ]
    df = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    for words in (licenses.BROADCAST_WORDS, 0):  # and by a shuffle of the grams
        monkeypatch.setattr(licenses, "BROADCAST_WORDS", words)
        got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
        assert {i: "mit" in r.labels.split(",") for i, r in got.items()} == {i: found for i, _, found in texts}
        assert got[1].score == got[5].score == got[9].score == 1.0 and got[2].score < 0.5
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(con.execute(licenses.scan_sql()).fetchall()) == sorted(map(tuple, got.values()))


PAGES = [
    (1, "http://a.example/x", "<p>one</p>"),
    (2, None, "<p>one</p>"),
    (3, "http://b.example/\r\nx y é", "é" * 50_000),
    (4, "", None),
    (5, "http://c.example/", ""),
    (6, "http://d.example/", "body\r\n\r\nwith blank lines"),
    (6, "http://d.example/", "body\r\n\r\nwith blank lines"),
    (None, "http://e.example/", "alone"),
    (7, "http://f.example/", "alone"),
]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, record_type string")
    got = sorted((tuple(r) for r in warc.archive_table(spark, df).collect()), key=str)
    owner = {}
    for i, _, h in PAGES:
        if i is not None:
            owner[h or ""] = max(i, owner.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        revisit = i != owner.get(h or "")
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", owner[h or ""] if revisit else None))
    assert got == sorted(want, key=str)


def test_warc_payloads_and_layout(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    manifest = warc.write_archives(df)
    rows = warc.read_archives(manifest, with_payload=True).filter("record_type = 'response'").collect()
    bodies = {(h or "").encode() for _, _, h in PAGES}
    assert {bytes(r.payload) for r in rows} == bodies
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(PAGES)
    path = manifest.first().archive.removeprefix("file://")
    with open(path, "rb") as f:
        assert int.from_bytes(f.read(4), "little") == 0x184D2A5D
    assert warc.archive_table(spark, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(warc.read_archive(b"\x28\xb5\x2f\xfd" + b"\0" * 20))


def test_warc_many_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    rows = [(i, f"http://a.example/{i}", f"<p>{i % 40}</p>" * (1 + i % 7) if i % 11 else "z" * 9000) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    owner = {h: i for i, _, h in rows}
    for limit in (warc.BROADCAST_PAYLOADS, 0):  # and by a shuffle
        monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", limit)
        manifest = warc.write_archives(df)
        assert manifest.count() > 5
        back = warc.read_archives(manifest, with_payload=True).collect()
        assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in back) == [(i, len(h), owner[h] if owner[h] != i else None) for i, _, h in rows]
        assert all(bytes(r.payload).decode() == rows[r.page_id][2] for r in back if r.record_type == "response")
        warc.drop_archives(manifest)
    alone = warc.read_archives(warc.write_archives(df, min_revisit_bytes=1 << 20))
    assert alone.filter("record_type = 'response' AND refers_to IS NULL").count() == len(rows)


def brute_topk(rows, k):
    v = {}
    valid = [(i, [int(np.floor(256 * float(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = set()
    for q, a in valid:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in valid if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out | v.keys()


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(700)]
    rows += [(int(i), [0.25] * 8) for i in range(1000, 1100)] + [(2000, None), (2050, [float("nan")] * 8), (2100, [1.0, None]), (2150, []), (2151, [0.5]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = {tuple(r) for r in topk.exact_topk(df, df["vec_id"] % 50 == 0, 5).collect()}
    assert got == brute_topk(rows, 5)
    assert topk.exact_topk(df.limit(0), df["vec_id"] % 50 == 0, 5).count() == 0
    big = spark.createDataFrame([(50, [1e7, 1.0]), (1, [1e7, 2.0]), (2, [1e7, 3.0])], "vec_id long, embedding array<double>")
    best = topk.exact_topk(big, big["vec_id"] % 50 == 0, 1).first()
    assert (best.vec_id, best.score) == (2, (256 * 10_000_000) ** 2 + 256 * 256 * 3)


def test_topk_prunes_blocks():
    rng = np.random.default_rng(1)
    blocks = [(np.arange(b * 50, b * 50 + 50), np.zeros(50, int), np.rint(rng.normal(size=(50, 4)) + 30 * b)) for b in range(10)]
    found, scored = topk.search_shard((np.array([-1]), np.array([0]), np.ones((1, 4))), blocks, 3)
    assert scored < 10 and set(found["vec_id"]) <= set(range(450, 500))


def plain_distance(p, t):
    d = np.zeros(len(t) + 1, int)
    lane = np.arange(len(t) + 1)
    for i in range(1, len(p) + 1):
        s = np.empty(len(t) + 1, int)
        s[0] = i
        s[1:] = np.minimum(d[:-1] + (t != p[i - 1]), d[1:] + 1)
        d = np.minimum.accumulate(s - lane) + lane
    return d.min()


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    letters = "abcdefgh "
    items = [(k, "".join(rng.choices(letters, k=rng.randint(40, 160)))) for k in range(12)] + [(90, "short"), (91, None), (92, "")]
    docs = []
    for i in range(60):
        parts = ["".join(rng.choices(letters, k=rng.randint(0, 200))) for _ in range(2)]
        p = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, 20)):
            k = rng.randrange(len(p))
            p[k : k + rng.randint(0, 1)] = rng.choice(letters)
        docs.append((i, parts[0] + "".join(p).upper() + parts[1] if i % 3 else parts[0]))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, items[0][1] + " " + items[0][1]), (102, items[1][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, edits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in docs:
        text = decontaminate.code_points(decontaminate.normal(t))
        for k, s in items:
            n = decontaminate.normal(s)
            if len(n) >= 32 and len(text) and plain_distance(decontaminate.code_points(n), text) <= decontaminate.edit_budget(len(n)):
                want.add((i, k))
    got = decontaminate.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 20
    assert sum(1 for r in got if r.doc_id == 102 and r.item_id == 0) == 2
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.find_leaks(df.limit(0), bench).count() == 0


URLS = [None, "", "no scheme", "http://", "http://COM/en/x", "http://a.COM/en/", "https://example.com/en/7?x", "https://b.example.com/en/71/2#y", "http://xexample.com/en/7", "http://example.net/de/8", "http://net?/de/", "http://a.b.org#/es/", "http://a.org/es/://b.com/en/", "x://y.com/en/é", "http://com./en/"]


def test_url_filters_match_sql(spark):
    rows = [(i, u, 0) for i, u in enumerate(URLS * 2)] + [(3, URLS[6], 0), (None, URLS[7], 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, host int")
    con = duckdb.connect()
    con.register("frame", df.toPandas())
    con.execute("create view pages as select cast(page_id as bigint) as page_id, url from frame")
    rules = spark.createDataFrame(URL_RULES, url_filters.RULE_SCHEMA)
    got = sorted((tuple(r) for r in url_filters.filter_urls(df, rules).collect()), key=str)
    assert got == sorted(con.execute(OP9_SQL).fetchall(), key=str)
    none = url_filters.filter_urls(df, rules.limit(0))
    assert none.filter("rule IS NULL AND verdict = 'allow'").count() == len(rows)
    assert url_filters.filter_urls(df.limit(0), rules).count() == 0


def test_host_and_path_are_told_apart(spark):
    rules = spark.createDataFrame([("com", "x", "block"), ("org", "", "block"), ("a.net", "b", "block")], url_filters.RULE_SCHEMA)
    urls = [(1, "http://comx"), (2, "http://a.org/x"), (3, "http://com/x"), (4, "http://a.netb"), (5, "http://x.a.net/b"), (6, "http://orgx/")]
    got = {r.page_id: r.rule for r in url_filters.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert got == {1: None, 2: "org", 3: None, 4: None, 5: None, 6: None}


def test_language_id(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.train(rows.filter(~lang_id.held_out("doc_id")))
    out = lang_id.identify(rows, model).join(rows, "doc_id").filter(lang_id.held_out("doc_id"))
    right = out.filter("lang_pred = lang").count() / out.count()
    assert right >= 0.9
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !?", "q"), (4, "the" * 100_000, "q"), (4, "der und die", "q")], "doc_id long, text string, score string")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in lang_id.identify(odd, model).collect())
    assert [g[1] for g in got[:3]] == ["und"] * 3 and all(0 <= g[2] <= 1 for g in got) and all(g[1] != "und" for g in got[3:])
    assert lang_id.identify(odd.limit(0), model).count() == 0
    nothing = lang_id.train(odd.withColumnRenamed("score", "lang").filter("doc_id < 4"))
    assert {r.lang_pred for r in lang_id.identify(odd, nothing).collect()} == {"und"}


def plain_ngrams(text):
    """Buckets of a text's n-grams, one at a time."""
    out = []
    clean = lang_id.clean(text)
    for n in (1, 2, 3):
        for k in range(len(clean) - n + 1):
            acc = 0
            for j in range(n):
                acc = ((acc ^ ord(clean[k + j])) * int(lang_id._MULTIPLIERS[j]) + j) & 0xFFFFFFFF
                acc ^= acc >> 15
            out.append(((acc * 0x27D4EB2F) & 0xFFFFFFFF) >> (32 - lang_id.BUCKETS.bit_length() + 1))
    return out


def test_language_id_matches_plain_naive_bayes(spark):
    rng = random.Random(4)
    letters = {"aa": "abcdeé ", "bb": "cdefgß ", "cc": "नमस्ते हिंदी "}
    rows = [(i, "".join(rng.choices(letters[lang], k=rng.randint(1, 60))) + rng.choice(["", "1!", "\n"]), lang) for i in range(90) for lang in [rng.choice(list(letters))]]
    rows += [(90, None, "aa"), (91, "12", "bb"), (92, "unlabelled", None), (93, "x" * 3000, "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = [(plain_ngrams(t), lang) for _, t, lang in rows if t and lang and any(map(str.isalpha, t))]
    langs = sorted({lang for _, lang in taught})
    counts = {lang: np.zeros(lang_id.BUCKETS) for lang in langs}
    for grams, lang in taught:
        np.add.at(counts[lang], grams, 1)
    logs = {lang: np.log((c + lang_id.SMOOTHING) / (c + lang_id.SMOOTHING).sum()) for lang, c in counts.items()}
    prior = {lang: np.log(sum(x == lang for _, x in taught) / len(taught)) for lang in langs}
    got = {r.doc_id: r for r in lang_id.identify(df, lang_id.train(df)).collect()}
    for i, text, _ in rows:
        if not text or not any(map(str.isalpha, text)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        total = np.array([prior[lang] + logs[lang][plain_ngrams(text)].sum() for lang in langs])
        posterior = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert got[i].lang_pred == langs[int(posterior.argmax())] and got[i].score == pytest.approx(posterior.max(), rel=1e-9)


def test_equal_posteriors_go_to_the_first_language(spark):
    rows = [(1, "same text", "zz"), (2, "same text", "aa"), (3, "same text", "mm")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.lang_pred, round(r.score, 9)) for r in lang_id.identify(df, lang_id.train(df)).collect()} == {("aa", round(1 / 3, 9))}


def test_language_scores_do_not_depend_on_neighbours(spark):
    model = lang_id.LanguageModel(("a", "b"), np.random.default_rng(0).normal(size=(lang_id.BUCKETS + 1, 2)) * [[1, 1]] * np.r_[np.ones(lang_id.BUCKETS), 0][:, None], np.log([0.5, 0.5]))
    rows = ["alpha beta", "x", "gamma delta epsilon", "é"]
    alone = [model.predict([r])[1][0] for r in rows]
    assert model.predict(rows)[1] == pytest.approx(alone)
