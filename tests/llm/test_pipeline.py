"""Every stage of the pipeline, and all of them, against plain versions."""

import hashlib

import numpy as np
import public_tokenizers
from test_dedup import brute_components, brute_repeats
from test_scans import plain_distance
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import decontaminate, lang_id

SF = "/root/testdata/sf0.001"


def named(spark, docs):
    """``doc_id -> (text, lang)`` of documents with a language, by one prediction at a time."""
    model = lang_id.train(docs)
    out = {}
    for r in docs.collect():
        lang = model.predict([r.text or ""])[0][0]
        if lang != "und":
            out[r.doc_id] = (r.text, lang)
    return out


def without_near_copies(docs):
    component, _ = brute_components([(i, t) for i, (t, _) in docs.items()], words=5)
    return {i: x for i, x in docs.items() if component[i] == i}


def without_passages(docs):
    """Texts without what a smaller document holds; a character that is cut goes whole."""
    first = {}
    for i, (t, _) in sorted(docs.items()):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = {}
    for i, (t, lang) in docs.items():
        b = t.encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                cover[p : p + 50] = True
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            if not cover[at : at + n].any():
                kept.append(c)
            at += n
        if "".join(kept).strip():
            out[i] = ("".join(kept), lang)
    return out


def without_leaks(docs, items):
    codes = [decontaminate.code_points(decontaminate.normal(t)) for t in items]
    texts = {i: decontaminate.code_points(decontaminate.normal(t)) for i, (t, _) in docs.items()}
    assert min(map(len, codes)) >= decontaminate.WORD_CHARS
    leaky = {i for i, t in texts.items() if any(plain_distance(c, t) <= decontaminate.edit_budget(len(c)) for c in codes)}
    return {i: x for i, x in docs.items() if i not in leaky}


def texts_of(df):
    return {r.doc_id: (r.text, r.lang) for r in df.collect()}


def test_stages_and_run_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = named(spark, docs)
    plain = [want, want := without_near_copies(want), want := without_passages(want), want := without_leaks(want, items)]
    assert [len(p) for p in plain] == sorted((len(p) for p in plain), reverse=True) and 50 < len(plain[3]) < len(plain[1]) < len(plain[0])
    state = docs
    for (_, stage), wanted in zip(corpus_pipeline.STAGES, plain, strict=False):
        state = stage(spark, state, SF)
        state = spark.createDataFrame(state.collect(), state.schema)
        assert set(corpus_pipeline.COLUMNS) == set(state.columns)
        assert texts_of(state) == wanted
    assert all(r.n_chars == len(r.text) for r in state.collect())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert rows.keys() == plain[3].keys()
    for i, (text, _) in plain[3].items():
        ids = library.encode(text, add_special_tokens=False).ids
        r = rows[i]
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def all_stages(spark, rows):
    state = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, SF)
        state = spark.createDataFrame(state.collect(), state.schema)
    return state.collect()


def test_odd_rows(spark):
    words = "some words here"
    other = "quite another text \ufffd of its own"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "123", "en", "s", 3), (None, words, "en", "s", 5), (None, other, "en", "s", 5)]
    rows += [(4, words, "en", None, 5), (4, words, "en", None, 5), (4, other, "en", None, 5), (5, "x" * 5000, "en", "s", 5000)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.decoded_sha256) for r in all_stages(spark, rows))
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in (words, other, "x" * 5000)}
    assert got == sorted([(False, 4, digest[words]), (False, 4, digest[other]), (False, 5, digest["x" * 5000]), (True, 0, digest[words]), (True, 0, digest[other])])
    assert all_stages(spark, []) == []


def test_without_any_label(spark):
    rows = [(1, "some words", None, "s", 1), (2, "12 34", None, "s", 1), (3, None, None, "s", 1)]
    assert [r.doc_id for r in all_stages(spark, rows)] == [1]


def test_leaks_of_rows_without_an_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, f"before {item} after", "en", "s", 1), (None, "nothing to see here", "en", "s", 1), (7, item, "en", "s", 1), (7, "a clean text of the same id", "en", "s", 1)]
    kept = corpus_pipeline.drop_leaks(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted(r.text for r in kept) == ["a clean text of the same id", "nothing to see here"]
