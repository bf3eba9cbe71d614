"""Past the sizes up to which tables are sent to all tasks, and with many shards: the rows are the same."""

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import licenses, minhash, topk, url_filters
from graphloom.session import table
from test_scans import brute_topk

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_topk_over_shards_and_groups(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("SHARD_BLOCKS", 4), ("GROUP_QUERIES", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    data = [(int(i), [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(600)] + [(int(i), [0.5] * 6) for i in range(700, 760)] + [(900, [0.5, 0.5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.exact_topk(df, df["vec_id"] % 50 == 0, 5).collect()} == brute_topk(data, 5)


RULES = [("com", "/a/", "block"), ("b.com", "/", "allow"), ("x.b.com", "/a/1", "block"), ("COM", "/a/", "allow"), ("net", "/q", "allow"), ("n.net", "", "block")]
URLS = ["http://x.b.com/a/12", "http://b.com/a/", "http://c.com/a/z", "http://n.net/q", "http://y.n.net/z", "http://net/q?x", "nothing", None]


def test_urls_by_a_shuffle_join(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, rule_action string")
    want = rows(url_filters.filter_urls(pages, rules))
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = url_filters.filter_urls(pages, rules)
        assert rows(out) == want
        assert "SortMergeJoin" in out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    verdicts = {r[0]: (r[3], r[4]) for r in want}
    # of rules of one length, blocking wins
    assert verdicts[0] == ("x.b.com/a/1", "block") and verdicts[1] == ("com/a/", "block") and verdicts[2] == ("com/a/", "block")
    assert verdicts[3] == ("n.net", "block") and verdicts[4] == ("n.net", "block") and verdicts[5] == ("net/q", "allow") and verdicts[6] == verdicts[7] == (None, "allow")


@pytest.mark.parametrize("module,name,run", [(minhash, "BROADCAST_IDS", lambda d: minhash.near_duplicates(d, words=2, percent=80)), (licenses, "BROADCAST_WORDS", licenses.scan_licenses)])
def test_operators_without_broadcasts(spark, monkeypatch, module, name, run):
    docs = table(spark, SF, "documents")
    want = rows(run(docs))
    monkeypatch.setattr(module, name, 0)
    assert rows(run(docs)) == want


def test_leaks_without_a_broadcast(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    want = rows(corpus_pipeline.drop_leaks(spark, docs, SF))
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_LEAKS", -1)
    assert rows(corpus_pipeline.drop_leaks(spark, docs, SF)) == want
