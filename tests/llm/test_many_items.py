"""Benchmarks in several shards."""

import random

from graphloom.llm import decontaminate


def test_shards_give_the_rows_of_one(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join("".join(rng.choices("abcdef", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 14)))) for k in range(60)]
    docs = []
    for i in range(40):
        p = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 2)):
            p[rng.randrange(len(p))] = "#"
        docs.append((i, "qqq " + "".join(p) + " rrr"))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.find_leaks(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 400)
    assert sorted(map(tuple, decontaminate.find_leaks(df, bench).collect())) == want and len(want) > 30
