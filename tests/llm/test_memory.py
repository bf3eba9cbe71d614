"""What a task or a batch holds stays within its bound."""

import random

import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from graphloom.llm import suffix_dedup

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def session(spark):
    was = spark.conf.get(LIMIT)
    yield spark
    spark.conf.set(LIMIT, was)


def test_buckets_of_grams_are_even():
    rng = random.Random(1)
    texts = [bytes(rng.choices(range(97, 123), k=20_000)) for _ in range(10)]
    pdf = pd.DataFrame({"pid": 0, "id": range(10), "text": texts})
    out = suffix_dedup._send_grams(40)(pdf)
    assert list(out["bucket"]) == list(range(40))
    assert out["n"].max() < 2 * out["n"].mean()


def test_stages_get_small_batches(session):
    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    step = corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(seen, "n long"))
    docs = session.range(3000).selectExpr("repeat(cast(id % 10 as string), 10000) text").coalesce(1)
    sizes = [r.n for r in step(session, docs, "").collect()]
    assert sum(sizes) > 30_000_000 and max(sizes) < 2 * corpus_pipeline.BATCH_BYTES
    assert all(stage.__wrapped__ for _, stage in corpus_pipeline.STAGES)


def test_a_lower_limit_stays(session):
    session.conf.set(LIMIT, "1m")
    corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs)(session, None, "")
    assert session.conf.get(LIMIT) == "1m"
