"""Exact top-k by inner product, block at a time.

Vectors are ordered by their largest component and cut into blocks of consecutive rows. A block keeps its
vectors (the forward index) and each component's largest and smallest value. For a query, the sum over the
components of the larger of ``q * max`` and ``q * min`` bounds the score of every row in a block. A task holds
a bounded shard of blocks and a bounded group of queries: each query visits the shard's blocks by falling
bound and stops when the next bound is below its k-th score (an equal bound is still visited, for ties). The
k best of each shard meet in a ranked window, k rows per shard and query.

Every shard meets every group of queries: that is the stated query set against all rows, in blocks.

Scores are integers. They are computed in double precision while that is exact, and with Python's integers
beyond. Edge cases: vectors that are null or hold null or non-finite components, and rows without an id, take
no part; shorter vectors count as padded with zeros; repeated query rows are answered once, repeated
candidate rows are candidates each; ties go to the smaller id; fewer than k candidates give fewer rows; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 128
SHARD_BLOCKS = 32
GROUP_QUERIES = 2048

EXACT = float(1 << 53)

BLOCK_SCHEMA = "part int, n int, width int, ids binary, mat binary, keys binary"
RESULT_SCHEMA = "query_id long, query_key long, vec_id long, score long"


def valid(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _pack(step: int):
    """Pack rows ``(id, key, v)`` in order, ``step`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[int, int, list[float]]] = []

        def made(rows: list) -> pa.RecordBatch:
            width = max(len(v) for _, _, v in rows)
            mat = np.zeros((len(rows), width))
            for i, (_, _, v) in enumerate(rows):
                mat[i, : len(v)] = v
            ids, keys = (np.array([r[c] for r in rows], np.int64) for c in (0, 1))
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "width": pa.array([width], pa.int32()),
                 "ids": [ids.tobytes()], "mat": [mat.tobytes()], "keys": [keys.tobytes()]}
            )

        for batch in batches:
            held += zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), batch.column("v").to_pylist(), strict=True)
            while len(held) >= step:
                yield made(held[:step])
                held = held[step:]
        if held:
            yield made(held)

    return run


def _unpack(rows: pd.DataFrame, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for r in rows.itertuples():
        mat = np.zeros((r.n, width))
        mat[:, : r.width] = np.frombuffer(r.mat).reshape(r.n, r.width)
        out.append((np.frombuffer(r.ids, np.int64), np.frombuffer(r.keys, np.int64), mat))
    return out


def search_shard(queries: tuple, blocks: list[tuple], k: int) -> tuple[pd.DataFrame, int]:
    """The k best rows of the blocks for each query, and how many (query, block) pairs were scored."""
    q_ids, q_keys, q = queries
    top_s = np.full((len(q), k), -np.inf, object if q.dtype == object else float)
    top_i = np.full((len(q), k), np.iinfo(np.int64).max)
    high, low = np.stack([b[2].max(0) for b in blocks]), np.stack([b[2].min(0) for b in blocks])
    zero = q * 0
    bound = np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T
    order = np.argsort(-bound.astype(float), axis=1, kind="stable")
    live, scored = np.arange(len(q)), 0
    for turn in range(len(blocks)):
        best = order[live, turn]
        live = live[bound[live, best] >= top_s[live, k - 1]]
        if not len(live):
            break
        best = order[live, turn]
        for b in np.unique(best):
            own = live[best == b]
            ids, _, mat = blocks[b]
            s = q[own] @ mat.T
            s = np.where(ids[None, :] == q_ids[own][:, None], -np.inf, s)
            s = np.concatenate([top_s[own], s], axis=1)
            i = np.concatenate([top_i[own], np.tile(ids, (len(own), 1))], axis=1)
            i = np.where(s == -np.inf, np.iinfo(np.int64).max, i)
            pick = np.lexsort((i, -s), axis=1)[:, :k] if s.dtype != object else np.array([sorted(range(len(r)), key=lambda c: (-r[c], t[c]))[:k] for r, t in zip(s, i, strict=True)])  # noqa: B023
            top_s[own], top_i[own] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
            scored += len(own)
    real = top_s > -np.inf
    at = np.nonzero(real)
    return pd.DataFrame({"query_id": q_ids[at[0]], "query_key": q_keys[at[0]], "vec_id": top_i[real], "score": [int(x) for x in top_s[real]]}), scored


def exact_topk(vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows with the largest integer inner product with each
    query row (where ``is_query`` holds), their own rows excepted. Components are ``floor(scale * x)``."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = (
        vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), wide.alias("raw"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
        .filter(valid(F.col("raw")))
        .select("id", "is_query", F.transform("raw", lambda x: F.floor(x * scale).cast("double")).alias("v"))
        .withColumn("key", F.xxhash64("v"))
    )
    counts = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    n_shards = max(1, -(-counts["n"] // (BLOCK_ROWS * SHARD_BLOCKS)))
    n_groups = max(1, -(-counts["q"] // GROUP_QUERIES))

    peak = F.expr("coalesce(array_position(v, array_max(v)), 0)")
    blocks = (
        rows.select("id", "key", "v", peak.alias("peak"))
        .repartitionByRange(n_shards, "peak", "id")
        .sortWithinPartitions("peak", "id")
        .select("id", "key", "v")
        .mapInArrow(_pack(BLOCK_ROWS), BLOCK_SCHEMA)
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    )
    packs = (
        rows.filter("is_query")
        .dropDuplicates(["id", "key"])
        .select("id", "key", "v")
        .repartition(n_groups, "id")
        .mapInArrow(_pack(GROUP_QUERIES), BLOCK_SCHEMA)
        .withColumn("group", F.pmod("part", F.lit(n_groups)))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    )
    # partitions can be more than were asked for, so shards are counted by remainder
    blocks = blocks.withColumn("shard", F.pmod("part", F.lit(n_shards)))

    def search(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}, dtype="int64")
        width = int(max(q["width"].max(), b["width"].max(), 1))
        queries, own = _unpack(q, width), _unpack(b, width)
        ids, keys, mat = (np.concatenate([x[c] for x in queries]) for c in range(3))
        if np.abs(mat).max(initial=0) * max(np.abs(x[2]).max(initial=0) for x in own) * width >= EXACT:
            exact = np.frompyfunc(int, 1, 1)
            mat, own = exact(mat), [(i, c, exact(m)) for i, c, m in own]
        return search_shard((ids, keys, mat), own, k)[0]

    best = packs.groupBy("shard", "group").cogroup(blocks.groupBy("shard", "group")).applyInPandas(search, RESULT_SCHEMA)
    order = W.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
