"""Content-keyed Parquet caches, and the level of each column of a set of samples."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.pipeline import PipelineSpec


def cache_key(*parts: str, extra: dict[str, str] | None = None) -> str:
    """Twelve hex digits of the SHA-256 of the parts, joined by ``|``; ``extra`` in key order."""
    full = [*parts, *(f"{k}={v}" for k, v in sorted((extra or {}).items()))]
    return hashlib.sha256("|".join(full).encode()).hexdigest()[:12]


def key_column(*parts: Column | str) -> Column:
    """:func:`cache_key` of each row."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256), 1, 12)


def cache_root(spark: SparkSession) -> str:
    """Below the shared folder of the session. A session on one machine may have none: then a temporary folder is
    made and remembered. On a cluster that is an error, since other machines would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/graphloom-cache"
    known = spark.conf.get("graphloom.cache.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
        path = tempfile.mkdtemp(prefix="graphloom-cache-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        known = f"file://{path}"
        spark.conf.set("graphloom.cache.dir", known)
    return known


def is_ready(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is there."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def cached(df: DataFrame, parts: list[str], *, overwrite: bool = False) -> DataFrame:
    """``df`` through a Parquet table named by its key; an existing table is kept unless ``overwrite``."""
    spark = df.sparkSession
    path = f"{cache_root(spark)}/{cache_key(*parts)}"
    if overwrite or not is_ready(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def source_id(kind: str, version: str, total: int | None = None, targets: list[str] | None = None) -> str:
    """What a source holds, whatever its path: its kind and version, and what was selected from it."""
    parts = [f"{kind}:{version}"]
    if total is not None:
        parts.append(f"total={total}")
    if targets is not None:
        parts.append("targets=" + "+".join(targets))
    return ":".join(parts)


def content_id(df: DataFrame) -> str:
    """What a table holds, whatever its path and the order of its rows: its columns, and the number and the summed hashes of
    its rows. One pass over the table."""
    h = F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("null")) for c in df.columns]) if df.columns else F.lit(0)
    row = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return "content:" + hashlib.sha256(f"{df.schema.simpleString()}|{row.n}|{row.s}|{row.x}".encode()).hexdigest()[:16]


def memory_id(name: str, n: int) -> str:
    return f"memory:{name}:{n}"


def subset_id(source: str, index: DataFrame, key: str) -> str:
    """A source's id with that of the chosen rows, whatever their order: the sum and number of their keys' hashes."""
    h = F.xxhash64(key)
    row = index.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return f"{source}:subset={hashlib.sha256(f'{row.n}|{row.s}|{row.x}'.encode()).hexdigest()[:12]}"


FORMAT_VERSION = 1


def run_cached(spec: PipelineSpec, source: DataFrame, source_key: str, *, fit_source: DataFrame | None = None, fit_key: str | None = None, overwrite: bool = False) -> DataFrame:
    """The result of a pipeline through a cache named by the pipeline (with what each task does and its options), the source
    and what its tasks were fitted on (the source itself by default); the fitted states are stored beside it, and restored when it is read again."""
    spark = source.sparkSession
    path = f"{cache_root(spark)}/{cache_key(spec.id, source_key, fit_key or source_key)}"
    if overwrite or not is_ready(spark, f"{path}/states"):
        spec.run(source, fit_source).write.mode("overwrite").parquet(f"{path}/data")
        states = [(FORMAT_VERSION, name, json.dumps(state)) for name, state in spec.states().items()]
        # written last: a cache without states is not finished
        spark.createDataFrame(states, "format int, name string, state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/states")
    rows = spark.read.parquet(f"{path}/states").collect()  # a row for each task
    if any(r.format != FORMAT_VERSION for r in rows):
        raise ValueError(f"{path} has another format")
    spec.load({r.name: json.loads(r.state) for r in rows})
    return spark.read.parquet(f"{path}/data")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{cache_root(spark)}/{name}-{uuid.uuid4().hex}"


_NOTED: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of all tables that operators write while this is open, to drop (:func:`drop_written`) once results were used."""
    paths: list[str] = []
    _NOTED.append(paths)
    try:
        yield paths
    finally:
        _NOTED[:] = [p for p in _NOTED if p is not paths]


def written(df: DataFrame, name: str, *, rows_a_file: int = 0) -> tuple[DataFrame, str]:
    """``df`` through a Parquet table of its own, so that its lineage ends there, and the table's path. Files of at most
    ``rows_a_file`` rows let a small table with much work for each row be read by many tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    for paths in _NOTED:
        paths.append(path)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`written` that nothing reads again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dataset(spark: SparkSession, path: str, in_memory: bool = False) -> DataFrame:
    """A written table: read from its files each time, or kept in memory (and on disk where that is full)."""
    out = spark.read.parquet(path)
    return out.persist(StorageLevel.MEMORY_AND_DISK) if in_memory else out


def read_one(table: DataFrame, graph_id: int) -> DataFrame:
    """The rows of one graph; IndexError if there are none."""
    out = table.filter(F.col("graph_id") == graph_id)
    if out.isEmpty():
        raise IndexError(graph_id)
    return out


def classify(samples: DataFrame, n_atoms: Column, n_edges: Column | None, columns: list[str]) -> DataFrame:
    """``(name, level)`` of array columns: ``atom`` if the length is the atom count in every sample, else
    ``edge`` if it is the edge count, else ``graph`` if all lengths are equal; otherwise an error. Null arrays
    are an error too. One pass over the samples."""
    return classify_lengths(samples, n_atoms, n_edges, {c: F.when(F.col(c).isNotNull(), F.size(c)) for c in columns})


def classify_lengths(samples: DataFrame, n_atoms: Column, n_edges: Column | None, lengths: dict[str, Column]) -> DataFrame:
    """:func:`classify` by the lengths alone, ``name -> length`` in each sample: they can be counts of long tables, so that no
    sample need be gathered in a row."""
    columns, aggs = list(lengths), []
    for c, length in lengths.items():
        n = F.coalesce(length, F.lit(-1))
        aggs += [F.bool_and(n == n_atoms).alias(f"{c}__atom"), F.bool_and(n == n_edges if n_edges is not None else F.lit(False)).alias(f"{c}__edge")]
        aggs += [(F.min(n) == F.max(n)).alias(f"{c}__graph")]
    row = samples.agg(*aggs)
    levels = [
        F.struct(
            F.lit(c).alias("name"),
            F.when(F.col(f"{c}__atom"), "atom").when(F.col(f"{c}__edge"), "edge").when(F.col(f"{c}__graph"), "graph")
            .otherwise(F.raise_error(F.lit(f"{c} has no level")).cast("string")).alias("level"),
        )
        for c in columns
    ]
    return row.select(F.inline(F.array(*levels)))
