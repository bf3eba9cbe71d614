"""Streaming counterparts of the run log: they take files as they come and give the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.cache import new_path


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream; a single file is found by its name in its folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def summaries(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, sum and largest value by group."""
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))


def windowed_speed(events: DataFrame, ts: str, width: str, late: str | None = None) -> DataFrame:
    """Events by tumbling window. With ``late``, the watermark's delay, a stream in append mode gives out each window once it is over, and
    drops its state; in complete mode all windows stay, and a watermark would have no effect."""
    return (events if late is None else events.withWatermark(ts, late)).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run over all that is there now, with the result written below the shared folder: the whole result of the
    last batch (``complete``), or what all batches add (``append``)."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    batches: set[int] = set()

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes over what it wrote
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        batches.add(number)

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}-log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    read = [max(batches)] if mode == "complete" else sorted(batches)
    return spark.read.schema(stream.schema).parquet(*[f"{path}/{n}" for n in read])


def routed(stream: DataFrame, sink_column: str, path: str, checkpoint: str):
    """Write each row below a folder named by its sink; exactly once, by the file sink's log."""
    return (
        stream.writeStream.format("parquet")
        .partitionBy(sink_column)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
