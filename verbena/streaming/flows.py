"""Streams: taking in candidates as they come, once each, and counting outcomes over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, place: str, schema, most_files: int = 100) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(place)


def once_each(stream: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key; state older than the watermark is forgotten, so it stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, time: str, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(stream: DataFrame, time: str, width: str, step: str, *keys: str, late: str = "1 hour") -> DataFrame:
    w = stream.withWatermark(time, late).groupBy(F.window(time, width, step), *keys)
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def visits(stream: DataFrame, time: str, gap: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Runs of events of a key with no gap as long as that."""
    w = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys)
    return w.agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def ingest_stream(stream: DataFrame, take_in: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch through take_in(batch, batch_id), which must give the same result when a batch comes again."""
    return stream.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, place: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over what is there now; its result as a table under place.

    Each micro-batch is a folder of its own, written anew if the batch comes again. Of a stream in complete mode the last batch is the
    result, in update mode the last row of each of keys, in append mode everything.
    """
    spark, fields = stream.sparkSession, stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/result/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*fields.fields, T.StructField("batch", T.LongType())])).parquet(f"{place}/result")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == F.lit(last))
    elif mode == "update":
        rest = [c for c in fields.names if c not in keys]
        rows = rows.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in rest))
    return rows.select(*fields.names)
