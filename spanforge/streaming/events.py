"""Structured Streaming over a folder of event files, and running a stream over what is there now."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 64) -> DataFrame:
    """The event files as a stream with time as a timestamp; new files are taken as they come.

    The path is a pattern, since a stream takes a single file only by one.
    """
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def shared_path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spanforge-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def run_now(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over the files that are there, with checkpoints; returns its result as a batch.

    append goes to a Parquet sink, which commits each batch once: windows come when the watermark has passed them, and
    late rows are refused. complete keeps the last batch's result, and all state.
    """
    spark = stream.sparkSession
    root = shared_path(spark, name)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/state")
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(f"{root}/out")
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def update_now(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an aggregation over the files that are there in update mode; the latest result of each key.

    Each batch adds the results that it changed, with its number; a batch that is repeated writes its folder again.
    """
    spark, root = stream.sparkSession, shared_path(stream.sparkSession, name)
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/state").outputMode("update").foreachBatch(write).start().awaitTermination()
    found = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{root}/out")
    return found.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("last")).select(*keys, "last.*")


def tee(stream: DataFrame, name: str, *sinks: Callable[[DataFrame, int], None]) -> None:
    """Hand each batch of a stream, computed once, to several sinks with its number; a sink must bear a repeated batch."""
    root = shared_path(stream.sparkSession, name)

    def write(df: DataFrame, n: int) -> None:
        df.persist()
        try:
            for sink in sinks:
                sink(df, n)
        finally:
            df.unpersist()

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(write).start().awaitTermination()


def rows(df: DataFrame) -> Iterator[Row]:
    """The rows of a query one by one; the driver holds two partitions at most."""
    return df.toLocalIterator(prefetchPartitions=True)


def running_totals(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """user_id, n, total after each batch, by state kept for each user; state goes a day after the last event.

    The state is two numbers for a user, however many events there are.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    grouped = stream.withWatermark("ts", delay).select("user_id", "ts", "value").groupBy("user_id")
    return grouped.applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", "EventTimeTimeout")


def filtered(stream: DataFrame, least: float) -> DataFrame:
    return stream.where(F.col("value") >= least).select("event_id", "user_id", "event_type", "value")


def tumbling(stream: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    rows = stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str = "1 day", slide: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    rows = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """The first event of each user and type within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")
