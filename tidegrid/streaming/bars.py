"""Streaming forms of the panel operators: bars by event-time window, carried values, rolling windows and sessions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder
from ..sources.market import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files. Its times have no zone; watermarks need instants."""
    path = f"{sf_dir}/events.parquet"
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema)
    folder, name = path.rsplit("/", 1)
    stream = reader.option("pathGlobFilter", name).parquet(folder) if not _is_folder(spark, path) else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def daily_bars(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Open, high, low, close, count and volume of each event type and day. Complete days leave the state after the watermark."""
    day = F.window("ts", "1 day")
    at = F.struct("ts", "event_id")
    out = stream.withWatermark("ts", late).groupBy(day, F.col("event_type").alias("symbol"))
    bars = out.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("volume"))
    return bars.select(F.col("window.start").cast("date").alias("date"), "symbol", "open", "high", "low", "close", "n", "volume")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a user's events with no gap of that length."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("s.start").alias("first"), F.col("s.end").alias("until"), "n", "value")


def rolling_means(stream: DataFrame, key: str = "event_type", n: int = 20) -> DataFrame:
    """Mean of the last n values of each key with every event; the last n are the state. Events of one batch are in order of time."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0] if state.exists else [], float)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        # in front of the values what the first windows lack, as zeros that are not counted
        values = np.concatenate((held, rows["value"].to_numpy(float)))
        sums = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(n - 1), values)), n)[len(held) :].sum(axis=1)
        means = sums / np.minimum(np.arange(len(held) + 1, len(values) + 1), n)
        state.update((values[max(0, len(values) - n + 1) :].tolist(),))
        yield pd.DataFrame({"key": group[0], "event_id": rows["event_id"].to_numpy(), "mean": means})

    return stream.withColumn("key", F.col(key)).groupBy("key").applyInPandasWithState(step, "key string, event_id long, mean double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def carried_last(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """The last value of each key so far: the streaming form of a carried value."""
    return stream.groupBy(key).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Everything that is there now, through a streaming query into Parquet tables in the shared folder.

    In complete mode each batch gives everything so far, so the newest table is the result; otherwise all of them are.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        done.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    wanted = sorted(set(done))[-1:] if mode == "complete" else sorted(set(done))
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{folder}/{n}" for n in wanted))
