"""Windowed monitoring of the prediction log, as a batch and as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from cropline import schemas
from cropline.functions.scalars import exact_mean, round_even
from cropline.operators.monitor import LATENCIES, ROWS, SUCCESS, is_error, log_report, log_state, merge_states
from cropline.session import passing_tables
from cropline.sources.files import auth_rows, prediction_rows, write_log

WINDOW = "1 day"
DELAY = "1 hour"


def _utc(df: DataFrame) -> DataFrame:
    """Event time as an instant; a watermark needs one."""
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _by_window(df: DataFrame, width: str, prefix: bool) -> DataFrame:
    grouped = df.groupBy(F.window("timestamp", width).alias("w")).agg(
        F.count(F.lit(1)).alias("predictions"),
        round_even(exact_mean(F.when(F.col("status") == SUCCESS, F.col("latency_ms"))), 4).alias("avg_latency_ms"),
        F.count_if(is_error(prefix)).alias("errors"),
    )
    return grouped.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "predictions", "avg_latency_ms", "errors",
    )


def monitor_windows(log: DataFrame, width: str = WINDOW, prefix: bool = False) -> DataFrame:
    """Predictions, mean latency of the successful ones and errors per window."""
    return _by_window(_utc(log), width, prefix)


def monitor_stream(log: DataFrame, width: str = WINDOW, delay: str = DELAY, prefix: bool = False) -> DataFrame:
    """The same over a streamed log. A window is emitted once, when events are
    ``delay`` past its end; state is kept for open windows only."""
    return _by_window(_utc(log).withWatermark("timestamp", delay), width, prefix)


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType = schemas.PREDICTION_LOG) -> DataFrame:
    """New files of a log folder."""
    return spark.readStream.schema(schema).parquet(path).select(*schema.names)


def write_windows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to a folder of their own, each exactly once across restarts."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the stored states."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def keep_report(
    stream: DataFrame, path: str, checkpoint: str, latencies: int = LATENCIES, rows: int = ROWS
) -> StreamingQuery:
    """Keep the report of a streamed prediction log up to date: what the console polls.

    A micro-batch is reduced to one row, merged with the state after the batch before and
    stored under its own number, so a repeated batch replaces itself and counts once. The state
    holds a few sums and the newest rows, however long the log is; the last two are kept.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _batches(spark, path)
        states = log_state(batch, latencies, rows)
        before = [n for n in known if n < number]
        if before:
            states = states.unionByName(spark.read.schema(states.schema).parquet(f"{path}/batch={before[-1]}"))
        merge_states(states, latencies, rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")
        for old in before[:-1]:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={old}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def kept_report(spark: SparkSession, path: str) -> DataFrame:
    """The report after the last batch, in the form of ``monitoring``."""
    return log_report(spark.read.parquet(f"{path}/batch={_batches(spark, path)[-1]}"))


def append_log(stream: DataFrame, rows: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Append ``rows`` of each micro-batch to a log that batch jobs append to as well.

    A stream's batches are named after its checkpoint and number, so a repeated
    batch replaces itself, and streams do not replace each other's.
    """
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def run(batch: DataFrame, number: int) -> None:
        # A long stream must not leave tables behind with every batch.
        with passing_tables(batch.sparkSession):
            write_log(rows(batch), path, name, str(number))

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def append_prediction_stream(predictions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append streamed predictions to the prediction log."""
    return append_log(predictions, prediction_rows, path, checkpoint)


def append_auth_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append streamed access events to the access log."""
    return append_log(events, auth_rows, path, checkpoint)
