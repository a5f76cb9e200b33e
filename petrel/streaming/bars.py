"""Daily bars from a tick stream (B1 on Structured Streaming).

Event-time tumbling windows of one day with a watermark: a bar is emitted in
append mode once the watermark passes the end of its day, and the state of
older days is dropped.  Open/close use ``min_by``/``max_by`` on the order of the
batch builder.

``store_states`` keeps bars up as ticks come, however late: each micro-batch
writes its bar states under its batch number, replacing what an earlier try of
the same batch wrote, and ``stored_bars`` merges them.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.operators.bars import STATE, bar_states, merged_bars, tick_order


def stream_daily_bars(ticks: DataFrame, code: str = "code", ts: str = "ts", price: str = "price",
                      tiebreak: str | None = None, lateness: str = "1 hour") -> DataFrame:
    # watermarks need TIMESTAMP; a zone-less column is read in the session zone (UTC)
    ticks = ticks.withColumn(ts, F.col(ts).cast("timestamp"))
    order = tick_order(ts, tiebreak)
    return (ticks.withWatermark(ts, lateness)
            .groupBy(F.col(code).alias("code"), F.window(ts, "1 day").alias("w"))
            .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"),
                 F.min(price).alias("low"), F.max_by(price, order).alias("close"),
                 F.count(F.lit(1)).alias("volume"))
            .select("code", F.to_date(F.col("w.start")).alias("dt"),
                    "open", "high", "low", "close", "volume"))


def store_states(path: str, code: str = "code", ts: str = "ts", price: str = "price",
                 tiebreak: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the bar states of each micro-batch, a folder per batch under ``path``."""
    def write(ticks: DataFrame, batch_id: int) -> None:
        states = bar_states(ticks, F.lit(batch_id).cast("long"), code, ts, price, tiebreak)
        states.select("code", "dt", *STATE).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
    return write


def stored_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars of all micro-batches written so far."""
    return merged_bars(spark.read.parquet(path))
