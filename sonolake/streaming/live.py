"""Streaming operators: live meter, inactivity watchdog, recording.

Streams carry (stream_id, us, x).  Time is the data's own, in microseconds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def live_meter(samples: DataFrame, step: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Peak and sum of squares of each stream and step; append mode emits a step once it is past lateness."""
    t = samples.withColumn("time", F.timestamp_micros("us")).withWatermark("time", late)
    out = t.groupBy("stream_id", F.window("time", step)).agg(F.max(F.abs("x")).alias("peak"), F.sum(F.col("x") * F.col("x")).alias("sum_sq"), F.count(F.lit(1)).alias("n"))
    return out.select("stream_id", F.col("window.start").alias("start"), "peak", "sum_sq", "n")


def watchdog(samples: DataFrame, timeout_us: int) -> DataFrame:
    """A row for each silence of at least ``timeout_us`` between successive samples of a stream."""

    def work(key, pieces, state):
        last = state.get[0] if state.exists else None
        times = sorted(t for p in pieces for t in p["us"].tolist())
        found = []
        for t in times:
            if last is not None and t - last >= timeout_us:
                found.append((key[0], last, t - last))
            last = t if last is None else max(last, t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(found, columns=["stream_id", "since_us", "gap_us"])

    return samples.select("stream_id", "us").groupBy("stream_id").applyInPandasWithState(work, "stream_id long, since_us long, gap_us long", "last long", "append", GroupStateTimeout.NoTimeout)


def record(samples: DataFrame, path: str, checkpoint: str):
    """Write a stream to Parquet, each row once: the file sink's log covers restarts."""
    return samples.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out(samples: DataFrame, sinks: list, checkpoint: str):
    """Give each micro-batch to several sinks, functions of (frame, batch id) that can be repeated."""

    def work(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return samples.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
