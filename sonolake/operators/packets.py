"""Packetisation plans: fragments, transport packets, cluster timestamps, run-length timelines.

Times are recomputed from the cumulative index with integer floor and never accumulated, so they do not drift.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import BLOCK_ROWS, blocks_of, dealt


def _block(value: Column, cuts: list[float]) -> Column:
    """How many ascending cuts are below a value, by bisection; a null is behind all."""
    bits = len(cuts).bit_length()
    bounds = F.lit(cuts + [math.inf] * ((1 << bits) - 1 - len(cuts)))
    steps = F.lit([1 << k for k in reversed(range(bits))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(value > F.get(bounds, at + step - 1), at + step).otherwise(at))
    return F.when(value.isNull(), len(cuts) + 1).otherwise(found if cuts else F.lit(0))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, before: dict[str, Column] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with their place from 0 among those of their keys, totals of columns over the places before, and their block.

    Few keys may hold all rows, so no task gets all of a key: rows are cut into blocks of about ``block_rows`` by
    quantiles of the first column of the order, a number; what a block begins with is the total of the blocks before, and
    goes to it as one row ahead of its own.  Blocks are cut between values, so results do not depend on the cuts; only
    rows of one value are never divided.  Nulls come last, as in SQL.
    """
    blocks = blocks_of(rows, block_rows)
    cuts = sorted(set(rows.approxQuantile(order[0], [k / blocks for k in range(1, blocks)], 0.25 / blocks))) if blocks > 1 else []
    sums = {name: F.lit(1).cast("bigint"), **{k: F.coalesce(c.cast("bigint"), F.lit(0)) for k, c in (before or {}).items()}}
    x = rows.withColumn("block", _block(F.col(order[0]), cuts))
    first = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = x.groupBy(*keys, "block").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    total = total.select(*keys, "block", F.lit(0).alias("_own"), *[F.coalesce(F.sum(k).over(first), F.lit(0)).alias(k) for k in sums])
    x = x.withColumns({"_own": F.lit(1), **sums}).unionByName(total, allowMissingColumns=True)
    x = dealt(x, blocks, *keys, "block")
    w = Window.partitionBy(*keys, "block").orderBy("_own", *[F.asc_nulls_last(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumns({k: F.sum(k).over(w) for k in sums}).where("_own = 1").drop("_own")


def fragments(frames: DataFrame, keys: list[str], i: str, size: str, per: int, samples: int) -> DataFrame:
    """Media segments of ``per`` frames: sequence number from 1, decode time in samples, bytes."""
    f = frames.groupBy(*keys, F.expr(f"{i} div {per} + 1").alias("seq")).agg(F.count(F.lit(1)).alias("n_frames"), F.sum(size).cast("bigint").alias("mdat_bytes"))
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return f.withColumn("tfdt", F.coalesce(F.sum(F.col("n_frames") * samples).over(w), F.lit(0)).cast("bigint"))


def packets_of(size: Column, payload: int = 184) -> Column:
    """How many packets a frame of so many bytes takes; none if it is empty or null."""
    return F.greatest(F.ceil(size / payload), F.lit(0)).cast("bigint")


def transport(frames: DataFrame, i: str, size: str, sent: str, samples: int, rate: int, payload: int = 184) -> DataFrame:
    """One row for each 188-byte packet: time stamp in 90 kHz ticks, continuity counter, stuffing.

    ``sent`` is how many packets of the programme go before the frame, so packets need no order of their own.
    """
    x = frames.withColumn("pts", F.expr(f"{i} * {samples * 90000} div {rate}")).withColumn("n", packets_of(F.col(size), payload).cast("int"))
    x = x.where("n > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return x.withColumn("continuity", ((F.col(sent) + F.col("part")) % 16).cast("bigint")).withColumn("stuffing", F.when(F.col("part") == F.col("n") - 1, F.col("n") * payload - F.col(size)).otherwise(0).cast("bigint"))


def run_lengths(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Gaps and islands: (keys, first, value, repeats after the first) of each run of equal values."""
    w, v = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, value).orderBy(order)
    x = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(v))
    return x.groupBy(*keys, value, "island").agg(F.min(order).alias("first"), (F.count(F.lit(1)) - 1).alias("repeats")).drop("island")
