"""Levels, gated loudness, loudness range, energy vectors and meters over (channel, order, x) rows.

Samples arrive as integers (``x``); sums of squares are exact.  ``full`` is the integer of full scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import decibels, r6


def levels(samples: DataFrame, channel: str, x: str, full: int, clip: int) -> DataFrame:
    """Peak, mean square and clipped count of each channel; a silent channel rests at -120 dB."""
    out = samples.groupBy(channel).agg(F.max(F.abs(x)).alias("peak"), F.sum(F.col(x) * F.col(x)).alias("sum_sq"), F.count(x).alias("n"), F.count_if(F.abs(x) >= clip).alias("clipped"))
    db = lambda p: r6(F.greatest(F.coalesce(decibels(p), F.lit(-120.0)), F.lit(-120.0)))
    return out.select(channel, "n", "sum_sq", "clipped", db((F.col("peak") / full) * (F.col("peak") / full)).alias("peak_db"), db(F.col("sum_sq") / F.col("n") / (float(full) * full)).alias("rms_db"))


def steps(samples: DataFrame, keys: list[str], us: str, x: str, step_us: int) -> DataFrame:
    """Sum of squares and count of each step: the one aggregation that touches samples."""
    return samples.groupBy(*keys, F.floor(F.col(us) / step_us).cast("bigint").alias("step")).agg(F.sum(F.col(x) * F.col(x)).alias("p"), F.count(F.lit(1)).alias("n"))


def blocks(step_powers: DataFrame, keys: list[str], width: int, full: int) -> DataFrame:
    """Mean power of every full window of ``width`` steps."""
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(1 - width, 0)
    out = step_powers.withColumn("k", F.count(F.lit(1)).over(w)).withColumn("power", F.sum("p").over(w) / F.sum("n").over(w) / (float(full) * full))
    return out.where(F.col("k") == width).select(*keys, "step", "power")


def gated(powers: DataFrame, keys: list[str], absolute_db: float, relative_lu: float) -> DataFrame:
    """Two gates, both strict: an absolute one, then one relative to the mean of what passes it."""
    loud = powers.where(decibels(F.col("power")) > absolute_db)
    mean = loud.groupBy(*keys).agg((10 * F.log10(F.avg("power")) + relative_lu).alias("threshold"))
    kept = loud.join(mean, keys).where(decibels(F.col("power")) > F.col("threshold"))
    return kept.groupBy(*keys).agg(r6(10 * F.log10(F.avg("power"))).alias("lkfs"), F.count(F.lit(1)).alias("n_blocks"))


def nearest_rank(values: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank, round((n - 1) p / 100) half away from zero; not interpolated."""
    w = Window.partitionBy(*keys)
    at = values.withColumn("rank", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return at.groupBy(*keys).agg(*[F.max(F.when(F.col("rank") == F.round((F.col("n") - 1) * p / 100), F.col(value))).alias(name) for name, p in percents.items()])


def loudness_range(powers: DataFrame, keys: list[str], absolute_db: float, relative_lu: float = -20.0) -> DataFrame:
    """P95 - P10 of short-term loudness past both gates, which here admit equality."""
    x = powers.withColumn("db", decibels(F.col("power"))).where(F.col("db") >= absolute_db)
    mean = x.groupBy(*keys).agg((10 * F.log10(F.avg("power")) + relative_lu).alias("threshold"))
    x = x.join(mean, keys).where(F.col("db") >= F.col("threshold"))
    return nearest_rank(x, keys, "db", {"low": 10.0, "high": 95.0}).select(*keys, r6(F.col("high") - F.col("low")).alias("lra"))


def energy_vector(channel_power: DataFrame, keys: list[str], floor_db: float = -120.0) -> DataFrame:
    """Power-weighted vector sum of (keys, azimuth_deg, power); channels at the floor do not count."""
    x = channel_power.where(F.col("azimuth_deg").isNotNull() & (decibels(F.col("power")) > floor_db))
    a = F.radians("azimuth_deg")
    v = x.groupBy(*keys).agg(F.sum(F.col("power") * F.cos(a)).alias("vx"), F.sum(F.col("power") * F.sin(a)).alias("vy"), F.sum("power").alias("total"))
    length = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    return v.select(*keys, r6(F.degrees(F.atan2("vy", "vx"))).alias("azimuth_deg"), r6(F.least(F.lit(1.0), length / F.col("total"))).alias("magnitude"), r6(10 * F.log10("total")).alias("level_db"))


def peak_decay(points: DataFrame, keys: list[str], i: str, value: str, rate: float) -> DataFrame:
    """A peak meter that falls by ``rate`` a step: the running maximum of value + rate i, less rate i."""
    w = Window.partitionBy(*keys).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("meter", F.max(F.col(value) + F.col(i) * rate).over(w) - F.col(i) * rate)


def limiter(points: DataFrame, keys: list[str], i: str, target: str, step: float) -> DataFrame:
    """Instant attack and linear release: the running minimum of target - step i, plus step i."""
    w = Window.partitionBy(*keys).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("gain", F.min(F.col(target) - F.col(i) * step).over(w) + F.col(i) * step)


def fold(points: DataFrame, keys: list[str], i: str, value: str, zero, merge, out: str) -> DataFrame:
    """A recursion over each key's values in order; a key's sequence is one array, so keys must be streams of bounded length."""
    arrays = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(i, value))).alias("s"))
    return arrays.select(*keys, F.size("s").cast("bigint").alias("n"), F.aggregate(F.col(f"s.{value}"), zero, merge).alias(out))
