"""Routing, downmix, panning, motion: matrices are relations, applied by a join and a grouped sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def render(samples: DataFrame, routing: DataFrame, keys: list[str], source: str, x: str) -> DataFrame:
    """out[coded] = sum of gain times source, over (source, coded, gain) rows; zero gains are simply absent."""
    return samples.join(F.broadcast(routing), source).groupBy(*keys, "coded").agg(F.sum(F.col("gain") * F.col(x)).alias("y"))


def normalise(matrix: DataFrame, keys: list[str], gain: str = "gain") -> DataFrame:
    """Divide the gains of each output by their sum where that is over one; never boost."""
    total = F.sum(gain).over(Window.partitionBy(*keys))
    return matrix.withColumn(gain, F.col(gain) / F.greatest(F.lit(1.0), total))


def vbap(u: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Constant-power gains of the speakers at a and b (degrees, b after a) for a source at u between them."""
    rad = F.radians
    det = F.cos(rad(a)) * F.sin(rad(b)) - F.sin(rad(a)) * F.cos(rad(b))
    ga = F.greatest((F.cos(rad(u)) * F.sin(rad(b)) - F.sin(rad(u)) * F.cos(rad(b))) / det, F.lit(0.0))
    gb = F.greatest((F.cos(rad(a)) * F.sin(rad(u)) - F.sin(rad(a)) * F.cos(rad(u))) / det, F.lit(0.0))
    norm = F.sqrt(ga * ga + gb * gb)
    t = (u - a) / (b - a) * F.lit(3.141592653589793 / 2)
    wide = b - a >= 180
    return F.when(wide, F.cos(t)).otherwise(ga / norm), F.when(wide, F.sin(t)).otherwise(gb / norm)


def pan(sources: DataFrame, azimuth: str, ring: DataFrame) -> DataFrame:
    """Gains of the enclosing pair of a ring of (name, azimuth) speakers for each source direction."""
    deg = F.pmod(F.col(azimuth), F.lit(360.0))
    wrapped = ring.select("name", F.pmod(F.col("azimuth"), F.lit(360.0)).alias("a"))
    w = Window.partitionBy(F.lit(1)).orderBy("a")
    first = Window.partitionBy(F.lit(1))
    pairs = wrapped.select(F.col("name").alias("first"), "a", F.coalesce(F.lead("name").over(w), F.min_by("name", "a").over(first)).alias("second"), F.coalesce(F.lead("a").over(w), F.min("a").over(first) + 360).alias("b"))
    x = sources.withColumn("u", deg).crossJoin(F.broadcast(pairs)).where("(u >= a AND u < b) OR (u + 360 >= a AND u + 360 < b)")
    x = x.withColumn("u", F.when(F.col("u") < F.col("a"), F.col("u") + 360).otherwise(F.col("u")))
    ga, gb = vbap(F.col("u"), F.col("a"), F.col("b"))
    return x.withColumn("ga", ga).withColumn("gb", gb).drop("u", "a", "b")


def asof_lerp(queries: DataFrame, frames: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """As-of join with linear interpolation between keyframes; the end values hold outside them.

    Two running windows over the union of both sides find each query's neighbours, so there is no range join: the last
    keyframe at or before it and, read backwards, the first after it.
    """
    both = frames.select(*keys, F.col(t).alias("t"), F.col(value).alias("v"), F.lit(None).cast("double").alias("q"), F.lit(0).alias("kind"), *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in queries.columns if c not in (*keys, t)])
    asked = queries.select(*keys, F.col(t).alias("t"), F.lit(None).cast("double").alias("v"), F.col(t).cast("double").alias("q"), F.lit(1).alias("kind"), *[c for c in queries.columns if c not in (*keys, t)])
    x = both.unionByName(asked)
    back = Window.partitionBy(*keys).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    frame = F.when(F.col("kind") == 0, F.struct("t", "v"))
    x = x.withColumn("p", F.last(frame, ignorenulls=True).over(back)).withColumn("n", F.last(frame, ignorenulls=True).over(ahead)).where("kind = 1")
    lerp = F.col("p.v") + (F.col("n.v") - F.col("p.v")) * (F.col("t") - F.col("p.t")) / (F.col("n.t") - F.col("p.t"))
    out = F.when(F.col("p").isNull(), F.col("n.v")).when(F.col("n").isNull(), F.col("p.v")).otherwise(lerp)
    return x.withColumn(value, out).withColumnRenamed("t", t).select(*queries.columns, value)
