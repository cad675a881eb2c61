"""Measurements of PCM programmes: one numpy kernel for each stream, relational gates over what it returns.

A stream's filter state makes it sequential; streams are parallel.  A kernel returns 100 ms step powers, so
what is shuffled after it is ten rows a second and channel instead of the samples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

STEPS = "file_id string, channel int, step long, p double, n long, true_peak_db double"


def step_powers(pcm: DataFrame) -> DataFrame:
    """K-weighted power of each whole 100 ms step of each channel, with the channel's true peak."""

    def work(table: pa.Table) -> pa.Table:
        t = table.sort_by([("block", "ascending")])
        x = np.concatenate([np.array(s, np.float64) for s in t.column("samples").to_pylist()])
        rate = t.column("sample_rate")[0].as_py()
        p = kernels.step_powers(x, rate)
        m = len(p)
        cols = [[t.column("file_id")[0].as_py()] * m, [t.column("channel")[0].as_py()] * m, range(m), p, [rate // 10] * m, [kernels.true_peak_db(x)] * m]
        types = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, types)], names=[f.split()[0] for f in STEPS.split(", ")])

    return pcm.where(F.col("error").isNull()).select("file_id", "sample_rate", "channel", "block", "samples").groupBy("file_id", "channel").applyInArrow(work, STEPS)


def loudness(pcm: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """(file_id, lkfs, true_peak_db): gated loudness over weighted channels; no row passes, no loudness (null)."""
    from pyspark.sql import Window

    steps = step_powers(pcm)
    weight = F.lit(1.0)
    for c, w in (weights or {}).items():
        weight = F.when(F.col("channel") == c, F.lit(w)).otherwise(weight)
    peaks = steps.groupBy("file_id").agg(F.max("true_peak_db").alias("true_peak_db"))
    power = steps.groupBy("file_id", "step").agg(F.sum(F.col("p") * weight).alias("p"), F.max("n").alias("n"))
    w = Window.partitionBy("file_id").orderBy("step").rowsBetween(-3, 0)
    z = power.withColumn("k", F.count(F.lit(1)).over(w)).withColumn("z", F.sum("p").over(w) / F.sum("n").over(w)).where("k = 4")
    db = lambda c: kernels.OFFSET_DB + 10 * F.log10(c)
    loud = z.where((F.col("z") > 0) & (db(F.col("z")) > -70))
    t = loud.groupBy("file_id").agg((db(F.avg("z")) - 10).alias("t"))
    kept = loud.join(t, "file_id").where(db(F.col("z")) > F.col("t")).groupBy("file_id").agg(db(F.avg("z")).alias("lkfs"))
    return peaks.join(kept, "file_id", "left").select("file_id", "lkfs", "true_peak_db")


def spectra(pcm: DataFrame, n: int = 256) -> DataFrame:
    """(file_id, channel, block, coefficients) of windowed lapped transforms of 2n samples, hop n."""
    schema = "file_id string, channel int, block long, coefficients array<double>"

    def work(table: pa.Table) -> pa.Table:
        t = table.sort_by([("block", "ascending")])
        x = np.concatenate([np.zeros(n), *[np.array(s, np.float64) for s in t.column("samples").to_pylist()], np.zeros(2 * n)])
        m = len(x) // n - 1
        rise = kernels.kbd_window(n)
        frames = np.lib.stride_tricks.sliding_window_view(x, 2 * n)[: m * n : n] * np.concatenate([rise, rise[::-1]])
        y = kernels.mdct(frames)
        cols = [[t.column("file_id")[0].as_py()] * len(y), [t.column("channel")[0].as_py()] * len(y), range(len(y)), list(y)]
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64())])], names=["file_id", "channel", "block", "coefficients"])

    return pcm.where(F.col("error").isNull()).select("file_id", "channel", "block", "samples").groupBy("file_id", "channel").applyInArrow(work, schema)


def synthesise(spectra_: DataFrame, n: int = 256) -> DataFrame:
    """(file_id, channel, samples): windowed overlap-add of the inverse transform; inverse of ``spectra``."""

    def work(table: pa.Table) -> pa.Table:
        t = table.sort_by([("block", "ascending")])
        rise = kernels.kbd_window(n)
        y = kernels.imdct(np.array(t.column("coefficients").to_pylist())) * (2 / n) * np.concatenate([rise, rise[::-1]])
        out = (y[1:, :n] + y[:-1, n:]).ravel()
        return pa.table([pa.array([t.column("file_id")[0].as_py()]), pa.array([t.column("channel")[0].as_py()], pa.int32()), pa.array([out.tolist()], pa.list_(pa.float64()))], names=["file_id", "channel", "samples"])

    return spectra_.groupBy("file_id", "channel").applyInArrow(work, "file_id string, channel int, samples array<double>")
