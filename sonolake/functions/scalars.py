"""Scalar functions of levels, positions, quantisers and names, as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR_DB, SILENCE_DB = -120.0, -200.0


def to_dbfs(x: Column) -> Column:
    """20 log10 of a linear level, at least -120."""
    return F.greatest(F.coalesce(F.when(x > 0, 20 * F.log10(x)), F.lit(FLOOR_DB)), F.lit(FLOOR_DB))


def to_db(x: Column) -> Column:
    """20 log10 of a gain; -200 stands for silence."""
    return F.when(x > 1e-10, 20 * F.log10(x)).otherwise(F.lit(SILENCE_DB))


def meter_fraction(db: Column, floor: float = -60.0) -> Column:
    return F.least(F.greatest((db - floor) / -floor, F.lit(0.0)), F.lit(1.0))


def linear_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def snap_trim(db: Column) -> Column:
    return F.round(db, 1)


def smoothing(time_ms: Column, rate: Column, block: int = 256) -> Column:
    """Coefficient of a one-pole smoother at the block rate; no time is no smoothing."""
    return F.when(time_ms <= 0, 1.0).otherwise(1 - F.exp(-1000.0 * block / rate / time_ms))


def sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi))


def blackman(x: Column, half: float) -> Column:
    """Continuous window over -half..half, zero outside."""
    t = x / half * math.pi
    return F.when(F.abs(x) < half, 0.42 + 0.5 * F.cos(t) + 0.08 * F.cos(2 * t)).otherwise(0.0)


def to_fixed25(x: Column) -> Column:
    """A sample in -1..1 as 25-bit fixed point."""
    return F.least(F.greatest(F.round(x * 16777216.0), F.lit(-16777216.0)), F.lit(16777215.0)).cast("int")


def exponent_of(fixed: Column) -> Column:
    """Leading zeros of a 24-bit magnitude, 24 for zero."""
    return F.when(fixed == 0, 24).otherwise(F.least(F.lit(24), 24 - F.length(F.bin(F.abs(fixed)))))


def quantise(x: Column, scale: float, steps: int) -> Column:
    """Uniform quantiser around the middle of an even number of steps."""
    return F.least(F.greatest(F.round(x / scale) + steps // 2, F.lit(0)), F.lit(steps - 1)).cast("int")


def dequantise(code: Column, scale: float, steps: int) -> Column:
    return (code - steps // 2) * scale


def quantise_position(x: Column) -> Column:
    """A room coordinate in 0..1 as a 6-bit code over 62."""
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 62).cast("int")


def quantise_height(z: Column) -> Column:
    """Sign bit (set for not negative) over a 4-bit magnitude of 15."""
    c = F.least(F.greatest(z, F.lit(-1.0)), F.lit(1.0))
    return F.when(c < 0, 0).otherwise(16) + F.round(F.abs(c) * 15).cast("int")


def mix_level(code: Column) -> Column:
    """Linear gain of a mix-level code 0..7: +3, +1.5, 0, -1.5, -3, -4.5, -6 dB, off."""
    return F.when(code == 7, 0.0).otherwise(F.pow(F.lit(2.0), (2 - code) / 4.0))


def lfe_mix_db(code: Column) -> Column:
    return 10 - code


def dialnorm(lkfs: Column) -> Column:
    return F.least(F.greatest(F.round(-lkfs).cast("int"), F.lit(1)), F.lit(31))
