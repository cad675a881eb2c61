"""Queries over levels, loudness and dynamics.  The table ``events`` stands in for samples: its type is the
channel, its value in cents the sample, an hour the step."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dims, drc, metering
from ..operators.base import decibels, dim, epoch_us, r6
from .registry import add

FULL, CLIP, HOUR = 65536, 40000, 3_600_000_000
TYPES = ["click", "error", "purchase", "signup", "view"]
CHANNELS = [(t, c, a, w) for t, (c, a, w) in zip(TYPES, dims.CHANNELS)]

S = "s AS (SELECT event_id, user_id, event_type AS channel, CAST(round(value * 100) AS BIGINT) AS x, epoch_us(ts) AS us FROM events)"
DIM = f"dim AS {dims.values(CHANNELS, 'channel, name, azimuth, weight')}"
STEPS = f"{S}, steps AS (SELECT channel, CAST(floor(us / {HOUR}) AS BIGINT) AS step, CAST(SUM(x * x) AS BIGINT) AS p, COUNT(*) AS n FROM s GROUP BY ALL)"


def _blocks(width: int, name: str = "b", src: str = "steps", keys: str = "channel") -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY step ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return f"{name} AS (SELECT {keys}, step, power FROM (SELECT *, COUNT(*) {w} AS k, SUM(p) {w} / SUM(n) {w} / ({FULL}.0 * {FULL}.0) AS power FROM {src}) WHERE k = {width})"


def _gated(keys: str = "channel", absolute: int = -14) -> str:
    return f"""loud AS (SELECT * FROM b WHERE 10 * log10(power) > {absolute}),
t AS (SELECT {keys}, 10 * log10(AVG(power)) - 1 AS threshold FROM loud GROUP BY {keys}),
g AS (SELECT {keys}, round(10 * log10(AVG(power)), 6) AS lkfs, COUNT(*) AS n_blocks FROM loud JOIN t USING ({keys}) WHERE 10 * log10(power) > threshold GROUP BY {keys})"""


def samples(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    return ev.select("event_id", "user_id", F.col("event_type").alias("channel"), F.round(F.col("value") * 100).cast("bigint").alias("x"), epoch_us("ts").alias("us"))


def step_powers(spark, sf, keys=("channel",)):
    return metering.steps(samples(spark, sf), list(keys), "us", "x", HOUR)


def channel_dim(spark):
    return dim(spark, CHANNELS, "channel string, name string, azimuth double, weight double")


add("levels_by_channel", lambda spark, sf: metering.levels(samples(spark, sf), "channel", "x", FULL, CLIP), f"""
WITH {S}, a AS (SELECT channel, COUNT(x) AS n, CAST(SUM(x * x) AS BIGINT) AS sum_sq, COUNT(*) FILTER (WHERE abs(x) >= {CLIP}) AS clipped, MAX(abs(x)) AS peak FROM s GROUP BY channel)
SELECT channel, n, sum_sq, clipped, round(GREATEST(-120.0, COALESCE(CASE WHEN peak > 0 THEN 20 * log10(peak / {FULL}) END, -120.0)), 6) AS peak_db,
 round(GREATEST(-120.0, COALESCE(CASE WHEN sum_sq > 0 THEN 10 * log10(sum_sq / n / ({FULL}.0 * {FULL}.0)) END, -120.0)), 6) AS rms_db FROM a""")

add("clip_count", lambda spark, sf: samples(spark, sf).groupBy("user_id", "channel").agg(F.count_if(F.abs("x") >= CLIP).alias("clipped"), F.max(F.abs("x")).alias("peak")),
    f"WITH {S} SELECT user_id, channel, COUNT(*) FILTER (WHERE abs(x) >= {CLIP}) AS clipped, MAX(abs(x)) AS peak FROM s GROUP BY ALL")


def energy_vector(spark, sf):
    p = samples(spark, sf).groupBy("user_id", "channel").agg((F.sum(F.col("x") * F.col("x")) / F.count(F.lit(1)) / (float(FULL) * FULL)).alias("power"))
    return metering.energy_vector(p.join(channel_dim(spark), "channel").withColumnRenamed("azimuth", "azimuth_deg"), ["user_id"])


add("energy_vector", energy_vector, f"""
WITH {S}, {DIM}, p AS (SELECT user_id, channel, CAST(SUM(x * x) AS BIGINT) / COUNT(*) / ({FULL}.0 * {FULL}.0) AS power FROM s GROUP BY ALL),
v AS (SELECT user_id, SUM(power * cos(radians(azimuth))) AS vx, SUM(power * sin(radians(azimuth))) AS vy, SUM(power) AS total FROM p JOIN dim USING (channel) WHERE power > 0 AND 10 * log10(power) > -120 GROUP BY user_id)
SELECT user_id, round(degrees(atan2(vy, vx)), 6) AS azimuth_deg, round(LEAST(1.0, sqrt(vx * vx + vy * vy) / total), 6) AS magnitude, round(10 * log10(total), 6) AS level_db FROM v""")


def _last(width):
    return lambda spark, sf: metering.blocks(step_powers(spark, sf), ["channel"], width, FULL).groupBy("channel").agg(F.max("step").alias("step"), r6(10 * F.log10(F.max_by("power", "step"))).alias("lkfs"))


add("momentary_power", _last(4), f"WITH {STEPS}, {_blocks(4)} SELECT channel, MAX(step) AS step, round(10 * log10(max_by(power, step)), 6) AS lkfs FROM b GROUP BY channel")
add("short_term_power", _last(30), f"WITH {STEPS}, {_blocks(30)} SELECT channel, MAX(step) AS step, round(10 * log10(max_by(power, step)), 6) AS lkfs FROM b GROUP BY channel")


def gated_loudness(spark, sf):
    return metering.gated(metering.blocks(step_powers(spark, sf), ["channel"], 4, FULL), ["channel"], -14.0, -1.0)


add("gated_loudness", gated_loudness, f"WITH {STEPS}, {_blocks(4)}, {_gated()} SELECT channel, lkfs, n_blocks FROM g")

add("loudness_range", lambda spark, sf: metering.loudness_range(metering.blocks(step_powers(spark, sf), ["channel"], 30, FULL), ["channel"], -70.0), f"""
WITH {STEPS}, {_blocks(30)}, a AS (SELECT channel, power, 10 * log10(power) AS db FROM b WHERE 10 * log10(power) >= -70),
t AS (SELECT channel, 10 * log10(AVG(power)) - 20 AS threshold FROM a GROUP BY channel),
r AS (SELECT channel, db, row_number() OVER (PARTITION BY channel ORDER BY db) - 1 AS rank, COUNT(*) OVER (PARTITION BY channel) AS n FROM a JOIN t USING (channel) WHERE db >= threshold)
SELECT channel, round(MAX(CASE WHEN rank = round((n - 1) * 95 / 100) THEN db END) - MAX(CASE WHEN rank = round((n - 1) * 10 / 100) THEN db END), 6) AS lra FROM r GROUP BY channel""")


def qc_gate(spark, sf):
    """Measured loudness against every preset; an unmeasured value never passes."""
    peak = samples(spark, sf).groupBy("channel").agg(r6(20 * F.log10(F.max(F.abs("x")) / FULL)).alias("peak_db"))
    presets = dim(spark, dims.QC_PRESETS, "preset string, target double, tolerance double, ceiling double")
    x = peak.join(gated_loudness(spark, sf), "channel", "left").crossJoin(presets)
    delta = F.col("lkfs") - F.col("target")
    return x.select("channel", "preset", r6(delta).alias("delta_lu"), F.coalesce(F.abs(delta) <= F.col("tolerance"), F.lit(False)).alias("loudness_pass"), r6(F.col("ceiling") - F.col("peak_db")).alias("peak_margin"), F.coalesce(F.col("peak_db") <= F.col("ceiling"), F.lit(False)).alias("peak_pass"))


add("qc_gate_all_presets", qc_gate, f"""
WITH {STEPS}, {_blocks(4)}, {_gated()}, pk AS (SELECT channel, round(20 * log10(MAX(abs(x)) / {FULL}), 6) AS peak_db FROM s GROUP BY channel), q AS {dims.values(dims.QC_PRESETS, 'preset, target, tolerance, ceiling')}
SELECT channel, preset, round(lkfs - target, 6) AS delta_lu, COALESCE(abs(lkfs - target) <= tolerance, false) AS loudness_pass, round(ceiling - peak_db, 6) AS peak_margin, COALESCE(peak_db <= ceiling, false) AS peak_pass
FROM pk LEFT JOIN g USING (channel) CROSS JOIN q""")

add("dialnorm_from_loudness", lambda spark, sf: gated_loudness(spark, sf).select("channel", "lkfs", F.least(F.greatest(F.round(-F.col("lkfs")).cast("int"), F.lit(1)), F.lit(31)).alias("dialnorm")),
    f"WITH {STEPS}, {_blocks(4)}, {_gated()} SELECT channel, lkfs, CAST(LEAST(GREATEST(round(-lkfs), 1), 31) AS INT) AS dialnorm FROM g")


def dual_programme(spark, sf):
    """Two programmes of five channels: channels are weighted and summed before the gates."""
    s = samples(spark, sf).withColumn("programme", (F.col("user_id") % 2).cast("bigint"))
    p = metering.steps(s, ["programme", "channel"], "us", "x", 6 * HOUR).join(channel_dim(spark), "channel")
    p = p.groupBy("programme", "step").agg(F.sum(F.round(F.col("p") * F.col("weight")).cast("bigint")).alias("p"), F.sum("n").alias("n"))
    return metering.gated(metering.blocks(p, ["programme"], 4, FULL), ["programme"], -70.0, -1.0)


add("dual_programme_loudness", dual_programme, f"""
WITH {S}, {DIM}, c AS (SELECT CAST(user_id % 2 AS BIGINT) AS programme, channel, CAST(floor(us / {6 * HOUR}) AS BIGINT) AS step, CAST(SUM(x * x) AS BIGINT) AS p, COUNT(*) AS n FROM s GROUP BY ALL),
steps AS (SELECT programme, step, CAST(SUM(CAST(round(p * weight) AS BIGINT)) AS BIGINT) AS p, CAST(SUM(n) AS BIGINT) AS n FROM c JOIN dim USING (channel) GROUP BY ALL), {_blocks(4, keys='programme')}, {_gated("programme", -70)}
SELECT programme, lkfs, n_blocks FROM g""")


def _numbered(spark, sf):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return samples(spark, sf).withColumn("i", (F.row_number().over(w) - 1).cast("bigint")).withColumn("db", r6(20 * F.log10(F.greatest(F.abs("x"), F.lit(1)) / FULL)))


I = f"{S}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i, round(20 * log10(GREATEST(abs(x), 1) / {FULL}), 6) AS db FROM s)"
FRAME = "OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
add("peak_decay_meter", lambda spark, sf: metering.peak_decay(_numbered(spark, sf), ["user_id"], "i", "db", 0.5).select("event_id", "user_id", r6(F.col("meter")).alias("meter_db")),
    f"WITH {I} SELECT event_id, user_id, round(MAX(db + i * 0.5::DOUBLE) {FRAME} - i * 0.5::DOUBLE, 6) AS meter_db FROM i")
add("limiter_running_min", lambda spark, sf: metering.limiter(_numbered(spark, sf).withColumn("target", F.least(F.lit(6.0), -3.0 - F.col("db"))), ["user_id"], "i", "target", 0.25).select("event_id", "user_id", r6(F.col("gain")).alias("gain_db")),
    f"WITH {I} SELECT event_id, user_id, round(MIN(LEAST(6.0::DOUBLE, -3.0::DOUBLE - db) - i * 0.25::DOUBLE) {FRAME} + i * 0.25::DOUBLE, 6) AS gain_db FROM i")

ARRAYS = "arr AS (SELECT user_id, COUNT(*) AS n, list(db ORDER BY i) AS l FROM i GROUP BY user_id)"
add("one_pole_rms", lambda spark, sf: metering.fold(_numbered(spark, sf).withColumn("power", F.pow(F.lit(10.0), F.col("db") / 10)), ["user_id"], "i", "power", F.lit(0.0), lambda a, v: a + (v - a) * 0.2, "state").select("user_id", "n", r6(10 * F.log10("state")).alias("rms_db")),
    f"WITH {I}, {ARRAYS} SELECT user_id, n, round(10 * log10(list_reduce(list_prepend(0.0::DOUBLE, list_transform(l, lambda v: pow(10.0, v / 10))), lambda a, v: a + (v - a) * 0.2::DOUBLE)), 6) AS rms_db FROM arr")


def range_controller(spark, sf, attack=0.4, release=0.05):
    """Gain follows the film-standard curve, faster down than up."""
    profile = dims.DRC_PROFILES[0]
    names = ["null_low", "null_high", "boost_ratio", "max_boost", "early_ratio", "early_to", "cut_ratio"]
    x = _numbered(spark, sf).withColumns({n: F.lit(v) for n, v in zip(names, profile[1:])}).withColumn("target", drc.static_gain_db(F.col("db") - 10))
    return metering.fold(x, ["user_id"], "i", "target", F.lit(0.0), lambda g, t: g + (t - g) * F.when(t < g, F.lit(attack)).otherwise(F.lit(release)), "gain").select("user_id", "n", r6(F.col("gain")).alias("gain_db"))


_CURVE = "CASE WHEN {v} < null_low THEN LEAST((null_low - {v}) / boost_ratio, max_boost) WHEN {v} <= null_high THEN 0.0 WHEN {v} <= early_to THEN -({v} - null_high) / early_ratio ELSE -(early_to - null_high) / early_ratio - ({v} - early_to) / cut_ratio END"
_PROFILES = dims.values(dims.DRC_PROFILES, "profile, null_low, null_high, boost_ratio, max_boost, early_ratio, early_to, cut_ratio")
add("range_controller", range_controller, f"""
WITH {I}, pr AS {_PROFILES}, tg AS (SELECT user_id, i, {_CURVE.format(v='(db - 10)')} AS t FROM i, pr WHERE profile = 'film-standard'), arr AS (SELECT user_id, COUNT(*) AS n, list(CAST(t AS DOUBLE) ORDER BY i) AS l FROM tg GROUP BY user_id)
SELECT user_id, n, round(list_reduce(list_prepend(0.0::DOUBLE, l), lambda g, t: g + (t - g) * CASE WHEN t < g THEN 0.4::DOUBLE ELSE 0.05::DOUBLE END), 6) AS gain_db FROM arr""")


def static_curve(spark, sf):
    profiles = dim(spark, dims.DRC_PROFILES, "profile string, null_low double, null_high double, boost_ratio double, max_boost double, early_ratio double, early_to double, cut_ratio double")
    return _numbered(spark, sf).crossJoin(profiles).groupBy("profile", "channel").agg(F.sum(F.round(drc.static_gain_db(F.col("db") - 10) * 1e6).cast("bigint")).alias("sum_micro_db"), r6(F.max(drc.static_gain_db(F.col("db") - 10))).alias("max_db"))


add("static_drc_curve", static_curve, f"""
WITH {I}, pr AS {_PROFILES}, c AS (SELECT profile, channel, {_CURVE.format(v='(db - 10)')} AS g FROM i, pr)
SELECT profile, channel, CAST(SUM(CAST(round(g * 1e6) AS BIGINT)) AS BIGINT) AS sum_micro_db, round(MAX(g), 6) AS max_db FROM c GROUP BY ALL""")

for _name, _bits in (("dynrng_decode", 5), ("compr_decode", 4)):
    _scale, _span = 1 << _bits, 1 << (8 - _bits)
    add(_name, lambda spark, sf, bits=_bits: spark.range(256).select(F.col("id").cast("int").alias("word")).withColumn("gain", drc.word_gain(F.col("word"), bits)).select("word", r6(F.col("gain")).alias("gain"), r6(20 * F.log10("gain")).alias("gain_db")), f"""
WITH w AS (SELECT CAST(range AS INT) AS word FROM range(256)), g AS (SELECT word, pow(2.0, CASE WHEN (word >> {_bits}) >= {_span // 2} THEN (word >> {_bits}) - {_span} ELSE word >> {_bits} END + 1) * ({_scale} + (word & {_scale - 1})) / {2 * _scale} AS gain FROM w)
SELECT word, round(gain, 6) AS gain, round(20 * log10(gain), 6) AS gain_db FROM g""")


def encode_dynrng(spark, sf):
    x = _numbered(spark, sf).withColumn("g", r6(F.col("db") / 2 + 7))
    x = x.withColumn("word", drc.encode_word(F.col("g"), 5)).withColumn("down", drc.encode_word(F.col("g"), 4, True))
    return x.groupBy("word", "down").agg(F.count(F.lit(1)).alias("n"))


_GAINS = lambda bits: dims.values([(w, g) for g, w in drc.word_gains(bits)], "word, code")
add("dynrng_encode", encode_dynrng, f"""
WITH {I}, gains AS (SELECT event_id, pow(10.0, round(db / 2 + 7, 6) / 20) AS gain FROM i), g AS (SELECT DISTINCT gain FROM gains),
a AS (SELECT gain, arg_min(word, {{'d': abs(code - gain), 'g': code}}) AS word FROM g, {_GAINS(5)} GROUP BY gain),
b AS (SELECT gain, COALESCE(arg_max(word, code) FILTER (code <= gain * (1 + 1e-12)), arg_min(word, code)) AS word FROM g, {_GAINS(4)} GROUP BY gain)
SELECT CAST(a.word AS INT) AS word, CAST(b.word AS INT) AS down, COUNT(*) AS n FROM gains JOIN a USING (gain) JOIN b USING (gain) GROUP BY ALL""")


def nearest_code(spark, sf):
    """The word whose gain is nearest in dB, the smallest of equals: an exhaustive search of 256 codes."""
    codes = F.broadcast(spark.range(256).select(F.col("id").cast("int").alias("word")).withColumn("code_db", r6(20 * F.log10(drc.word_gain(F.col("word"), 5)))))
    asked = _numbered(spark, sf).select(r6(F.round(F.col("db"), 1) / 2 + 7).alias("g")).distinct()
    return asked.crossJoin(codes).groupBy("g").agg(F.min_by("word", F.struct(r6(F.abs(F.col("g") - F.col("code_db"))), "word")).alias("word"))


add("nearest_code_search", nearest_code, f"""
WITH {I}, w AS (SELECT CAST(range AS INT) AS word, round(20 * log10(pow(2.0, CASE WHEN (range >> 5) >= 4 THEN (range >> 5) - 8 ELSE range >> 5 END + 1) * (32 + (range & 31)) / 64), 6) AS code_db FROM range(256)),
a AS (SELECT DISTINCT round(round(db, 1) / 2 + 7, 6) AS g FROM i)
SELECT g, word FROM (SELECT g, word, row_number() OVER (PARTITION BY g ORDER BY round(abs(g - code_db), 6), word) AS k FROM a, w) WHERE k = 1""")


def partial_gain(spark, sf):
    """A heavy word wins unscaled where asked for; else the light word's gain to the power of the scale."""
    x = spark.range(256).select(F.col("id").cast("int").alias("word")).crossJoin(dim(spark, [(0.0,), (0.25,), (0.5,), (1.0,)], "scale double")).crossJoin(dim(spark, [(None,), (17,), (200,)], "heavy int"))
    light = F.when((F.col("scale") == 0) | (F.col("word") == 0), F.lit(1.0)).otherwise(F.pow(drc.word_gain(F.col("word"), 5), F.col("scale")))
    return x.select("word", "scale", F.coalesce("heavy", F.lit(-1)).alias("heavy"), r6(F.when(F.col("heavy").isNotNull(), drc.word_gain(F.col("heavy"), 4)).otherwise(light)).alias("gain"))


_g = lambda w, bits: f"(pow(2.0, CASE WHEN ({w} >> {bits}) >= {1 << (7 - bits)} THEN ({w} >> {bits}) - {1 << (8 - bits)} ELSE {w} >> {bits} END + 1) * ({1 << bits} + ({w} & {(1 << bits) - 1})) / {2 << bits})"
add("partial_drc_gain", partial_gain, f"""
SELECT CAST(range AS INT) AS word, scale, COALESCE(heavy, -1) AS heavy, round(CASE WHEN heavy IS NOT NULL THEN {_g('heavy', 4)} WHEN scale = 0 OR range = 0 THEN 1.0 ELSE pow({_g('range', 5)}, scale) END, 6) AS gain
FROM range(256), (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) a(scale), (VALUES (NULL::INT), (17), (200)) h(heavy)""")
