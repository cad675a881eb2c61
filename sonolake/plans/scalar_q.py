"""Queries over scalar functions, generators and validation grammars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import dims
from ..operators.base import dim, r6
from .loud_q import DIM, FULL, S, channel_dim, samples
from .registry import add


def level_scalars(spark, sf):
    x = samples(spark, sf).withColumn("v", F.col("x") / float(FULL))
    return x.select("event_id", r6(sc.to_dbfs(F.col("v"))).alias("dbfs"), r6(sc.to_db(F.col("v") - 0.001)).alias("db"), r6(sc.meter_fraction(sc.to_dbfs(F.col("v")))).alias("bar"), r6(sc.linear_gain(F.col("x") / -1000.0)).alias("gain"), sc.snap_trim(F.col("x") / 1234.5).alias("trim"))


add("level_scalars", level_scalars, f"""
WITH {S}, v AS (SELECT event_id, x, x / {FULL}.0::DOUBLE AS v FROM s), d AS (SELECT *, GREATEST(COALESCE(CASE WHEN v > 0 THEN 20 * log10(v) END, -120.0), -120.0) AS db0 FROM v)
SELECT event_id, round(db0, 6) AS dbfs, round(CASE WHEN v - 0.001 > 1e-10 THEN 20 * log10(v - 0.001) ELSE -200.0 END, 6) AS db, round(LEAST(GREATEST((db0 + 60) / 60, 0.0), 1.0), 6) AS bar, round(pow(10.0, x / -1000.0::DOUBLE / 20), 6) AS gain, round(x / 1234.5::DOUBLE, 1) AS trim FROM d""")


def quantisers(spark, sf):
    x = samples(spark, sf).withColumn("v", F.col("x") / 25000.0 - 1)
    return x.select("event_id", sc.to_fixed25(F.col("v") / 2).alias("fixed"), sc.exponent_of(sc.to_fixed25(F.col("v") / 2)).alias("exponent"), sc.quantise(F.col("v") * 9, 0.1, 192).alias("code"), r6(sc.dequantise(sc.quantise(F.col("v") * 9, 0.1, 192), 0.1, 192)).alias("value"), sc.quantise_position(F.col("v")).alias("xy"), sc.quantise_height(F.col("v")).alias("z"))


add("quantisers", quantisers, f"""
WITH {S}, v AS (SELECT event_id, x / 25000.0::DOUBLE - 1 AS v FROM s), q AS (SELECT event_id, v, CAST(LEAST(GREATEST(round(v / 2 * 16777216.0), -16777216.0), 16777215.0) AS INT) AS fixed, CAST(LEAST(GREATEST(round(v * 9 / 0.1::DOUBLE) + 96, 0), 191) AS INT) AS code FROM v)
SELECT event_id, fixed, CAST(CASE WHEN fixed = 0 THEN 24 ELSE LEAST(24, 24 - length(bin(abs(fixed)))) END AS INT) AS exponent, code, round((code - 96) * 0.1::DOUBLE, 6) AS value, CAST(round(LEAST(GREATEST(v, 0.0), 1.0) * 62) AS INT) AS xy,
 CAST(CASE WHEN v < 0 THEN 0 ELSE 16 END + round(abs(LEAST(GREATEST(v, -1.0), 1.0)) * 15) AS INT) AS z FROM q""")


def windows(spark, sf):
    x = samples(spark, sf).withColumn("v", F.col("x") / 1000.0 - 25)
    return x.select("event_id", r6(sc.sinc(F.col("v"))).alias("sinc"), r6(sc.blackman(F.col("v"), 16.0)).alias("window"), r6(sc.smoothing(F.col("v"), F.lit(48000.0))).alias("smooth"))


add("window_functions", windows, f"""
WITH {S}, v AS (SELECT event_id, x / 1000.0::DOUBLE - 25 AS v FROM s)
SELECT event_id, round(CASE WHEN v = 0 THEN 1.0 ELSE sin(v * pi()) / (v * pi()) END, 6) AS sinc, round(CASE WHEN abs(v) < 16 THEN 0.42 + 0.5 * cos(v / 16 * pi()) + 0.08 * cos(2 * v / 16 * pi()) ELSE 0.0 END, 6) AS "window", round(CASE WHEN v <= 0 THEN 1.0 ELSE 1 - exp(-1000.0 * 256 / 48000 / v) END, 6) AS smooth FROM v""")

add("mix_levels", lambda spark, sf: spark.range(8).select(F.col("id").cast("int").alias("code"), r6(sc.mix_level(F.col("id"))).alias("gain"), r6(sc.to_db(sc.mix_level(F.col("id")))).alias("db"), sc.lfe_mix_db(F.col("id")).cast("int").alias("lfe_db"), (F.col("id") >= 3).alias("surround_ok")),
    "SELECT CAST(range AS INT) AS code, round(CASE WHEN range = 7 THEN 0.0 ELSE pow(2.0, (2 - range) / 4.0::DOUBLE) END, 6) AS gain, round(CASE WHEN range = 7 THEN -200.0 ELSE 20 * log10(pow(2.0, (2 - range) / 4.0::DOUBLE)) END, 6) AS db, CAST(10 - range AS INT) AS lfe_db, range >= 3 AS surround_ok FROM range(8)")

add("channel_names", lambda spark, sf: samples(spark, sf).groupBy("channel").agg(F.count(F.lit(1)).alias("n")).join(channel_dim(spark), "channel").select("name", "n", "azimuth", "weight"),
    f"WITH {S}, {DIM} SELECT name, COUNT(*) AS n, azimuth, weight FROM s JOIN dim USING (channel) GROUP BY ALL")

BANDS = dims.values([(i, a, b) for i, (a, b) in enumerate(dims.REMATRIX_BANDS)], "band, lo, hi")


def bin_bands(spark, sf):
    """Range join of bins to bands of a small table; bins outside all bands have none."""
    bands = dim(spark, [(i, a, b) for i, (a, b) in enumerate(dims.REMATRIX_BANDS)], "band int, lo int, hi int")
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_partkey") % 256).alias("bin"))
    return p.join(bands, (F.col("bin") >= F.col("lo")) & (F.col("bin") <= F.col("hi")), "left").groupBy(F.coalesce("band", F.lit(-1)).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("bin").alias("first"), F.max("bin").alias("last"))


add("bin_to_band", bin_bands, f"WITH b AS {BANDS} SELECT CAST(COALESCE(band, -1) AS INT) AS band, COUNT(*) AS n, MIN(bin) AS first, MAX(bin) AS last FROM (SELECT p_partkey % 256 AS bin FROM part) LEFT JOIN b ON bin BETWEEN lo AND hi GROUP BY ALL")


def channel_lists(spark, sf):
    """Comma lists of locations to a bitmap: unknown names are errors, and names must not repeat."""
    names = dims.LOCATIONS
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.concat_ws(",", *[F.element_at(F.array(*map(F.lit, [*names, "??"])), ((F.col("p_partkey") * k) % (len(names) + (1 if k == 7 else 0)) + 1).cast("int")) for k in (1, 3, 7)]).alias("list"))
    x = p.select("p_partkey", F.posexplode(F.split("list", ",")).alias("pos", "name"))
    bits = dim(spark, [(n, 0x8000 >> i) for i, n in enumerate(names)], "name string, bit int")
    g = x.join(bits, "name", "left").groupBy("p_partkey").agg(F.coalesce(F.bit_or("bit"), F.lit(0)).alias("map"), F.count_if(F.col("bit").isNull()).alias("unknown"), (F.count("name") - F.count_distinct("name")).alias("repeated"))
    return g.withColumn("valid", (F.col("unknown") == 0) & (F.col("repeated") == 0))


_LIST = "[" + ", ".join(f"'{n}'" for n in [*dims.LOCATIONS, "??"]) + "]"
add("channel_list_parse", channel_lists, f"""
WITH x AS (SELECT p_partkey, {_LIST}[(p_partkey * k) % (16 + CASE WHEN k = 7 THEN 1 ELSE 0 END) + 1] AS name FROM part, (VALUES (1), (3), (7)) v(k)), b AS {dims.values([(n, 0x8000 >> i) for i, n in enumerate(dims.LOCATIONS)], 'name, bit')}
SELECT p_partkey, CAST(COALESCE(bit_or(bit), 0) AS INT) AS map, COUNT(*) FILTER (WHERE bit IS NULL) AS unknown, COUNT(*) - COUNT(DISTINCT name) AS repeated, COUNT(*) FILTER (WHERE bit IS NULL) = 0 AND COUNT(*) = COUNT(DISTINCT name) AS valid FROM x LEFT JOIN b USING (name) GROUP BY p_partkey""")


def assignment(spark, sf):
    """An explicit mapping: every source must be mentioned, no destination twice, the last row for a source wins."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").alias("seq"), (F.col("l_suppkey") % 4).alias("source"), (F.col("l_partkey") % 5).alias("dest"), F.col("l_partkey"))
    last = l.groupBy("l_orderkey", "source").agg(F.max_by("dest", F.struct("seq", "l_partkey", "dest")).alias("dest"))
    return last.groupBy("l_orderkey").agg((F.count(F.lit(1)) == 4).alias("complete"), (F.count(F.lit(1)) == F.count_distinct("dest")).alias("unique"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "dest"))), lambda r: F.concat(r["source"].cast("string"), F.lit(":"), r["dest"].cast("string"))), ",").alias("map"))


add("assignment_rows", assignment, """
WITH l AS (SELECT l_orderkey, l_suppkey % 4 AS source, l_partkey % 5 AS dest, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 4 ORDER BY l_linenumber DESC, l_partkey DESC, l_partkey % 5 DESC) AS k FROM lineitem)
SELECT l_orderkey, COUNT(*) = 4 AS complete, COUNT(*) = COUNT(DISTINCT dest) AS "unique", string_agg(source || ':' || dest, ',' ORDER BY source) AS map FROM l WHERE k = 1 GROUP BY l_orderkey""")


def sine(spark, sf):
    """A tone per nation from a row range: level and phase by formula, measured back."""
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey")
    t = n.crossJoin(spark.range(4800)).select("n_nationkey", F.round(F.sin(F.col("id") * (F.col("n_nationkey") + 1) * (2 * 3.141592653589793 * 100 / 48000)) * 16384).cast("bigint").alias("x"))
    return t.groupBy("n_nationkey").agg(F.sum(F.col("x") * F.col("x")).alias("sum_sq"), F.max("x").alias("peak"), F.count(F.lit(1)).alias("n"))


add("sine_generator", sine, "WITH t AS (SELECT n_nationkey, CAST(round(sin(range * (n_nationkey + 1) * (2 * 3.141592653589793 * 100 / 48000)) * 16384) AS BIGINT) AS x FROM nation, range(4800)) SELECT n_nationkey, CAST(SUM(x * x) AS BIGINT) AS sum_sq, MAX(x) AS peak, COUNT(*) AS n FROM t GROUP BY n_nationkey")


def tone_level(spark, sf):
    """Single-bin transform of each user's events: the level at one frequency."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    x = samples(spark, sf).withColumn("n", (F.row_number().over(w) - 1))
    a = F.col("n") * 0.3
    t = x.groupBy("user_id").agg(F.sum(F.col("x") * F.cos(a)).alias("c"), F.sum(F.col("x") * F.sin(a)).alias("s"), F.count(F.lit(1)).alias("k"))
    return t.select("user_id", F.round(20 * F.log10(2 * F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("k") / FULL), 5).alias("tone_db"))


add("tone_level", tone_level, f"""
WITH {S}, n AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS n FROM s), t AS (SELECT user_id, SUM(x * cos(n * 0.3::DOUBLE)) AS c, SUM(x * sin(n * 0.3::DOUBLE)) AS s, COUNT(*) AS k FROM n GROUP BY user_id)
SELECT user_id, round(20 * log10(2 * sqrt(c * c + s * s) / k / {FULL}), 5) AS tone_db FROM t""")


def audio_stats(spark, sf):
    """Levels with grouping sets: by channel, by parity of the user, and overall."""
    x = samples(spark, sf).withColumn("programme", (F.col("user_id") % 2).cast("string"))
    return x.rollup("programme", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_x"), F.max("x").alias("peak")).select(F.coalesce("programme", F.lit("*")).alias("programme"), F.coalesce("channel", F.lit("*")).alias("channel"), "n", "sum_x", "peak")


add("level_rollup", audio_stats, f"WITH {S} SELECT COALESCE(CAST(user_id % 2 AS VARCHAR), '*') AS programme, COALESCE(channel, '*') AS channel, COUNT(*) AS n, CAST(SUM(x) AS BIGINT) AS sum_x, MAX(x) AS peak FROM s GROUP BY ROLLUP (CAST(user_id % 2 AS VARCHAR), channel)")


def gaq_mode(spark, sf):
    """Cheapest of four modes for each block, the lowest of equals."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.count(F.lit(1)).alias("n"))
    m = l.crossJoin(dim(spark, [(0,), (1,), (2,), (3,)], "mode int")).withColumn("bits", F.when(F.col("mode") == 0, F.col("n") * 30).otherwise(F.expr("q div (mode + 1)") + F.col("n") * F.col("mode") * 6))
    return m.groupBy("l_orderkey").agg(F.min(F.struct("bits", "mode")).alias("m")).select("l_orderkey", F.col("m.mode").alias("mode"), F.col("m.bits").alias("bits"))


add("gaq_mode_choice", gaq_mode, """
WITH l AS (SELECT l_orderkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey), m AS (SELECT l_orderkey, mode, CASE WHEN mode = 0 THEN n * 30 ELSE q // (mode + 1) + n * mode * 6 END AS bits FROM l, (VALUES (0), (1), (2), (3)) v(mode))
SELECT l_orderkey, mode, bits FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY bits, mode) AS k FROM m) WHERE k = 1""")


def veto(spark, sf):
    """Any switched block in an order's lines turns coupling off for all; first switched line of each."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 45).alias("sw"))
    return l.groupBy("l_orderkey").agg((~F.bool_or("sw")).alias("coupled"), F.coalesce(F.min(F.when(F.col("sw"), F.col("l_linenumber") * 256)), F.lit(-1)).alias("transient_at"))


add("switch_veto", veto, "SELECT l_orderkey, NOT bool_or(l_quantity > 45) AS coupled, CAST(COALESCE(MIN(CASE WHEN l_quantity > 45 THEN l_linenumber * 256 END), -1) AS INT) AS transient_at FROM lineitem GROUP BY l_orderkey")


def hold_back(spark, sf):
    """A flagged frame waits for its successor: the index at which each is released."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).cast("bigint").alias("i"), (F.col("l_quantity") > 40).alias("held"))
    return l.select("l_suppkey", "i", F.when(F.col("held"), F.coalesce(F.lead("i").over(Window.partitionBy("l_suppkey").orderBy("i")), F.lit(-1).cast("bigint"))).otherwise(F.col("i")).alias("released_at"))


add("hold_back_release", hold_back, """
WITH l AS (SELECT l_suppkey, l_quantity > 40 AS held, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS i FROM lineitem) SELECT l_suppkey, i, CASE WHEN held THEN COALESCE(lead(i) OVER (PARTITION BY l_suppkey ORDER BY i), -1) ELSE i END AS released_at FROM l""")
