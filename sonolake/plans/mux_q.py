"""Queries over packetisation and rate control.  A line item stands in for a frame; its order is the stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import packets
from ..operators.base import blocks_of, dealt, epoch_us, r6
from .loud_q import S, samples
from .registry import add


def frames(spark, sf, **before):
    """Frames of a programme (part modulo 40): index and size in bytes; ``before`` are totals over the frames before."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_partkey") % 40).alias("prog"), "l_orderkey", "l_linenumber", (F.col("l_quantity") * 36).cast("bigint").alias("size"))
    return packets.numbered(l, ["prog"], ["l_orderkey", "l_linenumber", "size"], "i", before)


FRAMES = "f AS (SELECT l_partkey % 40 AS prog, l_orderkey, l_linenumber, CAST(l_quantity * 36 AS BIGINT) AS size, row_number() OVER (PARTITION BY l_partkey % 40 ORDER BY l_orderkey, l_linenumber, CAST(l_quantity * 36 AS BIGINT)) - 1 AS i FROM lineitem)"
SEG = f"{FRAMES}, g AS (SELECT prog, i // 31 + 1 AS seq, COUNT(*) AS n_frames, CAST(SUM(size) AS BIGINT) AS mdat_bytes FROM f GROUP BY ALL)"

add("fragment_plan", lambda spark, sf: packets.fragments(frames(spark, sf), ["prog"], "i", "size", 31, 1536).withColumn("moof_bytes", F.col("n_frames") * 4 + 88),
    f"WITH {SEG} SELECT prog, seq, n_frames, mdat_bytes, CAST(COALESCE(SUM(n_frames * 1536) OVER (PARTITION BY prog ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tfdt, n_frames * 4 + 88 AS moof_bytes FROM g")

add("mp4_chunk_offsets", lambda spark, sf: frames(spark, sf, offset=F.col("size")).select("prog", "i", "offset"),
    f"WITH {FRAMES} SELECT prog, i, CAST(COALESCE(SUM(size) OVER (PARTITION BY prog ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM f")

add("ts_packet_plan", lambda spark, sf: packets.transport(frames(spark, sf, sent=packets.packets_of(F.col("size"))), "i", "size", "sent", 1536, 48000).select("prog", "i", F.col("part").cast("bigint").alias("part"), "pts", "continuity", "stuffing"), f"""
WITH {FRAMES}, n AS (SELECT *, CAST(ceil(size / 184) AS BIGINT) AS n FROM f), p AS (SELECT *, unnest(generate_series(0, n - 1)) AS part FROM n)
SELECT prog, i, part, i * 138240000 // 48000 AS pts, (row_number() OVER (PARTITION BY prog ORDER BY i, part) - 1) % 16 AS continuity, CASE WHEN part = n - 1 THEN n * 184 - size ELSE 0 END AS stuffing FROM p""")


def psi(spark, sf, every=40):
    """Table packets before every 40th frame, and frames, in the order in which they are sent."""
    f = frames(spark, sf)
    tables = f.where(F.col("i") % every == 0).withColumn("kind", F.explode(F.array(F.lit("0-PAT"), F.lit("1-PMT"))))
    x = tables.select("prog", "i", "kind").unionByName(f.select("prog", "i", F.lit("2-PES").alias("kind")))
    return x.groupBy("prog", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("last"))


add("ts_table_packets", psi, f"""
WITH {FRAMES}, u AS (SELECT prog, i, k AS kind FROM f, (VALUES ('0-PAT'), ('1-PMT')) v(k) WHERE i % 40 = 0 UNION ALL SELECT prog, i, '2-PES' FROM f) SELECT prog, kind, COUNT(*) AS n, MAX(i) AS last FROM u GROUP BY ALL""")

add("mkv_timestamps", lambda spark, sf: frames(spark, sf).select("prog", "i", F.expr("i * 1536 * 1000 div 48000").alias("ms"), F.expr("i * 1536 * 1000 div 44100").alias("ms_441"), F.expr("(i * 32) div 1024").alias("cluster"), F.expr("i * 32 - ((i * 32) div 1024) * 1024").alias("relative")),
    f"WITH {FRAMES} SELECT prog, i, i * 1536000 // 48000 AS ms, i * 1536000 // 44100 AS ms_441, (i * 32) // 1024 AS cluster, i * 32 - ((i * 32) // 1024) * 1024 AS relative FROM f")

DUR = f"{SEG}, d AS (SELECT prog, seq, n_frames * 1536 AS dur FROM g)"


def _segments(spark, sf):
    return packets.fragments(frames(spark, sf), ["prog"], "i", "size", 31, 1536).withColumn("dur", F.col("n_frames") * 1536)


add("dash_rle_timeline", lambda spark, sf: packets.run_lengths(_segments(spark, sf), ["prog"], "seq", "dur"), f"""
WITH {DUR}, i AS (SELECT *, row_number() OVER (PARTITION BY prog ORDER BY seq) - row_number() OVER (PARTITION BY prog, dur ORDER BY seq) AS island FROM d) SELECT prog, dur, MIN(seq) AS first, COUNT(*) - 1 AS repeats FROM i GROUP BY prog, dur, island""")


def hls_media(spark, sf):
    """The ordered lines of a media playlist, and its target duration."""
    s = _segments(spark, sf).withColumn("line", F.concat(F.lit("#EXTINF:"), F.format_string("%.5f", F.col("dur") / 48000), F.lit(",seg"), F.col("seq").cast("string"), F.lit(".m4s")))
    rows = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return s.groupBy("prog").agg(F.ceil(F.max("dur") / 48000).cast("bigint").alias("target"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("body"))


add("hls_playlist", hls_media, f"WITH {DUR} SELECT prog, CAST(ceil(MAX(dur) / 48000) AS BIGINT) AS target, string_agg('#EXTINF:' || printf('%.5f', dur / 48000) || ',seg' || CAST(seq AS VARCHAR) || '.m4s', chr(10) ORDER BY seq) AS body FROM d GROUP BY prog")


def hls_master(spark, sf):
    """Peak and average bandwidth of each programme's segments as a master playlist line."""
    b = _segments(spark, sf).withColumn("bps", F.ceil(F.col("mdat_bytes") * 8 * 48000 / F.col("dur")).cast("bigint"))
    a = b.groupBy("prog").agg(F.max("bps").alias("peak"), F.ceil(F.sum("mdat_bytes") * 8 * 48000 / F.sum("dur")).cast("bigint").alias("mean"))
    return a.select("prog", F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), F.col("peak").cast("string"), F.lit(",AVERAGE-BANDWIDTH="), F.col("mean").cast("string"), F.lit(',CODECS="'), F.when(F.col("prog") % 2 == 0, "ac-3").otherwise("ec-3"), F.lit('"')).alias("line"))


add("hls_master", hls_master, f"""
WITH {SEG}, b AS (SELECT prog, MAX(CAST(ceil(mdat_bytes * 8 * 48000 / (n_frames * 1536)) AS BIGINT)) AS peak, CAST(ceil(SUM(mdat_bytes) * 8 * 48000 / SUM(n_frames * 1536)) AS BIGINT) AS mean FROM g GROUP BY prog)
SELECT prog, '#EXT-X-STREAM-INF:BANDWIDTH=' || peak || ',AVERAGE-BANDWIDTH=' || mean || ',CODECS="' || CASE WHEN prog % 2 = 0 THEN 'ac-3' ELSE 'ec-3' END || '"' AS line FROM b""")


def bursts(spark, sf):
    """Access units gathered until six blocks: the burst that each unit goes to, for 1, 2, 3 or 6 blocks a unit."""
    f = frames(spark, sf).withColumn("blocks", F.element_at(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(6)), (F.col("prog") % 4 + 1).cast("int")).cast("bigint"))
    # Bursts inside a block are whole without a shuffle; what is left of the rest is as bounded as a block.
    f = f.withColumn("burst", F.expr("i * blocks div 6")).groupBy("prog", "block", "burst").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("blocks").alias("blocks"))
    f = dealt(f, blocks_of(spark.read.parquet(f"{sf}/lineitem.parquet")), "prog", "burst")
    return f.groupBy("prog", "burst").agg(F.sum("n").alias("n_units"), F.sum("size").cast("bigint").alias("payload"), (F.sum("blocks") == 6).alias("complete"))


add("burst_packer", bursts, f"""
WITH {FRAMES}, b AS (SELECT *, [1, 2, 3, 6][prog % 4 + 1] AS blocks FROM f), c AS (SELECT *, (SUM(blocks) OVER (PARTITION BY prog ORDER BY i) - blocks) // 6 AS burst FROM b)
SELECT prog, CAST(burst AS BIGINT) AS burst, COUNT(*) AS n_units, CAST(SUM(size) AS BIGINT) AS payload, SUM(blocks) = 6 AS complete FROM c GROUP BY ALL""")

add("cbr_accumulator", lambda spark, sf: _cbr(spark, sf), f"""
WITH {FRAMES}, w AS (SELECT prog, i, (i + 1) * (448 + prog) * 1536000 // 705600 - i * (448 + prog) * 1536000 // 705600 AS words, (448 + prog) * 1536000 // 705600 AS base FROM f) SELECT prog, i, words, words <> base AS padded FROM w""")


def _cbr(spark, sf):
    """Words of the i-th frame at constant rate: the difference of cumulative floors."""
    r = (F.col("prog") + 448) * 1536000
    f = frames(spark, sf).withColumn("r", r)
    f = f.withColumn("words", F.expr("(i + 1) * r div 705600 - i * r div 705600"))
    return f.select("prog", "i", "words", (F.col("words") != F.expr("r div 705600")).alias("padded"))


def fitting(spark, sf, budget=100_000):
    """The largest index whose cumulative size fits a budget: a search over a monotone cost."""
    return frames(spark, sf, before=F.col("size")).withColumn("cum", F.col("before") + F.col("size")).where(F.col("cum") <= budget).groupBy("prog").agg(F.max("i").alias("best"), F.max("cum").cast("bigint").alias("used"))


add("max_fitting_budget", fitting, f"WITH {FRAMES}, c AS (SELECT *, SUM(size) OVER (PARTITION BY prog ORDER BY i) AS cum FROM f) SELECT prog, MAX(i) AS best, CAST(MAX(cum) AS BIGINT) AS used FROM c WHERE cum <= 100000 GROUP BY prog")

add("sequence_wrap", lambda spark, sf: frames(spark, sf).select("prog", "i", F.when(F.col("i") == 0, F.lit(0).cast("bigint")).otherwise(F.pmod(F.col("i") - 1, F.lit(1023)) + 1).alias("seq")),
    f"WITH {FRAMES} SELECT prog, i, CASE WHEN i = 0 THEN 0 ELSE (i - 1) % 1023 + 1 END AS seq FROM f")


def access_units(spark, sf):
    """A unit opens at each independent substream (first line of an order) and gathers the dependents after it."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_quantity") * 36).cast("bigint").alias("size"), (F.col("l_linenumber") % 3 != 1).alias("dependent"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).alias("i"))
    unit = F.sum(F.when(F.col("dependent"), 0).otherwise(1)).over(Window.partitionBy("l_suppkey").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return l.withColumn("unit", unit).where("unit > 0").groupBy("l_suppkey", "unit").agg(F.count(F.lit(1)).alias("substreams"), F.sum("size").cast("bigint").alias("bytes"))


add("access_unit_group", access_units, """
WITH l AS (SELECT l_suppkey, CAST(l_quantity * 36 AS BIGINT) AS size, CASE WHEN l_linenumber % 3 <> 1 THEN 0 ELSE 1 END AS opens, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS i FROM lineitem),
u AS (SELECT *, CAST(SUM(opens) OVER (PARTITION BY l_suppkey ORDER BY i) AS BIGINT) AS unit FROM l) SELECT l_suppkey, unit, COUNT(*) AS substreams, CAST(SUM(size) AS BIGINT) AS bytes FROM u WHERE unit > 0 GROUP BY ALL""")


def overwrite(spark, sf):
    """At each location the last substream of a unit wins over the bed."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", (F.col("l_partkey") % 5).alias("location"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("at"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("v"))
    return l.groupBy("l_orderkey", "location").agg(F.max_by("v", "at").alias("v"))


add("location_overwrite", overwrite, "SELECT l_orderkey, location, v FROM (SELECT l_orderkey, l_partkey % 5 AS location, CAST(round(l_extendedprice * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 5 ORDER BY l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1")


def gaps(spark, sf):
    """Silences of an hour or more between a user's events: the watchdog's verdict in batch."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    x = samples(spark, sf).withColumn("gap", F.lead("us").over(w) - F.col("us"))
    return x.where(F.col("gap") >= 3_600_000_000).groupBy("user_id").agg(F.count(F.lit(1)).alias("timeouts"), F.max("gap").alias("longest_us"))


add("silence_gaps", gaps, f"WITH {S}, g AS (SELECT user_id, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) - us AS gap FROM s) SELECT user_id, COUNT(*) AS timeouts, MAX(gap) AS longest_us FROM g WHERE gap >= 3600000000 GROUP BY user_id")


def servo(spark, sf):
    """Clamped proportional drift estimate, smoothed by one pole, folded over a user's events."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    x = samples(spark, sf).withColumn("i", F.row_number().over(w)).withColumn("e", F.col("x") / 10000.0 - 2.5)
    from ..operators.metering import fold

    return fold(x, ["user_id"], "i", "e", F.lit(0.0), lambda a, e: a + (F.least(F.greatest(e * 0.5, F.lit(-1.0)), F.lit(1.0)) - a) * 0.1, "drift").select("user_id", r6(F.col("drift")).alias("drift"))


add("drift_servo", servo, f"""
WITH {S}, a AS (SELECT user_id, list(x / 10000.0::DOUBLE - 2.5::DOUBLE ORDER BY us, event_id) AS l FROM s GROUP BY user_id)
SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, l), lambda a, e: a + (LEAST(GREATEST(e * 0.5::DOUBLE, -1.0::DOUBLE), 1.0::DOUBLE) - a) * 0.1::DOUBLE), 6) AS drift FROM a""")


def hold_last(spark, sf):
    """A user's daily value on a complete grid of days: zero before the first, the last one held in gaps."""
    day = F.floor(F.col("us") / 86_400_000_000).cast("bigint")
    d = samples(spark, sf).groupBy("user_id", day.alias("day")).agg(F.max("x").alias("x"))
    span = samples(spark, sf).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    grid = d.select("user_id").distinct().crossJoin(F.broadcast(span)).select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(d, ["user_id", "day"], "left").select("user_id", "day", F.coalesce(F.last("x", ignorenulls=True).over(w), F.lit(0).cast("bigint")).alias("x"))


add("hold_last_fill", hold_last, f"""
WITH {S}, d AS (SELECT user_id, CAST(floor(us / 86400000000) AS BIGINT) AS day, MAX(x) AS x FROM s GROUP BY ALL), g AS (SELECT user_id, unnest(generate_series((SELECT MIN(day) FROM d), (SELECT MAX(day) FROM d))) AS day FROM (SELECT DISTINCT user_id FROM d))
SELECT user_id, day, COALESCE(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS x FROM g LEFT JOIN d USING (user_id, day)""")


def reuse(spark, sf):
    """Only even blocks send a coordinate; odd blocks take over the last one sent."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_discount") * 100).cast("bigint").alias("c"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey").rowsBetween(Window.unboundedPreceding, 0)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.last(F.when(F.col("l_linenumber") % 2 == 0, F.col("c")), ignorenulls=True).over(w).alias("c"))


add("coordinate_reuse_fill", reuse, "SELECT l_orderkey, l_linenumber, l_partkey, last_value(CASE WHEN l_linenumber % 2 = 0 THEN CAST(round(l_discount * 100) AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM lineitem")


def programme_length(spark, sf):
    """Programmes of several sources with offsets: length is the largest offset plus frames; rates must agree."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", (F.floor(epoch_us("o_orderdate") / 86_400_000_000) % 1000).cast("bigint").alias("offset"), (F.round(F.col("o_totalprice")) % 500).cast("bigint").alias("frames"), F.col("o_orderstatus").alias("rate"))
    return o.groupBy("o_custkey").agg(F.max(F.col("offset") + F.col("frames")).alias("length"), (F.count_distinct("rate") == 1).alias("same_rate"))


add("load_sources", programme_length, "SELECT o_custkey, MAX(CAST(floor(epoch_us(o_orderdate) / 86400000000) % 1000 AS BIGINT) + CAST(round(o_totalprice) % 500 AS BIGINT)) AS length, COUNT(DISTINCT o_orderstatus) = 1 AS same_rate FROM orders GROUP BY o_custkey")
