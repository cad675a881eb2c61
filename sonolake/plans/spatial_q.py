"""Queries over routing, downmix, panning, motion and transforms."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dims, spatial
from ..operators.base import dim, epoch_us, r6
from .loud_q import DIM, FULL, S, channel_dim, samples
from .registry import add

M3, P3 = 0.7071067811865476, 1.4142135623730951
MODES = [(mode, at, name) for mode, names in dims.MODES for at, name in enumerate(names)]
LEVELS = [(M3, M3), (0.5946035575013605, 0.5), (0.5, 0.0)]
_MODES = f"m AS (SELECT mode, pos, ch, CASE WHEN MAX(CASE WHEN ch = 'L' THEN 1 ELSE 0 END) OVER (PARTITION BY mode) = 1 THEN true ELSE false END AS wide FROM {dims.values(MODES, 'mode, pos, ch')}), lv AS {dims.values(LEVELS, 'clev, slev')}"


def _modes(spark):
    wide = F.max(F.when(F.col("ch") == "L", 1).otherwise(0)).over(Window.partitionBy("mode")) == 1
    return spark.createDataFrame(MODES, "mode int, pos int, ch string").withColumn("wide", wide).crossJoin(dim(spark, LEVELS, "clev double, slev double"))


def stereo_matrix(modes):
    """(mode, levels, channel, out, gain) of the two-channel downmix, attenuated where gains add to over one."""
    side = lambda own, other: F.when(F.col("ch") == own, 1.0).when(F.col("ch") == other, 0.0)
    common = lambda w, s: w.when(F.col("ch") == "C", F.when(F.col("wide"), F.col("clev")).otherwise(M3)).when(F.col("ch") == "S", F.col("slev") * M3).when(F.col("ch") == s, F.col("slev")).otherwise(0.0)
    x = modes.withColumn("o", F.explode(F.array(F.struct(F.lit("Lo").alias("out"), common(side("L", "R"), "SL").alias("gain")), F.struct(F.lit("Ro").alias("out"), common(side("R", "L"), "SR").alias("gain")))))
    return spatial.normalise(x.select("mode", "clev", "slev", "pos", "ch", "o.out", "o.gain"), ["mode", "clev", "slev", "out"])


def mono_matrix(modes):
    c = F.col("ch")
    gain = F.when(c.isin("L", "R"), M3).when(c == "C", F.when(F.col("wide"), F.col("clev") * P3).otherwise(1.0)).otherwise(F.col("slev") * M3)
    return spatial.normalise(modes.withColumn("gain", gain), ["mode", "clev", "slev"])


_STEREO = f"""{_MODES}, st AS (SELECT mode, clev, slev, pos, ch, o.out, CASE WHEN ch = o.own THEN 1.0 WHEN ch = o.other THEN 0.0 WHEN ch = 'C' THEN CASE WHEN wide THEN clev ELSE {M3} END WHEN ch = 'S' THEN slev * {M3} WHEN ch = o.side THEN slev ELSE 0.0 END AS g
 FROM m, lv, (VALUES ('Lo', 'L', 'R', 'SL'), ('Ro', 'R', 'L', 'SR')) o(out, own, other, side)),
sn AS (SELECT *, CAST(g AS DOUBLE) / GREATEST(1.0, SUM(CAST(g AS DOUBLE)) OVER (PARTITION BY mode, clev, slev, out)) AS gain FROM st)"""
_MONO = f"""{_MODES}, mo AS (SELECT mode, clev, slev, pos, ch, CAST(CASE WHEN ch IN ('L', 'R') THEN {M3} WHEN ch = 'C' THEN CASE WHEN wide THEN clev * {P3} ELSE 1.0 END ELSE slev * {M3} END AS DOUBLE) AS g FROM m, lv),
mn AS (SELECT *, g / GREATEST(1.0, SUM(g) OVER (PARTITION BY mode, clev, slev)) AS gain FROM mo)"""
add("stereo_downmix", lambda spark, sf: stereo_matrix(_modes(spark)).select("mode", r6(F.col("clev")).alias("clev"), r6(F.col("slev")).alias("slev"), "pos", "ch", "out", r6(F.col("gain")).alias("gain")),
    f"WITH {_STEREO} SELECT mode, round(clev, 6) AS clev, round(slev, 6) AS slev, pos, ch, out, round(gain, 6) AS gain FROM sn")
add("mono_downmix", lambda spark, sf: mono_matrix(_modes(spark)).select("mode", r6(F.col("clev")).alias("clev"), r6(F.col("slev")).alias("slev"), "pos", "ch", r6(F.col("gain")).alias("gain")),
    f"WITH {_MONO} SELECT mode, round(clev, 6) AS clev, round(slev, 6) AS slev, pos, ch, round(gain, 6) AS gain FROM mn")


def _framed(spark, sf):
    """Samples by channel name, numbered in their user's channel: x at n."""
    w = Window.partitionBy("user_id", "channel").orderBy("us", "event_id")
    return samples(spark, sf).withColumn("n", (F.row_number().over(w) - 1).cast("bigint")).join(channel_dim(spark).select("channel", "name"), "channel")


FR = f"{S}, {DIM}, fr AS (SELECT event_id, user_id, name, x, us, row_number() OVER (PARTITION BY user_id, channel ORDER BY us, event_id) - 1 AS n FROM s JOIN dim USING (channel))"


def mono_peak(spark, sf):
    m = mono_matrix(_modes(spark)).where("mode = 7").select("clev", F.col("ch").alias("name"), "gain")
    y = _framed(spark, sf).join(F.broadcast(m), "name").groupBy("clev", "user_id", "n").agg(F.sum(F.col("gain") * F.col("x")).alias("y"))
    return y.groupBy(r6(F.col("clev")).alias("clev"), "user_id").agg(r6(20 * F.log10(F.max(F.abs("y")) / FULL)).alias("peak_db"))


add("mono_downmix_peak", mono_peak, f"""
WITH {FR}, {_MONO}, y AS (SELECT clev, user_id, n, SUM(gain * x) AS y FROM fr JOIN (SELECT * FROM mn WHERE mode = 7) k ON k.ch = fr.name GROUP BY ALL)
SELECT round(clev, 6) AS clev, user_id, round(20 * log10(MAX(abs(y)) / {FULL}), 6) AS peak_db FROM y GROUP BY clev, user_id""")


def routing_render(spark, sf):
    m = stereo_matrix(_modes(spark)).where(f"mode = 7 AND gain <> 0 AND clev > 0.7").select(F.col("ch").alias("name"), F.col("out").alias("coded"), "gain")
    return spatial.render(_framed(spark, sf), m, ["user_id", "n"], "name", "x").select("user_id", "n", "coded", r6(F.col("y")).alias("y"))


add("routing_render", routing_render, f"""
WITH {FR}, {_STEREO} SELECT user_id, n, out AS coded, round(SUM(gain * x), 6) AS y FROM fr JOIN (SELECT * FROM sn WHERE mode = 7 AND gain <> 0 AND clev > 0.7) k ON k.ch = fr.name GROUP BY user_id, n, out""")


def fold_down(spark, sf):
    """A gain matrix from data (orders to priorities by status), attenuated to at most one for each output."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    m = o.groupBy(F.col("o_orderpriority").alias("coded"), F.col("o_orderstatus").alias("source")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 1e9).alias("gain"))
    return spatial.normalise(m, ["coded"]).select("coded", "source", r6(F.col("gain")).alias("gain"))


add("fold_down_normalise", fold_down, """
WITH m AS (SELECT o_orderpriority AS coded, o_orderstatus AS source, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 1e9 AS gain FROM orders GROUP BY ALL)
SELECT coded, source, round(gain / GREATEST(1.0, SUM(gain) OVER (PARTITION BY coded)), 6) AS gain FROM m""")


def permutations(spark, sf):
    """Which stereo matrices are 0/1 permutations: one non-zero gain, equal to one, in each row and column."""
    m = stereo_matrix(_modes(spark)).where("gain <> 0").withColumns({c: r6(F.col(c)) for c in ("clev", "slev")})
    by = lambda k: m.groupBy("mode", "clev", "slev", k).agg(F.count(F.lit(1)).alias("c"), F.max(F.abs(F.col("gain") - 1)).alias("off")).groupBy("mode", "clev", "slev").agg(F.bool_and((F.col("c") == 1) & (F.col("off") < 1e-9)).alias(f"ok_{k}"), F.count(F.lit(1)).alias(f"n_{k}"))
    return by("out").join(by("ch"), ["mode", "clev", "slev"]).select("mode", "clev", "slev", (F.col("ok_out") & F.col("ok_ch") & (F.col("n_out") == F.col("n_ch"))).alias("is_permutation"))


add("is_permutation", permutations, f"""
WITH {_STEREO}, z AS (SELECT mode, round(clev, 6) AS clev, round(slev, 6) AS slev, ch, out, gain FROM sn WHERE gain <> 0),
o AS (SELECT mode, clev, slev, bool_and(c = 1 AND off < 1e-9) AS ok, COUNT(*) AS k FROM (SELECT mode, clev, slev, out, COUNT(*) AS c, MAX(abs(gain - 1)) AS off FROM z GROUP BY ALL) GROUP BY ALL),
i AS (SELECT mode, clev, slev, bool_and(c = 1 AND off < 1e-9) AS ok, COUNT(*) AS k FROM (SELECT mode, clev, slev, ch, COUNT(*) AS c, MAX(abs(gain - 1)) AS off FROM z GROUP BY ALL) GROUP BY ALL)
SELECT mode, clev, slev, o.ok AND i.ok AND o.k = i.k AS is_permutation FROM o JOIN i USING (mode, clev, slev)""")

RING = [("L", 30.0), ("R", -30.0), ("C", 0.0), ("SL", 110.0), ("SR", -110.0)]
_PAIRS = f"w AS (SELECT name, ((azimuth % 360) + 360) % 360 AS a FROM {dims.values(RING, 'name, azimuth')}), pr AS (SELECT name AS first, a, COALESCE(lead(name) OVER (ORDER BY a), first_value(name) OVER (ORDER BY a)) AS second, COALESCE(lead(a) OVER (ORDER BY a), first_value(a) OVER (ORDER BY a) + 360) AS b FROM w)"
_VBAP = """v AS (SELECT *, cos(radians(a)) * sin(radians(b)) - sin(radians(a)) * cos(radians(b)) AS det FROM p), g AS (SELECT *, GREATEST((cos(radians(u)) * sin(radians(b)) - sin(radians(u)) * cos(radians(b))) / det, 0.0) AS g1, GREATEST((cos(radians(a)) * sin(radians(u)) - sin(radians(a)) * cos(radians(u))) / det, 0.0) AS g2 FROM v)"""
_GAINS = "first, second, round(CASE WHEN b - a >= 180 THEN cos((u - a) / (b - a) * pi() / 2) ELSE g1 / sqrt(g1 * g1 + g2 * g2) END, 6) AS ga, round(CASE WHEN b - a >= 180 THEN sin((u - a) / (b - a) * pi() / 2) ELSE g2 / sqrt(g1 * g1 + g2 * g2) END, 6) AS gb"


def _panned(x, spark):
    return spatial.pan(x, "azimuth", dim(spark, RING, "name string, azimuth double"))


add("pan_ring_vbap", lambda spark, sf: _panned(samples(spark, sf).select("event_id", (F.col("x") / 100.0 - 180).alias("azimuth")), spark).select("event_id", "first", "second", r6(F.col("ga")).alias("ga"), r6(F.col("gb")).alias("gb")), f"""
WITH {S}, {_PAIRS}, q AS (SELECT event_id, (((x / 100.0::DOUBLE - 180) % 360) + 360) % 360 AS z FROM s), p AS (SELECT event_id, first, second, a, b, CASE WHEN z < a THEN z + 360 ELSE z END AS u FROM q, pr WHERE (z >= a AND z < b) OR (z + 360 >= a AND z + 360 < b)), {_VBAP}
SELECT event_id, {_GAINS} FROM g""")


def pan_room(spark, sf):
    """Room position (x to the right, y to the back) to a direction; the centre is the front."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (F.col("c_nationkey") / 25.0).alias("px"), (F.pmod(F.round(F.col("c_acctbal") * 100).cast("bigint"), F.lit(1000)) / 1000.0).alias("py"))
    left, forward = 0.5 - F.col("px"), 0.5 - F.col("py")
    az = F.when((left == 0) & (forward == 0), F.lit(0.0)).otherwise(F.degrees(F.atan2(left, forward)))
    return _panned(c.select("c_custkey", az.alias("azimuth")), spark).select("c_custkey", r6(F.col("azimuth")).alias("azimuth"), "first", "second", r6(F.col("ga")).alias("ga"), r6(F.col("gb")).alias("gb"))


add("pan_room", pan_room, f"""
WITH {_PAIRS}, c AS (SELECT c_custkey, 0.5 - c_nationkey / 25.0::DOUBLE AS l, 0.5 - (((CAST(round(c_acctbal * 100) AS BIGINT) % 1000) + 1000) % 1000) / 1000.0::DOUBLE AS f FROM customer),
az AS (SELECT c_custkey, CASE WHEN l = 0 AND f = 0 THEN 0.0 ELSE degrees(atan2(l, f)) END AS azimuth FROM c), q AS (SELECT *, ((azimuth % 360) + 360) % 360 AS z FROM az),
p AS (SELECT c_custkey, azimuth, first, second, a, b, CASE WHEN z < a THEN z + 360 ELSE z END AS u FROM q, pr WHERE (z >= a AND z < b) OR (z + 360 >= a AND z + 360 < b)), {_VBAP}
SELECT c_custkey, round(azimuth, 6) AS azimuth, {_GAINS} FROM g""")


def gain_ramp(spark, sf):
    """A block's gain ramps from the previous block's; the first block starts at its target."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("g", F.round(F.col("o_totalprice") * 100).cast("bigint") / 1e8)
    x = o.withColumn("prev", F.coalesce(F.lag("g").over(w), F.col("g"))).withColumn("n", F.explode(F.array(*[F.lit(k) for k in (1, 64, 256)])))
    return x.select("o_orderkey", "n", r6(F.col("prev") + (F.col("g") - F.col("prev")) * F.col("n") / 256).alias("gain"))


add("gain_ramp", gain_ramp, """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) / 1e8 AS g FROM orders), p AS (SELECT *, COALESCE(lag(g) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), g) AS prev FROM o)
SELECT o_orderkey, n, round(prev + (g - prev) * n / 256, 6) AS gain FROM p, (VALUES (1), (64), (256)) k(n)""")


def asof(spark, sf):
    """Order value at the instant of each event of the user with the customer's number."""
    day = lambda c: F.floor(epoch_us(c) / 86_400_000_000).cast("bigint")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    frames = o.groupBy((F.col("o_custkey") % 150).alias("key"), (day("o_orderdate") % 365).alias("t")).agg(F.max(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double").alias("v"))
    asked = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 150).alias("key"), (F.pmod(epoch_us("ts") / 3_600_000_000, F.lit(10_000.0)).cast("bigint") % 365).alias("t"), "event_id")
    return spatial.asof_lerp(asked, frames, ["key"], "t", "v").select("event_id", r6(F.col("v")).alias("v"))


add("keyframe_asof_lerp", asof, """
WITH f AS (SELECT o_custkey % 150 AS key, CAST(floor(epoch_us(o_orderdate) / 86400000000) AS BIGINT) % 365 AS t, CAST(MAX(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS v FROM orders GROUP BY ALL),
q AS (SELECT event_id, user_id % 150 AS key, CAST(floor(fmod(epoch_us(ts) / 3600000000, 10000.0)) AS BIGINT) % 365 AS t FROM events),
seg AS (SELECT key, t AS t0, v AS v0, lead(t) OVER w AS t1, lead(v) OVER w AS v1, lag(t) OVER w AS tp FROM f WINDOW w AS (PARTITION BY key ORDER BY t))
SELECT event_id, round(CASE WHEN q.t < t0 THEN v0 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (q.t - t0) / (t1 - t0) END, 6) AS v
FROM q LEFT JOIN seg ON q.key = seg.key AND ((q.t >= t0 AND (t1 IS NULL OR q.t < t1)) OR (tp IS NULL AND q.t < t0))""")

add("orbit_path", lambda spark, sf: samples(spark, sf).select("event_id", r6(0.5 + 0.5 * F.sin(F.col("x") / 1000.0)).alias("px"), r6(0.5 - 0.5 * F.cos(F.col("x") / 1000.0)).alias("py")),
    f"WITH {S} SELECT event_id, round(0.5 + 0.5 * sin(x / 1000.0::DOUBLE), 6) AS px, round(0.5 - 0.5 * cos(x / 1000.0::DOUBLE), 6) AS py FROM s")


def polar(spark, sf):
    """Azimuth (left positive), elevation and distance to the room cube."""
    x = samples(spark, sf).select("event_id", F.radians(F.col("x") % 360 - 180.0).alias("a"), F.radians(F.col("x") % 90 - 0.0).alias("e"), (F.col("x") % 100 / 100.0).alias("d"))
    cx, cy, cz = -F.sin("a") * F.cos("e") * F.col("d"), F.cos("a") * F.cos("e") * F.col("d"), F.sin("e") * F.col("d")
    return x.select("event_id", r6((cx + 1) / 2).alias("rx"), r6((1 - cy) / 2).alias("ry"), r6(cz).alias("rz"))


add("polar_to_room", polar, f"""
WITH {S}, p AS (SELECT event_id, radians(x % 360 - 180.0::DOUBLE) AS a, radians((x % 90)::DOUBLE) AS e, (x % 100) / 100.0::DOUBLE AS d FROM s)
SELECT event_id, round((-sin(a) * cos(e) * d + 1) / 2, 6) AS rx, round((1 - cos(a) * cos(e) * d) / 2, 6) AS ry, round(sin(e) * d, 6) AS rz FROM p""")

MICRO = "CAST(round(v * 1e6) AS BIGINT)"
LONG = f"e AS (SELECT vec_id, label, CAST(unnest(generate_series(0, 63)) AS BIGINT) AS bin, {MICRO.replace('v *', 'CAST(unnest(embedding) AS DOUBLE) *')} AS q FROM embeddings)"


def bins(spark, sf):
    """Spectra as (vec_id, label, bin, q) rows; q in millionths."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("bin", "v"))
    return e.select("vec_id", "label", F.col("bin").cast("bigint").alias("bin"), F.round(F.col("v").cast("double") * 1e6).cast("bigint").alias("q"))


add("band_energy_64", lambda spark, sf: bins(spark, sf).groupBy("vec_id", F.expr("bin div 4").alias("band")).agg(F.sum(F.col("q") * F.col("q")).alias("energy")),
    f"WITH {LONG} SELECT vec_id, bin // 4 AS band, CAST(SUM(q * q) AS BIGINT) AS energy FROM e GROUP BY ALL")

DCT6 = [(k, n, math.cos(math.pi * (2 * n + 1) * k / 12) * (math.sqrt(0.5) if k == 0 else 1.0)) for k in range(6) for n in range(6)]


def dct6(spark, sf):
    """Six-point cosine transform across blocks: vectors of six successive ids are the blocks."""
    m = dim(spark, DCT6, "k int, n int, c double")
    x = bins(spark, sf).select(F.expr("vec_id div 6").alias("grp"), (F.col("vec_id") % 6).cast("int").alias("n"), "bin", "q")
    return x.join(m, "n").groupBy("grp", "bin", "k").agg(F.round(F.sum(F.col("c") * F.col("q")), 3).alias("y"))


add("dct6_matrix_join", dct6, f"WITH {LONG}, m AS {dims.values(DCT6, 'k, n, c')} SELECT vec_id // 6 AS grp, bin, k, round(SUM(c * q), 3) AS y FROM e JOIN m ON m.n = vec_id % 6 GROUP BY ALL")


def quantise(spark, sf):
    """Nearest codeword of a codebook of ten: the vector with the smallest id of each label."""
    b = bins(spark, sf)
    first = b.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    book = F.broadcast(b.join(F.broadcast(first), ["label", "vec_id"]).select(F.col("label").alias("code"), "bin", F.col("q").alias("w")))
    d = b.join(book, "bin").groupBy("vec_id", "code").agg(F.sum((F.col("q") - F.col("w")) * (F.col("q") - F.col("w"))).alias("d"))
    return d.groupBy("vec_id").agg(F.min(F.struct("d", "code")).alias("m")).select("vec_id", F.col("m.code").alias("code"), F.col("m.d").alias("distance"))


add("vector_quantise_knn", quantise, f"""
WITH {LONG}, b AS (SELECT label AS code, bin, q AS w FROM e JOIN (SELECT label, MIN(vec_id) AS vec_id FROM embeddings GROUP BY label) USING (label, vec_id)), d AS (SELECT vec_id, code, CAST(SUM((q - w) * (q - w)) AS BIGINT) AS d FROM e JOIN b USING (bin) GROUP BY ALL)
SELECT vec_id, code, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, code) AS k FROM d) WHERE k = 1""")


def transients(spark, sf):
    """Peak-ratio tree over sub-blocks of 64, 32 and 16 bins against the previous block; the first is suppressed."""
    p3 = bins(spark, sf).groupBy("vec_id", F.expr("bin div 16").alias("k")).agg(F.max(F.abs("q")).alias("p"))
    x = p3.groupBy("vec_id").agg(*[F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"a{k}") for k in range(4)])
    x = x.withColumn("b0", F.greatest("a0", "a1")).withColumn("b1", F.greatest("a2", "a3")).withColumn("c", F.greatest("b0", "b1"))
    w = Window.partitionBy(F.expr("vec_id div 64")).orderBy("vec_id")
    x = x.withColumns({f"l{n}": F.lag(c).over(w) for n, c in ((1, "c"), (2, "b1"), (3, "a3"))})
    # A peak times 0.1, 0.075 or 0.05, by the length it is of, is above the one before.
    hit = (F.col("c") > F.col("l1") * 10) | (F.col("b0") * 3 > F.col("l2") * 40) | (F.col("b1") * 3 > F.col("b0") * 40) | (F.col("a0") > F.col("l3") * 20)
    for k in (1, 2, 3):
        hit = hit | (F.col(f"a{k}") > F.col(f"a{k - 1}") * 20)
    return x.select("vec_id", (F.col("l1").isNotNull() & hit).alias("transient"))


add("transient_tree", transients, f"""
WITH {LONG}, p AS (SELECT vec_id, MAX(CASE WHEN bin // 16 = 0 THEN abs(q) END) AS a0, MAX(CASE WHEN bin // 16 = 1 THEN abs(q) END) AS a1, MAX(CASE WHEN bin // 16 = 2 THEN abs(q) END) AS a2, MAX(CASE WHEN bin // 16 = 3 THEN abs(q) END) AS a3 FROM e GROUP BY vec_id),
b AS (SELECT *, GREATEST(a0, a1) AS b0, GREATEST(a2, a3) AS b1, GREATEST(a0, a1, a2, a3) AS c FROM p),
l AS (SELECT *, lag(c) OVER w AS l1, lag(b1) OVER w AS l2, lag(a3) OVER w AS l3 FROM b WINDOW w AS (PARTITION BY vec_id // 64 ORDER BY vec_id))
SELECT vec_id, l1 IS NOT NULL AND (c > l1 * 10 OR b0 * 3 > l2 * 40 OR b1 * 3 > b0 * 40 OR a0 > l3 * 20 OR a1 > a0 * 20 OR a2 > a1 * 20 OR a3 > a2 * 20) AS transient FROM l""")

add("exponent_change", lambda spark, sf: _exponents(bins(spark, sf)), f"""
WITH {LONG}, x AS (SELECT vec_id, bin, CASE WHEN q = 0 THEN 24 ELSE CAST(LEAST(24, GREATEST(0, 20 - floor(log2(abs(q))))) AS INT) END AS ex FROM e),
d AS (SELECT a.vec_id, SUM(abs(a.ex - b.ex)) AS change FROM x a JOIN x b ON a.bin = b.bin AND a.vec_id = b.vec_id + 1 GROUP BY a.vec_id) SELECT vec_id, CAST(change AS BIGINT) AS change, change > 128 AS resend FROM d""")


def _exponents(b):
    """Exponents by leading zeros; a block sends new ones if they moved by over two a bin from its predecessor's."""
    ex = b.select("vec_id", "bin", F.when(F.col("q") == 0, 24).otherwise(F.least(F.lit(24), F.greatest(F.lit(0), 20 - F.floor(F.log2(F.abs("q"))).cast("int")))).alias("ex"))
    prev = ex.select((F.col("vec_id") + 1).alias("vec_id"), "bin", F.col("ex").alias("before"))
    d = ex.join(prev, ["vec_id", "bin"]).groupBy("vec_id").agg(F.sum(F.abs(F.col("ex") - F.col("before"))).alias("change"))
    return d.select("vec_id", "change", (F.col("change") > 128).alias("resend"))


def islands(spark, sf):
    """Runs of bands with the same sign of change: start, length and value of each run."""
    band = bins(spark, sf).groupBy("vec_id", F.expr("bin div 4").alias("band")).agg(F.signum(F.sum("q")).cast("int").alias("delta"))
    w, v = Window.partitionBy("vec_id").orderBy("band"), Window.partitionBy("vec_id", "delta").orderBy("band")
    return band.withColumn("island", F.row_number().over(w) - F.row_number().over(v)).groupBy("vec_id", "delta", "island").agg(F.min("band").alias("start"), F.count(F.lit(1)).alias("length")).drop("island")


add("delta_islands", islands, f"""
WITH {LONG}, b AS (SELECT vec_id, bin // 4 AS band, CAST(sign(SUM(q)) AS INT) AS delta FROM e GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY band) - row_number() OVER (PARTITION BY vec_id, delta ORDER BY band) AS island FROM b)
SELECT vec_id, delta, MIN(band) AS start, COUNT(*) AS length FROM i GROUP BY vec_id, delta, island""")


def rematrix(spark, sf):
    """Per pair and band: code sum and difference if the smaller of their energies beats the smaller original."""
    x = bins(spark, sf)
    l = x.where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("pair"), "bin", F.col("q").alias("l"))
    r = x.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("pair"), "bin", F.col("q").alias("r"))
    sq = lambda e: F.sum(e * e)
    s = l.join(r, ["pair", "bin"]).groupBy("pair", F.expr("bin div 16").alias("band")).agg(sq(F.col("l")).alias("ll"), sq(F.col("r")).alias("rr"), sq(F.col("l") + F.col("r")).alias("ss"), sq(F.col("l") - F.col("r")).alias("dd"))
    return s.select("pair", "band", (F.least("ss", "dd") < F.least("ll", "rr")).alias("rematrix"))


_LR = f"{LONG}, lr AS (SELECT a.vec_id // 2 AS pair, a.bin, a.q AS l, b.q AS r FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1 AND a.bin = b.bin)"
add("rematrix_decision", rematrix, f"WITH {_LR} SELECT pair, bin // 16 AS band, LEAST(SUM((l + r) * (l + r)), SUM((l - r) * (l - r))) < LEAST(SUM(l * l), SUM(r * r)) AS rematrix FROM lr GROUP BY ALL")


def coupling(spark, sf):
    """Coordinates sqrt(channel energy / energy of the sum) n / 8 of four channels coupled into one."""
    x = bins(spark, sf).select(F.expr("vec_id div 4").alias("block"), (F.col("vec_id") % 4).alias("ch"), "bin", "q")
    total = x.groupBy("block", "bin").agg(F.sum("q").alias("t")).groupBy("block", F.expr("bin div 8").alias("band")).agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
    own = x.groupBy("block", "ch", F.expr("bin div 8").alias("band")).agg(F.sum(F.col("q") * F.col("q")).alias("qq"))
    return own.join(total, ["block", "band"]).select("block", "ch", "band", r6(F.when(F.col("tt") > 0, F.sqrt(F.col("qq") / F.col("tt")) * 4 / 8).otherwise(0.0)).alias("coordinate"))


add("coupling_coordinates", coupling, f"""
WITH {LONG}, t AS (SELECT vec_id // 4 AS block, bin, SUM(q) AS t FROM e GROUP BY ALL), tt AS (SELECT block, bin // 8 AS band, CAST(SUM(t * t) AS DOUBLE) AS tt FROM t GROUP BY ALL), o AS (SELECT vec_id // 4 AS block, vec_id % 4 AS ch, bin // 8 AS band, CAST(SUM(q * q) AS DOUBLE) AS qq FROM e GROUP BY ALL)
SELECT block, ch, band, round(CASE WHEN tt > 0 THEN sqrt(qq / tt) * 4 / 8 ELSE 0.0 END, 6) AS coordinate FROM o JOIN tt USING (block, band)""")


def overlap_add(spark, sf):
    """out[n] = 2 (x[n] + the previous block's second half[n])."""
    e = bins(spark, sf)
    first, second = e.where("bin < 32"), e.where("bin >= 32").select((F.col("vec_id") + 1).alias("vec_id"), (F.col("bin") - 32).alias("bin"), F.col("q").alias("d"))
    return first.join(second, ["vec_id", "bin"], "left").select("vec_id", "bin", (2 * (F.col("q") + F.coalesce("d", F.lit(0)))).cast("bigint").alias("y"))


add("overlap_add", overlap_add, f"WITH {LONG} SELECT a.vec_id, a.bin, CAST(2 * (a.q + COALESCE(b.q, 0)) AS BIGINT) AS y FROM e a LEFT JOIN e b ON b.vec_id = a.vec_id - 1 AND b.bin = a.bin + 32 WHERE a.bin < 32")


def decode_block(spark, sf):
    """The shared channel back to four: shared value times coordinate times eight, on joined bands."""
    c = coupling(spark, sf)
    x = bins(spark, sf).groupBy(F.expr("vec_id div 4").alias("block"), "bin").agg(F.avg("q").alias("shared")).withColumn("band", F.expr("bin div 8"))
    return x.join(c, ["block", "band"]).groupBy("block", "ch").agg(F.round(F.sum(F.abs(F.col("shared") * F.col("coordinate") * 8)), 2).alias("magnitude"))


add("decoupling", decode_block, f"""
WITH {LONG}, t AS (SELECT vec_id // 4 AS block, bin, SUM(q) AS t, AVG(q) AS shared FROM e GROUP BY ALL), tt AS (SELECT block, bin // 8 AS band, CAST(SUM(t * t) AS DOUBLE) AS tt FROM t GROUP BY ALL), o AS (SELECT vec_id // 4 AS block, vec_id % 4 AS ch, bin // 8 AS band, CAST(SUM(q * q) AS DOUBLE) AS qq FROM e GROUP BY ALL),
c AS (SELECT block, ch, band, round(CASE WHEN tt > 0 THEN sqrt(qq / tt) * 4 / 8 ELSE 0.0 END, 6) AS coordinate FROM o JOIN tt USING (block, band))
SELECT block, ch, round(SUM(abs(shared * coordinate * 8)), 2) AS magnitude FROM t JOIN c ON c.block = t.block AND c.band = t.bin // 8 GROUP BY ALL""".replace("SELECT block, ch, round(SUM", "SELECT t.block, ch, round(SUM"))
