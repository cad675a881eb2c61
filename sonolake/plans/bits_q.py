"""Queries over bytes, bit fields, legal values and option grammars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..operators import dims
from ..operators.base import dim
from .registry import add


def urls(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("url").cast("binary").alias("raw")).withColumn("b", bits.byte_array(F.col("raw")))


_BYTES = "u AS (SELECT page_id, url, list_transform(generate_series(1, length(hex(encode(url))) // 2), lambda i: CAST(('0x' || substr(hex(encode(url)), 2 * i - 1, 2)) AS BIGINT)) AS b FROM pages)"


def _crc_sql(poly: int, width: int, init: int) -> str:
    t = ", ".join(map(str, bits.crc_table(poly, width)))
    return f"list_reduce(list_prepend(CAST({init} AS BIGINT), b), lambda c, x: xor((c << 8) & {(1 << width) - 1}, CAST([{t}][xor(c >> {width - 8}, x) % 256 + 1] AS BIGINT)))"


add("crc16_bytes", lambda spark, sf: urls(spark, sf).select("page_id", bits.crc(F.col("b"), 0x8005, 16, 0).alias("crc")), f"WITH {_BYTES} SELECT page_id, {_crc_sql(0x8005, 16, 0)} AS crc FROM u")
add("crc32_mpeg2", lambda spark, sf: urls(spark, sf).select("page_id", bits.crc(F.col("b"), 0x04C11DB7, 32, 0xFFFFFFFF).alias("crc")), f"WITH {_BYTES} SELECT page_id, {_crc_sql(0x04C11DB7, 32, 0xFFFFFFFF)} AS crc FROM u")

FIELDS = [("sync", 0, 16), ("rate", 40, 2), ("size", 42, 6), ("bsid", 45, 5), ("mode", 61, 3), ("wide", 3, 29)]
add("bit_fields", lambda spark, sf: urls(spark, sf).select("page_id", *[bits.field(F.col("b"), at, n).alias(name) for name, at, n in FIELDS]),
    f"WITH {_BYTES}, w AS (SELECT page_id, list_reduce(list_prepend('', list_transform(b, lambda x: lpad(bin(x), 8, '0'))), lambda s, x: s || x) AS s FROM u) SELECT page_id, "
    + ", ".join(f"list_reduce(list_prepend(0::BIGINT, list_transform(generate_series({at + 1}, {at + n}), lambda i: CAST(substr(s, i, 1) AS BIGINT))), lambda a, x: a * 2 + x) AS {name}" for name, at, n in FIELDS) + " FROM w")


def syncs(spark, sf, word="74 68 "):
    """Number and first byte offset of a two-byte sync word in each text."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.regexp_replace(F.hex(F.col("text").cast("binary")), "(..)", "$1 ").alias("s"))
    return d.select("doc_id", ((F.length("s") - F.length(F.replace("s", F.lit(word), F.lit("")))) / 6).cast("bigint").alias("n_syncs"), F.when(F.instr("s", word) > 0, F.floor((F.instr("s", word) - 1) / 3).cast("bigint")).alias("first_offset"))


add("sync_search", syncs, """
WITH d AS (SELECT doc_id, regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g') AS s FROM documents)
SELECT doc_id, CAST((length(s) - length(replace(s, '74 68 ', ''))) / 6 AS BIGINT) AS n_syncs, CASE WHEN instr(s, '74 68 ') > 0 THEN (instr(s, '74 68 ') - 1) // 3 END AS first_offset FROM d""")

RATES = dims.values([(r,) for r in dims.BITRATES], "kbps")


def frame_sizes(spark, sf):
    """Words of a frame by rate code: 1536 samples at 48 and 32 kHz; at 44.1 kHz a padded frame has one more."""
    r = spark.createDataFrame([(r,) for r in dims.BITRATES], "kbps bigint")
    low = F.expr("kbps * 96000 div 44100")
    return r.select("kbps", (F.col("kbps") * 2).alias("w48"), low.alias("w441"), (low + 1).alias("w441_padded"), (F.col("kbps") * 3).alias("w32"), F.expr("kbps * 2 div 2 + kbps * 2 div 8").alias("w58"))


add("frame_size_lookup", frame_sizes, f"SELECT CAST(kbps AS BIGINT) AS kbps, CAST(kbps * 2 AS BIGINT) AS w48, CAST(kbps * 96000 // 44100 AS BIGINT) AS w441, CAST(kbps * 96000 // 44100 + 1 AS BIGINT) AS w441_padded, CAST(kbps * 3 AS BIGINT) AS w32, CAST((kbps * 2) // 2 + (kbps * 2) // 8 AS BIGINT) AS w58 FROM {RATES}")


def clamp_rates(spark, sf):
    """The largest legal rate not above each request, the smallest rate below all."""
    legal = F.array(*map(F.lit, dims.BITRATES))
    q = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.round("p_retailprice").cast("int").alias("asked"))
    return q.select("p_partkey", F.coalesce(F.array_max(F.filter(legal, lambda r: r <= F.col("asked"))), F.lit(dims.BITRATES[0])).alias("kbps"), F.coalesce(F.nullif(F.array_position(legal, F.col("asked")), F.lit(0)) - 1, F.lit(-1).cast("bigint")).alias("code"))


add("legal_bitrate_clamp", clamp_rates, f"""
WITH r AS {RATES}, q AS (SELECT p_partkey, CAST(round(p_retailprice) AS INT) AS asked FROM part)
SELECT p_partkey, CAST(COALESCE((SELECT MAX(kbps) FROM r WHERE kbps <= asked), 32) AS INT) AS kbps, CAST(COALESCE((SELECT COUNT(*) FROM r WHERE kbps < asked AND EXISTS (SELECT 1 FROM r r2 WHERE r2.kbps = asked)) + CASE WHEN EXISTS (SELECT 1 FROM r WHERE kbps = asked) THEN 0 ELSE NULL END, -1) AS BIGINT) AS code FROM q""")


def layouts(spark, sf):
    """Channels of a location map: a pair bit is two; the list of named locations in order."""
    m = spark.range(65536).select(F.col("id").cast("int").alias("map"))
    names = F.array(*map(F.lit, dims.LOCATIONS))
    on = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda k: F.col("map").bitwiseAND(F.call_function("shiftright", F.lit(32768), k)) != 0)
    return m.select("map", (F.bit_count("map") + F.bit_count(F.col("map").bitwiseAND(F.lit(dims.PAIRS)))).alias("channels"), F.array_join(F.transform(on, lambda k: F.get(names, k)), ",").alias("names"))


_NAMES = "[" + ", ".join(f"'{n}'" for n in dims.LOCATIONS) + "]"
add("popcount_layout", layouts, f"SELECT CAST(range AS INT) AS map, CAST(bit_count(CAST(range AS INT)) + bit_count(CAST(range AS INT) & {dims.PAIRS}) AS INT) AS channels, array_to_string(list_transform(list_filter(generate_series(0, 15), lambda k: (range & (32768 >> k)) <> 0), lambda k: {_NAMES}[k + 1]), ',') AS names FROM range(65536)")

add("sha256", lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("digest")), "SELECT doc_id, sha256(text) AS digest FROM documents")


def options(spark, sf):
    """key=value tokens (here of the JSON that events carry) to typed columns; a bad value is null."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    flat = F.regexp_replace("props", '[{}" ]', "")
    m = F.str_to_map(flat, F.lit(","), F.lit(":"))
    return e.select("event_id", F.try_element_at(m, F.lit("k")).try_cast("int").alias("k"), F.cardinality(m).alias("n_options"))


add("option_parse", options, "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(len(json_keys(props)) AS INT) AS n_options FROM events")


def destinations(spark, sf):
    """'name@-3.5' tokens to (name, trim) with trims snapped to a tenth of a dB; no trim is 0.

    As in SQL, two places are of the binary value, an exact half to the even one; what rounds to zero keeps its sign.
    """
    n = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("token", F.concat(F.substring("s_name", 1, 8), F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("@"), F.call_function("format_number", F.col("s_acctbal") / 1000, F.lit("0.00"))))))
    trim = F.regexp_extract("token", "@([-+]?[0-9.]+)$", 1)
    d = trim.try_cast("double")
    return n.select("s_suppkey", F.regexp_extract("token", "^([^@]+)", 1).alias("name"), F.when(trim == "", 0.0).otherwise(F.signum(d) * F.floor(F.abs(d) * 10 + 0.5) / 10).alias("trim_db"))


add("destination_parse", destinations, """
WITH t AS (SELECT s_suppkey, substr(s_name, 1, 8) || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '@' || printf('%.2f', s_acctbal / 1000) END AS token FROM supplier)
SELECT s_suppkey, split_part(token, '@', 1) AS name, CASE WHEN instr(token, '@') = 0 THEN 0.0::DOUBLE ELSE round(CAST(split_part(token, '@', 2) AS DOUBLE), 1) END AS trim_db FROM t""")


def plan_errors(spark, sf):
    """First failing rule of each plan: rate, then channels, then layout of the mode."""
    o = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 8).alias("mode"), F.col("l_quantity").cast("int").alias("channels"), (F.col("l_suppkey") % 700).cast("int").alias("kbps"))
    err = F.when(~F.col("kbps").isin(*dims.BITRATES), "rate").when(F.col("channels") > 6, "channels").when((F.col("mode") == 0) & (F.col("channels") != 2), "dual mono")
    return o.withColumn("error", F.coalesce(err, F.lit("none"))).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


add("plan_validate", plan_errors, f"""
WITH o AS (SELECT l_partkey % 8 AS mode, CAST(l_quantity AS INT) AS channels, l_suppkey % 700 AS kbps FROM lineitem)
SELECT CASE WHEN kbps NOT IN (SELECT kbps FROM {RATES}) THEN 'rate' WHEN channels > 6 THEN 'channels' WHEN mode = 0 AND channels <> 2 THEN 'dual mono' ELSE 'none' END AS error, COUNT(*) AS n FROM o GROUP BY ALL""")


def varints(spark, sf):
    """Bytes of a variable-length integer of 7-bit groups, most significant first, a set top bit for more."""
    v = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("v"))
    n = F.when(F.col("v") < 1 << 7, 1).when(F.col("v") < 1 << 14, 2).when(F.col("v") < 1 << 21, 3).when(F.col("v") < 1 << 28, 4).otherwise(5)
    groups = F.transform(F.reverse(F.sequence(F.lit(0), n - 1)), lambda k: F.call_function("shiftright", F.col("v"), k * 7).bitwiseAND(F.lit(127)) + F.when(k > 0, 128).otherwise(0))
    return v.select("o_orderkey", n.alias("n_bytes"), F.array_join(F.transform(groups, lambda b: F.lpad(F.hex(b), 2, "0")), "").alias("code"))


add("varint_encode", varints, """
WITH v AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders), n AS (SELECT *, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END AS n FROM v)
SELECT o_orderkey, CAST(n AS INT) AS n_bytes, array_to_string(list_transform(list_reverse(generate_series(0, n - 1)), lambda k: lpad(upper(hex(((v >> (7 * k)) & 127) + CASE WHEN k > 0 THEN 128 ELSE 0 END)), 2, '0')), '') AS code FROM n""")


def mantissa_bits(spark, sf):
    """Bits of a block's mantissas by allocation code: codes 1, 2 and 4 travel in groups of 3, 3 and 2."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.expr("l_orderkey div 4").alias("block"), F.col("l_quantity").cast("int").alias("q")).withColumn("bap", F.col("q") % 16)
    c = x.groupBy("block", "bap").agg(F.count(F.lit(1)).alias("n"))
    bits_ = F.when(F.col("bap") == 0, 0).when(F.col("bap") == 1, F.ceil(F.col("n") / 3) * 5).when(F.col("bap") == 2, F.ceil(F.col("n") / 3) * 7).when(F.col("bap") == 3, F.col("n") * 3).when(F.col("bap") == 4, F.ceil(F.col("n") / 2) * 7).when(F.col("bap") == 5, F.col("n") * 4).when(F.col("bap") == 15, F.col("n") * 16).when(F.col("bap") == 14, F.col("n") * 14).otherwise(F.col("n") * (F.col("bap") - 1))
    return c.groupBy("block").agg(F.sum(bits_).cast("bigint").alias("bits"))


add("mantissa_bits", mantissa_bits, """
WITH c AS (SELECT l_orderkey // 4 AS block, CAST(l_quantity AS INT) % 16 AS bap, COUNT(*) AS n FROM lineitem GROUP BY ALL)
SELECT block, CAST(SUM(CASE bap WHEN 0 THEN 0 WHEN 1 THEN ceil(n / 3) * 5 WHEN 2 THEN ceil(n / 3) * 7 WHEN 3 THEN n * 3 WHEN 4 THEN ceil(n / 2) * 7 WHEN 5 THEN n * 4 WHEN 15 THEN n * 16 WHEN 14 THEN n * 14 ELSE n * (bap - 1) END) AS BIGINT) AS bits FROM c GROUP BY block""")
