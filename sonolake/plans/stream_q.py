"""Queries over files and coded streams: made from the tables, written and read back, against plain SQL over the tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec, kernels
from ..operators import dims
from ..sources import elementary, wav
from .registry import add

RATE = 48000


def _per_row(df, keep: list[str], function, column: str, schema: str):
    """Columns of ``keep`` with what a function of one column's value returns, in Arrow batches of the declared types."""
    names = [f.split(" ", 1)[0] for f in schema.split(", ")]
    x = df.select(*keep, column)
    types = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}[f.split(" ", 1)[1]] for f in schema.split(", ")]
    out = ", ".join([f"{c} {t}" for c, t in x.dtypes[:-1]] + [schema])

    def work(batches):
        for b in batches:
            made = [function(v) for v in b.column(b.num_columns - 1).to_pylist()]
            cols = list(zip(*made)) if made else [[]] * len(names)
            yield pa.record_batch([*b.columns[:-1], *[pa.array(c, t) for c, t in zip(cols, types)]], names=[*keep, *names])

    return x.mapInArrow(work, out)


# Files of 16-bit PCM, a programme for each supplier: written, read back in blocks, measured.
_SAMPLE = "(l_partkey * 37 + l_linenumber * 991) % 65536 - 32768"


def programmes(spark, sf):
    """pcm rows of two channels for each supplier, the second the complement of the first."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("file_id"), "l_orderkey", "l_linenumber", F.expr(_SAMPLE).alias("v"))
    at = F.row_number().over(Window.partitionBy("file_id").orderBy("l_orderkey", "l_linenumber", "v")) - 1
    x = x.withColumn("at", at).withColumn("block", F.expr(f"at div {wav.BLOCK}"))
    x = x.select("file_id", "block", "at", F.explode(F.array(F.struct(F.lit(0).alias("channel"), "v"), F.struct(F.lit(1).alias("channel"), (-F.col("v") - 1).alias("v")))).alias("c"))
    held = F.array_sort(F.collect_list(F.struct("at", (F.col("c.v") / 32768.0).cast("float").alias("x"))))
    g = x.groupBy("file_id", F.col("c.channel").alias("channel"), "block").agg(held.alias("s"))
    return g.select("file_id", F.lit(RATE).alias("sample_rate"), "channel", "block", F.col("s.x").alias("samples"), F.lit(None).cast("string").alias("error"))


def wav_round_trip(spark, sf, bits=16):
    files = wav.write(programmes(spark, sf), bits).withColumnRenamed("file_id", "path")
    s = F.transform("samples", lambda v: (v * 32768).cast("bigint"))
    got = wav.blocks(files).withColumn("s", s)
    return got.select("file_id", "sample_rate", "channel", F.col("block").cast("bigint").alias("block"), F.size("s").cast("bigint").alias("n"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, v: a * 31 % 1000003 + v % 1000003).alias("folded"))


_PCM = f"""
x AS (SELECT CAST(l_suppkey AS VARCHAR) AS file_id, {_SAMPLE} AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, {_SAMPLE}) - 1 AS pos FROM lineitem),
y AS (SELECT file_id, 0 AS channel, pos, v FROM x UNION ALL SELECT file_id, 1, pos, -v - 1 FROM x),
b AS (SELECT file_id, channel, pos // {wav.BLOCK} AS block, list(v ORDER BY pos) AS s FROM y GROUP BY ALL)"""
_WAV = f"""WITH {_PCM}
SELECT file_id, CAST({RATE} AS INT) AS sample_rate, CAST(channel AS INT) AS channel, CAST(block AS BIGINT) AS block, CAST(len(s) AS BIGINT) AS n, CAST(list_sum(s) AS BIGINT) AS total,
 list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(s, lambda v: CAST(v AS BIGINT))), lambda a, v: a * 31 % 1000003 + v % 1000003) AS folded FROM b"""
add("wav_round_trip_pcm16", wav_round_trip, _WAV)
add("wav_round_trip_f32", lambda spark, sf: wav_round_trip(spark, sf, 32), _WAV)


def wav_errors(spark, sf):
    """Files that are none give a row with an error each and fail no task."""
    return wav.blocks(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))).select("file_id", "error")


add("wav_scan_errors", wav_errors, "SELECT CAST(page_id AS VARCHAR) AS file_id, 'not a RIFF/WAVE file' AS error FROM pages WHERE html IS NOT NULL")


# Elementary streams: frames with headers by order, a stream for each customer.
def _ac3_frame(key: int) -> bytes:
    code, size, mode, lfe = key % 3, key * 7 % 20, key % 8, key // 8 % 2
    head = [(0x0B77, 16), (0, 16), (code, 2), (size, 6), (8, 5), (0, 3), (mode, 3)]
    head += [(1, 2)] * (bool(mode & 1 and mode != 1) + bool(mode & 4) + (mode == 2)) + [(lfe, 1)]
    return elementary.put(head).ljust(2 * elementary.frame_words(code, size), b"\0")


def _ec3_frame(key: int) -> bytes:
    blocks, code, mode, lfe, words = key % 4, key // 4 % 3, key % 8, key // 8 % 2, 64 + key % 200
    return elementary.put([(0x0B77, 16), (0, 2), (0, 3), (words - 1, 11), (code, 2), (blocks, 2), (mode, 3), (lfe, 1), (16, 5)]).ljust(2 * words, b"\0")


def _streams(spark, sf, frame, cut):
    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    return _per_row(o, ["path"], lambda keys: (b"".join(map(frame, keys))[: -cut or None],), "keys", "content binary")


def frame_scan(spark, sf, frame, cut=0):
    got = elementary.scan(_streams(spark, sf, frame, cut))
    return got.select("file_id", "frame_idx", "offset", "length", "codec", "bsid", "sample_rate", "mode", "lfe", "channels", "blocks", "error")


_CH = "[" + ", ".join(map(str, elementary.CHANNELS)) + "][mode + 1]"
_O = "o AS (SELECT CAST(o_custkey AS VARCHAR) AS file_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS frame_idx FROM orders)"


def _scan_sql(fields: str, broken: bool = False) -> str:
    rows = """SELECT file_id, frame_idx, CAST(sum(length) OVER (PARTITION BY file_id ORDER BY frame_idx) - length AS BIGINT) AS "offset", CAST(length AS INT) AS length, codec, CAST(bsid AS INT) AS bsid, CAST(rate AS INT) AS sample_rate, CAST(mode AS INT) AS mode, lfe, CAST(channels AS INT) AS channels, CAST(blocks AS INT) AS blocks, CAST(NULL AS VARCHAR) AS error FROM f"""
    if broken:
        last = "frame_idx = max(frame_idx) OVER (PARTITION BY file_id)"
        rows = f"""SELECT file_id, frame_idx, CASE WHEN NOT last THEN "offset" END AS "offset", CASE WHEN NOT last THEN length END AS length, CASE WHEN NOT last THEN codec END AS codec, CASE WHEN NOT last THEN bsid END AS bsid, CASE WHEN NOT last THEN sample_rate END AS sample_rate, CASE WHEN NOT last THEN mode END AS mode, CASE WHEN NOT last THEN lfe END AS lfe, CASE WHEN NOT last THEN channels END AS channels, CASE WHEN NOT last THEN blocks END AS blocks, CASE WHEN last THEN 'truncated frame' END AS error FROM (SELECT *, {last} AS last FROM ({rows}))"""
    return f"WITH {_O}, {fields} {rows}"


_AC3 = f"""h AS (SELECT *, k % 3 AS code, k * 7 % 20 AS size, k % 8 AS mode, k // 8 % 2 = 1 AS lfe, [{', '.join(map(str, dims.BITRATES))}][CAST(k * 7 % 20 // 2 + 1 AS INT)] AS kbps FROM o),
f AS (SELECT *, 2 * CASE code WHEN 0 THEN kbps * 2 WHEN 1 THEN kbps * 96000 // 44100 + size % 2 ELSE kbps * 3 END AS length, 'ac-3' AS codec, 8 AS bsid, [48000, 44100, 32000][CAST(code + 1 AS INT)] AS rate, {_CH} + CAST(lfe AS INT) AS channels, 6 AS blocks FROM h)"""
_EC3 = f"""h AS (SELECT *, k // 4 % 3 AS code, k % 8 AS mode, k // 8 % 2 = 1 AS lfe FROM o),
f AS (SELECT *, 2 * (64 + k % 200) AS length, 'ec-3' AS codec, 16 AS bsid, [48000, 44100, 32000][CAST(code + 1 AS INT)] AS rate, {_CH} + CAST(lfe AS INT) AS channels, [1, 2, 3, 6][CAST(k % 4 + 1 AS INT)] AS blocks FROM h)"""
add("ac3_frame_scan", lambda spark, sf: frame_scan(spark, sf, _ac3_frame), _scan_sql(_AC3))
add("eac3_frame_scan", lambda spark, sf: frame_scan(spark, sf, _ec3_frame), _scan_sql(_EC3))
add("frame_scan_truncated", lambda spark, sf: frame_scan(spark, sf, _ac3_frame, 20), _scan_sql(_AC3, True))

# Exponents of 64 bins for each vector: limited, grouped, decoded, by the three strategies.

def _exponents(values):
    out = []
    for name in codec.SPAN:
        first, groups, decoded = codec.encode_exponents(np.array(values, np.int64), name)
        out += [first, groups, decoded.tolist()]
    return tuple(out)


def exponent_coding(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 1000).cast("bigint") % 25).alias("e"))
    return _per_row(e, ["vec_id"], _exponents, "e", ", ".join(f"first_{n} long, groups_{n} array<bigint>, decoded_{n} array<bigint>" for n in codec.SPAN))


def _exponent_sql(name: str, span: int) -> str:
    n = -(-63 // (3 * span)) * 3
    least = f"CASE WHEN j = 0 THEN LEAST(e[1], 15) ELSE list_min(list_transform(range(CAST((j - 1) * {span} AS BIGINT), CAST(j * {span} AS BIGINT)), lambda b: e[CAST(LEAST(b + 2, 64) AS INT)])) END"
    return f"""SELECT vec_id, list_transform(range({n + 1}), lambda k: list_min(list_transform(range({n + 1}), lambda j: {least} + 2 * abs(k - j)))) AS s_{name} FROM e"""


add("exponent_coding", exponent_coding, "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 1000) AS BIGINT) % 25) AS e FROM embeddings), "
    + ", ".join(f"{n} AS ({_exponent_sql(n, span)})" for n, span in codec.SPAN.items()) + " SELECT vec_id, "
    + ", ".join(f"s_{n}[1] AS first_{n}, list_transform(range(CAST((len(s_{n}) - 1) // 3 AS BIGINT)), lambda g: 25 * (s_{n}[CAST(3 * g + 2 AS INT)] - s_{n}[CAST(3 * g + 1 AS INT)] + 2) + 5 * (s_{n}[CAST(3 * g + 3 AS INT)] - s_{n}[CAST(3 * g + 2 AS INT)] + 2) + s_{n}[CAST(3 * g + 4 AS INT)] - s_{n}[CAST(3 * g + 3 AS INT)] + 2) AS groups_{n}, list_transform(range(64), lambda i: s_{n}[CAST(CASE WHEN i = 0 THEN 1 ELSE (i - 1) // {span} + 2 END AS INT)]) AS decoded_{n}" for n, span in codec.SPAN.items()) + " FROM " + " JOIN ".join(f"{n}{'' if i == 0 else ' USING (vec_id)'}" for i, n in enumerate(codec.SPAN)))

# Mantissas: a vector's components by allocation code 1 to 15 in turn; groups of the codes that share a word.
def _mantissas(values):
    x = np.clip(np.array(values, np.float64) * 2, -1, 0.999)
    q, back, words = [], [], []
    for code in range(1, 16):
        part = codec.quantise_mantissa(x[code - 1 :: 15], code)
        q += part.tolist()
        back += (codec.dequantise_mantissa(part, code) + 0.0).tolist()
        if code in (1, 2, 4):
            made = codec.group_mantissas(part.tolist(), code)
            assert codec.ungroup_mantissas(made, code, len(part)) == part.tolist()
            words += made
    return q, back, words


def mantissa_coding(spark, sf):
    return _per_row(spark.read.parquet(f"{sf}/embeddings.parquet"), ["vec_id"], _mantissas, "embedding", "codes array<bigint>, mantissas array<double>, words array<bigint>")


_LEVEL = "CASE " + " ".join(f"WHEN c = {c} THEN {n}" for c, n in codec.LEVELS.items()) + " ELSE 0 END"
_HALF = "CASE " + " ".join(f"WHEN c = {c} THEN {1 << (b - 1)}" for c, b in codec.BITS.items()) + " ELSE 0 END"
add("mantissa_coding", mantissa_coding, f"""
WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings),
x AS (SELECT vec_id, i // 15 AS r, i % 15 + 1 AS c, LEAST(GREATEST(CAST(v AS DOUBLE) * 2, -1.0), CAST(0.999 AS DOUBLE)) AS x FROM v),
l AS (SELECT *, {_LEVEL} AS n, {_HALF} AS h FROM x),
q AS (SELECT *, CAST(CASE WHEN n > 0 THEN LEAST(floor((x + 1) / 2 * n), n - 1) ELSE LEAST(GREATEST(floor(x * h + 0.5), -h), h - 1) END AS BIGINT) AS q FROM l),
m AS (SELECT vec_id, list(q ORDER BY c, r) AS codes, list(CASE WHEN n > 0 THEN CAST(2 * q - (n - 1) AS DOUBLE) / n ELSE CAST(q AS DOUBLE) / h END ORDER BY c, r) AS mantissas FROM q GROUP BY vec_id),
g AS (SELECT vec_id, c, r // CASE WHEN c = 4 THEN 2 ELSE 3 END AS w, CAST(sum(q * CAST(pow(n, CASE WHEN c = 4 THEN 1 - r % 2 ELSE 2 - r % 3 END) AS BIGINT)) AS BIGINT) AS word FROM q WHERE c IN (1, 2, 4) GROUP BY ALL),
ws AS (SELECT vec_id, list(word ORDER BY c, w) AS words FROM g GROUP BY vec_id)
SELECT vec_id, codes, mantissas, words FROM m JOIN ws USING (vec_id)""")


# Variable-length numbers in groups of four bits.
def _variable(value):
    fields = codec.variable_bits(value, 4)
    data = elementary.Bits(elementary.put(fields))
    return len(fields) // 2, "".join(f"{v:0{n}b}" for v, n in fields), codec.read_variable_bits(data.read, 4)


add("variable_length_numbers", lambda spark, sf: _per_row(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.expr("o_orderkey * 13 % 70000").alias("k")), ["o_orderkey"], _variable, "k", "n_groups int, coded string, decoded long"), """
WITH v AS (SELECT o_orderkey, o_orderkey * 13 % 70000 AS k FROM orders),
g AS (SELECT *, CASE WHEN k < 16 THEN 1 WHEN k < 16 + 256 THEN 2 WHEN k < 16 + 256 + 4096 THEN 3 WHEN k < 16 + 256 + 4096 + 65536 THEN 4 ELSE 5 END AS n, k - CASE WHEN k < 16 THEN 0 WHEN k < 16 + 256 THEN 16 WHEN k < 16 + 256 + 4096 THEN 16 + 256 WHEN k < 16 + 256 + 4096 + 65536 THEN 16 + 256 + 4096 ELSE 16 + 256 + 4096 + 65536 END AS rest FROM v)
SELECT o_orderkey, CAST(n AS INT) AS n_groups, list_reduce(list_transform(range(n), lambda i: lpad(bin((rest >> CAST(4 * (n - 1 - i) AS BIGINT)) & 15), 4, '0') || CASE WHEN i < n - 1 THEN '1' ELSE '0' END), lambda a, b: a || b) AS coded, k AS decoded FROM g""")

# Tags of texts under a key, and what verifying says of them, of broken ones, and without a key.
KEY = b"a key of a test"


def _tags(url):
    data = (url or "").encode()
    t = codec.tag(KEY, data)
    return t.hex(), codec.verify(KEY, data, t), codec.verify(KEY, data + b"x", t), codec.verify(None, data, t), codec.verify(KEY, data, None)


def _pad(byte: int) -> str:
    return "'" + "".join(f"\\x{b ^ byte:02X}" for b in KEY.ljust(64, b"\0")) + "'::BLOB"


add("frame_tags", lambda spark, sf: _per_row(spark.read.parquet(f"{sf}/pages.parquet"), ["page_id"], _tags, "url", "tag string, own string, broken string, keyless string, untagged string"),
    f"SELECT page_id, sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(COALESCE(url, ''))))) AS tag, 'valid' AS own, 'invalid' AS broken, 'no key' AS keyless, 'unsigned' AS untagged FROM pages")

# Codes sent as differences modulo their alphabet.
def _deltas(values):
    codes = np.floor((np.array(values, np.float64) + 1) * 48).astype(np.int64) % 96
    d = codec.delta_codes(codes, 96)
    return d.tolist(), codec.undelta_codes(d, 96).tolist()


add("delta_coding", lambda spark, sf: _per_row(spark.read.parquet(f"{sf}/embeddings.parquet"), ["vec_id"], _deltas, "embedding", "deltas array<bigint>, codes array<bigint>"), """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor((CAST(v AS DOUBLE) + 1) * 48) AS BIGINT) % 96) AS codes FROM embeddings)
SELECT vec_id, list_transform(range(len(codes)), lambda i: (codes[CAST(i + 1 AS INT)] - CASE WHEN i = 0 THEN 48 ELSE codes[CAST(GREATEST(i, 1) AS INT)] END + 96) % 96) AS deltas, codes FROM c""")


# Lapped transform of each vector as a block of 64 windowed samples, and its inverse.  Sums are no negative zero; what
# rounds to zero keeps its sign, as in SQL.
def _transform(values):
    rise = kernels.kbd_window(32)
    y = kernels.mdct(np.array(values, np.float64) * np.concatenate([rise, rise[::-1]]))
    return np.round(y + 0.0, 6).tolist(), np.round(kernels.imdct(y) + 0.0, 6).tolist()


_KBD = ", ".join(f"CAST({v!r} AS DOUBLE)" for v in [*kernels.kbd_window(32).tolist(), *kernels.kbd_window(32)[::-1].tolist()])
_ANGLE = "cos(pi() / 32 * (i + 0.5::DOUBLE + 16) * (k + 0.5::DOUBLE))"
add("lapped_transform", lambda spark, sf: _per_row(spark.read.parquet(f"{sf}/embeddings.parquet"), ["vec_id"], _transform, "embedding", "coefficients array<double>, aliased array<double>"), f"""
WITH w AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v, unnest([{_KBD}]) AS w FROM embeddings WHERE len(embedding) = 64),
m AS (SELECT i.range AS i, k.range AS k, {_ANGLE.replace('(i ', '(i.range ').replace('(k ', '(k.range ')} AS c FROM range(64) i, range(32) k),
y AS (SELECT vec_id, k, sum(CAST(v AS DOUBLE) * w * c) AS y FROM w JOIN m USING (i) GROUP BY vec_id, k),
a AS (SELECT vec_id, i, sum(y * c) AS x FROM y JOIN m USING (k) GROUP BY vec_id, i),
ys AS (SELECT vec_id, list(round(y, 6) ORDER BY k) AS coefficients FROM y GROUP BY vec_id), xs AS (SELECT vec_id, list(round(x, 6) ORDER BY i) AS aliased FROM a GROUP BY vec_id)
SELECT vec_id, coefficients, aliased FROM ys JOIN xs USING (vec_id)""")
