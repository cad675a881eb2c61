"""Bit allocation of each vector as a block of exponents, against a recursive query over bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import allocation as al
from .registry import add

#: Two models a query runs: the usual codes, and the ends of the tables at 32 kHz.
MODELS = {"usual": al.Model(), "ends": al.Model(2, 15, 15, 0, 3, 3, 0, 4, 7)}


def _rows(values, function):
    """What a function of a matrix gives for each row, rows of a length at a time; null for null and empty ones."""
    lengths = np.array([len(v or ()) for v in values], np.int64)
    out = [None] * len(values)
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        for i, r in zip(at, function(np.array([values[i] for i in at], np.int64))):
            out[i] = r.tolist()
    return pa.array(out, pa.list_(pa.int64()))


def _allocate(batches):
    for b in batches:
        e = b.column(1).to_pylist()
        bands = _rows(e, lambda m: al.band_power(3072 - 128 * m, 0)[:, : al.BAND_OF[m.shape[1] - 1] + 1])
        codes = [_rows(e, lambda m, model=model: al.allocate(m, model)) for model in MODELS.values()]
        yield pa.record_batch([b.column(0), bands, *codes], names=["vec_id", "bands", *MODELS])


def bit_allocation(spark, sf):
    """Band powers and allocation codes of exponents 0 to 24 made from each vector."""
    e = F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 1000).cast("bigint") % 25)
    x = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("e"))
    return x.mapInArrow(_allocate, "vec_id bigint, bands array<bigint>, usual array<bigint>, ends array<bigint>")


def _list(values) -> str:
    return "[" + ", ".join(f"CAST({int(v)} AS BIGINT)" for v in values) + "]"


def _masks(name: str, m: al.Model) -> str:
    """Excitation band by band, then levels and codes, as common table expressions."""
    fast, slow = al.fast_gain(m.fast_gain), al.SLOW_GAIN[m.slow_gain]
    near, far = f"n.p - {fast}", f"n.p - {slow}"
    low = "CASE WHEN n.b >= 22 THEN 0 WHEN n.b >= 20 THEN GREATEST(r.low - 128, 0) WHEN n.p + 256 = n.nx THEN CASE WHEN n.b < 7 THEN 384 ELSE 320 END WHEN n.p > n.nx THEN GREATEST(r.low - 64, 0) ELSE r.low END"
    return f"""r_{name} AS (
 SELECT vec_id, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS low, CAST(0 AS BIGINT) AS quick, CAST(0 AS BIGINT) AS slow, FALSE AS rose, CAST(0 AS BIGINT) AS ex FROM (SELECT DISTINCT vec_id FROM n)
 UNION ALL
 SELECT vec_id, b, CAST(low AS BIGINT), CAST(quick AS BIGINT), CAST(slow AS BIGINT), rose OR (b >= 2 AND p <= nx), CAST(CASE WHEN rose THEN GREATEST(quick - low, slow) ELSE quick - low END AS BIGINT) FROM (
  SELECT n.vec_id, n.b, n.p, n.nx, {low} AS low, r.rose OR n.b >= 7 AS rose,
   CASE WHEN r.rose OR n.b >= 7 THEN GREATEST(r.quick - {al.FAST_DECAY[m.fast_decay]}, {near}) ELSE {near} END AS quick,
   CASE WHEN r.rose OR n.b >= 7 THEN GREATEST(r.slow - {al.SLOW_DECAY[m.slow_decay]}, {far}) ELSE {far} END AS slow
  FROM r_{name} r JOIN n ON n.vec_id = r.vec_id AND n.b = r.b + 1)),
l_{name} AS (SELECT vec_id, b, (GREATEST(GREATEST(ex + GREATEST({al.KNEE[m.knee]} - p, 0) // 4, {_list(al.HEARING[m.rate])}[CAST(b + 1 AS INT)]) - {m.offset} - ({al.FLOOR[m.floor]}), 0) & {0x1FE0}) + ({al.FLOOR[m.floor]}) AS level FROM r_{name} JOIN n USING (vec_id, b)),
c_{name} AS (SELECT vec_id, list({_list(al.CODES)}[CAST(LEAST(GREATEST(psd - level, 0) // 32, 63) + 1 AS INT)] ORDER BY i) AS {name} FROM z JOIN l_{name} USING (vec_id, b) GROUP BY vec_id)"""


_SUM = f"GREATEST(a, v) + {_list([*al.SUM_OVER, *[0] * (256 - len(al.SUM_OVER))])}[CAST(LEAST(abs(a - v) // 2, 255) + 1 AS INT)]"
add("bit_allocation", bit_allocation, f"""
WITH RECURSIVE x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings),
z AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, i, {_list(al.BAND_OF)}[CAST(i + 1 AS INT)] AS b, 3072 - 128 * (CAST(floor(abs(CAST(v AS DOUBLE)) * 1000) AS BIGINT) % 25) AS psd FROM x),
g AS (SELECT vec_id, b, list_reduce(list(psd ORDER BY i), lambda a, v: {_SUM}) AS p FROM z GROUP BY vec_id, b),
n AS (SELECT vec_id, b, p, COALESCE(lead(p) OVER (PARTITION BY vec_id ORDER BY b), 0) AS nx FROM g),
{', '.join(_masks(*m) for m in MODELS.items())},
bs AS (SELECT vec_id, list(p ORDER BY b) AS bands FROM g GROUP BY vec_id)
SELECT CAST(e.vec_id AS BIGINT) AS vec_id, bands, {', '.join(MODELS)} FROM embeddings e LEFT JOIN bs ON bs.vec_id = e.vec_id {' '.join(f'LEFT JOIN c_{m} ON c_{m}.vec_id = e.vec_id' for m in MODELS)}""")
