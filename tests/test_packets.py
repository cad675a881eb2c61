"""Numbering of frames in blocks: the same for any blocks, and no task holds a whole programme."""

import random

from pyspark.sql import functions as F
from sonolake.operators import packets

SCHEMA = "prog long, k long, line int, size long"


def test_numbers_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.choice((0, 0, 0, 1, 2, None)), rng.choice((None, 3, 2**40, rng.randrange(-500, 500), rng.randrange(10**12))), rng.randrange(1, 4), rng.choice((None, 0, 184, 185, 900))) for _ in range(600)]
    last = lambda v: (v is None, v or 0)
    want, at, sent = [], {}, {}
    for p, k, line, size in sorted(rows, key=lambda r: [last(v) for v in r]):
        want.append((p, k, line, size, at.get(p, 0), sent.get(p, 0)))
        at[p], sent[p] = at.get(p, 0) + 1, sent.get(p, 0) + -(-(size or 0) // 184)
    df = spark.createDataFrame(rows, SCHEMA)
    for block_rows in (5, 100, 10_000):
        got = packets.numbered(df, ["prog"], ["k", "line", "size"], "i", {"sent": packets.packets_of(F.col("size"))}, block_rows)
        assert sorted(map(str, map(tuple, got.drop("block").collect()))) == sorted(map(str, want))


def test_no_task_holds_a_whole_programme(spark):
    df = spark.range(20_000).select(F.lit(7).cast("long").alias("prog"), F.col("id").alias("k"), F.lit(1).alias("line"), F.lit(300).cast("long").alias("size"))
    got = packets.numbered(df, ["prog"], ["k", "line", "size"], "i", {"sent": packets.packets_of(F.col("size"))}, 500)
    plan = packets.transport(got, "i", "size", "sent", 1536, 48000)
    sizes = [r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 10_000
    assert plan.where("continuity <> (2 * k + part) % 16 OR i <> k").count() == 0


def test_an_empty_frame_has_no_packet(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 185, 0), (1, 10, 2)], "i long, size long, sent long")
    assert sorted((r["i"], r["size"], r["part"], r["stuffing"]) for r in packets.transport(df, "i", "size", "sent", 1536, 48000).collect()) == [(0, 185, 0, 0), (0, 185, 1, 183), (1, 10, 0, 174)]
