"""Small helpers shared by relational operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BLOCK_ROWS = 1 << 19


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def decibels(power: Column) -> Column:
    """10 log10 of a power; null where it is not positive."""
    return F.when(power > 0, 10 * F.log10(power))


def r6(x: Column) -> Column:
    return F.round(x, 6)


def dim(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension table of fixed values, to be broadcast: its size is that of the list."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def held(df: DataFrame) -> DataFrame:
    """A table computed once, its lineage cut, in the checkpoint folder: the one on the context, or spark.checkpoint.dir.

    Where neither is set, a local master gets a temporary folder; a cluster must name one that all share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sonolake-"))
    return df.checkpoint()


def blocks_of(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> int:
    """How many blocks of about ``block_rows`` a table makes."""
    return max(1, -(-rows.count() // block_rows))


def dealt(rows: DataFrame, blocks: int, *keys: str) -> DataFrame:
    """Rows dealt by keys over tasks in proportion to the blocks, so that a task's share does not grow with the table."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, blocks), *keys)
