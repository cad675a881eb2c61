"""Shared pieces: staged tables, chunking, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Where neither is set, a local master gets a temporary folder; a cluster has no folder that all would see, and must
    name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sonolake-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _cleaning = threading.Lock(), {"writes": 0, "before": None}


@contextmanager
def _shuffle_cleanup(spark: SparkSession):
    """Shuffle files go when a write ends; the setting returns to what it was when the last of concurrent writes does."""
    with _lock:
        if not _cleaning["writes"]:
            _cleaning["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _cleaning["writes"] += 1
    try:
        yield
    finally:
        with _lock:
            _cleaning["writes"] -= 1
            if not _cleaning["writes"]:
                if _cleaning["before"] is None:
                    spark.conf.unset(CLEANUP)
                else:
                    spark.conf.set(CLEANUP, _cleaning["before"])


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, done: tuple | list = ()) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go when it ends, as the table stands in their place.  ``done`` are staged tables that
    nothing reads after this one is written; they are deleted.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with _shuffle_cleanup(spark):
        df.write.parquet(path)
    for old in done:
        delete(spark, old.staged_at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(docs: DataFrame, *columns: str) -> int:
    """Bytes of text columns, counted over all rows."""
    total = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0))
    return int(docs.agg(F.coalesce(F.sum(total.cast("long") + 1), F.lit(0))).first()[0])


def chunk_count(total_bytes: int, chunk_bytes: float) -> int:
    """How many chunks of about ``chunk_bytes`` so many bytes of text make; four at least."""
    return int(max(4, -(-total_bytes // int(chunk_bytes))))


def tasks_for(chunks: int, each: int = 4) -> int:
    """Partitions over which chunks are dealt, so that a task's share does not grow with the table."""
    return max(4, -(-chunks // each))


class Ids(dict):
    """Numbers keys in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def number_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of each word, words of each text, distinct words as they are met) of binary texts, lower-cased in A-Z.

    Words are cut at bytes 0x20 and 0x09 to 0x0D; a null text has none.
    """
    texts = texts.cast(pa.binary())
    as_text = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), texts.null_count, texts.offset)
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(as_text, "")))
    flat = parts.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False) if len(flat) else np.empty(0, bool)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = flat.filter(pa.array(real)).dictionary_encode()
    _, at, data = coded.dictionary.buffers()
    at = np.frombuffer(at, np.int32)[coded.dictionary.offset :][: len(coded.dictionary) + 1].tolist() if len(coded.dictionary) else [0]
    data = data.to_pybytes() if data is not None else b""
    words = [data[a:b] for a, b in zip(at, at[1:])]
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(of[real], minlength=len(texts)), words


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending uint64 numbers as byte planes of their differences, which compress well."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes as byte planes."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunked(docs: DataFrame, chunks: int, *columns) -> DataFrame:
    """(chunk, *columns): rows dealt into chunks by a hash of id and text."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), *columns)


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of an edge list: every node but a component's smallest, with that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = lo != hi
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(root, hi[open_], lo[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _forest(batches):
    """Spanning stars of each partition's edges, gathered a bounded number of edges at a time."""
    held: list = []
    total = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        total += batch.num_rows
        if total > 2_000_000:
            u, v = union_find(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            if len(u) > 1_000_000:
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
                held, total = [], 0
            else:
                held, total = [(u, v)], len(u)
    if total:
        u, v = union_find(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def connected_components(edges: DataFrame, salts: int = 32) -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest node reachable.

    Each partition first replaces its edges by spanning stars; alternating large-star and small-star
    rounds then join them, each round a table in the shared folder.  A hub's rows are dealt over
    ``salts`` partitions.  Null ends and loops are ignored; an empty list gives an empty table.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = stage(e.mapInArrow(_forest, "u long, v long"), "forest")
    salted = spark.range(salts).select(F.col("id").cast("int").alias("salt"))
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u point to the smallest neighbour of u.  Only nodes that are not
        # themselves the smallest change anything.
        low = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u")
        up = both.where("v > u").withColumn("salt", F.pmod(F.hash("v"), F.lit(salts)))
        moved = up.join(low.crossJoin(F.broadcast(salted)), ["u", "salt"], "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
        large = moved.where("u <> v").distinct()
        large = stage(large, "large")
        # Small star: each node's smaller neighbours, and the node, point to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
        down = large.withColumn("salt", F.pmod(F.hash("v"), F.lit(salts)))
        linked = down.join(low.crossJoin(F.broadcast(salted)), ["u", "salt"], "left")
        small = linked.select(
            F.explode(
                F.when(F.col("m").isNull() | (F.col("m") == F.col("v")), F.array(F.struct(F.col("u"), F.col("v"))))
                .otherwise(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            ).alias("x")
        ).select("x.u", "x.v").distinct()
        e = stage(small, "small", [e, large])
        seen = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    )
