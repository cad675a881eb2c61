"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles.

Fingerprints are grouped in tiles by the population counts of their four 16-bit parts.  Two fingerprints
at distance d have part counts that differ by at most d in sum, so only tile pairs whose counts differ by
no more than the radius are compared; all others are skipped.  Large tiles are dealt into parts of a
bounded size.  A tile pair is compared whole, by numpy exclusive-or and bit counts, and yields the spanning
stars of its links, not all of them.  Components join the stars.

Equal fingerprints are one row throughout, so groups of copies cost nothing.  Defined results: a null or
empty text, or one without words, has fingerprint zero and is linked like any other; rows with a null
doc_id get a fingerprint and a null component; repeated ids are one node; a text of any length is read whole;
other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import connected_components, stage, union_find

RADIUS, WORDS, SEED = 3, 3, 42
TILE = 2048
PARTS, PART_BITS = 4, 16


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of all word shingles, repeats included, of a lower-cased text."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed)], np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    n = len(w) - words + 1
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n)


def fingerprint(text: bytes) -> int:
    """64-bit SimHash: a bit is 1 if set in over half the shingle hashes."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, fp, *carry): fp is the fingerprint as a signed long."""

    def work(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *carry])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *carry)
    return x.mapInArrow(work, StructType([*StructType().add("doc_id", "long").add("fp", "long").fields, *x.schema.fields[2:]]))


def _part_counts(fp):
    """The tile key of a fingerprint: its part counts in base 17, which bounds tiles at 17**4 keys."""
    key = F.lit(0)
    for k in range(PARTS):
        key = key * (PART_BITS + 1) + F.bit_count(F.shiftrightunsigned(fp, PART_BITS * k).bitwiseAND(F.lit((1 << PART_BITS) - 1)))
    return key.cast("int")


def neighbours(radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts within the radius, one of each opposite pair, zero included."""
    near = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * PARTS]


def compare(a_fp, a_id, b_fp, b_id, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links between two lists of fingerprints, in blocks of bounded memory."""
    xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    held = 0
    step = max(1, (1 << 20) // max(1, len(b_fp)))
    for at in range(0, len(a_fp), step):
        near = np.bitwise_count(a_fp[at : at + step, None] ^ b_fp[None, :]) <= radius
        i, j = np.nonzero(near)
        x, y = a_id[at + i], b_id[j]
        keep = x != y
        xs.append(x[keep])
        ys.append(y[keep])
        held += len(xs[-1])
        if held > 1 << 20:
            u, v = union_find(np.concatenate(xs), np.concatenate(ys))
            xs, ys, held = [u], [v], 0
    return union_find(np.concatenate(xs), np.concatenate(ys)) if held else (xs[0], ys[0])


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): spanning stars of the links within the radius among distinct (fp, id) rows."""
    keyed = distinct.withColumn("key", _part_counts(F.col("fp")))
    sizes = keyed.groupBy("key").count().select("key", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    sizes = F.broadcast(stage(sizes, "tile_sizes"))  # at most 17**4 rows
    dealt = keyed.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = dealt.groupBy("key", "part").agg(F.collect_list(F.struct("fp", "id")).alias("rows"))
    tiles = stage(tiles.select("key", "part", F.col("rows.fp").alias("fps"), F.col("rows.id").alias("ids")), "tiles")

    offsets = F.array(*[F.array(*map(F.lit, d)) for d in neighbours(radius)])
    digits = [F.expr(f"(key div {17**p}) % 17") for p in range(PARTS - 1, -1, -1)]
    moved = F.transform(offsets, lambda d: F.array(*[digits[k] + d[k] for k in range(PARTS)]))
    inside = F.filter(moved, lambda t: F.forall(t, lambda v: (v >= 0) & (v <= PART_BITS)))
    to = F.transform(inside, lambda t: F.aggregate(t, F.lit(0).cast("bigint"), lambda acc, v: acc * 17 + v).cast("int"))
    asked = tiles.select(F.col("key").alias("a_key"), F.col("part").alias("a_part"), F.col("fps").alias("a_fps"), F.col("ids").alias("a_ids"), F.explode(to).alias("key"))
    asked = asked.join(sizes, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.where("a_key <> key OR a_part <= part")
    pairs = asked.join(tiles.hint("merge"), ["key", "part"]).select("a_fps", "a_ids", "fps", "ids")

    def work(batches):
        for batch in batches:
            us, vs = [], []
            for r in range(batch.num_rows):
                a_fp, a_id, b_fp, b_id = (batch.column(c)[r].values.to_numpy() for c in range(4))
                u, v = compare(a_fp.view(np.uint64), a_id, b_fp.view(np.uint64), b_id, radius)  # bit counts of signed numbers are of their absolute values
                us.append(u)
                vs.append(v)
            if us:
                yield pa.record_batch([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])

    return pairs.mapInArrow(work, "u long, v long")


def first_of_each(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of each component of linked fingerprints, all columns as they are: that with the smallest id.

    Rows are judged each by their own text, whatever rows have the same id: of a repeated id's rows, those linked to a
    kept one go.  Of rows that are equal in id and fingerprint the first by text and all else stays; rows with a null
    doc_id belong to no component and stay.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    key, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    fps = stage(fingerprints(docs).where("doc_id IS NOT NULL"), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct_fps")
    parts = connected_components(links(distinct.select("fp", F.col("fp").alias("id")), radius, tile))
    labelled = distinct.join(stage(parts, "components").withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = labelled.groupBy("component").agg(F.min(F.struct("id", "fp")).alias("best")).select(F.col("best.id").alias("__id"), F.col("best.fp").alias("__fp"))
    rows = fps.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__rows"))
    kept = stage(best.join(rows, "__id"), "kept", [fps, distinct])
    once = plain.join(kept.where("__rows = 1"), key.cast("long") == F.col("__id"), "left_semi")
    again = plain.join(kept.where("__rows > 1"), key.cast("long") == F.col("__id"), "left_semi")
    struct = F.struct(*plain.columns)
    again = fingerprints(again.select(key.alias("doc_id"), text.alias("text"), struct.alias("row")), "row").join(kept.select(F.col("__id").alias("doc_id"), F.col("__fp").alias("fp")), ["doc_id", "fp"])
    first = F.row_number().over(Window.partitionBy("doc_id", "fp").orderBy(F.col(f"row.c{names.index('text')}"), F.to_json("row")))
    again = again.withColumn("n", first).where("n = 1").select("row.*")
    return once.unionByName(again).unionByName(plain.where(key.isNull())).toDF(*names)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    fps = stage(fingerprints(docs), "fingerprints")
    distinct = stage(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct_fps")
    star = links(distinct, radius, tile)
    # An id that stands on several rows joins their fingerprints.
    ids = fps.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    again = fps.join(ids, "doc_id").join(distinct, "fp").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    parts = stage(connected_components(star.unionByName(again)), "components")
    smallest = distinct.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    smallest = stage(smallest, "fp_components")
    out = fps.join(smallest, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
