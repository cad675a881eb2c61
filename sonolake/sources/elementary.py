"""Scan of coded elementary streams: frames, header fields, access units, without decoding.

The walk over a file's frames is sequential; files are parallel.  A stream that breaks off gives the frames up
to there and one row with an error.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dims import BITRATES

SYNC = b"\x0b\x77"
RATES = (48000, 44100, 32000)
CHANNELS = (2, 1, 2, 3, 3, 4, 4, 5)  # fixed values: full-band channels by coding mode
FRAME = "file_id string, frame_idx long, offset long, length int, codec string, bsid int, sample_rate int, mode int, lfe boolean, channels int, blocks int, stream_type int, substream int, error string"


class Bits:
    """Most significant bit first; reading past the end raises ValueError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        first, last = self.at // 8, (self.at + n + 7) // 8
        if last > len(self.data):
            raise ValueError("truncated header")
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)


def put(fields: list[tuple[int, int]]) -> bytes:
    """(value, bits) fields as bytes, zero-padded."""
    value = n = 0
    for v, k in fields:
        if not 0 <= v < 1 << k:
            raise ValueError(f"{v} does not fit {k} bits")
        value, n = value << k | v, n + k
    pad = -n % 8
    return (value << pad).to_bytes((n + pad) // 8, "big")


def frame_words(code: int, size_code: int) -> int:
    """16-bit words of a frame at a rate code: 1536 samples, one more word in padded frames at 44.1 kHz."""
    kbps = BITRATES[size_code >> 1]
    return (kbps * 2, kbps * 96000 // 44100 + (size_code & 1), kbps * 3)[code]


def header(data: bytes) -> dict:
    """Fields of the frame at the start of ``data``; length is in bytes."""
    if data[:2] != SYNC:
        raise ValueError("no sync word")
    if len(data) < 6:
        raise ValueError("truncated header")
    bsid = data[5] >> 3
    b = Bits(data[:16])
    b.read(16)
    if bsid <= 10:
        b.read(16)
        code, size = b.read(2), b.read(6)
        if code == 3 or size >= 2 * len(BITRATES):
            raise ValueError("reserved rate or size code")
        b.read(8)
        mode = b.read(3)
        b.read((2 if mode & 1 and mode != 1 else 0) + (2 if mode & 4 else 0) + (2 if mode == 2 else 0))
        out = {"codec": "ac-3", "sample_rate": RATES[code] >> max(0, bsid - 8), "blocks": 6, "stream_type": 0, "substream": 0, "length": 2 * frame_words(code, size)}
        lfe = b.read(1)
    elif bsid == 16:
        kind, sub, size, code = b.read(2), b.read(3), b.read(11), b.read(2)
        low = b.read(2)
        if code == 3 and low == 3:
            raise ValueError("reserved rate code")
        mode, lfe = b.read(3), b.read(1)
        out = {"codec": "ec-3", "sample_rate": RATES[low] // 2 if code == 3 else RATES[code], "blocks": 6 if code == 3 else (1, 2, 3, 6)[low], "stream_type": kind, "substream": sub, "length": 2 * (size + 1)}
    else:
        raise ValueError(f"bit stream {bsid} is not known")
    return out | {"bsid": bsid, "mode": mode, "lfe": bool(lfe), "channels": CHANNELS[mode] + lfe}


def walk(data: bytes):
    """(offset, header) of each frame; raises ValueError where the stream breaks."""
    at = 0
    while at < len(data):
        h = header(data[at : at + 16])
        if at + h["length"] > len(data):
            raise ValueError("truncated frame")
        yield at, h
        at += h["length"]


def scan(files: DataFrame) -> DataFrame:
    """A row for each frame of (path, content) rows."""
    names = [f.split()[0] for f in FRAME.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in FRAME.split(", ")]

    def work(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = []
                try:
                    for k, (at, h) in enumerate(walk(content.as_py())):
                        rows.append({"file_id": path.as_py(), "frame_idx": k, "offset": at} | h)
                except ValueError as e:
                    rows.append({"file_id": path.as_py(), "frame_idx": len(rows), "error": str(e)})
                if rows:
                    yield pa.record_batch([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    return files.select("path", "content").mapInArrow(work, FRAME)


def access_units(frames: DataFrame) -> DataFrame:
    """Frames grouped into units: an independent substream 0 opens one, all others up to the next belong to it."""
    opens = F.when((F.col("stream_type") != 1) & (F.col("substream") == 0), 1).otherwise(0)
    unit = F.sum(opens).over(Window.partitionBy("file_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)) - 1
    x = frames.where(F.col("error").isNull()).withColumn("unit", unit.cast("long")).where("unit >= 0")
    return x.groupBy("file_id", "unit").agg(F.min("offset").alias("offset"), F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("substreams"), F.max("channels").alias("channels"))
