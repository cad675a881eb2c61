"""RIFF/WAVE scans and sinks: binary files to PCM blocks and back.

``pcm(file_id, sample_rate, channel, block, samples)`` is one row for a channel's block.  A file that cannot
be read gives one row with an error, not a failed task.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1536
PCM = "file_id string, sample_rate int, channel int, block long, samples array<float>, error string"


def parse(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples[channel, n]) of a 16-bit or float32 file; a data chunk longer than the file is cut to it."""
    if data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
            if form[0] == 0xFFFE and size >= 40:
                form = (struct.unpack_from("<H", data, at + 32)[0], *form[1:])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    if form is None or body is None:
        raise ValueError("no fmt or data chunk")
    code, channels, rate, _, align, bits = form
    if channels == 0 or (code, bits) not in ((1, 16), (3, 32)):
        raise ValueError(f"format {code} of {bits} bits is not read")
    body = body[: len(body) // align * align]
    x = np.frombuffer(body, "<i2").astype(np.float32) / np.float32(32768) if bits == 16 else np.frombuffer(body, "<f4")
    return rate, x.reshape(-1, channels).T


def build(rate: int, samples: np.ndarray, bits: int = 32) -> bytes:
    """A float32 or 16-bit file of samples[channel, n]; refuses to write nothing."""
    channels, n = samples.shape
    if channels == 0:
        raise ValueError("no channels")
    if bits == 32:
        body = np.ascontiguousarray(samples.T.astype("<f4")).tobytes()
    else:
        body = np.ascontiguousarray(np.clip(np.round(samples.T * 32768), -32768, 32767).astype("<i2")).tobytes()
    align = channels * bits // 8
    form = struct.pack("<HHIIHH", 3 if bits == 32 else 1, channels, rate, rate * align, align, bits)
    size = 4 + 8 + len(form) + 8 + len(body)
    return b"RIFF" + struct.pack("<I", size) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(body)) + body


def blocks(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """PCM rows of (path, content) rows."""
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.string()]
    names = [f.split()[0] for f in PCM.split(", ")]

    def work(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                try:
                    rate, x = parse(content.as_py())
                    rows = [(path.as_py(), rate, c, k, x[c, k * block : (k + 1) * block].tolist(), None) for k in range(-(-x.shape[1] // block)) for c in range(len(x))]
                except (ValueError, struct.error) as e:
                    rows = [(path.as_py(), None, None, None, None, str(e))]
                for at in range(0, len(rows), 512):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 512]), types)], names=names)

    return files.select("path", "content").mapInArrow(work, PCM)


def read(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """PCM rows of all files under a path, any store that Spark reads."""
    return blocks(spark.read.format("binaryFile").load(path), block)


def write(pcm: DataFrame, bits: int = 32) -> DataFrame:
    """(file_id, content): one file of each programme, its blocks in order; ragged channels are cut to the shortest."""

    def work(table: pa.Table) -> pa.Table:
        t = table.sort_by([("channel", "ascending"), ("block", "ascending")])
        rows: dict[int, list] = {}
        for c, s in zip(t.column("channel").to_pylist(), t.column("samples").to_pylist()):
            rows.setdefault(c, []).append(np.array(s, np.float32))
        x = [np.concatenate(v) for _, v in sorted(rows.items())]
        n = min(map(len, x))
        content = build(t.column("sample_rate")[0].as_py(), np.stack([v[:n] for v in x]), bits)
        return pa.table([pa.array([t.column("file_id")[0].as_py()]), pa.array([content], pa.binary())], names=["file_id", "content"])

    return pcm.where(F.col("error").isNull()).groupBy("file_id").applyInArrow(work, "file_id string, content binary")
