"""Elementary-stream scans, container writers, streaming operators."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from sonolake.sources import elementary as es
from sonolake.sources import mux
from sonolake.streaming import live


def ac3(code=0, size=20, mode=7, lfe=1):
    mix = (2 if mode & 1 and mode != 1 else 0) + (2 if mode & 4 else 0) + (2 if mode == 2 else 0)
    head = es.put([(0x0B77, 16), (0, 16), (code, 2), (size, 6), (8, 5), (0, 3), (mode, 3), (0, mix), (lfe, 1)] if mix else [(0x0B77, 16), (0, 16), (code, 2), (size, 6), (8, 5), (0, 3), (mode, 3), (lfe, 1)])
    return head + bytes(2 * es.frame_words(code, size) - len(head))


def eac3(kind=0, sub=0, words=100, blocks=3, mode=2, lfe=0):
    head = es.put([(0x0B77, 16), (kind, 2), (sub, 3), (words - 1, 11), (0, 2), (blocks, 2), (mode, 3), (lfe, 1), (16, 5)])
    return head + bytes(2 * words - len(head))


def test_scan_and_access_units(spark):
    one = b"".join(ac3(mode=m, lfe=m % 2) for m in range(8)) + ac3(1, 21)
    two = (eac3() + eac3(1, 0, 60, mode=4) + eac3(0, 1, 40)) * 5
    files = spark.createDataFrame([("a", bytearray(one)), ("b", bytearray(two)), ("cut", bytearray(one[:-5])), ("none", bytearray(b"xx" * 9)), ("empty", bytearray())], "path string, content binary")
    frames = es.scan(files)
    got = {k: [r for r in frames.orderBy("frame_idx").collect() if r["file_id"] == k] for k in ("a", "b", "cut", "none", "empty")}
    assert [r["channels"] for r in got["a"][:8]] == [es.CHANNELS[m] + m % 2 for m in range(8)]
    assert got["a"][8]["sample_rate"] == 44100 and got["a"][8]["length"] == len(ac3(1, 21))
    assert sum(r["length"] for r in got["a"]) == len(one) and len(got["b"]) == 15 and got["b"][0]["blocks"] == 6
    assert got["cut"][-1]["error"] == "truncated frame" and len(got["cut"]) == 9 and got["none"][0]["error"] == "no sync word" and got["empty"] == []
    units = {(r["file_id"], r["unit"]): r for r in es.access_units(frames).collect()}
    assert units["b", 4]["substreams"] == 3 and units["b", 4]["bytes"] == 400 and units["b", 4]["channels"] == 3 and ("b", 5) not in units


def test_transport_stream_demuxes():
    rng = random.Random(1)
    frames = [rng.randbytes(rng.choice((10, 157, 158, 165, 166, 900))) for _ in range(100)]
    ts = mux.transport_stream(frames, 1536, 48000)
    assert len(ts) % 188 == 0
    pes, counters, tables = [], {}, 0
    for at in range(0, len(ts), 188):
        p = ts[at : at + 188]
        assert p[0] == 0x47
        pid, flags = struct.unpack_from(">H", p, 1)[0] & 0x1FFF, p[3]
        assert flags & 15 == counters.get(pid, 0) % 16
        counters[pid] = counters.get(pid, 0) + 1
        body = p[5 + p[4] :] if flags & 0x20 else p[4:]
        if pid == mux.ES_PID:
            if p[1] & 0x40:
                pes.append(b"")
            pes[-1] += body
        else:
            tables += 1
            n = struct.unpack_from(">H", body, 2)[0] & 0xFFF
            assert mux.crc32_mpeg2(body[1 : 4 + n]) == 0
    assert [p[14:] for p in pes] == frames and tables == 6
    for i, p in enumerate(pes):
        pts = (p[9] >> 1 & 7) << 30 | p[10] << 22 | p[11] >> 1 << 15 | p[12] << 7 | p[13] >> 1
        assert pts == i * 1536 * 90000 // 48000


def test_burst_and_fragments():
    b = mux.burst(b"\x0b\x77abc")
    assert len(b) == 6144 and b[:4] == b"\x72\xf8\x1f\x4e" and struct.unpack_from("<H", b, 6)[0] == 40 and b[8:14] == b"\x77\x0bba\x00c"
    with pytest.raises(ValueError):
        mux.burst(bytes(7000))
    frames = [bytes([i]) * (i + 1) for i in range(10)]
    segs = mux.fragments(frames, 4, 1536)
    assert len(segs) == 3
    for k, s in enumerate(segs):
        moof = s.index(b"moof") - 4
        offset = struct.unpack_from(">i", s, s.index(b"trun") + 12)[0]
        assert s[moof + offset :] == b"".join(frames[4 * k : 4 * k + 4])
        assert struct.unpack_from(">Q", s, s.index(b"tfdt") + 8)[0] == 4 * k * 1536


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stream")
    rows = [(k % 3, 1_000_000 * k + (20_000_000 if k > 60 else 0), k) for k in range(120)]
    for i in range(4):
        spark.createDataFrame(rows[i * 30 : i * 30 + 30], "stream_id long, us long, x long").coalesce(1).write.parquet(f"{folder}/part{i}")
    return spark.readStream.schema("stream_id long, us long, x long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"), rows


def run(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_watchdog_equals_batch(spark, stream, tmp_path):
    df, rows = stream
    got = sorted((r["stream_id"], r["since_us"], r["gap_us"]) for r in run(spark, live.watchdog(df, 5_000_000), "gaps", "append", tmp_path))
    want = []
    for s in range(3):
        t = [u for k, u, _ in rows if k == s]
        want += [(s, a, b - a) for a, b in zip(t, t[1:]) if b - a >= 5_000_000]
    assert got == sorted(want) and got


def test_meter_and_sinks(spark, stream, tmp_path):
    df, rows = stream
    got = run(spark, live.live_meter(df), "meter", "append", tmp_path / "a")
    assert sum(r["n"] for r in got) >= len(rows) - 15 and max(r["peak"] for r in got) > 100
    live.record(df, str(tmp_path / "out"), str(tmp_path / "b")).awaitTermination(120)
    seen = []
    live.fan_out(df, [lambda b, i: seen.append(b.count()), lambda b, i: seen.append(b.agg(F.max("x")).first()[0])], str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows) and sum(seen[::2]) == len(rows) and max(seen[1::2]) == 119
