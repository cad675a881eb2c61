"""Keyframe text, definition graphs, Matroska and MP4 writers."""

import struct

import duckdb

from sonolake.plans import graph_q, registry
from sonolake.sources import matroska as mk
from sonolake.sources import metadata as md


def test_keyframes(spark):
    lines = ["# header", "", "1 0.0 0 0 0 1 0", "1 1.5 1 0.5 0 0.5 0 # end", "2 0 0 0 0 1 0", "2 0 1 1 1 1 1", "1 2 3", "x 0 0 0 0 0 0"]
    got = md.keyframes(spark.createDataFrame([(x,) for x in lines], "value string"))
    ok = sorted((r["object"], r["time_s"], r["x"], r["gain"]) for r in got.where("error IS NULL").collect())
    assert ok == [(1, 0.0, 0.0, 1.0), (1, 1.5, 1.0, 0.5), (2, 0.0, 0.0, 1.0), (2, 0.0, 1.0, 1.0)]
    assert got.where("error IS NOT NULL").count() == 2
    assert [tuple(r) for r in md.duplicate_times(got).collect()] == [(2, 1)]


XML = """<f xmlns="urn:x"><audioProgramme audioProgrammeID="P1" audioProgrammeName="main"><audioContentIDRef>C1</audioContentIDRef></audioProgramme>
<audioContent audioContentID="C1"><audioObjectIDRef>O1</audioObjectIDRef><audioObjectIDRef>O3</audioObjectIDRef></audioContent>
<audioObject audioObjectID="O1"><audioObjectIDRef>O2</audioObjectIDRef><audioPackFormatIDRef>K9</audioPackFormatIDRef></audioObject>
<audioObject audioObjectID="O2"><audioObjectIDRef>O1</audioObjectIDRef></audioObject><audioObject audioObjectID="O3"/><audioObject audioObjectID="O4"/></f>"""


def test_definition_graph(spark):
    g = md.definition_graph(spark.createDataFrame([("a", bytearray(XML.encode())), ("bad", bytearray(b"<x"))], "path string, content binary"))
    assert g.where("error IS NOT NULL").first()["file_id"] == "bad"
    assert [(r["id"], r["ref"]) for r in md.unresolved(g).collect()] == [("O1", "K9")]
    assert {(r["object"], r["cycle"]) for r in md.leaf_objects(g, 6).collect()} == {("O1", True), ("O2", False), ("O3", False)}


def test_leaf_objects_of_a_deep_chain(spark):
    edge = lambda kind, i, ref_kind, ref: ("a", kind, i, i, ref_kind, ref, 0, None)
    rows = [edge("audioProgramme", "P", "audioContent", "C"), edge("audioContent", "C", "audioObject", "O0"), *[edge("audioObject", f"O{k}", "audioObject", f"O{k + 1}") for k in range(20)], edge("audioObject", "O20", "audioObject", "O5")]
    got = {(r["object"], r["cycle"]) for r in md.leaf_objects(spark.createDataFrame(rows, md.EDGE)).collect()}
    assert got == {(f"O{k}", k == 5) for k in range(21)}


def test_closure_of_a_deep_chain(spark, tmp_path):
    spark.createDataFrame([(3**k,) for k in range(20)] + [(2,), (7,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in graph_q.closure(spark, str(tmp_path)).collect())
    assert got == sorted([(3**k, 19 - k, 19 - k) for k in range(19)] + [(2, 1, 1)])


def test_matroska_parses():
    frames = [bytes([i % 251]) * (i % 300 + 1) for i in range(200)]
    data = mk.matroska(frames, 1536, 48000, 6)

    def parse(b):
        at = 0
        while at < len(b):
            n = 9 - b[at].bit_length()
            ident = int.from_bytes(b[at : at + n], "big")
            at += n
            k = 9 - b[at].bit_length()
            size = int.from_bytes(b[at : at + k], "big") & ((1 << 7 * k) - 1)
            at += k
            yield ident, b[at : at + size]
            at += size
        assert at == len(b)

    segment = dict(parse(data))[0x18538067]
    got, times = [], []
    for ident, body in parse(segment):
        if ident == 0x1F43B675:
            inner = list(parse(body))
            base = int.from_bytes(inner[0][1], "big")
            for i, b in inner[1:]:
                assert i == 0xA3
                times.append(base + struct.unpack(">h", b[1:3])[0])
                got.append(b[4:])
    assert got == frames and times == [i * 32 for i in range(200)]
    assert mk.clusters([0, 32, 1024, 2047, 2048], 1024) == [0, 0, 1, 1, 2]


def test_mp4_offsets_and_lists():
    frames = [b"abc", b"defgh", b"i"]
    data = mk.mp4(frames, 1536, 48000, 2, b"cfg")
    offset = struct.unpack_from(">I", data, data.index(b"stco") + 12)[0]
    assert data[offset:] == b"abcdefghi" and sum(struct.unpack_from(">I", data, at)[0] for at in (0, 28)) + 8 + 9 == len(data) - 0
    assert mk.timeline([5, 5, 5, 3, 5]) == '<S d="5" r="2"/><S d="3"/><S d="5"/>'
    assert "#EXT-X-TARGETDURATION:2\n" in mk.playlist([1.024, 1.5])
    assert mk.vint(126) == b"\xfe" and mk.vint(127) == b"\x40\x7f"


def test_closure_holds_counts_of_paths(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k,) for k in range(1000)] + [(4,), (4,), (13,), (-5,), (-1,), (None,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    held, rows = graph_q.held, []

    def counted(df):
        out = held(df)
        rows.append((out.count(), any(t.startswith("array") for _, t in out.dtypes)))
        return out

    monkeypatch.setattr(graph_q, "held", counted)
    got = sorted(tuple(r) for r in graph_q.closure(spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(duck.sql(registry.ORACLE_SQL["graph_closure"]).fetchall())
    assert sum(n for n, _ in rows) < 2 * 1000 and not any(path for _, path in rows)
