"""Deterministic container writers over a stream's ordered frames: transport stream, bursts, fragments."""

from __future__ import annotations

import struct

from ..functions.bits import crc_table

PAT_PID, PMT_PID, ES_PID = 0, 0x1000, 0x100
_TABLE = crc_table(0x04C11DB7, 32)


def crc32_mpeg2(data: bytes) -> int:
    """The non-reflected CRC-32 of transport tables."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8) & 0xFFFFFFFF ^ _TABLE[(c >> 24) ^ b]
    return c


def _packets(pid: int, payload: bytes, counter: int, pcr: int | None = None):
    """188-byte packets of one unit; the last is filled by its adaptation field."""
    first = True
    while payload:
        clock = b""
        if first and pcr is not None:
            clock = b"\x10" + struct.pack(">IH", pcr >> 1, (pcr & 1) << 15 | 0x7E00)
        room = 184 - (1 + len(clock) if clock else 0)
        piece = payload[:room]
        payload = payload[room:]
        fill = 184 - len(piece)
        head = struct.pack(">BHB", 0x47, (0x4000 if first else 0) | pid, (0x30 if fill else 0x10) | counter & 15)
        if fill:
            body = clock or (b"\x00" if fill > 1 else b"")
            field = bytes([fill - 1]) + body + b"\xff" * (fill - 1 - len(body))
        else:
            field = b""
        yield head + field + piece
        counter, first = counter + 1, False


def _section(table: int, ident: int, body: bytes) -> bytes:
    s = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, ident, 0xC1, 0, 0) + body
    return b"\x00" + s + struct.pack(">I", crc32_mpeg2(s))


def transport_stream(frames: list[bytes], samples: int, rate: int, every: int = 40, stream_type: int = 0x81) -> bytes:
    """PAT and PMT before every 40th frame, a PES packet for each; stamps from the index, so without drift."""
    pat = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _section(2, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, stream_type, 0xE000 | ES_PID, 0xF000))
    out, count = [], {PAT_PID: 0, PMT_PID: 0, ES_PID: 0}
    for i, frame in enumerate(frames):
        pts = i * samples * 90000 // rate
        units = [(PAT_PID, pat, None), (PMT_PID, pmt, None)] if i % every == 0 else []
        stamp = bytes([0x21 | (pts >> 29) & 14]) + struct.pack(">HH", (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1)
        pes = b"\x00\x00\x01\xbd" + struct.pack(">HBBB", len(frame) + 8, 0x84, 0x80, 5) + stamp + frame
        for pid, unit, pcr in [*units, (ES_PID, pes, pts)]:
            made = list(_packets(pid, unit, count[pid], pcr))
            count[pid] += len(made)
            out += made
    return b"".join(out)


def burst(frame: bytes, kind: int = 1, size: int = 6144) -> bytes:
    """A data burst: preamble, length in bits, payload in swapped byte order, zero fill."""
    if len(frame) + 8 > size:
        raise ValueError("a frame is larger than its burst")
    body = frame + b"\x00" * (len(frame) & 1)
    swapped = bytes(x for pair in zip(body[1::2], body[::2]) for x in pair)
    return struct.pack("<HHHH", 0xF872, 0x4E1F, kind, len(frame) * 8) + swapped + b"\x00" * (size - 8 - len(swapped))


def box(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, name) + body


def fragment(frames: list[bytes], sequence: int, first_sample: int, samples: int) -> bytes:
    """One media segment: styp, moof with the data offset that the sizes imply, mdat."""
    run = b"".join(struct.pack(">I", len(f)) for f in frames)

    def moof(offset: int) -> bytes:
        tfhd = box(b"tfhd", struct.pack(">III", 0x020008, 1, samples))
        tfdt = box(b"tfdt", struct.pack(">IQ", 0x01000000, first_sample))
        trun = box(b"trun", struct.pack(">IIi", 0x000201, len(frames), offset), run)
        return box(b"moof", box(b"mfhd", struct.pack(">II", 0, sequence)), box(b"traf", tfhd, tfdt, trun))

    head = moof(len(moof(0)) + 8)
    return box(b"styp", b"msdh", struct.pack(">I", 0), b"msdh", b"msix") + head + box(b"mdat", *frames)


def fragments(frames: list[bytes], per: int, samples: int) -> list[bytes]:
    """All media segments of a stream, ``per`` frames each."""
    return [fragment(frames[a : a + per], a // per + 1, a * samples, samples) for a in range(0, len(frames), per)]
