"""Deterministic Matroska and single-file MP4 writers over a stream's ordered frames."""

from __future__ import annotations

import struct

from .mux import box


def vint(n: int) -> bytes:
    """An element size: one to eight bytes, a marker bit before 7 bits for each byte; all ones are reserved."""
    for k in range(1, 9):
        if n < (1 << 7 * k) - 1:
            return (n | 1 << 7 * k).to_bytes(k, "big")
    raise ValueError("too large for an element size")


def element(ident: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def clusters(times: list[int], span: int) -> list[int]:
    """The cluster of each frame: a new one begins where the distance to its first frame reaches ``span`` ms,
    or would not fit 16 bits."""
    out, start, k = [], None, -1
    for t in times:
        if start is None or t - start >= min(span, 32767):
            start, k = t, k + 1
        out.append(k)
    return out


def matroska(frames: list[bytes], samples: int, rate: int, channels: int, codec: str = "A_AC3", span: int = 1024) -> bytes:
    """One audio track, a simple block for each frame, stamps from the index."""
    times = [i * samples * 1000 // rate for i in range(len(frames))]
    head = element(0x1A45DFA3, number(0x4286, 1), number(0x42F7, 1), number(0x42F2, 4), number(0x42F3, 8), element(0x4282, b"matroska"), number(0x4287, 4), number(0x4285, 2))
    info = element(0x1549A966, number(0x2AD7B1, 1_000_000), element(0x4D80, b"sonolake"), element(0x5741, b"sonolake"), element(0x4489, struct.pack(">d", len(frames) * samples * 1000 / rate)))
    audio = element(0xE1, element(0xB5, struct.pack(">d", float(rate))), number(0x9F, channels))
    track = element(0x1654AE6B, element(0xAE, number(0xD7, 1), number(0x73C5, 1), number(0x83, 2), element(0x86, codec.encode()), audio))
    groups: dict[int, list[int]] = {}
    for i, c in enumerate(clusters(times, span)):
        groups.setdefault(c, []).append(i)
    body = []
    for members in groups.values():
        base = times[members[0]]
        blocks = [element(0xA3, b"\x81", struct.pack(">hB", times[i] - base, 0x80), frames[i]) for i in members]
        body.append(element(0x1F43B675, number(0xE7, base), *blocks))
    return head + element(0x18538067, info, track, *body)


def mp4(frames: list[bytes], samples: int, rate: int, channels: int, config: bytes, kind: bytes = b"ac-3") -> bytes:
    """ftyp, moov with sample sizes and one chunk, mdat; the chunk's offset follows from the sizes before it."""
    if not frames:
        raise ValueError("no frames")
    total = len(frames) * samples
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(kind, bytes(6), struct.pack(">H8xHH4xI", 1, channels, 16, rate << 16), config)

    def moov(offset: int) -> bytes:
        table = box(
            b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry), box(b"stts", struct.pack(">IIII", 0, 1, len(frames), samples)), box(b"stsc", struct.pack(">IIIII", 0, 1, 1, len(frames), 1)),
            box(b"stsz", struct.pack(">III", 0, 0, len(frames)), *[struct.pack(">I", len(f)) for f in frames]), box(b"stco", struct.pack(">III", 0, 1, offset)),
        )
        media = box(b"minf", box(b"smhd", bytes(8)), box(b"dinf", box(b"dref", struct.pack(">II", 0, 1), box(b"url ", struct.pack(">I", 1)))), table)
        mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, rate, total, 0x55C4, 0)), box(b"hdlr", struct.pack(">II", 0, 0), b"soun", bytes(13)), media)
        tkhd = box(b"tkhd", struct.pack(">IIIIII8xHHHH", 7, 0, 0, 1, 0, total, 0, 0, 0x100, 0), matrix, bytes(8))
        mvhd = box(b"mvhd", struct.pack(">IIIIIIH10x", 0, 0, 0, rate, total, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    return head + moov(len(head) + len(moov(0)) + 8) + box(b"mdat", *frames)


def playlist(durations: list[float], name: str = "seg{}.m4s") -> str:
    """A media playlist; its target is the longest segment, rounded up."""
    lines = ["#EXTM3U", "#EXT-X-VERSION:7", f"#EXT-X-TARGETDURATION:{-int(-max(durations, default=0) // 1)}", '#EXT-X-MAP:URI="init.mp4"']
    for i, d in enumerate(durations):
        lines += [f"#EXTINF:{d:.5f},", name.format(i + 1)]
    return "\n".join([*lines, "#EXT-X-ENDLIST", ""])


def timeline(durations: list[int]) -> str:
    """Run-length coded segment durations as timeline elements."""
    out: list[list[int]] = []
    for d in durations:
        if out and out[-1][0] == d:
            out[-1][1] += 1
        else:
            out.append([d, 0])
    return "".join(f'<S d="{d}"/>' if not r else f'<S d="{d}" r="{r}"/>' for d, r in out)
