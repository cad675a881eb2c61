"""Bit, byte and checksum functions over arrays of bytes, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crc_table(poly: int, width: int) -> list[int]:
    """The 256 remainders of a non-reflected polynomial, by rule."""
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for b in range(256):
        r = b << (width - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly) & mask if r & top else (r << 1) & mask
        out.append(r)
    return out


def byte_array(binary: Column) -> Column:
    """The bytes of a binary column as numbers 0..255."""
    h = F.hex(binary)
    places = F.when(F.length(h) > 0, F.sequence(F.lit(0), F.floor(F.length(h) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))


def crc(data: Column, poly: int, width: int, init: int) -> Column:
    """Non-reflected CRC of an array of bytes; the standard library's crc32 is the reflected one."""
    table = F.array(*[F.lit(v).cast("bigint") for v in crc_table(poly, width)])
    mask = F.lit((1 << width) - 1).cast("bigint")
    step = lambda c, b: F.shiftleft(c, 8).bitwiseAND(mask).bitwiseXOR(F.element_at(table, (F.shiftright(c, width - 8).bitwiseXOR(b).bitwiseAND(F.lit(255)) + 1).cast("int")))
    return F.aggregate(data, F.lit(init).cast("bigint"), step)


def field(data: Column, bit: int, n: int) -> Column:
    """An n-bit field, most significant bit first, at a bit offset of an array of bytes; null past the end."""
    first, last = bit // 8, (bit + n - 1) // 8
    value = F.lit(0).cast("bigint")
    for k in range(first, last + 1):
        value = F.shiftleft(value, 8).bitwiseOR(F.get(data, F.lit(k)))
    return F.shiftright(value, 8 * (last + 1) - bit - n).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))
