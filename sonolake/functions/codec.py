"""Integer stages of the coded formats: exponents, mantissas, coordinates, variable-length fields, tags.

Plain functions over numpy arrays or bit lists; ``apply`` runs one over a column in Arrow batches.
"""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Exponents that share a code by strategy.
SPAN = {"D15": 1, "D25": 2, "D45": 4}
# Quantiser levels of symmetric allocation codes, mantissa bits of the others (6 to 15).
LEVELS = {1: 3, 2: 5, 3: 7, 4: 11, 5: 15}
BITS = dict(zip(range(6, 16), (5, 6, 7, 8, 9, 10, 11, 12, 14, 16)))


def strategy_for(blocks: int) -> str:
    """Finer exponents the longer they are used."""
    return "D45" if blocks <= 1 else "D25" if blocks <= 3 else "D15"


def encode_exponents(exponents: np.ndarray, strategy: str) -> tuple[int, list[int], np.ndarray]:
    """(absolute first exponent, 7-bit groups, exponents as decoded): differences in -2..2, three to a group.

    Shared exponents take the least of their bins; then no exponent may exceed a neighbour by over two, so
    values are lowered until differences fit.
    """
    span = SPAN[strategy]
    first, rest = int(min(exponents[0], 15)), exponents[1:]
    n = -(-len(rest) // (3 * span)) * 3
    padded = np.concatenate([rest, np.full(n * span - len(rest), rest[-1] if len(rest) else first)])
    shared = np.concatenate([[first], padded.reshape(n, span).min(axis=1)]) if n else np.array([first])
    for k in range(1, len(shared)):
        shared[k] = min(shared[k], shared[k - 1] + 2)
    for k in range(len(shared) - 2, -1, -1):
        shared[k] = min(shared[k], shared[k + 1] + 2)
    d = np.diff(shared) + 2
    groups = (25 * d[::3] + 5 * d[1::3] + d[2::3]).tolist()
    return int(shared[0]), groups, decode_exponents(int(shared[0]), groups, strategy, len(exponents))


def decode_exponents(first: int, groups: list[int], strategy: str, n: int) -> np.ndarray:
    """Prefix sums of the groups' differences, each repeated over its bins."""
    g = np.array(groups, np.int64)
    if len(g) and (g.min() < 0 or g.max() > 124):
        raise ValueError("a group of exponents is out of range")
    d = np.stack([g // 25, g // 5 % 5, g % 5], axis=1).ravel() - 2
    e = first + np.cumsum(d)
    if len(e) and (e.min() < 0 or e.max() > 24):
        raise ValueError("an exponent is out of range")
    return np.concatenate([[first], np.repeat(e, SPAN[strategy])])[:n]


def quantise_mantissa(x: np.ndarray, code: int) -> np.ndarray:
    """Codes of mantissas in -1..1 by allocation code; 0 carries nothing."""
    if code == 0:
        return np.zeros(len(x), np.int64)
    if code in LEVELS:
        n = LEVELS[code]
        return np.clip(np.floor((x + 1) / 2 * n), 0, n - 1).astype(np.int64)
    half = 1 << (BITS[code] - 1)
    return np.clip(np.floor(x * half + 0.5), -half, half - 1).astype(np.int64)


def dequantise_mantissa(q: np.ndarray, code: int) -> np.ndarray:
    if code == 0:
        return np.zeros(len(q))
    if code in LEVELS:
        n = LEVELS[code]
        return (2 * q - (n - 1)) / n
    return q / float(1 << (BITS[code] - 1))


def group_mantissas(q: list[int], code: int) -> list[int]:
    """Grouped words of codes 1, 2 and 4; the last group is filled with zeros."""
    per, n = {1: (3, 3), 2: (3, 5), 4: (2, 11)}[code]
    q = q + [0] * (-len(q) % per)
    return [int(sum(v * n ** (per - 1 - k) for k, v in enumerate(q[i : i + per]))) for i in range(0, len(q), per)]


def ungroup_mantissas(words: list[int], code: int, count: int) -> list[int]:
    per, n = {1: (3, 3), 2: (3, 5), 4: (2, 11)}[code]
    return [w // n ** (per - 1 - k) % n for w in words for k in range(per)][:count]


def variable_bits(value: int, n: int) -> list[tuple[int, int]]:
    """(value, bits) fields of a variable-length number in groups of n bits, each with a flag for more."""
    groups, reach = 1, 1 << n
    while value >= reach:
        value -= reach
        groups += 1
        reach = 1 << n * groups
    digits = [(value >> n * k) & ((1 << n) - 1) for k in range(groups - 1, -1, -1)]
    return [f for k, d in enumerate(digits) for f in ((d, n), (int(k + 1 < groups), 1))]


def read_variable_bits(read, n: int) -> int:
    """Inverse of ``variable_bits`` over a reader of bits."""
    value, base, groups = read(n), 0, 1
    while read(1):
        base += 1 << n * groups
        value = value << n | read(n)
        groups += 1
    return base + value


def delta_codes(codes: np.ndarray, steps: int) -> np.ndarray:
    """Differences of successive codes modulo the alphabet; the first is from its middle."""
    return np.diff(codes, prepend=steps // 2) % steps


def undelta_codes(deltas: np.ndarray, steps: int) -> np.ndarray:
    return (np.cumsum(deltas) + steps // 2) % steps


def tag(key: bytes, data: bytes) -> bytes:
    return hmac.new(key, data, hashlib.sha256).digest()


def verify(key: bytes | None, data: bytes, claimed: bytes | None) -> str:
    """Outcome of a tag: unsigned, no key, valid, or invalid."""
    if claimed is None:
        return "unsigned"
    if key is None:
        return "no key"
    return "valid" if hmac.compare_digest(tag(key, data), claimed) else "invalid"


def apply(df: DataFrame, function, column: str, out: str, kind: str) -> DataFrame:
    """Add ``function`` of a column's values, in Arrow batches; a ValueError gives null."""
    schema = StructType(list(df.schema.fields)).add(out, kind)
    at = df.columns.index(column)

    def one(v):
        try:
            return None if v is None else function(v)
        except ValueError:
            return None

    def work(batches):
        for b in batches:
            made = pa.array([one(v) for v in b.column(at).to_pylist()])
            yield pa.record_batch([*b.columns, made], names=[*b.schema.names, out])

    return df.mapInArrow(work, schema)
