"""Bit allocation of the coded formats: exponents to allocation codes by a masking model, as the public standard gives it.

Many blocks at once: a matrix with a row for each block goes through the bands in order, so the loop is over 50 bands,
whatever the number of blocks. Powers are integers, 128 to a doubling of amplitude, and every step is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fixed values of the standard, in the order of their codes.
SLOW_DECAY = (15, 17, 19, 21)
FAST_DECAY = (63, 83, 103, 123)
SLOW_GAIN = (0x540, 0x4D8, 0x478, 0x410)
KNEE = (0x000, 0x700, 0x900, 0xB00)
FLOOR = (0x2F0, 0x2B0, 0x270, 0x230, 0x1F0, 0x170, 0x0F0, -0x800)
# Allocation codes by level above the mask, in steps of 32.
CODES = (
    0, 1, 1, 1, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 6, 6, 6, 7, 7, 7, 7, 8, 8, 8, 8, 9, 9, 9, 9, 10,
    10, 10, 10, 11, 11, 11, 11, 12, 12, 12, 12, 13, 13, 13, 13, 14, 14, 14, 14, 14, 14, 14, 14, 15, 15, 15, 15, 15, 15, 15, 15, 15,
)
# What the sum of two powers has over the larger, by half their difference; zero from 200 on.
SUM_OVER = (
    64, 63, 62, 61, 60, 59, 58, 57, 56, 55, 54, 53, 52, 52, 51, 50, 49, 48, 47, 47, 46, 45, 44, 44, 43, 42, 41, 41, 40, 39,
    38, 38, 37, 36, 36, 35, 35, 34, 33, 33, 32, 32, 31, 30, 30, 29, 29, 28, 28, 27, 27, 26, 26, 25, 25, 24, 24, 23, 23, 22,
    22, 21, 21, 21, 20, 20, 19, 19, 19, 18, 18, 18, 17, 17, 17, 16, 16, 16, 15, 15, 15, 14, 14, 14, 13, 13, 13, 13, 12, 12,
    12, 12, 11, 11, 11, 11, 10, 10, 10, 10, 10, 9, 9, 9, 9, 9, 8, 8, 8, 8, 8, 8, 7, 7, 7, 7, 7, 7, 6, 6,
    6, 6, 6, 6, 6, 6, 5, 5, 5, 5, 5, 5, 5, 5, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 3, 3, 3, 3, 3,
    3, 3, 3, 3, 3, 3, 3, 3, 3, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 1,
    1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1,
)
# Hearing thresholds of the bands at 48, 44.1 and 32 kHz.
HEARING = (
    (
        0x4D0, 0x4D0, 0x440, 0x400, 0x3E0, 0x3C0, 0x3B0, 0x3B0, 0x3A0, 0x3A0, 0x3A0, 0x3A0, 0x3A0, 0x390, 0x390, 0x390, 0x380, 0x380, 0x370, 0x370,
        0x360, 0x360, 0x350, 0x350, 0x340, 0x340, 0x330, 0x320, 0x310, 0x300, 0x2F0, 0x2F0, 0x2F0, 0x2F0, 0x300, 0x310, 0x340, 0x390, 0x3E0, 0x420,
        0x460, 0x490, 0x4A0, 0x460, 0x440, 0x440, 0x520, 0x800, 0x840, 0x840,
    ),
    (
        0x4F0, 0x4F0, 0x460, 0x410, 0x3E0, 0x3D0, 0x3C0, 0x3B0, 0x3B0, 0x3A0, 0x3A0, 0x3A0, 0x3A0, 0x3A0, 0x390, 0x390, 0x390, 0x380, 0x380, 0x380,
        0x370, 0x370, 0x360, 0x360, 0x350, 0x350, 0x340, 0x340, 0x320, 0x310, 0x300, 0x2F0, 0x2F0, 0x2F0, 0x2F0, 0x300, 0x320, 0x350, 0x390, 0x3E0,
        0x420, 0x450, 0x4A0, 0x490, 0x460, 0x440, 0x480, 0x630, 0x840, 0x840,
    ),
    (
        0x580, 0x580, 0x4B0, 0x450, 0x420, 0x3F0, 0x3E0, 0x3D0, 0x3C0, 0x3B0, 0x3B0, 0x3B0, 0x3A0, 0x3A0, 0x3A0, 0x3A0, 0x3A0, 0x3A0, 0x3A0, 0x3A0,
        0x390, 0x390, 0x390, 0x390, 0x380, 0x380, 0x380, 0x370, 0x360, 0x350, 0x340, 0x330, 0x320, 0x310, 0x300, 0x2F0, 0x2F0, 0x2F0, 0x300, 0x310,
        0x330, 0x350, 0x3C0, 0x410, 0x470, 0x4A0, 0x460, 0x440, 0x450, 0x4E0,
    ),
)
#: First bins of the 50 bands and the end of the last: 28 of one bin, 7 of 3, 6 of 6, 4 of 12, 5 of 24.
EDGES = np.cumsum([0] + [1] * 28 + [3] * 7 + [6] * 6 + [12] * 4 + [24] * 5)
BAND_OF = np.repeat(np.arange(50), np.diff(EDGES))
_OVER = np.zeros(256, np.int64)
_OVER[: len(SUM_OVER)] = SUM_OVER
_CODES = np.array(CODES)


@dataclass(frozen=True)
class Model:
    """Codes of a masking model as a stream carries them; ``rate`` is 0, 1 or 2 for 48, 44.1 or 32 kHz."""

    rate: int = 0
    coarse: int = 20
    fine: int = 6
    slow_decay: int = 2
    fast_decay: int = 1
    slow_gain: int = 1
    knee: int = 2
    floor: int = 4
    fast_gain: int = 4

    @property
    def offset(self) -> int:
        return ((self.coarse - 15) * 16 + self.fine) * 4


def fast_gain(code: int) -> int:
    return 128 * (code + 1)


def log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Power of two powers together."""
    return np.maximum(a, b) + _OVER[np.minimum(np.abs(a - b) >> 1, 255)]


def band_power(power: np.ndarray, start: int) -> np.ndarray:
    """Powers of the 50 bands from those of bins ``start`` on, a row for each block; absent bands are zero."""
    out = np.zeros((len(power), 51), np.int64)
    for k in range(start, power.shape[1]):
        b = BAND_OF[k]
        out[:, b] = power[:, k] if k in (start, EDGES[b]) else log_add(out[:, b], power[:, k])
    return out


def excitation(p: np.ndarray, model: Model, first: int, last: int, leaks: tuple[int, int] | None) -> np.ndarray:
    """What each band masks. ``leaks`` are those a coupling channel starts from; other channels start at band 0, follow
    the power alone until it first ceases to fall, and compensate for steep rises at low frequencies."""
    rows = len(p)
    fall, fall_slow = FAST_DECAY[model.fast_decay], SLOW_DECAY[model.slow_decay]
    quick, slow = (np.full(rows, (v << 8) + 768) for v in leaks or (0, 0))
    decays = np.full(rows, leaks is not None)
    low = np.zeros(rows, np.int64)
    out = np.zeros_like(p)
    for b in range(first, last):
        now, following = p[:, b], p[:, b + 1]
        known = not (last == 7 and b == 6)  # the low-frequency channel has no band after its seventh
        if leaks is not None or b >= 22:
            low = np.zeros(rows, np.int64)
        elif b >= 20:
            low = np.maximum(low - 128, 0)
        elif known:
            low = np.where(now + 256 == following, 384 if b < 7 else 320, np.where(now > following, np.maximum(low - 64, 0), low))
        decays = decays | (b >= 7)
        near, far = now - fast_gain(model.fast_gain), now - SLOW_GAIN[model.slow_gain]
        quick, slow = np.where(decays, np.maximum(quick - fall, near), near), np.where(decays, np.maximum(slow - fall_slow, far), far)
        out[:, b] = np.where(decays, np.maximum(quick - low, slow), quick - low)
        if b >= 2 and known:
            decays = decays | (now <= following)
    return out


def allocate(exponents: np.ndarray, model: Model, start: int = 0, leaks: tuple[int, int] | None = None, deltas: list[tuple[int, int, int]] = (), silent: bool = False) -> np.ndarray:
    """Allocation codes of blocks (rows) of exponents (bins 0 to the end; those before ``start`` get none).

    ``deltas`` are (bands skipped, bands, code) corrections of the mask; ``silent`` says that all of a block's signal
    offsets are zero, so that nothing is allocated.
    """
    out = np.zeros(exponents.shape, np.int64)
    if not 0 <= start < exponents.shape[1] <= EDGES[-1]:
        raise ValueError("bins are out of range")
    if silent:
        return out
    power = 3072 - 128 * exponents.astype(np.int64)
    p = band_power(power, start)
    first, last = int(BAND_OF[start]), int(BAND_OF[exponents.shape[1] - 1]) + 1
    mask = excitation(p, model, first, last, leaks) + np.maximum(KNEE[model.knee] - p, 0) // 4
    mask[:, first:last] = np.maximum(mask[:, first:last], HEARING[model.rate][first:last])
    band = first
    for skipped, n, code in deltas:
        band += skipped
        if band + n > 50:
            break
        mask[:, band : band + n] += 128 * (code - 3 if code >= 4 else code - 4)
        band += n
    floor = FLOOR[model.floor]
    level = (np.maximum(mask - model.offset - floor, 0) & 0x1FE0) + floor
    above = (power - level[:, BAND_OF[: exponents.shape[1]]]) >> 5
    out[:, start:] = _CODES[np.clip(above, 0, 63)][:, start:]
    return out
