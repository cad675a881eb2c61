"""Dense and recursive numpy kernels that Arrow functions run over one stream at a time.

From public standards: ITU-R BS.1770 (weighting, gating), the lapped transforms of ATSC A/52, windowed-sinc
resampling.  Nothing here knows of Spark.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

# The two stages of K weighting, as analogue prototypes.
SHELF_HZ, SHELF_DB, SHELF_Q, SHELF_VB = 1681.974450955533, 3.999843853973347, 0.7071752369554196, 0.4996667741545416
HIGHPASS_HZ, HIGHPASS_Q = 38.13547087602444, 0.5003270373238773
OFFSET_DB = -0.691


def k_weighting(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(b, a) of the shelf and of the high-pass at a sample rate, by the bilinear transform."""
    k, vh = math.tan(math.pi * SHELF_HZ / rate), 10 ** (SHELF_DB / 20)
    vb = vh**SHELF_VB
    a0 = 1 + k / SHELF_Q + k * k
    shelf = (np.array([vh + vb * k / SHELF_Q + k * k, 2 * (k * k - vh), vh - vb * k / SHELF_Q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / SHELF_Q + k * k) / a0]))
    k = math.tan(math.pi * HIGHPASS_HZ / rate)
    a0 = 1 + k / HIGHPASS_Q + k * k
    return [shelf, (np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / HIGHPASS_Q + k * k) / a0]))]


def biquad(b: np.ndarray, a: np.ndarray, x: np.ndarray, block: int = 256) -> np.ndarray:
    """A second-order recursive filter, a block at a time: the block's own response is a convolution with the
    impulse response, and what two past outputs add is a combination of two fixed sequences."""
    n = min(block, len(x))
    if n == 0:
        return x.astype(np.float64)
    impulse, one, two = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        impulse[i] = (1.0 if i == 0 else 0.0) - (a[1] * impulse[i - 1] if i > 0 else 0) - (a[2] * impulse[i - 2] if i > 1 else 0)
        one[i] = -a[1] * (one[i - 1] if i > 0 else 1.0) - a[2] * (one[i - 2] if i > 1 else (1.0 if i == 1 else 0.0))
        two[i] = -a[1] * (two[i - 1] if i > 0 else 0.0) - a[2] * (two[i - 2] if i > 1 else (1.0 if i == 0 else 0.0))
    f = np.convolve(x.astype(np.float64), b)[: len(x)]
    size = 1 << (2 * n - 1).bit_length()
    h = np.fft.rfft(impulse, size)
    out, y1, y2 = np.empty(len(f)), 0.0, 0.0
    for at in range(0, len(f), n):
        piece = f[at : at + n]
        m = len(piece)
        y = np.fft.irfft(np.fft.rfft(piece, size) * h, size)[:m] + y1 * one[:m] + y2 * two[:m]
        out[at : at + m] = y
        y1, y2 = (y[-1], y[-2] if m > 1 else y1)
    return out


def step_powers(x: np.ndarray, rate: int) -> np.ndarray:
    """Sums of squares of the K-weighted signal over whole steps of 100 ms."""
    for b, a in k_weighting(rate):
        x = biquad(b, a, x)
    step = rate // 10
    return (x[: len(x) // step * step] ** 2).reshape(-1, step).sum(axis=1)


def integrated(channels: list[np.ndarray], weights: list[float], rate: int, absolute: float = -70.0, relative: float = -10.0) -> float | None:
    """Gated loudness of a programme; None where nothing passes the gates."""
    length = max((len(c) for c in channels), default=0)
    p = sum(w * step_powers(np.concatenate([c, np.zeros(length - len(c))]), rate) for c, w in zip(channels, weights) if w)
    if np.ndim(p) == 0 or len(p) < 4:
        return None
    z = np.convolve(p, np.ones(4), "valid") / (4 * (rate // 10))
    loud = lambda v: OFFSET_DB + 10 * np.log10(np.maximum(v, 1e-30))
    z = z[loud(z) > absolute]
    if not len(z):
        return None
    z = z[loud(z) > loud(z.mean()) + relative]
    return float(loud(z.mean())) if len(z) else None


def loudness_range(channels: list[np.ndarray], weights: list[float], rate: int) -> float | None:
    """P95 - P10 by nearest rank of short-term loudness (3 s) past both gates."""
    p = sum(w * step_powers(c, rate) for c, w in zip(channels, weights) if w)
    if np.ndim(p) == 0 or len(p) < 30:
        return None
    z = np.convolve(p, np.ones(30), "valid") / (30 * (rate // 10))
    db = OFFSET_DB + 10 * np.log10(np.maximum(z, 1e-30))
    keep = db >= -70
    if not keep.any():
        return None
    z, db = z[keep], db[keep]
    db = np.sort(db[db >= OFFSET_DB + 10 * np.log10(z.mean()) - 20])
    at = lambda q: db[int(math.floor((len(db) - 1) * q / 100 + 0.5))]
    return float(at(95) - at(10))


def kbd_window(n: int = 256, alpha: float = 5.0) -> np.ndarray:
    """Rising half of the Kaiser-Bessel-derived window of 2n points."""
    c = np.cumsum(np.kaiser(n + 1, math.pi * alpha))
    return np.sqrt(c[:n] / c[n])


def mdct(x: np.ndarray) -> np.ndarray:
    """Lapped transform of blocks of 2n windowed samples to n coefficients (rows are blocks), by one FFT of n/2 points."""
    n = x.shape[-1] // 2
    half = n // 2
    a, b, c, d = x[..., :half], x[..., half:n], x[..., n : n + half], x[..., n + half :]
    folded = np.concatenate([-c[..., ::-1] - d, a - b[..., ::-1]], axis=-1)
    return _dct4(folded, n)


def imdct(y: np.ndarray) -> np.ndarray:
    """2n time-aliased samples of n coefficients; windowed overlap-add of ``2 imdct(mdct(x)) / n`` gives x back."""
    n = y.shape[-1]
    half = n // 2
    u = _dct4(y, n)
    p, q = u[..., :half], u[..., half:]
    return np.concatenate([q, -q[..., ::-1], -p[..., ::-1], -p], axis=-1)


@lru_cache(maxsize=16)
def _turns(n: int) -> np.ndarray:
    return np.exp(-1j * np.pi * (np.arange(n // 2) + 0.125) / n)


def _dct4(x: np.ndarray, n: int) -> np.ndarray:
    """Type-IV cosine transform of even length: even places and reversed odd ones are the parts of n/2 complex numbers."""
    w = _turns(n)
    z = np.fft.fft((x[..., ::2] + 1j * x[..., ::-1][..., ::2]) * w, axis=-1) * w
    out = np.empty(x.shape)
    out[..., ::2], out[..., ::-1][..., ::2] = z.real, -z.imag
    return out


def resample(x: np.ndarray, source: int, target: int, taps: int = 32) -> np.ndarray:
    """Windowed-sinc resampling, each output normalised by the weights that lie in the signal."""
    n = int(len(x) * target // source)
    cut = min(1.0, target / source)
    out = np.empty(n)
    for at in range(0, n, 4096):
        pos = np.arange(at, min(at + 4096, n)) * (source / target)
        base = np.floor(pos).astype(np.int64)
        idx = base[:, None] + np.arange(1 - taps, taps + 1)[None, :]
        d = pos[:, None] - idx
        window = np.where(np.abs(d) < taps, 0.42 + 0.5 * np.cos(np.pi * d / taps) + 0.08 * np.cos(2 * np.pi * d / taps), 0.0)
        w = np.sinc(d * cut) * cut * window * ((idx >= 0) & (idx < len(x)))
        out[at : at + len(pos)] = (w * x[np.clip(idx, 0, max(0, len(x) - 1))]).sum(axis=1) / w.sum(axis=1)
    return out


def true_peak_db(x: np.ndarray, times: int = 4, taps: int = 12) -> float:
    """Peak of the signal interpolated four times, in dB; -200 for silence."""
    if not len(x):
        return -200.0
    padded = np.concatenate([np.zeros(taps), x, np.zeros(taps)])
    peak = np.abs(x).max()
    for phase in range(1, times):
        d = np.arange(-taps, taps) + 0.5 - 0.5 + phase / times
        w = np.sinc(d) * (0.42 + 0.5 * np.cos(np.pi * d / taps) + 0.08 * np.cos(2 * np.pi * d / taps)) * (np.abs(d) < taps)
        peak = max(peak, np.abs(np.convolve(padded, w / w.sum(), "valid")).max())
    return 20 * math.log10(peak) if peak > 1e-10 else -200.0


def snr_db(signal: np.ndarray, actual: np.ndarray) -> float:
    noise = float(((signal - actual) ** 2).sum())
    power = float((signal**2).sum())
    return math.inf if noise == 0 else -math.inf if power == 0 else 10 * math.log10(power / noise)
