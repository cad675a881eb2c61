"""Kernels against compliance vectors, closed forms and round trips."""

import math

import numpy as np
import pytest

from sonolake.functions import kernels
from sonolake.operators import programme
from sonolake.sources import wav

RATE = 48000


def tone(db, seconds, hz=1000.0, rate=RATE):
    return 10 ** (db / 20) * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def test_stereo_tone_reads_its_level():
    x = tone(-20, 10)
    assert abs(kernels.integrated([x, x], [1.0, 1.0], RATE) + 20.0) < 0.1


def test_loudness_range_of_two_levels():
    x = np.concatenate([tone(-40, 20), tone(-20, 20)])
    assert abs(kernels.loudness_range([x, x], [1.0, 1.0], RATE) - 20) < 1


def test_silence_and_short_programmes_have_no_loudness():
    assert kernels.integrated([np.zeros(RATE)], [1.0], RATE) is None
    assert kernels.integrated([np.ones(100)], [1.0], RATE) is None
    assert kernels.integrated([], [], RATE) is None


def test_biquad_equals_the_recursion():
    b, a = kernels.k_weighting(RATE)[0]
    x = np.random.default_rng(1).standard_normal(1000)
    want = np.zeros(1000)
    for n in range(1000):
        want[n] = sum(b[k] * x[n - k] for k in range(3) if n >= k) - sum(a[k] * want[n - k] for k in (1, 2) if n >= k)
    assert np.allclose(kernels.biquad(b, a, x), want, atol=1e-9)
    assert np.allclose(kernels.biquad(b, a, x, 7), want, atol=1e-9)


def test_transform_is_the_sum_of_cosines_and_inverts():
    n = 16
    x = np.random.default_rng(2).standard_normal(2 * n)
    want = [sum(x[t] * math.cos(math.pi / n * (t + 0.5 + n / 2) * (k + 0.5)) for t in range(2 * n)) for k in range(n)]
    assert np.allclose(kernels.mdct(x), want)
    w = kernels.kbd_window(n)
    assert np.allclose(w**2 + w[::-1] ** 2, 1)


def test_resampling_keeps_a_tone():
    x = tone(-6, 0.5, 997, 44100)
    y = kernels.resample(x, 44100, 48000)
    want = tone(-6, 0.5, 997)
    assert kernels.snr_db(want[500:-500], y[500 : len(want) - 500]) > 60


def test_true_peak_between_samples():
    x = np.sin(np.pi / 2 * np.arange(400) + np.pi / 4)
    assert abs(np.abs(x).max() - math.sqrt(0.5)) < 1e-9 and abs(kernels.true_peak_db(x)) < 0.3
    assert kernels.true_peak_db(np.zeros(9)) == -200


@pytest.fixture(scope="module")
def files(spark):
    a = np.stack([tone(-20, 2), tone(-20, 2)])
    b = np.stack([tone(-12, 1, 300), np.zeros(RATE)])
    rows = [("a.wav", wav.build(RATE, a)), ("b.wav", wav.build(RATE, b, 16)), ("bad.wav", b"RIFFxxxxWAVE"), ("not.wav", b"")]
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def test_wav_round_trip_and_errors(files):
    pcm = wav.blocks(files)
    assert {r["file_id"] for r in pcm.where("error IS NOT NULL").collect()} == {"bad.wav", "not.wav"}
    back = {r["file_id"]: wav.parse(bytes(r["content"])) for r in wav.write(pcm).collect()}
    assert back["a.wav"][0] == RATE and np.allclose(back["a.wav"][1][0], tone(-20, 2), atol=1e-6)
    assert np.allclose(back["b.wav"][1][0], tone(-12, 1, 300), atol=1 / 32768)
    with pytest.raises(ValueError):
        wav.build(RATE, np.zeros((0, 5)))


def test_clamped_data_chunk():
    whole = wav.build(RATE, np.ones((1, 10), np.float32))
    assert wav.parse(whole[:-12])[1].shape == (1, 7)


def test_programme_loudness(files):
    got = {r["file_id"]: r for r in programme.loudness(wav.blocks(files)).collect()}
    assert abs(got["a.wav"]["lkfs"] + 20) < 0.1 and abs(got["a.wav"]["true_peak_db"] + 20) < 0.2
    x = [tone(-12, 1, 300), np.zeros(RATE)]
    assert abs(got["b.wav"]["lkfs"] - kernels.integrated(x, [1.0, 1.0], RATE)) < 0.01


def test_spectra_round_trip(files):
    s = programme.spectra(wav.blocks(files.where("path = 'a.wav'")))
    back = programme.synthesise(s).where("channel = 0").first()["samples"]
    assert kernels.snr_db(tone(-20, 2), np.array(back)[: 2 * RATE]) > 100
