"""Bit allocation against fixed vectors of the public integer model, and its invariants."""

import numpy as np

from sonolake.functions.allocation import BAND_OF, EDGES, Model, allocate, log_add

# Exponents and allocation codes.
LOUD = ([2, 3, 4, 6, 9, 14, 20], [10, 10, 10, 10, 9, 7, 0])
RISING = ([20, 18, 14, 10, 6, 3, 1], [0, 3, 8, 12, 15, 15, 15])
RANDOM_E = [
    4, 24, 15, 16, 9, 5, 5, 21, 8, 5, 24, 1, 13, 15, 18, 3, 6, 9, 17, 4, 3, 15, 2, 20, 10, 11, 24, 15, 2, 15, 5, 0, 7, 11, 22, 9, 0,
    17, 11, 17, 22, 14, 13, 12, 9, 20, 12, 21, 8, 0, 11, 9, 3, 22, 7, 9, 1, 6, 0, 11, 3, 21, 2, 19, 22, 10, 0, 12, 21, 19, 13, 0, 9,
]
RANDOM_B = [
    12, 0, 7, 7, 11, 12, 12, 0, 10, 12, 0, 12, 0, 0, 0, 12, 10, 7, 0, 12, 12, 0, 12, 0, 3, 3, 0, 0, 12, 0, 9, 12, 5, 0, 0, 1, 12,
    0, 0, 0, 0, 0, 0, 0, 3, 0, 1, 0, 6, 12, 0, 1, 9, 0, 5, 1, 11, 6, 12, 0, 9, 0, 10, 0, 0, 1, 12, 0, 0, 0, 0, 12, 1,
]
# Of exponents 17, 22, 8, 13, 18, 4, 9, 14, 19, 5, 10, 15, 20, 6, 11, 16, 21, 7, 12 in turn from bin 109 to 217.
TURN = [17, 22, 8, 13, 18, 4, 9, 14, 19, 5, 10, 15, 20, 6, 11, 16, 21, 7, 12]
COUPLED = [
    0, 0, 6, 0, 0, 10, 5, 0, 0, 9, 3, 0, 0, 9, 3, 0, 0, 8, 1, 0, 0, 7, 1, 0, 10, 4, 0, 0, 9, 3, 0, 0, 8, 1, 0, 0, 7,
    0, 0, 0, 6, 0, 0, 10, 4, 0, 0, 9, 3, 0, 0, 8, 2, 0, 0, 7, 1, 0, 0, 6, 0, 0, 10, 5, 0, 0, 9, 3, 0, 0, 8, 2, 0, 0, 7,
    0, 0, 0, 6, 0, 0, 10, 4, 0, 0, 9, 2, 0, 0, 8, 1, 0, 0, 7, 0, 0, 0, 5, 0, 0, 9, 3, 0, 0, 8, 1, 0, 0,
]
# A ramp of exponents, bin div 11, with the mask of bands 10 to 14 lowered by four steps: codes up to bin 45.
CUT = [10] * 10 + [14, 13, 14, 14, 14] + [10] * 7 + [9] + [10] * 5 + [9] * 5 + [8] + [9] * 10 + [8, 8]


def one(e, model, **more):
    return allocate(np.array([e]), model, **more)[0].tolist()


def test_vectors():
    assert one(LOUD[0], Model()) == LOUD[1]
    assert one(RISING[0], Model(coarse=30, fine=8)) == RISING[1]
    assert one(RANDOM_E, Model(1, 25, 3, floor=7)) == RANDOM_B
    assert one([24] * 253, Model()) == [0] * 253


def test_coupling_channel():
    e = [24] * 109 + (TURN * 6)[:108]
    got = one(e, Model(coarse=22, fine=9), start=109, leaks=(0, 0))
    assert got[:109] == [0] * 109 and got[109:] == COUPLED


def test_mask_corrections():
    e = [k // 11 for k in range(253)]
    got = one(e, Model(), deltas=[(10, 5, 0)])
    assert got[:46] == CUT
    assert one(e, Model(), deltas=[(48, 5, 7)]) == one(e, Model())


def test_rows_are_independent_and_silence_gets_nothing():
    e = np.random.default_rng(3).integers(0, 25, (40, 181))
    whole = allocate(e, Model(2, 15, 15, 0, 3, 3, 0, 4, 7))
    assert all((allocate(e[i : i + 1], Model(2, 15, 15, 0, 3, 3, 0, 4, 7))[0] == whole[i]).all() for i in range(40))
    assert not allocate(e, Model(), silent=True).any()
    assert (allocate(e, Model(coarse=40)) >= allocate(e, Model(coarse=20))).all()


def test_bands_and_sums():
    assert EDGES[-1] == len(BAND_OF) == 253 and BAND_OF[[27, 28, 49, 252]].tolist() == [27, 28, 35, 49]
    assert log_add(np.array([0, 100, 0]), np.array([0, 0, 500])).tolist() == [64, 127, 500]
