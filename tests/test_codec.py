"""Integer stages: round trips and bounds, by random inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolake.functions import codec
from sonolake.sources.elementary import Bits, put


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 24), min_size=1, max_size=60), st.sampled_from(sorted(codec.SPAN)))
def test_exponents(values, strategy):
    e = np.array(values)
    first, groups, decoded = codec.encode_exponents(e, strategy)
    assert (decoded == codec.decode_exponents(first, groups, strategy, len(e))).all()
    assert (decoded <= e).all() and len(decoded) == len(e) and 0 <= first <= 15


def test_exponents_keep_smooth_ones():
    e = np.array([4, 5, 7, 6, 4, 4, 5])
    assert (codec.encode_exponents(e, "D15")[2] == e).all()
    with pytest.raises(ValueError):
        codec.decode_exponents(0, [125], "D15", 4)
    with pytest.raises(ValueError):
        codec.decode_exponents(0, [0], "D15", 4)


@pytest.mark.parametrize("code", range(16))
def test_mantissas(code):
    x = np.linspace(-0.999, 0.999, 501)
    y = codec.dequantise_mantissa(codec.quantise_mantissa(x, code), code)
    step = 2.0 if code == 0 else 1 / codec.LEVELS[code] if code in codec.LEVELS else 2.0 ** -(codec.BITS[code] - 1)
    assert np.abs(x - y).max() <= step + 1e-9
    if code in (1, 2, 4):
        q = codec.quantise_mantissa(x, code).tolist()
        assert codec.ungroup_mantissas(codec.group_mantissas(q, code), code, len(q)) == q


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 1 << 40), st.sampled_from([2, 4, 5, 8, 11]))
def test_variable_bits(value, n):
    reader = Bits(put(codec.variable_bits(value, n)))
    assert codec.read_variable_bits(reader.read, n) == value


def test_deltas_and_tags():
    c = np.random.default_rng(1).integers(0, 96, 50)
    assert (codec.undelta_codes(codec.delta_codes(c, 96), 96) == c).all()
    t = codec.tag(b"k", b"data")
    assert [codec.verify(k, b"data", x) for k, x in ((b"k", t), (b"j", t), (None, t), (b"k", None))] == ["valid", "invalid", "no key", "unsigned"]


def test_apply(spark):
    df = spark.createDataFrame([(1, [3, 62]), (2, None), (3, [200])], "id int, g array<int>")
    got = codec.apply(df, lambda g: int(codec.decode_exponents(5, g, "D15", 2)[-1]), "g", "e", "long").collect()
    assert [r["e"] for r in got] == [3, None, None]
