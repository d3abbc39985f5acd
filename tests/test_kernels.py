import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolink.operators import correlation, kernels
from chronolink.operators.diagnostics import binomial_two_sided
from chronolink.operators.evaluation import parent_aid
from chronolink.operators.memory import adf, kpss, pacf
from chronolink.operators.transforms import hp_cycle, stl_deseason


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=30))
def test_q_values_equal_the_definition(p):
    q = kernels.bh(np.array(p))
    s = sorted(p)
    for a, b in zip(p, q):
        want = min(1.0, min(x * len(p) / (s.index(x) + s.count(x)) for x in s if x >= a)) if a > 0 else 0.0
        assert b >= a - 1e-15 and abs(b - max(a, want)) < 1e-9


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=3, max_size=25))
def test_kendall_equals_the_definition(pairs):
    x, y = (np.array(c, float) for c in zip(*pairs))
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    den = math.sqrt((np.sign(x[:, None] - x) ** 2).sum() * (np.sign(y[:, None] - y) ** 2).sum())
    got = correlation.kendall_tau(x, y)
    assert math.isnan(got) if den == 0 else abs(got - s.sum() / den) < 1e-9


def test_distance_correlation_equals_double_centring():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=60), rng.normal(size=60) ** 2
    a, b = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    c = lambda m: m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    cov, va, vb = (c(a) * c(b)).mean(), (c(a) ** 2).mean(), (c(b) ** 2).mean()
    got = correlation.distance_correlation(x, y, block=7)
    assert got == pytest.approx((math.sqrt(cov / math.sqrt(va * vb)), math.sqrt(cov)))
    assert correlation.distance_correlation(5 * x, y)[0] == pytest.approx(got[0])


def test_surrogates_keep_what_they_should():
    x = np.cumsum(np.random.default_rng(2).normal(size=128))
    rng = np.random.default_rng(3)
    assert np.allclose(np.sort(kernels.iaaft(x, rng)), np.sort(x))
    assert np.allclose(np.abs(np.fft.rfft(kernels.phase(x, rng))), np.abs(np.fft.rfft(x)))
    assert np.allclose(np.sort(kernels.blocks(x, rng)), np.sort(x))


def test_tails_and_tests():
    # closed forms: one degree of freedom is Cauchy's distribution; F with two numerator degrees is a power
    r = 0.5
    assert kernels.t_p(r, 1) == pytest.approx(1 - 2 / math.pi * math.atan(r / math.sqrt(1 - r * r)))
    assert kernels.f_p(4.0, 2, 100) == pytest.approx((1 + 2 * 4.0 / 100) ** -50)
    assert kernels.f_p(4.0, 1, 98) == pytest.approx(kernels.t_p(math.sqrt(4 / (4 + 98)), 98))
    rng = np.random.default_rng(4)
    e = rng.normal(size=400)
    assert adf(e)[1] < 0.01 and kpss(e)[1] > 0.05
    assert adf(np.cumsum(e))[1] > 0.05 and kpss(np.cumsum(e))[1] <= 0.05
    assert binomial_two_sided(8, 10, 0.5) == pytest.approx(0.109375)
    assert pacf(np.array([0.6**k for k in range(1, 6)]))[1:] == pytest.approx(np.zeros(4), abs=1e-12)


def test_filters():
    t = np.arange(120)
    assert np.abs(hp_cycle(3.0 + 2.0 * t)).max() < 1e-6
    y = 0.05 * t + np.sin(2 * np.pi * t / 12)
    assert np.abs(stl_deseason(y, 12)[24:-24] - 0.05 * t[24:-24]).max() < 0.1


def test_lingam_finds_the_order():
    rng = np.random.default_rng(5)
    a = rng.uniform(-1, 1, 2000)
    b = 0.8 * a + rng.uniform(-1, 1, 2000)
    order, b0 = kernels.direct_lingam(np.column_stack([b, a]))
    assert order == [1, 0] and b0[0, 1] == pytest.approx(0.8, abs=0.05)


def test_conditional_information_screens_off():
    rng = np.random.default_rng(6)
    z = rng.normal(size=300)
    m = np.column_stack([z + 0.3 * rng.normal(size=300), z + 0.3 * rng.normal(size=300), z])
    test = kernels.CMIKnn(m, k=10, surrogates=19)
    assert test.test(0, 1, [])[1] <= 0.05 and test.test(0, 1, [2])[1] > 0.05
    assert kernels.GPDC(m, surrogates=19).test(0, 1, [2])[1] > 0.05


def test_adjustment_distance():
    chain = {("a", "b"), ("b", "c")}
    assert parent_aid(chain, chain, ["a", "b", "c"]) == 0
    assert parent_aid({("c", "b"), ("b", "a")}, chain, ["a", "b", "c"]) > 0
