"""Quantiles by refined histograms against numpy."""

import math

import numpy as np
import pytest

from stratus.operators.quantiles import exact_quantiles

AT = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def test_against_sorting(spark):
    rng = np.random.default_rng(2)
    groups = {
        0: rng.standard_normal(3000),
        1: np.exp(rng.standard_normal(2000) * 60),
        2: rng.integers(0, 3, 1500).astype(float),
        3: np.array([7.5]),
        4: np.array([-1.7e308, 1.7e308, 5e-324, 0.0, 1.0]),
        None: np.full(50, 2.0),
    }
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [(0, None), (0, float("nan")), (9, None)]
    got = {(r.k, r.q): r.value for r in exact_quantiles(spark.createDataFrame(rows, "k int, x double"), "x", ["k"], AT).collect()}
    assert set(got) == {(k, q) for k in groups for q in AT}
    for k, x in groups.items():
        x = np.sort(x)
        for q in AT:
            p = q * (len(x) - 1)
            a, b = x[int(p)], x[min(int(p) + 1, len(x) - 1)]
            want = a if a == b or p == int(p) else a * (1 - (p - int(p))) + b * (p - int(p))
            assert got[k, q] == want or math.isclose(got[k, q], want, rel_tol=1e-12), (k, q)


def test_infinite_none_and_bounds(spark):
    rows = [(-math.inf,), (1.0,), (2.0,), (3.0,), (math.inf,)]
    got = {r.q: r.value for r in exact_quantiles(spark.createDataFrame(rows, "x double"), "x", [], [0.0, 0.25, 0.625, 1.0]).collect()}
    assert got == {0.0: -math.inf, 0.25: 1.0, 0.625: 2.5, 1.0: math.inf}
    assert exact_quantiles(spark.createDataFrame([], "k int, x double"), "x", ["k"], AT).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(spark.createDataFrame(rows, "x double"), "x", [], [1.5])
