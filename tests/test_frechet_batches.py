"""Frechet distances over Arrow lists: no Python step a pair."""

import numpy as np
import pyarrow as pa

from stratus.operators import tracking as TR


def test_distances_come_from_lists_as_they_are():
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    p = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 2.0, "y": 0.0}], None, [], [{"x": 5.0, "y": 5.0}]]
    q = [[{"x": 0.0, "y": 3.0}, {"x": 2.0, "y": 4.0}], [{"x": 1.0, "y": 1.0}], [{"x": 1.0, "y": 1.0}], [{"x": 5.0, "y": 6.0}, {"x": 8.0, "y": 9.0}]]
    a, b = pa.array([p[3], *p], kind).slice(1), pa.array([q[3], *q], kind).slice(1)
    got = TR._frechet(a, b).to_numpy()
    assert np.allclose(got, [4.0, np.nan, np.nan, 5.0], equal_nan=True)
    pair = TR.frechet_of([np.array([[0.0, 0], [1, 0], [2, 0]])], [np.array([[0.0, 3], [2, 4]])])
    assert pair[0] == got[0]
