"""Lines joined up by list ranking against the walk in one group, which takes the same pieces."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from stratus.operators import contours as C, lines

SCHEMA = "step bigint, ilon int, ilat int, lon double, lat double, s double"


def noisy(spark, steps, nlon, nlat, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for step in steps:
        v = rng.standard_normal((nlon, nlat)).cumsum(axis=0).cumsum(axis=1)
        rows += [(step, i, j, i * 360.0 / nlon - 180.0, j * 5.0 - 60.0, float(v[i, j])) for i in range(nlon) for j in range(nlat)]
    return spark.createDataFrame(rows, SCHEMA)


def walked(rows):
    out = defaultdict(dict)
    for r in rows:
        assert r["index"] not in out[r.step, r.level, r.contour]
        out[r.step, r.level, r.contour][r["index"]] = (round(r.lon, 9), round(r.lat, 9), r.cyclic, r.len)
    return out


def test_equal_to_the_walk(spark):
    df = noisy(spark, [0, 1, None], 14, 11, 3).unionByName(noisy(spark, [7], 14, 11, 4).withColumn("s", F.lit(1.0)))
    args = (df, "s", [-2.0, 0.0, 3.0], ["step"], None, 3)
    want, got = walked(C.contours(*args).collect()), walked(lines.ranked_contours(*args).collect())
    assert got == want and len(want) > 8 and {p[0][2] for p in want.values()} == {True, False}
    assert any(k[0] is None for k in got)


def test_over_the_seam(spark):
    df = noisy(spark, [0, 1], 18, 11, 5)
    # Both sides of the seam name the same nodes, whose order the walk takes from the first piece that it meets.
    shape = lambda out: sorted((k[0], k[1], p[0][2], p[0][3], sorted((round(v[0] % 360, 6), v[1]) for v in p.values())) for k, p in out.items())
    args = (df, "s", [-2.0, 1.0], ["step"], 18, 3)
    got = walked(lines.ranked_contours(*args).collect())
    assert shape(got) == shape(walked(C.contours(*args).collect()))
    for p in got.values():
        assert sorted(p) == list(range(p[0][3]))
        for i in range(len(p) - (not p[0][2])):
            a, b = p[i], p[(i + 1) % len(p)]
            assert abs((a[0] - b[0] + 180) % 360 - 180) <= 20 + 1e-9 and abs(a[1] - b[1]) <= 5 + 1e-9


def test_long_lines_and_none(spark):
    """A meandering line of over two hundred points, whose places along it are known; an empty grid has no lines."""
    rows = [(0, i, j, float(i), float(j), float(j - 4.3 - 3 * np.sin(i / 3))) for i in range(150) for j in range(10)]
    out = lines.ranked_contours(spark.createDataFrame(rows, SCHEMA), "s", [0.0], ["step"]).orderBy("index").collect()
    assert len(out) > 200 and [r["index"] for r in out] == list(range(len(out))) and not out[0].cyclic
    assert out[0].lon == 0.0 and out[-1].lon == 149.0 and all(abs(a.lon - b.lon) <= 1 and abs(a.lat - b.lat) <= 1 for a, b in zip(out, out[1:]))
    assert lines.ranked_contours(spark.createDataFrame([], SCHEMA), "s", [0.0], ["step"]).count() == 0
