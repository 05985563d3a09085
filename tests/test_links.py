"""Frechet distances, thresholds by time, nearest nodes over ranges, and p-values, against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from stratus.functions.sphere import haversine
from stratus.operators import jets as JT, joins as J, stats as T, tracking as TR


def programme(a, b):
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    for i in range(len(a)):
        for j in range(len(b)):
            before = [d[i - 1, j]] * (i > 0) + [d[i, j - 1]] * (j > 0) + [d[i - 1, j - 1]] * (i > 0 and j > 0)
            d[i, j] = max(d[i, j], min(before)) if before else d[i, j]
    return d[-1, -1]


def test_frechet_of_many_pairs(spark):
    rng = np.random.default_rng(0)
    walk = lambda: rng.standard_normal((rng.integers(1, 25), 2)).cumsum(0)
    pairs = [(walk(), walk()) for _ in range(120)]
    want = [programme(a, b) for a, b in pairs]
    assert np.allclose(TR.frechet_of(*map(list, zip(*pairs))), want)
    rows = [(i, [tuple(map(float, p)) for p in a], [tuple(map(float, p)) for p in b]) for i, (a, b) in enumerate(pairs)] + [(900, None, [(1.0, 2.0)]), (901, [], [(1.0, 2.0)])]
    df = spark.createDataFrame(rows, "k int, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    got = {r.k: (r.f, r.low) for r in df.select("k", TR.frechet(F.col("a"), F.col("b")).alias("f"), F.when(F.size("a") > 0, TR.least_frechet(F.col("a"), F.col("b"))).alias("low")).collect()}
    assert got[900][0] is None and got[901][0] is None
    assert np.allclose([got[i][0] for i in range(120)], want) and all(got[i][1] <= want[i] + 1e-9 for i in range(120))


def test_bound_leaves_out_what_is_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(t, j, i, float(10 * i + j), float(40 + 5 * j + rng.uniform(-2, 2)), 10.0) for t in range(3) for j in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "step bigint, jet_id bigint, index bigint, lon double, lat double, s double")
    whole = TR.track(df, [], "step").where("dist <= 7e5").drop("ds").collect()
    assert 0 < len(whole) < 18 and sorted(whole) == sorted(TR.track(df, [], "step", within=7e5).drop("ds").collect())


def test_thresholds_by_time(spark):
    """Each time's cores are those of its own quantile as a fixed threshold."""
    rows = []
    for t, top in ((0, 40.0), (1, 15.0)):
        for i in range(30):
            for j in range(30):
                lat = 20.0 + 2 * j
                s = top * math.exp(-(((lat - 45) / 8) ** 2))
                rows.append((t, i, j, i * 10.0 - 180, lat, s, 0.0, s))
    df = spark.createDataFrame(rows, "step bigint, ilon bigint, ilat bigint, lon double, lat double, u double, v double, s double")
    find = lambda x, s, **k: {tuple(round(v, 6) for v in r) for r in JT.find_jets(x, ["step"], (-180.0, 20.0), (10.0, 2.0), s, max_gap=15.0, **k).select("step", "lon", "lat", "s").collect()}
    cut = {t: float(np.quantile([r[7] for r in rows if r[0] == t], 0.7)) for t in (0, 1)}
    want = set().union(*(find(df.where(F.col("step") == t), cut[t]) for t in (0, 1)))
    assert {r[0] for r in want} == {0, 1}
    assert find(df, 0.7) == want == find(df, 0.0, thresholds=spark.createDataFrame(list(cut.items()), "step bigint, s_thresh double"))
    assert {r[0] for r in find(df, 20.0)} == {0}


def test_nearest_over_ranges(spark):
    rng = random.Random(2)
    asked, axis = [rng.uniform(-50, 150) for _ in range(400)] + [3.0, None], [rng.uniform(0, 100) for _ in range(7)] + [2.0, 4.0]
    got = J.nearest_map(spark.createDataFrame([(x,) for x in asked], "x double"), spark.createDataFrame([(x,) for x in axis], "x double"), "x").collect()
    assert len(got) == 401 and all(r.nearest == min(axis, key=lambda a: (abs(a - r.x), a)) for r in got)
    assert {r.nearest for r in J.nearest_map(spark.createDataFrame([(1.0,)], "x double"), spark.createDataFrame([], "x double"), "x").collect()} == {None}


def test_p_values(spark):
    rng = np.random.default_rng(3)
    x, y = np.arange(30.0), rng.standard_normal(30) + 0.03 * np.arange(30)
    r = T.linear_trend(spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "k int, x double, y double"), "y", "x", ["k"]).first()
    slope = np.polyfit(x, y, 1)[0]
    rho = np.corrcoef(x, y)[0, 1]
    t = rho * math.sqrt(28 / (1 - rho * rho))
    grid = np.linspace(abs(t), 400, 2_000_001)
    density = math.gamma(14.5) / (math.sqrt(28 * math.pi) * math.gamma(14)) * (1 + grid**2 / 28) ** -14.5
    assert math.isclose(r.slope, slope) and math.isclose(r.t, t) and math.isclose(r.p, 2 * np.trapezoid(density, grid), rel_tol=1e-5)
    a, b = rng.standard_normal(40), rng.standard_normal(50) + 0.6
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b]
    u = sum((p > q) + 0.5 * (p == q) for p in a for q in b)
    z = (u - 1000) / math.sqrt(40 * 50 * 91 / 12)
    m = T.mann_whitney(spark.createDataFrame(rows, "g string, v double"), "v", "g", "a", []).first()
    assert m.u == u and math.isclose(m.z, z) and math.isclose(m.p, math.erfc(abs(z) / math.sqrt(2)), abs_tol=1e-6)
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in np.concatenate((a, b)))
    k = T.ks_two_sample(spark.createDataFrame(rows, "g string, v double"), "v", "g", "a", "b").first()
    lam = math.sqrt(40 * 50 / 90) * d
    assert math.isclose(k.d, d) and math.isclose(k.p, 2 * sum((-1) ** (i - 1) * math.exp(-2 * i * i * lam * lam) for i in range(1, 60)), rel_tol=1e-9)


def test_distance_of_a_null_point_is_null(spark):
    df = spark.createDataFrame([(0.0, 0.0, None, 1.0), (0.0, 0.0, 180.0, 0.0)], "a double, b double, c double, d double")
    assert [r[0] is None for r in df.select(haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [True, False]
