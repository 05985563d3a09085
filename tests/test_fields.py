"""Analytic fields, paths and graphs."""

import math

import numpy as np
from pyspark.sql import functions as F

from stratus.functions.sphere import OMEGA, RADIUS, destination, haversine
from stratus.operators import aggregate as A, contours as C, graph, grid as G, jets as JT, points as P, stats as T, tracking as TR
from stratus.sources import fields as S


def grid(spark, f, nlon=36, nlat=17, dlon=10.0, lat0=-80.0, dlat=10.0):
    data = []
    for j in range(nlat):
        for i in range(nlon):
            lon, lat = -180.0 + dlon * i, lat0 + dlat * j
            data.append((0, i, j, lon, lat, *map(float, f(lon, lat))))
    return spark.createDataFrame(data, "step bigint, ilon bigint, ilat bigint, lon double, lat double, u double, v double")


def test_solid_rotation(spark):
    df = grid(spark, lambda lon, lat: (10 * math.cos(math.radians(lat)), 0), dlat=1.0, lat0=-8.0)
    out = G.relative_vorticity(df, ["step"]).where("abs(lat) < 7 and ilon > 0 and ilon < 35").collect()
    for r in out:
        assert abs(r.vorticity - 2 * 10 * math.sin(math.radians(r.lat)) / RADIUS) < 1e-9
    assert all(abs(r.divergence) < 1e-12 for r in G.divergence(df, "u", "v", ["step"]).collect())
    total = G.absolute_vorticity(df, ["step"]).where("ilat = 8 and ilon = 5").first()
    assert abs(total.abs_vorticity - 2 * OMEGA * math.sin(math.radians(total.lat)) - 2 * 10 * math.sin(math.radians(total.lat)) / RADIUS) < 1e-9


def test_bilinear_is_exact_on_a_plane(spark):
    df = grid(spark, lambda lon, lat: (2 + 3 * lon - lat, 0))
    pts = spark.createDataFrame([(0, 1, 12.3, 33.3), (0, 2, -101.0, -7.5), (0, 3, 20.0, 30.0), (0, 4, 20.0, 89.0)], "step bigint, k int, lon double, lat double")
    out = {r.k: r.u_interp for r in P.bilinear(pts, df, ["step"], ["u"], (-180.0, -80.0), (10.0, 10.0)).collect()}
    assert set(out) == {1, 2, 3}
    assert abs(out[1] - (2 + 3 * 12.3 - 33.3)) < 1e-6 and abs(out[2] - (2 - 303 + 7.5)) < 1e-6 and abs(out[3] - 32) < 1e-6


def test_destination_and_distance(spark):
    lon, lat = destination(F.lit(10.0), F.lit(20.0), F.lit(0.7), F.lit(5e5))
    r = spark.range(1).select(haversine(F.lit(10.0), F.lit(20.0), lon, lat).alias("d")).first()
    assert abs(r.d - 5e5) < 1e-3


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 6)]
    edges = spark.createDataFrame([*chain, *star, (200, 200), (41 + 1, 42)], "a bigint, b bigint")
    out = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert {out[i] for i in range(41)} == {0} and {out[100 + i] for i in range(6)} == {100} and out[200] == 200 and out[42] == 42
    back = {r.node: r.component for r in graph.connected_components(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).collect()}
    assert back == out


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(0)
    for n, m in ((30, 20), (60, 80)):
        pairs = rng.integers(0, n, (m, 2)).tolist()
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
        assert got == {x: find(x) for p in pairs for x in p}


def test_closed_and_open_contours(spark):
    circle = grid(spark, lambda lon, lat: (math.hypot(lon, lat), 0), nlon=36, nlat=17)
    out = C.contours(circle, "u", [45.0], ["step"], min_points=4).collect()
    assert out and all(r.cyclic for r in out) and len({r.contour for r in out}) == 1
    assert all(abs(math.hypot(r.lon, r.lat) - 45) < 2 for r in out)
    flat = grid(spark, lambda lon, lat: (lat, 0))
    line = C.contours(flat, "u", [15.0], ["step"], min_points=4).collect()
    assert len(line) == 36 and not line[0].cyclic and all(abs(r.lat - 15) < 1e-9 for r in line)
    assert [r.lon for r in sorted(line, key=lambda r: r["index"])] == sorted(r.lon for r in line)


def test_zonal_jet(spark):
    df = grid(spark, lambda lon, lat: (50 * math.exp(-(((lat - 45) / 8) ** 2)), 0), nlon=30, nlat=30, dlat=2.0, lat0=20.0).withColumn("s", F.hypot("u", "v"))
    out = JT.find_jets(df, ["step"], (-180.0, 20.0), (10.0, 2.0), s_thresh=20.0, max_gap=15.0)
    rows = out.collect()
    assert rows and {r.jet_id for r in rows} == {0} and all(abs(r.lat - 45) < 1.5 and r.alignment > 0.99 for r in rows)
    props = JT.jet_properties(out, ["step", "jet_id"]).first()
    assert abs(props.mean_lat - 45) < 1.5 and abs(props.tilt) < 1e-6 and props.s_star > 45 and abs(props.wavinessR16) < 1e-6


def test_frechet_and_tracking(spark):
    data = [(t, 0, i, float(i), 30.0 + t, 30.0) for t in range(5) for i in range(10)]
    jets = spark.createDataFrame(data, "step bigint, jet_id bigint, index bigint, lon double, lat double, s double")
    cross = TR.track(jets, [], "step").orderBy("step").collect()
    assert len(cross) == 4 and all(r.lon_overlap == 1.0 for r in cross)
    y = [RADIUS * math.log(math.tan(math.radians(45 + lat / 2))) for lat in (30, 31)]
    assert abs(cross[0].dist - (y[1] - y[0])) < 1e-3
    spells = TR.connect(TR.track(jets, [], "step"), [], "step", 1e6, 0.5).collect()
    assert len(spells) == 5 and len({r.spell for r in spells}) == 1


def brute_frechet(a, b):
    d = [[math.dist(p, q) for q in b] for p in a]
    c = [[0.0] * len(b) for _ in a]
    for i in range(len(a)):
        for j in range(len(b)):
            before = [c[x][y] for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            c[i][j] = max(d[i][j], min(before)) if before else d[i][j]
    return c[-1][-1]


def test_frechet_against_brute_force(spark):
    rng = np.random.default_rng(1)
    sets = [(k, rng.random((int(rng.integers(1, 7)), 2)).tolist(), rng.random((int(rng.integers(1, 7)), 2)).tolist()) for k in range(20)]
    df = spark.createDataFrame([(k, [tuple(p) for p in a], [tuple(p) for p in b]) for k, a, b in sets], "k int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = {r.k: r.d for r in df.select("k", TR.frechet(F.col("a"), F.col("b")).alias("d")).collect()}
    for k, a, b in sets:
        assert abs(got[k] - brute_frechet(a, b)) < 1e-12


def test_bootstrap_and_fdr(spark):
    times = spark.range(100).withColumnRenamed("id", "step")
    spells = spark.createDataFrame([(0, s) for s in (5, 6, 7)] + [(1, s) for s in (20, 21)], "spell int, step bigint")
    out = T.bootstrap_times(spells, times, "step", 8)
    assert out.count() == 9 * 5
    assert {(r.spell, r.step) for r in out.where("sample_index = 8").collect()} == {(0, 5), (0, 6), (0, 7), (1, 20), (1, 21)}
    steps = out.where("sample_index = 3 and spell = 0").orderBy("inside_index").collect()
    assert [b.step - a.step for a, b in zip(steps, steps[1:])] == [1, 1]
    p = spark.createDataFrame(list(enumerate([0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216])), "cell int, p double")
    assert T.fdr(p, "p", 0.05, ["cell"], "bh").where("significant").count() == 2


def test_student_tail(spark):
    df = spark.createDataFrame([(2.228138852, 10.0, 0.05), (1.0, 5.0, 0.36321746764912263), (0.0, 3.0, 1.0)], "t double, n double, p double")
    assert all(abs(r.got - r.p) < 1e-7 for r in df.select("p", T.student_p("t", "n").alias("got")).collect())


def test_dense_round_trip(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0, None, 5.0, 6.0])], "step int, values array<double>")
    long = S.grid_to_long(df, "values", 2, 3, (0.0, 10.0), (1.0, 5.0))
    assert long.where("ilat = 1 and ilon = 1").first().value == 5.0
    assert S.long_to_grid(long, ["step"], "value", 2, 3).first()["values"] == [1.0, 2.0, 3.0, None, 5.0, 6.0]


def test_anomalies_average_to_zero(spark):
    df = spark.createDataFrame([(g, m, float(g * m + i)) for g in (0, 1) for m in (1, 2) for i in range(5)], "g int, m int, x double")
    out = A.anomaly(df, ["x"], ["g"], "m").groupBy("g", "m").agg(F.avg("x").alias("x")).collect()
    assert all(abs(r.x) < 1e-12 for r in out)
