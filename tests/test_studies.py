"""Studies, jobs and the operators that SQL cannot state, against brute force and analytic cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratus.operators import aggregate as A, contours as C, graph, grid as G, joins as J, learn as L, points as P, sequence as Q, studies as U, tracking as TR
from stratus.plans import jobs, queries as plans
from stratus.sources import fields

SF = "/root/testdata/sf0.001"


def test_rows_are_numbered_without_a_global_window(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(50), i) for i in range(500)]
    got = graph.numbered(spark.createDataFrame(rows, "x bigint, id bigint").repartition(5), ["x", "id"]).collect()
    assert {(r.x, r.id): r.number for r in got} == {v: i + 1 for i, v in enumerate(sorted(rows))}


def test_wave_in_band(spark):
    n = 1000
    rows = [(0, i, math.cos(2 * math.pi * 50 * i / n) + math.cos(2 * math.pi * 200 * i / n)) for i in range(n)]
    out = G.band_pass(spark.createDataFrame(rows, "k int, step bigint, x double"), "x", ["k"], "step", 0.0, 0.1).collect()
    assert all(abs(r.filtered - math.cos(2 * math.pi * 50 * r.step / n)) < 1e-6 for r in out)


def test_linear_in_three_axes(spark):
    f = lambda t, x, y: 1 + 2 * t - x + 3 * y + 0.5 * x * y * t
    rows = [(float(t), -10.0 + 5 * i, 40.0 + 2 * j, f(t, -10.0 + 5 * i, 40.0 + 2 * j)) for t in range(3) for i in range(5) for j in range(4)]
    points = [(1, 0.25, -3.0, 41.0), (2, 1.0, 0.0, 46.0), (3, 1.9, 9.9, 40.1), (4, 2.0, 10.0, 46.0), (5, 0.5, 11.0, 41.0)]
    out = P.interp_along(spark.createDataFrame(rows, "t double, x double, y double, v double").withColumn("z", F.lit(0)), spark.createDataFrame(points, "k int, t double, x double, y double").withColumn("z", F.lit(0)), ["z"], {"t": (0.0, 1.0), "x": (-10.0, 5.0), "y": (40.0, 2.0)}, "v")
    got = {r.k: r.interp for r in out.collect()}
    assert set(got) == {1, 2, 3, 4}
    for k, t, x, y in points[:4]:
        t0, x0, y0 = math.floor(t), -10 + 5 * math.floor((x + 10) / 5), 40 + 2 * math.floor((y - 40) / 2)
        want = sum(f(t0 + a, x0 + 5 * b, y0 + 2 * c) * (t - t0 if a else 1 - (t - t0)) * ((x - x0) / 5 if b else 1 - (x - x0) / 5) * ((y - y0) / 2 if c else 1 - (y - y0) / 2) for a in (0, 1) for b in (0, 1) for c in (0, 1))
        assert abs(got[k] - want) < 1e-9


def test_nodes_in_a_triangle(spark):
    grid = spark.createDataFrame([(i, j, float(i), float(j)) for i in range(-20, 20) for j in range(-10, 10)], "ilon bigint, ilat bigint, lon double, lat double")
    ring = [(-5.5, -3.2), (7.3, -1.1), (0.4, 6.6)]
    events = spark.createDataFrame([(1, ring)], "event int, points array<struct<lon: double, lat: double>>")
    side = lambda p, q, x, y: (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])
    want = {(i, j) for i in range(-20, 20) for j in range(-10, 10) if all(side(ring[k], ring[(k + 1) % 3], i, j) > 0 for k in range(3))}
    assert {(r.ilon, r.ilat) for r in J.spatial_join(events, grid).collect()} == want


def test_greedy_label_runs(spark):
    rng = random.Random(1)
    labels = [rng.randrange(5) for _ in range(60)]
    near = {(a, b): float(abs(a - b)) for a in range(5) for b in range(5)}
    want, first = [], None
    for i, x in enumerate(labels):
        if first is None or abs(x - first) > 1:
            want.append([])
            first = x
        want[-1].append(i)
    got = Q.label_spells(spark.createDataFrame([(0, i, x) for i, x in enumerate(labels)], "m int, ord bigint, label bigint"), ["m"], "ord", "label", near, 1.0, 2).collect()
    assert sorted((r["first"], r["last"], r["len"]) for r in got) == [(w[0], w[-1], len(w)) for w in want if len(w) >= 2]


def test_medoid(spark):
    rng = np.random.default_rng(2)
    paths = {k: rng.standard_normal((4, 2)).cumsum(0) for k in range(5)}

    def frechet(a, b):
        d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
        for i in range(len(a)):
            for j in range(len(b)):
                if i or j:
                    d[i, j] = max(d[i, j], min(d[x, y] for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0))
        return d[-1, -1]

    total = {k: sum(frechet(p, q) for j, q in paths.items() if j != k) for k, p in paths.items()}
    rows = spark.createDataFrame([(0, k, [tuple(map(float, x)) for x in p]) for k, p in paths.items()], "g int, id int, path array<struct<x: double, y: double>>")
    got = TR.medoid(rows, ["g"], "id").first()
    assert got.id == min(total, key=total.get) and abs(got.total - min(total.values())) < 1e-9


def test_trend_baseline_is_logistic_regression(spark):
    rng = np.random.default_rng(3)
    rows = [(k, t, int(rng.random() < 1 / (1 + math.exp(-(0.02 * (k - 1) * (t - 100)))))) for k in range(3) for t in range(200)]
    got = U.trend_baseline(spark.createDataFrame(rows, "k int, t bigint, y int"), ["k"], "t", "y").collect()
    for k in range(3):
        y = np.array([r[2] for r in rows if r[0] == k], float)
        z = (np.arange(200) - 99.5) / np.arange(200).std()
        x, w = np.column_stack((np.ones(200), z)), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * w)
        p = 1 / (1 + np.exp(-x @ w))
        assert max(abs(r.prob - p[r.t]) for r in got if r.k == k) < 1e-6


def test_composites_of_planted_spells_stand_out(spark):
    rng = np.random.default_rng(5)
    spells = [(s, t) for s in range(5) for t in range(40 * s + 10, 40 * s + 16)]
    hot = {t for _, t in spells}
    table = spark.createDataFrame([(c, t, float(rng.standard_normal() + (5 if c == 0 and t in hot else 0))) for c in range(3) for t in range(220)], "cell int, step bigint, x double")
    rows = {r.cell: r for r in U.composite_significance(table, spark.createDataFrame(spells, "spell bigint, step bigint"), ["cell"], "step", "x", 60, 0.3).collect()}
    assert rows[0].p > 0.99 and rows[0].significant and rows[0]["mean"] > 4 and all(abs(rows[c]["mean"]) < 1 for c in (1, 2))
    props = table.where("cell = 0")
    p = A.during_pvalues(spark.createDataFrame([(0, *x) for x in spells], "cell int, spell bigint, step bigint"), props, ["cell"], "step", "x", 50).collect()
    assert len(p) == 5 and all(r.p > 0.9 and r.len == 6 for r in p)


def test_stored_results(spark):
    base, ran = graph.shared_path(spark, "results"), []
    make = lambda: ran.append(1) or spark.range(3)
    with pytest.raises(ZeroDivisionError):
        fields.materialize(spark, lambda: 1 / 0, base, {"a": 1})
    spark.range(1).write.parquet(f"{base}/broken")
    for meta in ({"a": 1, "b": [1, 2]}, {"b": [1, 2], "a": 1}, {"a": 2}):
        assert fields.materialize(spark, make, base, meta).count() == 3
    assert len(ran) == 2


def test_importances_find_the_cause(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 2))
    rows = spark.createDataFrame([(i, *map(float, v), int(v[0] + 0.3 * rng.standard_normal() > 0)) for i, v in enumerate(x)], "id bigint, a double, b double, y int")
    out = {r.feature: r for r in U.importances(rows, ["a", "b"], "y", "id", L.fold_of(F.col("id"), 3)).collect()}
    assert out["a"].permutation > 0.2 > abs(out["b"].permutation) and out["a"].corr > 0.6
    left_out = {r.feature: r.importance for r in U.leave_one_out(rows, ["a", "b"], "y", L.fold_of(F.col("id"), 2), 2).collect()}
    assert left_out["a"] > 0.5 > left_out["b"]


def test_two_zonal_jets_through_the_whole_job(spark):
    rows = [(t, i, j, -180.0 + 10 * i, 10.0 + 2 * j) for t in range(3) for i in range(30) for j in range(35)]
    df = spark.createDataFrame(rows, "step bigint, ilon bigint, ilat bigint, lon double, lat double")
    core = lambda at, width: F.exp(-F.pow((F.col("lat") - at) / width, 2.0))
    df = df.withColumns({"u": 50 * core(25.0, 6.0) + 40 * core(F.lit(57.0) + F.col("step"), 6.0), "v": F.lit(0.0)}).withColumn("s", F.hypot("u", "v"))
    jets, props, averages = jobs.jet_pipeline(df, [], "step", (-180.0, 10.0), (10.0, 2.0), s_thresh=20.0, max_gap=15.0)
    got = averages.collect()
    assert {(r.step, r.jet, r.njets) for r in got} == {(t, j, 1) for t in range(3) for j in ("EDJ", "STJ")}
    assert all(abs(r.mean_lat - (25 if r.jet == "STJ" else 57 + r.step)) < 1.5 for r in got)
    assert {r.spell for r in props.where("jet = 'STJ'").collect()} != {None} and props.select("spell").distinct().count() == 2
    smooth = lambda g: g.withColumn("s", F.col("s") * 1.0)
    from stratus.operators import jets as JT

    again = JT.find_jets(df, ["step"], (-180.0, 10.0), (10.0, 2.0), s_thresh=20.0, max_gap=15.0, smoother=smooth)
    assert again.count() == jets.count()


def test_components_give_the_data_back(spark):
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(7).standard_normal((60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").withColumn("features", array_to_vector("v"))
    out, model, scaler = L.pca(df, 4)
    assert all(np.allclose(r.restored, x[r.id]) for r in L.pca_inverse(out, model, scaler).collect())


def test_slow_pattern_comes_first(spark):
    rng = np.random.default_rng(8)
    slow, noise = np.cumsum(rng.standard_normal(400)) * 0.2, rng.standard_normal((400, 2))
    data = np.column_stack((noise[:, 0], slow, noise[:, 1]))
    from stratus.operators import stats as T

    rows = spark.createDataFrame([(k, t, float(data[t, k])) for t in range(400) for k in range(3)], "k int, t bigint, x double")
    first = np.abs(L.persistent_patterns(T.lagged_covariance(rows, "k", "t", "x", 5), 3, 5)[:, 0])
    assert first.argmax() == 1


def test_wind_on_the_axis(spark):
    rows = [(0, i, float(n), 10.0 + i, 50.0, 3.0, 4.0) for i in range(6) for n in (-1, 0, 1)]
    out = P.along_axis(spark.createDataFrame(rows, "k int, i bigint, n double, lon double, lat double, u double, v double"), ["k"], "i", "u", "v").collect()
    assert len(out) == 18 and all(abs(r.u_along - 3) < 1e-9 and abs(r.v_left - 4) < 1e-9 for r in out)


def test_selection_finds_the_cause(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 2))
    rows = spark.createDataFrame([(i, *map(float, v), int(v[1] > 0)) for i, v in enumerate(x)], "id bigint, a double, b double, y int")
    assert L.forward_select(rows, ["a", "b"], "y", L.fold_of(F.col("id"), 2), 2, 1)[0][0] == ["b"]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_queries_without_sql_run(spark, name):
    plans.QUERIES[name](spark, SF).collect()
