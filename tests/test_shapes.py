"""Maps, polygons, streamers, automata, mixtures and patterns against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratus.operators import automata, contours as C, maps, mixtures, patterns, polygons, sequence as Q

# self-organising maps ---------------------------------------------------------------------------------------------------


def vectors(spark, x, *more):
    rows = [(i, [float(c) for c in v], "a") for i, v in enumerate(x)] + [(1000 + i, v, "b") for i, v in enumerate(more)]
    return spark.createDataFrame(rows, "k bigint, vec array<double>, v string").repartition(3)


def test_torus_distances():
    gap = maps.hex_distances(6, 4, True)
    assert np.allclose(gap, gap.T) and all(((gap[i] > 0) & (gap[i] < 1.01)).sum() == 6 for i in range(24))
    assert gap[0, 5] == 1 and maps.hex_distances(6, 4, False)[0, 5] == 5
    with pytest.raises(ValueError):
        maps.hex_distances(6, 3, True)


def test_nearest_two_nodes_over_blocks(monkeypatch):
    monkeypatch.setattr(maps, "NODES", 3)
    monkeypatch.setattr(maps, "SAMPLES", 7)
    rng = np.random.default_rng(0)
    x, code = rng.standard_normal((50, 4)), rng.standard_normal((10, 4))
    first, second, d = maps.nearest(x, code)
    full = ((x[:, None] - code[None]) ** 2).sum(2)
    order = full.argsort(1, kind="stable")
    assert (first == order[:, 0]).all() and (second == order[:, 1]).all() and np.allclose(d, full.min(1))
    assert (maps.nearest(x, code[:1])[1] == -1).all()


def test_map_finds_a_ring_over_the_seam(spark):
    rng = np.random.default_rng(1)
    angle = np.repeat(np.arange(24) * 2 * np.pi / 24, 15)
    x = np.column_stack((np.cos(angle), np.sin(angle), 0.3 * np.cos(2 * angle))) + 0.02 * rng.standard_normal((360, 3))
    df = vectors(spark, x, None, [1.0, None, 2.0], [1.0, float("nan"), 0.0], [1.0, 2.0, float("inf")])
    codebook, mean, sd = maps.train(df, "vec", 12, 2, 8)
    assert np.allclose(mean, x.mean(0)) and np.allclose(sd, x.std(0))
    z, gap = (x - mean) / sd, maps.hex_distances(12, 2, True)
    code = maps.start(12, 2, 3, True)
    for e in range(8):  # the same batch map in one place
        best = ((z[:, None] - code[None]) ** 2).sum(2).argmin(1)
        total, n = np.zeros_like(code), np.bincount(best, minlength=24)
        np.add.at(total, best, z)
        h = np.exp(-(gap**2) / (2 * (4 * (0.3 / 4) ** (e / 7)) ** 2))
        code = (h @ total) / (h @ n)[:, None]
    assert np.allclose(np.array([r.weights for r in codebook.orderBy("node").collect()]), code, atol=1e-6)
    samples = maps.assign(df, "vec", codebook, mean, sd, ["k", "v"])
    node = {r.k: r.node for r in samples.collect()}
    assert len(node) == 360
    centre = [node[i * 15] for i in range(24)]
    around = [gap[a, b] for a, b in zip(centre, centre[1:] + centre[:1])]
    assert max(around) <= 1.8 and len(set(centre)) >= 12  # neighbours on the ring are neighbours on the torus, the last and first too
    flat = maps.hex_distances(12, 2, False)
    assert max(flat[a, b] for a, b in zip(centre, centre[1:] + centre[:1])) > 5  # though the sheet's edges lie between some of them
    errors = maps.sheet_errors(samples, 12, 2, True).first()
    assert errors.n == 360 and errors.topographic < 0.35 and errors.quantisation < 0.6


def test_projection_on_a_foreign_map(spark):
    rng = np.random.default_rng(2)
    x = 5 + 3 * rng.standard_normal((80, 3))
    code = spark.createDataFrame([(i, rng.standard_normal(3).tolist()) for i in range(5)], "node int, weights array<double>")
    w = np.array([r.weights for r in code.orderBy("node").collect()])
    samples, centres = maps.project(vectors(spark, x), "vec", code, ["k"])
    best = ((((x - x.mean(0)) / x.std(0))[:, None] - w[None]) ** 2).sum(2).argmin(1)
    assert {r.k: r.node for r in samples.collect()} == dict(enumerate(best.tolist()))
    assert all(np.allclose(r.centre, x[best == r.node].mean(0)) and r.n == (best == r.node).sum() for r in centres.collect())
    none = vectors(spark, [])
    assert maps.train(none, "vec", 4, 2, 3)[0].count() == 0


# polygons ---------------------------------------------------------------------------------------------------------------


def ray(ring, lon, lat, wrap=True):
    """Even-odd test of a point against a ring, in each turn of longitudes."""
    x = [ring[0][0]]
    for a, b in zip(ring, ring[1:]):
        step = b[0] - a[0]
        x.append(x[-1] + step - 360 * (math.copysign(math.floor(abs(step) / 360 + 0.5), step) if wrap else 0))
    pts = [(p, q[1]) for p, q in zip(x, ring)]
    end = pts[-1][0] + (((ring[0][0] - ring[-1][0]) + 180) % 360 - 180 if wrap else ring[0][0] - ring[-1][0])
    if wrap and abs(end - pts[0][0]) > 180:
        pole = -90.0 if sum(q for _, q in pts) < 0 else 90.0
        pts += [(end, pts[0][1]), (end, pole), (pts[0][0], pole)]
    hit = False
    for turn in range(-3, 4):
        odd = False
        for (x0, y0), (x1, y1) in zip(pts, pts[1:] + pts[:1]):
            if (y0 > lat) != (y1 > lat) and lon + 360 * turn < (x1 - x0) * (lat - y0) / (y1 - y0) + x0:
                odd = not odd
        hit |= odd
    return hit


RINGS = {
    "seam in plain numbers": [(172.0, -20.3), (188.0, -20.3), (188.0, 15.2), (172.0, 15.2)],
    "seam": [(171.5, -11.0), (-169.5, -12.0), (-171.0, 30.5), (169.3, 28.7)],
    "concave over the seam": [(160.0, -30.2), (-150.0, -30.2), (-150.0, 30.1), (-170.0, 30.1), (-170.0, -5.4), (175.0, -5.4), (175.0, 33.3), (160.0, 33.3)],
    "around the south pole": [(i * 40.0 - 180.0, -62.0 - (i % 2) * 9.7) for i in range(9)],
    "westward around the north pole": [(175.0 - i * 30.0, 50.3 + (i % 3) * 4.1) for i in range(12)],
    "small": [(9.0, 9.2), (16.0, 9.3), (12.6, 16.9)],
}


@pytest.mark.parametrize("zero", [False, True])
def test_nodes_inside_rings(spark, zero):
    rng = random.Random(3)
    nodes = [(i, j, i * 5.0 + (0.0 if zero else -180.0), j * 5.0 - 85.0) for i in range(72) for j in range(35)]
    nodes += [(1000 + i, 0, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(300)]
    star = [(((170 + (28 if i % 2 else 11) * math.cos(i * math.pi / 8) + 180) % 360) - 180, (28 if i % 2 else 11) * math.sin(i * math.pi / 8) + 0.123) for i in range(16)]
    rings = {**RINGS, "star": star}
    grid = spark.createDataFrame(nodes, "ilon bigint, ilat bigint, lon double, lat double").withColumn("x", F.lit("clash"))
    events = spark.createDataFrame([(k, [(float(a), float(b)) for a, b in v]) for k, v in rings.items()], "event string, points array<struct<lon: double, lat: double>>")
    got = {}
    for r in polygons.nodes_inside(events, grid.drop("x")).collect():
        key = (r.ilon, r.ilat)
        assert key not in got.setdefault(r.event, set())
        got[r.event].add(key)
    for name, ring in rings.items():
        want = {(i, j) for i, j, lon, lat in nodes if ray(ring, lon, lat)}
        assert want and got[name] == want, name
    flat = spark.createDataFrame([("wide", [(-170.0, -10.0), (170.0, -10.0), (170.0, 10.5), (-170.0, 10.5)])], "event string, points array<struct<lon: double, lat: double>>")
    assert {(r.ilon, r.ilat) for r in polygons.nodes_inside(flat, grid.drop("x"), wrap=False).collect()} == {(i, j) for i, j, lon, lat in nodes if ray(flat.first().points, lon, lat, False)}
    assert polygons.nodes_inside(events.limit(0), grid.drop("x")).count() == 0


def test_envelopes(spark):
    lines = {1: [(170.0, 1.0), (179.0, 2.0), (-175.0, 5.0), (178.0, 7.0)], 2: [(-179.0, 0.0), (179.0, 1.0), (175.0, -4.0)], 3: [(i * 30.0 % 360 - 180, 60.0) for i in range(14)], 4: [(5.0, 5.0)]}
    points = spark.createDataFrame([(k, i, a, b) for k, v in lines.items() for i, (a, b) in enumerate(v)], "event int, index bigint, lon double, lat double")
    got = {r.event: (r.west, r.east, r.south, r.north, [p.lon for p in r.points]) for r in polygons.event_envelopes(points, ["event"], "index").collect()}
    assert got[1] == (170.0, 185.0, 1.0, 7.0, [170.0, 179.0, 185.0, 178.0])
    assert got[2] == (175.0, 181.0, -4.0, 1.0, [181.0, 179.0, 175.0])
    assert got[3][:2] == (-180.0, 180.0) and got[4][:4] == (5.0, 5.0, 5.0, 5.0)


# streamers --------------------------------------------------------------------------------------------------------------


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6.371e6 * math.asin(math.sqrt(min(1.0, h)))


def brute_streamers(line, cyclic, reach, low, high, ratio, share):
    n = len(line)
    s = np.concatenate(([0.0], np.cumsum([metres(a, b) for a, b in zip(line, line[1:])])))
    total = s[-1] + metres(line[-1], line[0])
    pairs = []
    for i in range(n):
        for j in range(i + 1, n):
            d = metres(line[i], line[j])
            ahead = s[j] - s[i]
            forward = not cyclic or ahead <= total - ahead
            along = ahead if forward else total - ahead
            if d < reach and low < along < high and along > ratio * d:
                pairs.append((i, j, d, (i if forward else j, j - i if forward else n - (j - i))))
    mi, mj = {}, {}
    for i, j, d, _ in pairs:
        mi[i], mj[j] = min(d, mi.get(i, 1e18)), min(d, mj.get(j, 1e18))
    arcs = [(a, d) for i, j, d, a in pairs if d == mi[i] == mj[j]]
    points = lambda a: {(a[0] + k) % n for k in range(a[1] + 1)}
    arcs = [(a, d) for a, d in arcs if not any(b[1] > a[1] and {a[0], (a[0] + a[1]) % n} <= points(b) for b, _ in arcs)]
    group = list(range(len(arcs)))
    for x, (a, _) in enumerate(arcs):
        for y, (b, _) in enumerate(arcs):
            if x < y and len(points(a) & points(b)) > share * (min(a[1], b[1]) + 1):
                group = [group[x] if g == group[y] else g for g in group]
    return sorted((sorted(set().union(*(points(arcs[k][0]) for k in range(len(arcs)) if group[k] == g))), sum(x == g for x in group)) for g in set(group))


@pytest.mark.parametrize("stretch", [64, 7])
def test_streamers_of_closed_lines(spark, monkeypatch, stretch):
    monkeypatch.setattr(C, "STRETCH", stretch)
    rng = random.Random(5)

    def around(n, base, tongues, start):
        """A line round the globe with narrow tongues to the south."""
        out = []
        for i in range(n):
            lon = (start + 360.0 * i / n + 180) % 360 - 180
            out.append((lon, base + rng.uniform(-0.2, 0.2)))
            for centre, depth in tongues:
                if abs((lon - centre + 180) % 360 - 180) < 180.0 / n + 1e-9:
                    out += [(lon, base - k * 1.5) for k in range(1, depth)] + [((lon + 3.5 + 180) % 360 - 180, base - k * 1.5) for k in range(depth, 0, -1)]
        return out

    lines = {1: (around(70, 55.0, [(-120.0, 16), (30.0, 11)], -170.0), True), 2: (around(80, 50.0, [(178.0, 15)], 177.5), True), 3: (around(60, 52.0, [(0.0, 14), (90.0, 9)], -170.0)[:-3], False)}
    k = 12  # a ring whose first point lies within a tongue
    lines[4] = (lines[1][0][k:] + lines[1][0][:k], True)
    at = next(i for i, p in enumerate(lines[1][0]) if p[1] < 40)
    lines[5] = (lines[1][0][at:] + lines[1][0][:at], True)
    points = spark.createDataFrame([(m, i, a, b, c) for m, (line, c) in lines.items() for i, (a, b) in enumerate(line)], "line int, index bigint, lon double, lat double, cyclic boolean")
    got = C.ring_streamers(points, ["line"], "index", 8e5, 1.5e6, 1.5e7, 4.0)
    found = {}
    for r in got.collect():
        found.setdefault(r.line, []).append((sorted({(r.start + s) % r.n for s in range(r["size"] + 1)}), r.pairs))
    for m, (line, c) in lines.items():
        assert sorted(found.get(m, [])) == brute_streamers(line, c, 8e5, 1.5e6, 1.5e7, 4.0, 0.8), m
    assert len(found[1]) == 2 and len(found[2]) == 1 and len(found[5]) == 2
    steps = C.streamer_points(got, points, ["line"], "index").where("line = 2").orderBy("step").collect()
    assert len(steps) == len(found[2][0][0]) and min(r.lat for r in steps) < 32
    assert C.ring_streamers(points.limit(0), ["line"], "index", 8e5, 1.5e6, 1.5e7, 4.0).count() == 0


# automata ---------------------------------------------------------------------------------------------------------------


def greedy(labels, near):
    first, out = None, []
    for t, x in labels:
        if first is None or not near(first, x):
            first, start = x, t
        out.append((t, x, start))
    return out


@pytest.mark.parametrize("steps", [4, 32, 1024])
def test_scan_is_the_walk(spark, steps):
    rng = random.Random(steps)
    far = np.array([[abs(a - b) if (a + b) % 5 else np.nan for b in range(6)] for a in range(6)])
    series = {k: [(t, rng.randrange(6)) for t in range(low, low + n) if rng.random() < 0.8] for k, low, n in ((0, -300, 700), (1, 0, 3), (2, 399, 1), (3, -299, 150))}
    df = spark.createDataFrame([(k, t, x) for k, v in series.items() for t, x in v] + [(0, None, 1), (1, 7, None)], "k int, t bigint, x int").repartition(3)
    near = lambda a, b: a == b if np.isnan(far[a, b]) else far[a, b] <= 1
    got = automata.scan(df, ["k"], "t", "x", *automata.greedy_runs(far, 1.0), steps)
    want = [(k, t, x, s) for k, v in series.items() for t, x, s in greedy(v, near)]
    assert sorted((r.k, r.t, r.x, r.since) for r in got.collect()) == sorted(want)
    assert automata.scan(df.limit(0), ["k"], "t", "x", *automata.greedy_runs(far, 1.0), steps).count() == 0


def test_label_runs_with_nulls_and_unknown_labels(spark):
    labels = ["a", "b", "a", "c", None, None, "a", "d", "d", "c", "b"]
    near = {("a", "b"): 1.0, ("b", "a"): 1.0, ("a", "a"): 0.0, ("c", "b"): 1.0}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "t bigint, label string").withColumn("k", F.lit(1))
    got = [(r.run, r.first, r.last, r.len, r.value) for r in Q.label_spells(df, ["k"], "t", "label", near, 1.0).orderBy("run").collect()]
    assert got == [(0, 0, 2, 3, "a"), (1, 3, 3, 1, "c"), (2, 4, 5, 2, None), (3, 6, 6, 1, "a"), (4, 7, 8, 2, "d"), (5, 9, 10, 2, got[5][4])]


# mixtures ---------------------------------------------------------------------------------------------------------------


def em(x, w, m, c, rounds):
    for _ in range(rounds):
        log = np.stack([np.log(w[k]) - 0.5 * np.linalg.slogdet(2 * np.pi * c[k])[1] - 0.5 * np.einsum("ni,ij,nj->n", x - m[k], np.linalg.inv(c[k]), x - m[k]) for k in range(len(w))], 1)
        r = np.exp(log - log.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        n = r.sum(0)
        w, m = n / len(x), (r.T @ x) / n[:, None]
        c = np.stack([(r[:, k, None] * (x - m[k])).T @ (x - m[k]) / n[k] + 1e-6 * np.eye(x.shape[1]) for k in range(len(w))])
    return w, m, c


def test_mixtures_of_all_periods(spark):
    rng = np.random.default_rng(7)
    data = {p: np.concatenate([rng.multivariate_normal((300 + 3 * p, 50), [[9, 2], [2, 20]], 120), rng.multivariate_normal((330 + 3 * p, 30), [[16, -3], [-3, 12]], 90)]) for p in range(4)}
    rows = [(p, i, float(a), float(b), "x") for p, v in data.items() for i, (a, b) in enumerate(v)] + [(1, 900, None, 3.0, "x"), (1, 901, 3.0, float("nan"), "x"), (9, 902, None, None, "x"), (None, 903, 1.0, 2.0, "x")]
    df = spark.createDataFrame(rows, "week int, i int, theta double, lat double, x0 string").withColumnRenamed("x0", "c9").repartition(3)
    fits = mixtures.fit(df, ["theta", "lat"], "week", 2, 0, 2, 40, 1e-9)
    assert sorted(fits) == [0, 1, 2, 3]
    for p, x in data.items():
        w, m, c = em(x, np.array([0.5, 0.5]), np.array([[300.0 + 3 * p, 50], [330 + 3 * p, 30]]), np.stack([np.cov(x.T) / 4] * 2), 200)
        order = np.argsort(fits[p][1][:, 0])
        assert np.allclose(fits[p][0][order], w, atol=1e-3) and np.allclose(fits[p][1][order], m, atol=0.02) and np.allclose(fits[p][2][order], c, rtol=0.01, atol=0.05)
    assert len({tuple(np.argsort(f[1][:, 0])) for f in fits.values()}) == 1  # components keep their places
    for mode in ("score", "probability"):
        got = {(r.week, r.i): r.is_polar for r in mixtures.categorise(df, ["theta", "lat"], "week", fits, 0, True, mode).collect()}
        assert len(got) == len(rows) and [got[k] for k in ((1, 900), (9, 902), (None, 903))] == [None] * 3
        w, m, c = fits[2]
        hot = int(np.argmax(m[:, 0]))
        far = np.stack([np.sqrt(np.einsum("ni,ij,nj->n", data[2] - m[k], np.linalg.inv(c[k]), data[2] - m[k])) for k in (hot, 1 - hot)])
        if mode == "score":
            assert np.allclose([got[2, i] for i in range(210)], 1 / (1 + far[1] / far[0]))
        assert np.mean([got[2, i] > 0.5 for i in range(120)]) > 0.97 and np.mean([got[2, i] < 0.5 for i in range(120, 210)]) > 0.97
    assert mixtures.fit(df.limit(0), ["theta", "lat"], "week") == {}


def test_a_period_starts_from_the_one_before(spark):
    df = spark.createDataFrame([(p, float(v + 2 * p)) for p in range(3) for v in (0, 1, 2, 8, 9, 10)], "p int, x double")
    fits = mixtures.fit(df, ["x"], "p", 2, 0, 3, 5)
    assert all(np.allclose(f[1][:, 0], [1 + 2 * p, 9 + 2 * p], atol=0.2) for p, f in fits.items())


# patterns ---------------------------------------------------------------------------------------------------------------


def long(spark, m, cells="bigint"):
    return spark.createDataFrame([(t, i, float(v)) for t, row in enumerate(m) for i, v in enumerate(row)], f"step bigint, cell {cells}, v double").repartition(3)


def test_coupled_patterns(spark):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((80, 15)), rng.standard_normal((80, 9))
    b[:, 0] += 6 * a[:, 2]
    b[:, 3] += 3 * a[:, 5]
    extra = long(spark, rng.standard_normal((3, 15))).withColumn("step", F.col("step") + 500)
    left, right, cov = patterns.coupled_patterns(long(spark, a).unionByName(extra), long(spark, b), "step", "cell", "v", 2, rounds=3)
    u, s, vt = np.linalg.svd((a - a.mean(0)).T @ (b - b.mean(0)) / 79)
    assert np.allclose(cov, s[:2], rtol=1e-6)
    for table, want in ((left, u.T), (right, vt)):
        got = np.zeros((2, want.shape[1]))
        for r in table.collect():
            got[r.pattern, r.cell] = r.loading
        assert np.allclose(np.abs(got), np.abs(want[:2]), atol=1e-5)
        if table is left:
            assert all(row[np.abs(row).argmax()] > 0 for row in got)


def test_patterns_of_low_rank_and_of_nothing(spark):
    t = np.sin(np.arange(40))[:, None]
    left, right, cov = patterns.coupled_patterns(long(spark, t @ np.array([[1.0, 2.0, 2.0]])), long(spark, t @ np.array([[3.0, 4.0]])), "step", "cell", "v", 3)
    assert len(cov) == 1 and np.allclose(sorted(r.loading for r in left.collect()), [1 / 3, 2 / 3, 2 / 3]) and np.allclose(sorted(r.loading for r in right.collect()), [0.6, 0.8])
    none = long(spark, t).limit(0)
    assert [x.count() for x in patterns.coupled_patterns(none, none, "step", "cell", "v", 2)[:2]] == [0, 0]
    assert patterns.coupled_patterns(long(spark, t[:1]), long(spark, t[:1]), "step", "cell", "v", 2)[2] == []


def test_principal_patterns(spark):
    rng = np.random.default_rng(6)
    x = np.outer(rng.standard_normal(60), rng.standard_normal(50)) * 3 + np.outer(rng.standard_normal(60), rng.standard_normal(50)) + 0.1 * rng.standard_normal((60, 50))
    found, scores, variances = patterns.principal_patterns(long(spark, x), "step", "cell", "v", 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(variances, values[::-1][:2], rtol=1e-6)
    for k in range(2):
        own = [r.score for r in scores.where(F.col("pattern") == k).orderBy("step").collect()]
        assert np.allclose(np.abs(own), np.abs((x - x.mean(0)) @ vectors[:, -1 - k]), atol=1e-4)
