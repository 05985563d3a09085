"""Queries of maps, rings over the date line, streamers of closed lines, stays and patterns."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from stratus.operators import contours as C, jets as JT, joins as J, lines, maps, mixtures, polygons, quantiles, sequence as Q, stats as T, tracking as TR

from . import roles
from .queries import R, query, r
from .roles import DAILY, FIELD, LABELS, PATHS


def _vectors(spark, sf):
    return roles.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query()
def l04_periodic_map(spark, sf):
    """A map on a torus: each node's place, samples and mean distance."""
    x = _vectors(spark, sf)
    codebook, mean, sd = maps.train(x, "v", 6, 4, 4)
    hits = maps.assign(x, "v", codebook, mean, sd, ["vec_id"]).groupBy("node").agg(F.count("*").alias("n"), F.avg("distance").alias("distance"))
    return codebook.select("node", "x", "y").join(hits, "node", "left")


@query()
def l04_map_errors(spark, sf):
    x = _vectors(spark, sf)
    codebook, mean, sd = maps.train(x, "v", 6, 4, 4)
    return maps.sheet_errors(maps.assign(x, "v", codebook, mean, sd, []), 6, 4, True)


FOREIGN = """nodes AS (SELECT row_number() OVER (ORDER BY label) - 1 AS node, w FROM (SELECT label, list(m ORDER BY i) AS w FROM (
        SELECT label, i, round(avg(embedding[i]::DOUBLE), 4) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)),
    own AS (SELECT list(m ORDER BY i) AS m, list(CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY i) AS s FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m, stddev_pop(embedding[i]::DOUBLE) AS s FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1)),
    std AS (SELECT vec_id, list_transform(list_zip(embedding, m, s), lambda z: (z[1]::DOUBLE - z[2]) / z[3]) AS x FROM embeddings, own),
    far AS (SELECT vec_id, node, list_sum(list_transform(list_zip(x, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM std, nodes),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, node) AS k FROM far)"""


@query(f"SELECT vec_id, max(CASE WHEN k = 1 THEN node END)::INT AS node, max(CASE WHEN k = 2 THEN node END)::INT AS second, {R('sqrt(min(d))', 4)} AS distance FROM ranked GROUP BY vec_id", FOREIGN)
def l04_project_on_map(spark, sf):
    """All vectors on a map whose nodes are the labels' mean vectors."""
    x = _vectors(spark, sf)
    means = x.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 4).alias("m"))
    code = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z.m).alias("weights"))
    code = code.withColumn("node", F.row_number().over(Window.orderBy("label")) - 1)  # a row a label
    samples, _ = maps.project(x, "v", code, ["vec_id"])
    return samples.select("vec_id", "node", "second", r("distance", 4).alias("distance"))


@query("SELECT n_nationkey::BIGINT AS event, step, ilon, ilat FROM field JOIN nation ON (((lon - (n_nationkey * 12 + 60.5)) % 360) + 360) % 360 < 25 AND lat > n_regionkey * 20 - 55.5 AND lat < n_regionkey * 20 - 20.5", FIELD)
def j10_over_the_date_line(spark, sf):
    """Rectangles with corners from -180 up to 180, many over the seam."""
    n = roles.table(spark, sf, "nation")
    x, y = F.col("n_nationkey") * 12.0 + 60.5, F.col("n_regionkey") * 20.0 - 55.5
    ring = F.array(*[F.struct((F.pmod(x + a + 180.0, F.lit(360.0)) - 180.0).alias("lon"), (y + b).alias("lat")) for a, b in ((0, 0), (25, 0), (25, 35), (0, 35))])
    return J.spatial_join(n.select(F.col("n_nationkey").cast("bigint").alias("event"), ring.alias("points")), roles.field(spark, sf)).select("event", "step", "ilon", "ilat")


UNWRAPPED = """tn AS (SELECT *, coalesce(-round((lon - lag(lon) OVER w) / 360), 0) AS turn FROM paths WINDOW w AS (PARTITION BY jet_id ORDER BY index)),
    un AS (SELECT *, lon + 360 * sum(turn) OVER (PARTITION BY jet_id ORDER BY index) AS x FROM tn),
    ev AS (SELECT jet_id, min(x) AS a, max(x) AS b, min(lat) AS south, max(lat) AS north FROM un GROUP BY 1)"""


@query(f"SELECT jet_id, {R('CASE WHEN b - a >= 360 THEN -180 ELSE a - 360 * floor((a + 180) / 360) END', 4)} AS west, {R('CASE WHEN b - a >= 360 THEN 180 ELSE b - 360 * floor((a + 180) / 360) END', 4)} AS east, south, north FROM ev", PATHS, UNWRAPPED)
def g05_envelopes(spark, sf):
    out = polygons.event_envelopes(roles.paths(spark, sf), ["jet_id"], "index")
    return out.select("jet_id", r("west", 4).alias("west"), r("east", 4).alias("east"), "south", "north")


@query()
def g04_ring_streamers(spark, sf):
    """Where paths come back near themselves; every second one is closed."""
    lines = roles.paths(spark, sf).withColumn("cyclic", F.col("jet_id") % 2 == 0)
    return C.ring_streamers(lines, ["jet_id"], "index", 8e5, 3e6, 6e7, 10.0)


@query(f"SELECT member, sum(CASE WHEN label <> before THEN 1 ELSE 0 END)::BIGINT AS jumps, {R('sum(abs(label - before))')} AS distance FROM (SELECT *, lag(label) OVER (PARTITION BY member ORDER BY ord) AS before FROM labels0) GROUP BY 1 HAVING count(before) > 0", LABELS)
def w25_label_distances(spark, sf):
    far = {(a, b): float(abs(a - b)) for a in range(5) for b in range(5)}
    return Q.label_jumps(roles.labels(spark, sf), ["member"], "ord", "label", far).where("jumps is not null")


STAYS = """sp AS (SELECT member AS spell, member, arg_max(ord, (value, ord)) AS ord FROM labels0 GROUP BY member),
    ch AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY member ORDER BY ord) THEN 1 ELSE 0 END AS new, max(ord) OVER (PARTITION BY member) AS top FROM labels0),
    ru AS (SELECT *, sum(new) OVER (PARTITION BY member ORDER BY ord) AS run FROM ch),
    st AS (SELECT member, ord, max(k) AS stay FROM (SELECT a.member, a.ord, b.run, count(*) AS k FROM ru a JOIN ru b ON a.member = b.member AND b.ord BETWEEN a.ord AND a.ord + 5 WHERE a.ord + 5 <= a.top GROUP BY 1, 2, 3) GROUP BY 1, 2),
    rf AS (SELECT ord // 20 AS grp, count(*) AS windows, quantile_cont(stay, 0.9) AS threshold FROM st GROUP BY 1)"""


@query("SELECT spell, 6 AS len, stay AS longest, windows, threshold::DOUBLE AS threshold, stay >= threshold AS significant FROM sp JOIN st USING (member, ord) JOIN rf ON ord // 20 = grp", LABELS, STAYS)
def w25_longest_stays(spark, sf):
    """The six labels from each member's largest value on, against all windows of six that start in the same stretch of twenty."""
    x = roles.labels(spark, sf).withColumn("stretch", F.floor(F.col("ord") / 20))
    spells = x.groupBy("member").agg(F.max_by("ord", F.struct("value", "ord")).alias("ord")).select(F.col("member").alias("spell"), "member", "ord", F.lit(6).alias("len"))
    return Q.longest_stays(x, ["member"], "ord", "label", "stretch", spells)


@query()
def t11_seeded_mixtures(spark, sf):
    """Parameters of two components of latitude and speed for each of three stretches, every one seeded by the one before."""
    p = roles.paths(spark, sf).withColumn("period", F.least(F.floor(F.col("index") / 40), F.lit(2)).cast("int"))
    fits = mixtures.fit(p, ["lat", "s"], "period", 2, 1, tolerance=1e-3)
    rows = [(p, k, float(w[k]), *map(float, m[k]), *map(float, (c[k][0][0], c[k][1][0], c[k][1][1]))) for p, (w, m, c) in fits.items() for k in range(2)]
    return spark.createDataFrame(rows, "period int, component int, weight double, lat double, s double, var_lat double, cov double, var_s double")


@query()
def t01_quantile_jets(spark, sf):
    """Cores by each month's own 0.3 quantile of speed."""
    return JT.find_jets(roles.field(spark, sf), ["step"], (-180.0, -85.0), (10.0, 10.0), 0.3, 0.0, 0.0, 0.0, 4, 25.0, 36)


CDF = "1 / (1 + 0.2316419 * abs(z))"
RANKS = """rk AS (SELECT doy, qty, jet = 'A' AS a, row_number() OVER (PARTITION BY doy ORDER BY qty) AS i FROM daily WHERE jet IN ('A', 'R')),
    av AS (SELECT doy, a, avg(i) OVER (PARTITION BY doy, qty) AS k FROM rk),
    us AS (SELECT doy, sum(CASE WHEN a THEN k ELSE 0 END) AS r, sum(a::INT)::DOUBLE AS m, sum((NOT a)::INT)::DOUBLE AS n FROM av GROUP BY 1),
    zs AS (SELECT doy, r - m * (m + 1) / 2 AS u, (r - m * (m + 1) / 2 - m * n / 2) / sqrt(CASE WHEN m * n > 0 THEN m * n * (m + n + 1) / 12 END) AS z FROM us)"""


@query(f"SELECT doy, {R('u', 2)} AS u, {R(f'2 * (((((1.330274429 * {CDF} - 1.821255978) * {CDF} + 1.781477937) * {CDF} - 0.356563782) * {CDF} + 0.319381530) * {CDF}) * exp(-z * z / 2) / 2.5066282746310002')} AS p FROM zs WHERE z IS NOT NULL AND z <> 0", DAILY, RANKS)
def r22_mann_whitney_by_day(spark, sf):
    d = roles.daily(spark, sf).where("jet in ('A', 'R')")
    return T.mann_whitney(d, "qty", "jet", "A", ["doy"]).where("z is not null and z <> 0").select("doy", r("u", 2).alias("u"), r("p").alias("p"))


KS = """ks AS (SELECT member, sum(a) OVER w / sum(a) OVER v AS fa, sum(b) OVER w / sum(b) OVER v AS fb, sum(a) OVER v AS m, sum(b) OVER v AS n FROM (
        SELECT user_id % 4 AS member, value, sum((event_type = 'click')::INT)::DOUBLE AS a, sum((event_type = 'error')::INT)::DOUBLE AS b FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2) WINDOW w AS (PARTITION BY member ORDER BY value), v AS (PARTITION BY member)),
    kd AS (SELECT member, max(abs(fa - fb)) AS d, sqrt(any_value(m) * any_value(n) / (any_value(m) + any_value(n))) * max(abs(fa - fb)) AS l FROM ks GROUP BY 1)"""


@query(f"SELECT member, {R('d')} AS d, {R('CASE WHEN l < 0.2 THEN 1 ELSE least(1, greatest(0, list_sum(list_transform(range(1, 21), lambda k: 2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * l * l))))) END')} AS p FROM kd", KS)
def r11_ks_by_member(spark, sf):
    e = roles.table(spark, sf, "events").withColumn("member", F.col("user_id") % 4)
    return T.ks_two_sample(e, "value", "event_type", "click", "error", ["member"]).select("member", r("d").alias("d"), r("p").alias("p"))


@query()
def t05_connect_by_category(spark, sf):
    """Paths of one user cut into stretches of twenty points, tied to the next stretch if their categories are near."""
    p = roles.paths(spark, sf).withColumn("stretch", F.floor(F.col("index") / 20)).withColumnRenamed("jet_id", "user").withColumn("jet_id", F.lit(0).cast("bigint"))
    cross = TR.track(p, ["user"], "stretch", values=["s", "is_polar"])
    return TR.connect(cross, ["user"], "stretch", 4e7, 0.0, max_dis_polar=0.1)


@query()
def g01_ranked_contours(spark, sf):
    """Lines of three levels over the seam, joined up by list ranking."""
    return lines.ranked_contours(roles.field(spark, sf), "s", [18.0, 26.0, 34.0], ["step"], 36, 6)


SORTED = """lists AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type),
    places AS (SELECT event_type, v, n, q, q * (n - 1) AS p, floor(q * (n - 1))::BIGINT AS k FROM lists, (SELECT unnest([0.0::DOUBLE, 0.1, 0.5, 0.9, 0.99]) AS q))"""


@query(f"SELECT event_type, q, {R('v[k + 1] * (1 - (p - k)) + v[least(k + 2, n)] * (p - k)', 6)} AS value FROM places", SORTED)
def f26_exact_quantiles(spark, sf):
    """Quantiles of each event type, exact whatever its size."""
    out = quantiles.exact_quantiles(roles.table(spark, sf, "events"), "value", ["event_type"], [0.0, 0.1, 0.5, 0.9, 0.99])
    return out.select("event_type", "q", r("value", 6).alias("value"))
