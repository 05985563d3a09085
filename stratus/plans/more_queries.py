"""More queries over the test tables: sources, cleaning, joins, grids, geometry, statistics and learning."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from stratus.functions import measures as M, sphere as S
from stratus.operators import aggregate as A, contours as C, graph, grid as G, jets as JT, joins as J, learn as L, points as P, select as E, sequence as Q, stats as T, studies as U, tracking as TR
from stratus.sources import fields

from . import roles
from .queries import DDX, FULL, WINDOWS, R, _full, _spells, ddy, query, r
from .roles import DAILY, FIELD, LABELS, MEMBERS, PATHS, SERIES

AXES = (-180.0, -85.0), (10.0, 10.0)


def _dated(spark, sf):
    return roles.daily(spark, sf).withColumn("time", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")))


def _at_steps(spark, sf):
    """Path points, each at one of the field's steps of 1995."""
    return roles.paths(spark, sf).withColumn("step", F.lit(1995 * 12).cast("bigint") + F.col("index") % 12)


AT = f"at0 AS (SELECT *, {1995 * 12} + index % 12 AS step FROM paths)"


# sources ----------------------------------------------------------------------------------------------------------------


@query("SELECT step, ilon, ilat, s AS value FROM field WHERE step // 12 IN (1994, 1996)", FIELD)
def s01_read_fields(spark, sf):
    path = graph.shared_path(spark, "store")
    f = roles.field(spark, sf).withColumn("year", F.floor(F.col("step") / 12))
    both = f.select("year", "step", "ilon", "ilat", F.explode(F.array(*[F.struct(F.lit(c).alias("var"), F.col(c).alias("value")) for c in ("s", "u")])).alias("x"))
    both = both.select("year", "step", "ilon", "ilat", "x.*").withColumns({"dataset": F.lit("test"), "level_type": F.lit("surface"), "resolution": F.lit("10")})
    fields.write_table(both, path, ["dataset", "level_type", "var", "resolution", "year"])
    return fields.read_fields(spark, path, "test", "surface", "s", "10", (1994, 1996)).select("step", "ilon", "ilat", "value")


@query("SELECT step, ilon, ilat, ilon * 10.0 - 180 AS lon, ilat * 10.0 - 85 AS lat, s AS value FROM (SELECT * FROM (SELECT DISTINCT step FROM field), (SELECT unnest(range(36)) AS ilon), (SELECT unnest(range(18)) AS ilat)) LEFT JOIN (SELECT step, ilon, ilat, s FROM field) USING (step, ilon, ilat)", FIELD)
def s05_grid_and_back(spark, sf):
    dense = fields.long_to_grid(roles.field(spark, sf), ["step"], "s", 18, 36)
    return fields.grid_to_long(dense, "values", 18, 36, *AXES).select("step", "ilon", "ilat", "lon", "lat", "value")


@query("SELECT day, jet, qty, year FROM daily", DAILY)
def s06_write_and_read(spark, sf):
    path = graph.shared_path(spark, "daily")
    fields.write_table(roles.daily(spark, sf).select("day", "jet", "qty", "year"), path)
    return fields.read_table(spark, path).select("day", "jet", "qty", F.col("year").cast("bigint").alias("year"))


@query("SELECT CAST(DATE '1970-01-01' + day::INTEGER AS VARCHAR) AS time, sum(qty)::DOUBLE AS qty FROM daily GROUP BY day", DAILY)
def s07_series_text(spark, sf):
    path = graph.shared_path(spark, "series")
    d = _dated(spark, sf).groupBy("time").agg(F.sum("qty").cast("double").alias("qty"))
    d.select(F.concat_ws("  ", F.year("time"), F.month("time"), F.day("time"), "qty")).write.text(path)
    return fields.read_series_text(spark, path, ["year", "month", "day", "qty"]).select(F.col("time").cast("string").alias("time"), "qty")


@query("SELECT jet, year, sum(qty) AS qty FROM daily GROUP BY 1, 2", DAILY)
def s08_materialize(spark, sf):
    base = graph.shared_path(spark, "results")
    make = lambda: roles.daily(spark, sf).groupBy("jet", "year").agg(F.sum("qty").alias("qty"))
    fields.materialize(spark, make, base, {"table": "daily", "by": ["jet", "year"]})
    return fields.materialize(spark, lambda: spark.range(0), base, {"by": ["jet", "year"], "table": "daily"})


@query(f"SELECT step, lon, lat, s, dense_rank() OVER (ORDER BY lat) - 1 AS ilat, dense_rank() OVER (ORDER BY lon) - 1 AS ilon FROM (SELECT step, ((lon + 360 + 180) % 360) - 180 AS lon, lat, s FROM field)", FIELD)
def s09_standardize(spark, sf):
    f = roles.field(spark, sf).select("step", (F.col("lon") + 360).alias("longitude"), F.col("lat").alias("latitude"), F.col("s").alias("ws"))
    return fields.latitude_order(fields.standardize(f)).select("step", "lon", "lat", "s", "ilat", "ilon")


@query("SELECT step, ilon, ilat, s FROM field WHERE (ilon, ilat) IN (SELECT n_nationkey, n_regionkey * 4 FROM nation)", FIELD)
def s10_land_mask(spark, sf):
    land = roles.table(spark, sf, "nation").select(F.col("n_nationkey").alias("ilon"), (F.col("n_regionkey") * 4).alias("ilat"))
    return fields.land_mask(roles.field(spark, sf), land).select("step", "ilon", "ilat", "s")


@query("SELECT year, count(*) AS n, sum(qty) AS qty FROM daily WHERE year IN (1994, 1995, 1996) GROUP BY year", DAILY)
def s11_append_year(spark, sf):
    path, d = graph.shared_path(spark, "years"), _dated(spark, sf).select("time", "qty", "jet")
    for year in (1994, 1995, 1996, 1995):  # the second run of a year replaces it
        fields.append_year(d.where(F.year("time") == year), path)
    return spark.read.parquet(path).groupBy(F.col("year").cast("bigint").alias("year")).agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


# selection and cleaning -------------------------------------------------------------------------------------------------


@query("SELECT day, jet, price, disc FROM daily WHERE month IN (6, 7, 8) AND price IS NOT NULL AND disc IS NOT NULL", DAILY)
def f06_select_features(spark, sf):
    return E.select_features(_dated(spark, sf), ["price", "disc"], ["day", "jet"], "JJA")


@query(f"SELECT day, jet, {R('price')} AS price FROM daily", DAILY)
def f09_unscale(spark, sf):
    return E.unscale(E.minmax_scale(roles.daily(spark, sf), ["price"]), ["price"]).select("day", "jet", r("price").alias("price"))


@query(f"SELECT day, jet, {R('CASE WHEN count(*) OVER (PARTITION BY jet) > 1 THEN price END')} AS price FROM daily", DAILY)
def f10_zscore_inverse(spark, sf):
    d = roles.daily(spark, sf)
    return E.zscore_inverse(E.zscore(d, ["price"], ["jet"]), ["price"], d, ["jet"]).select("day", "jet", r("price").alias("price"))


KEPT = "kept AS (SELECT *, avg(is_polar) OVER (PARTITION BY jet_id) AS p FROM paths), modes AS (SELECT jet_id, int FROM (SELECT jet_id, int, row_number() OVER (PARTITION BY jet_id ORDER BY count(*) DESC, int) AS k FROM (SELECT jet_id, floor(s / 10) AS int FROM paths) GROUP BY 1, 2) WHERE k = 1)"


@query("SELECT jet_id, index, CASE WHEN p > 0.5 THEN 'EDJ' ELSE 'STJ' END AS jet FROM kept JOIN modes USING (jet_id) WHERE p <= 0.5 OR int > 1", PATHS, KEPT)
def f13_keep_large(spark, sf):
    p = roles.paths(spark, sf).withColumn("int", F.floor(F.col("s") / 10))
    return E.keep_large(p, ["jet_id"], 1).select("jet_id", "index", "jet")


@query("SELECT member, ord, CASE WHEN label = 3 THEN m ELSE label END AS label FROM labels0 LEFT JOIN (SELECT member, label AS m FROM (SELECT member, label, row_number() OVER (PARTITION BY member ORDER BY count(*) DESC, label) AS k FROM labels0 WHERE label <> 3 GROUP BY 1, 2) WHERE k = 1) USING (member)", LABELS)
def f15_fill_mode(spark, sf):
    x = roles.labels(spark, sf).withColumn("label", F.when(F.col("label") != 3, F.col("label")))
    return E.fill_mode(x, "label", ["member"]).select("member", "ord", "label")


@query("SELECT member, ord, CASE WHEN label NOT IN (1, 2) THEN value END AS value FROM labels0", LABELS)
def f16_non_finite(spark, sf):
    bad = F.when(F.col("label") == 1, F.lit(float("nan"))).when(F.col("label") == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return E.non_finite_to_null(roles.labels(spark, sf).withColumn("value", bad)).select("member", "ord", "value")


@query(f"SELECT jet_id, index, {R('round(lon * 2 + 3.1e-9) / 2')} AS half_lon FROM paths", PATHS)
def f17_round_half(spark, sf):
    return roles.paths(spark, sf).select("jet_id", "index", r(M.round_to(F.col("lon") + 1.55e-9, 2)).alias("half_lon"))


@query("SELECT min(lon) <= -170 AND max(lon) >= 165 AS periodic FROM field", FIELD)
def f18_periodic_lon(spark, sf):
    return E.is_periodic_lon(roles.field(spark, sf), 10.0)


@query("SELECT member, ord, label = 0 AS is_0, label = 1 AS is_1, label = 4 AS is_4 FROM labels0", LABELS)
def f19_label_mask(spark, sf):
    return E.label_mask(roles.labels(spark, sf), "label", [0, 1, 4]).select("member", "ord", "is_0", "is_1", "is_4")


OUTLIERS = "mag AS (SELECT event_id, value, floor(log10(abs(nullif(value, 0)))) AS b FROM events), often AS (SELECT b, count(*) AS n FROM mag WHERE b IS NOT NULL GROUP BY b HAVING count(*) >= 30), isl AS (SELECT b, n, b - row_number() OVER (ORDER BY b) AS i FROM often), best AS (SELECT min(b) AS lo, max(b) AS hi FROM isl GROUP BY i ORDER BY sum(n) DESC, lo LIMIT 1)"


@query("SELECT event_id, CASE WHEN b BETWEEN lo AND hi THEN value END AS value FROM mag, best", OUTLIERS)
def f21_magnitude_outliers(spark, sf):
    e = roles.table(spark, sf, "events").select("event_id", F.when(F.col("value") != 0, F.col("value")).alias("value"))
    return E.magnitude_outliers(e, "value", 30)


@query("SELECT CASE WHEN min(lat) < 0 AND max(lat) > 0 AND abs(log10(max(lat)) - log10(-min(lat))) <= 2 THEN 0 WHEN greatest(max(lat), 0) > -least(min(lat), 0) THEN 1 ELSE -1 END::BIGINT AS direction FROM paths", PATHS)
def f23_direction(spark, sf):
    return E.infer_direction(roles.paths(spark, sf), "lat")


ROWS = "jrows AS (SELECT *, jet || '-' || spell AS sp, DATE '1970-01-01' + (step // 4)::INTEGER AS time FROM rows_)"


@query("SELECT jet, spell, step FROM jrows WHERE year(time) = (SELECT max(year(b.time)) FROM jrows b WHERE b.sp = jrows.sp AND b.relative_index = 0)", SERIES, FULL, ROWS)
def f24_dominant_year(spark, sf):
    x = _spells(spark, sf).withColumn("time", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("step") / 4).cast("int")))
    return E.dominant_year(x, ["jet", "spell"]).select("jet", "spell", "step")


@query("SELECT jet, spell, avg(CASE WHEN d < a + 10 THEN 1.0 ELSE 0 END) > 0.5 AS early, avg(CASE WHEN d > b - 10 THEN 1.0 ELSE 0 END) > 0.5 AS late FROM (SELECT jet, spell, step // 4 - 19722 AS d FROM rows_), (SELECT 1 AS a, 30 AS b) GROUP BY 1, 2", SERIES, FULL)
def f25_early_late(spark, sf):
    x = _spells(spark, sf).withColumn("d", F.floor(F.col("step") / 4) - 19722)
    return E.early_late(x, ["jet", "spell"], "d", 1, 30)


# joins ------------------------------------------------------------------------------------------------------------------


SNAP = "ids AS (SELECT jet_id, index, step, round((lon + 180) / 10)::BIGINT AS ilon, round((lat + 85) / 10)::BIGINT AS ilat FROM at0), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jet_id, ilon, ilat ORDER BY index) AS k FROM ids) WHERE k = 1)"


@query("SELECT jet_id, row_number() OVER (PARTITION BY jet_id ORDER BY index) - 1 AS index, ilon, ilat, step, s FROM once LEFT JOIN (SELECT step, ilon, ilat, s FROM field) USING (step, ilon, ilat)", PATHS, AT, SNAP, FIELD)
def j02_snap_join(spark, sf):
    p = _at_steps(spark, sf).select("jet_id", "index", "step", "lon", "lat")
    return J.snap_join(p, roles.field(spark, sf), ["jet_id"], "index", *AXES).select("jet_id", "index", "ilon", "ilat", "step", "s")


@query("SELECT jet_id, index, u_g, s_g FROM ids LEFT JOIN (SELECT step, ilon, ilat, u AS u_g, s AS s_g FROM field) USING (step, ilon, ilat)", PATHS, AT, SNAP, FIELD)
def j03_field_join(spark, sf):
    p = _at_steps(spark, sf).select("jet_id", "index", "step", J.axis_id(F.col("lon"), -180, 10).alias("ilon"), J.axis_id(F.col("lat"), -85, 10).alias("ilat"))
    return J.field_join(p, roles.field(spark, sf).select("step", "ilon", "ilat", "u", "s"), ["step", "ilon", "ilat"], "_g").select("jet_id", "index", "u_g", "s_g")


@query("SELECT step, jet, near AS nearest FROM series JOIN (SELECT step, arg_min(v, abs(v - step) * 1000000 + v) AS near FROM (SELECT DISTINCT step FROM series), (SELECT DISTINCT step AS v FROM series WHERE step % 7 = 0) GROUP BY step) USING (step) WHERE abs(step - near) <= 2", SERIES)
def j04_as_of_tolerance(spark, sf):
    s = roles.series(spark, sf).select("step", "jet")
    return J.as_of_tolerance(s, s.where("step % 7 = 0").select("step").distinct(), "step", 2)


def _corners(wrap: bool) -> str:
    x, first = ("((lon + 180) / 10)", "(floor(x)::BIGINT + a) % 36" if wrap else "floor(x)::BIGINT + a")
    return f"""pt AS (SELECT jet_id, index, step, {x} AS x, (lat + 85) / 10 AS y FROM at0),
    cn AS (SELECT jet_id, index, step, {first} AS ilon, floor(y)::BIGINT + b AS ilat, (CASE a WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w
        FROM pt, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(a, b)),
    cs AS (SELECT jet_id, index, sum(w * u) AS u, sum(w * v) AS v, sum(w * s) AS s FROM cn LEFT JOIN (SELECT step, ilon, ilat, u, v, s FROM field) USING (step, ilon, ilat) WHERE w > 0 GROUP BY 1, 2 HAVING count(*) = count(u))"""


@query(f"SELECT jet_id, index, {R('u')} AS u_interp, {R('v')} AS v_interp FROM cs", PATHS, AT, FIELD, _corners(True))
def j05_bilinear(spark, sf):
    p = _at_steps(spark, sf).select("jet_id", "index", "step", "lon", "lat")
    return P.bilinear(p, roles.field(spark, sf), ["step"], ["u", "v"], *AXES, 36).select("jet_id", "index", r("u_interp").alias("u_interp"), r("v_interp").alias("v_interp"))


@query(f"SELECT jet_id, index, {R('s')} AS interp FROM cs", PATHS, AT, FIELD, _corners(False))
def j06_interp_along(spark, sf):
    p = _at_steps(spark, sf).select("jet_id", "index", "step", "lon", "lat")
    out = P.interp_along(roles.field(spark, sf), p, ["step"], {"lon": (-180.0, 10.0), "lat": (-85.0, 10.0)}, "s")
    return out.select("jet_id", "index", r("interp").alias("interp"))


DOYS = "doys AS (SELECT DISTINCT jet, year, doy FROM daily), dn AS (SELECT jet, year, count(*) AS n FROM doys GROUP BY 1, 2)"


@query("SELECT DISTINCT b.jet, b.year FROM (SELECT r.jet, r.year, l.year AS other, count(*) AS k FROM doys r JOIN doys l ON r.jet = l.jet AND r.doy = l.doy AND l.year < r.year GROUP BY 1, 2, 3) b JOIN dn USING (jet, year) WHERE k > 0.6 * n", DAILY, DOYS)
def j09_contained(spark, sf):
    return J.contained(roles.daily(spark, sf).select("jet", "year", "doy").distinct(), ["jet"], "year", "doy", 0.6)


@query("SELECT n_nationkey AS event, step, ilon, ilat FROM field JOIN nation ON lon > n_nationkey * 12 - 165.5 AND lon < n_nationkey * 12 - 140.5 AND lat > n_regionkey * 20 - 55.5 AND lat < n_regionkey * 20 - 20.5", FIELD)
def j10_spatial_join(spark, sf):
    n = roles.table(spark, sf, "nation")
    x, y = F.col("n_nationkey") * 12.0 - 165.5, F.col("n_regionkey") * 20.0 - 55.5
    ring = F.array(*[F.struct((x + a).alias("lon"), (y + b).alias("lat")) for a, b in ((0, 0), (25, 0), (25, 35), (0, 35))])
    return J.spatial_join(n.select(F.col("n_nationkey").cast("bigint").alias("event"), ring.alias("points")), roles.field(spark, sf)).select("event", "step", "ilon", "ilat")


@query("SELECT step, jet, value FROM series WHERE step IN (SELECT step FROM rows_ WHERE relative_index = 0)", SERIES, FULL)
def j13_season_semi(spark, sf):
    return J.restrict_to(roles.series(spark, sf), _spells(spark, sf).where("relative_index = 0"), ["step"]).select("step", "jet", "value")


@query("SELECT jet, step, CASE WHEN value > 12 THEN value + 1 ELSE value END AS value FROM series", SERIES)
def j14_left_behind(spark, sf):
    s = roles.series(spark, sf).select("jet", "step", "value")
    return J.left_behind(s, s.where("value > 12").withColumn("value", F.col("value") + 1), ["jet", "step"])


@query("SELECT year, doy, jet, name, value FROM (UNPIVOT (SELECT year, doy, jet, price, disc FROM daily) ON price, disc INTO NAME name VALUE value)", DAILY)
def j22_long(spark, sf):
    return J.long(roles.daily(spark, sf), ["year", "doy", "jet"], ["price", "disc"])


TANGENT = "tg AS (SELECT *, ((atan2(coalesce((lead(lat) OVER w - lag(lat) OVER w) / 2, lead(lat) OVER w - lat, lat - lag(lat) OVER w), coalesce((lead(lon) OVER w - lag(lon) OVER w) / 2, lead(lon) OVER w - lon, lon - lag(lon) OVER w) * cos(radians(lat))) % pi()) + pi()) % pi() AS angle FROM paths WINDOW w AS (PARTITION BY jet_id ORDER BY index))"
NORMAL = "nm AS (SELECT jet_id, index, n, lon, asin(sin(radians(lat)) * cos(n / 6371000.0) + cos(radians(lat)) * sin(n / 6371000.0) * cos(-angle)) AS la, sin(-angle) * sin(n / 6371000.0) * cos(radians(lat)) AS q, lat FROM tg, (VALUES (-150000.0::DOUBLE), (0.0), (150000.0)) t(n))"


@query(f"SELECT jet_id, index, n, {R('((((lon + degrees(atan2(q, cos(n / 6371000.0) - sin(radians(lat)) * sin(la))) + 180) % 360) + 360) % 360) - 180', 3)} AS normal_lon, {R('degrees(la)', 4)} AS normal_lat FROM nm WHERE la IS NOT NULL", PATHS, TANGENT, NORMAL)
def j18_normals(spark, sf):
    out = P.normal_points(roles.paths(spark, sf), ["jet_id"], "index", 150_000.0, 150_000.0).where("normal_lat is not null")
    return out.select("jet_id", "index", "n", r("normal_lon", 3).alias("normal_lon"), r("normal_lat", 4).alias("normal_lat"))


# aggregation ------------------------------------------------------------------------------------------------------------


@query(f"SELECT step, ilat // 3 AS ilat, (((ilon + 1) % 36) // 3)::BIGINT AS ilon, max(s) AS s, max(u) AS u FROM field GROUP BY 1, 2, 3", FIELD)
def a05_coarsen_grid(spark, sf):
    return G.coarsen_grid(roles.field(spark, sf), ["step"], 3, ["s", "u"], F.max, 36)


@query(f"SELECT jet, doy, {R('avg(price)')} AS price, {R('avg(qty)')} AS qty FROM daily GROUP BY 1, 2", DAILY)
def a06_climatology(spark, sf):
    return A.climatology(roles.daily(spark, sf), ["price", "qty"], ["jet"], "doy").select("jet", "doy", r("price").alias("price"), r("qty").alias("qty"))


EXTREME = "eq AS (SELECT step, step % 12 + 1 AS doy, quantile_cont(s, 0.6) AS a, quantile_cont(s, 0.9) AS b FROM field GROUP BY 1, 2), ec AS (SELECT doy, avg(a) AS a, avg(b) AS b FROM eq GROUP BY doy)"


@query(f"SELECT x.doy, {R('avg(y.a)')} AS q60, {R('avg(y.b)')} AS q90 FROM ec x JOIN (SELECT doy + o AS d, a, b FROM ec, (VALUES (0), (12), (-12)) t(o)) y ON y.d BETWEEN x.doy - 1 AND x.doy + 1 GROUP BY x.doy", FIELD, EXTREME)
def a09_extreme_climatology(spark, sf):
    f = roles.field(spark, sf).withColumn("doy", F.col("step") % 12 + 1)
    return A.extreme_climatology(f, "s", ["step"], "doy", [0.6, 0.9], 3, 12).select("doy", r("q60").alias("q60"), r("q90").alias("q90"))


@query(f"SELECT jet, spell, day, {R('value')} AS value, day - min(day) OVER w AS relative_index, count(*) OVER w AS len FROM (SELECT jet, spell, step // 4 AS day, avg(value) AS value FROM rows_ GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY jet, spell)", SERIES, FULL)
def a11_make_daily(spark, sf):
    return A.make_daily(_spells(spark, sf), ["jet"], "step", 4, ["value"]).withColumn("value", r("value"))


@query(f"SELECT label, {R('avg(value)')} AS value, count(*) AS n FROM series JOIN (SELECT DISTINCT step, step % 3 AS label FROM series) USING (step) GROUP BY label", SERIES)
def a15_series_by_label(spark, sf):
    s = roles.series(spark, sf)
    return A.series_by_label(s, s.select("step").distinct().withColumn("label", F.col("step") % 3), ["step"], ["value"]).withColumn("value", r("value"))


@query(f"SELECT step, ilat, ilon, {R('avg(is_polar)')} AS is_polar FROM (SELECT step, is_polar, round((lon + 180) / 10)::BIGINT AS ilon, round((lat + 85) / 10)::BIGINT AS ilat FROM at0) GROUP BY 1, 2, 3", PATHS, AT)
def a16_position_grid(spark, sf):
    p = _at_steps(spark, sf).withColumns({"ilon": J.axis_id(F.col("lon"), -180, 10), "ilat": J.axis_id(F.col("lat"), -85, 10)})
    return A.position_grid(p, ["step"]).withColumn("is_polar", r("is_polar"))


EXT = "ext AS (SELECT jet, spell, unnest(range(first - 3, last + 1)) AS step, unnest(range(-3, last - first + 1)) AS relative_index FROM spells), xj AS (SELECT ascii(jet) * 1000 + spell AS spell, e.step, relative_index, s.value FROM ext e JOIN series s USING (jet, step))"


@query(f"SELECT spell, {R('avg(CASE WHEN relative_index BETWEEN -3 AND -1 THEN value END)')} AS before, {R('avg(CASE WHEN relative_index >= 0 THEN value END)')} AS during FROM xj GROUP BY spell UNION ALL SELECT -2, {R('avg(value)')}, {R('avg(value)')} FROM series UNION ALL SELECT -3, {R('stddev_samp(value)')}, {R('stddev_samp(value)')} FROM series", SERIES, FULL, EXT)
def a20_before_during(spark, sf):
    spells = Q.extend_spells(_spells(spark, sf), ["jet"], "step", 3, 0).withColumn("spell", F.ascii("jet") * 1000 + F.col("spell"))
    out = A.before_during(spells, roles.series(spark, sf).select("jet", "step", "value"), ["jet", "step"], "value", 3)
    return out.select("spell", r("before").alias("before"), r("during").alias("during"))


@query()
def a20_during_pvalues(spark, sf):
    return A.during_pvalues(_spells(spark, sf).select("jet", "spell", "step"), roles.series(spark, sf), ["jet"], "step", "value", 100)


RELATIVE = "rc AS (SELECT jet, month, avg(qty) AS m, stddev_samp(qty) AS s FROM daily GROUP BY 1, 2), rs AS (SELECT jet, avg(s) AS ss FROM rc GROUP BY jet)"


@query(f"SELECT day, jet, {R('(qty - m) / nullif(ss, 0)')} AS qty FROM daily JOIN rc USING (jet, month) JOIN rs USING (jet)", DAILY, RELATIVE)
def a21_relative_anomaly(spark, sf):
    return A.relative_anomaly(roles.daily(spark, sf), ["jet"], "month", "qty").select("day", "jet", r("qty").alias("qty"))


SEASON_DIFF = """sa AS (SELECT jet, month, avg(qty) AS a FROM daily WHERE year >= 1996 GROUP BY 1, 2), sb AS (SELECT jet, month, avg(qty) AS b FROM daily WHERE year < 1996 GROUP BY 1, 2),
    sm AS (SELECT jet, month, quantile_cont(v, 0.2) AS q20, quantile_cont(v, 0.8) AS q80 FROM (SELECT jet, month, year, avg(qty) AS v FROM daily WHERE year >= 1996 GROUP BY 1, 2, 3) GROUP BY 1, 2),
    sd AS (SELECT jet, month, a - b AS diff, q20 - b AS q20, q80 - b AS q80 FROM sa JOIN sb USING (jet, month) JOIN sm USING (jet, month))"""


@query(f"SELECT x.jet, x.month, {R('avg(y.diff)')} AS diff, {R('avg(y.q20)')} AS q20, {R('avg(y.q80)')} AS q80 FROM sd x JOIN (SELECT jet AS j, month + o AS d, diff, q20, q80 FROM sd, (VALUES (0), (12), (-12)) t(o)) y ON x.jet = y.j AND y.d BETWEEN x.month - 1 AND x.month + 1 GROUP BY 1, 2", DAILY, SEASON_DIFF)
def a26_seasonal_diff(spark, sf):
    d = roles.daily(spark, sf)
    out = A.seasonal_diff(d.where("year >= 1996"), d.where("year < 1996"), ["jet"], "month", "qty", "year", 3, 12)
    return out.select("jet", "month", *[r(c).alias(c) for c in ("diff", "q20", "q80")])


RATE = "rm AS (SELECT avg(value) OVER w AS m, count(value) OVER w AS k FROM members WINDOW w AS (PARTITION BY member ORDER BY step ROWS 3 PRECEDING)), rh AS (SELECT greatest(0, least(floor(m / 40.0 * 20), 19))::BIGINT AS bin, count(*) AS n FROM rm WHERE k = 4 GROUP BY 1)"


@query(f"SELECT bin, {R('ln((SELECT max(n) FROM rh) / n::DOUBLE) / 4')} AS rate FROM rh", MEMBERS, RATE)
def a31_rate_function(spark, sf):
    return A.rate_function(roles.members(spark, sf), "value", ["member"], "step", 4, 0.0, 40.0, 20).withColumn("rate", r("rate"))


@query(f"SELECT label, {R('sum(CASE WHEN i THEN 1.0 ELSE 0 END) / any_value(s) - count(*) / any_value(n)')} AS excess FROM (SELECT member % 5 AS label, (step IN (SELECT step FROM rows_)) AS i FROM members), (SELECT count(*) AS n, sum(CASE WHEN step IN (SELECT step FROM rows_) THEN 1.0 ELSE 0 END) AS s FROM members) GROUP BY label", SERIES, FULL, MEMBERS)
def a34_frequency_anomaly(spark, sf):
    marks = roles.members(spark, sf).select("step", (F.col("member") % 5).alias("label"))
    return A.frequency_anomaly(_spells(spark, sf), marks, ["step"]).withColumn("excess", r("excess"))


@query(f"SELECT step, ilon, {R('avg(s)')} AS s FROM field WHERE ilat - 9 BETWEEN -2 AND 2 GROUP BY 1, 2", FIELD)
def a36_hovmoller(spark, sf):
    return A.hovmoller(roles.field(spark, sf).withColumn("n", F.col("ilat") - 9), -2, 2, ["step", "ilon"], "s").withColumn("s", r("s"))


@query(f"SELECT member, label, {R('count(*) * 0.25')} AS lifetime FROM labels0 GROUP BY 1, 2", LABELS)
def a37_lifetime(spark, sf):
    return A.lifetime(roles.labels(spark, sf), ["member"], "label", 0.25).withColumn("lifetime", r("lifetime"))


@query(f"SELECT jet_id, {R('sum(CASE WHEN lon > 0 THEN lat * s END) / sum(CASE WHEN lon > 0 THEN s END)')} AS lat FROM paths GROUP BY jet_id", PATHS)
def a38_regional_metric(spark, sf):
    return A.conditional_weighted(roles.paths(spark, sf), ["jet_id"], F.col("lon") > 0, "lat", "s").withColumn("lat", r("lat"))


STRONG = "strong AS (SELECT step, max(s) AS top, avg(u) AS u FROM field GROUP BY step HAVING count(*) > 10)"


@query(f"SELECT kind, o AS offset, ilon, ilat, {R('avg(s)')} AS s FROM (SELECT step + o AS step, o, unnest(list_filter([CASE WHEN u > 25.5 THEN 'fast' END, CASE WHEN top > 40 THEN 'intense' END], lambda x: x IS NOT NULL)) AS kind FROM strong, (VALUES (-1), (0), (2)) t(o)) JOIN field USING (step) GROUP BY 1, 2, 3, 4", FIELD, STRONG)
def a39_event_composite(spark, sf):
    f = roles.field(spark, sf)
    events = f.groupBy("step").agg(F.max("s").alias("top"), F.avg("u").alias("u"), F.count("*").alias("n")).where("n > 10")
    out = A.event_composite(f, events, "step", [-1, 0, 2], ["ilon", "ilat"], "s", {"fast": F.col("u") > 25.5, "intense": F.col("top") > 40})
    return out.withColumn("s", r("s"))


@query("SELECT a.step AS event, a.step, f.ilon - a.ilon AS dx, f.ilat - a.ilat AS dy, f.s FROM (SELECT step, arg_max(ilon, (s, ilon, ilat)) AS ilon, arg_max(ilat, (s, ilon, ilat)) AS ilat FROM field GROUP BY step) a JOIN field f ON a.step = f.step AND abs(f.ilon - a.ilon) <= 3 AND abs(f.ilat - a.ilat) <= 3", FIELD)
def a40_centered_box(spark, sf):
    f = roles.field(spark, sf)
    top = f.groupBy("step").agg(F.max_by(F.struct("ilon", "ilat"), F.struct("s", "ilon", "ilat")).alias("b")).select("step", F.col("step").alias("event"), "b.*")
    return A.centered_box(f.select("step", "ilon", "ilat", "s"), top, "event", ["step"], 3).select("event", "step", "dx", "dy", "s")


@query("SELECT g, jet_id, change, len FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(change) DESC, jet_id) AS k FROM (SELECT jet_id % 7 AS g, jet_id, arg_max(lat, index) - arg_min(lat, index) AS change, count(*) AS len FROM paths GROUP BY 1, 2)) WHERE k = 1".replace("SELECT g, jet_id, change", f"SELECT g, jet_id, {R('change')} AS change"), PATHS)
def a42_largest_jump(spark, sf):
    p = roles.paths(spark, sf).withColumn("g", F.col("jet_id") % 7)
    return A.largest_jump(p, ["g"], "jet_id", "index", "lat").select("g", "jet_id", r("change").alias("change"), "len")


@query("SELECT step, min(lat) AS south, max(lat) AS north FROM (SELECT step, lat, z, (max(z) OVER w + avg(z) OVER w) / 2 AS h FROM (SELECT step, lat, avg(s) AS z FROM field GROUP BY 1, 2) WINDOW w AS (PARTITION BY step)) WHERE z >= h GROUP BY step", FIELD)
def a44_half_width(spark, sf):
    return A.half_width(roles.field(spark, sf), ["step"], "s")


@query("SELECT step, sum(abs(top - ilat))::BIGINT AS departure FROM (SELECT step, ilon, arg_max(ilat, (s, -ilat)) AS top FROM field GROUP BY 1, 2) JOIN (SELECT step, ilon, min(ilat) AS ilat FROM field GROUP BY 1, 2) USING (step, ilon) GROUP BY step", FIELD)
def a46_departure(spark, sf):
    f = roles.field(spark, sf)
    tracked = f.groupBy("step", "ilon").agg(F.min("ilat").alias("ilat"))
    return A.departure(f, tracked, ["step"], "ilon", "ilat", "s")


@query(f"SELECT g, {R('max(t)')} AS meandering FROM (SELECT jet_id % 7 AS g, jet_id, sum(d) / 360 AS t FROM (SELECT jet_id, sqrt((lon - lag(lon) OVER w) ** 2 + (lat - lag(lat) OVER w) ** 2) AS d FROM paths WINDOW w AS (PARTITION BY jet_id ORDER BY index)) GROUP BY 1, 2) GROUP BY g", PATHS)
def a47_meandering(spark, sf):
    p = roles.paths(spark, sf).withColumn("g", F.col("jet_id") % 7)
    return A.meandering(p, ["g"], ["jet_id"], "index").withColumn("meandering", r("meandering"))


@query(f"SELECT jet, relative_index, {R('avg(z)')} AS value, count(*) AS n FROM (SELECT jet, step, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM series WINDOW w AS (PARTITION BY jet)) JOIN (SELECT jet, step, relative_index FROM rows_ WHERE len BETWEEN 2 AND 4 AND abs(relative_index) <= 1) USING (jet, step) GROUP BY 1, 2", SERIES, FULL)
def a48_region_composite(spark, sf):
    out = A.region_composite(_spells(spark, sf), roles.series(spark, sf).select("jet", "step", "value"), ["jet", "step"], ["jet"], "value", (2, 4), 1)
    return out.withColumn("value", r("value"))


@query(f"SELECT month, ilon, ilat, {R('count(*) / any_value(n)')} AS share FROM (SELECT step % 12 AS month, ilon, ilat FROM field WHERE s > 26) JOIN (SELECT step % 12 AS month, count(DISTINCT step)::DOUBLE AS n FROM field GROUP BY 1) USING (month) GROUP BY 1, 2, 3", FIELD)
def a51_occurrence(spark, sf):
    f = roles.field(spark, sf).withColumn("month", F.col("step") % 12)
    return A.occurrence(f.where("s > 26"), f.select("month", "step").distinct(), ["ilon", "ilat"], ["month"]).withColumn("share", r("share"))


@query(f"SELECT label, next, n, {R('n / sum(n) OVER (PARTITION BY label)')} AS share FROM (SELECT label, next, count(*) AS n FROM (SELECT label, lead(label, 5) OVER (PARTITION BY member ORDER BY ord) AS next FROM labels0) WHERE next IS NOT NULL GROUP BY 1, 2)", LABELS)
def a52_lagged_transitions(spark, sf):
    return A.transition_matrix(roles.labels(spark, sf), ["member"], "ord", "label", 5).withColumn("share", r("share"))


@query(f"SELECT jet, doy, {R('avg(qty)')} AS mean, {R('stddev_samp(qty)')} AS std, {R('median(qty)')} AS median, {R('quantile_cont(qty, 0.4)')} AS q40, {R('quantile_cont(qty, 0.6)')} AS q60, {R('sum(qty)')} AS total FROM (SELECT jet, doy, qty::DOUBLE AS qty FROM daily) GROUP BY 1, 2", DAILY)
def a54_event_seasonality(spark, sf):
    out = A.event_seasonality(roles.daily(spark, sf).withColumn("qty", F.col("qty").cast("double")), ["jet"], "doy", "qty")
    return out.select("jet", "doy", *[r(c).alias(c) for c in ("mean", "std", "median", "q40", "q60", "total")])


@query(f"SELECT (doy - 1) // 7 AS week, count(*) AS n, {R('sqrt(avg(sin(radians(x * 72.0))) ** 2 + avg(cos(radians(x * 72.0))) ** 2)')} AS x_length FROM (SELECT doy, year % 5 AS x FROM daily) GROUP BY 1", DAILY)
def a55_weekly_population(spark, sf):
    d = roles.daily(spark, sf).withColumn("x", F.col("year") % 5)
    return A.weekly_population(d, "doy", {"x": 5}).select("week", "n", r("x_length").alias("x_length"))


ONSET = "nl AS (SELECT r.jet, r.spell, r.len, m.label FROM rows_ r JOIN (SELECT jet, step, step % 3 AS label FROM series) m USING (jet, step) WHERE abs(r.relative_index) <= 2), ml AS (SELECT jet, spell, any_value(len) AS len, label, row_number() OVER (PARTITION BY jet, spell ORDER BY count(*) DESC, label) AS k FROM nl GROUP BY jet, spell, label)"


@query(f"SELECT label, count(*) AS spells, {R('avg(len)')} AS mean_len, {R('count(*) / (SELECT count(*) FROM ml WHERE k = 1)')} AS share FROM ml WHERE k = 1 GROUP BY label", SERIES, FULL, ONSET)
def a56_label_at_onset(spark, sf):
    marks = roles.series(spark, sf).select("jet", "step", (F.col("step") % 3).alias("label"))
    out = A.label_at_onset(_spells(spark, sf), marks, ["jet"], "step", 2)
    return out.select("label", "spells", r("mean_len").alias("mean_len"), r("share").alias("share"))


# metrics of jets --------------------------------------------------------------------------------------------------------

HAV = "2 * 6371000.0 * asin(sqrt(CASE WHEN pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2) > 1 THEN 1 ELSE pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2) END))"
PROPS = f"""pl AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(s) OVER w AS sl, coalesce((((lon - lag(lon) OVER w + 180) % 360 + 360) % 360) - 180, 0) AS dx,
        abs(lat - lag(lat) OVER (PARTITION BY jet_id ORDER BY lon, index)) AS dlat, avg(v) OVER (PARTITION BY jet_id) AS vbar FROM paths WINDOW w AS (PARTITION BY jet_id ORDER BY index)),
    px AS (SELECT *, sum(dx) OVER (PARTITION BY jet_id ORDER BY index) AS x, {HAV} AS d FROM pl)"""


@query(f"""SELECT jet_id, {R('sum(lat * s) / sum(s)', 4)} AS mean_lat, {R('avg(s)', 4)} AS mean_s, arg_max(lon, (s, index)) AS lon_star, arg_max(lat, (s, index)) AS lat_star, max(s) AS s_star,
    {R('max(x) - min(x)', 4)} AS lon_ext, {R('max(lat) - min(lat)', 4)} AS lat_ext, {R('regr_slope(lat, x)', 4)} AS tilt, {R('1 - regr_r2(lat, x)', 4)} AS waviness1, {R('var_pop(lat) * count(lat)', 3)} AS waviness2,
    {R('sum(dlat) / nullif(max(x) - min(x), 0)', 4)} AS "wavinessR16", {R('sum(d) / 6371000.0 / cos(radians(avg(lat))) / radians(nullif(max(x) - min(x), 0))', 4)} AS "wavinessDC16",
    {R('sum((v - vbar) * abs(v) / s) / sum(s)', 5)} AS "wavinessFV15", {R('sum(d * (s + sl) / 2) / 1e6', 4)} AS int, {R('avg(is_polar)', 5)} AS is_polar FROM px GROUP BY jet_id HAVING count(*) > 2""", PATHS, PROPS)
def m01_jet_properties(spark, sf):
    out = JT.jet_properties(roles.paths(spark, sf), ["jet_id"])
    out = out.join(roles.paths(spark, sf).groupBy("jet_id").count().where("count > 2"), "jet_id").withColumn("int", F.col("int") / 1e6)
    places = {"waviness2": 3, "wavinessFV15": 5, "is_polar": 5}
    whole = ["jet_id", "lon_star", "lat_star", "s_star"]
    names = ["mean_lat", "mean_s", "lon_ext", "lat_ext", "tilt", "waviness1", "waviness2", "wavinessR16", "wavinessDC16", "wavinessFV15", "int", "is_polar"]
    return out.select(*whole, *[r(c, places.get(c, 4)).alias(c) for c in names])


EUROPE = f"pe AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(s) OVER w AS sl FROM paths WHERE lon > -10 WINDOW w AS (PARTITION BY jet_id ORDER BY index))"


@query(f"SELECT jet_id, {R(f'coalesce(i, 0) / 1e6', 4)} AS int_over_europe FROM (SELECT DISTINCT jet_id FROM paths) LEFT JOIN (SELECT jet_id, sum({HAV} * (s + sl) / 2) AS i FROM pe GROUP BY jet_id) USING (jet_id)", PATHS, EUROPE)
def m12_int_over_europe(spark, sf):
    out = JT.integral_over(roles.paths(spark, sf), ["jet_id"], "index", F.col("lon") > -10, "int_over_europe")
    return out.select("jet_id", r(F.col("int_over_europe") / 1e6, 4).alias("int_over_europe"))


SECTION = "sc AS (SELECT step, ilon, ilat - 9 AS n, s AS s_interp, max(CASE WHEN ilat = 9 THEN s END) OVER (PARTITION BY step, ilon) AS c FROM field)"


def _sections(spark, sf):
    return roles.field(spark, sf).select("step", "ilon", "lon", "lat", (F.col("ilat") - 9).alias("n"), F.col("s").alias("s_interp"))


@query(f"SELECT step, {R('sum((up + down) * c) / sum(c)')} AS width FROM (SELECT step, ilon, c, min(CASE WHEN n > 0 THEN n END) AS up, min(CASE WHEN n < 0 THEN -n END) AS down FROM sc WHERE s_interp <= greatest(0.75 * c, 20) AND c IS NOT NULL GROUP BY 1, 2, 3) GROUP BY step", FIELD, SECTION)
def m15_width(spark, sf):
    x = _sections(spark, sf)
    cores = x.where("n = 0").select("step", "ilon")
    return JT.jet_widths(x.join(cores, ["step", "ilon"]), ["step"], "ilon", 0.75, 20.0).withColumn("width", r("width"))


@query(f"SELECT jet_id, index, {R(f'{HAV} / (21600.0 * (index - li))', 4)} AS com_speed FROM (SELECT *, lag(index) OVER w AS li, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM paths WINDOW w AS (PARTITION BY jet_id ORDER BY index))", PATHS)
def m16_com_speed(spark, sf):
    p = roles.paths(spark, sf).withColumnsRenamed({"lon": "mean_lon", "lat": "mean_lat"})
    return JT.speed_of_centre(p, ["jet_id"], "index", 21_600.0).select("jet_id", "index", r("com_speed", 4).alias("com_speed"))


LOW = _corners(True) + ", ci AS (SELECT jet_id, index, lon, lat, p.s, cs.s AS low FROM paths p JOIN cs USING (jet_id, index)), cl AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(s) OVER w AS sl, lag(low) OVER w AS ll FROM ci WINDOW w AS (PARTITION BY jet_id ORDER BY index))"


@query(f"SELECT jet_id, {R(f'coalesce(sum({HAV} * (s + sl) / 2), 0) / 1e6', 4)} AS int, {R(f'coalesce(sum({HAV} * (low + ll) / 2), 0) / 1e6', 4)} AS int_low FROM cl GROUP BY jet_id", PATHS, AT, FIELD, LOW)
def m17_low_integral(spark, sf):
    out = JT.low_integral(_at_steps(spark, sf), roles.field(spark, sf), ["jet_id"], "index", ["step"], *AXES, 36)
    return out.select("jet_id", r(F.col("int") / 1e6, 4).alias("int"), r(F.col("int_low") / 1e6, 4).alias("int_low"))


@query(f"SELECT member, step, {R('var_samp(value) OVER w', 4)} AS var, {R('sum(value) OVER w')} AS total FROM members WINDOW w AS (PARTITION BY member ORDER BY step RANGE BETWEEN 7 PRECEDING AND CURRENT ROW)", MEMBERS)
def m18_rolling(spark, sf):
    out = Q.rolling(roles.members(spark, sf), {"var": F.var_samp("value"), "total": F.sum("value")}, ["member"], "step", 7, 0)
    return out.select("member", "step", r("var", 4).alias("var"), r("total").alias("total"))


@query(f"SELECT jet_id, {R('max(is_polar / greatest(s * 1000, 1) * 21600)')} AS slowness FROM paths GROUP BY jet_id", PATHS)
def m19_slowness(spark, sf):
    cross = roles.paths(spark, sf).select("jet_id", F.col("is_polar").alias("lon_overlap"), (F.col("s") * 1000).alias("dist"))
    return TR.feature_slowness(cross, ["jet_id"], 21_600.0).withColumn("slowness", r("slowness"))


# sequences --------------------------------------------------------------------------------------------------------------


@query("SELECT member, unnest(range(start, start + len)) AS index, len FROM (SELECT member, min(i) AS start, count(*) AS len FROM (SELECT *, sum(c) OVER (PARTITION BY member ORDER BY ord) AS run FROM (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN (label = 0) IS DISTINCT FROM lag(label = 0) OVER w THEN 1 ELSE 0 END AS c FROM labels0 WINDOW w AS (PARTITION BY member ORDER BY ord))) GROUP BY member, run)", LABELS)
def w03_explode_runs(spark, sf):
    return Q.explode_runs(Q.run_lengths(roles.labels(spark, sf), F.col("label") == 0, ["member"], "ord")).select("member", "index", "len")


@query("SELECT jet, day, row_number() OVER (PARTITION BY jet ORDER BY day) - 1 AS index FROM daily", DAILY)
def w04_group_index(spark, sf):
    return Q.group_index(roles.daily(spark, sf), ["jet"], "day").select("jet", "day", "index")


def _short(d: str) -> str:
    return f"(((({d}) + 180) % 360 + 360) % 360 - 180)"


@query(f"SELECT jet_id, index, {R(f'coalesce(({_short("lead(lon) OVER w - lon")} + {_short("lon - lag(lon) OVER w")}) / 2, {_short("lead(lon) OVER w - lon")}, {_short("lon - lag(lon) OVER w")})')} AS d FROM paths WINDOW w AS (PARTITION BY jet_id ORDER BY index)", PATHS)
def w06_periodic_diff(spark, sf):
    return roles.paths(spark, sf).select("jet_id", "index", r(Q.periodic_diff("lon", ["jet_id"], "index", 360.0)).alias("d"))


@query(f"SELECT step, ilon, ilat, {R(f'{DDX.format("s")} / {DDX.format("ilon")}')} AS d FROM field {WINDOWS}", FIELD)
def w07_directional_diff(spark, sf):
    return Q.directional_diff(roles.field(spark, sf), "s", "ilon", ["step", "ilat"], "d").select("step", "ilon", "ilat", r("d").alias("d"))


ALIGN = "coalesce((lead({0}) OVER w - lag({0}) OVER w) / 2, lead({0}) OVER w - {0}, {0} - lag({0}) OVER w)"


@query(f"SELECT jet_id, index, {R('(u * x + v * y) / (sqrt(u * u + v * v) * nullif(sqrt(x * x + y * y), 0))')} AS alignment FROM (SELECT *, {ALIGN.format('lon')} * cos(radians(lat)) AS x, {ALIGN.format('lat')} AS y FROM paths WINDOW w AS (PARTITION BY jet_id ORDER BY index))", PATHS)
def w16_alignment(spark, sf):
    return JT.alignment(roles.paths(spark, sf), ["jet_id"], "index").select("jet_id", "index", r("alignment").alias("alignment"))


@query(f"SELECT jet, {R('sum(CASE WHEN s.value < x THEN 1.0 ELSE 0 END) + (sum(CASE WHEN s.value = x THEN 1.0 ELSE 0 END) + 1) / 2')} AS rank, count(*) AS n FROM series s JOIN (SELECT jet, arg_max(value, step) AS x FROM series GROUP BY jet) USING (jet) GROUP BY jet", SERIES)
def w18_rank_last(spark, sf):
    s = roles.series(spark, sf)
    s = s.withColumn("sample", F.when(F.col("step") == F.max("step").over(Window.partitionBy("jet")), -1).otherwise(F.col("step")))
    return Q.rank_last(s, "value", "sample", -1, ["jet"]).withColumn("rank", r("rank"))


LANCZOS = G.lanczos(3, 0.1)


@query(f"SELECT member, step, {R('value - CASE WHEN n = 7 THEN f END')} AS eddy FROM members LEFT JOIN (SELECT member, step - o AS step, sum(value * w) AS f, count(*) AS n FROM members, (VALUES {', '.join(f'({k - 3}, {w!r}::DOUBLE)' for k, w in enumerate(LANCZOS))}) t(o, w) GROUP BY 1, 2) USING (member, step)", MEMBERS)
def w20_lanczos_eddy(spark, sf):
    low = Q.fir_filter(roles.members(spark, sf), "value", ["member"], "step", LANCZOS, "low")
    return low.select("member", "step", r(F.col("value") - F.col("low")).alias("eddy"))


GAUSS = [math.exp(-0.5 * (k / 0.5) ** 2) for k in range(-2, 3)]


def _taps(c: str, w: str) -> str:
    at = lambda k: f"{'lag' if k <= 0 else 'lead'}({c}, {abs(k)}) OVER {w}"
    top = " + ".join(f"coalesce({at(k - 2)} * {x!r}::DOUBLE, 0)" for k, x in enumerate(GAUSS))
    return f"({top}) / (" + " + ".join(f"CASE WHEN {at(k - 2)} IS NOT NULL THEN {x!r}::DOUBLE ELSE 0 END" for k, x in enumerate(GAUSS)) + ")"


@query(f"SELECT step, ilon, ilat, {R(_taps('s', 'y'))} AS s FROM (SELECT step, ilon, ilat, {_taps('s', 'x')} AS s FROM field {WINDOWS}) {WINDOWS}", FIELD)
def w21_gaussian_smooth(spark, sf):
    return G.gaussian_smooth(roles.field(spark, sf), "s", ["step"], 0.5, 0.5).select("step", "ilon", "ilat", r("s").alias("s"))


FOURIER = """fb AS (SELECT member, step, value, row_number() OVER (PARTITION BY member ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY member) AS n FROM members),
    ff AS (SELECT member, k, n, sum(value * cos(k * i * 2 * pi() / n)) AS c, sum(value * sin(k * i * 2 * pi() / n)) AS s FROM fb, (SELECT unnest(range(0, 2000)) AS k) WHERE k / n::DOUBLE BETWEEN 0.02 AND 0.1 AND 2 * k <= n GROUP BY 1, 2, 3)"""


@query(f"SELECT member, step, {R('coalesce(sum(CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END * (c * cos(k * i * 2 * pi() / n) + s * sin(k * i * 2 * pi() / n)) / n), 0)', 4)} AS filtered FROM fb LEFT JOIN ff USING (member, n) GROUP BY member, step", MEMBERS, FOURIER)
def w22_band_pass(spark, sf):
    return G.band_pass(roles.members(spark, sf), "value", ["member"], "step", 0.02, 0.1).select("member", "step", r("filtered", 4).alias("filtered"))


@query(f"""SELECT a.step, a.ilon, a.ilat, {R('sum(w * b.s) / sum(w)')} AS smoothed FROM (SELECT *, greatest(sqrt(u * u + v * v), 1e-9) AS l FROM field) a JOIN field b ON a.step = b.step AND abs(a.ilon - b.ilon) <= 1 AND abs(a.ilat - b.ilat) <= 1,
    LATERAL (SELECT exp(-(pow(((b.ilon - a.ilon) * a.u + (b.ilat - a.ilat) * a.v) / a.l / 1.5, 2) + pow(((b.ilat - a.ilat) * a.u - (b.ilon - a.ilon) * a.v) / a.l / 0.7, 2)) / 2) AS w) GROUP BY 1, 2, 3""", FIELD)
def w23_directional_smooth(spark, sf):
    return G.directional_smooth(roles.field(spark, sf), "s", ["step"], 1.5, 0.7, 1).select("step", "ilon", "ilat", r("smoothed").alias("smoothed"))


@query()
def w24_label_spells_sigma(spark, sf):
    near = {(a, b): float(abs(a - b)) for a in range(5) for b in range(5)}
    return Q.label_spells(roles.labels(spark, sf), ["member"], "ord", "label", near, 1.0, 2)


@query()
def w26_tracked_latitude(spark, sf):
    return Q.tracked_latitude(roles.field(spark, sf), ["step"], "ilon", "ilat", "s")


ACF = "acf AS (SELECT k AS lag, corr(value, x) AS rho FROM (SELECT value, unnest([0, 1, 2, 3]) AS k, unnest([value, lag(value, 1) OVER w, lag(value, 2) OVER w, lag(value, 3) OVER w]) AS x FROM members WINDOW w AS (PARTITION BY member ORDER BY step)) GROUP BY 1)"


@query(f"SELECT min(CASE WHEN rho < exp(-1) THEN lag END) AS e_folding, {R('1 + 2 * sum(CASE WHEN lag > 0 THEN rho ELSE 0 END)')} AS integral, {R('1 + 2 * sum(CASE WHEN lag > 0 THEN (1 - lag / 4.0) * rho ELSE 0 END)')} AS triangular FROM acf", MEMBERS, ACF)
def w27_decorrelation(spark, sf):
    m, w = roles.members(spark, sf), Window.partitionBy("member").orderBy("step")
    late = m.withColumn("xs", F.array(*[F.lag("value", k).over(w) for k in range(4)])).select("value", F.posexplode("xs").alias("lag", "x"))
    acf = late.groupBy(F.col("lag").cast("bigint").alias("lag")).agg(F.corr("value", "x").alias("rho"))
    return Q.decorrelation(acf).select("e_folding", r("integral").alias("integral"), r("triangular").alias("triangular"))


@query("SELECT jet, step, coalesce(CASE WHEN relative_index = 0 THEN len END, 0) AS lag_0, coalesce(CASE WHEN relative_index = 1 THEN len END, 0) AS lag_1 FROM full0 LEFT JOIN (SELECT jet, step, relative_index, len FROM rows_) USING (jet, step)", SERIES, FULL)
def w28_onset_lags(spark, sf):
    return Q.onset_lags(_full(spark, sf), _spells(spark, sf), ["jet"], "step", 2)


@query("SELECT jet AS value, arg_max(len, (len, -first)) AS len, arg_max(first, (len, -first)) AS first FROM spells GROUP BY jet", SERIES, FULL)
def k06_longest_spell(spark, sf):
    return A.longest_by_label(Q.spell_summary(_spells(spark, sf), ["jet"], "step").withColumnRenamed("jet", "value"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def u0b_first_of_each(spark, sf):
    e = roles.table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return A.top_n(e, ["user_id"], [F.col("ts"), F.col("event_id")], 1).drop("ts")


# scalar functions and field calculus --------------------------------------------------------------------------------------


@query(f"SELECT jet_id, index, {R('(SELECT degrees(asin(sin(radians(lat)) * cos(0.1) + cos(radians(lat)) * sin(0.1) * cos(is_polar))))', 5)} AS lat2 FROM paths", PATHS)
def x03_destination(spark, sf):
    _, lat = S.destination(F.col("lon"), F.col("lat"), F.col("is_polar"), F.lit(637_100.0))
    return roles.paths(spark, sf).select("jet_id", "index", r(lat, 5).alias("lat2"))


@query(f"SELECT step, ilon, ilat, {R('1e5 * (200 + s) / (287.0500676 * (250 + u)) / (200 + s)', 5)} AS density, {R('sqrt(u * u + v * v)')} AS speed, {R('2e5 * 7.2921e-5 * sin(radians(lat))', 5)} AS f FROM field", FIELD)
def x10_air(spark, sf):
    return roles.field(spark, sf).select("step", "ilon", "ilat", r(S.air_density(F.lit(1e5), 250 + F.col("u")), 5).alias("density"), r(S.wind_speed(F.col("u"), F.col("v"))).alias("speed"), r(S.coriolis(F.col("lat")) * 1e5, 5).alias("f"))


def gx(c: str) -> str:
    return f"({DDX.format(c)} / ({DDX.format('lon')} * pi() / 180 * 6371000.0 * cos(radians(lat))))"


def gy(c: str) -> str:
    return f"({ddy(c)} / ({ddy('lat')} * pi() / 180 * 6371000.0))"


SIGMA = f"sg AS (SELECT *, (v * {gx('s')} - u * {gy('s')}) / s AS sigma FROM field {WINDOWS})"


@query(f"SELECT step, ilon, ilat, {R('radians(10.0) * 6371000.0 * cos(radians(lat)) / 1000', 4)} AS dx, {R('radians(10.0) * 6371.0', 4)} AS dy FROM field", FIELD)
def d01_metric_terms(spark, sf):
    g = G.metric_terms(roles.field(spark, sf), 10.0, 10.0)
    return g.select("step", "ilon", "ilat", r(F.col("dx") / 1000, 4).alias("dx"), r(F.col("dy") / 1000, 4).alias("dy"))


@query(f"SELECT step, ilon, ilat, {R('sigma * 1e6', 4)} AS sigma FROM sg", FIELD, SIGMA)
def d02_norm_derivative(spark, sf):
    return G.norm_derivative(roles.field(spark, sf), "s", ["step"]).select("step", "ilon", "ilat", r(F.col("sigma") * 1e6, 4).alias("sigma"))


@query(f"SELECT step, ilon, ilat, {R(f'1e6 * ({gx("v")} - {gy("uc")} / cos(radians(lat)) + 2 * 7.2921e-5 * sin(radians(lat)))', 4)} AS abs_vorticity FROM (SELECT *, u * cos(radians(lat)) AS uc FROM field) {WINDOWS}", FIELD)
def d03_absolute_vorticity(spark, sf):
    return G.absolute_vorticity(roles.field(spark, sf), ["step"]).select("step", "ilon", "ilat", r(F.col("abs_vorticity") * 1e6, 4).alias("abs_vorticity"))


FIRST = f"fd AS (SELECT step, ilon, ilat, lon, lat, u, v, s, {gx('s')} AS fx, {gy('s')} AS fy FROM field {WINDOWS})"


@query(f"SELECT step, ilon, ilat, {R('1e6 * (u * fx + v * fy) / s', 4)} AS along FROM fd", FIELD, FIRST)
def d05_tangential(spark, sf):
    return G.tangential_derivative(roles.field(spark, sf), "s", ["step"]).select("step", "ilon", "ilat", r(F.col("along") * 1e6, 4).alias("along"))


@query(f"SELECT step, ilon, ilat, {R(f'1e12 * ({gx("fx")} + {gy("fy")})', 3)} AS laplacian FROM fd {WINDOWS}", FIELD, FIRST)
def d05_laplacian(spark, sf):
    return G.laplacian(roles.field(spark, sf), "s", ["step"]).select("step", "ilon", "ilat", r(F.col("laplacian") * 1e12, 3).alias("laplacian"))


CRITERION = f"cr AS (SELECT step, ilon, ilat, s * ((v * {gx('sigma')} - u * {gy('sigma')}) / s) + sigma * sigma AS c FROM sg {WINDOWS})"


@query(f"SELECT step, ilon, ilat, {R('CASE WHEN c < 0 THEN c END * 1e12', 3)} AS criterion FROM cr", FIELD, SIGMA, CRITERION)
def d06_axis_criterion(spark, sf):
    return G.axis_criterion(roles.field(spark, sf), ["step"]).select("step", "ilon", "ilat", r(F.col("criterion") * 1e12, 3).alias("criterion"))


@query(f"SELECT step, ilon, ilat, {R(f'1e6 * sqrt(pow({gx("l")}, 2) + pow({gy("l")}, 2))', 4)} AS log_gradient FROM (SELECT *, ln(s) AS l FROM field) {WINDOWS}", FIELD)
def d07_log_gradient(spark, sf):
    return G.log_gradient(roles.field(spark, sf), "s", ["step"]).select("step", "ilon", "ilat", r(F.col("log_gradient") * 1e6, 4).alias("log_gradient"))


LEVELS = "lv AS (SELECT step, ilon, (100 + ilat * (ilat + 3) * 2)::DOUBLE AS lev, ilon * 4.0 - 70 AS lat, s, u + 280 AS theta FROM field)"


def _levels(spark, sf):
    i = F.col("ilat")
    return roles.field(spark, sf).select("step", "ilon", F.lit(0).cast("bigint").alias("zero"), (100 + i * (i + 3) * 2).cast("double").alias("lev"), (F.col("ilon") * 4.0 - 70).alias("lat"), "s", (F.col("u") + 280).alias("theta")).withColumnRenamed("zero", "ilat")


def dp(c: str) -> str:
    hu, hd = "(lead(lev) OVER p - lev)", "(lev - lag(lev) OVER p)"
    up, down = f"((lead({c}) OVER p - {c}) / {hu})", f"(({c} - lag({c}) OVER p) / {hd})"
    return f"coalesce(({up} * {hd} + {down} * {hu}) / ({hu} + {hd}), {up}, {down})"


@query(f"SELECT step, ilon, lev, {R(dp('s'))} AS d_dp FROM lv WINDOW p AS (PARTITION BY step, ilon ORDER BY lev)", FIELD, LEVELS)
def d08_vertical_derivative(spark, sf):
    return G.vertical_derivative(_levels(spark, sf), "s", ["step"]).select("step", "ilon", "lev", r("d_dp").alias("d_dp"))


LOWS = "lo AS (SELECT step, ilon, ilat, lon, lat, u, v, ul, vl, u - ul AS ue, v - vl AS ve, (u - ul) * (v - vl) * cos(radians(lat)) AS uvc, (u - ul) * (u - ul) AS uu FROM (SELECT *, avg(u) OVER (PARTITION BY ilon, ilat) AS ul, avg(v) OVER (PARTITION BY ilon, ilat) AS vl FROM field))"


def _with_lows(spark, sf):
    w = Window.partitionBy("ilon", "ilat")
    return roles.field(spark, sf).withColumns({"u_low": F.avg("u").over(w), "v_low": F.avg("v").over(w)})


@query(f"SELECT step, ilon, ilat, {R('(ue * ue + ve * ve) / 2', 4)} AS eke, {R('ue * ve', 4)} AS uv, {R(f'-1e6 * ({gx("uu")} + {gy("uvc")} / cos(radians(lat)))', 3)} AS momentum FROM lo {WINDOWS}", FIELD, LOWS)
def d09_eddy_forcing(spark, sf):
    e = G.eddy_forcing(_with_lows(spark, sf), {"u": "u_low", "v": "v_low"}, ["step"])
    return e.select("step", "ilon", "ilat", r("eke", 4).alias("eke"), r("uv", 4).alias("uv"), r(F.col("momentum_convergence") * 1e6, 3).alias("momentum"))


@query(f"SELECT step, ilon, lev, {R('86400 * 0.3098 * 9.81 * rho * abs(2 * 7.2921e-5 * sin(radians(lat))) * abs(du / 100) / sqrt(greatest(1e-12, -9.81 * 9.81 * rho * dt / 100 / theta))', 4)} AS eady FROM (SELECT *, lev * 100 / (287.0500676 * theta * pow(lev / 1000, 0.2854)) AS rho, {dp('s')} AS du, {dp('theta')} AS dt FROM lv WINDOW p AS (PARTITION BY step, ilon ORDER BY lev))", FIELD, LEVELS)
def d10_eady_growth(spark, sf):
    return G.eady_growth(_levels(spark, sf), ["step"]).select("step", "ilon", "lev", r(F.col("eady") * 86400, 4).alias("eady"))


@query(f"SELECT step, ilon, ilat, {R(f'1e6 * ((ve * ve - ue * ue) / 2 * ({gx("ul")} - {gy("vl")}) - ue * ve * ({gx("vl")} + {gy("ul")}))', 3)} AS generation FROM lo {WINDOWS}", FIELD, LOWS)
def d10b_eddy_generation(spark, sf):
    e = G.eddy_generation(G.eddy_energy(_with_lows(spark, sf), {"u": "u_low", "v": "v_low"}), ["step"])
    return e.select("step", "ilon", "ilat", r(F.col("generation") * 1e6, 3).alias("generation"))


COARSE = """c0 AS (SELECT step, ilat // 2 AS ilat, ilon // 2 AS ilon, avg(lon) AS lon, avg(lat) AS lat, avg(u) AS u, avg(v) AS v FROM field GROUP BY 1, 2, 3),
    c1 AS (SELECT *, avg(u) OVER w AS u1, avg(v) OVER w AS v1 FROM c0 WINDOW w AS (PARTITION BY step, ilat ORDER BY ilon RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
    c2 AS (SELECT step, ilat, ilon, lon, lat, avg(u1) OVER w AS u, avg(v1) OVER w AS v FROM c1 WINDOW w AS (PARTITION BY step, ilon ORDER BY ilat RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
    c3 AS (SELECT *, sqrt(u * u + v * v) AS s FROM c2)"""


@query(f"SELECT step, ilon, ilat, {R('s')} AS s, {R(f'1e6 * (v * {gx("s")} - u * {gy("s")}) / s', 3)} AS sigma FROM c3 {WINDOWS}", FIELD, COARSE)
def d11_preprocess(spark, sf):
    return G.preprocess(roles.field(spark, sf), ["step"], 2, 1).select("step", "ilon", "ilat", r("s").alias("s"), r(F.col("sigma") * 1e6, 3).alias("sigma"))


# geometry ---------------------------------------------------------------------------------------------------------------


@query("SELECT step, ilon, ilat FROM (SELECT *, s - 26 AS z, lag(s) OVER x AS a, lead(s) OVER x AS b, lag(s) OVER y AS c, lead(s) OVER y AS d FROM field WINDOW x AS (PARTITION BY step, ilat ORDER BY ilon), y AS (PARTITION BY step, ilon ORDER BY ilat)) WHERE z <= 0 AND (coalesce(a > 26, false) OR coalesce(b > 26, false) OR coalesce(c > 26, false) OR coalesce(d > 26, false))", FIELD)
def g02_zero_line_nodes(spark, sf):
    return C.boundary_nodes(roles.field(spark, sf).withColumn("z", F.col("s") - 26), "z", ["step"]).select("step", "ilon", "ilat")


STREAM = """al AS (SELECT *, sum(d) OVER (PARTITION BY jet_id ORDER BY index) AS along FROM (SELECT *, coalesce(sqrt((lon - lag(lon) OVER w) ** 2 + (lat - lag(lat) OVER w) ** 2), 0) AS d FROM paths WINDOW w AS (PARTITION BY jet_id ORDER BY index))),
    pr AS (SELECT a.jet_id, a.index AS i, b.index AS j, sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2) AS dist, b.along - a.along AS length FROM al a JOIN al b ON a.jet_id = b.jet_id AND a.index < b.index),
    lg AS (SELECT * FROM pr WHERE dist <= 20 AND length >= 60 AND length >= 3 * dist), bm AS (SELECT * FROM (SELECT *, min(dist) OVER (PARTITION BY jet_id, i) AS mi, min(dist) OVER (PARTITION BY jet_id, j) AS mj FROM lg) WHERE dist = mi AND dist = mj),
    nb AS (SELECT *, max(j) OVER (PARTITION BY jet_id ORDER BY i, j DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM bm)"""


@query(f"SELECT jet_id, i, j, {R('dist', 4)} AS dist, {R('length', 4)} AS length FROM nb WHERE b IS NULL OR j > b", PATHS, STREAM)
def g04_streamers(spark, sf):
    out = C.streamers(roles.paths(spark, sf), ["jet_id"], "index", 20.0, 60.0, 3.0)
    return out.select("jet_id", "i", "j", r("dist", 4).alias("dist"), r("length", 4).alias("length"))


@query("SELECT jet_id, count(*) AS n, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north, arg_min(lon, index) AS first_lon FROM paths GROUP BY jet_id", PATHS)
def g05_event_points(spark, sf):
    out = C.event_points(roles.paths(spark, sf), ["jet_id"], "index")
    return out.select("jet_id", F.size("points").cast("bigint").alias("n"), "west", "east", "south", "north", F.col("points")[0].lon.alias("first_lon"))


@query(f"SELECT jet_id, {R('degrees(atan2(arg_max(lat, (abs(lat - y), -index)) - any_value(y), arg_max(lon, (abs(lat - y), -index)) - any_value(x)))', 4)} AS axis_angle FROM paths JOIN (SELECT jet_id, (arg_min(lon, index) + arg_max(lon, index)) / 2 AS x, (arg_min(lat, index) + arg_max(lat, index)) / 2 AS y FROM paths GROUP BY jet_id) USING (jet_id) GROUP BY jet_id", PATHS)
def g06_streamer_angle(spark, sf):
    return C.streamer_angle(roles.paths(spark, sf), ["jet_id"], "index").withColumn("axis_angle", r("axis_angle", 4))


@query("SELECT f.step, f.ilon, f.ilat, CASE WHEN s > 26 AND area >= 40 THEN 1 ELSE 0 END::BIGINT AS large, CASE WHEN s > 26 AND lat0 > 0 THEN 1 ELSE 0 END::BIGINT AS northern FROM field f LEFT JOIN (SELECT step, count(*) AS area, avg(lat) AS lat0 FROM field WHERE s > 26 GROUP BY step) USING (step)", FIELD)
def g07_wave_break_masks(spark, sf):
    f = roles.field(spark, sf)
    nodes = f.where("s > 26").select("step", F.col("step").alias("event"), "ilon", "ilat")
    events = f.where("s > 26").groupBy(F.col("step").alias("event")).agg(F.count("*").alias("area"), F.avg("lat").alias("lat0"))
    return C.wave_break_masks(events, nodes, f.select("step", "ilon", "ilat"), ["event"], ["step", "ilon", "ilat"], {"large": F.col("area") >= 40, "northern": F.col("lat0") > 0})


@query()
def g08_normal_sections(spark, sf):
    return P.normal_sections(_at_steps(spark, sf).select("jet_id", "index", "step", "lon", "lat"), roles.field(spark, sf), ["jet_id"], "index", ["step"], ["s"], 4e5, 2e5, *AXES, 36).select("jet_id", "index", "n", "side", r("s_interp").alias("s_interp"))


@query(f"SELECT step, {R('least(floor(ilon / greatest(top, 1) * 6), 5) / 6')} AS norm_index, n, {R('avg(s_interp)')} AS s_interp FROM (SELECT *, (max(ilon) OVER (PARTITION BY step))::DOUBLE AS top FROM sc) GROUP BY 1, 2, 3", FIELD, SECTION)
def g09_relative_dataset(spark, sf):
    out = P.relative_dataset(_sections(spark, sf), ["step"], "ilon", ["s"], 6)
    return out.groupBy("step", r("norm_index").alias("norm_index"), "n").agg(r(F.avg("s_interp_interp" if "s_interp_interp" in out.columns else "s_interp")).alias("s_interp"))


ZERO = """z1 AS (SELECT step, ilon, n, avg(s_interp) OVER (PARTITION BY step, ilon ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM sc),
    z2 AS (SELECT step, ilon, n, avg(v) OVER (PARTITION BY step, n ORDER BY ilon RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM z1),
    z3 AS (SELECT *, (lead(v) OVER w - v) / (lead(n) OVER w - n) AS d FROM z2 WINDOW w AS (PARTITION BY step, ilon ORDER BY n)),
    z4 AS (SELECT *, lag(d) OVER (PARTITION BY step, ilon ORDER BY n) AS b FROM z3),
    z5 AS (SELECT step, ilon, arg_min(CASE WHEN b > 0 AND d <= 0 THEN n END, CASE WHEN b > 0 AND d <= 0 THEN abs(n) + CASE WHEN n < 0 THEN 1e-6 ELSE 0 END END) AS n FROM z4 GROUP BY 1, 2)"""


@query(f"SELECT step, ilon, n, {R('CASE WHEN avg(CASE WHEN n IS NOT NULL THEN 1.0 ELSE 0 END) OVER (PARTITION BY step) >= 0.5 THEN avg(n) OVER (PARTITION BY step ORDER BY ilon RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) END')} AS bias FROM z5", FIELD, SECTION, ZERO)
def g10_zero_line_bias(spark, sf):
    return P.zero_line_bias(_sections(spark, sf), ["step"], "ilon", "s_interp", 1, 1, 2, 0.5).select("step", "ilon", "n", r("bias").alias("bias"))


EXTEND = """en AS (SELECT jet_id, arg_min(lon, index) AS x0, arg_min(lat, index) AS y0, max(index) AS o1, arg_max(lon, index) AS x1, arg_max(lat, index) AS y1, avg(CASE WHEN i < 5 THEN dx END) AS a0, avg(CASE WHEN i < 5 THEN dy END) AS b0,
        avg(CASE WHEN i > n - 5 THEN dx END) AS a1, avg(CASE WHEN i > n - 5 THEN dy END) AS b1
    FROM (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY jet_id) AS n, lead(lon) OVER w - lon AS dx, lead(lat) OVER w - lat AS dy FROM paths WINDOW w AS (PARTITION BY jet_id ORDER BY index)) GROUP BY jet_id)"""


@query(f"SELECT jet_id, index, {R('lat', 4)} AS lat FROM paths UNION ALL SELECT jet_id, -t, {R('y0 - t * b0', 4)} FROM en, (VALUES (1), (2)) v(t) UNION ALL SELECT jet_id, o1 + t, {R('y1 + t * b1', 4)} FROM en, (VALUES (1), (2)) v(t)", PATHS, EXTEND)
def g11_extend_paths(spark, sf):
    return P.extend_paths(roles.paths(spark, sf), ["jet_id"], "index", 2).select("jet_id", "index", r("lat", 4).alias("lat"))


@query(f"SELECT jet_id, index, {R('avg(lat) OVER (PARTITION BY jet_id ORDER BY index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS lat FROM paths", PATHS)
def g12_smooth_paths(spark, sf):
    return P.smooth_paths(roles.paths(spark, sf), ["jet_id"], "index", 2).select("jet_id", "index", r("lat").alias("lat"))


@query(f"SELECT step, ilon, n, {R('avg(n) OVER (PARTITION BY step ORDER BY ilon RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS bias FROM (SELECT step, ilon, arg_max(n, (s_interp, -abs(n), -n)) AS n FROM (SELECT step, ilon, n, s_interp + n * 1e-7 AS s_interp FROM sc) GROUP BY 1, 2)", FIELD, SECTION)
def g10_bias_of_maximum(spark, sf):
    x = _sections(spark, sf).withColumn("s_interp", F.col("s_interp") + F.col("n") * 1e-7)  # no ties
    return P.bias_offset(x, ["step"], "ilon", "s_interp", 2).select("step", "ilon", "n", r("bias").alias("bias"))


@query(f"SELECT jet_id, index, {R('sqrt(pow((((lon - lo + 180) % 360 + 360) % 360) - 180, 2) + pow(lat - la, 2))', 4)} AS d FROM (SELECT *, lag(lon) OVER w AS lo, lag(lat) OVER w AS la FROM paths WINDOW w AS (PARTITION BY jet_id ORDER BY index))", PATHS)
def x01_flat_distance(spark, sf):
    w = Window.partitionBy("jet_id").orderBy("index")
    p = roles.paths(spark, sf).withColumns({"lo": F.lag("lon").over(w), "la": F.lag("lat").over(w)})
    return p.select("jet_id", "index", r(S.flat_distance(F.col("lo"), F.col("la"), F.col("lon"), F.col("lat")), 4).alias("d"))


@query("SELECT dt FROM (SELECT step - lag(step) OVER (ORDER BY step) AS dt FROM (SELECT DISTINCT step FROM series)) WHERE dt IS NOT NULL GROUP BY dt ORDER BY count(*) DESC, dt LIMIT 1", SERIES)
def x04_time_step(spark, sf):
    return fields.time_step(roles.series(spark, sf), "step")


@query("SELECT year, doy, jet, price FROM daily WHERE year IN (1993, 1995, 1997)", DAILY)
def f01_filter_period(spark, sf):
    return E.filter_period(_dated(spark, sf), (1993, 1997, 2)).select("year", "doy", "jet", "price")


@query()
def l06_persistent_patterns(spark, sf):
    """The members' pattern that persists longest, from their lagged covariances, as rows."""
    m = roles.members(spark, sf)
    patterns = L.persistent_patterns(T.lagged_covariance(m, "member", "step", "value", 4), 4, 4)
    rows = [(k, i, abs(float(patterns[i, k]))) for k in range(patterns.shape[1]) for i in range(4)]
    return spark.createDataFrame(rows, "pattern int, member int, weight double")


@query()
def l15_forward_select(spark, sf):
    found = L.forward_select(_marked(spark, sf), ["size", "is_en", "is_fr"], "toxic", L.fold_of(F.col("doc_id"), 2), 2, 2)
    return spark.createDataFrame([(len(names), ",".join(names), float(auc)) for names, auc in found], "n int, features string, auc double")


# features through time --------------------------------------------------------------------------------------------------


def _daily_paths(spark, sf):
    """Path points as short paths, one a user and day; users meet in groups of eight."""
    p = roles.paths(spark, sf, "ts").withColumn("step", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000))
    return p.withColumn("member", F.floor(F.col("jet_id") / 8)).select("member", "step", "jet_id", "index", "lon", "lat", "s", "is_polar")


@query()
def t04_track(spark, sf):
    """Every user-day path with those of its group on the next day."""
    return TR.track(_daily_paths(spark, sf), ["member"], "step").select("member", "step", "jet_id", "jet_id_right", "dist", "lon_overlap", "ds")


@query()
def t05_connect(spark, sf):
    cross = TR.track(_daily_paths(spark, sf), ["member"], "step")
    return TR.connect(cross, ["member"], "step", 8e6, 0.0)


@query()
def k05_medoid(spark, sf):
    arrays = TR.paths_as_arrays(_daily_paths(spark, sf), ["member", "step", "jet_id"], [])
    return TR.medoid(arrays, ["member", "step"], "jet_id")


TRACKS = "tt AS (SELECT member, label, sum(value) AS t, count(*) AS len FROM labels0 GROUP BY 1, 2), tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY round(t, 6) DESC, label) AS k FROM tt) WHERE k <= 2)"


@query("SELECT member, label AS spell, ord, len, ord - min(ord) OVER (PARTITION BY member, label) AS relative_index FROM labels0 JOIN tr USING (member, label)", LABELS, TRACKS)
def t07_spells_from_tracks(spark, sf):
    x = roles.labels(spark, sf).withColumnRenamed("label", "spell")
    return TR.spells_from_tracks(x, ["member"], "ord", "value", 2).select("member", "spell", "ord", "len", "relative_index")


CATS = """cm AS (SELECT jet, step, value, avg(value) OVER (PARTITION BY jet ORDER BY step RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS mean FROM full0),
    cq AS (SELECT jet, quantile_cont(mean, 0.7) AS q FROM cm GROUP BY jet), ch2 AS (SELECT jet, step, value, coalesce(mean > q, false) AS c FROM cm JOIN cq USING (jet)),
    ci2 AS (SELECT *, step - row_number() OVER (PARTITION BY jet ORDER BY step) AS g FROM ch2 WHERE c), cr2 AS (SELECT *, count(*) OVER (PARTITION BY jet, g) AS len FROM ci2),
    cs2 AS (SELECT *, dense_rank() OVER (PARTITION BY jet ORDER BY g) - 1 AS spell FROM cr2 WHERE len >= 2), ct2 AS (SELECT jet, spell, row_number() OVER (PARTITION BY jet ORDER BY round(sum(value), 6) DESC, spell) AS k FROM cs2 GROUP BY 1, 2)"""


@query("SELECT jet, spell, step, len FROM cs2 JOIN ct2 USING (jet, spell) WHERE k <= 3", SERIES, FULL, CATS)
def t08_spells_from_categories(spark, sf):
    out = U.spells_from_categories(roles.series(spark, sf), ["jet"], "step", "value", 4, 0.7, 2, 3)
    return out.select("jet", "spell", "step", "len")


@query("SELECT jet_id, index, 200 * lat - 30 * lon + s * 1e9 / 6371000.0 > 9000 AS eddy_driven FROM paths", PATHS)
def t12_linear_categorise(spark, sf):
    return roles.paths(spark, sf).select("jet_id", "index", U.linear_categorise(F.col("lat"), F.col("lon"), F.col("s") * 1e9).alias("eddy_driven"))


SEASON_ONSET = "so AS (SELECT jet, year, day, coalesce(qty > 60 AND NOT (day - lag(day) OVER (PARTITION BY jet, year ORDER BY day) > 1), qty > 60) AS c, row_number() OVER (PARTITION BY jet, year ORDER BY day) AS i FROM daily), sp2 AS (SELECT jet, year, day, count(*) OVER (PARTITION BY jet, year, g) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY jet, year ORDER BY day) AS g FROM so WHERE c))"


@query("SELECT jet, year, min(day) AS onset FROM sp2 WHERE len >= 2 GROUP BY 1, 2", DAILY, SEASON_ONSET)
def t13_season_onset(spark, sf):
    return Q.season_onset(roles.daily(spark, sf), F.col("qty") > 60, ["jet", "year"], "day", 2)


@query()
def t11_mixture(spark, sf):
    """Polar or subtropical by a mixture of two normal distributions for each season of starts."""
    p = roles.paths(spark, sf).withColumn("period", F.least(F.floor(F.col("index") / 40), F.lit(2)).cast("int"))
    return JT.gmix_categorise(p.drop("is_polar"), ["lat", "s"], "period", "s", tolerance=1e-3).groupBy("period").agg(F.count("*").alias("n"), r(F.avg("is_polar"), 3).alias("is_polar"))


# statistics -------------------------------------------------------------------------------------------------------------


@query(f"SELECT jet, {R('var_samp(qty)', 4)} AS var, {R('greatest(0, var_samp(qty) - 1.959963984540054 * var_samp(qty) * sqrt(2.0 / (count(qty) - 1)))', 4)} AS low, {R('var_samp(qty) + 1.959963984540054 * var_samp(qty) * sqrt(2.0 / (count(qty) - 1))', 4)} AS high FROM (SELECT jet, qty::DOUBLE AS qty FROM daily) GROUP BY jet", DAILY)
def r12_var_ci(spark, sf):
    out = T.var_ci(roles.daily(spark, sf).withColumn("qty", F.col("qty").cast("double")), ["jet"], "qty")
    return out.select("jet", *[r(c, 4).alias(c) for c in ("var", "low", "high")])


PVALS = "pv AS (SELECT jet, year, (sum(qty)::BIGINT * sum(qty)::BIGINT % 997) / 997.0 AS p FROM daily GROUP BY 1, 2), pk AS (SELECT *, row_number() OVER (ORDER BY p, jet, year) AS i, count(*) OVER () AS n FROM pv)"


def _pvals(spark, sf):
    q = F.sum("qty").cast("bigint")
    return roles.daily(spark, sf).groupBy("jet", "year").agg((q * q % 997 / 997.0).alias("p"))


@query("SELECT jet, year, p <= 0.9 * (i - 1) / greatest(n - 1, 1) AS significant FROM pk", DAILY, PVALS)
def r09_fdr(spark, sf):
    return T.fdr(_pvals(spark, sf), "p", 0.9, ["jet", "year"]).select("jet", "year", "significant")


@query("SELECT jet, year, i <= (SELECT coalesce(max(i), 0) FROM pk WHERE p <= 0.9 * i / n) AS significant FROM pk", DAILY, PVALS)
def r09_fdr_step_up(spark, sf):
    return T.fdr(_pvals(spark, sf), "p", 0.9, ["jet", "year"], "bh").select("jet", "year", "significant")


WELCH = "w1 AS (SELECT jet, avg(qty) AS m, stddev_samp(qty) AS s, count(qty) AS n FROM daily WHERE year >= 1996 GROUP BY jet), w2 AS (SELECT jet, avg(qty) AS m2, stddev_samp(qty) AS s2, count(qty) AS n2 FROM daily WHERE year < 1996 GROUP BY jet), w3 AS (SELECT *, s * s / n AS a, s2 * s2 / n2 AS b FROM w1 JOIN w2 USING (jet))"


@query(f"SELECT jet, {R('m - m2')} AS diff, {R('(m - m2) / sqrt(a + b)')} AS t, {R('(a + b) * (a + b) / (a * a / (n - 1) + b * b / (n2 - 1))', 4)} AS free FROM w3", DAILY, WELCH)
def r10_run_welch(spark, sf):
    d = roles.daily(spark, sf)
    out = U.run_welch(d.where("year >= 1996"), d.where("year < 1996"), ["jet"], "qty")
    return out.select("jet", r("diff").alias("diff"), r("t").alias("t"), r("free", 4).alias("free"))


HURST = """h0 AS (SELECT jet, qty::DOUBLE AS x, row_number() OVER (PARTITION BY jet ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY jet) AS n FROM daily),
    h1 AS (SELECT jet, x, i, k, floor(n / pow(2.0, k)) AS size, floor(i / floor(n / pow(2.0, k))) AS chunk FROM h0, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
    h2 AS (SELECT *, x - avg(x) OVER (PARTITION BY jet, k, chunk) AS d FROM h1 WHERE chunk < pow(2.0, k)),
    h3 AS (SELECT *, sum(d) OVER (PARTITION BY jet, k, chunk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM h2),
    h4 AS (SELECT jet, k, chunk, any_value(size) AS size, (max(c) - min(c)) / nullif(stddev_pop(x), 0) AS rs FROM h3 GROUP BY 1, 2, 3),
    h5 AS (SELECT jet, k, any_value(size) AS size, avg(rs) AS rs FROM h4 GROUP BY 1, 2)"""


@query(f"SELECT jet, {R('regr_slope(ln(rs), ln(size))')} AS hurst FROM h5 GROUP BY jet", DAILY, HURST)
def r16_hurst(spark, sf):
    d = roles.daily(spark, sf).withColumn("qty", F.col("qty").cast("double"))
    return T.hurst(d, "qty", ["jet"], "day", [1, 2, 3, 4, 5]).withColumn("hurst", r("hurst"))


PARTIAL = """q0 AS (SELECT jet, day, price, qty, lag(price) OVER w AS p1, lag(qty) OVER w AS q1 FROM daily WINDOW w AS (PARTITION BY jet ORDER BY day)),
    q2 AS (SELECT jet, sum(price * p1) / sum(p1 * p1) AS bp, sum(qty * q1)::DOUBLE / sum(q1 * q1) AS bq FROM q0 GROUP BY jet), q3 AS (SELECT jet, day, price - bp * p1 AS rp, qty - bq * q1 AS rq FROM q0 JOIN q2 USING (jet)),
    q4 AS (SELECT jet, rp, lag(rq, 2) OVER (PARTITION BY jet ORDER BY day) AS rl FROM q3)"""


@query(f"SELECT jet, {R('corr(rp, rl)')} AS r FROM q4 GROUP BY jet", DAILY, PARTIAL)
def r19_partial_correlation(spark, sf):
    return T.partial_correlation(roles.daily(spark, sf), "price", "qty", ["jet"], "day", 2).withColumn("r", r("r"))


@query()
def r04_doy_trends(spark, sf):
    monthly = roles.daily(spark, sf).groupBy("jet", "year", "month").agg(F.avg("qty").alias("qty"))
    return U.doy_trends(monthly, "qty", ["jet"], "month", "year", 3, 2, 100)


@query()
def r05_quantile_significance(spark, sf):
    return U.quantile_significance(roles.daily(spark, sf), "qty", 4, "price", ["jet"], "day", 50)


@query()
def r08_composite_significance(spark, sf):
    """Members' values at the steps of all categories' spells, under a false discovery rate."""
    spells = _spells(spark, sf).select(F.concat_ws("-", "jet", "spell").alias("spell"), "step")
    return U.composite_significance(roles.members(spark, sf), spells, ["member"], "step", "value", 100, 0.1)


@query()
def r07_field_significance(spark, sf):
    f = roles.field(spark, sf)
    return T.field_significance(f.where("step % 12 in (0, 1, 11)"), f, ["ilon", "ilat"], "step", "s", 50)


@query()
def r21_draw_distribution(spark, sf):
    return U.draw_distribution(roles.labels(spark, sf), ["member"], "label", F.col("member") % 4 == 0, 50)


# learning ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT step, count(*) AS n, {R('sum(s * sqrt(cos(radians(lat))))')} AS total, {R('arg_min(s * sqrt(cos(radians(lat))), (ilat, ilon))')} AS first FROM field GROUP BY step", FIELD)
def l01_feature_vectors(spark, sf):
    from pyspark.ml.functions import vector_to_array

    v = L.feature_vectors(roles.field(spark, sf).select("step", "ilat", "ilon", "s", "lat"), ["step"], ["ilat", "ilon"], "s").select("step", vector_to_array("features").alias("v"))
    return v.select("step", F.size("v").cast("bigint").alias("n"), r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), r(F.col("v")[0]).alias("first"))


PROJ = "pj AS (SELECT member, step, value - 12 AS v, value - 12 AS raw FROM members), pz AS (SELECT *, v / stddev_samp(v) OVER (PARTITION BY member) AS z FROM pj)"


@query("SELECT step, CASE WHEN abs(z) < 0.8 THEN 0 ELSE sign(z) * (member + 1) END::BIGINT AS label FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY abs(z) DESC, member) AS k FROM pz) WHERE k = 1", MEMBERS, PROJ)
def l05_labels_from_projections(spark, sf):
    x = roles.members(spark, sf).withColumn("value", F.col("value") - 12)
    return L.labels_from_projections(x, ["step"], "member", "value", 0.8)


JACCARD = """hot AS (SELECT jet, step FROM series WHERE value > 12), hn AS (SELECT jet, count(*) AS n FROM hot GROUP BY jet),
    jd AS (SELECT a.jet AS a, b.jet AS b, 1 - count(*) / (any_value(na.n) + any_value(nb.n) - count(*)) AS d FROM hot a JOIN hot b ON a.step = b.step AND a.jet < b.jet JOIN hn na ON na.jet = a.jet JOIN hn nb ON nb.jet = b.jet GROUP BY 1, 2),
    ed AS (SELECT ascii(a[1]) AS a, ascii(b[1]) AS b FROM jd WHERE d <= 0.9 UNION ALL SELECT ascii(b[1]), ascii(a[1]) FROM jd WHERE d <= 0.9)"""


@query("WITH RECURSIVE placeholder AS (SELECT 1) SELECT 1".replace("WITH RECURSIVE placeholder AS (SELECT 1) SELECT 1", "SELECT x.a::BIGINT AS cell, least(min(x.a), min(x.b), min(y.b), min(z.b), min(w.b))::BIGINT AS region FROM ed x LEFT JOIN ed y ON x.b = y.a LEFT JOIN ed z ON y.b = z.a LEFT JOIN ed w ON z.b = w.a GROUP BY x.a"), SERIES, JACCARD)
def l08_regions(spark, sf):
    d = L.cell_jaccard(roles.series(spark, sf), F.col("value") > 12, "jet", "step")
    return L.regions(d.withColumns({"a": F.ascii("a").cast("bigint"), "b": F.ascii("b").cast("bigint")}), 0.9)


PREPARED = "tm AS (SELECT member, step, p AS timescale, (SELECT avg(b.value) FROM members b WHERE b.member = a.member AND b.step BETWEEN a.step - p + 1 AND a.step) AS value FROM members a, (VALUES (1), (4)) t(p)), sg2 AS (SELECT *, sum(j) OVER (PARTITION BY member, timescale ORDER BY step) AS seg FROM (SELECT *, CASE WHEN step - lag(step) OVER (PARTITION BY member, timescale ORDER BY step) > 1 THEN 1 ELSE 0 END AS j FROM tm))"


@query(f"SELECT member, step, timescale, 2 AS lag, {R('lag(value, 2) OVER (PARTITION BY member, timescale, seg ORDER BY step)')} AS value FROM sg2", MEMBERS, PREPARED)
def l10_prepare_predictors(spark, sf):
    out = L.prepare_predictors(roles.members(spark, sf), ["value"], ["member"], "step", [1, 4], [2])
    return out.select("member", "step", "timescale", "lag", r("value").alias("value"))


REGIME = "rz AS (SELECT member, step, (value - avg(value) OVER (PARTITION BY member)) / stddev_samp(value) OVER (PARTITION BY member) AS z FROM members), rb AS (SELECT step, CASE WHEN z >= 0.5 THEN member + 1 ELSE 0 END AS label FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY z DESC, member) AS k FROM rz) WHERE k = 1), rr AS (SELECT *, sum(c) OVER (ORDER BY step) AS run FROM (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (ORDER BY step) THEN 1 ELSE 0 END AS c FROM rb))"


@query("SELECT step, CASE WHEN count(*) OVER (PARTITION BY run) >= 2 THEN label ELSE 0 END::BIGINT AS label FROM rr", MEMBERS, REGIME)
def l19_regime_index(spark, sf):
    return L.regime_index(roles.members(spark, sf), "step", "member", "value", 0.5, 2)


def _marked(spark, sf):
    x = roles.table(spark, sf, "labels").join(roles.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return x.withColumns({"size": F.log("n_chars"), **{f"is_{k}": (F.col("lang") == k).cast("double") for k in ("en", "fr", "de")}})


@query()
def l11_trend_baseline(spark, sf):
    s = _full(spark, sf).withColumn("hit", (F.coalesce("value", F.lit(0.0)) > 12).cast("int"))
    return U.trend_baseline(s.select("jet", "step", "hit"), ["jet"], "step", "hit").withColumn("prob", r("prob"))


@query()
def l14_importances(spark, sf):
    return U.importances(_marked(spark, sf), ["size", "is_en", "is_fr"], "toxic", "doc_id", L.fold_of(F.col("doc_id"), 3))


@query()
def l16_leave_one_out(spark, sf):
    return U.leave_one_out(_marked(spark, sf), ["size", "is_en", "is_fr"], "toxic", L.fold_of(F.col("doc_id"), 2), 2)


@query()
def l17_tercile_combinations(spark, sf):
    x = _marked(spark, sf).withColumns({"half": F.col("n_chars") % 1000 / 1.0, "id_mod": (F.col("doc_id") % 97).cast("double"), "chars": F.col("n_chars").cast("double")})
    return U.tercile_combinations(x, ["chars", "half", "id_mod", "size"], "toxic", L.fold_of(F.col("doc_id"), 2), 2)
