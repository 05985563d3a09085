"""Queries over the test tables, each with the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stratus.functions import measures as M, sphere as S
from stratus.operators import aggregate as A, contours as C, graph, grid as G, jets as JT, joins as J, learn as L, select as E, sequence as Q, stats as T

from . import roles
from .roles import DAILY, FIELD, LABELS, MEMBERS, PATHS, SERIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return register


#: Added before rounding, so that exact halves fall to one side in every engine.
NUDGE = 3.1e-9


def r(x: Column | str, n: int = 6) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x) + NUDGE, n)


def R(x: str, n: int = 6) -> str:  # noqa: N802
    return f"(round(({x}) + {NUDGE}, {n}) + 0.0)"


# the flagship: spells of extreme values ---------------------------------------------------------------------------------

FULL = """axis AS (SELECT jet, step FROM (SELECT DISTINCT jet FROM series), (SELECT unnest(range((SELECT min(step) FROM series), (SELECT max(step) + 1 FROM series))) AS step)),
    full0 AS (SELECT jet, step, value FROM axis LEFT JOIN series USING (jet, step)),
    cut AS (SELECT jet, quantile_cont(value, 0.8) AS q FROM full0 GROUP BY jet),
    cond AS (SELECT jet, step, value, value > q AS c, row_number() OVER (PARTITION BY jet ORDER BY step) AS i FROM full0 JOIN cut USING (jet)),
    no AS (SELECT *, coalesce(NOT c, false) AS nn, coalesce(c, false) AS yy FROM cond),
    ch AS (SELECT *, CASE WHEN nn IS DISTINCT FROM lag(nn) OVER (PARTITION BY jet ORDER BY step) THEN 1 ELSE 0 END AS n0 FROM no),
    hr AS (SELECT *, sum(n0) OVER (PARTITION BY jet ORDER BY step) AS hrun FROM ch),
    ins AS (SELECT *, yy OR (nn AND count(*) OVER (PARTITION BY jet, hrun) <= 1 AND min(i) OVER (PARTITION BY jet, hrun) > 1) AS inside FROM hr),
    ic AS (SELECT *, CASE WHEN inside IS DISTINCT FROM lag(inside) OVER (PARTITION BY jet ORDER BY step) THEN 1 ELSE 0 END AS n1 FROM ins),
    ir AS (SELECT *, sum(n1) OVER (PARTITION BY jet ORDER BY step) AS irun FROM ic),
    runs AS (SELECT jet, irun, min(step) AS first, max(step) AS last, count(*) AS len, max(value) AS peak FROM ir WHERE inside GROUP BY jet, irun HAVING count(*) >= 2),
    spells AS (SELECT *, row_number() OVER (PARTITION BY jet ORDER BY irun) - 1 AS spell FROM runs),
    rows_ AS (SELECT jet, spell, step, value, len, step - first AS relative_index FROM spells JOIN ir USING (jet, irun))"""


def _full(spark, sf):
    return J.complete_index(roles.series(spark, sf).select("jet", "step", "value"), ["jet"], "step")


def _spells(spark, sf):
    hot = E.quantile_exceed(_full(spark, sf), "value", 0.8, ["jet"])
    return Q.get_spells(hot, F.col("exceeds"), ["jet"], "step", hole_size=1, min_len=2).drop("exceeds")


@query("SELECT jet, spell, first, last, len, peak FROM spells", SERIES, FULL)
def t10_persistent_spells(spark, sf):
    return Q.spell_summary(_spells(spark, sf), ["jet"], "step", "value")


@query("SELECT jet, spell, step, value, len, relative_index FROM rows_", SERIES, FULL)
def t09_spell_rows(spark, sf):
    return _spells(spark, sf)


@query("SELECT jet, spell, len, unnest(range(first - 2, last + 4)) AS step, unnest(range(-2, last - first + 4)) AS relative_index FROM spells", SERIES, FULL)
def w15_extend_spells(spark, sf):
    return Q.extend_spells(_spells(spark, sf), ["jet"], "step", 2, 3)


@query(f"SELECT a.jet, a.spell, count(*) AS n, {R('avg(d.value)')} AS value FROM rows_ a JOIN series d USING (jet, step) GROUP BY 1, 2", SERIES, FULL)
def j12_spell_join(spark, sf):
    rows = J.spell_join(_spells(spark, sf).drop("value"), roles.series(spark, sf), "step", ["jet"])
    return rows.groupBy("jet", "spell").agg(F.count("*").alias("n"), r(F.avg("value")).alias("value"))


@query("SELECT jet, step, coalesce(len, 0) AS target FROM full0 LEFT JOIN (SELECT jet, step, len FROM rows_) USING (jet, step)", SERIES, FULL)
def l09_make_targets(spark, sf):
    hot = E.quantile_exceed(_full(spark, sf), "value", 0.8, ["jet"])
    return L.make_targets(hot, F.col("exceeds"), ["jet"], "step", 1, 2)


@query("SELECT jet, spell, step, relative_index FROM rows_ WHERE abs(relative_index) <= 2", SERIES, FULL)
def f07_around_onset(spark, sf):
    return E.around_onset(_spells(spark, sf), 2).select("jet", "spell", "step", "relative_index")


@query(f"SELECT jet, sum(CASE WHEN len >= 3 THEN 1 ELSE 0 END)::BIGINT AS long_stays, {R('avg(len)')} AS mean_len, {R('quantile_cont(len::DOUBLE, 0.95)')} AS q95_len FROM spells GROUP BY jet", SERIES, FULL)
def a53_residence_times(spark, sf):
    spells = Q.spell_summary(_spells(spark, sf), ["jet"]).withColumnRenamed("jet", "value")
    out = A.residence_times(spells, 3)
    return out.select(F.col("value").alias("jet"), "long_stays", r("mean_len").alias("mean_len"), r("q95_len").alias("q95_len"))


@query(f"SELECT jet, relative_index, count(*) AS n, {R('avg(value)')} AS mean, {R('avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(value))')} AS low, {R('avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(value))')} AS high FROM rows_ GROUP BY 1, 2 HAVING count(DISTINCT spell) >= 4", SERIES, FULL)
def r13_relative_time_composite(spark, sf):
    out = T.relative_time_composite(_spells(spark, sf), ["jet"], "value", 4)
    return out.select("jet", "relative_index", F.col("spells").alias("n"), *[r(c).alias(c) for c in ("mean", "low", "high")])


@query("SELECT jet, spell, first, len, peak FROM (SELECT *, row_number() OVER (PARTITION BY jet ORDER BY peak DESC, spell) AS k FROM spells) WHERE k <= 3", SERIES, FULL)
def k03_top_spells(spark, sf):
    return A.top_n(Q.spell_summary(_spells(spark, sf), ["jet"], "step", "value"), ["jet"], [F.desc("peak"), F.col("spell")], 3).select("jet", "spell", "first", "len", "peak")


# selection --------------------------------------------------------------------------------------------------------------


@query("SELECT day, jet, qty FROM daily WHERE year BETWEEN 1995 AND 1998 AND month IN (12, 1, 2)", DAILY)
def f05_extract_winters(spark, sf):
    d = roles.daily(spark, sf).withColumn("time", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")))
    return E.extract(d, (1995, 1998), "DJF").select("day", "jet", "qty")


@query("SELECT day, jet, qty FROM daily WHERE doy >= 330 OR doy <= 45", DAILY)
def f02_season_wrapped(spark, sf):
    d = roles.daily(spark, sf).withColumn("time", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")))
    return E.filter_season(d, (330, 45)).select("day", "jet", "qty")


@query("SELECT step, ilon, ilat, s FROM field WHERE (lon >= 150 OR lon <= -120) AND lat BETWEEN 20 AND 70", FIELD)
def f03_region_wrapped(spark, sf):
    return E.filter_region(roles.field(spark, sf), 150, -120, 20, 70).select("step", "ilon", "ilat", "s")


@query(f"SELECT step, ilon, lev, {R('avg(s)')} AS s FROM (SELECT *, CASE WHEN lat BETWEEN 5 AND 35 THEN '5-35' WHEN lat = 45 THEN '45' END AS lev FROM field) WHERE lev IS NOT NULL GROUP BY 1, 2, 3", FIELD)
def f04_levels(spark, sf):
    out = E.filter_levels(roles.field(spark, sf).withColumnRenamed("lat", "lev"), [45, (5, 35)], ["step", "ilon"], ["s"])
    return out.withColumn("s", r("s"))


@query(f"SELECT day, jet, {R('(price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ())')} AS price FROM daily", DAILY)
def f09_minmax_scale(spark, sf):
    return E.minmax_scale(roles.daily(spark, sf), ["price"]).select("day", "jet", r("price").alias("price"))


@query(f"SELECT day, jet, {R('(price - avg(price) OVER w) / stddev_samp(price) OVER w')} AS price FROM daily WINDOW w AS (PARTITION BY jet)", DAILY)
def f10_zscore(spark, sf):
    return E.zscore(roles.daily(spark, sf), ["price"], ["jet"]).select("day", "jet", r("price").alias("price"))


@query("SELECT step, jet, value < q AS exceeds FROM series JOIN (SELECT jet, quantile_cont(value, 0.2) AS q FROM series GROUP BY jet) USING (jet)", SERIES)
def f11_quantile_exceed(spark, sf):
    return E.quantile_exceed(roles.series(spark, sf), "value", 0.2, ["jet"]).select("step", "jet", "exceeds")


@query("SELECT jet_id, index, CASE WHEN is_polar > 1 - 0.5 / 1.5 THEN 'EDJ' WHEN is_polar < 0.5 / 1.5 THEN 'STJ' ELSE 'Hybrid' END AS jet FROM paths", PATHS)
def f12_categorise(spark, sf):
    return roles.paths(spark, sf).select("jet_id", "index", E.categorise(F.col("is_polar"), 0.5, True).alias("jet"))


@query("SELECT step, jet, coalesce(CASE WHEN value <= 40 THEN value END, m) AS value FROM series, (SELECT avg(CASE WHEN value <= 40 THEN value END) AS m FROM series)".replace(", m)", ", " + R("m") + ")"), SERIES)
def f14_fill_mean(spark, sf):
    s = roles.series(spark, sf).withColumn("value", F.when(F.col("value") <= 40, F.col("value")))
    return E.fill_missing(s, "fill_mean", {"value": 0.0}).select("step", "jet", r("value").alias("value"))


@query("SELECT day, jet, hoy, week FROM (SELECT day, jet, (24 * (doy - 1))::BIGINT AS hoy, weekofyear(DATE '1970-01-01' + day::INTEGER) AS week FROM daily)", DAILY)
def f20_clim_keys(spark, sf):
    d = roles.daily(spark, sf).withColumn("time", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).cast("timestamp"))
    return d.select("day", "jet", E.clim_key(F.col("time"), "hourofyear").alias("hoy"), E.clim_key(F.col("time"), "week").alias("week"))


@query("SELECT step, jet, CASE WHEN value > m + 0.5 * s THEN 1 ELSE 0 END + CASE WHEN value < m - 0.5 * s THEN 2 ELSE 0 END AS group_id FROM series, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM series)", SERIES)
def f22_classify_vs_baseline(spark, sf):
    s = roles.series(spark, sf)
    return E.classify_vs_baseline(s, ["value"], s).select("step", "jet", "group_id")


@query(f"SELECT step, {R('quantile_cont(s, 0.75)')} AS s_thresh FROM field GROUP BY step", FIELD)
def f26_field_threshold(spark, sf):
    return E.field_threshold(roles.field(spark, sf), "s", 0.75, ["step"]).select("step", r("s_thresh").alias("s_thresh"))


# sequences --------------------------------------------------------------------------------------------------------------

RUNS = """ch AS (SELECT *, CASE WHEN (label = 0) IS DISTINCT FROM lag(label = 0) OVER w THEN 1 ELSE 0 END AS c, row_number() OVER w - 1 AS i FROM labels0 WINDOW w AS (PARTITION BY member ORDER BY ord)),
    rn AS (SELECT *, sum(c) OVER (PARTITION BY member ORDER BY ord) AS run FROM ch)"""


@query("SELECT member, min(i) AS start, count(*) AS len, any_value(label = 0) AS value FROM rn GROUP BY member, run", LABELS, RUNS)
def w01_run_lengths(spark, sf):
    return Q.run_lengths(roles.labels(spark, sf), F.col("label") == 0, ["member"], "ord")


@query("SELECT member, sum(CASE WHEN label <> p THEN 1 ELSE 0 END)::BIGINT AS jumps FROM (SELECT *, lag(label) OVER (PARTITION BY member ORDER BY ord) AS p FROM labels0) GROUP BY member HAVING count(p) > 0", LABELS)
def w25_label_jumps(spark, sf):
    return Q.label_jumps(roles.labels(spark, sf), ["member"], "ord", "label").where("jumps is not null")


@query(f"SELECT member, ord, {R('coalesce((lead(value) OVER w - lag(value) OVER w) / 2, lead(value) OVER w - value, value - lag(value) OVER w)')} AS d FROM labels0 WINDOW w AS (PARTITION BY member ORDER BY ord)", LABELS)
def w06_central_diff(spark, sf):
    return roles.labels(spark, sf).select("member", "ord", r(Q.central_diff("value", ["member"], "ord")).alias("d"))


CLIM = "clim AS (SELECT jet, doy, avg(qty) AS qty FROM daily GROUP BY jet, doy)"


@query(f"SELECT jet, doy, {R('avg(b.qty)')} AS qty FROM clim a JOIN (SELECT jet AS j, doy + o AS d, qty FROM clim, (VALUES (0), (366), (-366)) v(o)) b ON a.jet = b.j AND b.d BETWEEN a.doy - 15 AND a.doy + 15 GROUP BY jet, doy", DAILY, CLIM)
def w08_periodic_rolling(spark, sf):
    clim = A.climatology(roles.daily(spark, sf), ["qty"], ["jet"], "doy")
    return Q.periodic_rolling(clim, 31, {"qty": F.avg("qty")}, "doy", ["jet"], 366).select("jet", "doy", r("qty").alias("qty"))


@query(f"SELECT member, step, p AS timescale, {R('(SELECT avg(b.value) FROM members b WHERE b.member = a.member AND b.step BETWEEN a.step - p + 1 AND a.step)')} AS value FROM members a, (VALUES (1), (4), (12)) t(p)", MEMBERS)
def w10_timescales(spark, sf):
    return Q.timescales(roles.members(spark, sf), ["value"], ["member"], "step", [1, 4, 12]).select("member", "step", "timescale", r("value").alias("value"))


@query("SELECT member, step, k AS lag, lag(value, k) OVER (PARTITION BY member, seg, k ORDER BY step) AS value FROM (SELECT *, sum(j) OVER (PARTITION BY member ORDER BY step) AS seg FROM (SELECT *, CASE WHEN step - lag(step) OVER (PARTITION BY member ORDER BY step) > 1 THEN 1 ELSE 0 END AS j FROM members)), (VALUES (1), (3)) t(k)".replace("lag(value, k) OVER (PARTITION BY member, seg, k ORDER BY step)", "CASE WHEN k = 1 THEN lag(value, 1) OVER (PARTITION BY member, seg, k ORDER BY step) ELSE lag(value, 3) OVER (PARTITION BY member, seg, k ORDER BY step) END"), MEMBERS)
def w11_lags(spark, sf):
    return Q.lags(roles.members(spark, sf), ["value"], ["member"], "step", [1, 3]).select("member", "step", "lag", "value")


@query(f"SELECT day, jet, {R('price - a * day - b', 4)} AS price FROM daily JOIN (SELECT jet, regr_slope(price, day) AS a, regr_intercept(price, day) AS b FROM daily GROUP BY jet) USING (jet)", DAILY)
def w12_detrend(spark, sf):
    return Q.detrend(roles.daily(spark, sf), ["price"], ["jet"], "day").select("day", "jet", r("price", 4).alias("price"))


HOLES = """h AS (SELECT jet, step, value FROM full0), 
    iv AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, first_value(value IGNORE NULLS) OVER f AS v1, last_value(CASE WHEN value IS NOT NULL THEN step END IGNORE NULLS) OVER b AS t0,
        first_value(CASE WHEN value IS NOT NULL THEN step END IGNORE NULLS) OVER f AS t1 FROM h
        WINDOW b AS (PARTITION BY jet ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY jet ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _holes(spark, sf):
    return _full(spark, sf).withColumn("value", F.when(F.col("step") % 5 != 0, F.col("value")))


HOLED = SERIES, FULL, HOLES.replace("SELECT jet, step, value FROM full0", "SELECT jet, step, CASE WHEN step % 5 <> 0 THEN value END AS value FROM full0")


@query(f"SELECT jet, step, {R('CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * ((step - t0) / (t1 - t0)) END')} AS value FROM iv", *HOLED)
def w14_interpolate(spark, sf):
    return Q.interpolate(_holes(spark, sf), "value", ["jet"], "step").select("jet", "step", r("value").alias("value"))


@query(f"SELECT jet_id, index, {R('d')} AS signed_step, {R('abs(d)')} AS lon_step FROM (SELECT *, (((lon - lag(lon) OVER w + 180) % 360 + 360) % 360) - 180 AS d FROM paths WINDOW w AS (PARTITION BY jet_id ORDER BY index))", PATHS)
def w13_lon_steps(spark, sf):
    return Q.lon_steps(roles.paths(spark, sf), ["jet_id"], "index").select("jet_id", "index", r("signed_step").alias("signed_step"), r("lon_step").alias("lon_step"))


@query("SELECT jet_id, index, sum(g) OVER (PARTITION BY jet_id ORDER BY index)::BIGINT AS part FROM (SELECT *, CASE WHEN abs(lat - lag(lat) OVER (PARTITION BY jet_id ORDER BY index)) > 30 THEN 1 ELSE 0 END AS g FROM paths)", PATHS)
def w19_split_on_gap(spark, sf):
    p = roles.paths(spark, sf)
    step = F.abs(F.col("lat") - F.lag("lat").over(Window.partitionBy("jet_id").orderBy("index")))
    return Q.split_on_gap(p.withColumn("g", step), ["jet_id"], "index", F.col("g"), 30.0).select("jet_id", "index", "part")


WEIGHTS = [1.0, 2.0, 3.0, 2.0, 1.0]


@query(f"SELECT member, step, {R('CASE WHEN n = 5 THEN f END')} AS low FROM members LEFT JOIN (SELECT member, step - o AS step, sum(value * w) AS f, count(*) AS n FROM members, (VALUES (-2, 1.0), (-1, 2.0), (0, 3.0), (1, 2.0), (2, 1.0)) t(o, w) GROUP BY 1, 2) USING (member, step)", MEMBERS)
def w20_fir_filter(spark, sf):
    return Q.fir_filter(roles.members(spark, sf), "value", ["member"], "step", WEIGHTS, "low").select("member", "step", r("low").alias("low"))


@query("SELECT member, min(ord) AS first, max(ord) AS last, count(*) AS len, any_value(label) AS value FROM (SELECT *, sum(c) OVER (PARTITION BY member ORDER BY ord) AS run FROM (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY member ORDER BY ord) THEN 1 ELSE 0 END AS c FROM labels0)) GROUP BY member, run HAVING count(*) >= 2", LABELS)
def w24_label_spells(spark, sf):
    return Q.label_spells(roles.labels(spark, sf), ["member"], "ord", "label", min_len=2).drop("run")


# joins ------------------------------------------------------------------------------------------------------------------


@query("SELECT step, arg_min(v, abs(v - step)) AS nearest FROM (SELECT DISTINCT step FROM series), (VALUES (78890), (78905), (78931), (79002)) t(v) GROUP BY step".replace("abs(v - step)", "abs(v - step) * 1000000 + v"), SERIES)
def j01_nearest_map(spark, sf):
    axis = spark.createDataFrame([(78890,), (78905,), (78931,), (79002,)], "step bigint")
    return J.nearest_map(roles.series(spark, sf), axis, "step")


@query(f"SELECT a.step, count(*) AS pairs, {R('avg(b.s - a.s)')} AS ds FROM field a JOIN field b ON b.step = a.step + 1 AND a.ilon = b.ilon AND a.ilat = b.ilat GROUP BY a.step", FIELD)
def j07_successor_join(spark, sf):
    pairs = J.successor_join(roles.field(spark, sf).select("ilon", "ilat", "step", "s"), ["ilon", "ilat"], "step", 1, "s").where("s_right is not null")
    return pairs.groupBy("step").agg(F.count("*").alias("pairs"), r(F.avg(F.col("s_right") - F.col("s"))).alias("ds"))


@query("SELECT a.jet_id, a.index AS i, b.index AS j FROM paths a JOIN paths b ON a.jet_id = b.jet_id AND a.index < b.index AND sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2) <= 2.5", PATHS)
def j08_close_pairs(spark, sf):
    return J.close_pairs(roles.paths(spark, sf), ["jet_id"], "index", "lon", "lat", 2.5).select("jet_id", "i", "j")


@query("SELECT jet, step, value FROM full0", SERIES, FULL)
def j19_complete_index(spark, sf):
    return _full(spark, sf)


@query(f"SELECT step, region, {R('avg(s)')} AS s FROM field JOIN (SELECT n_nationkey AS ilon, n_regionkey AS region FROM nation) USING (ilon) GROUP BY 1, 2", FIELD)
def j15_regionalize(spark, sf):
    cells = roles.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("ilon"), F.col("n_regionkey").cast("bigint").alias("region"))
    return J.regionalize(roles.field(spark, sf), cells, ["ilon"], ["step"], "s").withColumn("s", r("s"))


@query("SELECT w.step, w.is_polar, arg_min(f.jet, abs(f.value - w.is_polar)) AS jet FROM (SELECT step, max(value) AS is_polar FROM series GROUP BY step) w JOIN series f USING (step) GROUP BY 1, 2", SERIES)
def j16_closest_attribute(spark, sf):
    s = roles.series(spark, sf).withColumnRenamed("value", "is_polar")
    return J.closest_attribute(s.groupBy("step").agg(F.max("is_polar").alias("is_polar")), s, ["step"], "is_polar", "jet")


@query(f"SELECT k AS lag, count(*) AS n, {R('avg(b.value)')} AS value FROM (SELECT DISTINCT step FROM rows_ WHERE relative_index = 0) a, (VALUES (-4), (0), (4)) t(k), series b WHERE b.step = a.step + k GROUP BY k", SERIES, FULL)
def j17_lag_cross(spark, sf):
    onset = _spells(spark, sf).where("relative_index = 0").select("step").distinct()
    rows = J.lag_cross(onset, [-4, 0, 4], "step").join(roles.series(spark, sf), "step")
    return rows.groupBy("lag").agg(F.count("*").alias("n"), r(F.avg("value")).alias("value"))


@query(f"SELECT a.jet, b.jet AS jet_other, {R('avg(a.value - b.value)')} AS diff FROM series a JOIN series b USING (step) WHERE a.jet <> b.jet GROUP BY 1, 2", SERIES)
def j20_other_feature(spark, sf):
    pairs = J.other_feature(roles.series(spark, sf).select("step", "jet", "value"), ["step"], "jet", ["value"])
    return pairs.groupBy("jet", "jet_other").agg(r(F.avg(F.col("value") - F.col("value_other"))).alias("diff"))


@query(f"SELECT jet, doy, {R('a.qty - b.qty')} AS qty FROM (SELECT jet, doy, avg(qty) AS qty FROM daily WHERE year >= 1999 GROUP BY 1, 2) a JOIN (SELECT jet, doy, avg(qty) AS qty FROM daily WHERE year < 1999 GROUP BY 1, 2) b USING (jet, doy)", DAILY)
def j21_run_difference(spark, sf):
    d = roles.daily(spark, sf)
    part = lambda c: A.climatology(d.where(c), ["qty"], ["jet"], "doy")
    return J.run_difference(part("year >= 1999"), part("year < 1999"), ["jet", "doy"], ["qty"]).withColumn("qty", r("qty"))


@query("SELECT step, max(CASE WHEN jet = 'click' THEN value END) AS value_click, max(CASE WHEN jet = 'error' THEN value END) AS value_error FROM series GROUP BY step", SERIES)
def j22_wide(spark, sf):
    return J.wide(roles.series(spark, sf), ["step"], "jet", ["click", "error"], ["value"])


@query("SELECT step, ilon, ilat, coalesce(b.value, 0.0) AS value FROM field LEFT JOIN (SELECT step, ilon, ilat, max(s) AS value FROM field WHERE s > 30 GROUP BY 1, 2, 3) b USING (step, ilon, ilat)", FIELD)
def j11_rasterize(spark, sf):
    f = roles.field(spark, sf)
    return J.rasterize(f.where("s > 30"), f, ["step", "ilon", "ilat"], F.col("s")).select("step", "ilon", "ilat", "value")


# aggregation ------------------------------------------------------------------------------------------------------------


@query(f"SELECT jet_id, {R('sum(lat * s) / sum(s)')} AS mean_lat, {R('degrees(atan2(sum(sin(radians(lon)) * s), sum(cos(radians(lon)) * s)))', 4)} AS mean_lon FROM paths GROUP BY jet_id", PATHS)
def a02_circular_mean(spark, sf):
    return roles.paths(spark, sf).groupBy("jet_id").agg(r(M.weighted_mean(F.col("lat"), F.col("s"))).alias("mean_lat"), r(M.circular_mean(F.col("lon"), F.col("s")), 4).alias("mean_lon"))


HAVERSINE = "2 * 6371000.0 * asin(sqrt(CASE WHEN pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2) > 1 THEN 1 ELSE pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2) END))"


@query(f"SELECT jet_id, {R(f'coalesce(sum({HAVERSINE} * (s + sl) / 2), 0) / 1e6', 4)} AS int FROM (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(s) OVER w AS sl FROM paths WINDOW w AS (PARTITION BY jet_id ORDER BY index)) GROUP BY jet_id", PATHS)
def a03_path_integral(spark, sf):
    return A.path_integral(roles.paths(spark, sf), ["jet_id"], "index", F.col("s")).select("jet_id", r(F.col("int") / 1e6, 4).alias("int"))


@query("SELECT step, floor(ilat / 3)::BIGINT AS ilat, floor(ilon / 4)::BIGINT AS ilon, max(s) AS s FROM field GROUP BY 1, 2, 3", FIELD)
def a04_coarsen(spark, sf):
    return A.coarsen(roles.field(spark, sf), {"ilat": 3, "ilon": 4}, ["step"], {"s": F.max("s")})


@query(f"SELECT day, jet, {R('(qty - avg(qty) OVER w) / stddev_samp(qty) OVER w')} AS qty FROM daily WINDOW w AS (PARTITION BY jet, month)", DAILY)
def a07_anomaly(spark, sf):
    return A.anomaly(roles.daily(spark, sf), ["qty"], ["jet"], "month", True).select("day", "jet", r("qty").alias("qty"))


SMOOTH = """fit AS (SELECT jet, doy, regr_slope(qty, year) AS a, regr_avgx(qty, year) AS x FROM daily GROUP BY 1, 2),
    det AS (SELECT day, jet, doy, qty - coalesce(CASE WHEN isfinite(a) THEN a * (year - x) END, 0) AS qty FROM daily JOIN fit USING (jet, doy)),
    c0 AS (SELECT jet, doy, avg(qty) AS m, stddev_samp(qty) AS s FROM det GROUP BY 1, 2),
    c1 AS (SELECT a.jet, a.doy, avg(b.m) AS m, avg(b.s) AS s FROM c0 a JOIN (SELECT jet AS j, doy + o AS d, m, s FROM c0, (VALUES (0), (366), (-366)) v(o)) b ON a.jet = b.j AND b.d BETWEEN a.doy - 15 AND a.doy + 15 GROUP BY 1, 2)"""


@query(f"SELECT day, jet, {R('(qty - m) / nullif(s, 0)', 5)} AS qty FROM det JOIN c1 USING (jet, doy)", DAILY, SMOOTH)
def a08_smooth_anomaly(spark, sf):
    return A.smooth_anomaly(roles.daily(spark, sf), ["qty"], ["jet"], "doy", 31, "year", True).select("day", "jet", r("qty", 5).alias("qty"))


@query(f"SELECT member, step, {R('avg(value)')} AS mean, max(value) AS peak FROM (SELECT member, floor(step / 4)::BIGINT AS step, value FROM members) GROUP BY 1, 2", MEMBERS)
def a10_resample(spark, sf):
    return A.resample(roles.members(spark, sf), ["member"], "step", 4, {"mean": r(F.avg("value")), "peak": F.max("value")})


@query(f"SELECT jet_id, jet, {R('sum(lat * s) / sum(s)')} AS lat, max(u) AS u, {R('avg(s)')} AS s, count(*) AS njets FROM (SELECT *, CASE WHEN is_polar > 0.5 THEN 'EDJ' ELSE 'STJ' END AS jet FROM paths) GROUP BY 1, 2", PATHS)
def a12_category_average(spark, sf):
    p = roles.paths(spark, sf).withColumn("jet", E.categorise(F.col("is_polar")))
    out = A.category_average(p, ["jet_id"], "jet", ["lat"], ["u"], "s")
    return out.withColumns({"lat": r("lat"), "s": r("s")})


@query("SELECT step, ilon, lev, s, u FROM (SELECT *, ilat AS lev, row_number() OVER (PARTITION BY step, ilon ORDER BY s DESC, ilat) AS k FROM field) WHERE k = 1", FIELD)
def a13_flatten_levels(spark, sf):
    f = roles.field(spark, sf).withColumnRenamed("ilat", "lev").select("step", "ilon", "lev", "s", "u")
    return A.flatten_levels(f, ["step", "ilon"], "s")


@query(f"SELECT label, ilon, ilat, {R('avg(s)')} AS s, {R('any_value(k) / any_value(n)')} AS ratio FROM field JOIN (SELECT step, step % 3 AS label FROM (SELECT DISTINCT step FROM field)) USING (step) JOIN (SELECT step % 3 AS label, count(*)::DOUBLE AS k FROM (SELECT DISTINCT step FROM field) GROUP BY 1) USING (label), (SELECT count(DISTINCT step) AS n FROM field) GROUP BY 1, 2, 3", FIELD)
def a14_cluster_centers(spark, sf):
    f = roles.field(spark, sf)
    marks = f.select("step").distinct().withColumn("label", F.col("step") % 3)
    return A.cluster_centers(f, marks, ["step"], ["ilon", "ilat"], "s").select("label", "ilon", "ilat", r("s").alias("s"), r("ratio").alias("ratio"))


@query(f"SELECT step, {R('sum(CASE WHEN k >= 2 THEN 1.0 ELSE 0.0 END) / any_value(n)')} AS double_index FROM (SELECT step, ilon, count(DISTINCT ilat) AS k FROM field GROUP BY 1, 2), (SELECT count(DISTINCT ilon) AS n FROM field) GROUP BY step", FIELD)
def a17_double_index(spark, sf):
    return A.double_feature_index(roles.field(spark, sf), ["step"], "ilon", "ilat").withColumn("double_index", r("double_index"))


@query(f"SELECT step, {R('sum(a) / 1e12', 4)} AS area, {R('degrees(atan2(sum(sin(radians(lon)) * a), sum(cos(radians(lon)) * a)))', 4)} AS com_x, {R('sum(lat * a) / sum(a)', 4)} AS com_y, {R('sum(s * a) / sum(a)', 4)} AS s FROM (SELECT *, cos(radians(lat)) * radians(10.0) * radians(10.0) * 6371000.0 * 6371000.0 AS a FROM field WHERE s > 26) GROUP BY step", FIELD)
def a18_event_props(spark, sf):
    out = A.event_props(roles.field(spark, sf).where("s > 26"), ["step"], 10.0, 10.0, ["s"])
    return out.select("step", r(F.col("area") / 1e12, 4).alias("area"), *[r(c, 4).alias(c) for c in ("com_x", "com_y", "s")])


@query(f"SELECT jet_id, {R('avg(CASE WHEN lat > 20 THEN s END)')} AS north, {R('avg(CASE WHEN lat < -20 THEN s END)')} AS south FROM paths GROUP BY jet_id", PATHS)
def a19_conditional_means(spark, sf):
    out = A.conditional_means(roles.paths(spark, sf), ["jet_id"], "s", {"north": F.col("lat") > 20, "south": F.col("lat") < -20})
    return out.select("jet_id", r("north").alias("north"), r("south").alias("south"))


@query(f"SELECT jet_id, {R('norm_index')} AS norm_index, {R('avg(s)')} AS s_interp FROM (SELECT jet_id, s, least(floor(index / greatest(max(index) OVER (PARTITION BY jet_id), 1) * 10), 9) / 10 AS norm_index FROM paths) GROUP BY jet_id, norm_index", PATHS)
def a22_normalise_position(spark, sf):
    out = A.normalise_position(roles.paths(spark, sf), ["jet_id"], "index", ["s"], 10)
    return out.select("jet_id", r("norm_index").alias("norm_index"), r("s_interp").alias("s_interp"))


ODDS = "SELECT lang, {0} AS odds_ratio, significant FROM (SELECT *, a * d / nullif(b * c, 0) AS o, abs(ln(a * d / nullif(b * c, 0))) > 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS significant FROM (SELECT lang, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1.0 ELSE 0 END) AS a, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0 END) AS b, sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1.0 ELSE 0 END) AS c, sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1.0 ELSE 0 END) AS d FROM labels JOIN documents USING (doc_id) GROUP BY lang))"


@query(ODDS.format(R("o")).replace("1 / a + 1 / b + 1 / c + 1 / d", "1 / nullif(a, 0) + 1 / nullif(b, 0) + 1 / nullif(c, 0) + 1 / nullif(d, 0)"))
def a23_odds_ratio(spark, sf):
    x = roles.table(spark, sf, "labels").join(roles.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return T.odds_table(x, F.col("quality") == 1, F.col("toxic") == 1, ["lang"]).withColumn("odds_ratio", r("odds_ratio"))


SEASONAL = """d0 AS (SELECT jet, doy, avg(qty) AS mean, median(qty) AS median, quantile_cont(qty, 0.25) AS q25, quantile_cont(qty, 0.75) AS q75 FROM daily GROUP BY 1, 2),
    d1 AS (SELECT jet, doy FROM (SELECT DISTINCT jet FROM daily), (SELECT unnest(range(1, 367)) AS doy)),
    d2 AS (SELECT jet AS j, doy + o AS d, mean, median, q25, q75 FROM d0, (VALUES (0), (366), (-366)) v(o))"""


@query(f"SELECT jet, doy, {R('avg(mean)', 4)} AS mean, {R('avg(median)', 4)} AS median, {R('avg(q25)', 4)} AS q25, {R('avg(q75)', 4)} AS q75 FROM d1 LEFT JOIN d2 ON jet = j AND d BETWEEN doy - 7 AND doy + 7 GROUP BY jet, doy", DAILY, SEASONAL)
def a25_seasonal_cycle(spark, sf):
    out = A.seasonal_cycle(roles.daily(spark, sf), ["jet"], "doy", "qty")
    return out.select("jet", F.col("doy").cast("bigint").alias("doy"), *[r(c, 4).alias(c) for c in ("mean", "median", "q25", "q75")])


@query(f"SELECT jet, bin, count(*) AS n, {R('avg(price)', 4)} AS price FROM (SELECT jet, price, (qty > q[1])::INT::BIGINT + (qty > q[2])::INT + (qty > q[3])::INT AS bin FROM daily JOIN (SELECT jet, quantile_cont(qty, [0.25, 0.5, 0.75]) AS q FROM daily GROUP BY jet) USING (jet)) GROUP BY jet, bin", DAILY)
def a27_quantile_bins(spark, sf):
    return A.quantile_bins(roles.daily(spark, sf), "qty", 4, ["price"], ["jet"]).withColumn("price", r("price", 4))


@query(f"SELECT lat_bin, lon_bin, count(*) AS n, {R('avg(s)')} AS s FROM (SELECT s, (lat >= -30)::INT::BIGINT + (lat >= 0)::INT + (lat >= 30)::INT AS lat_bin, (lon >= -90)::INT::BIGINT + (lon >= 90)::INT AS lon_bin FROM paths) GROUP BY 1, 2", PATHS)
def a29_binned_2d(spark, sf):
    return A.value_bins(roles.paths(spark, sf), {"lat": [-30, 0, 30], "lon": [-90, 90]}, ["s"]).withColumn("s", r("s"))


HIST = "hist AS (SELECT greatest(least(floor(value / 500.0 * 50), 49), 0)::BIGINT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)"


@query("SELECT bin, n FROM hist", HIST)
def a30_histogram(spark, sf):
    return A.histogram(roles.table(spark, sf, "events"), "value", 0.0, 500.0, 50)


@query(f"SELECT g AS grid, {R('sum(n * exp(-pow((g - (bin + 0.5) * 10.0) / 15.0, 2) / 2) / (15.0 * 2.5066282746310002::DOUBLE)) / sum(n)')} AS density FROM hist, (VALUES (5.0::DOUBLE), (25.0), (100.0), (300.0)) t(g) GROUP BY g", HIST)
def a30_kernel_density(spark, sf):
    return A.kernel_density(roles.table(spark, sf, "events"), "value", [5, 25, 100, 300], 15.0, 50, 0.0, 500.0).withColumn("density", r("density"))


@query("SELECT member, label, coalesce(n, 0) AS n FROM (SELECT member, label FROM (SELECT DISTINCT member FROM labels0), (SELECT unnest(range(0, 5)) AS label)) LEFT JOIN (SELECT member, label, count(*) AS n FROM labels0 GROUP BY 1, 2) USING (member, label)", LABELS)
def a32_label_distribution(spark, sf):
    return A.label_distribution(roles.labels(spark, sf), ["member"], "label", list(range(5)))


@query(f"SELECT label, {R('sum(CASE WHEN value > 20 THEN 1.0 ELSE 0 END) / any_value(s) - count(*) / any_value(n)')} AS excess FROM labels0, (SELECT count(*) AS n, sum(CASE WHEN value > 20 THEN 1.0 ELSE 0 END) AS s FROM labels0) GROUP BY label", LABELS)
def a33_relative_population(spark, sf):
    return A.relative_population(roles.labels(spark, sf), F.col("value") > 20, "label").withColumn("excess", r("excess"))


@query(f"SELECT label, next, n, {R('n / sum(n) OVER (PARTITION BY label)')} AS share FROM (SELECT label, next, count(*) AS n FROM (SELECT label, lead(label, 2) OVER (PARTITION BY member ORDER BY ord) AS next FROM labels0) WHERE next IS NOT NULL GROUP BY 1, 2)", LABELS)
def a35_transition_matrix(spark, sf):
    return A.transition_matrix(roles.labels(spark, sf), ["member"], "ord", "label", 2).withColumn("share", r("share"))


@query(f"SELECT step, arg_max(lat, z) AS jet_lat, {R('max(z)')} AS jet_speed, {R('max(z) - avg(z)')} AS sharpness FROM (SELECT step, lat, round(avg(s), 9) AS z FROM field GROUP BY 1, 2) GROUP BY step", FIELD)
def a43_latitude_index(spark, sf):
    out = A.latitude_index(roles.field(spark, sf), ["step"], "s")
    return out.select("step", "jet_lat", r("jet_speed").alias("jet_speed"), r("sharpness").alias("sharpness"))


@query(f"SELECT jet_id, {R('sum(lon * s * s) / sum(s * s)')} AS centroid, min(CASE WHEN s >= m THEN lon END) AS west, max(CASE WHEN s >= m THEN lon END) AS east FROM (SELECT *, avg(s) OVER (PARTITION BY jet_id) AS m FROM paths) GROUP BY jet_id", PATHS)
def a45_centroid_lon(spark, sf):
    return A.centroid_lon(roles.paths(spark, sf), ["jet_id"], "s").withColumn("centroid", r("centroid"))


@query(f"SELECT step, box, {R('avg(s)')} AS s FROM (SELECT step, s, unnest(list_filter([CASE WHEN lon BETWEEN -90 AND 0 AND lat BETWEEN 20 AND 70 THEN 'atlantic' END, CASE WHEN lon BETWEEN -20 AND 40 AND lat BETWEEN 30 AND 70 THEN 'europe' END], lambda x: x IS NOT NULL)) AS box FROM field) GROUP BY 1, 2", FIELD)
def a49_box_mean(spark, sf):
    return A.box_mean(roles.field(spark, sf), {"atlantic": (-90, 0, 20, 70), "europe": (-20, 40, 30, 70)}, ["step"], "s").withColumn("s", r("s"))


@query(f"SELECT 'price' AS a, 'qty' AS b, {R('corr(price, qty)')} AS r FROM daily UNION ALL SELECT 'price', 'disc', {R('corr(price, disc)')} FROM daily UNION ALL SELECT 'qty', 'disc', {R('corr(qty, disc)')} FROM daily", DAILY)
def a50_correlation_matrix(spark, sf):
    return A.correlation_matrix(roles.daily(spark, sf), ["price", "qty", "disc"]).withColumn("r", r("r"))


@query("SELECT year, jet, min(day) AS first_day, max(day) AS last_day FROM daily JOIN (SELECT year, jet, m FROM (SELECT year, jet, m, row_number() OVER (PARTITION BY year, jet ORDER BY count(*) DESC, m) AS k FROM (SELECT *, floor(qty / 40)::BIGINT AS m FROM daily WHERE month = 7) GROUP BY year, jet, m) WHERE k = 1) USING (year, jet) WHERE floor(qty / 40)::BIGINT = m GROUP BY 1, 2", DAILY)
def a41_dynamical_season(spark, sf):
    d = roles.daily(spark, sf).withColumn("label", F.floor(F.col("qty") / 40))
    return A.dynamical_season(d, ["year", "jet"], "day", "label", "month")


# grids ------------------------------------------------------------------------------------------------------------------


@query(f"SELECT step, ilat, ilon, {R('(SELECT avg(b.s) FROM field b WHERE b.step = a.step AND b.ilat = a.ilat AND least(abs(a.ilon - b.ilon), 36 - abs(a.ilon - b.ilon)) <= 2)')} AS s FROM field a", FIELD)
def w09_window_smooth(spark, sf):
    return G.window_mean(roles.field(spark, sf), "s", ["step", "ilat"], "ilon", 2, 36).select("step", "ilat", "ilon", r("s").alias("s"))


DDX = "coalesce((lead({0}) OVER x - lag({0}) OVER x) / 2, lead({0}) OVER x - {0}, {0} - lag({0}) OVER x)"
WINDOWS = "WINDOW x AS (PARTITION BY step, ilat ORDER BY ilon), y AS (PARTITION BY step, ilon ORDER BY ilat)"


def ddy(c: str) -> str:
    return DDX.format(c).replace("OVER x", "OVER y")


@query(f"SELECT step, ilon, ilat, {R(f'1e6 * ({DDX.format("v")} / ({DDX.format("lon")} * pi() / 180 * 6371000.0 * cos(radians(lat))) - {ddy("uc")} / ({ddy("lat")} * pi() / 180 * 6371000.0) / cos(radians(lat)))', 4)} AS vorticity FROM (SELECT *, u * cos(radians(lat)) AS uc FROM field) {WINDOWS}", FIELD)
def d03_relative_vorticity(spark, sf):
    out = G.relative_vorticity(roles.field(spark, sf), ["step"])
    return out.select("step", "ilon", "ilat", r(F.col("vorticity") * 1e6, 4).alias("vorticity"))


@query(f"SELECT step, ilon, ilat, {R(f'1e6 * ({DDX.format("u")} / ({DDX.format("lon")} * pi() / 180 * 6371000.0 * cos(radians(lat))) + {ddy("vc")} / ({ddy("lat")} * pi() / 180 * 6371000.0) / cos(radians(lat)))', 4)} AS divergence FROM (SELECT *, v * cos(radians(lat)) AS vc FROM field) {WINDOWS}", FIELD)
def d04_divergence(spark, sf):
    out = G.divergence(roles.field(spark, sf), "u", "v", ["step"])
    return out.select("step", "ilon", "ilat", r(F.col("divergence") * 1e6, 4).alias("divergence"))


# statistics -------------------------------------------------------------------------------------------------------------


@query(f"SELECT jet, {R('(sum(CASE WHEN b.value < a.value THEN 1.0 ELSE 0 END) + sum(CASE WHEN b.value = a.value THEN 0.5 ELSE 0 END)) / count(*)')} AS p FROM (SELECT jet, value FROM series JOIN (SELECT jet, max(step) AS step FROM series GROUP BY jet) USING (jet, step)) a JOIN (SELECT jet, value FROM series WHERE (jet, step) NOT IN (SELECT jet, max(step) FROM series GROUP BY jet)) b USING (jet) GROUP BY jet", SERIES)
def r02_rank_pvalue(spark, sf):
    s = roles.series(spark, sf)
    last = F.max("step").over(Window.partitionBy("jet"))
    s = s.withColumn("sample", F.when(F.col("step") == last, -1).otherwise(F.col("step")))
    return T.rank_pvalue(s, "value", "sample", -1, ["jet"]).select("jet", r("p").alias("p"))


@query(f"SELECT jet, {R('slope')} AS slope, {R('sign(slope) * sqrt(r2 * (n - 2) / (1 - r2))', 4)} AS t, n FROM (SELECT jet, regr_slope(qty, day) AS slope, regr_r2(qty, day) AS r2, count(*) AS n FROM daily GROUP BY jet)", DAILY)
def r23_linear_trend(spark, sf):
    return T.linear_trend(roles.daily(spark, sf), "qty", "day", ["jet"]).select("jet", r("slope").alias("slope"), r("t", 4).alias("t"), "n")


@query(f"SELECT {R('max(abs(a - b))')} AS d FROM (SELECT sum(a) OVER w / sum(a) OVER () AS a, sum(b) OVER w / sum(b) OVER () AS b FROM (SELECT value, sum(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) AS a, sum(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS b FROM events WHERE event_type IN ('click', 'error') GROUP BY value) WINDOW w AS (ORDER BY value))")
def r11_ks_two_sample(spark, sf):
    return T.ks_two_sample(roles.table(spark, sf, "events"), "value", "event_type", "click", "error").select(r("d").alias("d"))


@query(f"SELECT jet, {R('avg(qty)')} AS mean, {R('avg(qty) - 1.959963984540054 * stddev_samp(qty) / sqrt(count(qty))')} AS low, {R('avg(qty) + 1.959963984540054 * stddev_samp(qty) / sqrt(count(qty))')} AS high FROM daily GROUP BY jet", DAILY)
def r12_mean_ci(spark, sf):
    out = T.mean_ci(roles.daily(spark, sf), ["jet"], "qty")
    return out.select("jet", *[r(c).alias(c) for c in ("mean", "low", "high")])


@query(f"SELECT member, k AS lag, {R('corr(value, x)')} AS rho FROM (SELECT member, value, unnest([0, 1, 2, 3]) AS k, unnest([value, lag(value, 1) OVER w, lag(value, 2) OVER w, lag(value, 3) OVER w]) AS x FROM members WINDOW w AS (PARTITION BY member ORDER BY step)) GROUP BY 1, 2", MEMBERS)
def r14_autocorrelation(spark, sf):
    return T.autocorrelation(roles.members(spark, sf), "value", ["member"], "step", 3).select("member", "lag", r("rho").alias("rho"))


@query(f"SELECT a.jet AS a, b.jet AS b, k AS lag, {R('covar_samp(a.value, b.value)', 4)} AS cov FROM series a, series b, (VALUES (0), (1), (2)) t(k) WHERE b.step = a.step + k GROUP BY 1, 2, 3", SERIES)
def r15_lagged_covariance(spark, sf):
    return T.lagged_covariance(roles.series(spark, sf), "jet", "step", "value", 2).withColumn("cov", r("cov", 4))


@query(f"SELECT jet, value, {R('sum(c) OVER (PARTITION BY jet ORDER BY value) / sum(c) OVER (PARTITION BY jet)')} AS cdf FROM (SELECT jet, value, count(*) AS c FROM series GROUP BY 1, 2)", SERIES)
def r17_ecdf(spark, sf):
    return T.ecdf(roles.series(spark, sf), "value", ["jet"]).withColumn("cdf", r("cdf"))


@query("SELECT jet, value, (SELECT count(*) FROM series b WHERE b.jet = a.jet AND b.step % 2 = 0 AND b.value < a.value) AS rank FROM (SELECT DISTINCT jet, value FROM series WHERE step % 2 = 1) a", SERIES)
def r18_search_sorted(spark, sf):
    s = roles.series(spark, sf)
    return T.search_sorted(s.where("step % 2 = 0"), s.where("step % 2 = 1"), ["jet"], "value")


@query(f"SELECT step, {R('any_value(a) - any_value(s)')} AS crps FROM (SELECT step, (SELECT avg(abs(e.value - o.value)) FROM members e WHERE e.step = o.step) AS a, (SELECT sum(abs(e.value - f.value)) / 2 / (count(DISTINCT e.member) * count(DISTINCT e.member)) FROM members e, members f WHERE e.step = o.step AND f.step = o.step) AS s FROM (SELECT step, max(value) AS value FROM series GROUP BY step) o WHERE step IN (SELECT step FROM members)) GROUP BY step", SERIES, MEMBERS)
def r20_crps(spark, sf):
    obs = roles.series(spark, sf).groupBy("step").agg(F.max("value").alias("value"))
    return T.crps(obs, roles.members(spark, sf), ["step"], "value").withColumn("crps", r("crps"))


@query(f"SELECT month, {R('r - m * (m + 1) / 2', 2)} AS u FROM (SELECT month, sum(rk * a) AS r, sum(a) AS m FROM (SELECT month, a, avg(i) OVER (PARTITION BY month, qty) AS rk FROM (SELECT month, qty, CASE WHEN jet = 'A' THEN 1.0 ELSE 0 END AS a, row_number() OVER (PARTITION BY month ORDER BY qty) AS i FROM daily WHERE jet IN ('A', 'R'))) GROUP BY month)", DAILY)
def r22_mann_whitney(spark, sf):
    d = roles.daily(spark, sf).where("jet in ('A', 'R')")
    return T.mann_whitney(d, "qty", "jet", "A", ["month"]).select("month", r("u", 2).alias("u"))


# learning ---------------------------------------------------------------------------------------------------------------

AUC = """sc AS (SELECT lang, toxic AS y, n_chars::DOUBLE / (n_chars + 2000.0) AS p FROM labels JOIN documents USING (doc_id)),
    rk AS (SELECT lang, y, p, avg(i) OVER (PARTITION BY lang, p) AS k FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p) AS i FROM sc))"""


@query(f"SELECT lang, {R('(sum(k * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0)')} AS auc, {R('1 - avg(pow(p - y, 2))')} AS brier FROM rk GROUP BY lang", AUC)
def l13_scores(spark, sf):
    x = roles.table(spark, sf, "labels").join(roles.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    x = x.withColumn("prob", F.col("n_chars").cast("double") / (F.col("n_chars") + 2000.0))
    return L.scores(x, F.col("toxic") == 1, "prob", ["lang"]).select("lang", r("auc").alias("auc"), r("brier").alias("brier"))


@query(f"SELECT a.jet AS a, b.jet AS b, {R('1 - count(*) / (any_value(na.n) + any_value(nb.n) - count(*))')} AS distance FROM hot a JOIN hot b ON a.step = b.step AND a.jet < b.jet JOIN hn na ON na.jet = a.jet JOIN hn nb ON nb.jet = b.jet GROUP BY 1, 2", SERIES, "hot AS (SELECT jet, step FROM series WHERE value > 12)", "hn AS (SELECT jet, count(*) AS n FROM hot GROUP BY jet)")
def l07_cell_jaccard(spark, sf):
    return L.cell_jaccard(roles.series(spark, sf), F.col("value") > 12, "jet", "step").withColumn("distance", r("distance"))


@query(f"SELECT jet, year, {R('1e-3 * 287.0500676 * avg(qty)', 4)} AS x, {R('avg(disc) * pow(1000.0 / 250.0, 0.2854)')} AS theta FROM daily GROUP BY jet, year", DAILY)
def x10_thermodynamics(spark, sf):
    d = roles.daily(spark, sf).groupBy("jet", "year").agg(F.avg("qty").alias("q"), F.avg("disc").alias("t"))
    return d.select("jet", "year", r(F.col("q") * S.R_DRY * 1e-3, 4).alias("x"), r(S.potential_temperature(F.col("t"), F.lit(250.0))).alias("theta"))


# without SQL: iterations, folds over paths, and fitted models ------------------------------------------------------------


@query()
def t03_components(spark, sf):
    """Orders that share a part, supplier, quantity and discount, by chains of such ties."""
    x = roles.table(spark, sf, "lineitem").select("l_orderkey", F.xxhash64("l_partkey", "l_suppkey", "l_quantity", "l_discount").alias("k"))
    first = x.groupBy("k").agg(F.min("l_orderkey").alias("b"))
    edges = x.join(first, "k").where("l_orderkey <> b").select(F.col("l_orderkey").alias("a"), "b")
    return graph.connected_components(edges)


@query()
def g01_contours(spark, sf):
    return C.contours(roles.field(spark, sf), "s", [26.0], ["step"], 36, 6)


@query()
def g03_overturnings(spark, sf):
    lines = C.contours(roles.field(spark, sf), "s", [26.0], ["step"], 36, 6)
    return C.overturnings(lines, ["step", "level", "contour"], 20.0, 0.0, 5.0, 3)


@query()
def t01_find_jets(spark, sf):
    return JT.find_jets(roles.field(spark, sf), ["step"], (-180.0, -85.0), (10.0, 10.0), 20.0, 0.3, 1e6, 1e6, 4, 25.0, 36)


@query()
def m01_jet_properties(spark, sf):
    return JT.jet_properties(roles.paths(spark, sf), ["jet_id"])


@query()
def r01_bootstrap(spark, sf):
    """All spells of all categories against random blocks of their lengths, by category."""
    spells = _spells(spark, sf).select(F.concat_ws("-", "jet", "spell").alias("spell"), "step")
    times = roles.series(spark, sf).select("step").distinct()
    drawn = T.bootstrap_times(spells, times, "step", 100).join(roles.series(spark, sf), "step")
    return T.rank_pvalue(drawn.groupBy("jet", "sample_index").agg(F.avg("value").alias("value")), "value", "sample_index", 100, ["jet"])


@query()
def r03_block_trends(spark, sf):
    yearly = roles.daily(spark, sf).groupBy("jet", "year").agg(F.avg("qty").alias("qty"))
    return T.block_trend_pvalues(yearly, "qty", "year", ["jet"], 2, 200)


@query()
def r16_hurst(spark, sf):
    return T.hurst(roles.daily(spark, sf), "qty", ["jet"], "day", [1, 2, 3, 4, 5])


@query()
def w22_band_pass(spark, sf):
    return G.band_pass(roles.members(spark, sf), "value", ["member"], "step", 0.0, 0.1).select("member", "step", r("filtered").alias("filtered"))


@query()
def l02_pca(spark, sf):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = roles.table(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return L.pca(x, 4)[0].select("vec_id", vector_to_array("scores").alias("scores"))


@query()
def l03_kmeans(spark, sf):
    from pyspark.ml.functions import array_to_vector

    x = roles.table(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return L.kmeans(x, 10).groupBy("label").count()


@query()
def l20_map_quality(spark, sf):
    x = roles.table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return L.map_quality(x, "v", L.som(x, "v", 4, 3, 3))


@query()
def l12_predict(spark, sf):
    x = roles.table(spark, sf, "labels").join(roles.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    x = x.withColumns({"size": F.log("n_chars"), **{f"is_{k}": (F.col("lang") == k).cast("double") for k in ("en", "fr", "de")}})
    out = L.predict(x, ["size", "is_en", "is_fr", "is_de"], "toxic", L.fold_of(F.col("doc_id"), 3), 3)
    return L.scores(out, F.col("toxic") == 1, "prob", ["fold"])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t10_persistent_spells(spark, sf_dir)


from . import jobs, more_queries, shape_queries  # noqa: E402, F401  they register their queries
