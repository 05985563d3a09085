"""Whole jobs: operators in the order in which a study runs them, with the costly stages stored on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratus.operators import aggregate as A, contours as C, grid as G, jets as JT, joins as J, learn as L, patterns as PT, select as E, sequence as Q, stats as T, studies as U, tracking as TR
from stratus.operators.graph import cut_lineage

from . import roles
from .queries import R, _full, _spells, query, r


def jet_pipeline(grid: DataFrame, keys: list[str], order: str, first, step, split: float = 40.0, max_dist: float = 4e6, min_overlap: float = 0.1, seconds: float = 21_600.0, **find) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jets, properties, category averages) of a wind field: cores, their properties, category by mean latitude, tracks of
    best successors with their spell and slowness, and means by category. ``find`` goes to the search for cores."""
    at = [*keys, order]
    jets = cut_lineage(JT.find_jets(grid, at, first, step, **find))
    props = JT.jet_properties(jets, [*at, "jet_id"]).withColumn("is_polar", (F.abs("mean_lat") > split).cast("double"))
    cross = cut_lineage(TR.track(jets, keys, order))
    spells = TR.connect(cross, keys, order, max_dist, min_overlap, seconds=seconds)
    slow = TR.feature_slowness(cross, [*at, "jet_id"], seconds)
    props = cut_lineage(props.join(spells, [*at, "jet_id"], "left").join(slow, [*at, "jet_id"], "left").withColumn("jet", E.categorise(F.col("is_polar"))))
    return jets, props, A.category_average(props, at, "jet", ["mean_lat", "mean_s", "tilt"], ["s_star", "lon_ext", "slowness"])


def wave_breaking_pipeline(grid: DataFrame, keys: list[str], col: str, levels: list[float], nlon: int, dlon: float, dlat: float, min_points: int, classes: dict[str, Column], **fold) -> DataFrame:
    """``grid`` with masks of its overturnings' classes: smoothed field, iso-lines, folds, the nodes in each fold's box with
    their area and centre, masks. ``fold`` goes to the search for overturnings."""
    lines = C.contours(G.gaussian_smooth(grid, col, keys, 0.5, 0.5), col, levels, keys, nlon, min_points)
    found = cut_lineage(C.overturnings(lines, [*keys, "level", "contour"], **fold).withColumn("fold", F.xxhash64(*keys, "level", "contour", "event")))
    ring = F.array(*[F.struct((F.col(x) + a).alias("lon"), (F.col(y) + b).alias("lat")) for x, y, a, b in (("west", "south", -0.5, -0.5), ("east", "south", 0.5, -0.5), ("east", "north", 0.5, 0.5), ("west", "north", -0.5, 0.5))])
    nodes = cut_lineage(J.spatial_join(found.select("fold", *keys, ring.alias("points")), grid.select(*keys, "ilon", "ilat", "lon", "lat", col), "fold", keys, wrap=False))
    events = found.join(A.event_props(nodes, ["fold"], dlon, dlat, [col]), "fold").select("fold", "orientation", "level", "area", "com_x", "com_y")
    return C.wave_break_masks(events, nodes.select("fold", *keys, "ilon", "ilat"), grid, ["fold"], [*keys, "ilon", "ilat"], classes)


def eddy_pipeline(grid: DataFrame, keys: list[str], order: str, half: int, cutoff: float) -> DataFrame:
    """Eddy energy, fluxes, momentum convergence and generation against a low-passed background."""
    cell = [*keys, "ilon", "ilat"]
    low = Q.fir_filter(Q.fir_filter(grid, "u", cell, order, G.lanczos(half, cutoff), "u_low"), "v", cell, order, G.lanczos(half, cutoff), "v_low")
    low = low.where("u_low is not null and v_low is not null")
    return G.eddy_generation(G.eddy_forcing(low, {"u": "u_low", "v": "v_low"}, [*keys, order]), [*keys, order])


def extreme_prediction(series: DataFrame, cell: str, order: str, value: str, cond: Column, near: float, periods: list[int], steps: list[int], folds: int) -> DataFrame:
    """Scores of predicted extremes by region: cells that are extreme together form regions, whose means give targets; lagged
    trailing means of the regions and a trend in time predict them out of fold."""
    regions = L.regions(L.cell_jaccard(series, cond, cell, order), near)
    mean = cut_lineage(J.regionalize(series, regions.withColumnRenamed("cell", cell), [cell], [order], value))
    hot = E.quantile_exceed(mean, value, 0.7, ["region"])
    targets = L.make_targets(hot, F.col("exceeds"), ["region"], order, 1, 1).withColumn("hit", (F.col("target") > 0).cast("int"))
    base = U.trend_baseline(targets.select("region", order, "hit"), ["region"], order, "hit").withColumnRenamed("prob", "base")
    names = [f"t{p}_l{k}" for p in periods for k in steps]
    late = L.prepare_predictors(mean, [value], ["region"], order, periods, steps)
    late = late.withColumn("name", F.format_string("t%d_l%d", "timescale", "lag"))
    wide = late.groupBy("region", order).agg(*[F.max(F.when(F.col("name") == n, F.col(value))).alias(n) for n in names])
    rows = cut_lineage(base.join(wide, ["region", order]))
    fold = L.fold_of(F.concat_ws("-", "region", F.floor(F.col(order) / 8)), folds)
    return L.scores(L.predict(rows, [*names, "base"], "hit", fold, folds), F.col("hit") == 1, "prob", ["region"])


def composite_study(tracks: DataFrame, props: DataFrame, keys: list[str], order: str, by: str, value: str, n: int, before: int, draws: int) -> DataFrame:
    """By spell of the ``n`` strongest tracks of each key: means before and during it, and its rank among random places."""
    spells = cut_lineage(TR.spells_from_tracks(tracks, keys, order, by, n).select(*keys, "spell", order, "relative_index"))
    p = A.during_pvalues(spells, props, keys, order, value, draws)
    wide = Q.extend_spells(spells.withColumn("len", F.lit(0)), keys, order, before, 0)
    lead = wide.where("relative_index < 0").join(props.select(*keys, order, value), [*keys, order]).groupBy(*keys, "spell").agg(F.avg(value).alias("before"))
    return p.join(lead, [*keys, "spell"], "left")


def forecast_study(forecasts: DataFrame, truth: DataFrame, keys: list[str], order: str, cond: Column, min_len: int) -> DataFrame:
    """By forecast (``keys``) the onset of the first run of a condition, and its distance from the onset in ``truth``."""
    seen = Q.season_onset(truth.withColumn("all", F.lit(0)), cond, ["all"], order, min_len).select(F.col("onset").alias("seen"))
    return Q.season_onset(forecasts, cond, keys, order, min_len).crossJoin(F.broadcast(seen)).withColumn("error", F.col("onset") - F.col("seen"))


def association_tests(series: DataFrame, value: str, keys: list[str], day: str, year: str, order: str, period: int, q: float, other: DataFrame, on: list[str], mark: Column) -> DataFrame:
    """Odds ratios between a mark of ``other`` and spells of smoothed, standardised anomalies, by key."""
    anomalies = A.smooth_anomaly(series, [value], keys, day, 31, year, True)
    slow = Q.timescales(anomalies, [value], keys, order, [period])
    hot = E.quantile_exceed(slow, value, q, keys)
    spells = Q.get_spells(hot, F.col("exceeds"), keys, order, 1, 2).select(*keys, order, F.lit(1).alias("__in"))
    rows = hot.join(spells, [*keys, order], "left").join(other, on)
    return T.odds_table(rows, F.col("__in").isNotNull(), mark, keys)


@query()
def e01_jet_pipeline(spark, sf):
    return jet_pipeline(roles.field(spark, sf), [], "step", (-180.0, -85.0), (10.0, 10.0), s_thresh=20.0, alignment_thresh=0.3, int_thresh=1e6, end_dist=1e6, max_gap=25.0, nlon=36)[2]


@query()
def e02_wave_breaking(spark, sf):
    classes = {"cyclonic": F.col("orientation") == "cyclonic", "anticyclonic": F.col("orientation") == "anticyclonic", "large": F.col("area") > 1e13}
    f = roles.field(spark, sf).select("step", "ilon", "ilat", "lon", "lat", "s")
    masks = wave_breaking_pipeline(f, ["step"], "s", [24.0, 26.0], 36, 10.0, 10.0, 6, classes, max_gap=20.0, min_lon=0.0, min_lat=5.0, min_len=3)
    return masks.select("step", "ilon", "ilat", *classes)


@query()
def e03_eddies(spark, sf):
    e = eddy_pipeline(roles.field(spark, sf), [], "step", 1, 0.2)
    return e.select("step", "ilon", "ilat", r("eke").alias("eke"), r("uv").alias("uv"), r(F.col("generation") * 1e6).alias("generation"))


@query()
def e04_extreme_prediction(spark, sf):
    s = roles.series(spark, sf).withColumn("cell", F.ascii("jet").cast("bigint"))
    return extreme_prediction(s.select("cell", "step", "value"), "cell", "step", "value", F.col("value") > 12, 0.95, [1, 4], [1, 2], 2)


@query()
def e05_composites(spark, sf):
    x = roles.labels(spark, sf).withColumnRenamed("label", "spell")
    return composite_study(x.select("member", "spell", "ord", "value"), x.select("member", "ord", "value"), ["member"], "ord", "value", "value", 1, 3, 50)


@query()
def e06_forecasts(spark, sf):
    """Members as forecasts of the mean over all categories."""
    truth = roles.series(spark, sf).groupBy("step").agg(F.avg("value").alias("value"))
    return forecast_study(roles.members(spark, sf), truth, ["member"], "step", F.col("value") > 12, 2)


@query()
def e07_association(spark, sf):
    d = roles.daily(spark, sf)
    flags = d.groupBy("day").agg((F.sum("qty") > 150).alias("busy"))
    return association_tests(d, "price", ["jet"], "doy", "year", "day", 5, 0.8, flags, ["day"], F.col("busy"))


def zonal_means(spark, sf, col: str) -> DataFrame:
    return roles.field(spark, sf).groupBy("step", "ilat").agg(F.avg(col).alias("v"))


@query()
def l18_covariance_patterns(spark, sf):
    """Leading coupled patterns of the zonal means of two fields, as rows."""
    left, right, cov = PT.coupled_patterns(zonal_means(spark, sf, "u"), zonal_means(spark, sf, "v"), "step", "ilat", "v", 2)
    strength = spark.createDataFrame(list(enumerate(cov)), "pattern int, cov double")
    both = left.withColumnRenamed("loading", "left").join(right.withColumnRenamed("loading", "right"), ["cell", "pattern"], "full")
    return both.join(F.broadcast(strength), "pattern").select("pattern", F.col("cell").alias("ilat"), "left", "right", "cov")


@query(f"""SELECT a.ilat AS a, b.ilat AS b, count(*) AS n, {R('CASE WHEN count(*) > 1 THEN covar_samp(a.v, b.v) END')} AS cov
    FROM (SELECT step, ilat, avg(u) AS v FROM field GROUP BY 1, 2) a JOIN (SELECT step, ilat, avg(v) AS v FROM field GROUP BY 1, 2) b USING (step) GROUP BY 1, 2""", roles.FIELD)
def l18_cell_covariances(spark, sf):
    return PT.cell_covariances(zonal_means(spark, sf, "u"), zonal_means(spark, sf, "v"), "step", "ilat", "v").select("a", "b", "n", r("cov").alias("cov"))


@query()
def l02_wide_patterns(spark, sf):
    """Principal patterns of the whole field, a cell a node: variance and largest loadings of each."""
    f = roles.field(spark, sf).select("step", (F.col("ilat") * 36 + F.col("ilon")).alias("cell"), "s")
    patterns, scores, variances = PT.principal_patterns(f, "step", "cell", "s", 3)
    of = spark.createDataFrame(list(enumerate(variances)), "pattern int, variance double")
    most = patterns.groupBy("pattern").agg(F.count("*").alias("cells"), F.sum(F.col("loading") * F.col("loading")).alias("length"))
    return most.join(scores.groupBy("pattern").agg(F.var_samp("score").alias("spread")), "pattern").join(F.broadcast(of), "pattern")
