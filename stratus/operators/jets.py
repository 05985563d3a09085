"""Finding jet cores in wind fields, and their properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratus.functions.measures import circular_mean, weighted_mean
from stratus.functions.sphere import RADIUS, degcos, haversine

from .aggregate import path_integral
from .contours import contours
from .grid import norm_derivative
from .points import bilinear
from .sequence import central_diff, mark_runs, split_on_gap

#: Least numbers of points: of a contour, of a run, of a jet.
MIN_CONTOUR, MIN_RUN, MIN_JET = 10, 5, 6


def alignment(points: DataFrame, keys: list[str], order: str, name: str = "alignment") -> DataFrame:
    """Cosine between a line and the wind."""
    dx, dy = central_diff("lon", keys, order) * degcos(F.col("lat")), central_diff("lat", keys, order)
    cos = F.try_divide(F.col("u") * F.col("__x") + F.col("v") * F.col("__y"), F.hypot("u", "v") * F.hypot("__x", "__y"))
    return points.withColumns({"__x": dx, "__y": dy}).withColumn(name, cos).drop("__x", "__y")


def find_jets(grid: DataFrame, keys: list[str], first: tuple[float, float], step: tuple[float, float], s_thresh: float = 20.0, alignment_thresh: float = 0.3, int_thresh: float = 0.0, end_dist: float = 1e6, hole_size: int = 4, max_gap: float = 3.0, nlon: int | None = None, smoother=None, members: list[str] = (), thresholds: DataFrame | None = None) -> DataFrame:
    """Jet cores: pieces of the zero line of the wind speed's derivative across the wind, where the wind is strong and
    along the line. Columns: keys, jet_id, index, lon, lat, u, v, s, alignment, int.

    Holes of less than ``hole_size`` points inside a run stay in it, those at its ends do not. ``s_thresh`` is in m/s;
    steps of more than ``max_gap`` degrees part a line. ``smoother`` (DataFrame -> DataFrame) is applied to the field whose
    derivative is taken; speeds are those of the field itself.

    An ``s_thresh`` of at most 1 is a quantile: each time (the keys without ``members``) has that of its own speeds as its
    threshold. ``thresholds`` gives one for each time instead (those keys, ``s_thresh``). ``int_thresh`` then goes with a
    time's threshold over the mean one.
    """
    by = [k for k in keys if k not in members]
    if thresholds is None and s_thresh <= 1.0:
        thresholds = grid.groupBy(*by).agg(F.percentile("s", s_thresh).alias("s_thresh"))
    sigma = norm_derivative(grid.transform(smoother) if smoother else grid, "s", keys)
    lines = contours(sigma.where(F.col("sigma").isNotNull()), "sigma", [0.0], keys, nlon, MIN_CONTOUR)
    lines = bilinear(lines, grid, keys, ["u", "v", "s"], first, step, nlon, "")
    own = [*keys, "contour"]
    lines = alignment(lines, own, "index").withColumn("alignment", F.abs("alignment"))
    strong = F.lit(float(s_thresh))
    if thresholds is not None:
        usual = thresholds.agg(F.avg("s_thresh")).first()[0] or 1.0
        limits = thresholds.select(*by, F.col("s_thresh").alias("__strong"))
        lines = lines.join(limits, by) if by else lines.crossJoin(F.broadcast(limits))
        strong = F.col("__strong")
    good = (F.col("s") > strong) & (F.col("alignment") > alignment_thresh)
    runs = mark_runs(lines, good, own, "index", hole_size - 1, fill_trailing=False, dt=10**9)
    size = F.count("*").over(Window.partitionBy(*own, "run"))
    runs = runs.where("inside").withColumn("__n", size).where(F.col("__n") > MIN_RUN)
    w = Window.partitionBy(*own, "run").orderBy("index")
    gap = F.hypot(F.col("lon") - F.lag("lon").over(w), F.col("lat") - F.lag("lat").over(w))
    parts = split_on_gap(runs.withColumn("__g", gap), [*own, "run"], "index", F.col("__g"), max_gap)
    one = [*own, "run", "part"]
    total = path_integral(parts, one, "index", F.col("s"))
    ends = parts.groupBy(*one).agg(*[f(c, "index").alias(f"__{c}{k}") for c in ("lon", "lat") for f, k in ((F.min_by, 0), (F.max_by, 1))], F.count("*").alias("__c"), F.first(strong / usual if thresholds is not None else F.lit(1.0)).alias("__scale"))
    far = haversine(F.col("__lon0"), F.col("__lat0"), F.col("__lon1"), F.col("__lat1"))
    kept = ends.join(total, one).where((F.col("__c") > MIN_JET) & (F.col("int") > F.col("__scale") * int_thresh) & (far > end_dist)).select(*one, "int")
    ids = kept.withColumn("jet_id", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("int"), "contour", "run", "part")).cast("bigint") - 1)
    rows = parts.join(ids, one).withColumn("index", F.row_number().over(Window.partitionBy(*keys, "jet_id").orderBy("index")).cast("bigint") - 1)
    return rows.select(*keys, "jet_id", "index", "lon", "lat", "u", "v", "s", "alignment", "int")


def jet_properties(jets: DataFrame, keys: list[str], order: str = "index") -> DataFrame:
    """Some twenty properties of each path, from windows on one partitioning and one aggregate."""
    w, whole, by_lon = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("lon", order)
    step = F.pmod(F.col("lon") - F.lag("lon").over(w) + 180.0, F.lit(360.0)) - 180.0
    rows = jets.withColumn("__x", F.sum(F.coalesce(step, F.lit(0.0))).over(w)).withColumns({
        "__d": haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")),
        "__t": (F.col("s") + F.lag("s").over(w)) / 2,
        "__dlat": F.abs(F.col("lat") - F.lag("lat").over(by_lon)),
        "__vbar": F.avg("v").over(whole),
    })
    s, lat = F.col("s"), F.col("lat")
    lon_ext = F.max("__x") - F.min("__x")
    optional = [weighted_mean(F.col(c), s).alias(f"mean_{c}") for c in ("lev", "theta") if c in jets.columns] + ([F.avg("is_polar").alias("is_polar")] if "is_polar" in jets.columns else [])
    return rows.groupBy(*keys).agg(
        circular_mean(F.col("lon"), s).alias("mean_lon"), weighted_mean(lat, s).alias("mean_lat"), F.avg("s").alias("mean_s"),
        F.max_by("lon", F.struct("s", F.col(order))).alias("lon_star"), F.max_by("lat", F.struct("s", F.col(order))).alias("lat_star"), F.max("s").alias("s_star"),
        lon_ext.alias("lon_ext"), (F.max("lat") - F.min("lat")).alias("lat_ext"), F.regr_slope("lat", "__x").alias("tilt"), (1 - F.regr_r2("lat", "__x")).alias("waviness1"),
        (F.var_pop("lat") * F.count("lat")).alias("waviness2"), (F.sum("__dlat") / F.when(lon_ext > 0, lon_ext)).alias("wavinessR16"),
        (F.sum("__d") / RADIUS / degcos(F.avg("lat")) / F.when(lon_ext > 0, F.radians(lon_ext))).alias("wavinessDC16"),
        (F.sum((F.col("v") - F.col("__vbar")) * F.abs("v") / s) / F.sum(s)).alias("wavinessFV15"),
        F.sum(F.col("__d") * F.col("__t")).alias("int"), *optional,
    )


def integral_over(jets: DataFrame, keys: list[str], order: str, cond: Column, name: str) -> DataFrame:
    """Path integral of the speed over the points that meet a condition (by chords between them), 0 where none does."""
    part = path_integral(jets.where(cond), keys, order, F.col("s"), name)
    return jets.select(*keys).distinct().join(part, keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def low_integral(jets: DataFrame, low: DataFrame, keys: list[str], order: str, on: list[str], first, step, nlon=None) -> DataFrame:
    """Path integrals of the speed and of that of a lower level at the same points, and their ratio."""
    rows = bilinear(jets, low.select(*on, "ilon", "ilat", F.col("s").alias("low")), on, ["low"], first, step, nlon, "_s")
    both = path_integral(rows, keys, order, F.col("s")).join(path_integral(rows, keys, order, F.col("low_s"), "int_low"), keys)
    return both.withColumn("int_ratio", F.try_divide("int_low", "int"))


def jet_widths(sections: DataFrame, keys: list[str], order: str, share: float = 0.75, floor: float = 10.0) -> DataFrame:
    """Speed-weighted mean over points of both half widths: the nearest normal point with a low speed on each side."""
    core = F.max(F.when(F.col("n") == 0, F.col("s_interp"))).over(Window.partitionBy(*keys, order))
    low = sections.withColumn("__c", core).where(F.col("s_interp") <= F.greatest(share * F.col("__c"), F.lit(floor)))
    halves = low.groupBy(*keys, order, F.col("__c").alias("__s")).agg(F.min(F.when(F.col("n") > 0, F.col("n"))).alias("up"), F.min(F.when(F.col("n") < 0, -F.col("n"))).alias("down"))
    return halves.groupBy(*keys).agg((F.sum((F.col("up") + F.col("down")) * F.col("__s")) / F.sum("__s")).alias("width"))


def speed_of_centre(props: DataFrame, track: list[str], order: str, seconds: float) -> DataFrame:
    w = Window.partitionBy(*track).orderBy(order)
    moved = haversine(F.lag("mean_lon").over(w), F.lag("mean_lat").over(w), F.col("mean_lon"), F.col("mean_lat"))
    return props.withColumn("com_speed", moved / (seconds * (F.col(order) - F.lag(order).over(w))))


def gmix_categorise(jets: DataFrame, features: list[str], period: str, hot: str, n: int = 2, highest: bool = True, mode: str = "score", sweeps: int = 2, rounds: int = 20, tolerance: float = 1e-5) -> DataFrame:
    """``is_polar`` by Gaussian mixtures, one for each period, all fitted at once, each seeded by the period before it; the
    component with the highest (or lowest) mean of ``hot`` is subtropical. Rows with a null feature stay, with a null."""
    from .mixtures import categorise, fit

    by = features.index(hot)
    return categorise(jets, features, period, fit(jets, features, period, n, by, sweeps, rounds, tolerance), by, highest, mode)
