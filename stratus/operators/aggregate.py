"""Aggregations over features, labels, categories and the calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratus.functions.measures import circular_mean, weighted_mean
from stratus.functions.sphere import RADIUS, degcos, haversine

from .sequence import periodic_rolling

#: Steps of a series that are met together.
STRETCH = 64


def path_integral(df: DataFrame, keys: list[str], order: str, value: Column | None = None, name: str = "int") -> DataFrame:
    """Trapezoid integral of ``value`` along the great-circle steps of each path; its length without a value."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    part = step if value is None else step * (value + F.lag(value).over(w)) / 2
    return df.withColumn("__p", part).groupBy(*keys).agg(F.coalesce(F.sum("__p"), F.lit(0.0)).alias(name))


def coarsen(df: DataFrame, bins: dict[str, int], keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Keys floored to bins, then aggregates."""
    return df.groupBy(*keys, *[F.floor(F.col(c) / n).alias(c) for c, n in bins.items()]).agg(*[a.alias(n) for n, a in aggs.items()])


def climatology(df: DataFrame, cols: list[str], keys: list[str], clim: str) -> DataFrame:
    return df.groupBy(*keys, clim).agg(*[F.avg(c).alias(c) for c in cols])


def anomaly(df: DataFrame, cols: list[str], keys: list[str], clim: str, standardized: bool = False) -> DataFrame:
    """Values less the mean of their climatological key, over its sample standard deviation if asked."""
    stats = df.groupBy(*keys, clim).agg(*[f(c).alias(f"__{k}_{c}") for c in cols for f, k in ((F.avg, "m"), (F.stddev_samp, "s"))])
    less = lambda c: F.col(c) - F.col(f"__m_{c}")
    joined = df.join(stats, [*keys, clim])
    return joined.select(*[(F.try_divide(less(c), F.col(f"__s_{c}")) if standardized else less(c)).alias(c) if c in cols else c for c in df.columns])


def smooth_anomaly(df: DataFrame, cols: list[str], keys: list[str], day: str, window: int, year: str | None = None, standardized: bool = False, period: int = 366) -> DataFrame:
    """Anomalies against a day-of-year climatology smoothed over a cyclic window, after a linear trend of the years for
    each day if ``year`` is named, divided by the smoothed standard deviation if asked."""
    if year:
        fits = df.groupBy(*keys, day).agg(*[f(F.col(c), F.col(year)).alias(f"__{k}_{c}") for c in cols for f, k in ((F.regr_slope, "a"), (F.regr_avgx, "x"))])
        df = df.join(fits, [*keys, day])
        df = df.withColumns({c: F.col(c) - F.coalesce(F.col(f"__a_{c}") * (F.col(year) - F.col(f"__x_{c}")), F.lit(0.0)) for c in cols}).drop(*[f"__{k}_{c}" for c in cols for k in "ax"])
    clim = df.groupBy(*keys, day).agg(*[f(c).alias(f"{k}_{c}") for c in cols for f, k in ((F.avg, "__m"), (F.stddev_samp, "__s"))])
    names = [f"{k}_{c}" for c in cols for k in ("__m", "__s")]
    clim = periodic_rolling(clim, window, {n: F.avg(n) for n in names}, day, keys, period)
    less = lambda c: F.col(c) - F.col(f"__m_{c}")
    return df.join(clim, [*keys, day]).select(*[(F.try_divide(less(c), F.col(f"__s_{c}")) if standardized else less(c)).alias(c) if c in cols else c for c in df.columns])


def extreme_climatology(df: DataFrame, col: str, keys: list[str], day: str, quantiles: list[float], window: int, period: int = 366) -> DataFrame:
    """Spatial quantiles a step, averaged by day of year and smoothed."""
    q = df.groupBy(*keys, day).agg(F.percentile(col, F.array(*[F.lit(x) for x in quantiles])).alias("q"))
    flat = q.groupBy(day).agg(*[F.avg(F.col("q")[i]).alias(f"q{round(100 * x)}") for i, x in enumerate(quantiles)])
    return periodic_rolling(flat, window, {f"q{round(100 * x)}": F.avg(f"q{round(100 * x)}") for x in quantiles}, day, [], period)


def resample(df: DataFrame, keys: list[str], order: str, every: int, aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col(order) / every).alias(order)).agg(*[a.alias(n) for n, a in aggs.items()])


def make_daily(spells: DataFrame, keys: list[str], order: str, per_day: int, means: list[str]) -> DataFrame:
    """Daily means of spell rows with a new relative index and length in days."""
    daily = spells.groupBy(*keys, "spell", F.floor(F.col(order) / per_day).alias("day")).agg(*[F.avg(c).alias(c) for c in means])
    w = Window.partitionBy(*keys, "spell")
    return daily.withColumn("relative_index", F.col("day") - F.min("day").over(w)).withColumn("len", F.count("*").over(w))


def category_average(props: DataFrame, keys: list[str], jet: str, mean: list[str], top: list[str], weight: str = "int") -> DataFrame:
    """Weighted means, plain means and maxima of features by category, and their number."""
    aggs = [weighted_mean(F.col(c), F.col(weight)).alias(c) for c in mean] + [F.max(c).alias(c) for c in top]
    return props.groupBy(*keys, jet).agg(*aggs, F.avg(weight).alias(weight), F.count("*").alias("njets"))


def flatten_levels(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """For each key the row of the level that maximises ``by`` (``-x`` minimises x); ties go to the lower level."""
    name, sign = by.removeprefix("-"), -1 if by.startswith("-") else 1
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(sign * F.col(name), -F.col("lev"))).alias("__b"))
    return best.select(*keys, "__b.*")


def cluster_centers(field: DataFrame, labels: DataFrame, on: list[str], cell: list[str], value: str) -> DataFrame:
    """Mean field by label, and the label's share of all steps."""
    share = labels.groupBy("label").agg(F.count("*").alias("__n")).crossJoin(F.broadcast(labels.agg(F.count("*").alias("__all"))))
    share = share.select("label", (F.col("__n") / F.col("__all")).alias("ratio"))
    return field.join(labels, on).groupBy("label", *cell).agg(F.avg(value).alias(value)).join(share, "label")


def series_by_label(series: DataFrame, labels: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """Mean of each series by label."""
    return series.join(labels.select(*on, "label"), on).groupBy("label").agg(*[F.avg(c).alias(c) for c in cols], F.count("*").alias("n"))


def seasonal_diff(a: DataFrame, b: DataFrame, keys: list[str], day: str, value: str, member: str, window: int = 15, period: int = 366) -> DataFrame:
    """Difference of two runs' mean seasonal cycles, and the 0.2 and 0.8 quantiles of the first run's members less the
    second's mean, smoothed over a cyclic window."""
    mean_a, mean_b = (x.groupBy(*keys, day).agg(F.avg(value).alias(n)) for x, n in ((a, "__a"), (b, "__b")))
    spread = a.groupBy(*keys, day, member).agg(F.avg(value).alias("__v")).groupBy(*keys, day)
    spread = spread.agg(F.percentile("__v", F.lit(0.2)).alias("__q20"), F.percentile("__v", F.lit(0.8)).alias("__q80"))
    joined = mean_a.join(mean_b, [*keys, day]).join(spread, [*keys, day])
    rows = joined.select(*keys, day, *[(F.col(x) - F.col("__b")).alias(n) for x, n in (("__a", "diff"), ("__q20", "q20"), ("__q80", "q80"))])
    return periodic_rolling(rows, window, {c: F.avg(c) for c in ("diff", "q20", "q80")}, day, keys, period)


def frequency_anomaly(spells: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Share of a label among the steps of spells less its share among all steps."""
    hit = spells.select(*on).distinct().withColumn("__in", F.lit(1))
    return relative_population(labels.join(hit, on, "left").withColumn("__in", F.coalesce("__in", F.lit(0))), F.col("__in") == 1, "label")


def event_seasonality(events: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Mean, deviation, median and the 0.4 and 0.6 quantiles of an event's value by day of year, and its sum."""
    q = [F.percentile(value, F.lit(p)).alias(n) for p, n in ((0.5, "median"), (0.4, "q40"), (0.6, "q60"))]
    return events.groupBy(*keys, day).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), *q, F.sum(value).alias("total"))


def weekly_population(labels: DataFrame, day: str, places: dict[str, int]) -> DataFrame:
    """By 7-day bin the number of labels and, for each periodic map axis (column -> size), the circular mean place and the
    length of the mean vector."""
    week = F.floor((F.col(day) - 1) / 7).alias("week")
    turn = lambda c, n: F.col(c) * (360.0 / n)
    spread = lambda c, n: F.hypot(F.avg(F.sin(F.radians(turn(c, n)))), F.avg(F.cos(F.radians(turn(c, n)))))
    centre = lambda c, n: F.pmod(circular_mean(turn(c, n)), F.lit(360.0)) * (n / 360.0)
    return labels.groupBy(week).agg(F.count("*").alias("n"), *[x for c, n in places.items() for x in (centre(c, n).alias(f"{c}_centre"), spread(c, n).alias(f"{c}_length"))])


def label_at_onset(spells: DataFrame, labels: DataFrame, keys: list[str], order: str, bound: int) -> DataFrame:
    """By label: the spells around whose onset it is most frequent, their mean length, and their share of all spells."""
    near = spells.where(F.abs("relative_index") <= bound).join(labels.select(*keys, order, "label"), [*keys, order])
    modal = near.groupBy(*keys, "spell").agg(F.mode("label", True).alias("label"), F.first("len").alias("len"))
    counts = modal.groupBy("label").agg(F.count("*").alias("spells"), F.avg("len").alias("mean_len"))
    return counts.crossJoin(F.broadcast(modal.agg(F.count("*").alias("__all")))).withColumn("share", F.col("spells") / F.col("__all")).drop("__all")


def position_grid(jets: DataFrame, keys: list[str], value: str = "is_polar") -> DataFrame:
    return jets.groupBy(*keys, "ilat", "ilon").agg(F.avg(value).alias(value))


def double_feature_index(df: DataFrame, keys: list[str], column: str, feature: str) -> DataFrame:
    """Share of all columns (over the key's whole axis) that hold two features or more."""
    n = df.select(column).distinct().agg(F.count("*").alias("__n"))
    two = df.groupBy(*keys, column).agg(F.countDistinct(feature).alias("k")).groupBy(*keys).agg(F.sum((F.col("k") >= 2).cast("double")).alias("__two"))
    return two.crossJoin(F.broadcast(n)).select(*keys, (F.col("__two") / F.col("__n")).alias("double_index"))


def event_props(nodes: DataFrame, keys: list[str], dlon: float, dlat: float, means: list[str]) -> DataFrame:
    """Area of an event's nodes, circular centre, and area-weighted means."""
    area = degcos(F.col("lat")) * F.radians(F.lit(dlon)) * F.radians(F.lit(dlat)) * (RADIUS * RADIUS)
    rows = nodes.withColumn("__a", area)
    a = F.col("__a")
    return rows.groupBy(*keys).agg(F.sum("__a").alias("area"), circular_mean(F.col("lon"), a).alias("com_x"), weighted_mean(F.col("lat"), a).alias("com_y"), *[weighted_mean(F.col(c), a).alias(c) for c in means])


def conditional_means(df: DataFrame, keys: list[str], value: str, regions: dict[str, Column], factor: float = 1.0) -> DataFrame:
    return df.groupBy(*keys).agg(*[(F.avg(F.when(cond, F.col(value))) * factor).alias(name) for name, cond in regions.items()])


def relative_climatology(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    return df.groupBy(*keys, day).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def relative_anomaly(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Values less the climatology of their day, over the season's mean deviation."""
    clim = relative_climatology(df, keys, day, value)
    season = clim.groupBy(*keys).agg(F.avg("std").alias("season_std"))
    return df.join(clim, [*keys, day]).join(season, keys).withColumn(value, F.try_divide(F.col(value) - F.col("mean"), F.col("season_std"))).select(*df.columns)


def normalise_position(df: DataFrame, keys: list[str], index: str, values: list[str], n_bins: int, more: list[str] = ()) -> DataFrame:
    """Means in bins of the relative place along each path."""
    top = F.greatest(F.max(index).over(Window.partitionBy(*keys)), F.lit(1))
    place = F.least(F.floor(F.col(index) / top * n_bins), F.lit(n_bins - 1)) / n_bins
    return df.withColumn("norm_index", place).groupBy(*keys, "norm_index", *more).agg(*[F.avg(c).alias(f"{c}_interp") for c in values])


def seasonal_cycle(df: DataFrame, keys: list[str], day: str, value: str, window: int = 15, period: int = 366) -> DataFrame:
    """Mean, median and quartiles by day of year, completed and smoothed over a cyclic window."""
    stats = df.groupBy(*keys, day).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.25)).alias("q25"), F.percentile(value, F.lit(0.75)).alias("q75"))
    days = df.sparkSession.range(1, period + 1).select(F.col("id").alias(day))
    full = df.select(*keys).distinct().crossJoin(F.broadcast(days)).join(stats, [*keys, day], "left") if keys else days.join(stats, day, "left")
    return periodic_rolling(full, window, {c: F.avg(c) for c in ("mean", "median", "q25", "q75")}, day, keys, period)


def quantile_bins(df: DataFrame, by: str, n: int, cols: list[str], keys: list[str] = ()) -> DataFrame:
    """Equal-count bins of one variable and the means of others; ties share the lower bin."""
    edges = df.groupBy(*keys).agg(F.percentile(by, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("__e"))
    joined = df.join(edges, list(keys)) if keys else df.crossJoin(F.broadcast(edges))
    place = F.aggregate("__e", F.lit(0).cast("bigint"), lambda acc, e: acc + (F.col(by) > e).cast("bigint"))
    return joined.withColumn("bin", place).groupBy(*keys, "bin").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])


def value_bins(df: DataFrame, by: dict[str, list[float]], cols: list[str], keys: list[str] = ()) -> DataFrame:
    """Bins with fixed edges in one or more variables: [e0, e1) is 1, under e0 is 0, from the last edge on len(edges)."""
    place = {f"{c}_bin": sum(((F.col(c) >= e).cast("bigint") for e in edges), F.lit(0).cast("bigint")) for c, edges in by.items()}
    return df.withColumns(place).groupBy(*keys, *place).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])


def histogram(df: DataFrame, col: str, low: float, high: float, n: int) -> DataFrame:
    """Counts of ``n`` even bins from ``low`` to ``high``; the outer ones are open, so every value counts."""
    place = F.greatest(F.lit(0), F.least(F.floor((F.col(col) - low) / (high - low) * n), F.lit(n - 1)))
    return df.where(F.col(col).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def kernel_density(df: DataFrame, col: str, grid: list[float], bandwidth: float, bins: int, low: float, high: float) -> DataFrame:
    """Gaussian density at grid points from a fine histogram: the work is bins times grid points, whatever the rows."""
    width = (high - low) / bins
    counts = histogram(df, col, low, high, bins).withColumn("x", low + (F.col("bin") + 0.5) * width)
    at = counts.withColumn("grid", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    kernel = F.exp(-F.pow((F.col("grid") - F.col("x")) / bandwidth, 2.0) / 2) / (bandwidth * 2.5066282746310002)
    return at.groupBy("grid").agg((F.sum(F.col("n") * kernel) / F.sum("n")).alias("density"))


def rate_function(df: DataFrame, col: str, keys: list[str], order: str, n: int, low: float, high: float, bins: int) -> DataFrame:
    """-log of the density of n-step means over n, shifted to 0 at its least."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    means = df.withColumn("__m", F.avg(col).over(w)).withColumn("__k", F.count(col).over(w)).where(F.col("__k") == n)
    counts = histogram(means, "__m", low, high, bins)
    total = counts.agg(F.sum("n").alias("__all"), F.max("n").alias("__top"))
    return counts.crossJoin(F.broadcast(total)).select("bin", (F.log(F.col("__top") / F.col("n")) / n).alias("rate"))


def label_distribution(df: DataFrame, keys: list[str], label: str, values: list[int]) -> DataFrame:
    """Counts by key and label, zeros included."""
    all_labels = F.explode(F.array(*[F.lit(v).cast("bigint") for v in values])).alias(label)
    counts = df.groupBy(*keys, F.col(label).cast("bigint").alias(label)).agg(F.count("*").alias("n"))
    return df.select(*keys).distinct().select(*keys, all_labels).join(counts, [*keys, label], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def relative_population(df: DataFrame, subset: Column, label: str) -> DataFrame:
    """Share of a label in the subset less its share in all."""
    total = df.agg(F.count("*").alias("__n"), F.sum(subset.cast("bigint")).alias("__s"))
    counts = df.groupBy(label).agg(F.count("*").alias("__a"), F.sum(subset.cast("bigint")).alias("__b"))
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("__b") / F.col("__s") - F.col("__a") / F.col("__n")).alias("excess"))


def transition_matrix(df: DataFrame, keys: list[str], order: str, label: str, step: int = 1) -> DataFrame:
    """Counts and shares of the label ``step`` rows later."""
    moved = df.withColumn("next", F.lead(label, step).over(Window.partitionBy(*keys).orderBy(order))).where("next is not null")
    counts = moved.groupBy(label, "next").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def hovmoller(relative: DataFrame, low: float, high: float, keys: list[str], value: str) -> DataFrame:
    return relative.where(F.col("n").between(low, high)).groupBy(*keys).agg(F.avg(value).alias(value))


def lifetime(df: DataFrame, keys: list[str], track: str, days: float) -> DataFrame:
    return df.groupBy(*keys, track).agg((F.count("*") * days).alias("lifetime"))


def conditional_weighted(df: DataFrame, keys: list[str], cond: Column, value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.when(cond, F.col(value) * F.col(weight))) / F.sum(F.when(cond, F.col(weight)))).alias(value))


def event_composite(field: DataFrame, events: DataFrame, order: str, offsets: list[int], cell: list[str], value: str, classes: dict[str, Column]) -> DataFrame:
    """Mean field at offsets around events, by class of event."""
    kinds = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in classes.items()]))).alias("kind")
    at = events.select(order, kinds).withColumn("offset", F.explode(F.array(*[F.lit(o).cast("bigint") for o in offsets])))
    joined = at.withColumn(order, F.col(order) + F.col("offset")).join(field, order)
    return joined.groupBy("kind", "offset", *cell).agg(F.avg(value).alias(value))


def centered_box(field: DataFrame, events: DataFrame, key: str, on: list[str], half: int) -> DataFrame:
    """Field nodes within ``half`` ids of each event's centre (ilon, ilat), as offsets from it."""
    span = F.sequence(F.lit(-half).cast("bigint"), F.lit(half).cast("bigint"))
    want = events.select(key, *on, F.col("ilon").alias("__x"), F.col("ilat").alias("__y"), F.explode(span).alias("dx")).withColumn("dy", F.explode(span))
    want = want.withColumns({"ilon": F.col("__x") + F.col("dx"), "ilat": F.col("__y") + F.col("dy")}).drop("__x", "__y")
    return want.join(field, [*on, "ilon", "ilat"]).drop("ilon", "ilat")


def dynamical_season(df: DataFrame, keys: list[str], day: str, label: str, month: str) -> DataFrame:
    """First and last day of the label that July has most often."""
    summer = df.where(F.col(month) == 7).groupBy(*keys).agg(F.mode(label, True).alias("__l"))
    return df.join(summer, keys).where(F.col(label) == F.col("__l")).groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def largest_jump(tracks: DataFrame, keys: list[str], track: str, order: str, value: str) -> DataFrame:
    """By key, the track with the largest change of a value from its first to its last step."""
    ends = tracks.groupBy(*keys, track).agg((F.max_by(value, order) - F.min_by(value, order)).alias("change"), F.count("*").alias("len"))
    best = ends.groupBy(*keys).agg(F.max_by(F.struct(track, "change", "len"), F.struct(F.abs("change"), -F.col(track))).alias("b"))
    return best.select(*keys, "b.*")


def latitude_index(field: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Zonal mean; its largest value and the latitude of it (the lower of tied ones)."""
    zonal = field.groupBy(*keys, "lat").agg(F.avg(value).alias("__z"))
    return zonal.groupBy(*keys).agg(F.max_by("lat", F.struct("__z", -F.col("lat"))).alias("jet_lat"), F.max("__z").alias("jet_speed"), (F.max("__z") - F.avg("__z")).alias("sharpness"))


def half_width(field: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Southern- and northernmost latitudes where the zonal mean reaches half its sharpness."""
    zonal = field.groupBy(*keys, "lat").agg(F.avg(value).alias("__z"))
    w = Window.partitionBy(*keys)
    level = (F.max("__z").over(w) + F.avg("__z").over(w)) / 2
    return zonal.withColumn("__h", level).where(F.col("__z") >= F.col("__h")).groupBy(*keys).agg(F.min("lat").alias("south"), F.max("lat").alias("north"))


def centroid_lon(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Square-weighted longitude, and the ends of where the value exceeds its mean."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__m", F.avg(value).over(w))
    high = F.col(value) >= F.col("__m")
    return rows.groupBy(*keys).agg((F.sum(F.col("lon") * F.pow(F.col(value), 2.0)) / F.sum(F.pow(F.col(value), 2.0))).alias("centroid"), F.min(F.when(high, F.col("lon"))).alias("west"), F.max(F.when(high, F.col("lon"))).alias("east"))


def departure(field: DataFrame, tracked: DataFrame, keys: list[str], x: str, y: str, value: str) -> DataFrame:
    """Sum over columns of the distance of the maximum's row from the tracked row."""
    top = field.groupBy(*keys, x).agg(F.max_by(F.col(y), F.struct(F.col(value), -F.col(y))).alias("__top"))
    return top.join(tracked, [*keys, x]).groupBy(*keys).agg(F.sum(F.abs(F.col("__top") - F.col(y))).alias("departure"))


def meandering(points: DataFrame, keys: list[str], contour: list[str], order: str) -> DataFrame:
    """Greatest length of a key's contours in turns around the globe, in degrees on the map."""
    w = Window.partitionBy(*keys, *contour).orderBy(order)
    step = F.sqrt(F.pow(F.col("lon") - F.lag("lon").over(w), 2.0) + F.pow(F.col("lat") - F.lag("lat").over(w), 2.0))
    length = points.withColumn("__s", step).groupBy(*keys, *contour).agg((F.sum("__s") / 360).alias("turns"))
    return length.groupBy(*keys).agg(F.max("turns").alias("meandering"))


def region_composite(spells: DataFrame, table: DataFrame, on: list[str], keys: list[str], value: str, lengths: tuple[int, int], bound: int) -> DataFrame:
    """Mean of the standardised value within ``bound`` steps of the onset of spells of the given lengths."""
    scaled = table.withColumn("__z", (F.col(value) - F.avg(value).over(Window.partitionBy(*keys))) / F.stddev_samp(value).over(Window.partitionBy(*keys)))
    chosen = spells.where(F.col("len").between(*lengths) & (F.abs("relative_index") <= bound))
    return chosen.select(*on, "relative_index").join(scaled, on).groupBy(*keys, "relative_index").agg(F.avg("__z").alias(value), F.count("*").alias("n"))


def box_mean(field: DataFrame, boxes: dict[str, tuple[float, float, float, float]], keys: list[str], value: str) -> DataFrame:
    """Mean in named boxes (west, east, south, north); the boxes are literals, so no join."""
    inside = [F.when(F.col("lon").between(w, e) & F.col("lat").between(s, n), F.lit(name)) for name, (w, e, s, n) in boxes.items()]
    return field.withColumn("box", F.explode(F.array_compact(F.array(*inside)))).groupBy(*keys, "box").agg(F.avg(value).alias(value))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlations of all pairs over rows without gaps: one aggregate, laid out long."""
    full = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide_ = full.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return wide_.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("p")).select("p.*")


def occurrence(position: DataFrame, times: DataFrame, cell: list[str], by: list[str]) -> DataFrame:
    """Share of a group's times at which the cell is occupied; absent times count."""
    total = times.groupBy(*by).agg(F.count("*").alias("__all"))
    return position.groupBy(*by, *cell).agg(F.count("*").alias("__n")).join(total, by).select(*by, *cell, (F.col("__n") / F.col("__all")).alias("share"))


def residence_times(spells: DataFrame, long: int) -> DataFrame:
    """By label: long stays, mean and 0.95 quantile of stays."""
    return spells.groupBy("value").agg(F.sum((F.col("len") >= long).cast("bigint")).alias("long_stays"), F.avg("len").alias("mean_len"), F.percentile("len", F.lit(0.95)).alias("q95_len"))


def during_pvalues(spells: DataFrame, props: DataFrame, keys: list[str], order: str, value: str, n: int, seed: int = 0) -> DataFrame:
    """By spell the mean of a value during it and the share of ``n`` random places of the same length whose mean lies under
    it (ties, up to the order of sums, count half). Places are hashes of the seed, so results repeat; the key's steps are
    numbered once and meet the places by stretches of ``STRETCH``, not one by one."""
    rows = props.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    size = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    seen = spells.join(props.select(*keys, order, value), [*keys, order]).groupBy(*keys, "spell").agg(F.avg(value).alias("during"), F.count("*").alias("len"))
    draws = seen.join(size, keys).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    start = F.pmod(F.xxhash64(F.lit(seed), "__s", "spell", *keys), F.greatest(F.col("__n") - F.col("len") + 1, F.lit(1)))
    draws = draws.withColumn("__a", start).withColumn("__z", F.col("__a") + F.col("len") - 1)
    blocks = F.explode(F.sequence(F.floor(F.col("__a") / STRETCH), F.floor(F.col("__z") / STRETCH)))
    places = draws.select(*keys, "spell", "during", "len", "__s", "__a", "__z", blocks.alias("__b"))
    seq = F.array_sort(F.collect_list(F.struct("__i", F.col(value).cast("double").alias("v"))))
    series = rows.groupBy(*keys, F.floor(F.col("__i") / STRETCH).alias("__b")).agg(F.transform(seq, lambda x: x.v).alias("__q"))
    low, high = F.greatest(F.col("__a") - F.col("__b") * STRETCH, F.lit(0)), F.least(F.col("__z") - F.col("__b") * STRETCH, F.lit(STRETCH - 1))
    met = places.hint("merge").join(series, [*keys, "__b"])
    met = met.withColumn("__q", F.array_compact(F.slice("__q", (low + 1).cast("int"), (high - low + 1).cast("int"))))
    met = met.select(*keys, "spell", "during", "len", "__s", F.aggregate("__q", F.lit(0.0), lambda acc, x: acc + x).alias("__m"), F.size("__q").alias("__k"))
    means = met.groupBy(*keys, "spell", "during", "len", "__s").agg(F.try_divide(F.sum("__m"), F.sum("__k")).alias("__m"))
    even = F.abs(F.col("__m") - F.col("during")) <= 1e-12 * F.greatest(F.abs("__m"), F.abs("during"))
    under = F.avg(F.when(even, 0.5).when(F.col("__m") < F.col("during"), 1.0).otherwise(0.0))
    return means.groupBy(*keys, "spell", "during", "len").agg(under.alias("p"))


def before_during(spells: DataFrame, props: DataFrame, on: list[str], value: str, before: int) -> DataFrame:
    """By spell the mean of a value in the steps before and during it; rows -2 and -3 hold the mean and deviation of all."""
    joined = spells.join(props, on)
    rows = joined.groupBy("spell").agg(F.avg(F.when(F.col("relative_index").between(-before, -1), F.col(value))).alias("before"), F.avg(F.when(F.col("relative_index") >= 0, F.col(value))).alias("during"))
    mean, std = F.avg(value), F.stddev_samp(value)
    totals = props.agg(mean.alias("m"), std.alias("d")).select(F.explode(F.array(F.struct(F.lit(-2).cast("bigint").alias("spell"), F.col("m").alias("v")), F.struct(F.lit(-3).cast("bigint").alias("spell"), F.col("d").alias("v")))).alias("t"))
    return rows.unionByName(totals.select("t.spell", F.col("t.v").alias("before"), F.col("t.v").alias("during")))


def top_n(df: DataFrame, keys: list[str], by: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order, which must be unique."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("__n") <= n).drop("__n")


def longest_by_label(spells: DataFrame) -> DataFrame:
    best = spells.groupBy("value").agg(F.max_by(F.struct("len", "first"), F.struct("len", -F.col("first"))).alias("b"))
    return best.select("value", "b.*")
