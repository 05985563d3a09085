"""Interpolation at points, sections normal to paths, and path-relative data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratus.functions.sphere import degcos, destination, wrap_lon

from .aggregate import normalise_position
from .sequence import central_diff


def bilinear(points: DataFrame, grid: DataFrame, on: list[str], cols: list[str], first: tuple[float, float], step: tuple[float, float], nlon: int | None = None, suffix: str = "_interp") -> DataFrame:
    """Bilinear values of ``grid`` (ilon, ilat) at points; points whose four corners are not all there are dropped.

    The grid is gathered to cells that hold their four corners; a point meets its cell by one equi join. With ``nlon`` the
    longitude ids wrap.
    """
    wrap = (lambda c: F.pmod(c, F.lit(nlon))) if nlon else (lambda c: c)
    values = F.struct(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    corners = F.explode(F.array(*[F.struct(F.lit(2 * a + b).alias("k"), wrap(F.col("ilon") - a).alias("x"), (F.col("ilat") - b).alias("y")) for a in (0, 1) for b in (0, 1)]))
    cells = grid.select(*on, values.alias("__v"), corners.alias("c")).groupBy(*on, F.col("c.x").alias("__x"), F.col("c.y").alias("__y"))
    cells = cells.agg(*[F.max(F.when(F.col("c.k") == k, F.col("__v"))).alias(f"__c{k}") for k in range(4)])
    x, y = (F.col("lon") - first[0]) / step[0], (F.col("lat") - first[1]) / step[1]
    x = F.pmod(x, F.lit(float(nlon))) if nlon else x
    rows = points.withColumns({"__x": F.floor(x), "__y": F.floor(y), "__fx": x - F.floor(x), "__fy": y - F.floor(y)})
    weight = [(F.col("__fx") if a else 1 - F.col("__fx")) * (F.col("__fy") if b else 1 - F.col("__fy")) for a in (0, 1) for b in (0, 1)]
    joined = rows.join(cells, [*on, "__x", "__y"])
    for k in range(4):  # a point on a grid line needs no corner beyond it
        joined = joined.where((weight[k] <= 0) | F.col(f"__c{k}").isNotNull())
    term = lambda k, i: F.when(weight[k] > 0, weight[k] * F.col(f"__c{k}.v{i}")).otherwise(0.0)
    return joined.select(*points.columns, *[sum((term(k, i) for k in range(4)), F.lit(0.0)).alias(c + suffix) for i, c in enumerate(cols)])


def interp_along(grid: DataFrame, points: DataFrame, on: list[str], axes: dict[str, tuple[float, float]], value: str, name: str = "interp") -> DataFrame:
    """Linear values in any number of regular axes (column -> first, step) at ``points``: two corners an axis are gathered
    into cells, and a point meets its cell by one equi join. Points without all corners are dropped."""
    dims = list(axes)
    node = {d: F.round((F.col(d) - a) / s).cast("bigint") for d, (a, s) in axes.items()}
    ids = [[(k >> i) & 1 for i in range(len(dims))] for k in range(1 << len(dims))]
    corners = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[(node[d] - up[i]).alias(f"x{i}") for i, d in enumerate(dims)]) for k, up in enumerate(ids)]))
    at = [f"__x{i}" for i in range(len(dims))]
    cells = grid.select(*on, F.col(value).cast("double").alias("__v"), corners.alias("c")).groupBy(*on, *[F.col(f"c.x{i}").alias(n) for i, n in enumerate(at)])
    cells = cells.agg(*[F.max(F.when(F.col("c.k") == k, F.col("__v"))).alias(f"__c{k}") for k in range(len(ids))])
    place = [(F.col(d) - a) / s for d, (a, s) in axes.items()]
    rows = points.withColumns({n: F.floor(p) for n, p in zip(at, place)} | {f"__f{i}": p - F.floor(p) for i, p in enumerate(place)})
    joined, total = rows.join(cells, [*on, *at]), F.lit(0.0)
    for k, up in enumerate(ids):
        w = F.lit(1.0)
        for i, b in enumerate(up):
            w = w * (F.col(f"__f{i}") if b else 1 - F.col(f"__f{i}"))
        joined, total = joined.where((w <= 0) | F.col(f"__c{k}").isNotNull()), total + F.when(w > 0, w * F.col(f"__c{k}")).otherwise(0.0)
    return joined.select(*points.columns, total.alias(name))


def tangent_angle(keys: list[str], order: str) -> Column:
    """Angle of a path in its local plane, counter-clockwise from east, modulo pi."""
    dx = central_diff("lon", keys, order) * degcos(F.col("lat"))
    return F.pmod(F.atan2(central_diff("lat", keys, order), dx), F.lit(3.141592653589793))


def normal_points(paths: DataFrame, keys: list[str], order: str, half_length: float, dn: float) -> DataFrame:
    """Points every ``dn`` metres on the normal at each path point, ``n`` positive to the left; offsets are literals."""
    k = int(half_length // dn)
    rows = paths.withColumn("__angle", tangent_angle(keys, order)).withColumn("n", F.explode(F.array(*[F.lit(i * dn) for i in range(-k, k + 1)])))
    bearing = -F.col("__angle")  # left of east is north
    lon, lat = destination(F.col("lon"), F.col("lat"), bearing, F.col("n"))
    return rows.withColumns({"normal_lon": lon, "normal_lat": lat, "side": F.signum("n").cast("int")}).drop("__angle")


def normal_sections(paths: DataFrame, grid: DataFrame, keys: list[str], order: str, on: list[str], cols: list[str], half_length: float, dn: float, first, step, nlon=None) -> DataFrame:
    """Field values on the normals of paths."""
    points = normal_points(paths, keys, order, half_length, dn).withColumnsRenamed({"lon": "__lon", "lat": "__lat"}).withColumnsRenamed({"normal_lon": "lon", "normal_lat": "lat"})
    out = bilinear(points, grid, on, cols, first, step, nlon)
    return out.withColumnsRenamed({"lon": "normal_lon", "lat": "normal_lat"}).withColumnsRenamed({"__lon": "lon", "__lat": "lat"})


def along_axis(sections: DataFrame, keys: list[str], index: str, u: str, v: str) -> DataFrame:
    """``sections`` with a vector's parts along the path and to its left, in ``<u>_along`` and ``<v>_left``."""
    core = sections.where("n = 0").select(*keys, index, "lon", "lat").distinct()
    angle = core.withColumn("__angle", tangent_angle(keys, index)).select(*keys, index, "__angle")
    j = sections.join(angle, [*keys, index])
    return j.withColumns({f"{u}_along": F.col(u) * F.cos("__angle") + F.col(v) * F.sin("__angle"), f"{v}_left": F.col(v) * F.cos("__angle") - F.col(u) * F.sin("__angle")}).drop("__angle")


def relative_dataset(sections: DataFrame, keys: list[str], index: str, cols: list[str], n_bins: int, bias: DataFrame | None = None, dn: float = 1.0) -> DataFrame:
    """Section values by relative place along the path and distance from it; with ``bias`` (keys, index, bias) the distances
    are taken from the corrected core, in whole steps of ``dn``."""
    if bias is not None:
        shift = F.round(F.coalesce("bias", F.lit(0.0)) / dn) * dn
        sections = sections.join(bias.select(*keys, index, "bias"), [*keys, index], "left").withColumn("n", F.col("n") - shift).drop("bias")
    return normalise_position(sections, keys, index, [f"{c}_interp" for c in cols], n_bins, ["n"])


def bias_offset(sections: DataFrame, keys: list[str], index: str, value: str, half: int) -> DataFrame:
    """By path point the offset n of the section's maximum, as a running mean along the path."""
    best = sections.groupBy(*keys, index).agg(F.max_by("n", F.struct(value, -F.abs("n"))).alias("n"))
    return best.withColumn("bias", F.avg("n").over(Window.partitionBy(*keys).orderBy(index).rangeBetween(-half, half)))


def zero_line_bias(sections: DataFrame, keys: list[str], index: str, value: str, half_index: int, half_n: int, half: int, share: float = 0.9) -> DataFrame:
    """By path point the offset of the nearest maximum across the path: the section is smoothed both ways, its derivative in n
    changes sign there. Offsets are a running mean along the path; null where fewer than ``share`` of a path's points have one."""
    across, along = Window.partitionBy(*keys, index).orderBy("n"), Window.partitionBy(*keys, "n").orderBy(index)
    s = sections.withColumn("__v", F.avg(value).over(across.rowsBetween(-half_n, half_n)))
    s = s.withColumn("__v", F.avg("__v").over(along.rangeBetween(-half_index, half_index)))
    s = s.withColumn("__d", (F.lead("__v").over(across) - F.col("__v")) / (F.lead("n").over(across) - F.col("n")))
    s = s.withColumn("__b", F.lag("__d").over(across))
    top = (F.col("__b") > 0) & (F.col("__d") <= 0)
    points = s.groupBy(*keys, index).agg(F.min_by(F.when(top, F.col("n")), F.when(top, F.abs("n") + F.when(F.col("n") < 0, 1e-6).otherwise(0.0))).alias("n"))
    seen = F.avg(F.col("n").isNotNull().cast("double")).over(Window.partitionBy(*keys))
    mean = F.avg("n").over(Window.partitionBy(*keys).orderBy(index).rangeBetween(-half, half))
    return points.withColumn("__s", seen).withColumn("bias", F.when(F.col("__s") >= share, mean)).drop("__s")


def extend_paths(paths: DataFrame, keys: list[str], order: str, max_t: int, dt: float = 1.0, n_mean: int = 5) -> DataFrame:
    """Straight extensions along the mean step of the first and last points, ``max_t`` points each way."""
    w = Window.partitionBy(*keys)
    rows = paths.withColumns({"__i": F.row_number().over(w.orderBy(order)), "__n": F.count("*").over(w), "__dx": F.lead("lon").over(w.orderBy(order)) - F.col("lon"), "__dy": F.lead("lat").over(w.orderBy(order)) - F.col("lat")})
    head, tail = F.col("__i") < n_mean, F.col("__i") > F.col("__n") - n_mean
    ends = rows.groupBy(*keys).agg(
        F.min_by("lon", order).alias("x0"), F.min_by("lat", order).alias("y0"), F.max_by("lon", order).alias("x1"), F.max_by("lat", order).alias("y1"), F.min(order).alias("o0"), F.max(order).alias("o1"),
        *[F.avg(F.when(c, F.col(d))).alias(n) for c, d, n in ((head, "__dx", "a0"), (head, "__dy", "b0"), (tail, "__dx", "a1"), (tail, "__dy", "b1"))],
    ).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(max_t))))
    make = lambda s, e: ends.select(*keys, (F.col(f"o{e}") + s * F.col("t")).alias(order), wrap_lon(F.col(f"x{e}") + s * dt * F.col("t") * F.col(f"a{e}")).alias("lon"), (F.col(f"y{e}") + s * dt * F.col("t") * F.col(f"b{e}")).alias("lat"))
    return paths.select(*keys, order, "lon", "lat").unionByName(make(-1, 0)).unionByName(make(1, 1))


def smooth_paths(paths: DataFrame, keys: list[str], order: str, half: int) -> DataFrame:
    """Running mean of positions over the point index; longitudes are taken relative to the first point."""
    first = F.first("lon").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    rows = paths.withColumn("__f", first).withColumn("__d", F.pmod(F.col("lon") - F.col("__f") + 180.0, F.lit(360.0)) - 180.0)
    return rows.withColumns({"lon": wrap_lon(F.avg("__d").over(w) + F.col("__f")), "lat": F.avg("lat").over(w)}).drop("__f", "__d")


