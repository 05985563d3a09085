"""Smoothing and finite differences on latitude-longitude grids (columns ilon, ilat, lon, lat)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratus.functions.sphere import OMEGA, RADIUS, coriolis, degcos, degsin

from .sequence import central_diff


def window_mean(df: DataFrame, col: str, keys: list[str], axis: str, half: int, period: int | None = None, name: str | None = None) -> DataFrame:
    """Centred running mean along an axis id, over what is there; wrapped where ``period`` is given."""
    name = name or col
    if period is None:
        w = Window.partitionBy(*keys).orderBy(axis).rangeBetween(-half, half)
        return df.withColumn(name, F.avg(col).over(w))
    wrap = F.explode(F.array(F.lit(0), F.lit(period), F.lit(-period)))
    padded = df.withColumn("__o", wrap).withColumn("__a", F.col(axis) + F.col("__o")).where(F.col("__a").between(-half, period + half - 1))
    w = Window.partitionBy(*keys).orderBy("__a").rangeBetween(-half, half)
    return padded.withColumn(name, F.avg(col).over(w)).where("__o = 0").drop("__o", "__a")


def kernel_smooth(df: DataFrame, col: str, keys: list[str], axis: str, weights: list[float], name: str | None = None) -> DataFrame:
    """Weighted running mean along an axis id, renormalised at the edges: a window of shifted values, no join."""
    h = len(weights) // 2
    w = Window.partitionBy(*keys).orderBy(axis)
    taps = [(F.lag(col, h - i).over(w) if i <= h else F.lead(col, i - h).over(w), float(x)) for i, x in enumerate(weights)]
    top = sum((F.coalesce(v * x, F.lit(0.0)) for v, x in taps), F.lit(0.0))
    bottom = sum((F.when(v.isNotNull(), F.lit(x)).otherwise(0.0) for v, x in taps), F.lit(0.0))
    return df.withColumn(name or col, top / bottom)


def gaussian_smooth(df: DataFrame, col: str, keys: list[str], sigma_x: float, sigma_y: float) -> DataFrame:
    """Separable Gaussian filter, cut at four sigma."""
    weights = lambda s: [math.exp(-0.5 * (k / s) ** 2) for k in range(-round(4 * s), round(4 * s) + 1)]
    df = kernel_smooth(df, col, [*keys, "ilat"], "ilon", weights(sigma_x))
    return kernel_smooth(df, col, [*keys, "ilon"], "ilat", weights(sigma_y))


def lanczos(half: int, cutoff: float) -> list[float]:
    """Weights of a Lanczos low-pass filter of 2 * half + 1 steps, summing to 1."""
    raw = [2 * cutoff if k == 0 else math.sin(2 * math.pi * cutoff * k) / (math.pi * k) * math.sin(math.pi * k / (half + 1)) / (math.pi * k / (half + 1)) for k in range(-half, half + 1)]
    return [x / sum(raw) for x in raw]


def band_pass(df: DataFrame, col: str, keys: list[str], order: str, low: float, high: float, name: str = "filtered") -> DataFrame:
    """Keep the Fourier parts of whole frequencies k with low <= k / n <= high, by sums over series x frequencies.

    All such frequencies are kept; each key's series meets them in one aggregate and one join back.
    """
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)})
    last = F.least(F.floor(F.col("__n") * high), F.floor(F.col("__n") / 2)) + 1  # one more: rounding decides below
    spread = rows.withColumn("__k", F.explode(F.sequence(F.greatest(F.floor(F.col("__n") * low) - 1, F.lit(0).cast("bigint")), last)))
    spread = spread.where((F.col("__k") / F.col("__n")).between(low, high) & (2 * F.col("__k") <= F.col("__n")))
    angle = F.col("__k") * F.col("__i") * (2 * math.pi) / F.col("__n")
    parts = spread.groupBy(*keys, "__k", "__n").agg(F.sum(F.col(col) * F.cos(angle)).alias("__c"), F.sum(F.col(col) * F.sin(angle)).alias("__s"))
    twice = F.when((F.col("__k") == 0) | (F.col("__k") * 2 == F.col("__n")), 1.0).otherwise(2.0)
    packed = parts.groupBy(*keys).agg(F.collect_list(F.struct("__k", (twice * F.col("__c") / F.col("__n")).alias("c"), (twice * F.col("__s") / F.col("__n")).alias("s"))).alias("__f"))
    joined = rows.join(packed, keys, "left") if keys else rows.crossJoin(F.broadcast(packed))
    wave = lambda acc, p: acc + p.c * F.cos(p["__k"] * F.col("__i") * (2 * math.pi) / F.col("__n")) + p.s * F.sin(p["__k"] * F.col("__i") * (2 * math.pi) / F.col("__n"))
    return joined.withColumn(name, F.coalesce(F.aggregate("__f", F.lit(0.0), wave), F.lit(0.0))).drop("__i", "__n", "__f")


def d_dx(col: str | Column, keys: list[str]) -> Column:
    """Eastward derivative in 1/m."""
    rows = [*keys, "ilat"]
    return central_diff(col, rows, "ilon") / (central_diff("lon", rows, "ilon") * math.pi / 180 * RADIUS * degcos(F.col("lat")))


def d_dy(col: str | Column, keys: list[str]) -> Column:
    """Northward derivative in 1/m."""
    rows = [*keys, "ilon"]
    return central_diff(col, rows, "ilat") / (central_diff("lat", rows, "ilat") * math.pi / 180 * RADIUS)


def metric_terms(grid: DataFrame, dlon: float, dlat: float) -> DataFrame:
    return grid.withColumns({"dx": F.lit(RADIUS * math.radians(dlon)) * degcos(F.col("lat")), "dy": F.lit(RADIUS * math.radians(dlat))})


def norm_derivative(grid: DataFrame, of: str, keys: list[str], name: str = "sigma") -> DataFrame:
    """Derivative across the wind, to its left: (u df/dy - v df/dx) / s with the sign that makes a core's south positive."""
    both = grid.withColumns({"__x": d_dx(of, keys), "__y": d_dy(of, keys)})
    return both.withColumn(name, (F.col("v") * F.col("__x") - F.col("u") * F.col("__y")) / F.col("s")).drop("__x", "__y")


def relative_vorticity(grid: DataFrame, keys: list[str], name: str = "vorticity") -> DataFrame:
    both = grid.withColumn("__uc", F.col("u") * degcos(F.col("lat"))).withColumns({"__x": d_dx("v", keys), "__y": d_dy("__uc", keys)})
    return both.withColumn(name, F.col("__x") - F.col("__y") / degcos(F.col("lat"))).drop("__uc", "__x", "__y")


def absolute_vorticity(grid: DataFrame, keys: list[str], name: str = "abs_vorticity") -> DataFrame:
    return relative_vorticity(grid, keys, name).withColumn(name, F.col(name) + 2 * OMEGA * degsin(F.col("lat")))


def divergence(grid: DataFrame, u: str, v: str, keys: list[str], name: str = "divergence") -> DataFrame:
    both = grid.withColumn("__vc", F.col(v) * degcos(F.col("lat"))).withColumns({"__x": d_dx(u, keys), "__y": d_dy("__vc", keys)})
    return both.withColumn(name, F.col("__x") + F.col("__y") / degcos(F.col("lat"))).drop("__vc", "__x", "__y")


def tangential_derivative(grid: DataFrame, of: str, keys: list[str], name: str = "along") -> DataFrame:
    both = grid.withColumns({"__x": d_dx(of, keys), "__y": d_dy(of, keys)})
    return both.withColumn(name, (F.col("u") * F.col("__x") + F.col("v") * F.col("__y")) / F.col("s")).drop("__x", "__y")


def laplacian(grid: DataFrame, of: str, keys: list[str], name: str = "laplacian") -> DataFrame:
    first = grid.withColumns({"__x": d_dx(of, keys), "__y": d_dy(of, keys)})
    return first.withColumns({"__xx": d_dx("__x", keys), "__yy": d_dy("__y", keys)}).withColumn(name, F.col("__xx") + F.col("__yy")).drop("__x", "__y", "__xx", "__yy")


def axis_criterion(grid: DataFrame, keys: list[str]) -> DataFrame:
    """s * d(sigma)/dn + sigma squared where that is negative: sharp speed maxima across the wind."""
    twice = norm_derivative(norm_derivative(grid, "s", keys), "sigma", keys, "__t")
    crit = F.col("s") * F.col("__t") + F.pow("sigma", F.lit(2.0))
    return twice.withColumn("criterion", F.when(crit < 0, crit)).drop("__t")


def log_gradient(grid: DataFrame, col: str, keys: list[str], name: str = "log_gradient") -> DataFrame:
    logged = grid.withColumn("__l", F.log(F.when(F.col(col) > 0, F.col(col)))).withColumns({"__x": d_dx("__l", keys), "__y": d_dy("__l", keys)})
    return logged.withColumn(name, F.hypot("__x", "__y")).drop("__l", "__x", "__y")


def vertical_derivative(grid: DataFrame, col: str, keys: list[str], lev: str = "lev", name: str = "d_dp") -> DataFrame:
    """Derivative along uneven levels: the mean of both sides' slopes, each weighted by the other side's width."""
    w = Window.partitionBy(*keys, "ilon", "ilat").orderBy(lev)
    hu, hd = F.lead(lev).over(w) - F.col(lev), F.col(lev) - F.lag(lev).over(w)
    up, down = (F.lead(col).over(w) - F.col(col)) / hu, (F.col(col) - F.lag(col).over(w)) / hd
    return grid.withColumn(name, F.coalesce((up * hd + down * hu) / (hu + hd), up, down))


def eddy_energy(grid: DataFrame, low: dict[str, str]) -> DataFrame:
    """Eddy parts of the fields (field -> its low pass), eddy kinetic energy, and the deformation (E vector) terms."""
    parts = {f"{c}_eddy": F.col(c) - F.col(slow) for c, slow in low.items()}
    e = grid.withColumns(parts)
    return e.withColumns({"eke": (F.pow("u_eddy", F.lit(2.0)) + F.pow("v_eddy", F.lit(2.0))) / 2, "e_x": (F.pow("v_eddy", F.lit(2.0)) - F.pow("u_eddy", F.lit(2.0))) / 2, "e_y": -F.col("u_eddy") * F.col("v_eddy")})


def eddy_generation(grid: DataFrame, keys: list[str]) -> DataFrame:
    """E vector dotted with the deformation of the background wind (columns u_low, v_low)."""
    d = grid.withColumns({"__ux": d_dx("u_low", keys), "__uy": d_dy("u_low", keys), "__vx": d_dx("v_low", keys), "__vy": d_dy("v_low", keys)})
    return d.withColumn("generation", F.col("e_x") * (F.col("__ux") - F.col("__vy")) + F.col("e_y") * (F.col("__vx") + F.col("__uy"))).drop("__ux", "__uy", "__vx", "__vy")


def eady_growth(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Growth rate from shear and stability of columns s (wind), theta and lev (hPa) on levels."""
    g = vertical_derivative(vertical_derivative(grid, "s", keys, name="__du"), "theta", keys, name="__dt")
    rho = F.col("lev") * 100 / (287.0500676 * F.col("theta") * F.pow(F.col("lev") / 1000, F.lit(0.2854)))
    stability = F.sqrt(F.greatest(F.lit(1e-12), -9.81 * 9.81 * rho * F.col("__dt") / 100 / F.col("theta")))
    return g.withColumn("eady", 0.3098 * 9.81 * rho * F.abs(coriolis(F.col("lat"))) * F.abs(F.col("__du") / 100) / stability).drop("__du", "__dt")


def coarsen_grid(grid: DataFrame, keys: list[str], n: int, cols: list[str], func=F.avg, nlon: int | None = None) -> DataFrame:
    """Blocks of n x n nodes reduced by ``func``; with ``nlon`` the blocks are centred on multiples of n and wrap."""
    x = F.pmod(F.col("ilon") + n // 2, F.lit(nlon)) if nlon else F.col("ilon")
    return grid.groupBy(*keys, F.floor(F.col("ilat") / n).alias("ilat"), F.floor(x / n).alias("ilon")).agg(*[func(c).alias(c) for c in cols])


def eddy_forcing(grid: DataFrame, low: dict[str, str], keys: list[str], lev: str | None = None) -> DataFrame:
    """:func:`eddy_energy`, the momentum and heat fluxes of the eddies, the convergence of the horizontal momentum flux, and
    with ``lev`` the available potential energy and the vertical convergence of the heat flux (fields theta and omega)."""
    e = eddy_energy(grid, low).withColumn("uv", F.col("u_eddy") * F.col("v_eddy")).withColumn("uu", F.pow("u_eddy", F.lit(2.0)))
    e = divergence(e, "uu", "uv", keys, "momentum_convergence").withColumn("momentum_convergence", -F.col("momentum_convergence"))
    if lev is None:
        return e
    e = e.withColumns({"v_theta": F.col("v_eddy") * F.col("theta_eddy"), "omega_theta": F.col("omega_eddy") * F.col("theta_eddy")})
    e = vertical_derivative(vertical_derivative(e, low["theta"], keys, lev, "__st"), "omega_theta", keys, lev, "__vc")
    stable = F.when(F.col("__st") < 0, F.col("__st"))
    return e.withColumns({"ape": -F.pow("theta_eddy", F.lit(2.0)) / (2 * F.col(low["theta"]) * stable), "heat_convergence": -F.col("__vc")}).drop("__st", "__vc")


def preprocess(grid: DataFrame, keys: list[str], factor: int, half: int) -> DataFrame:
    """Blocks of ``factor`` nodes averaged, smoothed, and the derivative across the wind."""
    names = [c for c in ("lon", "lat", "u", "v") if c in grid.columns]
    rough = grid.groupBy(*keys, F.floor(F.col("ilat") / factor).alias("ilat"), F.floor(F.col("ilon") / factor).alias("ilon")).agg(*[F.avg(c).alias(c) for c in names])
    for c in ("u", "v"):
        rough = window_mean(window_mean(rough, c, [*keys, "ilat"], "ilon", half), c, [*keys, "ilon"], "ilat", half)
    return norm_derivative(rough.withColumn("s", F.hypot("u", "v")), "s", keys)


def directional_smooth(grid: DataFrame, col: str, keys: list[str], along: float, across: float, reach: int) -> DataFrame:
    """Gaussian mean over neighbours, wide along the local wind and narrow across it."""
    span = F.sequence(F.lit(-reach).cast("bigint"), F.lit(reach).cast("bigint"))
    want = grid.select(*keys, "ilon", "ilat", "u", "v", F.explode(span).alias("dx")).withColumn("dy", F.explode(span))
    want = want.withColumns({"__x": F.col("ilon") + F.col("dx"), "__y": F.col("ilat") + F.col("dy")})
    near = grid.select(*keys, F.col("ilon").alias("__x"), F.col("ilat").alias("__y"), F.col(col).alias("__v"))
    s = F.greatest(F.hypot("u", "v"), F.lit(1e-9))
    t, n = (F.col("dx") * F.col("u") + F.col("dy") * F.col("v")) / s, (F.col("dy") * F.col("u") - F.col("dx") * F.col("v")) / s
    weight = F.exp(-(F.pow(t / along, 2.0) + F.pow(n / across, 2.0)) / 2)
    joined = want.join(near, [*keys, "__x", "__y"]).withColumn("__w", weight)
    means = joined.groupBy(*keys, "ilon", "ilat").agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("smoothed"))
    return grid.join(means, [*keys, "ilon", "ilat"], "left")
