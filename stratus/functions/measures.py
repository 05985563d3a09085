"""Aggregates and statistics as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def weighted_mean(x: Column, w: Column, skip_null: bool = False) -> Column:
    """Sum of products over the sum of weights; weights of null values count unless ``skip_null``."""
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w) if skip_null else w))


def circular_mean(degrees: Column, w: Column | None = None) -> Column:
    """Mean direction in degrees, (-180, 180]."""
    w = F.lit(1.0) if w is None else w
    return F.degrees(F.atan2(F.sum(F.sin(F.radians(degrees)) * w), F.sum(F.cos(F.radians(degrees)) * w)))


def odds_ratio(a: Column, b: Column) -> Column:
    """Odds ratio of two conditions; null where a cell is empty."""
    n = lambda x, y: F.sum(F.when(x & y, 1).otherwise(0)).cast("double")
    both, neither, only_a, only_b = n(a, b), n(~a, ~b), n(a, ~b), n(~a, b)
    return F.when(only_a * only_b > 0, both * neither / (only_a * only_b))


def log_odds_halfwidth(a: Column, b: Column) -> Column:
    """Half width of the 95 % interval of the log odds ratio."""
    n = lambda x, y: F.sum(F.when(x & y, 1).otherwise(0)).cast("double")
    cells = [n(a, b), n(a, ~b), n(~a, b), n(~a, ~b)]
    full = cells[0] * cells[1] * cells[2] * cells[3] > 0
    return F.when(full, 1.96 * F.sqrt(sum((1 / F.when(c > 0, c) for c in cells), F.lit(0.0))))


def slowness(overlap: Column, distance: Column, seconds: float) -> Column:
    """Share of overlap per metre and second of movement."""
    return overlap / distance * seconds


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def round_to(x: Column, factor: float) -> Column:
    """To the nearest multiple of 1/factor."""
    return F.round(x * factor) / factor


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by Abramowitz and Stegun 26.2.17 (error under 7.5e-8)."""
    # fixed values of the approximation
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    upper = poly * F.exp(-z * z / 2) / F.lit(2.5066282746310002)
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").when(month.isin(9, 10, 11), "SON")
