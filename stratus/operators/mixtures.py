"""Gaussian mixtures of many periods at once: every round of expectation and maximisation is one aggregate of sufficient
statistics by period and component. Only parameters come to the driver, a row a period."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .graph import cut_lineage

#: Added to variances, as usual for mixtures.
LEAST_VARIANCE = 1e-6


def _parameters(spark, period: str, kind: str, fits: dict) -> DataFrame:
    """A row a period, from literals: for each component its mean, precision, constant of the log density."""
    rows = []
    for p, (weights, means, covs) in fits.items():
        row = {period: F.lit(p).cast(kind)}
        for k, (w, m, c) in enumerate(zip(weights, means, covs)):
            inverse = np.linalg.inv(c)
            row |= {f"m{k}_{i}": F.lit(float(v)) for i, v in enumerate(m)}
            row |= {f"p{k}_{i}_{j}": F.lit(float(inverse[i, j])) for i in range(len(m)) for j in range(i + 1)}
            row[f"c{k}"] = F.lit(float(math.log(max(w, 1e-300)) - 0.5 * np.linalg.slogdet(2 * math.pi * c)[1]))
        rows.append(F.struct(*[v.alias(n) for n, v in row.items()]))
    return spark.range(1).select(F.inline(F.array(*rows)))


def _quad(k: int, d: int) -> Column:
    """Squared Mahalanobis distance from component k."""
    x = [F.col(f"x{i}") - F.col(f"m{k}_{i}") for i in range(d)]
    total = sum((x[i] * x[j] * F.col(f"p{k}_{i}_{j}") * (1.0 if i == j else 2.0) for i in range(d) for j in range(i + 1)), F.lit(0.0))
    return F.when(total < 0, 0.0).otherwise(total)  # rounding; null stays null


def _shares(n: int, d: int) -> tuple[list[Column], Column]:
    """Responsibilities and log density of a row."""
    logs = [F.col(f"c{k}") - 0.5 * _quad(k, d) for k in range(n)]
    top = F.greatest(*logs) if n > 1 else logs[0]
    total = sum((F.exp(x - top) for x in logs), F.lit(0.0))
    return [F.exp(x - top) / total for x in logs], top + F.log(total)


def _statistics(rows: DataFrame, period: str, shares: list[Column], density: Column, d: int) -> dict:
    """By period the weights, means and covariances that follow from responsibilities, and the mean log density."""
    sums = [f.alias(a) for k, r in enumerate(shares) for f, a in [(F.sum(r), f"n{k}"), *[(F.sum(r * F.col(f"x{i}")), f"s{k}_{i}") for i in range(d)], *[(F.sum(r * F.col(f"x{i}") * F.col(f"x{j}")), f"q{k}_{i}_{j}") for i in range(d) for j in range(i + 1)]]]
    out = {}
    for r in rows.groupBy(period).agg(F.count("*").alias("n"), F.avg(density).alias("density"), *sums).collect():  # a row a period
        weights, means, covs = [], [], []
        for k in range(len(shares)):
            size = max(r[f"n{k}"], 1e-9)
            m = np.array([r[f"s{k}_{i}"] / size for i in range(d)])
            c = np.zeros((d, d))
            for i in range(d):
                for j in range(i + 1):
                    c[i, j] = c[j, i] = r[f"q{k}_{i}_{j}"] / size - m[i] * m[j]
            weights.append(r[f"n{k}"] / r["n"])
            means.append(m)
            covs.append(c + LEAST_VARIANCE * np.eye(d))
        out[r[period]] = (np.array(weights), np.array(means), np.array(covs)), r["density"]
    return out


def fit(df: DataFrame, features: list[str], period: str, n: int = 2, by: int = 0, sweeps: int = 2, rounds: int = 20, tolerance: float = 1e-5) -> dict:
    """By period (weights, means, covariances) of ``n`` normal distributions of full covariance over the features.

    The first sweep starts each period from as many bins of feature number ``by``; in later ones a period starts from the
    means of the period before it, so that components keep their places from period to period. A sweep ends after
    ``rounds``, or when no period's mean log density moves by ``tolerance``. Rows with a null feature or period are left
    out, and periods without rows are not in the result.
    """
    kind, d = dict(df.dtypes)[period], len(features)
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(cast(`{c}` AS double))" for c in features) + f" AND `{period}` IS NOT NULL")
    rows = whole.select(period, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    middle = rows.groupBy(period).agg(*[F.avg(f"x{i}").alias(f"a{i}") for i in range(d)])
    rows = cut_lineage(rows.join(F.broadcast(middle), period).select(period, *[(F.col(f"x{i}") - F.col(f"a{i}")).alias(f"x{i}") for i in range(d)]))  # a row a period
    cuts = rows.groupBy(period).agg(F.percentile_approx(f"x{by}", [k / n for k in range(1, n)] or [0.5], 1000).alias("cuts"))
    binned = rows.join(F.broadcast(cuts), period)
    bin_ = F.aggregate("cuts", F.lit(0), lambda acc, c: acc + (F.col(f"x{by}") > c).cast("int")) if n > 1 else F.lit(0)
    found = _statistics(binned, period, [(bin_ == k).cast("double") for k in range(n)], F.lit(0.0), d)
    fits = {p: f for p, (f, _) in sorted(found.items())}
    centre = {r[period]: np.array([r[f"a{i}"] for i in range(d)]) for r in middle.collect()}
    shares, density = _shares(n, d)
    for sweep in range(sweeps if fits else 0):
        if sweep:
            before, own = list(fits), fits
            all_ = {p: np.average(f[2], axis=0, weights=f[0]) + np.einsum("k,ki,kj->ij", f[0], f[1], f[1]) for p, f in own.items()}
            fits = {p: (np.full(n, 1 / n), own[q][1] + centre[q] - centre[p], np.repeat(all_[p][None], n, 0)) if q is not None else own[p] for p, q in zip(before, [None, *before])}
        last = {}
        for _ in range(rounds):
            table = _parameters(df.sparkSession, period, kind, fits)
            found = _statistics(rows.join(F.broadcast(table), period), period, shares, density, d)  # a row a period
            fits = {p: f for p, (f, _) in sorted(found.items())}
            moved = max(abs(v - last.get(p, math.inf)) for p, (_, v) in found.items())
            last = {p: v for p, (_, v) in found.items()}
            if moved < tolerance:
                break
    return {p: (w, m + centre[p], c) for p, (w, m, c) in fits.items()}


def categorise(df: DataFrame, features: list[str], period: str, fits: dict, by: int = 0, highest: bool = True, mode: str = "score", name: str = "is_polar") -> DataFrame:
    """``df`` with ``name``: how far a row belongs to other components than the subtropical one, whose mean of feature ``by`` is
    the highest (or with ``highest=False`` the lowest).

    ``probability``: the others' responsibility. ``score``: with Mahalanobis distances, 1 / (1 + sum of the others' distances
    / distance from the subtropical one). Null where a feature is null or the period has no fit.
    """
    if not fits:
        return df.withColumn(name, F.lit(None).cast("double"))
    d, n = len(features), len(next(iter(fits.values()))[0])
    ordered = {}
    for p, (w, m, c) in fits.items():  # the subtropical component comes first
        order = np.argsort(m[:, by])[:: -1 if highest else 1]
        ordered[p] = (w[order], m[order], c[order])
    table = _parameters(df.sparkSession, period, dict(df.dtypes)[period], ordered)
    added = [c for c in table.columns if c != period]
    rows = df.withColumns({f"x{i}": F.col(c).cast("double") for i, c in enumerate(features)}).join(F.broadcast(table), period, "left")  # a row a period
    if mode == "probability":
        value = 1 - _shares(n, d)[0][0]
    else:
        far = [F.sqrt(_quad(k, d)) for k in range(n)]
        value = F.coalesce(F.try_divide(far[0], sum(far[1:], far[0])), F.when(far[0].isNotNull(), 0.5))
    return rows.withColumn(name, F.nanvl(value, F.lit(None).cast("double"))).drop(*added, *[f"x{i}" for i in range(d)])
