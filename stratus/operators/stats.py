"""Resampling, significance and time-series statistics. Draws are hashes of seeds and ids, so results repeat."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratus.functions.measures import normal_cdf

from .graph import numbered


def bootstrap_times(spells: DataFrame, times: DataFrame, order: str, n: int, seed: int = 0) -> DataFrame:
    """sample_index, spell, inside_index, time: random blocks of each spell's length, and the observed times as sample ``n``.

    The start of a block is a hash of (seed, sample, spell) modulo the places where it fits; rows of the time axis are
    numbered once and met by an equi join.
    """
    axis = times.select(F.col(order)).distinct().withColumn("__i", F.row_number().over(Window.orderBy(order)) - 1)
    size = axis.agg(F.count("*").alias("__all"))
    lens = spells.groupBy("spell").agg(F.count("*").alias("len"))
    draws = lens.crossJoin(F.broadcast(size)).withColumn("sample_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    start = F.pmod(F.xxhash64(F.lit(seed), "sample_index", "spell"), F.greatest(F.col("__all") - F.col("len"), F.lit(1)))
    rows = draws.select("sample_index", "spell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1)).alias("inside_index"), start.alias("__a"))
    drawn = rows.withColumn("__i", F.col("__a") + F.col("inside_index")).join(axis, "__i").select("sample_index", "spell", "inside_index", order)
    seen = spells.select(F.lit(n).cast("bigint").alias("sample_index"), "spell", (F.row_number().over(Window.partitionBy("spell").orderBy(order)) - 1).cast("bigint").alias("inside_index"), order)
    return drawn.unionByName(seen)


def rank_pvalue(df: DataFrame, value: str, sample: str, observed: int, keys: list[str]) -> DataFrame:
    """(rank of the observed sample - 1) / n with average ranks, and two-sided."""
    seen = df.where(F.col(sample) == observed).select(*keys, F.col(value).alias("__x"))
    joined = (df.join(seen, keys) if keys else df.crossJoin(F.broadcast(seen))).where(F.col(sample) != observed)
    under = F.sum((F.col(value) < F.col("__x")).cast("double")) + F.sum((F.col(value) == F.col("__x")).cast("double")) / 2
    p = joined.groupBy(*keys).agg((under / F.count("*")).alias("p"))
    return p.withColumn("p_two_sided", 2 * F.least(F.col("p"), 1 - F.col("p")))


def linear_trend(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """Slope, its t statistic, and a two-sided p-value of Student's t."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("__r2"), F.regr_count(y, x).alias("n"))
    t = F.sqrt(F.col("__r2") * (F.col("n") - 2) / F.when(F.col("__r2") < 1, 1 - F.col("__r2"))) * F.signum("slope")
    return fit.withColumn("t", t).withColumn("p", student_p("t", (F.col("n") - 2).cast("double"))).drop("__r2")


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 200):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
    return h


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    x = df / (df + t * t)
    a, b = df / 2, np.full_like(df, 0.5)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(np.clip(x, 1e-300, 1)) + b * np.log(np.clip(1 - x, 1e-300, 1)))
    low = x < (a + 1) / (a + b + 2)
    return np.where(low, front * _betacf(a, b, x) / a, 1 - front * _betacf(b, a, 1 - x) / b)


def _two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = student_two_sided(t[ok].to_numpy(float), df[ok].to_numpy(float))
    return out.where(ok, None)


def student_p(t: Column | str, df: Column | str) -> Column:
    """Two-sided p-value of Student's t; null where t is."""
    return F.pandas_udf(_two_sided, "double")(t, df)


def block_trend_pvalues(df: DataFrame, y: str, x: str, keys: list[str], block: int, n: int, seed: int = 0) -> DataFrame:
    """Observed slope and the share of block-bootstrapped slopes under it."""
    rows = df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(x)) - 1)
    size = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    draws = size.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("__n") / block) - 1)))
    start = F.pmod(F.xxhash64(F.lit(seed), "s", "b", *keys), F.greatest(F.col("__n") - block + 1, F.lit(1)))
    places = draws.select(*keys, "s", "b", "__n", start.alias("a"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o"))
    places = places.withColumn("__at", F.col("b") * block + F.col("o")).where(F.col("__at") < F.col("__n")).withColumn("__i", F.col("a") + F.col("o"))
    drawn = places.join(rows.select(*keys, "__i", y), [*keys, "__i"]).groupBy(*keys, "s").agg(F.regr_slope(y, "__at").alias("slope"))
    seen = rows.groupBy(*keys).agg(F.regr_slope(F.col(y), F.col("__i")).alias("__seen"))
    joined = drawn.join(seen, keys) if keys else drawn.crossJoin(F.broadcast(seen))
    under = F.avg((F.col("slope") < F.col("__seen")).cast("double")).alias("p")
    return joined.groupBy(*keys, "__seen").agg(under).withColumnRenamed("__seen", "slope")


def field_significance(sample: DataFrame, pool: DataFrame, cell: list[str], order: str, value: str, n: int, seed: int = 0) -> DataFrame:
    """By cell: mean of the sample's steps, and its normal p-value against means of as many steps drawn from the pool."""
    size = sample.select(order).distinct().count()  # a number of steps
    axis = pool.select(order).distinct().withColumn("__i", F.row_number().over(Window.orderBy(order)) - 1)
    total = axis.agg(F.count("*").alias("__all"))
    draws = sample.sparkSession.range(n * size).select((F.col("id") / size).cast("bigint").alias("__s"), "id").crossJoin(F.broadcast(total)).select("__s", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("__all")).alias("__i"))
    times = draws.join(axis, "__i").groupBy("__s", order).count()
    means = times.join(pool, order).groupBy("__s", *cell).agg((F.sum(F.col(value) * F.col("count")) / F.sum("count")).alias("m"))
    spread = means.groupBy(*cell).agg(F.avg("m").alias("mu"), F.stddev_samp("m").alias("sd"))
    seen = sample.groupBy(*cell).agg(F.avg(value).alias("mean"))
    return seen.join(spread, cell).withColumn("p", normal_cdf((F.col("mean") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")))).drop("mu", "sd")


def fdr(df: DataFrame, p: str, q: float, cell: list[str], method: str = "pointwise") -> DataFrame:
    """Significance under a false discovery rate: element-wise p_(i) <= q i / (n - 1) from i = 0, or step-up ("bh")."""
    ranked = numbered(df.where(F.col(p).isNotNull()), [p, *cell], "__i")
    total = ranked.agg(F.count("*").alias("__n"))
    j = ranked.crossJoin(F.broadcast(total))
    if method == "pointwise":
        return j.withColumn("significant", F.col(p) <= q * (F.col("__i") - 1) / F.greatest(F.col("__n") - 1, F.lit(1))).drop("__i", "__n")
    last = j.where(F.col(p) <= q * F.col("__i") / F.col("__n")).agg(F.coalesce(F.max("__i"), F.lit(0)).alias("__k"))
    return j.crossJoin(F.broadcast(last)).withColumn("significant", F.col("__i") <= F.col("__k")).drop("__i", "__n", "__k")


def welch_t(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> tuple[Column, Column]:
    """(t, degrees of freedom) of two samples given their means, deviations and sizes."""
    a, b = s1 * s1 / n1, s2 * s2 / n2
    return (m1 - m2) / F.sqrt(a + b), (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))


def ks_two_sample(df: DataFrame, value: str, group: str, first, second, keys: list[str] = ()) -> DataFrame:
    """Greatest gap of two empirical distributions and its asymptotic p-value; ties by value."""
    counts = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum((F.col(group) == first).cast("double")).alias("a"), F.sum((F.col(group) == second).cast("double")).alias("b"))
    run, whole = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    gap = F.abs(F.sum("a").over(run) / F.sum("a").over(whole) - F.sum("b").over(run) / F.sum("b").over(whole))
    out = counts.withColumns({"__g": gap, "__m": F.sum("a").over(whole), "__n": F.sum("b").over(whole)}).groupBy(*keys).agg(F.max("__g").alias("d"), F.first("__m").alias("m"), F.first("__n").alias("n"))
    lam = F.sqrt(F.col("m") * F.col("n") / (F.col("m") + F.col("n"))) * F.col("d")
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 21)), F.lit(0.0))
    return out.withColumn("p", F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))).select(*keys, "d", "p")


def mean_ci(df: DataFrame, keys: list[str], value: str, z: float = 1.959963984540054) -> DataFrame:
    half = z * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def var_ci(df: DataFrame, keys: list[str], value: str, z: float = 1.959963984540054) -> DataFrame:
    """Asymptotic interval of the variance, clipped at 0."""
    half = z * F.var_samp(value) * F.sqrt(F.lit(2.0) / (F.count(value) - 1))
    return df.groupBy(*keys).agg(F.var_samp(value).alias("var"), F.greatest(F.lit(0.0), F.var_samp(value) - half).alias("low"), (F.var_samp(value) + half).alias("high"))


def relative_time_composite(rows: DataFrame, keys: list[str], value: str, least_spells: int) -> DataFrame:
    """Mean and interval by relative index, where at least so many spells are alive."""
    alive = rows.groupBy(*keys, "relative_index").agg(F.countDistinct("spell").alias("spells"))
    return mean_ci(rows, [*keys, "relative_index"], value).join(alive.where(F.col("spells") >= least_spells), [*keys, "relative_index"])


def autocorrelation(df: DataFrame, value: str, keys: list[str], order: str, max_lag: int) -> DataFrame:
    """Pearson correlation with the value ``lag`` rows earlier."""
    w = Window.partitionBy(*keys).orderBy(order)
    late = df.withColumns({f"__{k}": F.lag(value, k).over(w) for k in range(max_lag + 1)})
    pairs = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.col(f"__{k}").alias("x")) for k in range(max_lag + 1)]))
    return late.select(*keys, value, pairs.alias("p")).groupBy(*keys, F.col("p.lag").alias("lag")).agg(F.corr(F.col(value), F.col("p.x")).alias("rho"))


def lagged_covariance(df: DataFrame, series: str, order: str, value: str, max_lag: int) -> DataFrame:
    """Sample covariances of all pairs of series at lags 0 to ``max_lag``; the lags are a literal, so the join is an equi join."""
    late = df.select(F.col(series).alias("b"), F.col(order).alias("__o"), F.col(value).alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max_lag).cast("bigint"))).alias("lag"))
    late = late.select("b", "y", "lag", (F.col("__o") - F.col("lag")).alias(order))
    return df.select(F.col(series).alias("a"), order, F.col(value).alias("x")).join(late, order).groupBy("a", "b", "lag").agg(F.covar_samp("x", "y").alias("cov"))


def hurst(df: DataFrame, value: str, keys: list[str], order: str, powers: list[int]) -> DataFrame:
    """Slope of log mean rescaled range on log chunk length, over 2**k chunks."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)}).withColumn("k", F.explode(F.array(*[F.lit(k) for k in powers])))
    size = F.floor(F.col("__n") / F.pow(F.lit(2.0), F.col("k")))
    rows = rows.withColumn("size", size).withColumn("chunk", F.floor(F.col("__i") / F.col("size"))).where(F.col("chunk") < F.pow(F.lit(2.0), F.col("k")))
    part = Window.partitionBy(*keys, "k", "chunk")
    rows = rows.withColumn("__d", F.col(value) - F.avg(value).over(part)).withColumn("__c", F.sum("__d").over(part.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)))
    rs = rows.groupBy(*keys, "k", "chunk").agg(((F.max("__c") - F.min("__c")) / F.when(F.stddev_pop(value) > 0, F.stddev_pop(value))).alias("rs"), F.first("size").alias("size"))
    means = rs.groupBy(*keys, "k").agg(F.avg("rs").alias("rs"), F.first("size").alias("size"))
    return means.groupBy(*keys).agg(F.regr_slope(F.log("rs"), F.log("size")).alias("hurst"))


def ecdf(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Distinct values with their cumulative share; counted before the window, so ties cost nothing."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    run, whole = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    return counts.withColumn("cdf", F.sum("__c").over(run) / F.sum("__c").over(whole)).drop("__c")


def search_sorted(a: DataFrame, x: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each row of ``x`` the number of values of ``a`` under it: a running count over the union."""
    both = a.select(*keys, value, F.lit(0).alias("__q")).unionByName(x.select(*keys, value, F.lit(1).alias("__q")))
    counts = both.groupBy(*keys, value).agg(F.sum(1 - F.col("__q")).alias("__n"), F.sum("__q").alias("__asked"))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("rank", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("bigint")).where("__asked > 0").select(*keys, value, "rank")


def partial_correlation(df: DataFrame, target: str, predictor: str, keys: list[str], order: str, lag: int) -> DataFrame:
    """Correlation of the target with the predictor ``lag`` rows earlier after each one's own autoregression is removed."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumns({"__t1": F.lag(target).over(w), "__p1": F.lag(predictor).over(w)})
    fit = rows.groupBy(*keys).agg(*[(F.sum(F.col(c) * F.col(f)) / F.sum(F.col(f) * F.col(f))).alias(n) for c, f, n in ((target, "__t1", "__bt"), (predictor, "__p1", "__bp"))])
    joined = rows.join(fit, keys) if keys else rows.crossJoin(F.broadcast(fit))
    rest = joined.withColumns({"__rt": F.col(target) - F.col("__bt") * F.col("__t1"), "__rp": F.col(predictor) - F.col("__bp") * F.col("__p1")})
    return rest.withColumn("__rl", F.lag("__rp", lag).over(w)).groupBy(*keys).agg(F.corr("__rt", "__rl").alias("r"))


def crps(obs: DataFrame, ensemble: DataFrame, keys: list[str], value: str, threshold: float | None = None) -> DataFrame:
    """Ensemble CRPS by the sorted form, with values clipped at a threshold first if one is given."""
    clip = (lambda c: F.greatest(c, F.lit(threshold))) if threshold is not None else (lambda c: c)
    ens = ensemble.select(*keys, clip(F.col(value)).alias("__x"))
    w = Window.partitionBy(*keys)
    ens = ens.withColumns({"__i": F.row_number().over(w.orderBy("__x")), "__m": F.count("*").over(w)})
    joined = ens.join(obs.select(*keys, clip(F.col(value)).alias("__y")), keys)
    spread = F.sum((2 * F.col("__i") - F.col("__m") - 1) * F.col("__x")) / F.pow(F.first("__m"), F.lit(2.0))
    return joined.groupBy(*keys).agg((F.avg(F.abs(F.col("__x") - F.col("__y"))) - spread).alias("crps"))


def mann_whitney(df: DataFrame, value: str, group: str, first, keys: list[str]) -> DataFrame:
    """U of the first group, its normal approximation and two-sided p-value, by average ranks from counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"), F.sum((F.col(group) == first).cast("bigint")).alias("__a"))
    run = Window.partitionBy(*keys).orderBy(value)
    rank = F.sum("__c").over(run) - (F.col("__c") - 1) / 2
    sums = counts.withColumn("__r", rank).groupBy(*keys).agg(F.sum(F.col("__r") * F.col("__a")).alias("r"), F.sum("__a").alias("m"), (F.sum("__c") - F.sum("__a")).alias("n"))
    u = F.col("r") - F.col("m") * (F.col("m") + 1) / 2
    both = F.col("m") * F.col("n")
    z = (u - both / 2) / F.sqrt(F.when(both > 0, both) * (F.col("m") + F.col("n") + 1) / 12)  # null where a group is empty
    return sums.select(*keys, u.alias("u"), z.alias("z")).withColumn("p", 2 * normal_cdf(-F.abs("z")))


def odds_table(df: DataFrame, a: Column, b: Column, keys: list[str]) -> DataFrame:
    from stratus.functions.measures import log_odds_halfwidth, odds_ratio

    out = df.groupBy(*keys).agg(odds_ratio(a, b).alias("odds_ratio"), log_odds_halfwidth(a, b).alias("__h"))
    return out.withColumn("significant", F.abs(F.log("odds_ratio")) > F.col("__h")).drop("__h")
