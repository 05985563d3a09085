"""Composites with significance, trends, label draws and prediction studies: operators joined to the questions asked of them."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratus.functions.sphere import RADIUS

from .graph import cut_lineage, numbered
from .joins import complete_index
from .learn import predict, scores, shuffled
from .select import quantile_exceed
from .sequence import get_spells, rolling
from .stats import block_trend_pvalues, bootstrap_times, fdr, rank_pvalue, student_p, welch_t


def spells_from_categories(slow: DataFrame, keys: list[str], order: str, value: str, window: int, q: float, min_len: int, n: int | None = None) -> DataFrame:
    """Spells of a category's slowness: completed steps, mean over ``window`` steps, runs over its q-quantile, and of these
    the ``n`` with the largest sum of slowness, or all."""
    full = complete_index(slow.select(*keys, order, value), keys, order)
    hot = quantile_exceed(rolling(full, {"mean": F.avg(value)}, keys, order, window - 1, 0), "mean", q, keys)
    spells = get_spells(hot, F.col("exceeds"), keys, order, 0, min_len).drop("exceeds")
    if n is None:
        return spells
    total = spells.groupBy(*keys, "spell").agg(F.sum(value).alias("__t"))
    best = total.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__t"), "spell"))).where(F.col("__r") <= n)
    return spells.join(best.select(*keys, "spell"), [*keys, "spell"], "left_semi")


def linear_categorise(lat: Column, lon: Column, int_low: Column) -> Column:
    """Whether a jet is eddy-driven, by a line through latitude, longitude and the low-level integral (fixed values)."""
    return 200 * lat - 30 * lon + int_low / RADIUS > 9000


def doy_trends(df: DataFrame, value: str, keys: list[str], day: str, year: str, win: int, block: int, n: int) -> DataFrame:
    """By day of year the slope over the years of a trailing mean of ``win`` days, and its block-bootstrap p-value."""
    smooth = rolling(df, {"__m": F.avg(value)}, [*keys, year], day, win - 1, 0)
    return block_trend_pvalues(smooth, "__m", year, [*keys, day], block, n)


def quantile_significance(df: DataFrame, by: str, n_bins: int, value: str, keys: list[str], order: str, n: int, seed: int = 0) -> DataFrame:
    """Means of a value in equal-count bins of another, and the share of ``n`` random draws of as many rows with a smaller mean."""
    edges = df.groupBy(*keys).agg(F.percentile(by, F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])).alias("__e"), F.count("*").alias("__n"))
    rows = df.join(edges, keys).withColumn("bin", F.aggregate("__e", F.lit(0).cast("bigint"), lambda acc, e: acc + (F.col(by) > e).cast("bigint")))
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    seen = rows.groupBy(*keys, "bin").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    draws = rows.select(*keys, "bin", "__n", F.col("__i").alias("__o"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__s"))
    draws = draws.select(*keys, "bin", "__s", F.pmod(F.xxhash64(F.lit(seed), "__s", "__o", *keys), F.col("__n")).alias("__i"))
    means = draws.join(rows.select(*keys, "__i", F.col(value).alias("__v")), [*keys, "__i"]).groupBy(*keys, "bin", "__s").agg(F.avg("__v").alias("__m"))
    under = F.avg(F.when(F.col("__m") < F.col("mean"), 1.0).when(F.col("__m") == F.col("mean"), 0.5).otherwise(0.0)).alias("p")
    return means.join(seen, [*keys, "bin"]).groupBy(*keys, "bin", "mean", "n").agg(under)


def composite_significance(table: DataFrame, spells: DataFrame, cell: list[str], order: str, value: str, n: int, q: float | None = None) -> DataFrame:
    """By cell the mean of a value at the steps of spells, its two-sided rank among ``n`` bootstraps of the spells' times, and
    with ``q`` whether it passes that false discovery rate."""
    drawn = bootstrap_times(spells, table.select(order).distinct(), order, n)
    times = drawn.groupBy("sample_index", order).agg(F.count("*").alias("__c"))
    means = times.join(table, order).groupBy("sample_index", *cell).agg((F.sum(F.col(value) * F.col("__c")) / F.sum("__c")).alias("__m"))
    seen = means.where(F.col("sample_index") == n).select(*cell, F.col("__m").alias("mean"))
    out = seen.join(rank_pvalue(means, "__m", "sample_index", n, cell), cell)
    return out if q is None else fdr(out, "p_two_sided", q, cell)


def run_welch(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Difference of two runs' means by key, Welch's t and its two-sided p-value."""
    stats = lambda x, k: x.groupBy(*keys).agg(F.avg(value).alias(f"m{k}"), F.stddev_samp(value).alias(f"s{k}"), F.count(value).alias(f"n{k}"))
    j = stats(a, 1).join(stats(b, 2), keys)
    t, free = welch_t(*[F.col(c) for c in ("m1", "s1", "n1", "m2", "s2", "n2")])
    return j.select(*keys, (F.col("m1") - F.col("m2")).alias("diff"), t.alias("t"), free.alias("free")).withColumn("p", student_p("t", "free"))


def draw_distribution(labels: DataFrame, group: list[str], label: str, subset: Column, n: int, seed: int = 0) -> DataFrame:
    """By label the mean count in the chosen groups, that in ``n`` draws of as many groups, and Welch's t between them."""
    counts = labels.groupBy(*group, label).agg(F.count("*").alias("k"), F.max(subset.cast("int")).alias("__in"))
    groups = numbered(labels.groupBy(*group).agg(F.max(subset.cast("int")).alias("__in")), group, "__g")
    values = labels.select(label).distinct()
    full = groups.crossJoin(values).join(counts.drop("__in"), [*group, label], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    size = groups.agg(F.count("*").alias("__all"), F.sum("__in").alias("__m"))
    draws = labels.sparkSession.range(n).crossJoin(F.broadcast(size)).select("id", "__all", F.explode(F.sequence(F.lit(1), F.col("__m"))).alias("__d"))
    drawn = draws.select("id", (F.pmod(F.xxhash64(F.lit(seed), "id", "__d"), F.col("__all")) + 1).alias("__g")).join(full, "__g")
    chosen = full.where("__in = 1")
    return run_welch(chosen, drawn, [label], "k")


def trend_baseline(df: DataFrame, keys: list[str], order: str, target: str, rounds: int = 8, ridge: float = 1e-3) -> DataFrame:
    """``df`` with ``prob``, a logistic regression of a 0/1 target on time for each key, by Newton's method: each round is
    one aggregate over all keys at once."""
    t0 = df.groupBy(*keys).agg(F.avg(order).alias("__t0"), F.stddev_pop(order).alias("__td"), F.lit(0.0).alias("__a"), F.lit(0.0).alias("__b"))
    rows = df.withColumn("__y", F.col(target).cast("double"))
    prob = 1 / (1 + F.exp(-(F.col("__a") + F.col("__b") * F.col("__t"))))
    at = lambda p: rows.join(p, keys).withColumn("__t", (F.col(order) - F.col("__t0")) / F.when(F.col("__td") > 0, F.col("__td")).otherwise(1.0)).withColumn("__p", prob)
    for _ in range(rounds):
        w, e, t = F.col("__p") * (1 - F.col("__p")), F.col("__y") - F.col("__p"), F.col("__t")
        sums = at(t0).groupBy(*keys, "__t0", "__td", "__a", "__b").agg((F.sum(w) + ridge).alias("w0"), F.sum(w * t).alias("w1"), (F.sum(w * t * t) + ridge).alias("w2"), F.sum(e).alias("g0"), F.sum(e * t).alias("g1"))
        g0, g1, det = F.col("g0") - ridge * F.col("__a"), F.col("g1") - ridge * F.col("__b"), F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1")
        t0 = cut_lineage(sums.select(*keys, "__t0", "__td", (F.col("__a") + (F.col("w2") * g0 - F.col("w1") * g1) / det).alias("__a"), (F.col("__b") + (F.col("w0") * g1 - F.col("w1") * g0) / det).alias("__b")))
    return at(t0).select(*df.columns, F.col("__p").alias("prob"))


def importances(df: DataFrame, features: list[str], target: str, order: str, fold: Column, seed: int = 0) -> DataFrame:
    """By feature: correlation with the target, its coefficient in a logistic model of the other folds, and the AUC of fold 0
    lost when the feature is shuffled there."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumns({"__f": fold, "__y": F.col(target).cast("double")})
    pack = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
    model = LogisticRegression(regParam=0.01, featuresCol="__x", labelCol="__y").fit(pack.transform(rows.where("__f <> 0")))
    test = cut_lineage(rows.where("__f = 0"))
    auc = lambda x: scores(model.transform(pack.transform(x)).withColumn("prob", vector_to_array("probability")[1]), F.col("__y") == 1, "prob")
    whole = auc(test).select(F.col("auc").alias("__whole"))
    lost = [auc(shuffled(test, c, order, seed)).select(F.lit(c).alias("feature"), F.lit(float(model.coefficients[i])).alias("coefficient"), "auc") for i, c in enumerate(features)]
    corr = rows.agg(*[F.corr(c, "__y").alias(c) for c in features]).unpivot([], features, "feature", "corr")
    out = reduce(DataFrame.unionByName, lost).crossJoin(F.broadcast(whole)).join(corr, "feature")
    return out.select("feature", "corr", "coefficient", (F.col("__whole") - F.col("auc")).alias("permutation"))


def leave_one_out(df: DataFrame, features: list[str], target: str, fold: Column, n: int) -> DataFrame:
    """By feature 1 - (1 - AUC with all) / (1 - AUC without it); a small job for each of the few features."""
    auc = lambda f: scores(predict(df, f, target, fold, n), F.col(target) == 1, "prob").select("auc")
    whole = auc(features).select(F.col("auc").alias("__all"))
    without = [auc([x for x in features if x != c]).withColumn("feature", F.lit(c)) for c in features]
    return reduce(DataFrame.unionByName, without).crossJoin(F.broadcast(whole)).select("feature", (1 - F.try_divide(1 - F.col("__all"), 1 - F.col("auc"))).alias("importance"))


def tercile_combinations(df: DataFrame, features: list[str], target: str, fold: Column, n: int, size: int = 3) -> DataFrame:
    """AUC of the logistic model of every ``size`` features in one-hot terciles."""
    cuts = df.agg(*[F.percentile(c, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias(f"__{c}") for c in features])
    hot = df.crossJoin(F.broadcast(cuts)).withColumns({f"{c}_low": (F.col(c) <= F.col(f"__{c}")[0]).cast("double") for c in features} | {f"{c}_high": (F.col(c) > F.col(f"__{c}")[1]).cast("double") for c in features})
    out = [scores(predict(hot, [f"{c}_{k}" for c in some for k in ("low", "high")], target, fold, n), F.col(target) == 1, "prob").select(F.lit(",".join(some)).alias("features"), "auc") for some in combinations(features, size)]
    return reduce(DataFrame.unionByName, out)
