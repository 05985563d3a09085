"""Components, clusters, maps, targets, predictors and scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import numbered
from .sequence import get_spells, lags, timescales


def feature_vectors(field: DataFrame, sample: list[str], cell: list[str], value: str, lat: str | None = "lat") -> DataFrame:
    """One vector a sample, cells in order, weighted by the root of the cosine of latitude."""
    weight = F.sqrt(F.cos(F.radians(F.col(lat)))) if lat else F.lit(1.0)
    seq = F.array_sort(F.collect_list(F.struct(*cell, (F.col(value) * weight).alias("v"))))
    return field.groupBy(*sample).agg(array_to_vector(F.transform(seq, lambda p: p.v)).alias("features"))


def pca(df: DataFrame, k: int, features: str = "features"):
    """(scores, model, centring model): leading components of centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler

    scaler = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="__c").fit(df)
    centred = scaler.transform(df)
    model = PCA(k=k, inputCol="__c", outputCol="scores").fit(centred)
    return model.transform(centred).drop("__c"), model, scaler


def pca_inverse(scores: DataFrame, model, scaler) -> DataFrame:
    back, mean = model.pc.toArray(), scaler.mean.toArray()
    terms = [sum((F.col("__s")[j] * float(back[i, j]) for j in range(back.shape[1])), F.lit(float(mean[i]))) for i in range(back.shape[0])]
    return scores.withColumn("__s", vector_to_array("scores")).withColumn("restored", F.array(*terms)).drop("__s")


def kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 0) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, featuresCol=features, predictionCol="label", seed=seed).fit(df).transform(df)


def nearest_node(vec: Column, codebook: np.ndarray) -> Column:
    """struct(d2, node): nearest row of a small codebook; it travels as literals."""
    parts = [F.struct(F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(v)) for v in row]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d2"), F.lit(i).alias("node")) for i, row in enumerate(codebook)]
    return F.array_min(F.array(*parts))


def som(df: DataFrame, vector: str, nx: int, ny: int, epochs: int = 6, sigma: float | None = None, seed: int = 0) -> np.ndarray:
    """Codebook of a batch self-organising map on a hexagonal sheet: each epoch is one aggregate by best node.

    Only node sums come to the driver, nx * ny of them.
    """
    dim = df.select(F.size(vector)).first()[0]
    stats = df.select(*[F.col(vector)[i].alias(f"v{i}") for i in range(dim)]).agg(*[f(f"v{i}").alias(f"{k}{i}") for i in range(dim) for f, k in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    mean, sd = np.array([stats[f"m{i}"] for i in range(dim)]), np.array([stats[f"s{i}"] for i in range(dim)])
    code = mean + sd * np.random.default_rng(seed).standard_normal((nx * ny, dim)) * 0.5
    at = np.array([(i % nx + 0.5 * (i // nx % 2), (i // nx) * np.sqrt(0.75)) for i in range(nx * ny)])
    gap = ((at[:, None] - at[None]) ** 2).sum(2)
    width = sigma or max(nx, ny) / 2
    for e in range(epochs):
        hit = df.select(nearest_node(F.col(vector), code).node.alias("node"), *[F.col(vector)[i].alias(f"v{i}") for i in range(dim)])
        sums = hit.groupBy("node").agg(F.count("*").alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(dim)]).collect()
        total, n = np.zeros_like(code), np.zeros(len(code))
        for r in sums:
            total[r.node], n[r.node] = [r[f"v{i}"] for i in range(dim)], r.n
        h = np.exp(-gap / (2 * max(0.3, width * (1 - e / epochs)) ** 2))
        code = (h @ total) / np.maximum(h @ n, 1e-9)[:, None]
    return code


def labels_from_projections(df: DataFrame, sample: list[str], pattern: str, value: str, cutoff: float = 1.0) -> DataFrame:
    """Pattern with the largest absolute standardised projection, signed; 0 where it is under the cutoff."""
    z = F.col(value) / F.stddev_samp(value).over(Window.partitionBy(pattern))
    best = df.withColumn("__z", z).groupBy(*sample).agg(F.max_by(F.struct(pattern, "__z"), F.struct(F.abs("__z"), -F.col(pattern))).alias("b"))
    return best.select(*sample, F.when(F.abs("b.__z") < cutoff, 0).otherwise(F.signum("b.__z") * (F.col(f"b.{pattern}") + 1)).cast("bigint").alias("label"))


def persistent_patterns(cov: DataFrame, n: int, max_lag: int) -> np.ndarray:
    """Patterns that persist longest: leading vectors of lag-summed against lag-0 covariances of ``n`` components."""
    parts = {(r.a, r.b, r.lag): r["cov"] for r in cov.collect()}  # n * n * lags numbers
    zero = np.array([[parts[i, j, 0] for j in range(n)] for i in range(n)])
    total = sum((np.array([[parts[i, j, k] for j in range(n)] for i in range(n)]) for k in range(1, max_lag + 1)), zero / 2)
    values, vectors = np.linalg.eig(np.linalg.solve(zero, (total + total.T) / 2))
    return vectors[:, np.argsort(-values.real)].real


def cell_jaccard(df: DataFrame, cond: Column, cell: str, order: str) -> DataFrame:
    """Jaccard distance of the times at which pairs of cells (a fixed grid) meet a condition; from counts of shared times."""
    on = df.where(cond).select(cell, order).distinct()
    n = on.groupBy(cell).agg(F.count("*").alias("n"))
    both = on.withColumnRenamed(cell, "a").join(on.withColumnRenamed(cell, "b"), order).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    joined = both.join(n.withColumnsRenamed({cell: "a", "n": "n_a"}), "a").join(n.withColumnsRenamed({cell: "b", "n": "n_b"}), "b")
    return joined.select("a", "b", (1 - F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))).alias("distance"))


def regions(distances: DataFrame, threshold: float) -> DataFrame:
    """Cells that a chain of small distances joins: ``cell``, ``region`` (its smallest cell)."""
    from .graph import connected_components

    return connected_components(distances.where(F.col("distance") <= threshold)).select(F.col("node").alias("cell"), F.col("component").alias("region"))


def make_targets(df: DataFrame, cond: Column, keys: list[str], order: str, hole_size: int, min_len: int) -> DataFrame:
    """Length of the spell at each step, 0 outside of spells."""
    spells = get_spells(df, cond, keys, order, hole_size, min_len).select(*keys, order, F.col("len").alias("target"))
    return df.select(*keys, order).join(spells, [*keys, order], "left").withColumn("target", F.coalesce("target", F.lit(0)).cast("bigint"))


def prepare_predictors(df: DataFrame, cols: list[str], keys: list[str], order: str, periods: list[int], steps: list[int]) -> DataFrame:
    """Trailing means over periods, at lags: keys, order, timescale, lag, columns."""
    return lags(timescales(df, cols, keys, order, periods), cols, [*keys, "timescale"], order, steps)


def fold_of(key: Column, n: int, seed: int = 0) -> Column:
    """Reproducible fold: a hash of the key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n))


def predict(df: DataFrame, features: list[str], target: str, fold: Column, n: int, kind: str = "lr") -> DataFrame:
    """Out-of-fold probabilities ``prob`` of a binary target by logistic regression (lr), forest (rf) or boosting (gbt)."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(df.withColumns({"__f": fold, "__y": F.col(target).cast("double")}))
    make = {"lr": lambda: LogisticRegression(regParam=0.01), "rf": lambda: RandomForestClassifier(numTrees=30, seed=0), "gbt": lambda: GBTClassifier(maxIter=20, seed=0)}[kind]
    out = []
    for k in range(n):
        model = make().setFeaturesCol("__x").setLabelCol("__y").fit(rows.where(F.col("__f") != k))
        out.append(model.transform(rows.where(F.col("__f") == k)).withColumn("prob", vector_to_array("probability")[1]).drop("__x", "__y", "rawPrediction", "probability", "prediction"))
    return reduce(DataFrame.unionByName, out).withColumnRenamed("__f", "fold")


def scores(df: DataFrame, target: Column, prob: str, keys: list[str] = ()) -> DataFrame:
    """ROC AUC (by average ranks from counts of distinct scores), F1, balanced accuracy, 1 - Brier."""
    rows = df.withColumn("__y", target.cast("bigint"))
    counts = rows.groupBy(*keys, prob).agg(F.count("*").alias("__c"), F.sum("__y").alias("__p"))
    rank = F.sum("__c").over(Window.partitionBy(*keys).orderBy(prob)) - (F.col("__c") - 1) / 2
    auc = counts.withColumn("__r", rank).groupBy(*keys).agg(F.sum(F.col("__r") * F.col("__p")).alias("__s"), F.sum("__p").alias("__m"), (F.sum("__c") - F.sum("__p")).alias("__n"))
    auc = auc.select(*keys, F.try_divide(F.col("__s") - F.col("__m") * (F.col("__m") + 1) / 2, (F.col("__m") * F.col("__n")).cast("double")).alias("auc"))
    yes, y = F.col(prob) >= 0.5, F.col("__y") == 1
    count = lambda c: F.sum(c.cast("double"))
    tp, fp, fn, tn = count(yes & y), count(yes & ~y), count(~yes & y), count(~yes & ~y)
    rest = rows.groupBy(*keys).agg((2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1.0))).alias("f1"), ((tp / F.greatest(tp + fn, F.lit(1.0)) + tn / F.greatest(tn + fp, F.lit(1.0))) / 2).alias("balanced"), (1 - F.avg(F.pow(F.col(prob) - F.col("__y"), 2.0))).alias("brier"))
    return auc.join(rest, list(keys)) if keys else auc.crossJoin(F.broadcast(rest))


def shuffled(df: DataFrame, col: str, order: str, seed: int) -> DataFrame:
    """``df`` with one column permuted: row numbers by two orders, joined."""
    a = numbered(df, [order], "__i")
    b = numbered(df.select(F.col(col).alias("__v"), F.xxhash64(F.lit(seed), order).alias("__h"), F.col(order).alias("__o")), ["__h", "__o"], "__i")
    return a.join(b.select("__v", "__i"), "__i").withColumn(col, F.col("__v")).drop("__i", "__v")


def forward_select(df: DataFrame, features: list[str], target: str, fold: Column, n_folds: int, most: int) -> list[tuple[list[str], float]]:
    """Greedy sets of predictors by AUC; one small job for each candidate."""
    chosen, out = [], []
    while len(chosen) < most:
        trials = [(scores(predict(df, [*chosen, c], target, fold, n_folds), F.col(target), "prob").first().auc, c) for c in features if c not in chosen]
        best, name = max(trials)
        chosen.append(name)
        out.append((list(chosen), best))
    return out


def regime_index(df: DataFrame, sample: str, pattern: str, value: str, cutoff: float = 1.0, min_stay: int = 1, keys: list[str] = ()) -> DataFrame:
    """Winning pattern of standardised projections, 0 under the cutoff, short stays cleared."""
    from .sequence import run_id

    z = (F.col(value) - F.avg(value).over(Window.partitionBy(pattern))) / F.stddev_samp(value).over(Window.partitionBy(pattern))
    best = df.withColumn("__z", z).groupBy(*keys, sample).agg(F.max_by(F.struct(pattern, "__z"), F.struct("__z", -F.col(pattern))).alias("b"))
    rows = best.select(*keys, sample, F.when(F.col("b.__z") >= cutoff, F.col(f"b.{pattern}") + 1).otherwise(0).cast("bigint").alias("label"))
    stay = F.count("*").over(Window.partitionBy(*keys, "run"))
    return run_id(rows, "label", list(keys), sample).withColumn("label", F.when(stay >= min_stay, F.col("label")).otherwise(0)).drop("run")


def map_quality(df: DataFrame, vector: str, codebook: np.ndarray) -> DataFrame:
    hit = df.select(nearest_node(F.col(vector), codebook).alias("h"))
    return hit.groupBy("h.node").agg(F.avg(F.sqrt("h.d2")).alias("distance"), F.count("*").alias("n"))
