"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .graph import cut_lineage

#: Bins of a round: one for the least value, one for the greatest, the others in between.
BINS = 256
LARGEST = 1.7976931348623157e308


def exact_quantiles(df: DataFrame, col: str, keys: list[str], at: list[float], cut=cut_lineage) -> DataFrame:
    """keys, q, value: the quantiles ``at`` (0 to 1) of ``col`` in each group, interpolated between neighbours in rank.

    Histograms are refined by rounds: the bin that holds a wanted rank becomes the next round's range, until one value
    fills it. Groups are only counted, with partial sums, so none has to fit into a task; after the first round only
    rows of wanted bins are kept. Null and NaN values do not count, a group without others has no rows, null keys make
    a group. Infinite values are ordered as such; between unequal infinite ones the quantile is NaN.
    """
    if not all(0 <= q <= 1 for q in at):
        raise ValueError("quantiles lie between 0 and 1")
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(key.alias("g"), F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)")
    size = cut(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    asked = size.select("g", "n", "lo", "hi", F.explode(F.array(*[F.lit(float(q)) for q in dict.fromkeys(at)])).alias("q")) if at else size.select("g", "n", "lo", "hi", F.lit(0.0).alias("q")).limit(0)
    asked = asked.withColumn("place", F.col("q") * (F.col("n") - 1)).withColumn("k", F.floor("place"))
    ranks = asked.select("g", "lo", "hi", F.explode(F.array("k", F.least(F.col("k") + 1, F.col("n") - 1))).alias("k")).distinct()
    open_ = cut(ranks.withColumn("before", F.lit(0).cast("bigint")))
    found = open_.where("lo = hi").select("g", "k", F.col("lo").alias("x"))
    open_ = open_.where("lo < hi")
    rows = rows.join(open_.select("g", "lo", "hi").distinct(), "g")
    low, high = F.greatest("lo", F.lit(-LARGEST)), F.least("hi", F.lit(LARGEST))
    # Halves where the range itself has no finite width.
    part = F.when(high - low <= LARGEST, (F.col("v") - low) / (high - low)).otherwise((F.col("v") / 2 - low / 2) / (high / 2 - low / 2))
    bin_ = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), BINS - 1).otherwise(F.least(F.floor(part * (BINS - 2)) + 1, F.lit(BINS - 2))).cast("int")
    until = Window.partitionBy("g", "lo", "hi").orderBy("bin")  # at most BINS rows
    while open_.limit(1).count():
        bins = rows.groupBy("g", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
        bins = bins.withColumn("upto", F.sum("m").over(until))
        to = open_.join(bins, ["g", "lo", "hi"]).withColumn("r", F.col("k") - F.col("before")).where("r < upto and r >= upto - m")
        to = cut(to.select("g", "k", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("before") + F.col("upto") - F.col("m")).alias("before")))
        found = found.unionByName(to.where("lo = hi").select("g", "k", F.col("lo").alias("x")))
        open_ = to.where("lo < hi")
        wanted = open_.select("g", F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
        # Ranges of a group do not overlap, so a row stays once at most.
        rows = cut(rows.select("g", "v", "lo", "hi").join(wanted, "g").where("v >= a and v <= b and a >= lo and b <= hi").select("g", "v", F.col("a").alias("lo"), F.col("b").alias("hi")))
    below = found.withColumnsRenamed({"x": "x0"})
    above = found.withColumnsRenamed({"x": "x1", "k": "k1"})
    out = asked.select("g", "q", "place", "k", F.least(F.col("k") + 1, F.col("n") - 1).alias("k1")).join(below, ["g", "k"]).join(above, ["g", "k1"])
    f = F.col("place") - F.col("k")
    value = F.when((F.col("x0") == F.col("x1")) | (f == 0), F.col("x0")).otherwise(F.col("x0") * (1 - f) + F.col("x1") * f)
    return out.select(*[F.col("g")[k].alias(k) for k in keys], "q", value.alias("value"))
