"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; on one machine a temporary folder stands in for it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(where or f'file://{tempfile.gettempdir()}').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back."""
    path = shared_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """``df`` with the 1-based place of each row in a total order, without a window over all rows: rows are dealt by ranges,
    numbered within each, and each range adds the rows before it."""
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    ends = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = ends.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rows = parts.withColumn("__place", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return rows.join(base, "__part").withColumn(name, (F.col("__place") + F.col("__base")).cast("bigint")).drop("__part", "__place", "__base")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", cut=cut_lineage) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of ``edges``; integer ids, loops and repeats allowed.

    Alternating large and small stars: each round ties every node to the smallest node among its neighbours, so that
    paths shorten geometrically and no node's neighbours need to meet in memory. Null ends are ignored.
    """
    pairs = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    star = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = cut(small)
        state = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return nodes.join(star, nodes.node == star.u, "left").select("node", F.coalesce("v", "node").alias("component"))
