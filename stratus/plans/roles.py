"""The test tables in the roles of the domain, as DataFrames and as the same SQL.

Times are whole steps: 6-hour steps or days since 1970, months since year 0. Values are rounded where a role averages,
so that both engines start from the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mean(c: str, unit: int, places: int):
    """Mean of a column of whole units, rounded half up by whole numbers so that no engine's order of sums shows."""
    n = F.count(c)
    return F.floor((F.sum(F.round(F.col(c) * unit).cast("bigint")) * 2 * 10**places + n * unit) / (2 * unit * n)) / float(10**places)


def mean_sql(c: str, unit: int, places: int) -> str:
    return f"floor((sum(CAST(round({c} * {unit}) AS BIGINT)) * {2 * 10**places} + count({c}) * {unit})::BIGINT / ({2 * unit} * count({c}))) / {float(10**places)}::DOUBLE"


def _epoch(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, jet, value, n: 6-hourly means by category."""
    e = table(spark, sf_dir, "events").select(F.floor(_epoch("ts") / 21_600_000_000).alias("step"), F.col("event_type").alias("jet"), "value")
    return e.groupBy("step", "jet").agg(mean("value", 100, 4).alias("value"), F.count("*").alias("n"))


SERIES = f"""series AS (SELECT CAST(floor(epoch_us(ts) / 21600000000.0) AS BIGINT) AS step, event_type AS jet, {mean_sql("value", 100, 4)} AS value, count(*) AS n
    FROM events GROUP BY 1, 2)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, step, value: 6-hourly means by member."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("member"), F.floor(_epoch("ts") / 21_600_000_000).alias("step"), "value")
    return e.groupBy("member", "step").agg(mean("value", 100, 4).alias("value"))


MEMBERS = f"""members AS (SELECT user_id % 4 AS member, CAST(floor(epoch_us(ts) / 21600000000.0) AS BIGINT) AS step, {mean_sql("value", 100, 4)} AS value
    FROM events GROUP BY 1, 2)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, year, month, doy, jet, price, qty, disc: daily values by category over several years."""
    x = table(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    x = x.groupBy(F.datediff("d", F.lit("1970-01-01").cast("date")).cast("bigint").alias("day"), F.year("d").cast("bigint").alias("year"), F.month("d").cast("bigint").alias("month"), F.dayofyear("d").cast("bigint").alias("doy"), F.col("l_returnflag").alias("jet"))
    return x.agg(mean("l_extendedprice", 100, 2).alias("price"), F.sum("l_quantity").alias("qty"), mean("l_discount", 100, 4).alias("disc"))


DAILY = f"""daily AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day, year(l_shipdate) AS year, month(l_shipdate) AS month,
    dayofyear(l_shipdate) AS doy, l_returnflag AS jet, {mean_sql("l_extendedprice", 100, 2)} AS price, sum(l_quantity) AS qty, {mean_sql("l_discount", 100, 4)} AS disc
    FROM lineitem GROUP BY 1, 2, 3, 4, 5)"""


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step (month), ilon, ilat, lon, lat, u, v, s: a grid of 36 x 18 nodes."""
    x = table(spark, sf_dir, "lineitem")
    x = x.groupBy((F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("bigint").alias("step"), (F.col("l_partkey") % 36).alias("ilon"), (F.col("l_suppkey") % 18).alias("ilat"))
    x = x.agg(mean("l_quantity", 1, 4).alias("u"), (mean("l_discount", 100, 4) * 100).alias("v"))
    x = x.withColumns({"lon": F.col("ilon") * 10.0 - 180.0, "lat": F.col("ilat") * 10.0 - 85.0})
    return x.withColumn("s", F.round(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")), 4))


FIELD = f"""field0 AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS step, l_partkey % 36 AS ilon, l_suppkey % 18 AS ilat,
    {mean_sql("l_quantity", 1, 4)} AS u, {mean_sql("l_discount", 100, 4)} * 100 AS v FROM lineitem GROUP BY 1, 2, 3),
    field AS (SELECT *, ilon * 10.0 - 180.0 AS lon, ilat * 10.0 - 85.0 AS lat, round(sqrt(u * u + v * v), 4) AS s FROM field0)"""


def paths(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """jet_id, index, lon, lat, s, u, v, is_polar: one path a user; and ``more`` columns of the events."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("index", F.row_number().over(w).cast("bigint") - 1)
    return e.select(
        F.col("user_id").alias("jet_id"), "index", F.round(F.pmod(F.col("value") * 37, F.lit(360.0)) - 180, 4).alias("lon"),
        F.round(F.pmod(F.col("value") * 11, F.lit(120.0)) - 60, 4).alias("lat"), F.round(F.col("value") + 1, 4).alias("s"),
        F.round(F.pmod(F.col("value") * 7, F.lit(20.0)) + 1, 4).alias("u"), F.round(F.pmod(F.col("value") * 3, F.lit(10.0)) - 5, 4).alias("v"),
        F.round(F.pmod(F.col("value"), F.lit(1.0)), 4).alias("is_polar"), *more,
    )


PATHS = """paths AS (SELECT user_id AS jet_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS index, round(fmod(value * 37, 360.0) - 180, 4) AS lon,
    round(fmod(value * 11, 120.0) - 60, 4) AS lat, round(value + 1, 4) AS s, round(fmod(value * 7, 20.0) + 1, 4) AS u, round(fmod(value * 3, 10.0) - 5, 4) AS v,
    round(fmod(value, 1.0), 4) AS is_polar FROM events)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, ord, label: event types as labels in order of time."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    kinds = e.select("event_type").distinct().withColumn("label", F.row_number().over(Window.orderBy("event_type")).cast("bigint") - 1)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.join(F.broadcast(kinds), "event_type").select(F.col("user_id").alias("member"), (F.row_number().over(w).cast("bigint") - 1).alias("ord"), "label", F.col("value"))


LABELS = """labels0 AS (SELECT user_id AS member, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord,
    dense_rank() OVER (ORDER BY event_type) - 1 AS label, value FROM events)"""
