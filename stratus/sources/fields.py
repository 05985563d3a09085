"""Fields as long tables: layout, standard names, dense arrays, stored results."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratus.functions.sphere import wrap_lon

#: Provider names of columns and ours.
RENAMES = {"longitude": "lon", "latitude": "lat", "level": "lev", "plev": "lev", "pressure_level": "lev", "valid_time": "time", "number": "member", "U": "u", "V": "v", "ws": "s", "T": "t", "temperature": "t"}


def read_fields(spark: SparkSession, root: str, dataset: str, level_type: str, var: str, resolution: str, years=None) -> DataFrame:
    """A variable of a tree partitioned by dataset, level_type, var, resolution and year: only the partitions named are listed."""
    df = spark.read.parquet(root).where((F.col("dataset") == dataset) & (F.col("level_type") == level_type) & (F.col("var") == var) & (F.col("resolution") == resolution))
    return df if years is None else df.where(F.col("year").isin(list(years)))


def standardize(df: DataFrame) -> DataFrame:
    """Our names, longitudes in [-180, 180), doubles without NaN or infinities."""
    df = df.withColumnsRenamed({a: b for a, b in RENAMES.items() if a in df.columns})
    clean = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    df = df.withColumns({c: clean(F.col(c).cast("double")) for c, t in df.dtypes if t in ("float", "double")})
    return df.withColumn("lon", wrap_lon(F.col("lon"))) if "lon" in df.columns else df


def latitude_order(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``ilat`` and ``ilon`` as the places of a node's axes in ascending order."""
    place = lambda c: F.dense_rank().over(Window.orderBy(c)) - 1  # noqa: E731  over the few axis values
    for axis, name in (("lat", "ilat"), ("lon", "ilon")):
        df = df.drop(name).join(F.broadcast(df.select(axis).distinct().withColumn(name, place(axis).cast("bigint"))), axis)
    return df


def grid_to_long(df: DataFrame, values: str, nlat: int, nlon: int, first: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """One row a cell of a dense row-major array column; ids and axes by arithmetic, no join."""
    out = df.select(*[c for c in df.columns if c != values], F.posexplode(values).alias("__i", "value"))
    out = out.withColumns({"ilat": F.floor(F.col("__i") / nlon), "ilon": F.col("__i").cast("bigint") % nlon}).where(F.col("ilat") < nlat).drop("__i")
    return out.withColumns({"lon": first[0] + step[0] * F.col("ilon"), "lat": first[1] + step[1] * F.col("ilat")})


def long_to_grid(df: DataFrame, keys: list[str], value: str, nlat: int, nlon: int) -> DataFrame:
    """A dense row-major array a key, with nulls where cells are missing."""
    at = (F.col("ilat") * nlon + F.col("ilon")).cast("string")
    cells = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at, F.col(value)))).alias("__m"))
    return cells.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(nlat * nlon - 1)), lambda i: F.try_element_at("__m", i.cast("string"))).alias("values"))


def write_table(df: DataFrame, path: str, by: list[str] = ("year",), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_year(df: DataFrame, path: str, time: str = "time") -> None:
    """Put a year's rows into the store; a second run replaces the years it holds."""
    df.withColumn("year", F.year(time)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def read_series_text(spark: SparkSession, path: str, columns: list[str], sep: str = r"\s+") -> DataFrame:
    """An index series in text with year, month and day columns: ``time`` and doubles."""
    parts = F.split(F.trim("value"), sep)
    rows = spark.read.text(path).where(F.trim("value") != "").select(*[parts[i].cast("int" if c in ("year", "month", "day") else "double").alias(c) for i, c in enumerate(columns)])
    return rows.withColumn("time", F.make_date("year", "month", "day")).drop("year", "month", "day")


def land_mask(df: DataFrame, land: DataFrame) -> DataFrame:
    return df.join(land.select("ilat", "ilon").distinct(), ["ilat", "ilon"], "left_semi")


def materialize(spark: SparkSession, make, base: str, metadata: dict) -> DataFrame:
    """The stored result of equal metadata, else the computed and stored one. The metadata are written last, beside the
    result: what a broken run left has none and is written anew."""
    text = json.dumps(metadata, sort_keys=True, default=str)
    path = f"{base.rstrip('/')}/{hashlib.sha256(text.encode()).hexdigest()}"
    try:
        if spark.read.text(f"{path}/metadata", wholetext=True).first().value.rstrip("\n") == text:
            return spark.read.parquet(f"{path}/data")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    make().write.mode("overwrite").parquet(f"{path}/data")
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return spark.read.parquet(f"{path}/data")


def time_step(df: DataFrame, order: str) -> DataFrame:
    """Most frequent step of the distinct values of an order."""
    steps = df.select(order).distinct().withColumn("dt", F.col(order) - F.lag(order).over(Window.orderBy(order)))
    return steps.agg(F.mode("dt", True).alias("dt"))
