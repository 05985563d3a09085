"""Joins on axes, spells and regions. Axis ids are whole numbers, so that grid joins are equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import cut_lineage


def axis_id(x: Column, first: float, step: float) -> Column:
    """Nearest node of a regular axis."""
    return F.round((x - first) / step).cast("bigint")


def nearest_map(left: DataFrame, right: DataFrame, col: str, name: str = "nearest") -> DataFrame:
    """Distinct values of ``left`` with the nearest value of an irregular axis; ties go to the smaller one.

    Both value sets are distinct first and dealt by ranges; each range takes the nearest nodes outside it from the ranges
    around, so that no window runs over all values. Null values have no row.
    """
    values = left.select(F.col(col).alias("__x"), F.lit(True).alias("__ask")).distinct().unionByName(right.select(F.col(col).alias("__x"), F.lit(False).alias("__ask")).distinct())
    parts = cut_lineage(values.where(F.col("__x").isNotNull()).repartitionByRange("__x").withColumn("__part", F.spark_partition_id()))
    node = F.when(~F.col("__ask"), F.col("__x"))
    ends = parts.groupBy("__part").agg(F.min(node).alias("__lo"), F.max(node).alias("__hi"))  # a row a range
    w = Window.orderBy("__part")
    ends = ends.select("__part", F.max("__hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__hi"), F.min("__lo").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__lo"))
    w = Window.partitionBy("__part").orderBy("__x")
    here = parts.withColumns({"__a": F.last(node, True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "__b": F.first(node, True).over(w.rangeBetween(0, Window.unboundedFollowing))})
    values = here.join(F.broadcast(ends), "__part").withColumns({"__a": F.coalesce("__a", "__hi"), "__b": F.coalesce("__b", "__lo")})
    near = F.when(F.col("__b").isNull() | (F.col("__x") - F.col("__a") <= F.col("__b") - F.col("__x")), F.col("__a")).otherwise(F.col("__b"))
    return values.where("__ask").select(F.col("__x").alias(col), near.alias(name))


def as_of_tolerance(points: DataFrame, axis: DataFrame, col: str, tolerance: float, name: str = "nearest") -> DataFrame:
    near = nearest_map(points, axis, col, name)
    return points.join(near, col).where(F.abs(F.col(col) - F.col(name)) <= tolerance)


def snap_join(points: DataFrame, grid: DataFrame, keys: list[str], order: str, first: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """Points snapped to grid nodes, one row a node (the earliest of a path), with the node's fields and a new index."""
    ids = points.withColumns({"ilon": axis_id(F.col("lon"), first[0], step[0]), "ilat": axis_id(F.col("lat"), first[1], step[1])})
    once = ids.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "ilon", "ilat").orderBy(order))).where("__n = 1").drop("__n", "lon", "lat")
    on = [c for c in ("member", "time", "step", "ilon", "ilat") if c in once.columns and c in grid.columns]
    fresh = [c for c in grid.columns if c not in once.columns or c in on]
    joined = once.join(grid.select(*fresh), on, "left")
    return joined.withColumn(order, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint") - 1)


def field_join(df: DataFrame, grid: DataFrame, on: list[str], suffix: str = "") -> DataFrame:
    return df.join(grid.select(*on, *[F.col(c).alias(c + suffix) for c in grid.columns if c not in on]), on, "left")


def successor_join(features: DataFrame, keys: list[str], order: str, dt: int, feature: str) -> DataFrame:
    """Every feature with those of the next step; unmatched ones have nulls."""
    later = features.select(*keys, (F.col(order) - dt).alias(order), *[F.col(c).alias(f"{c}_right") for c in features.columns if c not in (*keys, order)])
    return features.join(later, [*keys, order], "left")


def close_pairs(points: DataFrame, keys: list[str], index: str, x: str, y: str, reach: float) -> DataFrame:
    """Ordered pairs i < j of one key within ``reach``, met in neighbouring cells of that width only. A merge join, as Spark would
    take the exploded side for as small as the files it comes from, and broadcast it."""
    cell = lambda c: F.floor(F.col(c) / reach)
    left = points.select(*keys, F.col(index).alias("i"), F.col(x).alias("x_i"), F.col(y).alias("y_i"), cell(x).alias("cx"), cell(y).alias("cy"))
    spread = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    right = points.select(*keys, F.col(index).alias("j"), F.col(x).alias("x_j"), F.col(y).alias("y_j"), cell(x).alias("__cx"), cell(y).alias("__cy"), F.explode(spread).alias("o"))
    right = right.select(*keys, "j", "x_j", "y_j", (F.col("__cx") + F.col("o.a")).alias("cx"), (F.col("__cy") + F.col("o.b")).alias("cy"))
    distance = F.sqrt(F.pow(F.col("x_i") - F.col("x_j"), 2.0) + F.pow(F.col("y_i") - F.col("y_j"), 2.0))
    return left.join(right.hint("merge"), [*keys, "cx", "cy"]).where("i < j").withColumn("dist", distance).where(F.col("dist") <= reach).drop("cx", "cy")


def contained(sets: DataFrame, keys: list[str], owner: str, point: str, share: float = 0.97) -> DataFrame:
    """Owners that share more than ``share`` of their points with an earlier owner; counted by an equi join on points."""
    size = sets.groupBy(*keys, owner).agg(F.count("*").alias("n"))
    other = sets.select(*keys, point, F.col(owner).alias("__left"))
    both = sets.join(other, [*keys, point]).where(F.col("__left") < F.col(owner)).groupBy(*keys, owner, "__left").agg(F.count("*").alias("shared"))
    return both.join(size, [*keys, owner]).where(F.col("shared") > share * F.col("n")).select(*keys, owner).distinct()


def spell_join(spells: DataFrame, table: DataFrame, order: str, by: list[str] = ()) -> DataFrame:
    """Values of ``table`` at each spell's steps."""
    on = [order, *by]
    return spells.select(*dict.fromkeys([*on, "spell", "relative_index", "len", *[c for c in spells.columns if c in ("jet", "region", "member")]])).join(table.select(*on, *[c for c in table.columns if c not in spells.columns]), on)


def restrict_to(df: DataFrame, times: DataFrame, on: list[str]) -> DataFrame:
    return df.join(times.select(*on).distinct(), on, "left_semi")


def left_behind(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and the rows of ``old`` whose keys it lost."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns))


def regionalize(grid: DataFrame, regions: DataFrame, on: list[str], keys: list[str], value: str) -> DataFrame:
    return grid.join(regions, on).groupBy(*keys, "region").agg(F.avg(value).alias(value))


def closest_attribute(wanted: DataFrame, features: DataFrame, on: list[str], attribute: str, feature: str) -> DataFrame:
    """For each row of ``wanted`` (with ``attribute``) the feature of its time whose attribute is nearest; ties to the smaller id."""
    right = features.select(*on, F.col(feature).alias("__f"), F.col(attribute).alias("__a"))
    keys = wanted.columns
    gap = F.struct(F.abs(F.col("__a") - F.col(attribute)), "__f")
    return wanted.join(right, on).groupBy(*keys).agg(F.min_by("__f", gap).alias(feature))


def lag_cross(times: DataFrame, steps: list[int], order: str) -> DataFrame:
    """Each row at a list of lags; the list is short and travels as a literal."""
    return times.withColumn("lag", F.explode(F.array(*[F.lit(k).cast("bigint") for k in steps]))).withColumn(order, F.col(order) + F.col("lag"))


def complete_index(df: DataFrame, keys: list[str], order: str, dt: int = 1) -> DataFrame:
    """All combinations of the keys' values with a full axis from the least to the greatest step."""
    ends = df.agg(F.min(order).alias("__a"), F.max(order).alias("__b"))  # one row
    full = df.select(keys[0]).distinct() if keys else None
    for k in keys[1:]:  # all combinations are what is asked for
        full = full.crossJoin(df.select(k).distinct())
    full = full.crossJoin(F.broadcast(ends)) if keys else ends
    axis = F.explode(F.sequence("__a", "__b", F.lit(dt).cast("bigint"))).alias(order)
    return full.select(*keys, axis).join(df, [*keys, order], "left").select(*df.columns)


def other_feature(df: DataFrame, keys: list[str], feature: str, cols: list[str]) -> DataFrame:
    other = df.select(*keys, F.col(feature).alias(f"{feature}_other"), *[F.col(c).alias(f"{c}_other") for c in cols])
    return df.join(other, keys).where(F.col(feature) != F.col(f"{feature}_other"))


def run_difference(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    right = b.select(*keys, *[F.col(c).alias(f"__{c}") for c in cols])
    return a.join(right, keys).select(*keys, *[(F.col(c) - F.col(f"__{c}")).alias(c) for c in cols])


def spatial_join(events: DataFrame, grid: DataFrame, key: str = "event", on: list[str] = (), wrap: bool = True) -> DataFrame:
    """Grid nodes inside each event's polygon; see :func:`stratus.operators.polygons.nodes_inside`."""
    from .polygons import nodes_inside

    return nodes_inside(events, grid, key, list(on), wrap)


def rasterize(covered: DataFrame, grid: DataFrame, on: list[str], value: Column) -> DataFrame:
    """0 everywhere, the largest value where an event covers the node."""
    marks = covered.groupBy(*on).agg(F.max(value).alias("__v"))
    return grid.join(marks, on, "left").withColumn("value", F.coalesce("__v", F.lit(0.0))).drop("__v")


def long(df: DataFrame, keys: list[str], cols: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row for each of the listed columns."""
    return df.unpivot(keys, cols, name, value)


def wide(df: DataFrame, keys: list[str], by: str, values: list, cols: list[str]) -> DataFrame:
    """One column for each of the listed values and columns."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(by) == v, F.col(c))).alias(f"{c}_{v}") for v in values for c in cols])
