"""Grid nodes inside polygons, by scan lines: on each row of nodes a polygon is a few intervals, whose nodes need no test of
their own. Rings may go over the date line and around a pole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def shorter_way(step: Column) -> Column:
    """A step in longitude without the turns that the way round the other side would save."""
    return step - 360.0 * F.round(step / 360.0)


def unwrapped(points: DataFrame, keys: list[str], index: str, lon: str = "lon", name: str = "x") -> DataFrame:
    """``points`` with the longitude continued over the date line along each line."""
    w = Window.partitionBy(*keys).orderBy(index)
    rows = points.withColumn("__turn", F.coalesce(-F.round((F.col(lon) - F.lag(lon).over(w)) / 360.0), F.lit(0.0)))
    return rows.withColumn(name, F.col(lon) + 360.0 * F.sum("__turn").over(w)).drop("__turn")


def ring_edges(events: DataFrame, key: str, on: list[str], wrap: bool) -> DataFrame:
    """key, on, x0, y0, x1, y1 of the closed ring of each event's ``points``. With ``wrap`` each step goes the shorter way; a
    ring that ends a turn away from its start goes around a pole, and is closed along the nearer one."""
    own = [key, *on]
    rows = events.select(*own, F.posexplode("points").alias("i", "p")).select(*own, "i", F.col("p.lon").alias("lon"), F.col("p.lat").alias("y"))
    rows = unwrapped(rows, own, "i") if wrap else rows.withColumn("x", F.col("lon"))
    w = Window.partitionBy(*own).orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.lead("i").over(w).isNull()
    back = F.first("x").over(whole)
    closing = (F.col("x") + shorter_way(back - F.col("x"))) if wrap else back
    rows = rows.withColumns({"x1": F.when(last, closing).otherwise(F.lead("x").over(w)), "y1": F.when(last, F.first("y").over(whole)).otherwise(F.lead("y").over(w)), "__first": back, "__pole": F.when(F.avg("y").over(whole) < 0, -90.0).otherwise(90.0), "__last": last})
    edge = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    side = edge(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"))
    ends = F.array(side, edge(F.col("x1"), F.col("y1"), F.col("x1"), F.col("__pole")), edge(F.col("__first"), F.col("__pole"), F.col("__first"), F.col("y1")))
    turned = F.col("__last") & (F.abs(F.col("x1") - F.col("__first")) > 180)
    return rows.select(*own, F.explode(F.when(turned, ends).otherwise(F.array(side))).alias("e")).select(*own, "e.*")


def row_intervals(edges: DataFrame, rows: DataFrame, own: list[str]) -> DataFrame:
    """own, lat, low, high: where each row of nodes (``lat``) lies inside, from ``low`` up to but not at ``high``.

    An edge meets the rows between its ends by whole degrees of latitude; a row's crossings, sorted, are taken in twos.
    """
    degrees = F.sequence(F.floor(F.least("y0", "y1")), F.floor(F.greatest("y0", "y1")))
    cut = edges.where("y0 <> y1").withColumn("__row", F.explode(degrees)).join(rows.select("lat", F.floor("lat").alias("__row")), "__row")
    cut = cut.where((F.col("y0") > F.col("lat")) != (F.col("y1") > F.col("lat")))
    at = cut.select(*own, "lat", ((F.col("x1") - F.col("x0")) * (F.col("lat") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")).alias("low"))
    w = Window.partitionBy(*own, "lat").orderBy("low")
    at = at.withColumns({"high": F.lead("low").over(w), "__n": F.row_number().over(w)})
    return at.where((F.col("__n") % 2 == 1) & (F.col("high") > F.col("low"))).drop("__n")


def nodes_inside(events: DataFrame, grid: DataFrame, key: str = "event", on: list[str] = (), wrap: bool = True) -> DataFrame:
    """Nodes of ``grid`` inside each event's polygon (``points``: an array of lon, lat, closed by itself), of equal ``on``.

    Longitudes of nodes and polygons are compared modulo 360, so a polygon from 172 to 188 holds nodes at -180 and -175.
    With ``wrap`` each step of a ring goes the shorter way round; without it coordinates are continuous as they are.
    """
    own = [key, *on]
    inside = row_intervals(ring_edges(events, key, list(on), wrap), grid.select("lat").distinct(), own)
    inside = inside.withColumn("high", F.least("high", F.col("low") + 360.0))  # no node twice
    inside = inside.withColumn("__b", F.explode(F.sequence(F.floor("low"), F.floor("high")))).withColumn("__col", F.pmod("__b", F.lit(360)))
    nodes = grid.withColumn("__f", F.floor("lon")).withColumn("__col", F.pmod("__f", F.lit(360)))
    x = F.col("lon") + (F.col("__b") - F.col("__f")).cast("double")
    found = inside.join(nodes, [*on, "lat", "__col"]).where((x >= F.col("low")) & (x < F.col("high")))
    return found.select(key, *grid.columns)


def event_envelopes(points: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Points (longitudes continued along the line) and envelope of each event: ``west`` from -180 up to 180, ``east`` beyond 180
    where the event goes over the date line; the whole circle where it is a turn wide."""
    rows = unwrapped(points, keys, index)
    seq = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), "x", "lat")))
    out = rows.groupBy(*keys).agg(seq.alias("q"), F.min("x").alias("a"), F.max("x").alias("b"), F.min("lat").alias("south"), F.max("lat").alias("north"))
    turn = 360.0 * F.floor((F.col("a") + 180.0) / 360.0)
    round_ = F.col("b") - F.col("a") >= 360.0
    return out.select(
        *keys, F.transform("q", lambda p: F.struct((p.x - turn).alias("lon"), p.lat.alias("lat"))).alias("points"),
        F.when(round_, -180.0).otherwise(F.col("a") - turn).alias("west"), F.when(round_, 180.0).otherwise(F.col("b") - turn).alias("east"), "south", "north",
    )
