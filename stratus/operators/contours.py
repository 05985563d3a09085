"""Iso-lines as relations, and the events on them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratus.functions.sphere import RADIUS, haversine

from .graph import connected_components, cut_lineage

#: Points of a line that are met together.
STRETCH = 64


def segments(grid: DataFrame, col: str, levels: list[float], keys: list[str], nlon: int | None = None) -> DataFrame:
    """Marching squares: one row for each piece of an iso-line in a grid cell, with named crossing edges ``a`` and ``b``.

    Corners come from windows on the two axes (wrapped in longitude with ``nlon``). A saddle is cut by its mean.
    """
    rows, cols = Window.partitionBy(*keys, "ilat").orderBy("ilon"), Window.partitionBy(*keys, "ilon").orderBy("ilat")
    first = F.first(F.struct("lon", F.col(col).alias("v"))).over(rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    east = F.coalesce(F.when(F.lead("ilon").over(rows) == F.col("ilon") + 1, F.struct(F.lead("lon").over(rows).alias("lon"), F.lead(col).over(rows).alias("v"))), F.when(F.col("ilon") == nlon - 1, F.struct((first.lon + 360.0).alias("lon"), first.v.alias("v"))) if nlon else F.lit(None))
    g = grid.select(*keys, "ilon", "ilat", "lon", "lat", col).withColumn("__e", east)
    g = g.withColumns({"__n": F.when(F.lead("ilat").over(cols) == F.col("ilat") + 1, F.lead(col).over(cols)), "__ne": F.when(F.lead("ilat").over(cols) == F.col("ilat") + 1, F.lead("__e").over(cols)).v, "__la": F.lead("lat").over(cols)})
    g = g.where(F.col("__e").isNotNull() & F.col("__n").isNotNull() & F.col("__ne").isNotNull()).withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    sw, se, ne, nw = F.col(col), F.col("__e.v"), F.col("__ne"), F.col("__n")
    L, x0, x1, y0, y1 = F.col("level"), F.col("lon"), F.col("__e.lon"), F.col("lat"), F.col("__la")
    up = lambda v: v > L
    cut = lambda p, q: (L - p) / (q - p)
    ix, iy = F.col("ilon"), F.col("ilat")
    jx = F.pmod(ix + 1, F.lit(nlon)) if nlon else ix + 1
    node = lambda kind, x, y, px, py: F.struct(F.concat_ws("_", F.lit(kind), x, y).alias("name"), px.alias("lon"), py.alias("lat"))
    south, north = node("h", ix, iy, x0 + cut(sw, se) * (x1 - x0), y0), node("h", ix, iy + 1, x0 + cut(nw, ne) * (x1 - x0), y1)
    west, east_ = node("v", ix, iy, x0, y0 + cut(sw, nw) * (y1 - y0)), node("v", jx, iy, x1, y0 + cut(se, ne) * (y1 - y0))
    hit = {"s": up(sw) != up(se), "e": up(se) != up(ne), "n": up(nw) != up(ne), "w": up(sw) != up(nw)}
    at = {"s": south, "e": east_, "n": north, "w": west}
    saddle = hit["s"] & hit["e"] & hit["n"] & hit["w"]
    joined = up(sw) == up((sw + se + ne + nw) / 4)
    pair = lambda p, q: F.array(F.struct(at[p].alias("a"), at[q].alias("b")))
    two = lambda p, q, r, s: F.array(F.struct(at[p].alias("a"), at[q].alias("b")), F.struct(at[r].alias("a"), at[s].alias("b")))
    lines = F.when(saddle & joined, two("s", "e", "n", "w")).when(saddle, two("s", "w", "n", "e"))
    for p, q in ("se", "sn", "sw", "en", "ew", "nw"):
        lines = lines.when(hit[p] & hit[q], pair(p, q))
    return g.select(*keys, "level", F.explode(lines).alias("z")).select(*keys, "level", "z.a", "z.b")


def _chains(frame: pd.DataFrame) -> pd.DataFrame:
    """Order the nodes of one grid's lines by walking their links: first lines with ends, from the lesser end, then rings."""
    links: dict[str, list[str]] = {}
    place = {}
    for a, b in zip(frame["a"], frame["b"]):
        links.setdefault(a["name"], []).append(b["name"])
        links.setdefault(b["name"], []).append(a["name"])
        place.setdefault(a["name"], (a["lon"], a["lat"]))
        place.setdefault(b["name"], (b["lon"], b["lat"]))
    seen, out, line = set(), [], 0
    for at in sorted(links, key=lambda k: (len(links[k]) != 1, place[k], k)):
        if at in seen:
            continue
        cyclic, index = len(links[at]) != 1, 0
        while at is not None:
            seen.add(at)
            out.append((line, index, *place[at], cyclic))
            index += 1
            at = next((k for k in sorted(links[at]) if k not in seen), None)
        line += 1
    return pd.DataFrame(out, columns=["contour", "index", "lon", "lat", "cyclic"])


def contours(grid: DataFrame, col: str, levels: list[float], keys: list[str], nlon: int | None = None, min_points: int = 10) -> DataFrame:
    """keys, level, contour, index, lon, lat, cyclic, len: lines of more than ``min_points`` points.

    A line never leaves its grid and level, so the pieces of one of these are joined up in one group, which the grid
    bounds; the number ``contour`` counts within it.
    """
    seg = segments(grid, col, levels, keys, nlon)
    kinds, group = {f.name: f.dataType.simpleString() for f in seg.schema}, [*keys, "level"]

    def order(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = _chains(frame)
        for k, v in zip(group, key):
            out[k] = v
        return out[[*group, "contour", "index", "lon", "lat", "cyclic"]]

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in group) + ", contour bigint, index bigint, lon double, lat double, cyclic boolean"
    lines = seg.select(*group, "a", "b").groupBy(*group).applyInPandas(order, schema)
    return lines.withColumn("len", F.count("*").over(Window.partitionBy(*group, "contour"))).where(F.col("len") > min_points)


def overturnings(points: DataFrame, keys: list[str], max_gap: float, min_lon: float, min_lat: float, min_len: int) -> DataFrame:
    """Meridians that one line crosses three times or more, grouped where they are near; cyclonic if the west end lies
    north of the east end."""
    folded = points.groupBy(*keys, F.round("lon").alias("mer")).agg(F.count("*").alias("k"), F.min("lat").alias("lo"), F.max("lat").alias("hi"), F.min_by("lat", "index").alias("first"), F.max_by("lat", "index").alias("last")).where("k >= 3")
    w = Window.partitionBy(*keys).orderBy("mer")
    far = F.coalesce((F.col("mer") - F.lag("mer").over(w) > max_gap).cast("bigint"), F.lit(0))
    rows = folded.withColumn("__f", far).withColumn("event", F.sum("__f").over(w))
    out = rows.groupBy(*keys, "event").agg(F.min("mer").alias("west"), F.max("mer").alias("east"), F.min("lo").alias("south"), F.max("hi").alias("north"), F.sum("k").alias("n"), F.min_by("hi", "mer").alias("__w"), F.max_by("hi", "mer").alias("__e"))
    out = out.where((F.col("east") - F.col("west") >= min_lon) & (F.col("north") - F.col("south") >= min_lat) & (F.col("n") >= min_len))
    return out.withColumn("orientation", F.when(F.col("__w") > F.col("__e"), "cyclonic").otherwise("anticyclonic")).drop("__w", "__e")


def streamers(points: DataFrame, keys: list[str], index: str, max_real: float, min_along: float, min_ratio: float) -> DataFrame:
    """Pairs of points near each other on the map but far along the line; the locally nearest ones, nested ranges dropped."""
    from .joins import close_pairs

    w = Window.partitionBy(*keys).orderBy(index)
    step = F.sqrt(F.pow(F.col("lon") - F.lag("lon").over(w), 2.0) + F.pow(F.col("lat") - F.lag("lat").over(w), 2.0))
    rows = points.withColumn("__d", F.coalesce(step, F.lit(0.0))).withColumn("along", F.sum("__d").over(w))
    pairs = close_pairs(rows, keys, index, "lon", "lat", max_real)
    at = rows.select(*keys, F.col(index).alias("__k"), "along")
    pairs = pairs.join(at.withColumnsRenamed({"__k": "i", "along": "along_i"}).hint("merge"), [*keys, "i"]).join(at.withColumnsRenamed({"__k": "j", "along": "along_j"}).hint("merge"), [*keys, "j"])
    length = F.col("along_j") - F.col("along_i")
    pairs = pairs.withColumn("length", length).where((F.col("length") >= min_along) & (F.col("length") >= min_ratio * F.col("dist")))
    least = lambda c: F.min("dist").over(Window.partitionBy(*keys, c))
    best = pairs.withColumns({"__mi": least("i"), "__mj": least("j")}).where((F.col("dist") == F.col("__mi")) & (F.col("dist") == F.col("__mj")))
    before = F.max("j").over(Window.partitionBy(*keys).orderBy("i", F.desc("j")).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("j") > F.col("__b"))).select(*keys, "i", "j", "dist", "length")


def sphere_pairs(points: DataFrame, keys: list[str], index: str, reach: float) -> DataFrame:
    """Pairs i < j of one line nearer than ``reach`` metres, met in neighbouring cubes around the sphere, over seam and poles.

    Merge joins here and below: Spark takes an exploded side for as small as the files it comes from, and would broadcast it.
    """
    chord = 2.0 * math.sin(min(reach / RADIUS / 2.0, math.pi / 2.0)) * (1 + 1e-9)
    x = {"x": F.cos(F.radians("lat")) * F.cos(F.radians("lon")), "y": F.cos(F.radians("lat")) * F.sin(F.radians("lon")), "z": F.sin(F.radians("lat"))}
    cubes = points.select(*keys, index, "lon", "lat", *[F.floor(v / chord).alias(f"__{k}") for k, v in x.items()])
    around = F.array(*[F.struct(*[F.lit(d).alias(n) for n, d in zip("xyz", (a, b, c))]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    right = cubes.select(*keys, F.col(index).alias("j"), F.col("lon").alias("lon_j"), F.col("lat").alias("lat_j"), *[f"__{k}" for k in "xyz"], F.explode(around).alias("o"))
    right = right.select(*keys, "j", "lon_j", "lat_j", *[(F.col(f"__{k}") + F.col(f"o.{k}")).alias(f"__{k}") for k in "xyz"])
    far = haversine(F.col("lon"), F.col("lat"), F.col("lon_j"), F.col("lat_j"))
    near = cubes.withColumnRenamed(index, "i").join(right.hint("merge"), [*keys, "__x", "__y", "__z"]).where("i < j").withColumn("dist", far)
    return near.where(F.col("dist") < reach).select(*keys, "i", "j", "dist")


def _arc_cells(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """``arcs`` once for each stretch of ``STRETCH`` points that they cover on their line of ``n`` points."""
    cells = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("size"), F.lit(STRETCH)), lambda k: F.floor(F.pmod(F.col("start") + k, F.col("n")) / STRETCH)))
    ends = F.array(F.floor(F.pmod(F.col("start") + F.col("size"), F.col("n")) / STRETCH), F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / STRETCH))
    over = F.col("start") + F.col("size") >= F.col("n")
    ends = F.when(over, ends).otherwise(F.slice(ends, 1, 1))
    return arcs.withColumn("__cell", F.explode(F.array_union(cells, ends)))


def ring_streamers(points: DataFrame, keys: list[str], index: str, max_real: float, min_along: float, max_along: float, min_ratio: float, share: float = 0.8) -> DataFrame:
    """Streamers of lines that may be closed (``cyclic``): where two points are near on the sphere but far along the line.

    ``index`` counts each line's points from 0. A pair's arc is the shorter way along the line, for a closed one also over
    its first point; lengths are in metres. Of the pairs with an arc between ``min_along`` and ``max_along`` and over
    ``min_ratio`` times their distance, those stay that are nearest for both of their points and whose arc lies within no
    longer one. Arcs that share over ``share`` of the smaller one's points, also by way of others, become one. Columns:
    keys, streamer, start (first point), size (steps from it), n (points of the line), pairs (that were united), dist (least).
    """
    w, line = Window.partitionBy(*keys).orderBy(index), Window.partitionBy(*keys)
    step = F.coalesce(haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    close = haversine(F.first("lon").over(whole), F.first("lat").over(whole), F.last("lon").over(whole), F.last("lat").over(whole))
    rows = points.select(*keys, F.col(index).cast("bigint").alias("k"), "lon", "lat", "cyclic").withColumnRenamed("k", index).withColumn("__d", step)
    rows = rows.withColumns({"s": F.sum("__d").over(w), "n": F.count("*").over(line), "round": F.sum("__d").over(line) + close})
    at = lambda c: rows.select(*keys, F.col(index).alias(c), F.col("s").alias(f"s_{c}"), *(["n", "round", "cyclic"] if c == "i" else []))
    pairs = sphere_pairs(rows, keys, index, max_real).join(at("i").hint("merge"), [*keys, "i"]).join(at("j").hint("merge"), [*keys, "j"])
    ahead, back = F.col("s_j") - F.col("s_i"), F.col("round") - (F.col("s_j") - F.col("s_i"))
    forward = ~F.col("cyclic") | (ahead <= back)
    pairs = pairs.withColumns({"along": F.when(forward, ahead).otherwise(back), "start": F.when(forward, F.col("i")).otherwise(F.col("j")), "size": F.when(forward, F.col("j") - F.col("i")).otherwise(F.col("n") - (F.col("j") - F.col("i")))})
    pairs = pairs.where((F.col("along") > min_along) & (F.col("along") < max_along) & (F.col("along") > min_ratio * F.col("dist")))
    least = lambda c: F.min("dist").over(Window.partitionBy(*keys, c))
    best = pairs.withColumns({"__mi": least("i"), "__mj": least("j")}).where((F.col("dist") == F.col("__mi")) & (F.col("dist") == F.col("__mj")))
    arcs = cut_lineage(best.select(*keys, "start", "size", "n", "dist").withColumn("id", F.xxhash64(*keys, "start", "size")))

    own = [*keys, "__cell"]
    wide = _arc_cells(arcs, keys).select(*own, *[F.col(c).alias(f"{c}_w") for c in ("id", "start", "size")])
    holds = lambda p: F.pmod(p - F.col("start_w"), F.col("n")) <= F.col("size_w")
    first = arcs.withColumn("__cell", F.floor(F.col("start") / STRETCH)).join(wide.hint("merge"), own).where(F.col("size_w") > F.col("size"))
    nested = first.where(holds(F.col("start")) & holds(F.pmod(F.col("start") + F.col("size"), F.col("n")))).select("id").distinct()
    arcs = cut_lineage(arcs.join(nested.hint("merge"), "id", "left_anti").select(*arcs.columns))

    middle = F.pmod(F.col("start") + F.floor(F.col("size") / 2), F.col("n"))
    wide = _arc_cells(arcs, keys).select(*own, *[F.col(c).alias(f"{c}_w") for c in ("id", "start", "size")])
    met = arcs.withColumn("__cell", F.floor(middle / STRETCH)).join(wide.hint("merge"), own).where((F.col("id_w") != F.col("id")) & (F.col("size_w") >= F.col("size")))
    a, b = F.col("start"), F.col("start_w")
    both = sum((F.greatest(F.least(a + F.col("size"), b + F.col("size_w") + F.col("n") * t) - F.greatest(a, b + F.col("n") * t) + 1, F.lit(0)) for t in (-1, 0, 1)), F.lit(0))
    ties = met.where(both > share * (F.col("size") + 1)).select(F.col("id").alias("a"), F.col("id_w").alias("b")).distinct()
    groups = connected_components(ties)
    named = arcs.join(groups.hint("merge"), arcs.id == groups.node, "left").withColumn("__of", F.coalesce("component", "id")).drop("node", "component")
    lead = named.where("id = __of").select("__of", F.col("start").alias("__a"))
    named = named.join(lead.hint("merge"), "__of")
    shift = F.col("start") - F.col("__a")
    shift = shift - F.col("n") * F.round(shift / F.col("n")).cast("bigint")
    out = named.withColumn("__s", shift).groupBy(*keys, "__of", "__a", "n").agg(F.min("__s").alias("__lo"), F.max(F.col("__s") + F.col("size")).alias("__hi"), F.count("*").alias("pairs"), F.min("dist").alias("dist"))
    out = out.select(*keys, F.pmod(F.col("__a") + F.col("__lo"), F.col("n")).alias("start"), F.least(F.col("__hi") - F.col("__lo"), F.col("n") - 1).alias("size"), "n", "pairs", "dist")
    return out.withColumn("streamer", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "size")).cast("bigint") - 1).select(*keys, "streamer", "start", "size", "n", "pairs", "dist")


def streamer_points(streamers: DataFrame, points: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The points of each streamer in order along its line: keys, streamer, step, and the points' columns."""
    steps = streamers.select(*keys, "streamer", "start", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size"))).alias("step"))
    steps = steps.withColumn(index, F.pmod(F.col("start") + F.col("step"), F.col("n"))).drop("start", "n")
    return steps.join(points, [*keys, index])


def event_points(points: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Points array and envelope of each event."""
    seq = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), "lon", "lat")))
    return points.groupBy(*keys).agg(F.transform(seq, lambda p: F.struct(p.lon.alias("lon"), p.lat.alias("lat"))).alias("points"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))


def streamer_angle(points: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Angle of the axis from the middle of an event's base (its first and last point) to its farthest latitude."""
    ends = points.groupBy(*keys).agg(*[f(c, index).alias(f"{c}{k}") for c in ("lon", "lat") for f, k in ((F.min_by, 0), (F.max_by, 1))])
    base = ends.select(*keys, ((F.col("lon0") + F.col("lon1")) / 2).alias("bx"), ((F.col("lat0") + F.col("lat1")) / 2).alias("by"))
    tip = points.join(base, keys).groupBy(*keys, "bx", "by").agg(F.max_by(F.struct("lon", "lat"), F.struct(F.abs(F.col("lat") - F.col("by")), -F.col(index))).alias("t"))
    return tip.select(*keys, F.degrees(F.atan2(F.col("t.lat") - F.col("by"), F.col("t.lon") - F.col("bx"))).alias("axis_angle"))


def boundary_nodes(grid: DataFrame, positive: str, keys: list[str]) -> DataFrame:
    """Grid nodes with a value of at most 0 next to one above 0, on either axis."""
    rows, cols = Window.partitionBy(*keys, "ilat").orderBy("ilon"), Window.partitionBy(*keys, "ilon").orderBy("ilat")
    near = [F.coalesce(f(positive).over(w) > 0, F.lit(False)) for w in (rows, cols) for f in (F.lag, F.lead)]
    return grid.withColumn("__b", (F.col(positive) <= 0) & (near[0] | near[1] | near[2] | near[3])).where("__b").drop("__b")


def wave_break_masks(events: DataFrame, nodes: DataFrame, grid: DataFrame, key: list[str], on: list[str], classes: dict[str, Column]) -> DataFrame:
    """``grid`` with one 0/1 column for each class: whether an event of it covers the node.

    ``events`` has a row an event (``key``) with what the class conditions read (orientation, level, angle, area);
    ``nodes`` has the grid nodes of each event, by the columns ``on``.
    """
    kinds = nodes.join(events, key).groupBy(*on).agg(*[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in classes.items()])
    return grid.join(kinds, on, "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in classes})
