"""Iso-lines of grids of any size: their pieces are joined up by list ranking, not in one group a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .contours import segments
from .graph import cut_lineage


def linked(pieces: DataFrame, group: list[str]) -> DataFrame:
    """``group``, name, lon, lat, n0 and n1: each node of ``pieces`` with its neighbours by name, n1 null at a line's end.
    A node that both sides of the seam name lies at the lesser of its places."""
    ends = F.explode(F.array(F.struct("a", F.col("b.name").alias("to")), F.struct(F.col("b").alias("a"), F.col("a.name").alias("to")))).alias("z")
    nodes = pieces.select(*group, ends).groupBy(*group, F.col("z.a.name").alias("name"))
    nodes = nodes.agg(F.min(F.struct("z.a.lon", "z.a.lat")).alias("p"), F.min("z.to").alias("n0"), F.max("z.to").alias("n1"))
    return nodes.select(*group, "name", "p.lon", "p.lat", "n0", F.when(F.col("n1") != F.col("n0"), F.col("n1")).alias("n1"))


def ranked(nodes: DataFrame, group: list[str], cut=cut_lineage) -> DataFrame:
    """``group``, name, lon, lat, start, index, cyclic for each node of lines in which no node has over two neighbours.

    Pointer doubling over both directions of every line: each direction at a node points 2^k steps ahead and keeps what
    it met there, the line's end or the least node so far. An open line counts from the lesser of its ends, a ring
    from its least node towards that one's lesser neighbour. Rounds grow with the logarithm of the longest line; a
    round is one join of rows of constant width. Null keys make a group of their own.
    """
    node = nodes.select(F.struct(*group).alias("g"), "name", "lon", "lat", "n0", "n1")
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("n0").alias("v")), F.struct(F.lit(1).alias("side"), F.col("n1").alias("v")))).alias("s")
    way = node.select("g", "name", "lon", "lat", side).select("g", "name", "lon", "lat", "s.side", "s.v")
    there = node.select("g", F.col("name").alias("v"), F.col("n0").alias("back"))
    # At the next node a line leaves by the side that does not lead back; the free side of an end is its last step.
    mark = F.struct("lon", "lat", F.col("name").alias("at"), F.lit(0).cast("bigint").alias("hop"), "side").alias("mark")
    onward = F.when(F.col("back") == F.col("name"), 1).otherwise(0)
    ends = way.where("v is null").select("g", "name", "side", F.col("name").alias("to"), F.col("side").alias("to_side"), F.lit(0).cast("bigint").alias("hops"), F.lit(True).alias("done"), mark, F.lit(True).alias("moved"))
    steps = way.join(there, ["g", "v"]).select("g", "name", "side", F.col("v").alias("to"), onward.alias("to_side"), F.lit(1).cast("bigint").alias("hops"), F.lit(False).alias("done"), mark, F.lit(True).alias("moved"))
    state = cut(ends.unionByName(steps))
    while True:
        ahead = state.select("g", F.col("name").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("to_"), F.col("to_side").alias("to_side_"), F.col("hops").alias("hops_"), F.col("done").alias("done_"), F.col("mark").alias("mark_"))
        met = F.struct("mark_.lon", "mark_.lat", "mark_.at", (F.col("mark_.hop") + F.col("hops")).alias("hop"), "mark_.side")
        new = F.when(F.col("done_"), met).otherwise(F.least("mark", met))
        further = state.where("not done").join(ahead, ["g", "to", "to_side"]).select(
            "g", "name", "side", F.col("to_").alias("to"), F.col("to_side_").alias("to_side"), (F.col("hops") + F.col("hops_")).alias("hops"),
            F.col("done_").alias("done"), new.alias("mark"), (F.col("done_") | (new != F.col("mark"))).alias("moved"),
        )
        state = cut(state.where("done").withColumn("moved", F.lit(False)).unionByName(further))
        # While an open line is unfinished, some of it ends in every round; a ring on which no least node changes knows its own.
        if not state.where("moved").limit(1).count():
            break
    found = state.groupBy("g", "name").agg(F.min(F.when(F.col("done") | (F.col("mark.side") == 1), F.col("mark"))).alias("m"), (~F.bool_or("done")).alias("cyclic"))
    out = found.join(node.select("g", "name", "lon", "lat"), ["g", "name"])
    return out.select(*[F.col("g")[k].alias(k) for k in group], "name", "lon", "lat", F.col("m.at").alias("start"), F.col("m.hop").alias("index"), "cyclic")


def ranked_contours(grid: DataFrame, col: str, levels: list[float], keys: list[str], nlon: int | None = None, min_points: int = 10, cut=cut_lineage) -> DataFrame:
    """The lines of ``contours`` for grids that no one task holds: keys, level, contour, index, lon, lat, cyclic, len.

    Numbers and directions are those of ``contours``, where only lines, not points, of one grid and level meet to be numbered. Grids that wrap need three columns or more.
    An empty grid has no lines.
    """
    group = [*keys, "level"]
    nodes = cut(linked(segments(grid, col, levels, keys, nlon), group))
    points = cut(ranked(nodes, group, cut))
    lens = points.groupBy(F.struct(*group).alias("g"), "start").agg(F.count("*").alias("len"), F.first("cyclic").alias("c"), F.min(F.when(F.col("index") == 0, F.struct("lon", "lat"))).alias("p"))
    lens = lens.withColumn("contour", (F.row_number().over(Window.partitionBy("g").orderBy("c", "p", "start")) - 1).cast("bigint"))
    lens = lens.where(F.col("len") > min_points).select("g", "start", "contour", "len")
    return points.withColumn("g", F.struct(*group)).join(lens, ["g", "start"]).select(*group, "contour", "index", "lon", "lat", "cyclic", "len")
