"""Linking features through time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratus.functions.measures import slowness
from stratus.functions.sphere import RADIUS

from .graph import connected_components, cut_lineage
from .joins import successor_join


def paths_as_arrays(jets: DataFrame, keys: list[str], means: list[str] = ("s",)) -> DataFrame:
    """One row a path: its points in map metres, its whole longitudes, and means of its values."""
    x, y = F.radians("lon") * RADIUS, F.log(F.tan(F.radians(F.lit(45.0) + F.col("lat") / 2))) * RADIUS
    seq = F.array_sort(F.collect_list(F.struct(F.col("index").alias("i"), x.alias("x"), y.alias("y"))))
    return jets.groupBy(*keys).agg(F.transform(seq, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("path"), F.array_sort(F.collect_set(F.round("lon").cast("int"))).alias("lons"), *[F.avg(c).alias(c) for c in means])


def frechet_of(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Discrete Frechet distances of pairs of paths (rows of x, y, none empty)."""
    ends = lambda z: np.concatenate(([0], np.cumsum([len(p) for p in z])))
    p, q = ends(a), ends(b)
    return _frechet_of(np.concatenate(a), p[:-1], np.diff(p), np.concatenate(b), q[:-1], np.diff(q))


def _frechet_of(a: np.ndarray, at_a: np.ndarray, n: np.ndarray, b: np.ndarray, at_b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The dynamic programme of all pairs at once, along its anti-diagonals, so that memory grows with the paths' lengths and
    not with their product. Pair i has ``n[i]`` points of ``a`` from ``at_a[i]`` on and ``m[i]`` of ``b``."""
    pad = lambda z, at, k: z[at[:, None] + np.minimum(np.arange(k.max()), k[:, None] - 1)]
    p, q = pad(a, at_a, n), pad(b, at_b, m)
    before = np.full((2, len(n), n.max() + 1), np.inf)  # the last two diagonals, by point of the first path
    out = np.zeros(len(n))
    for k in range(n.max() + m.max() - 1):
        low, high = max(0, k - m.max() + 1), min(n.max() - 1, k)
        gap = p[:, low : high + 1] - q[:, k - high : k - low + 1][:, ::-1]
        far = np.hypot(gap[..., 0], gap[..., 1])
        if k:
            last, older = before[(k - 1) % 2], before[k % 2]
            far = np.maximum(far, np.minimum(np.minimum(last[:, low + 1 : high + 2], last[:, low : high + 1]), older[:, low : high + 1]))
        now = np.full_like(before[0], np.inf)
        now[:, low + 1 : high + 2] = far
        before[k % 2] = now
        done = np.flatnonzero(n + m - 2 == k)
        out[done] = now[done, n[done]]
    return out


def _points(paths: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points (x, y) of a column of paths, and where each begins and how many it has (0: null)."""
    flat = paths.flatten()
    size = paths.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")]), np.cumsum(size) - size, size


def _frechet(a: pa.Array, b: pa.Array) -> pa.Array:
    (p, at_p, n), (q, at_q, m) = _points(a), _points(b)
    out, work = np.full(len(n), np.nan), n + m
    order = np.argsort(work, kind="stable")
    order = order[(n[order] > 0) & (m[order] > 0)]
    start = 0
    while start < len(order):  # paths of like lengths together, so that little is padded
        fit = np.searchsorted(work[order[start:]] * np.arange(1, len(order) - start + 1), 1 << 18, "right")
        own = order[start : start + max(1, fit)]
        out[own] = _frechet_of(p, at_p[own], n[own], q, at_q[own], m[own])
        start += len(own)
    return pa.array(out)


def frechet(a: Column, b: Column) -> Column:
    """Discrete Frechet distance of two arrays of points (x, y); null where one is null or empty."""
    return F.nanvl(F.arrow_udf(_frechet, "double")(a, b), F.lit(None).cast("double"))


def least_frechet(a: Column, b: Column) -> Column:
    """What the Frechet distance cannot be below: the paths' ends must meet, and each path reaches the other's bounding box."""
    gap = lambda p, q: F.hypot(p.x - q.x, p.y - q.y)
    ends = F.greatest(gap(F.element_at(a, 1), F.element_at(b, 1)), gap(F.element_at(a, -1), F.element_at(b, -1)))
    side = lambda c: [F.abs(f(F.transform(a, lambda z: z[c])) - f(F.transform(b, lambda z: z[c]))) for f in (F.array_min, F.array_max)]
    return F.greatest(ends, *side("x"), *side("y"))


def lon_overlap(a: Column, b: Column) -> Column:
    """Shared longitudes over the length of each path, averaged."""
    shared = F.size(F.array_intersect(a, b))
    return (shared / F.size(a) + shared / F.size(b)) / 2


def track(jets: DataFrame, keys: list[str], order: str, dt: int = 1, values: list[str] = ("s",), within: float | None = None) -> DataFrame:
    """Every path with each path of the next step: dist, lon_overlap and differences of mean values. With ``within`` pairs that
    are farther apart are left out, most of them by a bound before the exact distance."""
    arrays = paths_as_arrays(jets, [*keys, order, "jet_id"], list(values))
    pairs = successor_join(arrays, keys, order, dt, "jet_id").where("jet_id_right is not null")
    if within is not None:
        pairs = pairs.where(least_frechet(F.col("path"), F.col("path_right")) <= within)
    pairs = pairs.withColumns({"dist": frechet(F.col("path"), F.col("path_right")), "lon_overlap": lon_overlap(F.col("lons"), F.col("lons_right")), **{f"d{v}": F.abs(F.col(v) - F.col(f"{v}_right")) for v in values}})
    pairs = pairs.drop("path", "path_right", "lons", "lons_right")
    return pairs if within is None else pairs.where(F.col("dist") <= within)


def connect(cross: DataFrame, keys: list[str], order: str, max_dist: float, min_overlap: float, dt: int = 1, seconds: float = 21600.0, max_dis_polar: float | None = None) -> DataFrame:
    """keys, order, jet_id, spell: components of the best successors over the thresholds. With ``max_dis_polar`` the mean
    ``is_polar`` of both must differ by less (``track`` gives ``dis_polar`` with ``values=["is_polar"]``)."""
    if max_dis_polar is not None:
        cross = cross.where(F.col("dis_polar") < max_dis_polar)
    ok = cross.where((F.col("dist") <= max_dist) & (F.col("lon_overlap") >= min_overlap)).withColumn("slowness", slowness(F.col("lon_overlap"), F.greatest(F.col("dist"), F.lit(1.0)), seconds))
    best = ok.groupBy(*keys, order, "jet_id").agg(F.max_by("jet_id_right", F.struct("slowness", -F.col("jet_id_right"))).alias("jet_id_right"))
    a, b = F.xxhash64(*keys, order, "jet_id"), F.xxhash64(*keys, F.col(order) + dt, "jet_id_right")
    edges = cut_lineage(best.withColumns({"a": a, "b": b}))  # read several times; distances are taken once
    parts = connected_components(edges)
    nodes = edges.select(*keys, order, "jet_id", F.col("a").alias("node")).unionByName(edges.select(*keys, (F.col(order) + dt).alias(order), F.col("jet_id_right").alias("jet_id"), F.col("b").alias("node"))).distinct()
    named = nodes.join(parts, "node").drop("node")
    return named.withColumn("spell", F.dense_rank().over(Window.partitionBy(*keys).orderBy("component")).cast("bigint") - 1 if keys else F.col("component")).drop("component")


def feature_slowness(cross: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    return cross.groupBy(*keys).agg(F.max(slowness(F.col("lon_overlap"), F.greatest(F.col("dist"), F.lit(1.0)), seconds)).alias("slowness"))


def spells_from_tracks(tracks: DataFrame, keys: list[str], order: str, by: str, n: int) -> DataFrame:
    """The ``n`` tracks of each key with the largest sum of ``by``, with relative index and length."""
    total = tracks.groupBy(*keys, "spell").agg(F.sum(by).alias("__t"), F.count("*").alias("len"))
    best = total.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__t"), "spell"))).where(F.col("__r") <= n).select(*keys, "spell", "len")
    rows = tracks.join(best, [*keys, "spell"])
    return rows.withColumn("relative_index", F.col(order) - F.min(order).over(Window.partitionBy(*keys, "spell")))


def medoid(paths: DataFrame, keys: list[str], key: str) -> DataFrame:
    """By composite (``keys``) the path with the least summed Frechet distance to its other paths."""
    other = paths.select(*keys, F.col(key).alias("__k"), F.col("path").alias("__p"))
    pairs = paths.join(other, keys).where(F.col(key) != F.col("__k"))
    total = pairs.groupBy(*keys, key).agg(F.sum(frechet(F.col("path"), F.col("__p"))).alias("total"))
    return total.groupBy(*keys).agg(F.min_by(F.struct(key, "total"), F.struct("total", key)).alias("b")).select(*keys, "b.*")
