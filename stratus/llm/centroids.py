"""Centroid clustering in whole numbers, by a tournament of bisectors.

Components become integers, so sums, floors and distances are exact and do not depend on the order of rows. Between each
two centroids lies a bisecting plane with an integer normal and threshold. A vector starts with centroid 0 and meets the
others in turn: the sign of one linear form says which of two centroids is farther and leaves, and zero keeps the smaller
number. After k - 1 signs the nearest is left, and only its distance is computed. Tasks hand on sums, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Up to this size of components all forms and distances of 64 components fit 64-bit integers; beyond, Python's integers are used.
FITS, LIMB = 1 << 27, 1 << 32
#: Components from here on count as not finite, so that sums of a billion vectors fit 38 digits above the lowest 32 bits.
LARGEST = 2.0**127 * 128


def whole_vectors(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their components floor(scale * x)) of a column of lists: those with ``dims`` components, none
    null or not finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.take(pa.array(rows)))
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls are NaN
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * scale)
        kept = (np.abs(scaled) < LARGEST).all(axis=1)
    scaled = scaled[kept]
    if np.abs(scaled).max(initial=0) < FITS:
        return rows[kept], scaled.astype(np.int64)
    return rows[kept], np.array([[int(x) for x in v] for v in scaled], object).reshape(-1, dims)


class Tournament:
    """The bisectors of centroids (rows of integers)."""

    def __init__(self, centroids: list[list[int]], dims: int):
        self.exact = np.array(centroids, object).reshape(-1, dims)
        self.k = len(self.exact)
        self.small = all(abs(x) < FITS for c in centroids for x in c)
        self.normals = 2 * (self.exact[None, :, :] - self.exact[:, None, :])
        squares = (self.exact * self.exact).sum(axis=1)
        self.thresholds = squares[None, :] - squares[:, None]
        if self.small:
            self.normals, self.thresholds, self.fast = self.normals.astype(np.int64), self.thresholds.astype(np.int64), self.exact.astype(np.int64)

    def nearest(self, x: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of the nearest centroids; ties to the smaller number."""
        out = [self._nearest(x[i : i + block]) for i in range(0, len(x), block)]
        return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if x.dtype == object or not self.small:  # rare: numbers beyond 64 bits
            x, normals, thresholds, exact = x.astype(object), self.normals.astype(object), self.thresholds.astype(object), self.exact
        else:
            normals, thresholds, exact = self.normals, self.thresholds, self.fast
        best = np.zeros(len(x), np.int64)
        for j in range(1, self.k):
            side = (x * normals[best, j]).sum(axis=1) - thresholds[best, j]
            best[side > 0] = j
        far = x - exact[best]
        return best, (far * far).sum(axis=1)


def _limbs(totals: list[int]) -> tuple[list[Decimal], list[int]]:
    return [Decimal(t >> 32) for t in totals], [t & (LIMB - 1) for t in totals]


def _read(vectors: DataFrame, vector_col: str, work: Callable, schema: str, *others: Column) -> DataFrame:
    """``vectors`` by batches through ``work``, which yields frames of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in work(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

    return vectors.select(*others, F.col(vector_col).alias("v")).mapInArrow(run, schema)


def _totals(vectors: DataFrame, vector_col: str, fight: Tournament, dims: int, scale: int) -> list[tuple[int, list[int], int]]:
    """(count, component sums, distance sum) of each centroid's vectors. A task hands on one row a centroid and component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        count, sums = [0] * fight.k, [[0] * (dims + 1) for _ in range(fight.k)]
        for batch in batches:
            _, x = whole_vectors(batch.column(batch.schema.get_field_index("v")), dims, scale)
            best, far = fight.nearest(x)
            for c in np.unique(best).tolist():
                own = best == c
                count[c] += int(own.sum())
                part = [int(s) for s in x[own].sum(axis=0)] + [sum(far[own].tolist())]
                sums[c] = [a + b for a, b in zip(sums[c], part)]
                sums[c][dims] = min(sums[c][dims], 1 << 63)  # beyond 64 bits it only matters that it is
        for c in range(fight.k):
            if count[c]:
                high, low = _limbs(sums[c])
                yield pd.DataFrame({"c": c, "i": range(dims + 1), "n": count[c], "high": high, "low": low})

    parts = _read(vectors, vector_col, work, "c int, i int, n bigint, high decimal(38,0), low bigint")
    rows = parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()  # k * (dims + 1) rows
    out = [(0, [0] * dims, 0) for _ in range(fight.k)]
    total = {(r.c, r.i): (r.n, int(r.high) * LIMB + int(r.low)) for r in rows}
    for c in {r.c for r in rows}:
        out[c] = (total[c, 0][0], [total[c, i][1] for i in range(dims)], total[c, dims][1])
    return out


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, seed: int, id_col: str, vector_col: str) -> list[list[int]]:
    """Components of the ``k`` kept vectors whose hashed ids are smallest, fewer if there are fewer; ties by components."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) * scale < LARGEST, F.lit(False)))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = vectors.where((F.size(v) == dims) & fine).select(hashed.alias("hash"), v.cast("array<double>").alias("v")).orderBy("hash", "v").limit(k).collect()
    _, x = whole_vectors(pa.array([r.v for r in rows], pa.list_(pa.float64())), dims, scale)
    return [[int(c) for c in row] for row in x]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[dict]]:
    """(vectors, centroids): each kept vector's id, cluster and distance; each centroid's x, n and inertia.

    Kept are vectors with ``dims`` finite components; a vector that is null, of other length, or has a null component is
    left out. Repeated rows count as often as they occur; rows with a null id are clustered too. Distances beyond 64 bits
    are null. Without kept vectors there are no rows and no centroids.
    """
    centroids = first_centroids(vectors, k, dims, scale, seed, id_col, vector_col)
    for _ in range(rounds if centroids else 0):
        totals = _totals(vectors, vector_col, Tournament(centroids, dims), dims, scale)
        centroids = [[s // n for s in sums] if n else old for old, (n, sums, _) in zip(centroids, totals)]
    fight = Tournament(centroids, dims)
    about = [{"x": c, "n": n, "inertia": inertia} for c, (n, _, inertia) in zip(centroids, _totals(vectors, vector_col, fight, dims, scale))] if centroids else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches if fight.k else ():
            rows, x = whole_vectors(batch.column(batch.schema.get_field_index("v")), dims, scale)
            best, far = fight.nearest(x)
            ids = batch.column(batch.schema.get_field_index("id")).take(pa.array(rows)).to_pandas(integer_object_nulls=True)
            if far.dtype == object:
                far = pd.array([d if d < 1 << 63 else None for d in far], "Int64")
            yield pd.DataFrame({"id": ids, "cluster": best, "distance": far})

    return _read(vectors, vector_col, work, "id bigint, cluster int, distance bigint", F.col(id_col).cast("bigint").alias("id")), about


def cluster_report(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """:func:`cluster` with what is known of each vector's cluster: cluster_inertia, inertia (null beyond 64 bits), centroid_sha256."""
    rows, about = cluster(vectors, k, rounds, dims, scale, seed, id_col, vector_col)
    long = lambda x: x if x < 1 << 63 else None
    total = long(sum(a["inertia"] for a in about))
    known = [(c, long(a["inertia"]), total, hashlib.sha256(",".join(map(str, a["x"])).encode()).hexdigest()) for c, a in enumerate(about)]
    table = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
