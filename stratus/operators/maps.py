"""Self-organising maps on hexagonal sheets, flat or closed to a torus.

Best nodes come from blocked products of a batch of samples with the codebook. An epoch sums samples by best node, with
one row a node and component from each task, and moves every node by its neighbours' sums. The codebook is a table; its
size is set by the map's parameters and never grows with the samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Samples and nodes that are multiplied at once.
SAMPLES, NODES = 4096, 1024


def hex_places(nx: int, ny: int) -> np.ndarray:
    """Node i lies in column i % nx of row i // nx; odd rows are moved by half a step."""
    i = np.arange(nx * ny)
    return np.column_stack((i % nx + 0.5 * (i // nx % 2), (i // nx) * np.sqrt(0.75)))


def hex_distances(nx: int, ny: int, periodic: bool) -> np.ndarray:
    """Distances between the nodes; on a torus the shortest way round, for which the number of rows must be even."""
    if periodic and ny % 2:
        raise ValueError("a hexagonal sheet closes only with an even number of rows")
    at = hex_places(nx, ny)
    gap = at[:, None] - at[None]
    round_ = [(i * nx, j * ny * np.sqrt(0.75)) for i in (-1, 0, 1) for j in (-1, 0, 1)] if periodic else [(0.0, 0.0)]
    return np.min([np.hypot(gap[..., 0] + p, gap[..., 1] + q) for p, q in round_], axis=0)


def nearest(x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest node, second nearest, squared distance to the nearest) of each row; ties to the smaller number."""
    first, second = np.zeros(len(x), np.int64), np.full(len(x), -1)
    d1, d2 = np.full(len(x), np.inf), np.full(len(x), np.inf)
    for start in range(0, len(x), SAMPLES):
        own = slice(start, start + SAMPLES)
        for node in range(0, len(code), NODES):
            block = code[node : node + NODES]
            d = np.maximum((x[own] ** 2).sum(1)[:, None] - 2 * x[own] @ block.T + (block**2).sum(1), 0.0)
            for _ in range(min(2, len(block))):
                i = d.argmin(1)
                v = d[np.arange(len(d)), i]
                less, middle = v < d1[own], (v >= d1[own]) & (v < d2[own])
                second[own] = np.where(less, first[own], np.where(middle, i + node, second[own]))
                d2[own] = np.where(less, d1[own], np.where(middle, v, d2[own]))
                first[own], d1[own] = np.where(less, i + node, first[own]), np.where(less, v, d1[own])
                d[np.arange(len(d)), i] = np.inf
    second[~np.isfinite(d2)] = -1
    return first, second, d1


def _vectors(frame: pd.DataFrame, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return (np.stack(frame["__vector"].to_numpy()).astype(np.float64) - mean) / sd if len(frame) else np.zeros((0, len(mean)))


def _clean(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return df.where(F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))).select(*keep, v.alias("__vector"))


def moments(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation (1 where it is 0) of each component; vectors that are null or have a component that is
    null or not finite are left out. All must have one length."""
    rows = _clean(df, vector)

    def sums(middle: np.ndarray | None):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, s, q = 0, 0.0, 0.0
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["__vector"].to_numpy())
                    n, s = n + len(x), s + x.sum(0)
                    q = q + ((x - middle) ** 2).sum(0) if middle is not None else q
            if n:
                yield pd.DataFrame({"i": range(len(s)), "n": n, "s": s, "q": q})

        total = rows.mapInPandas(run, "i int, n bigint, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").collect()
        return np.array([r.n for r in total]), np.array([r.s for r in total]), np.array([r.q for r in total])

    n, s, _ = sums(None)
    if not len(n):
        return np.zeros(0), np.ones(0)
    sd = np.sqrt(sums(s / n)[2] / n)
    return s / n, np.where(sd > 0, sd, 1.0)


def node_sums(df: DataFrame, vector: str, code: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums of standardised samples, number of samples, squared distances) by best node."""
    dim, shared = len(mean), df.sparkSession.sparkContext.broadcast((code, mean, sd))  # nodes * components numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, m, s = shared.value
        total, n, d = np.zeros((len(w), dim)), np.zeros(len(w), np.int64), np.zeros(len(w))
        for frame in frames:
            x = _vectors(frame, m, s)
            best, _, far = nearest(x, w)
            np.add.at(total, best, x)
            n += np.bincount(best, minlength=len(w))
            d += np.bincount(best, far, len(w))
        for k in np.flatnonzero(n):
            yield pd.DataFrame({"node": k, "i": np.arange(-2, dim), "s": np.concatenate(([n[k], d[k]], total[k]))})

    rows = _clean(df, vector).mapInPandas(run, "node int, i int, s double").groupBy("node", "i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros((len(code), dim + 2))
    for r in rows:
        out[r.node, r.i + 2] = r.s
    shared.unpersist()
    return out[:, 2:], out[:, 0], out[:, 1]


def train(df: DataFrame, vector: str, nx: int, ny: int, epochs: int = 10, periodic: bool = True, sigma: float | None = None, least: float = 0.3) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(codebook, mean, sd): a batch map of standardised vectors. The codebook has node, x, y, weights (standardised).

    The map starts as a plane (on a torus: two rings) through the samples' two widest components, and the neighbourhood
    narrows from ``sigma`` (a third of the sheet) to ``least`` steps. Without samples the codebook is empty.
    """
    mean, sd = moments(df, vector)
    dim, at, gap = len(mean), hex_places(nx, ny), hex_distances(nx, ny, periodic)
    code = start(nx, ny, dim, periodic)
    width = sigma or max(nx, ny) / 3
    for e in range(epochs if dim else 0):
        total, n, _ = node_sums(df, vector, code, mean, sd)
        code = moved(code, total, n, gap, width * (least / width) ** (e / max(1, epochs - 1)))
    rows = [(i, float(at[i, 0]), float(at[i, 1]), code[i].tolist()) for i in range(nx * ny)] if dim else []
    return df.sparkSession.createDataFrame(rows, "node int, x double, y double, weights array<double>"), mean, sd


def start(nx: int, ny: int, dim: int, periodic: bool) -> np.ndarray:
    """First weights: smooth functions of the place on the sheet, a different wave for each few components."""
    at = hex_places(nx, ny)
    p, q = 2 * np.pi * at[:, 0] / nx, 2 * np.pi * at[:, 1] / (ny * np.sqrt(0.75))
    waves = [np.cos(p), np.sin(p), np.cos(q), np.sin(q)] if periodic else [at[:, 0] / nx - 0.5, at[:, 1] / ny - 0.5]
    return np.column_stack([waves[i % len(waves)] / (1 + i // len(waves)) for i in range(dim)]) if dim else np.zeros((nx * ny, 0))


def moved(code: np.ndarray, total: np.ndarray, n: np.ndarray, gap: np.ndarray, width: float) -> np.ndarray:
    """The codebook after an epoch: means of the samples, weighted by how near their best nodes lie."""
    h = np.exp(-(gap**2) / (2 * width**2))
    weight = h @ n
    return np.where(weight[:, None] > 1e-12, (h @ total) / np.maximum(weight, 1e-12)[:, None], code)


def assign(df: DataFrame, vector: str, codebook: DataFrame, mean: np.ndarray, sd: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns with node, second (-1 if there is none), distance; vectors that are not whole are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    code = np.array([r.weights for r in codebook.orderBy("node").collect()]).reshape(-1, len(mean))  # the map's nodes
    shared = df.sparkSession.sparkContext.broadcast((code, mean, sd))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, m, s = shared.value
        for frame in frames:
            if len(frame) and len(w):
                best, second, far = nearest(_vectors(frame, m, s), w)
                yield frame.drop(columns=["__vector"]).assign(node=best, second=second, distance=np.sqrt(far))

    return _clean(df, vector, *keep).mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "node int, second int, distance double"]))


def project(df: DataFrame, vector: str, codebook: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(samples, centres) of data on a map trained on other data: the samples are standardised by their own moments, meet the
    map's standardised weights, and give the nodes new centres, their own means."""
    mean, sd = moments(df, vector)
    samples = assign(df, vector, codebook, mean, sd, keep)
    code = np.array([r.weights for r in codebook.orderBy("node").collect()]).reshape(-1, len(mean))
    total, n, _ = node_sums(df, vector, code, mean, sd) if len(mean) else (np.zeros((0, 0)), np.zeros(0), None)
    rows = [(int(i), int(n[i]), (total[i] / n[i] * sd + mean).tolist()) for i in np.flatnonzero(n)]
    return samples, df.sparkSession.createDataFrame(rows, "node int, n bigint, centre array<double>")


def sheet_errors(samples: DataFrame, nx: int, ny: int, periodic: bool) -> DataFrame:
    """quantisation: mean distance to the best node; topographic: share of samples whose two best nodes are not neighbours."""
    gap = hex_distances(nx, ny, periodic)
    near = F.array(*[F.array(*[F.lit(int(j)) for j in np.flatnonzero((gap[i] > 0) & (gap[i] < 1.01))]) for i in range(nx * ny)])
    apart = ~F.array_contains(F.element_at(near, F.col("node") + 1), F.col("second"))
    return samples.agg(F.avg("distance").alias("quantisation"), F.avg(apart.cast("double")).alias("topographic"), F.count("*").alias("n"))
