"""Leading patterns of fields of any width, by a randomised range finder whose products are joins and sums.

A field is a long table (step, cell, value). Its product with a narrow table of one row a cell is a join on the cell and a
sum by step, and the transposed product a join on the step and a sum by cell, so that no matrix of cells by cells exists
anywhere. Only matrices of a few patterns squared come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .graph import cut_lineage


def cell_covariances(x: DataFrame, y: DataFrame, on: str, cell: str, value: str) -> DataFrame:
    """a, b, n, cov: sample covariance of each cell of ``x`` with each of ``y`` over the steps that have both. For fields of few
    cells: the result has a row for each two of them."""
    pairs = x.select(on, F.col(cell).alias("a"), F.col(value).alias("__x")).join(y.select(on, F.col(cell).alias("b"), F.col(value).alias("__y")), on)
    pairs = pairs.where("__x is not null and __y is not null")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.when(F.count("*") > 1, F.covar_samp("__x", "__y")).alias("cov"))


def _anomalies(df: DataFrame, steps: DataFrame, on: str, cell: str, value: str) -> DataFrame:
    rows = df.where(F.col(value).isNotNull()).select(F.col(on).alias("step"), F.col(cell).alias("cell"), F.col(value).cast("double").alias("v")).join(steps, "step", "left_semi")
    means = rows.groupBy("cell").agg(F.avg("v").alias("m"))
    return rows.join(means, "cell").select("step", "cell", (F.col("v") - F.col("m")).alias("v"))


def _names(n: int) -> list[str]:
    return [f"c{j}" for j in range(n)]


def _times(field: DataFrame, narrow: DataFrame, over: str, by: str, n: int) -> DataFrame:
    """Product of a field with a table of ``n`` columns a key of ``over``: a row for each key of ``by``."""
    return field.join(narrow, over).groupBy(by).agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in _names(n)])


def _combined(narrow: DataFrame, key: str, weights: np.ndarray) -> DataFrame:
    """Columns times a small matrix."""
    n = len(weights)
    cols = [sum((F.col(f"c{i}") * float(weights[i, j]) for i in range(1, n)), F.col("c0") * float(weights[0, j])).alias(f"c{j}") for j in range(weights.shape[1])]
    return narrow.select(key, *cols)


def _gram(narrow: DataFrame, n: int) -> np.ndarray:
    r = narrow.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i + 1)]).first()
    g = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
    return g


def _orthonormal(narrow: DataFrame, key: str, n: int, least: float = 1e-12) -> tuple[DataFrame, int]:
    """The same column space with orthonormal columns, fewer where columns depend on each other; twice, for rounding."""
    for _ in range(2):
        narrow = cut_lineage(narrow)
        values, vectors = np.linalg.eigh(_gram(narrow, n))
        keep = values > least * max(values.max(), 0.0)
        keep &= values > 0
        if not keep.any():
            return narrow.limit(0), 0
        narrow, n = _combined(narrow, key, (vectors / np.sqrt(np.where(keep, values, 1.0)))[:, keep]), int(keep.sum())
    return cut_lineage(narrow), n


def _start(cells: DataFrame, n: int, seed: int) -> DataFrame:
    """A number between -1 and 1 for each cell and column, by hashes."""
    number = lambda j: F.pmod(F.xxhash64(F.lit(seed), F.lit(j), "cell"), F.lit(2_000_001)) / 1e6 - 1
    return cells.select("cell", *[number(j).alias(f"c{j}") for j in range(n)])


def coupled_patterns(x: DataFrame, y: DataFrame, on: str, cell: str, value: str, k: int, extra: int = 6, rounds: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame, list[float]]:
    """(left, right, covariances): the ``k`` leading singular vectors of the cross-covariance of two fields, as tables
    (cell, pattern, loading), and their singular values.

    Covariances are over the steps that both tables have; a cell without a value at such a step counts as its mean there.
    Loadings of a pattern have unit length, and the left one's largest is positive. Fewer patterns come out where the
    covariance has a smaller rank; none for empty tables or a single step. Cells need not be the same on both sides.
    """
    steps = cut_lineage(x.where(F.col(value).isNotNull()).select(F.col(on).alias("step")).distinct().join(y.where(F.col(value).isNotNull()).select(F.col(on).alias("step")).distinct(), "step"))
    n_steps, width = steps.count(), k + extra
    a, b = (cut_lineage(_anomalies(t, steps, on, cell, value)) for t in (x, y))
    narrow, n = (_start(b.select("cell").distinct(), width, seed), width) if n_steps > 1 else (_start(b.select("cell").limit(0), width, seed), 0)
    for r in range(rounds + 1 if n else 0):
        if r:
            left_to_right = _times(b, cut_lineage(_times(a, narrow, "cell", "step", n)), "step", "cell", n)
            narrow, n = _orthonormal(left_to_right, "cell", n)
            if not n:
                break
        narrow, n = _orthonormal(_times(a, cut_lineage(_times(b, narrow, "cell", "step", n)), "step", "cell", n), "cell", n)
        if not n:
            break
    if not n:
        empty = a.select("cell", F.lit(0).alias("pattern"), F.col("v").alias("loading")).limit(0)
        return empty, b.select("cell", F.lit(0).alias("pattern"), F.col("v").alias("loading")).limit(0), []
    other = cut_lineage(_times(b, cut_lineage(_times(a, narrow, "cell", "step", n)), "step", "cell", n))
    values, vectors = np.linalg.eigh(_gram(other, n))
    order = [i for i in np.argsort(-values)[:k] if values[i] > 1e-20 * values.max()]
    strength = np.sqrt(values[order])
    left, right = _combined(narrow, "cell", vectors[:, order]), _combined(other, "cell", vectors[:, order] / strength)
    peak = left.agg(*[F.max_by(f"c{j}", F.struct(F.abs(f"c{j}"), "cell")).alias(f"c{j}") for j in range(len(order))]).first()
    signs = [1.0 if (peak[j] or 0.0) >= 0 else -1.0 for j in range(len(order))]
    long = lambda t: t.select("cell", F.posexplode(F.array(*[F.col(f"c{j}") * signs[j] for j in range(len(order))])).alias("pattern", "loading"))
    return long(left), long(right), (strength / (n_steps - 1)).tolist()


def principal_patterns(x: DataFrame, on: str, cell: str, value: str, k: int, **how) -> tuple[DataFrame, DataFrame, list[float]]:
    """(patterns, scores, variances) of one field: its leading empirical orthogonal functions (cell, pattern, loading), the
    projections of each step's anomalies on them (step, pattern, score), and the variances they explain."""
    patterns, _, variances = coupled_patterns(x, x, on, cell, value, k, **how)
    patterns = cut_lineage(patterns)
    steps = x.where(F.col(value).isNotNull()).select(F.col(on).alias("step")).distinct()
    scores = _anomalies(x, steps, on, cell, value).join(patterns, "cell").groupBy("step", "pattern").agg(F.sum(F.col("v") * F.col("loading")).alias("score"))
    return patterns, scores.withColumnRenamed("step", on), variances

