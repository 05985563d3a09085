"""Quality by a document classifier and hierarchical empirical Bayes over sites.

The classifier is a logistic regression on shares of byte classes and of neighbouring symbols, fitted on a bounded
sample of labelled documents. Each document's evidence (its label, or else the classifier's probability) is summed by
host and path. Host rates are shrunk towards the global rate and path rates towards their host's, with prior strengths
estimated from the spread between the groups beyond sampling noise, so that sparse sites say little. A document's score
adds its path's shift against the global rate to its own log odds; its own evidence is left out of its host's and path's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .shared import map_slices, stored

#: Labelled documents that the classifier is fitted on, those with the least hashes of their ids.
FIT_ROWS = 20_000
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" ", "line": b"\n\r\t", "stop": b".,;:", "bang": b"!?", "bar": b"|/\\", "quote": b"'\"()-"}
NAMES = [*CLASSES, "wide", "symbol", "after_symbol", "after_upper", "length"]
_LUT = np.full(256, len(CLASSES) + 1, np.uint8)
_LUT[128:] = len(CLASSES)
for _i, _s in enumerate(CLASSES.values()):
    _LUT[list(_s)] = _i


def features(text: str) -> np.ndarray:
    """Square roots of the shares of byte classes and of repeated symbol and capital neighbours, and the log length."""
    kind = _LUT[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    n = max(1, len(kind))
    counts = np.bincount(kind, minlength=len(CLASSES) + 2)[: len(CLASSES) + 2]
    odd = (kind == len(CLASSES) + 1) | (kind == 6) | (kind == 7)
    pairs = [np.count_nonzero(odd[1:] & odd[:-1]), np.count_nonzero((kind[1:] == 0) & (kind[:-1] == 0))]
    return np.append(np.sqrt(np.append(counts, pairs) / n), np.log1p(n) / 10)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression by Newton's method; zeros where ``y`` has one class only."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(x.shape[1] if x.ndim == 2 else len(NAMES)), 0.0
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack(((x - mean) / sd, np.ones(len(x))))
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] / sd) @ mean)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def prior_strength(groups: DataFrame, rate: Column) -> float:
    """Strength of a Beta prior around ``rate`` from groups (good, n) by moments: little spread gives a strong prior."""
    p = F.col("good") / F.col("n")
    big = groups.where("n > 1")
    row = big.agg(
        F.sum(F.col("n") * (p - rate) ** 2).alias("spread"), F.sum(rate * (1 - rate)).alias("noise"), F.sum("n").alias("n"),
        F.sum(F.col("n") * rate * (1 - rate)).alias("scale"),
    ).first()
    if not row.n:
        return 10.0
    between = (row.spread - row.noise) / row.n
    scale = row.scale / row.n
    return float(min(1e6, max(1.0, scale / between - 1))) if between > 1e-12 and scale > 0 else 1e6


def score_quality(
    docs: DataFrame, labels: DataFrame, host: Column | str = "source", path: Column | str = "lang", id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", threshold: float = 0.5, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One row per input row: id, doc_logit, host_rate, path_rate, score, keep.

    Null texts are empty; null hosts and paths form groups of their own. Labels that repeat an id count by their mean, null
    labels not at all. Without labels of both kinds all documents are alike and stay. Rows with a null id are scored
    without labels; rows that repeat an id are each scored. An empty table gives an empty result.
    """

    def run(frames):
        for frame in frames:
            yield frame.drop(columns="text").assign(x=[features(t) for t in frame["text"]])

    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(as_col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(as_col(path).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.avg(label_col).alias("label"))
    table = stored(map_slices(rows, run, "id bigint, host string, path string, x array<double>").join(marks, "id", "left"), "quality-features")
    sample = table.where("label is not null").select("x", "label", F.xxhash64("id").alias("h")).orderBy("h").limit(fit_rows).toPandas()
    x = np.array(sample["x"].tolist()) if len(sample) else np.zeros((0, len(NAMES)))
    weights, bias = fit(x, (sample["label"] >= 0.5).to_numpy(float))
    logit = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(bias), lambda s, v: s + v)
    scored = table.select("id", "host", "path", logit.alias("doc_logit"), "label")
    evidence = F.coalesce("label", 1 / (1 + F.exp(-F.col("doc_logit"))))
    paths = stored(scored.groupBy("host", "path").agg(F.sum(evidence).alias("good"), F.count("*").alias("n")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = (total.good / total.n) if total.n else 0.5
    strength = prior_strength(hosts, F.lit(rate))
    hosts = hosts.select("host", F.col("good").alias("host_good"), F.col("n").alias("host_n"), ((F.col("good") + strength * rate) / (F.col("n") + strength)).alias("host_rate"))
    under = stored(paths.join(hosts, "host"), "quality-rates")
    inner = prior_strength(under, F.col("host_rate"))
    rest = lambda good, n, k, prior: (F.col(good) - evidence + k * prior) / (F.col(n) - 1 + k)  # noqa: E731  without the document itself
    out = scored.join(under.drop("host_rate"), ["host", "path"]).withColumn("host_rate", rest("host_good", "host_n", strength, F.lit(rate)))
    out = out.withColumn("path_rate", rest("good", "n", inner, F.col("host_rate")))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("doc_logit") + _logit(F.col("path_rate")) - _logit(F.lit(rate))))))
    return out.select(F.col("id").alias(id_col), "doc_logit", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that :func:`score_quality` rejects; rows without id stay."""
    rejected = score_quality(docs, labels, id_col=id_col, **options).where("not keep").select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return docs.join(stored(rejected, "quality-rejected"), id_col, "left_anti").select(*docs.columns)
