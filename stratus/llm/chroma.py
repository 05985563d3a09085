"""Audio fingerprints from pitch classes, and the alignment of recordings.

Overlapping frames of a recording are folded into twelve pitch classes and smoothed over time. Sixteen rectangle filters
on the integral image of a sliding window of frames, each coded in two bits, give one 32-bit integer a frame. Two
recordings align where most of their equal integers agree on one offset; the share of different bits over the overlap
then tells whether they are the same music. Recordings with equal fingerprints form a class and are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import map_slices, small_batches, stored

RATE, FRAME, HOP, WINDOW = 2000, 1024, 256, 16
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Filter responses at which the code of a filter changes.
EDGES = np.array([-0.08, 0.0, 0.08])
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: An alignment counts from this overlap on, and up to this share of different bits.
LEAST_OVERLAP, MOST_ERRORS = 8, 0.15


def filters() -> list[tuple[int, int, int, int, int]]:
    """(kind, first pitch class, pitch classes, first frame, frames) of the sixteen filters."""
    return [(i % 4, (5 * i) % 9, 3 + i % 2, (3 * i) % 5, (4, 8, 10)[i % 3]) for i in range(16)]


def pitch_classes(sound: np.ndarray) -> np.ndarray:
    """Smoothed, normalised energies of the twelve pitch classes, a row a frame."""
    n = (len(sound) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.as_strided(sound, (n, FRAME), (sound.strides[0] * HOP, sound.strides[0]))
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = np.flatnonzero(hertz > 55)
    of = np.round(12 * np.log2(hertz[use] / 440)).astype(int) % 12
    energy = power[:, use] @ np.eye(12)[of]
    padded = np.vstack((energy[:1].repeat(2, 0), energy, energy[-1:].repeat(2, 0)))
    smooth = sum(w * padded[k : k + n] for k, w in enumerate(SMOOTH))
    return smooth / np.maximum(np.linalg.norm(smooth, axis=1, keepdims=True), 1e-9)


def fingerprint(sound: np.ndarray) -> np.ndarray:
    """32-bit integers of a mono recording at ``RATE``; none where it is shorter than a window."""
    chroma = pitch_classes(sound.astype(np.float64))
    n = len(chroma) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    area = np.zeros((len(chroma) + 1, 13))
    area[1:, 1:] = chroma.cumsum(0).cumsum(1)
    at = np.arange(n)
    box = lambda t, k, p, q: area[at + t + k, p + q] - area[at + t, p + q] - area[at + t + k, p] + area[at + t, p]
    out = np.zeros(n, np.uint32)
    for i, (kind, p, q, t, k) in enumerate(filters()):
        half_q, half_k = q // 2, k // 2
        whole = box(t, k, p, q)
        if kind == 0:
            a = box(t, k, 0, 12) / 12 * q
            b = whole
        elif kind == 1:
            b = box(t, k, p, half_q)
            a = whole - b
        elif kind == 2:
            b = box(t, half_k, p, q)
            a = whole - b
        else:
            b = box(t, half_k, p, half_q) + box(t + half_k, k - half_k, p + half_q, q - half_q)
            a = whole - b
        out |= GRAY[np.searchsorted(EDGES, np.log((1 + a) / (1 + b)))] << np.uint32(2 * i)
    return out


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(overlap, different bits) where ``b`` begins ``offset`` frames into ``a``."""
    x, y = (a[offset:], b) if offset >= 0 else (a, b[-offset:])
    n = max(0, min(len(x), len(y)))
    return n, int(np.bitwise_count(x[:n] ^ y[:n]).sum())


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """One row per input row: id, print (binary, unsigned 32-bit integers). The audio is 16-bit mono PCM at ``RATE``;
    null audio has an empty print."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "print": [b"" if a is None else fingerprint(np.frombuffer(a[: len(a) // 2 * 2], "<i2")).tobytes() for a in frame["audio"]]})

    return media.select(F.col(id_col).cast("bigint").alias("id"), F.col(audio_col).alias("audio")).transform(map_slices, run, "id bigint, print binary", 64)


def align(media: DataFrame, id_col: str = "id", audio_col: str = "audio", every: int = 20) -> DataFrame:
    """Recordings by class, and what each queried class aligns with: kind, rec_id, other_id, frames, overlap, bit_errors.

    ``member`` rows give each recording's class (its smallest id, or itself where the print is empty). The queries are the
    recordings whose id ``every`` divides; for each class that holds one, a ``match`` row for every other class with an
    alignment of at least ``LEAST_OVERLAP`` frames and at most ``MOST_ERRORS`` different bits, at the offset where most
    equal integers meet (the smaller of tied ones). Rows with a null id are left out; repeated ids count once.
    """

    @F.pandas_udf("array<bigint>")
    def codes(prints: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(p, "<u4").astype(np.int64) for p in prints])

    @F.pandas_udf("overlap bigint, bit_errors bigint")
    def compared(a: pd.Series, b: pd.Series, offset: pd.Series) -> pd.DataFrame:
        rows = [bit_errors(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), int(o)) for x, y, o in zip(a, b, offset)]
        return pd.DataFrame(rows, columns=["overlap", "bit_errors"])

    with small_batches(media.sparkSession, 64):
        prints = stored(fingerprints(media.where(F.col(id_col).isNotNull()), id_col, audio_col), "prints")
    classes = stored(prints.where("length(print) > 0").groupBy("print").agg(F.min("id").alias("cls"), F.max((F.col("id") % every == 0).cast("int")).alias("asked")), "print-classes")
    members = prints.join(classes, "print", "left").select("id", F.coalesce("cls", "id").alias("cls")).distinct()
    index = classes.select("cls", "asked", F.posexplode(codes("print")).alias("at", "code"))
    asked = index.where("asked = 1").select(F.col("cls").alias("q"), F.col("at").alias("q_at"), "code")
    hits = asked.join(index.select("cls", "at", "code"), "code").where("q <> cls")
    counts = hits.groupBy("q", "cls", (F.col("q_at") - F.col("at")).alias("offset")).count()
    best = counts.groupBy("q", "cls").agg(F.max_by("offset", F.struct("count", -F.col("offset"))).alias("offset"))
    pair = best.join(classes.select(F.col("cls").alias("q"), F.col("print").alias("a")), "q").join(classes.select("cls", F.col("print").alias("b")), "cls")
    pair = pair.select("q", "cls", "offset", compared("a", "b", "offset").alias("r")).select("q", "cls", "offset", "r.*")
    good = pair.where((F.col("overlap") >= LEAST_OVERLAP) & (F.col("bit_errors") <= MOST_ERRORS * 32 * F.col("overlap")))
    none = F.lit(None).cast("bigint")
    match = good.select(F.lit("match").alias("kind"), F.col("q").alias("rec_id"), F.col("cls").alias("other_id"), F.col("offset").cast("bigint").alias("frames"), "overlap", "bit_errors")
    return members.select(F.lit("member").alias("kind"), F.col("id").alias("rec_id"), F.col("cls").alias("other_id"), none.alias("frames"), none.alias("overlap"), none.alias("bit_errors")).unionByName(match)


NOTE, NOTES, HEARD = 2 * HOP, 32, 24


def recordings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Media rows (id, audio) from vectors: neighbouring values are the angles of a melody's notes, and each recording
    holds ``HEARD`` of ``NOTES`` notes from a place that its id gives, so that like vectors are excerpts at offsets."""

    def run(frames):
        pitch = 220 * 2 ** (np.arange(12) / 12)
        sounds = (12000 * np.sin(2 * np.pi * pitch[:, None] * np.arange(NOTE) / RATE)).astype("<i2")
        for frame in frames:
            audio = []
            for i, v in zip(frame["id"], frame["vector"]):
                v = np.zeros(2) if v is None or len(v) < 2 else np.asarray(v, np.float64)
                angle = np.resize(np.arctan2(v[1::2][: len(v) // 2], v[: len(v) // 2 * 2 : 2]), NOTES)
                first = 0 if pd.isna(i) else int(i) % (NOTES - HEARD + 1)
                audio.append(sounds[np.floor(angle / (2 * np.pi) * 12).astype(int) % 12][first : first + HEARD].tobytes())
            yield pd.DataFrame({"id": frame["id"], "audio": audio})

    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).transform(map_slices, run, "id bigint, audio binary", 64)
