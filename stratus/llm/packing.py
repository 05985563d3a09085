"""Packing along a space-filling curve.

Each document's ids give a hashed count vector, which fixed random directions project to a few numbers; their ranks
along a Hilbert curve put similar documents side by side. The documents are range-sorted by that key, laid end to end
and cut at every ``length`` ids, so that the only short sequences are at the very end: the last ids are cut into
sequences whose lengths are powers of two, which need no padding either. Positions are prefix sums: a running sum in
each range partition, and one base for each partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import map_slices, stored

BUCKETS, DIMS, BITS, SEED = 4096, 4, 15, 20240101


def _directions() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def project(ids: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A document's unit count vector over hashed ids, on the fixed directions."""
    if not len(ids):
        return np.zeros(DIMS, np.float32)
    counts = np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS).astype(np.float32)
    return counts @ directions / np.float32(np.sqrt(counts @ counts))


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of unsigned cells; the bits go to one int64."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tail_cuts(total: int, length: int) -> list[int]:
    """Where sequences begin after the last full one, and the end of all ids."""
    at, left, cuts = total // length * length, total % length, []
    while left:
        cuts.append(at)
        size = 1 << (left.bit_length() - 1)
        at, left = at + size, left - size
    return [*cuts, total]


def pieces(first: int, n: int, cuts: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a document whose ids begin at ``first``."""
    at, end, full = first, first + n, cuts[-1] // length
    while at < end:
        if at < full * length:
            seq, begin, stop = at // length, at // length * length, at // length * length + length
        else:
            k = int(np.searchsorted(cuts, at, "right")) - 1
            seq, begin, stop = full + k, cuts[k], cuts[k + 1]
        size = min(end, stop) - at
        yield at - first, size, seq, at - begin
        at += size


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids (binary), width, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id, so null and empty texts have one id. Documents of one key are ordered by id,
    then by the place of their row in the input. Repeated rows are packed each; an empty table gives no pieces. A special
    token's string in a text gives that token, as in the library, or with ``special_as_text`` ordinary ids.
    """
    spark = docs.sparkSession

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .word_encoder import word_encoder

        directions = _directions()
        for frame in frames:
            encoder = word_encoder(tokenizer, special_as_text)
            width = encoder.dtype.itemsize
            end = np.array([end_id], encoder.dtype).tobytes()
            ids = [x + end for x in encoder.encode(frame["text"].tolist())]
            at = [project(np.frombuffer(x, encoder.dtype)[:-1], directions) for x in ids]
            yield pd.DataFrame({"id": frame["id"], "row": frame["row"], "n": [len(x) // width for x in ids], "at": at, "ids": ids, "width": np.int32(width)})

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = stored(map_slices(rows, tokens, "id bigint, row bigint, n bigint, at array<float>, ids binary, width int", 1024), "pack-ids")

    spread = table.agg(*[f(F.col("at")[d]).alias(f"{k}{d}") for d in range(DIMS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    middle = [spread[f"m{d}"] or 0.0 for d in range(DIMS)]
    width = [spread[f"s{d}"] or 1.0 for d in range(DIMS)]

    @F.pandas_udf("bigint")
    def curve(at: pd.Series) -> pd.Series:
        z = (np.stack(at.to_numpy()).astype(np.float64) - middle) / width
        cells = np.clip(1 / (1 + np.exp(-1.702 * z)), 0, 1 - 1e-9) * (1 << BITS)
        return pd.Series(hilbert_key(cells.astype(np.int64)))

    def running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at = 0
        for frame in frames:
            ends = at + np.cumsum(frame["n"].to_numpy())
            yield pd.DataFrame({"part": np.int32(TaskContext.get().partitionId()), "row": frame["row"], "first": ends - frame["n"].to_numpy(), "n": frame["n"]})
            at = int(ends[-1]) if len(ends) else at

    order = table.select("id", "row", "n", curve("at").alias("key")).repartitionByRange("key", "id", "row").sortWithinPartitions("key", "id", "row")
    placed = stored(order.select("row", "n").mapInPandas(running, "part int, row bigint, first bigint, n bigint"), "pack-order")
    sums = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a partition
    bases = dict(zip([p for p, _ in sums], accumulate([0, *(n for _, n in sums)])))
    cuts = tail_cuts(sum(n for _, n in sums), length)
    base = spark.createDataFrame([*bases.items()], "part int, base bigint")
    placed = placed.join(base, "part").select("row", (F.col("first") + F.col("base")).alias("first"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, n, ids, w, first in zip(frame["id"], frame["n"], frame["ids"], frame["width"], frame["first"]):
                for s, k, seq, off in pieces(int(first), int(n), cuts, length):
                    piece = ids[s * w : (s + k) * w]
                    out.append((doc, s, k, piece, w, zlib.crc32(np.frombuffer(piece, f"<u{w}").astype("<u4")), n, seq, off))
            names = ["id", "start", "length", "ids", "width", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            ids_ = pd.array([None if pd.isna(r[0]) else int(r[0]) for r in out], "Int64")
            yield pd.DataFrame([r[1:] for r in out], columns=names[1:]).assign(id=ids_)[names]

    whole = table.select("id", "row", "n", "ids", "width").join(placed.hint("merge"), "row")  # places grow with the corpus
    packed = map_slices(whole, cut, "id bigint, start bigint, length bigint, ids binary, width int, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("id", id_col)


def packed_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """:func:`pack` without the ids."""
    out = pack(docs, tokenizer, end_id, length)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
