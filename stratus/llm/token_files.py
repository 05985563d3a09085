"""Token ids in flat binary files with 64-bit document offsets.

Documents are encoded where they lie and dealt by ranges of their ids, whose bounds are quantiles of the ids. Every range is
written as three files: ``.ids`` (unsigned integers, 16 or 32
bits wide by the size of the vocabulary), ``.off`` (int64 offsets of the documents, one more than there are documents)
and ``.doc`` (int64 document ids). A table of the finished files, one row a partition, gives the partitions' bases as
prefix sums; files of lost or repeated attempts are in no table and are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import file_system, fresh_path, map_slices, partitions_for, stored

#: The part of the rows without an id.
NO_ID = 0


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, where: str, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Write the files below ``where``; one row per file: part, path, width, n_docs, n_tokens.

    Null texts are empty (their only id is the end id); rows with a null id come first; rows of one id are in the order of
    their ids' bytes. A special token's string in a text gives that token, as in the library, or with ``special_as_text``
    ordinary ids. An empty table gives no files.
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .word_encoder import word_encoder

        for frame in frames:
            encoder = word_encoder(tokenizer, special_as_text)
            end = np.array([end_id], encoder.dtype).tobytes()
            part = [NO_ID if pd.isna(x) else 1 + int(np.searchsorted(bounds, x)) for x in frame["id"]]
            yield pd.DataFrame({"part": part, "id": frame["id"], "ids": [x + end for x in encoder.encode(frame["text"].tolist())], "width": np.int32(encoder.dtype.itemsize)})

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        part, out = None, None

        def finished() -> pd.DataFrame:
            out.close()
            for name, values in ((".off", offsets), (".doc", doc_ids)):
                with fs.open_output_stream(local + name) as f:
                    f.write(np.array(values, "<i8").tobytes())
            return pd.DataFrame({"part": [part], "path": [path], "width": [width], "n_docs": [len(doc_ids)], "n_tokens": [offsets[-1]]})

        for frame in frames:
            for p, rows in frame.groupby("part"):  # rows come sorted by it
                if p != part:
                    if out is not None:
                        yield finished()
                    part, width, offsets, doc_ids = int(p), int(rows["width"].iloc[0]), [0], []
                    path = f"{where}/part-{part:06d}-{uuid.uuid4().hex}"
                    fs, local = file_system(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local + ".ids")
                for x in rows["ids"]:
                    out.write(x)
                    offsets.append(offsets[-1] + len(x) // width)
                doc_ids += [0 if pd.isna(x) else int(x) for x in rows["id"]]
        if out is not None:
            yield finished()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = partitions_for(docs, 16 << 20)
    ask = F.percentile_approx("id", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(10 * parts)) if parts > 1 else F.lit(None)
    bounds = np.array(rows.agg(ask.alias("b")).first().b or [], np.int64)
    encoded = map_slices(rows, encode, "part int, id bigint, ids binary, width int", 1024)
    ordered = encoded.repartition(parts, "part").sortWithinPartitions("part", "id", "ids")
    return stored(map_slices(ordered, write, "part int, path string, width int, n_docs bigint, n_tokens bigint", 2048), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Documents as the files hold them: id, start (ids of all documents before it), n_tokens, ids (binary, as stored),
    ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers), width."""
    spark = files.sparkSession
    rows = sorted(files.collect(), key=lambda r: r.part)  # one row a partition
    bases = [0, *accumulate(r.n_tokens for r in rows)]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, width, base, part in zip(frame["path"], frame["width"], frame["base"], frame["part"]):
                fs, local = file_system(path)
                with fs.open_input_file(local + ".off") as f:
                    off = np.frombuffer(f.read(), "<i8")
                with fs.open_input_file(local + ".doc") as f:
                    doc = np.frombuffer(f.read(), "<i8")
                if fs.type_name == "local":
                    ids = np.memmap(local + ".ids", f"<u{width}", "r")
                    get = lambda a, b: ids[a:b]
                else:
                    f = fs.open_input_file(local + ".ids")
                    get = lambda a, b: np.frombuffer(f.read_at((b - a) * width, a * width), f"<u{width}")
                i = 0
                while i < len(doc):
                    j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 20), "right")) - 1)
                    j = min(j, len(doc))
                    block = get(off[i], off[j])
                    yield pd.DataFrame({
                        "id": pd.array([None] * (j - i) if part == NO_ID else doc[i:j], "Int64"),
                        "start": off[i:j] + base,
                        "n_tokens": np.diff(off[i : j + 1]),
                        "ids": [block[a:b].tobytes() for a, b in zip(off[i:j] - off[i], off[i + 1 : j + 1] - off[i])],
                        "ids_crc32": [zlib.crc32(block[a:b].astype("<u4")) for a, b in zip(off[i:j] - off[i], off[i + 1 : j + 1] - off[i])],
                        "width": np.int32(width),
                    })
                    i = j

    listed = spark.createDataFrame([(r.path, r.width, b, r.part) for r, b in zip(rows, bases)], "path string, width int, base bigint, part int").repartition(max(1, len(rows)))
    return map_slices(listed, read, "id bigint, start bigint, n_tokens bigint, ids binary, ids_crc32 bigint, width int")


def token_file_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32."""
    where = fresh_path(docs.sparkSession, "tokens")
    back = read_token_files(write_token_files(docs, tokenizer, end_id, where))
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
