"""WARC archives: one gzip member per record, revisit records for repeated payloads, and a sequential reader.

Which records are revisits is decided by grouping (digest, length) pairs, without the payloads. Every task then writes
its pages into archives of its own and reports the finished ones; the reader takes archives from that report, so a file
of a lost or repeated attempt is never read. The reader inflates block by block, cuts records by gzip member and
Content-Length, and verifies every digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import file_system, fresh_path, map_slices, stored

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def members(stream, block_size: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    rest = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            block = rest or stream.read(block_size)
            rest = b""
            if not block:
                if parts:
                    raise ValueError("archive ends within a record")
                return
            parts.append(inflate.decompress(block))
        rest = inflate.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """Fields of one record; raises where framing or a digest is wrong."""
    head, _, body = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(fields["content-length"])
    block = body[:n]
    if not version.startswith("WARC/") or len(block) != n or body[n:] != b"\r\n\r\n":
        raise ValueError("bad record framing")
    if fields["warc-block-digest"] != "sha1:" + base32_sha1(block):
        raise ValueError("block digest does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and fields["warc-payload-digest"] != "sha1:" + base32_sha1(payload):
        raise ValueError("payload digest does not match")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(x[len(RECORD) + 1 : -1]) if x and len(x) > len(RECORD) + 2 else None
    url = fields.get("warc-target-uri")
    return {
        "page_id": number(fields["warc-record-id"]), "url": None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
        "record_type": fields["warc-type"], "payload_bytes": length, "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "refers_to": number(fields.get("warc-refers-to")), "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, where: str, min_revisit_bytes: int = 0, roll_bytes: int = 128 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``where``; one row per finished archive: path, n_records, n_bytes.

    Of equal payloads of at least ``min_revisit_bytes`` bytes, that with the smallest page_id becomes a response and the
    others revisit it. Null html is an empty payload, a null url has no Target-URI; a page without id never is referred
    to and stays a response; rows that repeat the smallest id with its payload all are responses. Other columns are ignored.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    digests = rows.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("n")).where("page_id is not null")
    shared = digests.where(F.col("n") >= min_revisit_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    revisits = digests.join(shared, ["digest", "n"]).where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    marked = rows.withColumn("digest", F.sha1("payload")).join(revisits, ["page_id", "digest"], "left").drop("digest")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        out, done, count = None, [], 0
        for frame in frames:
            for page_id, url, body, refers_to in zip(frame["page_id"], frame["url"], frame["payload"], frame["refers_to"]):
                if out is None:
                    path, count = f"{where}/{uuid.uuid4().hex}.warc.gz", 0
                    fs, local = file_system(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local, compression=None)
                out.write(record_bytes(None if pd.isna(page_id) else int(page_id), url, bytes(body), None if pd.isna(refers_to) else int(refers_to)))
                count += 1
                if out.tell() >= roll_bytes:
                    done.append((path, count, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((path, count, out.tell()))
            out.close()
        if done:
            yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes"])

    return stored(map_slices(marked, write, "path string, n_records bigint, n_bytes bigint"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to and the payload (null for revisits)."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * with_payload]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, want in zip(frame["path"], frame["n_records"]):
                fs, local = file_system(path)
                rows, held, count = [], 0, 0
                with fs.open_input_stream(local, compression=None) as stream:
                    for raw in members(stream):
                        record = parse_record(raw)
                        rows.append([record[k] for k in names])
                        held, count = held + len(raw), count + 1
                        if held > 8 << 20:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, names)
                if count != want:
                    raise ValueError(f"{path} holds {count} records where {want} were written")

    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * with_payload
    return map_slices(archives.select("path", "n_records").repartition(max(1, archives.count())), read, schema)


def _frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` and read the archives back, without payloads."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc"), min_revisit_bytes), with_payload=False)
