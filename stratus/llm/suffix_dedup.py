"""Repeated byte strings over all documents by externally induced suffix sorting of shards.

A string of ``length`` bytes belongs to the least hashed gram in it (the leftmost of equal ones), which is the same
wherever the string occurs. Runs of strings with one such anchor form a region; an anchor seen once needs no sorting, and
regions seen twice whole, by a cryptographic hash of their bytes, repeat whole. What is left are different regions of one anchor: one text of each goes to the
anchor's shard, and every shard is suffix-sorted on its own, as two equal strings always meet in one shard. The sort
keeps text, arrays and queues of a large shard on disk. Regions that a task meets more than once go on as one, and their
places travel apart from their anchor, so a frequent passage loads no shard with its occurrences. An anchor with many
different regions is parted: strings are dealt by where the anchor lies in them, and by the bytes beside it that all of
a part's strings hold.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .induced_sort import Scratch, repeated_starts, spans
from .shared import freed, local_dir, map_slices, partitions_for, stored
from .shingles import U64, batches, powers, prefix_hash

LENGTH, GRAM = 200, 40
#: Positions of a piece fit into the low bits of the compared numbers.
PIECE_BITS = 20
HELD_ANCHORS, HELD_BYTES = 500_000, 8 << 20
#: Different regions from which on an anchor is parted, and the offsets of the anchor that a part holds.
HOT_REGIONS, PART = 4096, 20
#: Symbols of a shard, and bytes of input whose anchors meet in one bucket.
SHARD_SYMBOLS, BUCKET_BYTES = 2 << 20, 8 << 20
#: What tells the regions of one anchor apart: 80 bits of a cryptographic hash of their bytes.
DIGEST = np.dtype([("a", "<u8"), ("b", "<u2")])
KINDS = {"whole": 0, "sorted": 1, "match": 2}


def anchored_runs(data: np.ndarray, spans: list[tuple[int, int]], length: int = LENGTH, gram: int = GRAM, limit: int | None = None) -> tuple[np.ndarray, ...]:
    """(start, number of strings, hash of the anchor, digest of the region (in two columns), anchor after the start) of the runs of strings within ``spans`` that
    share one anchor; with ``limit``, of strings that start before it."""
    spans = [(a, b) for a, b in spans if b - a >= length]
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros((0, 2), U64), np.zeros(0, np.int64)
    n, w = len(data), length - gram + 1
    prefix = prefix_hash(data)
    h = (prefix[gram:] - prefix[:-gram]) * powers(n + 1)[1][: n - gram + 1]
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    low = U64((1 << PIECE_BITS) - 1)
    key = np.full(-(-len(h) // w) * w, ~U64(0))
    key[: len(h)] = (h & ~low) | np.arange(len(h), dtype=U64)
    rows = key.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    at = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & low).astype(np.int64)
    edge = np.zeros(m + 1, np.int8)
    for a, b in spans:
        edge[a] += 1
        edge[b - length + 1] -= 1
    valid = np.cumsum(edge[:m]) > 0
    moved = at[1:] != at[:-1]
    start = np.flatnonzero(valid & np.concatenate(([True], moved | ~valid[:-1])))
    count = np.flatnonzero(valid & np.concatenate((moved | ~valid[1:], [True]))) + 1 - start
    if limit is not None:
        keep = start < limit
        start, count = start[keep], np.minimum(count[keep], limit - start[keep])
    raw, last = data.tobytes(), (start + count + length - 1).tolist()
    digests = np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=DIGEST.itemsize).digest() for a, b in zip(start.tolist(), last)]), DIGEST)
    return start, count, h[at[start]], _two(digests), at[start] - start


def _two(digests: np.ndarray) -> np.ndarray:
    return np.stack((digests["a"], digests["b"].astype(U64)), axis=1)


def _runs(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, start in it, strings, anchor, region, anchor after the start) of all runs, piece by piece; texts longer than a piece overlap."""
    most = (1 << PIECE_BITS) - 1
    for a, b in batches(texts, min(1 << 19, most)):
        if len(texts[a]) > most:  # alone in its range
            step = most - length + 1
            for p in range(0, len(texts[a]) - length + 1, step):
                piece = np.frombuffer(texts[a][p : p + most], np.uint8)
                start, *rest = anchored_runs(piece, [(0, len(piece))], length, gram, step)
                yield np.full(len(start), a), start + p, *rest
            continue
        ends = np.cumsum([len(t) for t in texts[a:b]])
        begins = ends - [len(t) for t in texts[a:b]]
        start, *rest = anchored_runs(np.frombuffer(b"".join(texts[a:b]), np.uint8), list(zip(begins.tolist(), ends.tolist())), length, gram)
        doc = np.searchsorted(ends, start, "right")
        yield doc + a, start - begins[doc], *rest


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h * U64(0x9FB21C651E98DF25)) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def repeated_anchors(rows: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """Runs (key, start, n, anchor, offset, kind, hot) whose anchor occurs at least twice: 0 repeats whole; of regions that
    differ, one place each is to be sorted, for itself (1) or for the others' sake (2). ``hot``: the anchor has many."""

    def deal(frames):
        held, keys = [], []

        def flush():
            doc, start, n, h, r, off = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((r[:, 1], r[:, 0], h))
            doc, start, n, h, r, off = doc[order], start[order], n[order], h[order], r[order], off[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]).any(axis=1))))
            size = np.diff(np.append(new, len(h)))
            twice = np.flatnonzero(np.repeat(size > 1, size))
            # places of what repeats within the task, by document, and one of each region by anchor
            at = np.concatenate((twice, new))
            flag = np.concatenate((np.full(len(twice), 2), (size > 1).astype(np.int64))).astype("u1")
            bucket = np.concatenate((_bucket((doc[twice] * 2654435761 + start[twice]).astype(U64), buckets), _bucket(h[new], buckets)))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own, out = np.array(keys, np.int64), []
            for b in np.flatnonzero(np.diff(cuts)):
                i, f = at[order[cuts[b] : cuts[b + 1]]], flag[order[cuts[b] : cuts[b + 1]]]
                used, place = np.unique(doc[i], return_inverse=True)
                one = i[f < 2]  # places of repeats need neither anchor nor region
                digests = np.empty(len(one), DIGEST)
                digests["a"], digests["b"] = r[one, 0], r[one, 1]
                out.append((int(b), h[one].tobytes(), digests.tobytes(), place.astype("<u2").tobytes(), start[i].astype("<u4").tobytes(), n[i].astype("u1").tobytes(), off[one].astype("u1").tobytes(), f.tobytes(), own[used].tobytes()))
            return pd.DataFrame(out, columns=["bucket", "anchor", "region", "place", "start", "n", "off", "flag", "keys"])

        count = 0
        for frame in frames:
            texts, own = [t.encode("utf-8", "surrogatepass") for t in frame["text"]], frame["key"].tolist()
            for a in range(0, len(texts), 2048):
                base = len(keys)
                keys += own[a : a + 2048]
                for doc, *rest in _runs(texts[a : a + 2048], length, gram):
                    held.append((doc + base, *rest))
                    count += len(doc)
                if count >= HELD_ANCHORS or len(keys) > 65_535 - 2048:
                    if count:
                        yield flush()
                    held, keys, count = [], [], 0
        if count:
            yield flush()

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        cat = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in frame[c]])
        start, n, flag = cat("start", "<u4").astype(np.int64), cat("n", "u1").astype(np.int64), cat("flag", "u1")
        h, r, off = np.zeros(len(flag), U64), np.zeros((len(flag), 2), U64), np.zeros(len(flag), np.uint8)
        h[flag < 2], r[flag < 2], off[flag < 2] = cat("anchor", "<u8"), _two(cat("region", DIGEST)), cat("off", "u1")
        key = np.concatenate([np.frombuffer(k, "<i8")[np.frombuffer(p, "<u2")] for k, p in zip(frame["keys"], frame["place"])])
        i = np.flatnonzero(flag < 2)
        i = i[np.lexsort((r[i, 1], r[i, 0], h[i]))]
        new_h = np.concatenate(([True], h[i][1:] != h[i][:-1]))[: len(i)]
        new = new_h | np.concatenate(([True], (r[i][1:] != r[i][:-1]).any(axis=1)))[: len(i)]
        group, anchor = np.cumsum(new) - 1, np.cumsum(new_h) - 1
        times = np.bincount(group, weights=1 + flag[i]) if len(i) else np.zeros(0)
        different = np.bincount(anchor, weights=new)[anchor] if len(i) else np.zeros(0)
        often = times[group] > 1
        parts = [(np.flatnonzero(flag == 2), 0), (i[often], 0), (i[~often & (different > 1)], 1), (i[often & new & (different > 1)], 2)]
        at = np.concatenate([x for x, _ in parts])
        hot = np.zeros(len(h), bool)
        hot[i] = different > HOT_REGIONS
        kind = np.repeat([k for _, k in parts], [len(x) for x, _ in parts]).astype(np.int32)
        return pd.DataFrame({"key": key[at], "start": start[at], "n": n[at], "anchor": h[at].view(np.int64), "offset": off[at].astype(np.int32), "kind": kind, "hot": hot[at]})

    dealt = map_slices(rows, deal, "bucket int, anchor binary, region binary, place binary, start binary, n binary, off binary, flag binary, keys binary")
    return dealt.groupBy("bucket").applyInPandas(freed(join), "key bigint, start bigint, n bigint, anchor bigint, offset int, kind int, hot boolean")


def _parts(raw: bytes, start: int, n: int, offset: int, anchor: int, length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(start, strings, number that stands for the shared bytes) of the parts of a region of a frequent anchor.

    The anchor lies ``offset`` bytes into the first string, one less into the next, and so on. Strings of a part have it
    at one of ``PART`` offsets, so all of them hold the same bytes beside it, and equal strings lie in parts of one number.
    """
    at, i = start + offset, 0
    while i < n:
        j = (offset - i) // PART
        end = min(n, offset - j * PART + 1)
        last = min(length - gram, j * PART + PART - 1)
        shared = raw[at - j * PART : at + length - last]
        yield start + i, end - i, int.from_bytes(blake2b(shared, digest_size=8, salt=j.to_bytes(2), key=anchor.to_bytes(8, signed=True)).digest(), signed=True)
        i = end


def _regions(rows: DataFrame, runs: DataFrame, length: int, gram: int, shards: int) -> DataFrame:
    """Texts of the regions to be sorted, packed by shard."""

    def deal(frames):
        def pack():
            anchor, n, key, start, kind = (np.array(x, np.int64) for x in zip(*[h[1:] for h in held]))
            shard = _bucket(anchor.view(U64), shards)
            order = np.argsort(shard, kind="stable")
            out = []
            for i in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                out.append((int(shard[i[0]]), b"".join([held[k][0] for k in i.tolist()]), (n[i] + length - 1).astype("<u4").tobytes(), np.column_stack((key[i], start[i], kind[i])).astype("<i8").tobytes()))
            return pd.DataFrame(out, columns=["shard", "texts", "lengths", "places"])

        held, size = [], 0
        for frame in frames:
            for key, text, runs_ in zip(frame["key"].tolist(), frame["text"], frame["runs"]):
                raw = text.encode("utf-8", "surrogatepass")
                for r in runs_:
                    own = [(r["start"], r["n"], r["anchor"])]
                    for start, n, anchor in _parts(raw, *own[0][:2], r["offset"], r["anchor"], length, gram) if r["hot"] else own:
                        held.append((raw[start : start + n + length - 1], anchor, n, key, start, r["kind"]))
                        size += n + length + 150
                if size >= HELD_BYTES:
                    yield pack()
                    held, size = [], 0
        if held:
            yield pack()

    by_text = runs.where("kind > 0").groupBy("key").agg(F.collect_list(F.struct("start", "n", "anchor", "offset", "kind", "hot")).alias("runs"))
    joined = rows.join(by_text.hint("merge"), "key")  # places grow with the corpus
    return map_slices(joined, deal, "shard bigint, texts binary, lengths binary, places binary")


def _sorted_shard(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = local_dir()
        scratch, total = Scratch(folder), 0
        with tempfile.TemporaryFile(dir=folder) as symbols, tempfile.TemporaryFile(dir=folder) as about:
            for frame in frames:
                for raw, lengths, place in zip(frame["texts"], frame["lengths"], frame["places"]):
                    lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
                    text = np.ones(len(raw) + len(lengths), "<u2")  # each region ends with a 1, bytes are 2 and more
                    at = np.arange(len(raw)) + np.repeat(np.arange(len(lengths)), lengths)
                    text[at] = np.frombuffer(raw, np.uint8).astype(np.uint16) + 2
                    symbols.write(text.tobytes())
                    about.write(np.column_stack((total + np.cumsum(lengths + 1) - lengths - 1, lengths, np.frombuffer(place, "<i8").reshape(-1, 3))).tobytes())
                    total += len(text)
            if not total:
                return
            symbols.write(b"\0\0")
            for f in (symbols, about):
                f.flush()
            regions = np.memmap(about, "<i8", "r").reshape(-1, 5)  # where a region begins in the shard, its length and its place
            flags = repeated_starts(np.memmap(symbols, "<u2", "r"), length, scratch)
            for a, b in spans(len(regions)):
                begin, size, key, start, kind = np.array(regions[a:b]).T
                hit = np.concatenate((np.asarray(flags[begin[0] : begin[-1] + size[-1]]), [False])).astype(np.int8)
                begin = begin - begin[0]
                within = np.zeros(len(hit) + 1, np.int8)  # not over a region's end
                within[begin] += 1
                within[begin + size - length + 1] -= 1
                hit &= np.cumsum(within[:-1], dtype=np.int8)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
                first, last = edge[::2], edge[1::2]
                region = np.searchsorted(begin, first, "right") - 1
                rows = np.column_stack((key[region], start[region] + first - begin[region], last - first))[kind[region] == KINDS["sorted"]]
                if len(rows):
                    yield pd.DataFrame(rows, columns=["key", "start", "n"])

    return run


def covered(starts: np.ndarray, counts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under strings that begin at ``starts`` .. ``starts + counts - 1``."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], (starts + counts + length - 1)[order]
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], begin[1:] > reach[:-1]))
    return list(zip(begin[new].tolist(), reach[np.append(new[1:], True)].tolist()))


def whole_characters(raw: bytes, begin: int, end: int) -> tuple[int, int]:
    """The span without the parts of UTF-8 characters that it cuts."""
    while begin < end and raw[begin] & 0xC0 == 0x80:
        begin += 1
    while end > begin and end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return begin, end


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = (), characters: bool = False
) -> DataFrame:
    """One row per input row: id, ``keep`` columns, n_bytes, spans (array of begin, end), kept (binary: the other bytes).

    Every byte under a string of ``length`` bytes that also starts elsewhere, in the same text or another, is removed; all
    copies go. Strings are judged on the input. With ``characters`` a character that a span cuts stays whole, and ``kept``
    is a string. A null text is empty; texts shorter than ``length`` lose nothing; rows that repeat a text repeat its
    strings. Null ids stay null. An empty table gives an empty result. Rows are told apart by a 64-bit hash of id and text.
    """
    if not gram < length <= 255:
        raise ValueError("strings of more bytes than the gram and at most 255 are found")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).alias("id"), text.alias("text"), *[F.col(c).alias(f"_{c}") for c in keep])
    runs = stored(repeated_anchors(rows.select("key", "text"), length, gram, partitions_for(docs, BUCKET_BYTES)), "anchor-runs")
    symbols = runs.where("kind > 0").agg(F.sum((F.col("n") + length) * F.when(F.col("hot"), length // PART).otherwise(1))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-symbols // SHARD_SYMBOLS)))
    shards = _regions(rows, runs, length, gram, parts).repartition(parts, "shard")
    sorted_ = map_slices(shards, _sorted_shard(length), "key bigint, start bigint, n bigint", 16)
    found = sorted_.unionByName(runs.where("kind = 0").select("key", "start", "n"))
    by_row = found.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    joined = rows.join(by_row.hint("merge"), "key", "left")  # both tables of places grow with the corpus

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n_bytes, removed, kept = [], [], []
            for t, found_ in zip(frame["text"], frame["found"]):
                raw = t.encode("utf-8", "surrogatepass")
                hit = [] if found_ is None or not len(found_) else covered(np.array([x["start"] for x in found_]), np.array([x["n"] for x in found_]), length)
                hit = [whole_characters(raw, a, b) for a, b in hit] if characters else hit
                edges = [0, *(x for s in hit for x in s), len(raw)]
                n_bytes.append(len(raw))
                removed.append([{"begin": a, "end": b} for a, b in hit])
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(left.decode("utf-8", "surrogatepass") if characters else left)
            yield frame.drop(columns=["key", "text", "found"]).assign(n_bytes=n_bytes, spans=removed, kept=kept)

    fields = {f.name: f.dataType.simpleString() for f in joined.schema}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in joined.columns if c not in ("key", "text", "found")] + ["n_bytes bigint", "spans array<struct<begin:bigint,end:bigint>>", f"kept {'string' if characters else 'binary'}"])
    out = map_slices(joined, cut, schema)
    return out.select(F.col("id").alias(id_col), *[F.col(f"_{c}").alias(c) for c in keep], "n_bytes", "spans", "kept")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x.end - x.begin)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
