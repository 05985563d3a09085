"""Near duplicates by an exact Jaccard join of word shingles on parity sketches.

Two sets that reach the threshold differ in at most ``(a + b) * (1 - t) / (1 + t)`` shingles. For each size band a set is
dealt into more blocks than that by its shingles' hashes, and each block keeps the XOR of them, its parity in a wide
bit sketch. A shingle in only one of two sets changes one block, so at least one block of a linked pair is equal:
blocks join the pairs. A block without shingles says nothing; sets with as many empty blocks as a linked pair may have
equal ones are keyed by a prefix of their sorted hashes as well, so no pair is lost. Narrow parity sketches, four bits a
shingle, then bound each candidate's symmetric difference from below, and what passes is verified on the whole sets.

Components do not need every link. Copies of one set are one node. Each key's smallest document is tied to the others,
and so is the one that shares most with others, which variants of one text have in common; every document verifies its
most frequent ties first. Only pairs whose documents are then still in different components are looked at again, in
blocks, and verified. Nothing is left out.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stratus.operators.graph import connected_components

from .shared import Tables, freed, map_slices, partitions_for
from .shingles import U64, batches, mix, shingle_sets

#: Empty blocks are allowed for by this share more blocks.
SLACK = 0.12
#: Keys that a task holds before it hands them on, members in a row of a key's group, and members compared at once.
HELD_KEYS, ROW_MEMBERS, BLOCK_MEMBERS = 1_000_000, 16_384, 512
#: Bytes of input whose keys meet in one bucket; members of open keys with one lead that do, and of all such keys.
BUCKET_BYTES, SHARE_MEMBERS, BUCKET_MEMBERS = 1 << 20, 8_192, 4_096


def bands(percent: int, largest: int) -> np.ndarray:
    """First sizes of the bands; linked sets lie in one band or in two neighbouring ones."""
    out = [1, 2]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, 100 * (out[-1] - 1) // percent + 1))
    return np.array([*out, max(out[-1] + 1, 100 * (out[-1] - 1) // percent + 1)])


def most_different(a: int, b: int, percent: int) -> int:
    return (a + b) * (100 - percent) // (100 + percent)


def level_blocks(band: int, lows: np.ndarray, percent: int) -> tuple[int, int]:
    """(blocks, most shingles that differ) for pairs whose smaller set lies in ``band``."""
    a = int(lows[band + 1]) - 1
    d = most_different(a, min(100 * a // percent, int(lows[band + 2]) - 1), percent)
    return d + 1 + int(np.ceil(SLACK * d)), d


def set_keys(hashes: np.ndarray, lows: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of one sorted set."""
    s = len(hashes)
    band = int(np.searchsorted(lows, s, "right")) - 1
    out = []
    for level in (band, band - 1) if band else (band,):
        blocks, d = level_blocks(level, lows, percent)
        at = ((hashes >> U64(32)) * U64(blocks)) >> U64(32)
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        parity = np.bitwise_xor.reduceat(hashes, start)
        out.append(mix(parity ^ mix(at[start] * U64(2) + (U64(level) << U64(40)))))
        if blocks - len(start) >= blocks - d:
            prefix = hashes[: s - (percent * s + 99) // 100 + 1]
            out.append(mix(prefix ^ mix(np.array([(level << 40) | 1], U64))))
    return np.concatenate(out)


def sketch(hashes: np.ndarray) -> bytes:
    """Parity of the shingles on each bit; at least four bits a shingle, a power of two of them."""
    if not len(hashes):
        return b""
    bits = max(64, 1 << int(4 * len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to ``size`` words."""
    while words.shape[1] > size:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def may_link(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (100 * low >= percent * high) & (differ <= (n_a + n_b) * (100 - percent) // (100 + percent))


def _texts(frame: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in frame["text"]]


def _split(doc: np.ndarray, hashes: np.ndarray, n: int) -> list[np.ndarray]:
    cuts = np.searchsorted(doc, np.arange(n + 1))
    return [hashes[a:b] for a, b in zip(cuts, cuts[1:])]


def _sets(frames: Iterator[pd.DataFrame], width: int, key: tuple[int, int]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for frame in frames:
        texts = _texts(frame)
        ids = [None if pd.isna(x) else int(x) for x in frame["doc_id"]]
        for a, b in batches(texts):
            yield ids[a:b], _split(*shingle_sets(texts[a:b], width, key), b - a)


def set_digest(h: np.ndarray) -> bytes:
    return (int(np.add.reduce(mix(h ^ U64(1)))) << 64 | int(np.bitwise_xor.reduce(mix(h)))).to_bytes(16, "little")


def shingle_info(docs: DataFrame, width: int, key: tuple[int, int] = (1, 2)) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sketch: one row per input row."""

    def run(frames):
        for ids, sets in _sets(frames, width, key):
            digest = [set_digest(h) if len(h) else b"" for h in sets]
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_shingles": [len(h) for h in sets], "digest": digest, "sketch": [sketch(h) for h in sets]})

    return map_slices(docs, run, "doc_id bigint, n_shingles bigint, digest binary, sketch binary")


def key_groups(docs: DataFrame, width: int, percent: int, largest: int, buckets: int, key: tuple[int, int] = (1, 2)) -> DataFrame:
    """Ties ``(lead, member, n)`` and, for keys of three documents or more, ``(lead, grp, members)``, in as many rows as need be;
    ``lead`` is a key's smallest document."""
    lows = bands(percent, largest)

    secret = key

    def keys(frames):
        held, count, known, ids = [], 0, set(), []

        def flush():
            key, idx = np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held])
            order = np.argsort(key)
            key, idx = key[order], idx[order]
            bucket = ((key >> U64(32)) * U64(buckets)) >> U64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            own = np.array(ids, np.int64)
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                a, z = cuts[b], cuts[b + 1]
                used, place = np.unique(idx[a:z], return_inverse=True)
                rows.append((int(b), key[a:z].astype("<u4").tobytes(), place.astype("<u2").tobytes(), own[used].astype("<i8").tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "keys", "place", "docs"])

        for some, sets in _sets(frames, width, secret):
            for doc_id, h in zip(some, sets):
                if doc_id is None or not len(h):
                    continue
                mark = (hash(h.tobytes()), len(h), h[0], h[-1])
                if mark in known:  # a copy within the task; classes of copies are tied by their digests
                    continue
                known.add(mark)
                k = set_keys(h, lows, percent)
                held.append((k, np.full(len(k), len(ids), np.uint16)))
                ids.append(doc_id)
                count += len(k)
                if count >= HELD_KEYS or len(ids) == 65_535:
                    yield flush()
                    held, count, ids = [], 0, []
            if len(known) > 1_000_000:
                known.clear()
        if held:
            yield flush()

    def groups(frame: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(x, "<u4") for x in frame["keys"]])
        doc = np.concatenate([np.frombuffer(d, "<i8")[np.frombuffer(p, "<u2")] for d, p in zip(frame["docs"], frame["place"])])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        key, doc = key[new], doc[new]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        many = size > 1
        names = ["lead", "member", "n", "grp", "members"]
        if not many.any():
            return pd.DataFrame({c: pd.Series([], dtype=object if c == "members" else "Int64") for c in names})
        keep = np.repeat(many, size)
        doc, size = doc[keep], size[many]
        start = np.cumsum(size) - size
        lead = np.repeat(doc[start], size)
        pair = np.stack((lead, doc))[:, lead != doc]
        order = np.lexsort(pair)
        pair = pair[:, order]
        first = np.flatnonzero(np.concatenate(([True], (pair[:, 1:] != pair[:, :-1]).any(0))))
        ties = pd.DataFrame({"lead": pair[0, first], "member": pair[1, first], "n": np.diff(np.append(first, pair.shape[1]))})
        name = np.add.reduceat(mix(doc.view(U64)), start)
        _, one = np.unique(name, return_index=True)
        one = one[size[one] > 2]
        rows = [(doc[start[i]], name[i].view(np.int64), doc[start[i] + a : start[i] + min(size[i], a + ROW_MEMBERS)]) for i in one for a in range(0, size[i], ROW_MEMBERS)]
        sets = pd.DataFrame({"lead": [int(x) for x, _, _ in rows], "grp": [int(g) for _, g, _ in rows], "members": [m for _, _, m in rows]}, columns=["lead", "grp", "members"])
        out = pd.concat([ties.assign(members=None), sets], ignore_index=True)
        out["members"] = pd.Series([None if isinstance(m, float) else m for m in out["members"]], dtype=object)
        return out.astype({"lead": "Int64", "member": "Int64", "n": "Int64", "grp": "Int64"})[names]

    dealt = map_slices(docs.where("doc_id is not null"), keys, "bucket int, keys binary, place binary, docs binary")
    return dealt.groupBy("bucket").applyInPandas(freed(groups), "lead bigint, member bigint, n bigint, grp bigint, members array<bigint>")


def _close(percent: int):
    @F.pandas_udf("boolean")
    def close(n_a: pd.Series, n_b: pd.Series, s_a: pd.Series, s_b: pd.Series) -> pd.Series:
        differ = np.zeros(len(n_a), np.int64)
        for i, (x, y) in enumerate(zip(s_a, s_b)):
            x, y = np.frombuffer(x, "<u8")[None], np.frombuffer(y, "<u8")[None]
            size = min(x.shape[1], y.shape[1])
            differ[i] = np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()
        return pd.Series(may_link(n_a.to_numpy(), n_b.to_numpy(), differ, percent))

    return close


def _linked(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _two(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable over links of at least ``percent``).

    Texts without words have no shingles and are in a component of their own, as are documents without links. A null
    text counts as empty. Rows with a null id are never linked and have a null component; rows that repeat an id are one
    node. An empty table gives an empty result. Other columns are ignored.
    """
    return _near_duplicates(docs, id_col, text_col, width, percent, Tables(docs.sparkSession))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, tables: Tables) -> DataFrame:
    stored, key = tables.stored, (secrets.randbits(64), secrets.randbits(64))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    info = stored(shingle_info(rows, width, key), "shingle-info")
    known = info.where("doc_id is not null and n_shingles > 0")
    largest = known.agg(F.max("n_shingles")).first()[0] or 1
    twice = stored(known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id"), "shingle-twice")
    if not twice.isEmpty():
        return _with_repeated_ids(rows, twice, width, percent, tables).withColumnRenamed("doc_id", id_col)
    classes = stored(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "shingle-classes")
    copies = stored(known.select("doc_id", "digest").join(classes, "digest").where("doc_id <> rep").select("doc_id", "rep").distinct(), "shingle-copies")
    of = lambda df, c: df.join(copies.select(F.col("doc_id").alias(c), F.col("rep").alias("__rep")), c, "left").withColumn(c, F.coalesce("__rep", c)).drop("__rep")

    found = stored(key_groups(rows, width, percent, largest, partitions_for(docs, BUCKET_BYTES), key), "shingle-groups")
    ties = found.where("member is not null").groupBy("lead", "member").agg(F.sum("n").alias("n"))
    ties = of(of(ties, "lead"), "member").where("lead <> member").select(*_two(F.col("lead"), F.col("member")), "n")
    about = known.select("doc_id", F.col("n_shingles").alias("size"), "sketch").dropDuplicates(["doc_id"])
    side = lambda c: about.select(F.col("doc_id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    close = _close(percent)
    ties = ties.groupBy("a", "b").agg(F.sum("n").alias("n")).join(side("a"), "a").join(side("b"), "b")
    ties = stored(ties.where(close("size_a", "size_b", "sketch_a", "sketch_b")).select("a", "b", "n"), "shingle-ties")

    wanted = stored(ties.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "shingle-wanted")
    sets = stored(_set_table(rows, wanted, width, key), "shingle-sets")
    tried = stored(_verified(_best(ties), sets, percent), "shingle-tried")
    pivots = stored(_pivot_ties(found, of).join(side("a"), "a").join(side("b"), "b").where(close("size_a", "size_b", "sketch_a", "sketch_b")).select("a", "b", "n"), "shingle-pivots")
    more = _best(pivots).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    missing = stored(more.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(wanted, "doc_id", "left_anti"), "shingle-missing")
    if not missing.isEmpty():
        sets, wanted = sets.unionByName(stored(_set_table(rows, missing, width, key), "shingle-sets")), wanted.unionByName(missing)
    tried = tried.unionByName(stored(_verified(more, sets, percent), "shingle-tried"))
    links = tried.where("linked").select("a", "b")
    parts = stored(_components(links, tables), "shingle-parts")

    tables.drop(classes)
    whole = lambda df, c: df.join(parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")), c, "left").withColumn(f"part_{c}", F.coalesce(f"part_{c}", c))
    apart = whole(whole(ties.unionByName(pivots).select("a", "b"), "a"), "b").where("part_a <> part_b").select("a", "b")
    again = apart.unionByName(_across(found, of, whole, about, percent, stored)).distinct()
    again = stored(again.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "shingle-again")
    if not again.isEmpty():
        missing = stored(again.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(wanted, "doc_id", "left_anti"), "shingle-missing")
        if not missing.isEmpty():
            sets = sets.unionByName(_set_table(rows, missing, width, key))
        more = stored(_verified(again, sets, percent).where("linked").select("a", "b"), "shingle-more")
        parts = stored(_components(links.unionByName(more), tables), "shingle-parts")
    tables.drop(keep=(info, copies, parts))
    out = of(info.select("doc_id", "n_shingles").withColumn("rep", F.col("doc_id")), "rep")
    out = out.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def _with_repeated_ids(rows: DataFrame, twice: DataFrame, width: int, percent: int, tables: Tables) -> DataFrame:
    """The same where ids of ``twice`` have different texts: each of their texts is a node with a number of its own, from a
    digest of both, and the nodes of one id are tied afterwards."""
    own = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("doc_id"), F.col("text")), 256), 1, 15), 16, 10).cast("bigint")
    split = rows.join(twice.withColumn("__twice", F.lit(True)), "doc_id", "left").withColumn("node", F.when(F.col("__twice"), own).otherwise(F.col("doc_id")))
    nodes = tables.stored(split.where("__twice").select("doc_id", "node").distinct(), "shingle-nodes")
    inner = Tables(rows.sparkSession)
    apart = tables.stored(_near_duplicates(split.select("node", "text"), "node", "text", width, percent, inner), "shingle-apart")
    inner.drop()
    parts = nodes.join(apart.select("node", F.col("component_id").alias("part")).distinct(), "node")
    ties = parts.join(parts.groupBy("doc_id").agg(F.min("part").alias("low")), "doc_id").where("part <> low").select(F.col("part").alias("a"), F.col("low").alias("b"))
    joined = tables.stored(_components(ties, tables).select(F.col("node").alias("part"), F.col("component").alias("whole")), "shingle-joined")
    named = apart.withColumnRenamed("component_id", "part").join(joined, "part", "left").withColumn("whole", F.coalesce("whole", "part"))
    named = named.join(nodes, "node", "left").withColumn("doc_id", F.coalesce("doc_id", "node"))
    least = named.groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "whole", "left").select("doc_id", "n_shingles", "component_id")


def _components(links: DataFrame, tables: Tables) -> DataFrame:
    return connected_components(links, cut=lambda df: tables.stored(df, "shingle-star"))


def _set_table(rows: DataFrame, wanted: DataFrame, width: int, key: tuple[int, int]) -> DataFrame:
    def run(frames):
        for ids, sets in _sets(frames, width, key):
            yield pd.DataFrame({"doc_id": ids, "hashes": [h.view(np.int64) for h in sets]})

    return map_slices(rows.join(wanted, "doc_id", "left_semi"), run, "doc_id bigint, hashes array<bigint>")


def _best(ties: DataFrame) -> DataFrame:
    """The most frequent tie of each document."""
    ends = ties.select("a", "b", "n", F.explode(F.array("a", "b")).alias("doc_id"))
    return ends.groupBy("doc_id").agg(F.max_by(F.struct("a", "b"), F.struct("n", -F.col("a"), -F.col("b"))).alias("p")).select("p.*").distinct()


def _pivot_ties(found: DataFrame, of) -> DataFrame:
    """Ties (a, b, n) of each key's members to the member whose keys have most members in all."""
    groups = found.where("grp is not null").select("grp", F.explode("members").alias("doc"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("size"))
    reach = groups.join(sizes, "grp").groupBy("doc").agg(F.sum("size").alias("reach"))
    pivot = groups.join(reach, "doc").groupBy("grp").agg(F.max_by("doc", F.struct("reach", -F.col("doc"))).alias("pivot"))
    pairs = of(of(groups.join(pivot, "grp").where("doc <> pivot").groupBy("doc", "pivot").agg(F.count("*").alias("n")), "doc"), "pivot")
    return pairs.where("doc <> pivot").select(*_two(F.col("doc"), F.col("pivot")), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.dropDuplicates(["doc_id"])
    side = lambda c: one.select(F.col("doc_id").alias(c), F.col("hashes").alias(f"hashes_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", _linked(F.col("hashes_a"), F.col("hashes_b"), percent).alias("linked"))


def _across(found: DataFrame, of, whole, about: DataFrame, percent: int, stored) -> DataFrame:
    """Pairs of one key whose documents are in different components and whose sketches allow a link.

    A key's members are dealt into numbered blocks and every two blocks meet once. Keys with one smallest document meet in
    one bucket, which gets each sketch once, or in as many as their members fill.
    """
    members = of(found.where("grp is not null").select("grp", "lead", F.explode("members").alias("doc")), "doc").distinct()
    members = whole(members, "doc")
    mixed = members.groupBy("grp").agg(F.min("part_doc").alias("low"), F.max("part_doc").alias("high"), F.count("*").alias("n")).where("low <> high")
    open_ = members.join(stored(mixed.select("grp", "n"), "shingle-mixed"), "grp")
    n_blocks = F.ceil(F.col("n") / BLOCK_MEMBERS)
    open_ = open_.withColumn("own", F.pmod(F.xxhash64("doc"), n_blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)))
    open_ = open_.select("grp", "lead", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", F.col("doc").alias("doc_id"), F.col("part_doc").alias("part"))
    open_ = stored(open_, "shingle-open")
    total = open_.count()
    load = open_.groupBy("lead").agg(F.ceil(F.count("*") / SHARE_MEMBERS).alias("shares")).where("shares > 1")
    if total // SHARE_MEMBERS < 1_000_000:  # no more leads than that have so many members
        load = F.broadcast(load)
    open_ = open_.join(load, "lead", "left").withColumn("share", F.pmod(F.xxhash64("grp", "x", "y"), F.coalesce("shares", F.lit(1).cast("bigint"))))
    buckets = max(1, total // BUCKET_MEMBERS)
    open_ = stored(open_.withColumn("bucket", F.pmod(F.xxhash64("lead", "share"), F.lit(buckets))).drop("shares", "share"), "shingle-dealt")
    sketches = open_.select(F.col("bucket").alias("b"), F.col("doc_id").alias("d")).distinct()
    sketches = sketches.join(about.select(F.col("doc_id").alias("d"), "size", "sketch"), "d").withColumnRenamed("d", "doc_id")

    def pairs(rows: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["size", "doc_id"], ignore_index=True)
        ids, size = docs["doc_id"].to_numpy(), docs["size"].to_numpy()
        words = (docs["sketch"].str.len() // 8).to_numpy()
        tables = {}
        for w in np.unique(words):  # linked sets have sketches of one length or of one and its double
            a, c = int(np.searchsorted(words, w, "left")), int(np.searchsorted(words, 2 * w, "right"))
            tables[w] = a, np.stack([fold(np.frombuffer(x, "<u8")[None], w)[0] for x in docs["sketch"].iloc[a:c]])
        by_id = np.argsort(ids)
        rows = rows.sort_values(["grp", "x", "y"], kind="stable")
        at = by_id[np.searchsorted(ids[by_id], rows["doc_id"].to_numpy())]
        part, own, cross = rows["part"].to_numpy(), rows["own"].to_numpy(), (rows["x"] != rows["y"]).to_numpy()
        key = rows[["grp", "x", "y"]].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        held, count, found_ = [], 0, []

        def compare():
            codes = np.unique(np.concatenate(held))
            for k in range(0, len(codes), 1 << 16):
                i, j = np.divmod(codes[k : k + (1 << 16)], len(ids))
                for w in np.unique(words[i]):
                    base, table = tables[w]
                    p, q = i[words[i] == w], j[words[i] == w]
                    ok = may_link(size[p], size[q], np.bitwise_count(table[p - base] ^ table[q - base]).sum(1), percent)
                    found_.append(np.column_stack((ids[p[ok]], ids[q[ok]])))

        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            order = np.argsort(at[a:z])
            g, p, o = at[a:z][order], part[a:z][order], own[a:z][order]
            i, j = np.triu_indices(len(g), 1)
            ok = (p[i] != p[j]) & (100 * size[g[i]] >= percent * size[g[j]])
            if cross[a]:
                ok &= o[i] != o[j]
            held.append(g[i[ok]] * len(ids) + g[j[ok]])
            count += len(held[-1])
            if count >= 1 << 21:
                compare()
                held, count = [], 0
        if count:
            compare()
        out = np.unique(np.concatenate(found_), axis=0) if found_ else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": out.min(1) if len(out) else [], "b": out.max(1) if len(out) else []}, dtype="int64")

    return open_.groupBy("bucket").cogroup(sketches.groupBy("b")).applyInPandas(pairs, "a bigint, b bigint")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; rows without id stay."""
    tables = Tables(docs.sparkSession)
    parts = _near_duplicates(docs, id_col, text_col, 5, 75, tables)
    dropped = tables.stored(parts.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "shingle-dropped")
    tables.drop(keep=(dropped,))
    return docs.join(dropped, id_col, "left_anti").select(*docs.columns)
