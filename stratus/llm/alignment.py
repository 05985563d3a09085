"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

A text is cut at single spaces between other characters, where a token of either tokenizer always ends, so a word is
tokenized and aligned once a batch of texts, exactly by its characters. Tokens of both sides that overlap in bytes are
linked. Documents are numbered in chunks; for each pair of ids a chunk holds a compressed bitmap of the documents that
link it and, where a document links it more than once, planes of the bits of how often beyond the first. Bitmaps OR-merge
over batches; their popcounts, summed over chunks, count documents and links of a pair corpus-wide. The postings then
carry each pair's score back to the documents that hold it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .shared import release, stored

SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
UNDER = "▁"
#: Documents of a chunk; entries after which a chunk ends early; words of a line given to the tokenizers; characters of text aligned at once and of words remembered.
CHUNK_DOCS, CHUNK_ENTRIES, LINE, TOGETHER, REMEMBERED = 8192, 3_000_000, 128, 1 << 20, 6 << 20
#: From so many documents on a chunk's bitmap is smaller than the list of their numbers.
DENSE = CHUNK_DOCS // 16


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Flat:
    """Rows of numbers of different lengths in one array that grows."""

    def __init__(self, dtype):
        self.data, self.ends, self.n = np.zeros(1024, dtype), np.zeros(1025, np.int64), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.ends[self.n])
        if used + len(values) > len(self.data):
            self.data = np.concatenate((self.data[:used], np.zeros(used + 2 * len(values), self.data.dtype)))
        if self.n + len(sizes) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends[: self.n + 1], np.zeros(self.n + 2 * len(sizes), np.int64)))
        self.data[used : used + len(values)] = values
        self.ends[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.ends[rows + 1] - self.ends[rows]

    def take(self, rows: np.ndarray) -> np.ndarray:
        n = self.sizes(rows)
        ends = np.cumsum(n)
        return self.data[np.repeat(self.ends[rows] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]


class Aligner:
    """Words' tokens of both tokenizers and how they overlap; forgets all when it remembers too many."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        bytes_a = [bytes(letters.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(UNDER, " ").encode() for i, p in enumerate(pieces)]
        self.parted = not any(UNDER in p.lstrip(UNDER) for p in pieces)  # no piece goes over a word's end
        self.size_b = len(pieces)
        self.side_a, self.side_b = (self._table(x) for x in (bytes_a, bytes_b))
        self.digits = self._table([str(i).encode() for i in range(max(len(bytes_a), len(bytes_b)))])
        self.forget()

    @staticmethod
    def _table(rows: list[bytes]) -> Flat:
        flat = Flat(np.uint8)
        flat.add(np.frombuffer(b"".join(rows), np.uint8), np.array([len(x) for x in rows], np.int64))
        return flat

    def forget(self) -> None:
        """``slot`` of a word; -1: its ends are white space, so words do not tell; -2: bytes differ, so its text has no tokens."""
        self.slot: dict[str, int] = {}
        self.held, self.pairs, self.numbers, self.strings = 0, Flat(np.int64), Flat(np.int64), []

    def learn(self, words: list[str], alone: bool = False) -> None:
        """New words between spaces; ``alone``: segments whose ends may be white space."""
        odd = [w for w in words if UNDER in w]
        self.slot.update(dict.fromkeys(odd, -2))
        if not alone:
            self.slot.update(dict.fromkeys([w for w in words if not w or w[0].isspace() or w[-1].isspace()], -1))
        words = [w for w in words if w not in self.slot]
        step = 1 if alone else LINE
        for i in range(0, len(words), 64 * LINE):
            block = words[i : i + 64 * LINE]
            lines = [" ".join(block[j : j + step]) for j in range(0, len(block), step)]
            a = np.fromiter((x for e in self.a.encode_batch_fast([" " + x for x in lines], add_special_tokens=False) for x in e.ids), np.int64)
            b = np.fromiter((x for ids in self.b.encode(lines, num_threads=1) for x in ids), np.int64)
            self._align(block, a, b)
        self.held += sum(map(len, words))

    def _align(self, words: list[str], a: np.ndarray, b: np.ndarray) -> None:
        raw = np.frombuffer("".join([" " + w for w in words]).encode(), np.uint8)
        ends = np.cumsum([1 + len(w.encode()) for w in words])
        end_a, end_b = np.cumsum(self.side_a.sizes(a)), np.cumsum(self.side_b.sizes(b))
        cuts = end_a[np.isin(end_a, end_b, assume_unique=True)]
        if not (np.array_equal(self.side_a.take(a), raw) and np.array_equal(self.side_b.take(b), raw) and np.isin(ends, cuts).all()):
            if len(words) == 1:
                self.slot[words[0]] = -2
            for w in words if len(words) > 1 else ():  # which ones differ?
                self.learn([w], True)
            return
        start_a, start_b = (np.concatenate(([0], x[:-1])) for x in (end_a, end_b))
        first, stop = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        size = stop - first
        over = np.cumsum(size)
        link_b = np.repeat(first - over + size, size) + np.arange(over[-1])
        pairs = np.repeat(a, size) * self.size_b + b[link_b]
        word_a, word_b, word_cut = (np.searchsorted(ends, x, "left") for x in (end_a, end_b, cuts))
        n = len(words)
        links = np.bincount(word_a, size, n).astype(np.int64)
        numbers = np.stack([np.bincount(word_a, minlength=n), np.bincount(word_b, minlength=n), np.bincount(word_cut, minlength=n), links], axis=1)
        # each group's A ids, then its B ids, each id with the mark that follows it
        group_a, group_b = np.searchsorted(cuts, end_a, "left"), np.searchsorted(cuts, end_b, "left")
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        at_a, at_b = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a], np.arange(len(b)) + np.cumsum(in_a)[group_b]
        ids, marks = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        last = np.cumsum(in_a + in_b)
        marks[last - 1], marks[last - in_b - 1] = ord(";"), ord("|")
        length = self.digits.sizes(ids) + 1
        marked = np.zeros(int(length.sum()), np.uint8)
        where = np.cumsum(length) - 1
        is_mark = np.zeros(len(marked), bool)
        is_mark[where] = True
        marked[where], marked[~is_mark] = marks, self.digits.take(ids)
        text = marked.tobytes()
        word_ends = (where[last[np.searchsorted(cuts, ends, "left")] - 1] + 1).tolist()
        self.slot.update(zip(words, range(self.pairs.n, self.pairs.n + n)))
        self.strings += [text[x:y] for x, y in zip([0, *word_ends], word_ends)]
        self.pairs.add(pairs, links)
        self.numbers.add(numbers.ravel(), np.full(n, 4))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(numbers, digest of groups, document, pair) of texts: n_a, n_b, n_groups, n_links a text; the links one by one."""
        if self.held > REMEMBERED:
            self.forget()
        plain = [i for i, t in enumerate(texts) if t] if self.parted else []
        words = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ") if plain else None
        slots: dict[int, np.ndarray] = {}
        if words is not None:
            coded = words.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            self.learn([w for w in names if w not in self.slot])
            of = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
            cuts = words.offsets.to_numpy()
            slots = {i: of[x:y] for i, x, y in zip(plain, cuts[:-1].tolist(), cuts[1:].tolist())}
        least = {i: int(s.min(initial=0)) for i, s in slots.items()}
        hard = [i for i, t in enumerate(texts) if t and least.get(i, -1) == -1]
        parts = {i: SINGLE_SPACE.split(texts[i]) if self.parted else [texts[i]] for i in hard}
        self._segments({w for p in parts.values() for w in p})
        for i, p in parts.items():
            slots[i] = np.fromiter((self.slot.get(w, -2) for w in p), np.int64, len(p))
        numbers, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        docs = [i for i in sorted(slots) if slots[i].min() >= 0]
        for i in docs:
            digests[i] = hashlib.sha256(b"".join([self.strings[s] for s in slots[i].tolist()])[:-1]).hexdigest()
        flat = np.concatenate([slots[i] for i in docs]) if docs else np.zeros(0, np.int64)
        if docs:
            starts = np.cumsum([0, *(len(slots[i]) for i in docs[:-1])])
            numbers[docs] = np.add.reduceat(self.numbers.take(flat).reshape(-1, 4), starts)
        for w in self._passing:
            self.slot.pop(w, None)
        return numbers, digests, np.repeat(np.array(docs, np.int64), numbers[docs, 3] if docs else 0), self.pairs.take(flat)

    def _segments(self, segments: set[str]) -> None:
        """Segments of texts that words do not tell. Those with white space at an end are aligned for this batch alone, since
        between spaces the same characters may be no word."""
        known = {w for w in segments if self.slot.get(w, -1) >= 0}
        self._passing = [w for w in segments - known if self.slot.get(w) != -2]
        for w in self._passing:
            self.slot.pop(w, None)
        self.learn(self._passing, True)


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of a Python worker; later tasks know the words of earlier ones."""
    return Aligner(path_a, path_b)


def containers(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Compressed bitmaps of a chunk's entries (pair, document, how often; sorted by pair and document, each once): plane 0
    holds the documents with the pair, plane p > 0 those where bit p - 1 of the times beyond the first is set. Few
    documents are listed by 16-bit numbers, many set bits."""
    for plane in range(1 + int(times.max(initial=1) - 1).bit_length()):
        on = np.ones(len(pair), bool) if plane == 0 else ((times - 1) >> (plane - 1) & 1).astype(bool)
        p, d = pair[on], doc[on]
        if not len(p):
            continue
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        size = np.diff(np.append(first, len(p)))
        for dense in (False, True):
            own = np.flatnonzero((size >= DENSE) == dense)
            if not len(own):
                continue
            entry = np.repeat((size >= DENSE) == dense, size)
            if dense:
                bits = np.zeros((len(own), CHUNK_DOCS), bool)
                bits[np.repeat(np.arange(len(own)), size[own]), d[entry]] = True
                data, offsets = np.packbits(bits, axis=1, bitorder="little"), np.arange(len(own) + 1) * (CHUNK_DOCS // 8)
            else:
                data, offsets = d[entry].astype("<u2"), np.concatenate(([0], 2 * np.cumsum(size[own])))
            column = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.record_batch({"pair": pa.array(p[first[own]]), "plane": pa.array(np.full(len(own), plane, np.int32)), "dense": pa.array(np.full(len(own), dense)), "docs": pa.array(size[own].astype(np.int64)), "bits": column})


def members(dense: bool, bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, document) of every set bit of containers of one kind."""
    raw = pc.binary_length(bits).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(bits.to_pylist()), np.uint8)
    if not dense:
        return np.repeat(np.arange(len(raw)), raw // 2), data.view("<u2").astype(np.int64)
    return np.nonzero(np.unpackbits(data.reshape(len(raw), -1), axis=1, bitorder="little"))


DOC = "chunk bigint, doc int, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
POSTING = "pair bigint, plane int, dense boolean, docs bigint, bits binary"


def pair_postings(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored table of both: a row a document (``doc`` within its ``chunk``, its numbers), and a row a chunk, pair and plane
    with the compressed bitmap (``pair`` is the A id times B's size plus the B id); the other columns are null."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"{DOC}, {POSTING}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def filled(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def entries(doc: np.ndarray, pair: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each pair and document once, OR-ed, with the sum of the times; sorted by both."""
        key = pair * CHUNK_DOCS + doc
        if times is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        n = np.diff(np.append(first, len(key))) if times is None else np.add.reduceat(times, first) if len(first) else times
        return key[first] // CHUNK_DOCS, key[first] % CHUNK_DOCS, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, ended, at, held = TaskContext.get().partitionId(), 0, 0, []

        def finished() -> Iterator[pa.RecordBatch]:
            pair, doc, times = entries(np.concatenate([h[1] for h in held]), np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held]))
            for c in containers(pair, doc, times):
                yield filled(c.num_rows, {**dict(zip(c.schema.names, c.columns)), "chunk": pa.array(np.full(c.num_rows, (task << 24) + ended))})

        try:
            words = aligner(path_a, path_b)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                start, lengths = 0, pc.binary_length(texts).to_pylist()
                while start < batch.num_rows:
                    stop, size = start, 0
                    while stop < batch.num_rows and stop - start < CHUNK_DOCS - at and (stop == start or size + lengths[stop] <= TOGETHER):
                        size += lengths[stop]
                        stop += 1
                    numbers, digests, doc, pair = words.batch(texts[start:stop].to_pylist())
                    held.append(entries(doc + at, pair))
                    n = stop - start
                    columns = {"chunk": np.full(n, (task << 24) + ended), "doc": np.arange(at, at + n, dtype=np.int32), **{c: numbers[:, k] for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}}
                    yield filled(n, {k: pa.array(v) for k, v in columns.items()} | {"id": ids[start:stop], "groups_sha256": pa.array(digests, pa.string())})
                    at, start = at + n, stop
                    if at == CHUNK_DOCS or sum(len(h[0]) for h in held) > CHUNK_ENTRIES:
                        yield from finished()
                        ended, at, held = ended + 1, 0, []
            if held:
                yield from finished()
        finally:
            release()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, schema), "align-postings")


def pair_scores(postings: DataFrame, size_b: int) -> DataFrame:
    """pair, docs (that hold it), links, best (whether its B id has no pair with more links) of :func:`pair_postings`."""
    times = F.expr("CASE WHEN plane = 0 THEN 1L ELSE shiftleft(1L, plane - 1) END")
    rows = postings.where("pair is not null")
    sums = rows.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("docs")).otherwise(0)).alias("docs"), F.sum(F.col("docs") * times).alias("links"))
    of_b = Window.partitionBy(F.pmod("pair", F.lit(size_b)))  # at most as many rows as A has ids
    return sums.withColumn("best", F.col("links") == F.max("links").over(of_b))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). A document's id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum; a pair's a, b,
    docs, links, best.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have zeros and an empty digest.
    Special tokens' strings are plain text. Repeated rows are documents of their own; an empty table gives empty tables.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    table = pair_postings(docs, path_a, path_b, id_col, text_col)
    scores = stored(pair_scores(table, size_b), "align-scores")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sums = None, None

        def finished() -> pa.RecordBatch:
            doc = np.flatnonzero(sums[:, 0])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), chunk)), pa.array(doc.astype(np.int32)), pa.array(sums[doc, 1]), pa.array(sums[doc, 2])], names=["chunk", "doc", "n_best", "count_sum"])

        for batch in batches:
            chunks = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
            for x, y in zip(edges, edges[1:]):
                if x == y:
                    continue
                if chunks[x] != chunk:
                    if chunk is not None:
                        yield finished()
                    chunk, sums = int(chunks[x]), np.zeros((CHUNK_DOCS, 3), np.int64)
                part = batch.slice(x, y - x)
                thick = part.column(2).to_numpy(zero_copy_only=False)
                plane, links, best = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 4, 5))
                times = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0))
                for dense in (False, True):
                    own = np.flatnonzero(thick == dense)
                    if len(own):
                        row, doc = members(dense, part.column(3).take(pa.array(own)))
                        row = own[row]
                        sums[:, 0] += np.bincount(doc, minlength=CHUNK_DOCS)
                        np.add.at(sums[:, 1], doc, times[row] * best[row])
                        np.add.at(sums[:, 2], doc, times[row] * links[row])
        if chunk is not None:
            yield finished()

    scored = table.where("pair is not null").select("chunk", "plane", "dense", "bits", "pair").join(scores.select("pair", "links", "best"), "pair")
    dealt = scored.select("chunk", "plane", "dense", "bits", "links", "best").repartition("chunk").sortWithinPartitions("chunk")
    carried = dealt.mapInArrow(carry, "chunk bigint, doc int, n_best bigint, count_sum bigint")
    rows = table.where("doc is not null").select(*[c.split()[0] for c in DOC.split(", ")]).join(carried.hint("merge"), ["chunk", "doc"], "left")
    out = rows.select("id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
    return out, scores.select(F.expr(f"pair div {size_b}").alias("a"), F.pmod("pair", F.lit(size_b)).alias("b"), "docs", "links", "best")
