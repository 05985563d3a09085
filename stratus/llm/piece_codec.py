"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text becomes marked words, which pieces never cross. The distinct new words of a batch are sorted, so that walking them
in order is a depth-first traversal of their trie: the forward state of each prefix is kept on a stack and words that
share a prefix share its states. For a unigram model the state is the best score and the last piece of the best
segmentation. A merging (BPE) model has exactly one segmentation of each prefix that merging produces, and it ends in
the one piece that is stable after the last piece of the prefix before it; that piece is the state.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import map_slices

MARK = "▁"
#: Words, and pairs of pieces, that a worker remembers.
MEMO = 300_000


class PieceCodec:
    def __init__(self, model: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.get_piece_size())
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        special = {i for i in ids if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.ids = {sp.id_to_piece(i): i for i in ids if i not in special}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        ranks = [sp.get_score(i) for i in ids if i not in special]
        self.merging = all(s == round(s) for s in ranks)  # ranks of merges; a unigram model has log probabilities
        self.longest = max(map(len, self.ids))
        joined = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        alone = "" if any("\n" in p for p in self.ids if len(p) > 1) else "\n"
        self.words = re.compile(f"{alone}|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+") if not joined else re.compile("(?s).+")
        probe = " ﬁ  A\t"
        self.plain = sp.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.stable: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}  # pieces that merging makes of their own text
        self.memo: dict[str, bytes] = {}

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.sp.normalize(text)

    def merge(self, text: str) -> list[str]:
        """Pieces by repeated merging of the best pair, the first of equal ones."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue = [(-self.scores[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
        heapq.heapify(queue)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = after[i]
            if parts[i] is None or j < 0 or parts[i] + parts[j] != joined:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j], after[i] = joined, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (pair := parts[k] + parts[after[k]]) in self.scores:
                    heapq.heappush(queue, (-self.scores[pair], k, pair))
        return [p for p in parts if p is not None]

    def follows(self, last: str, piece: str) -> bool:
        pair = (last, piece)
        out = self.stable.get(pair)
        if out is None:
            if len(self.stable) > MEMO:
                self.stable.clear()
            out = self.stable[pair] = self.merge(last + piece) == [last, piece]
        return out

    def first(self, piece: str) -> bool:
        out = self.whole.get(piece)
        if out is None:
            out = self.whole[piece] = self.merge(piece) == [piece]
        return out

    def _segment(self, words: list[str]) -> None:
        """Learn sorted distinct words."""
        states: list[tuple[float, str]] = [(0.0, "")]  # of prefixes: score and last piece
        before = ""
        pieces, scores, longest, known = self.ids, self.scores, self.longest, self.stable
        for word in words:
            if self.merging and word.startswith(2 * MARK):  # runs of spaces merge in ranks that tie
                self.memo[word] = self._ids(self.merge(word))
                continue
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                state = None
                if self.merging:
                    for begin in range(end - 1, max(-1, end - longest - 1), -1):
                        piece = word[begin:end]
                        if (begin == end - 1 or piece in pieces) and states[begin] is not None:
                            last = states[begin][1]
                            if begin:
                                fits = known.get((last, piece))
                                fits = self.follows(last, piece) if fits is None else fits
                            else:
                                fits = end == 1 or self.first(piece)
                            if fits:
                                state = (0.0, piece)
                                break
                else:
                    for begin in range(max(0, end - longest), end):
                        piece = word[begin:end]
                        score = scores.get(piece, -1e4 if begin == end - 1 else None)
                        if score is not None and (state is None or states[begin][0] + score > state[0]):
                            state = (states[begin][0] + score, piece)
                states.append(state)
            out, end = [], len(word)
            while end and states[end] is not None:
                out.append(states[end][1])
                end -= len(out[-1])
            self.memo[word] = self._ids(self.merge(word) if end else out[::-1])
            before = word

    def _ids(self, parts: list[str]) -> bytes:
        ids = []
        for p in parts:
            if p in self.ids:
                ids.append(self.ids[p])
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.sp.unk_id())
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        split = [self.words.findall(self.normalised(t)) for t in texts]
        every = set().union(*split)
        if len(self.memo) + len(every) > MEMO:
            self.memo.clear()
        self._segment(sorted(every - self.memo.keys()))
        return [b"".join(map(self.memo.__getitem__, w)) for w in split]

    def decode(self, ids: bytes) -> str:
        if not hasattr(self, "raw"):
            back = {i: bytes([b]) for b, i in self.byte_ids.items()} | {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
            self.raw = [back.get(i, b"") for i in range(self.sp.get_piece_size())]
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")[1:]


@lru_cache(1)
def piece_codec(model: str) -> PieceCodec:
    """The codec of a Python worker; later tasks of the worker know the words of earlier ones."""
    return PieceCodec(model)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row per input row: id, ids (binary, unsigned 32-bit), ids_crc32, in the partitions of ``docs``: nothing is
    shuffled. With ``decode`` the ids' text comes along as ``decoded``.

    Null and empty texts have no ids. Repeated rows and null ids are encoded like any other.
    """

    def run(frames):
        codec = piece_codec(model)
        for frame in frames:
            ids = codec.encode(frame["text"].tolist())
            out = pd.DataFrame({id_col: frame["id"].tolist(), "ids": ids, "ids_crc32": [zlib.crc32(x) for x in ids]}, columns=[id_col, "ids", "ids_crc32"])
            yield out.assign(decoded=[codec.decode(x) for x in ids]) if decode else out

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_slices(rows, run, f"`{id_col}` {kind}, ids binary, ids_crc32 bigint" + ", decoded string" * decode)


def decode_pieces(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``."""

    def run(frames):
        codec = piece_codec(model)
        for frame in frames:
            yield frame.assign(decoded=[codec.decode(x) for x in frame[ids_col]])

    return encoded.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string")


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256 (of the decoded text in UTF-8)."""

    out = encode_pieces(docs, model, decode=True)
    return out.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_ids"), "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
