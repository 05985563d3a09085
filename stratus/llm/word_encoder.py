"""Whole-text encoding with the tokenizers library, each distinct word once.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the ids of the parts, joined, are the ids
of the whole. A text that offers no such certainty goes to the library whole, as does one that holds a special token's
string, unless these are to count as ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from .shingles import LOWER, U64, eight, eights, mix, prefix_hash, range_hash

PUNCTUATION = "!#$%&()*+,-./:;<=>?@[]^`{|}~\"\\"
TAIL = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]+)")
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = re.compile("[\x1c-\x1f]")
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Bytes of texts that are looked up together, words that are learned in one line, bytes of the longest word kept.
TOGETHER, LINE, LONGEST = 1 << 20, 128, 64
#: Kinds of words: after a space, at the start of a text or line, a line feed.
AFTER, BEGIN, FEED = 0, 1, 2


class WordTable:
    """Ids of words by the words' hashes: open addressing over arrays, so that whole batches are looked up at once; a hit counts
    only if the words' bytes are equal. Words that no batch asked for since the last turn are forgotten at the next."""

    def __init__(self, limit: int, dtype: np.dtype):
        self.limit, self.dtype = limit, dtype
        self.mask = U64((1 << int(2 * limit).bit_length()) - 1)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(int(self.mask) + 1, U64), np.zeros(int(self.mask) + 1, np.int32)
        self.hashes, self.at, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.hard, self.used, self.ids = np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, self.dtype)
        self.kind, self.length, self.letters = np.zeros(0, np.int8), np.zeros(0, np.int32), np.zeros((0, LONGEST // 8), U64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for those that are not there."""
        place, out = hashes & self.mask, np.full(len(hashes), -1, np.int32)
        live = np.arange(len(hashes))
        while len(live):
            key = self.keys[place[live]]
            hit = key == hashes[live]
            out[live[hit]] = self.slots[place[live[hit]]]
            live = live[~hit & (key != 0)]
            place[live] = (place[live] + U64(1)) & self.mask
        return out

    def other(self, numbers: np.ndarray, view: np.ndarray, first: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which of the words found are not the words asked for, by their bytes and kinds."""
        size = end - first
        bad = (self.length[numbers] != size) | (self.kind[numbers] != kind)
        live = np.flatnonzero(~bad)
        for k in range(LONGEST // 8):
            live = live[size[live] > 8 * k]
            if not len(live):
                break
            bad[live] |= eight(view, first[live] + 8 * k, size[live] - 8 * k) != self.letters[numbers[live], k]
        return bad

    def add(self, hashes: np.ndarray, ids: list[bytes | None], view: np.ndarray, first: np.ndarray, end: np.ndarray, kind: np.ndarray) -> None:
        """New words, of at most ``LONGEST`` bytes; ``None`` marks one whose text is to go to the library whole."""
        letters = np.zeros((len(first), LONGEST // 8), U64)
        for k in range(LONGEST // 8):
            own = np.flatnonzero(end - first > 8 * k)
            letters[own, k] = eight(view, first[own] + 8 * k, (end - first)[own] - 8 * k)
        self._spell(letters, (end - first).astype(np.int32), kind.astype(np.int8))
        size = np.fromiter((len(x) if x else 0 for x in ids), np.int32, len(ids)) // self.dtype.itemsize
        self._put(hashes, size, np.fromiter((x is None for x in ids), bool, len(ids)), np.frombuffer(b"".join([x or b"" for x in ids]), self.dtype))

    def _spell(self, letters: np.ndarray, length: np.ndarray, kind: np.ndarray) -> None:
        self.letters, self.length, self.kind = np.concatenate((self.letters, letters)), np.concatenate((self.length, length)), np.concatenate((self.kind, kind))

    def _put(self, hashes: np.ndarray, size: np.ndarray, hard: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.hashes)
        self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(size, dtype=np.int64) - size))
        self.hashes, self.size, self.hard = np.concatenate((self.hashes, hashes)), np.concatenate((self.size, size)), np.concatenate((self.hard, hard))
        self.used, self.ids = np.concatenate((self.used, np.ones(len(hashes), bool))), np.concatenate((self.ids, ids))
        place, live = hashes & self.mask, np.arange(len(hashes))
        while len(live):
            free = live[self.keys[place[live]] == 0]
            self.keys[place[free]] = hashes[free]  # of several that want one place the last gets it
            won = free[self.keys[place[free]] == hashes[free]]
            self.slots[place[won]] = (n + won).astype(np.int32)
            live = np.setdiff1d(live, won, assume_unique=True)
            place[live] = (place[live] + U64(1)) & self.mask

    def turn(self) -> None:
        """Keep the words that were used since the last turn, as far as they fill half of the table."""
        keep = np.flatnonzero(self.used)[-self.limit // 2 :]
        hashes, size, hard = self.hashes[keep], self.size[keep], self.hard[keep]
        ids, spelled = self.gather(keep), (self.letters[keep], self.length[keep], self.kind[keep])
        self._clear()
        self._spell(*spelled)
        self._put(hashes, size, hard, ids)
        self.used[:] = False

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words in a row."""
        n = self.size[numbers].astype(np.int64)
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.at[numbers] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]


class WordEncoder:
    """ids of whole texts as little-endian bytes of ``dtype``; holds about ``memo_limit`` words, those in use.

    As in the library, a special token's string in a text gives that token, or with ``special_as_text`` ordinary ids.
    """

    def __init__(self, path: str, special_as_text: bool = False, memo_limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        spec = json.loads(self.tok.to_str())
        self.special = () if special_as_text else tuple(x["content"] for x in spec.get("added_tokens") or ())
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm
        ended = spec["model"].get("end_of_word_suffix") and {x["type"] for x in norm.get("normalizers", ())} == {"NFC", "Replace", "Lowercase"}
        self.kind = "spaced" if spaced else "ended" if ended else ""
        names = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.edge = np.array([x.startswith("Ġ") if spaced else x.endswith(spec["model"].get("end_of_word_suffix") or "\0") for x in names])
        self.line = np.zeros(size, bool)
        if len(ids := self.tok.encode("\n", add_special_tokens=False).ids) == 1:
            self.line[ids] = True
        self.memo: dict[str, bytes | None] = {}
        self.table = WordTable(memo_limit, self.dtype)

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn_plain(self, cores: list[str]) -> None:
        """Letters only: a line of them holds one id that ends a word for each."""
        size = self.dtype.itemsize
        for i in range(0, len(cores), 64 * LINE):
            blocks = [cores[j : j + LINE] for j in range(i, min(i + 64 * LINE, len(cores)), LINE)]
            for block, e in zip(blocks, self.tok.encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                stops = (np.flatnonzero(self.edge[ids]) + 1) * size
                if len(stops) != len(block):
                    self.memo.update(zip(block, self._whole(block)))
                    continue
                raw = ids.tobytes()
                self.memo.update(zip(block, [raw[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]))

    def _learn_lines(self, words: list[str], between: str, first: str, ends: np.ndarray) -> None:
        """Words without white space, joined to lines whose ids ``ends`` parts."""
        size = self.dtype.itemsize
        for i in range(0, len(words), 64 * LINE):
            blocks = [words[j : j + LINE] for j in range(i, min(i + 64 * LINE, len(words)), LINE)]
            lines = [first + between.join([w.removeprefix("\0") for w in b]) for b in blocks]
            for block, e in zip(blocks, self.tok.encode_batch_fast(lines, add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                at, skip = np.flatnonzero(ends[ids]), 0 if first else 1
                starts, stops = (at, np.append(at[1:], len(ids))) if first else (np.append(0, at + 1), np.append(at, len(ids)))
                if len(starts) != len(block) or skip and (stops <= starts).any():
                    self.memo.update(zip(block, self._whole([first + w.removeprefix("\0") for w in block])))
                    continue
                raw = ids.tobytes()
                self.memo.update(zip(block, [raw[a:b] for a, b in zip((starts * size).tolist(), (stops * size).tolist())]))

    def _learn(self, words: list[str], other_space: bool) -> None:
        """Words between spaces; a first ``\\0`` marks the start of a text or line. ``other_space``: one may hold some."""
        if self.kind == "ended":
            return self._learn_ended(words)
        rest, words = [w for w in words if w in ("", "\0", "\n")], [w for w in words if w not in ("", "\0", "\n")]
        if other_space:
            rest += [w for w in words if OTHER_SPACE.search(w)]
            words = list({*words}.difference(rest))
        begin = [w for w in words if w[0] == "\0"]
        after = list({*words}.difference(begin)) if begin else words
        unsure = [w for w in rest if w in ("", "\0") or w != "\n" and (w[-1].isspace() or w[w[0] == "\0"].isspace())]
        self.memo.update(dict.fromkeys(unsure))
        rest = list({*rest}.difference(unsure))
        self._learn_lines(after, " ", " ", self.edge)
        self._learn_lines(begin, "\n", "", self.line)
        self.memo.update(zip(rest, self._whole([w[1:] if w[0] == "\0" else w if w == "\n" else " " + w for w in rest])))
        return None

    def _learn_ended(self, words: list[str]) -> None:
        memo, rest = self.memo, []
        plain = [w for w in words if w.isalpha()]
        others = set(words).difference(plain)
        lower = [(w, w.lower(), "") for w in plain if w.isascii() and not w.islower()]
        plain = list({*plain}.difference(w for w, _, _ in lower))
        tailed = [(w, c, w[-1]) for w in others if (c := w[:-1]).isalpha() and w[-1] in PUNCTUATION and "İ" not in c]
        for w in others.difference([w for w, _, _ in tailed]):
            if (m := TAIL.fullmatch(w)) and m[1].isalpha() and "İ" not in w:
                tailed.append((w, m[1], m[2]))
            else:
                rest.append(w)
        tailed = [(w, c.lower() if c.isascii() else c, t) for w, c, t in tailed] + lower
        self._learn_plain(list({*plain, *(c for _, c, _ in tailed if c not in memo)}))
        tails = list({t for _, _, t in tailed} - {""})
        of = dict(zip(tails, self._whole(tails))) | {"": b""}
        memo.update([(w, memo[c] + of[t]) for w, c, t in tailed])
        memo.update(zip(rest, self._whole(rest)))

    def _easy(self, t: str) -> bool:
        """Whether the ids of the text's words, joined, are the text's ids, as far as single characters tell."""
        if not self.kind or "\0" in t or self.kind == "ended" and ODD_SPACE.search(t):
            return False
        low = t.lower() if self.kind == "ended" and self.special else t
        return not any(x in low for x in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; an empty text has none."""
        out: list[bytes] = []
        start = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= TOGETHER or i + 1 == len(texts):
                out += self._encode(texts[start : i + 1])
                start, held = i + 1, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        easy = [bool(t) and self._easy(t) for t in texts]
        full = [i for i, ok in enumerate(easy) if ok]
        out: list[bytes | None] = [b"" if not t else None for t in texts]
        if full:
            for i, ids in zip(full, self._joined([texts[i] for i in full])):
                out[i] = self._hard(texts[i], True) if ids is None else ids
        return [self._hard(t, False) if x is None else x for t, x in zip(texts, out)]

    def _joined(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text from those of its words; None where words do not tell."""
        spaced = self.kind == "spaced"
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0", np.uint8)
        if not spaced and len(data) == sum(map(len, texts)) + len(texts) + 1:  # pure ASCII
            data = LOWER[data]
        elif not spaced:
            data = np.frombuffer(b"\0" + b"\0".join([t.lower().encode() if t.isascii() else r for t, r in zip(texts, raw)]) + b"\0", np.uint8)
        gap = (data == 32) | (data == 10) | (data == 0) if spaced else (data <= 32) & ((data == 32) | (data == 0) | ((data >= 9) & (data <= 13)))
        first = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
        end = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
        ends_of_texts = np.flatnonzero(data == 0)[1:]
        unsure = np.zeros(len(texts), bool)
        if spaced:  # two gaps in a row
            two = np.flatnonzero(gap[1:] & gap[:-1])
            unsure[np.searchsorted(ends_of_texts, np.where(data[two] == 0, two + 1, two))] = True
        hashes = mix(range_hash(prefix_hash(data), first, end) + end.astype(U64) - first.astype(U64))
        kind = np.where(data[first - 1] == 32, AFTER, BEGIN) if spaced else np.zeros(len(first), np.int64)
        if spaced:
            feeds = np.flatnonzero(data == 10)
            order = np.argsort(np.concatenate((first, feeds)), kind="stable")
            first, end, kind = (np.concatenate(x)[order] for x in ((first, feeds), (end, feeds + 1), (kind, np.full(len(feeds), FEED))))
            hashes = np.concatenate((hashes, np.zeros(len(feeds), U64)))[order]
        hashes = mix(hashes ^ (kind.astype(U64) * U64(0x9E3779B97F4A7C15))) | U64(1)
        found, view = self.table.find(hashes), eights(data)
        long_ = end - first > LONGEST
        missing = np.flatnonzero((found < 0) & ~long_)
        if len(self.table.hashes) + len(missing) > self.table.limit and len(missing):
            self.table.used[found[found >= 0]] = True
            self.table.turn()
            found = self.table.find(hashes)
            missing = np.flatnonzero((found < 0) & ~long_)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            self._add(data, new, view, first[missing[at]], end[missing[at]], kind[missing[at]])
            found[missing] = self.table.find(hashes[missing])
        once = np.flatnonzero(long_ & (found < 0))  # long words are not kept: the table's words are few and short
        text_of = np.searchsorted(ends_of_texts, first)
        unsure[text_of[once]] = True
        hit = np.flatnonzero(found >= 0)
        unsure[text_of[hit[self.table.other(found[hit], view, first[hit], end[hit], kind[hit])]]] = True  # another word of that hash
        known = np.maximum(found, 0)
        self.table.used[known] = True
        flat, items = self.table.gather(known), np.searchsorted(first, np.concatenate(([0], ends_of_texts)))
        unsure |= np.diff(np.concatenate(([0], np.cumsum(self.table.hard[known])))[items]) > 0
        cuts = np.concatenate(([0], np.cumsum(self.table.size[known], dtype=np.int64)))[items]
        return [None if odd else flat[a:b].tobytes() for odd, a, b in zip(unsure.tolist(), cuts.tolist(), cuts[1:].tolist())]

    def _add(self, data: np.ndarray, hashes: np.ndarray, view: np.ndarray, first: np.ndarray, end: np.ndarray, kind: np.ndarray) -> None:
        words = [data[a:b].tobytes().decode() for a, b in zip(first.tolist(), end.tolist())]
        words = ["\0" + w if k == BEGIN and self.kind == "spaced" else w for w, k in zip(words, kind.tolist())]
        self.memo = {}
        self._learn(words, self.kind == "spaced" and bool(OTHER_SPACE.search("\n".join(words))))
        self.table.add(hashes, [self.memo[w] for w in words], view, first, end, kind)
        self.memo = {}

    def _hard(self, t: str, ok: bool) -> bytes:
        if not ok or self.kind != "spaced":
            return self._whole([t])[0]
        parts = SINGLE_SPACE.split(t)
        return b"".join(self._whole([parts[0], *(" " + p for p in parts[1:])]))


@lru_cache(1)
def word_encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """The encoder of a Python worker; later tasks of the worker know the words of earlier ones."""
    return WordEncoder(path, special_as_text)
