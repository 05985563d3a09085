"""Suffix sorting with common prefixes by external induced sorting.

Suffixes of the S type after an L (the seeds) are cut into substrings, named and sorted by recursion on the names; a
last string of at most ``IN_MEMORY`` names is sorted by doubling. From the sorted seeds two sweeps induce all other
suffixes. Each sweep takes the smallest (largest) symbols off a priority queue whose entries are suffix tuples: position,
the symbols before it and the common prefix with its neighbour in the queue, which is one more than the least common
prefix met in the sweep since the last push to that symbol.

A text of bytes has few symbols, and the queue keeps each symbol's tuples in order of arrival. The names of a recursion
are many, so its queue keeps ranges of names; a range is ordered when it is taken, by the chains along which its suffixes
induced each other. Text, seeds, names, orders and flags lie in mapped files once they are large, queues spill to a file
beyond a buffer, and every step handles a block at a time, so memory does not grow with the text.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np

CAP = 255
#: Names that are sorted by doubling; tuples handled at once; bytes of an array, or of a queue, before it goes to a file.
IN_MEMORY, BLOCK, HELD = 1 << 17, 1 << 17, 4 << 20
TUPLE = np.dtype([("pos", "<i8"), ("before", "<u8"), ("lcp", "u1")])
WIDE = np.dtype([("pos", "<i8"), ("symbol", "<i8")])
INT = np.dtype("<i8")


class Scratch:
    """Arrays in unnamed files of ``folder``, mapped; small ones in memory."""

    def __init__(self, folder: str, held: int = HELD):
        self.folder, self.held = folder, held

    def array(self, n: int, dtype) -> np.ndarray:
        dtype = np.dtype(dtype)
        if n * dtype.itemsize <= self.held:
            return np.zeros(n, dtype)
        with tempfile.TemporaryFile(dir=self.folder) as f:
            f.truncate(n * dtype.itemsize)
            return np.memmap(f, dtype, "r+", shape=(n,))

    def queue(self, dtype) -> SpillQueue:
        return SpillQueue(self.folder, dtype, 4 * self.held)


class SpillQueue:
    """Rows by key, in order of arrival, taken from either end; beyond a buffer they go to a file."""

    def __init__(self, folder: str, dtype=TUPLE, buffer: int = 4 * HELD):
        self.folder, self.dtype, self.buffer, self.size, self.file = folder, np.dtype(dtype), buffer, 0, None
        self.parts: dict[int, deque] = defaultdict(deque)  # first (place, rows) in the file, then arrays

    def push(self, key: int, rows: np.ndarray) -> None:
        if len(rows):
            self.parts[key].append(rows)
            self.size += rows.nbytes
            if self.size > self.buffer:
                self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        at = self.file.seek(0, os.SEEK_END)
        for parts in self.parts.values():
            held = []
            while parts and not isinstance(parts[-1], tuple):
                held.append(parts.pop())
            if held:
                rows = np.concatenate(held[::-1])
                self.file.write(rows.tobytes())
                parts.append((at, len(rows)))
                at += rows.nbytes
        self.size = 0

    def take(self, key: int, most: int | None = None, last: bool = False) -> np.ndarray:
        """The first rows of a key, ``most`` at most; with ``last`` its last ones, in order of arrival as well."""
        parts, out, n = self.parts.get(key), [], 0
        while parts and (most is None or n < most):
            part = parts.pop() if last else parts.popleft()
            size = part[1] if isinstance(part, tuple) else len(part)
            k = size if most is None else min(size, most - n)
            skip = size - k if last else 0
            if isinstance(part, tuple):
                self.file.seek(part[0] + skip * self.dtype.itemsize)
                rows = np.frombuffer(self.file.read(k * self.dtype.itemsize), self.dtype)
                rest = (part[0], size - k) if last else (part[0] + k * self.dtype.itemsize, size - k)
            else:
                rows, rest = part[skip : skip + k], part[:skip] if last else part[k:]
                self.size -= rows.nbytes
            if size > k:
                parts.append(rest) if last else parts.appendleft(rest)
            out.append(rows)
            n += k
        if parts is not None and not parts:
            del self.parts[key]
        return np.concatenate(out[::-1] if last else out) if out else np.zeros(0, self.dtype)

    def blocks(self, key: int, last: bool = False) -> Iterator[np.ndarray]:
        while len(rows := self.take(key, BLOCK, last)):
            yield rows

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def spans(n: int) -> Iterator[tuple[int, int]]:
    return ((a, min(a + BLOCK, n)) for a in range(0, n, BLOCK))


#: Pairs of suffixes that are compared at once.
COMPARED = 1 << 15


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int = CAP) -> np.ndarray:
    """Common prefix lengths of suffix pairs, at most ``cap``."""
    if len(a) > COMPARED:
        return np.concatenate([common_prefix(text, a[k : k + COMPARED], b[k : k + COMPARED], cap) for k in range(0, len(a), COMPARED)])
    out = np.zeros(len(a), np.int64)
    live, n, step = np.arange(len(a)), len(text), 16
    span = np.arange(step)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        same = text[np.minimum(x[:, None] + span, n - 1)] == text[np.minimum(y[:, None] + span, n - 1)]
        if max(x.max(), y.max()) + step > n:
            same &= (x[:, None] + span < n) & (y[:, None] + span < n)
        whole = same.all(1)
        out[live] += np.where(whole, step, same.argmin(1))
        live = live[whole & (out[live] < cap)]
    return np.minimum(out, cap)


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether substrings of equal length are equal."""
    if len(a) > COMPARED:
        return np.concatenate([_same(text, a[k : k + COMPARED], b[k : k + COMPARED], length[k : k + COMPARED]) for k in range(0, len(a), COMPARED)])
    out, live, done, span = np.ones(len(a), bool), np.arange(len(a)), 0, np.arange(16)
    while len(live):
        inside = span + done < length[live, None]
        x = np.minimum(a[live, None] + done + span, len(text) - 1)
        y = np.minimum(b[live, None] + done + span, len(text) - 1)
        ok = ((text[x] == text[y]) | ~inside).all(1)
        out[live[~ok]] = False
        done += 16
        live = live[ok & (length[live] > done)]
    return out


def find_seeds(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Ascending positions of the seeds; the last symbol, the unique smallest, is one of them."""
    n, rising, total = len(text), True, 0  # rising: type of the position after the block
    found = scratch.queue(INT)
    last = np.array([n - 1], INT) if n > 1 else np.zeros(1, INT)
    found.push(0, last)
    for a, b in reversed(list(spans(n - 1))):
        t = np.asarray(text[a : b + 1])
        differs = np.flatnonzero(t[1:] != t[:-1])
        s = np.full(b - a + 1, rising)
        if len(differs):  # equal neighbours have the type of what follows their run
            up = t[differs] < t[differs + 1]
            s[: differs[-1] + 1] = np.repeat(up, np.diff(np.concatenate(([-1], differs))))
        if b == n - 1:
            s[-1] = True
        seeds = np.flatnonzero(s[1:] & ~s[:-1]) + a + 1
        if b == n - 1:
            seeds = seeds[seeds < n - 1]
        found.push(1 + total, seeds.astype(INT))
        total += 1
        rising = bool(s[0])
    blocks = [1 + k for k in range(total - 1, -1, -1)] + [0]
    sizes = {k: sum(p[1] if isinstance(p, tuple) else len(p) for p in found.parts.get(k, ())) for k in blocks}
    out, at = scratch.array(sum(sizes.values()), INT), 0
    for k in blocks:
        rows = found.take(k)
        out[at : at + len(rows)] = rows
        at += len(rows)
    found.close()
    return out


# texts of bytes: a queue by symbol, with common prefixes -----------------------------------------------------------------


def _before(text: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The four symbols before each position in one number, the nearest lowest; read in order of position."""
    order = np.argsort(pos, kind="stable")
    p, out = pos[order], np.zeros(len(pos), np.uint64)
    for k in range(4):
        at = p - 1 - k
        out |= np.where(at >= 0, text[np.maximum(at, 0)], 0).astype(np.uint64) << np.uint64(16 * k)
    back = np.empty_like(out)
    back[order] = out
    return back


def _previous(text: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols before the tuples' suffixes (-1 at the start) and what then is before those."""
    before = rows["before"].copy()
    dry = np.flatnonzero((before == 0) & (rows["pos"] > 0))
    if len(dry):
        before[dry] = _before(text, rows["pos"][dry])
    symbol = (before & np.uint64(0xFFFF)).astype(np.int64)
    return np.where(rows["pos"] > 0, symbol, -1), before >> np.uint64(16)


def _sweep(queue: SpillQueue, rows: np.ndarray, prev: np.ndarray, rest: np.ndarray, go: np.ndarray, least: dict[int, int] | None) -> None:
    """Push what ``rows`` (in sweep order) induce.

    ``least`` holds, for each symbol pushed so far, the least common prefix met since the last push; None: not wanted.
    """
    at = np.flatnonzero(go)
    order = at[np.argsort(prev[at].astype(np.uint16), kind="stable")]
    out = np.empty(len(order), TUPLE)
    out["pos"], out["before"], out["lcp"] = rows["pos"][order] - 1, rest[order], 0
    keys = prev[order]
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
    if least is not None:
        lcp = rows["lcp"]
        low, hit = int(lcp.min()), {}
    for a, b in zip(cuts, cuts[1:]):
        d = int(keys[a])
        if least is not None:
            idx = order[a:b]
            run = np.minimum.reduceat(lcp[: idx[-1] + 1], np.concatenate(([0], idx[:-1] + 1)))
            run[0] = min(run[0], least[d]) if d in least else 0
            out["lcp"][a:b] = np.minimum(run, CAP - 1) + 1
            if d not in least:
                out["lcp"][a] = 0
            hit[d] = int(lcp[idx[-1] + 1 :].min()) if idx[-1] + 1 < len(lcp) else CAP
        queue.push(d, out[a:b])
    if least is not None:
        for d in least:
            least[d] = min(least[d], low)
        least.update(hit)


def induce(text: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None, scratch: Scratch, visit: Callable) -> None:
    """Induce all suffixes of a text of bytes from seeds that are grouped by ascending first symbol. ``visit(pos, lcp, seed)``
    gets every suffix from the greatest to the smallest, in blocks, with its common prefix with the one visited before
    (0 without ``seed_lcp``) and whether it is a seed."""
    size = int(max(text[a:b].max() for a, b in spans(len(text)))) + 1
    counts = np.zeros(size, np.int64)
    for a, b in spans(len(seeds)):
        counts += np.bincount(text[seeds[a:b]], minlength=size)
    starts = np.cumsum(counts) - counts
    up, lefts, down = scratch.queue(TUPLE), scratch.queue(TUPLE), scratch.queue(TUPLE)
    near = lambda last, rows: 0 if last is None or seed_lcp is None else common_prefix(text, np.array([last]), rows["pos"][:1].copy())[0]
    try:
        least = None if seed_lcp is None else {}
        for c in range(size):
            last = None
            least = least and dict.fromkeys(least, 0)
            for rows in up.blocks(c):
                lefts.push(c, rows)
                last = int(rows["pos"][-1])
                prev, rest = _previous(text, rows)
                _sweep(up, rows, prev, rest, prev >= c, least)
            for a, b in spans(int(counts[c])):
                part = slice(int(starts[c]) + a, int(starts[c]) + b)
                rows = np.zeros(b - a, TUPLE)
                rows["pos"] = seeds[part]
                if seed_lcp is not None:
                    rows["lcp"] = seed_lcp[part]
                    if not a:
                        rows["lcp"][0] = near(last, rows)
                prev, rest = _previous(text, rows)
                _sweep(up, rows, prev, rest, prev > c, least)
        least = None if seed_lcp is None else {}
        sentinel = np.zeros(1, TUPLE)
        sentinel["pos"] = len(text) - 1  # induced by nothing
        down.push(int(text[-1]), sentinel)
        for c in range(size - 1, -1, -1):
            last = None
            least = least and dict.fromkeys(least, 0)
            for rows in down.blocks(c):
                last = int(rows["pos"][-1])
                prev, rest = _previous(text, rows)
                visit(rows["pos"], rows["lcp"], prev > c)
                _sweep(down, rows, prev, rest, (prev >= 0) & (prev <= c), least)
            carried = None
            for rows in lefts.blocks(c, last=True):
                rows = rows[::-1].copy()
                carry = rows["lcp"][-1]
                rows["lcp"][1:] = rows["lcp"][:-1].copy()
                rows["lcp"][0] = near(last, rows) if carried is None else carried
                carried = carry
                prev, rest = _previous(text, rows)
                visit(rows["pos"], rows["lcp"], np.zeros(len(rows), bool))
                _sweep(down, rows, prev, rest, (prev >= 0) & (prev < c), least)
    finally:
        for q in (up, lefts, down):
            q.close()


# texts of names: a queue by ranges of names ------------------------------------------------------------------------------


class Ranges:
    """Ranges of names that occur about ``BLOCK`` times together; a frequent name is a range of its own."""

    def __init__(self, text: np.ndarray, scratch: Scratch):
        size = int(max(text[a:b].max() for a, b in spans(len(text)))) + 1
        counts, self.of = scratch.array(size, INT), scratch.array(size, "<i4")
        for a, b in spans(len(text)):
            names, n = np.unique(text[a:b], return_counts=True)
            counts[names] += n
        most = max(BLOCK, len(text) >> 10)
        total, window, big, at = 0, -1, False, -1
        self.frequent: dict[int, int] = {}
        for a, b in spans(size):
            n = np.asarray(counts[a:b])
            often, win = n > most // 4, (total + np.cumsum(n) - n) // most
            new = often | np.concatenate(([big], often[:-1])) | (win != np.concatenate(([window], win[:-1])))
            self.of[a:b] = at + np.cumsum(new)
            total, window, big, at = total + int(n.sum()), int(win[-1]), bool(often[-1]), int(self.of[b - 1])
            self.frequent.update(zip(self.of[a:b][often].tolist(), (np.flatnonzero(often) + a).tolist()))
        self.count = at + 1


def _push(queue: SpillQueue, ranges: Ranges, pos: np.ndarray, symbol: np.ndarray) -> None:
    key = ranges.of[symbol]
    order = np.argsort(key, kind="stable")
    rows = np.empty(len(order), WIDE)
    rows["pos"], rows["symbol"] = pos[order], symbol[order]
    key = key[order]
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
    for a, b in zip(cuts, cuts[1:]):
        queue.push(int(key[a]), rows[a:b])


def _prior(text: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return np.where(pos > 0, text[np.maximum(pos - 1, 0)], -1)


def _range(text: np.ndarray, ranges: Ranges, b: int, first: np.ndarray, then: np.ndarray, sign: int):
    """(pos, symbol, prev, induced) of a range's suffixes in sweep order: ``first`` came in before, they and what is
    induced within the range precede ``then`` of the same symbol. ``sign`` is 1 for the ascending sweep."""
    pos, symbol = np.concatenate((first["pos"], then["pos"])), np.concatenate((first["symbol"], then["symbol"]))
    kind, source, prev = np.repeat([0, 2], [len(first), len(then)]), np.arange(len(pos)), _prior(text, pos)
    held = [(pos, symbol, kind, source, prev)]
    base, n = 0, len(pos)
    while len(pos):
        go = (prev >= 0) & np.where(kind == 2, sign * prev > sign * symbol, sign * prev >= sign * symbol)
        go &= ranges.of[np.maximum(prev, 0)] == b
        at = np.flatnonzero(go)
        pos, symbol, source, kind = pos[at] - 1, prev[at], at + base, np.ones(len(at), np.int64)
        base, prev = n, _prior(text, pos)
        n += len(pos)
        if len(pos):
            held.append((pos, symbol, kind, source, prev))
    pos, symbol, kind, source, prev = (np.concatenate(x) for x in zip(*held)) if len(held) > 1 else held[0]
    label = (sign * symbol - (sign * symbol).min()) * 3 + kind if n else symbol
    order = np.argsort(label, kind="stable")  # what came in is in order; what was induced goes by what induced it
    if (kind == 1).any():
        sorted_, tied = label[order], kind[order] == 1
        rank, up = np.empty(n, np.int64), source
        rank[order] = np.cumsum(np.concatenate(([0], ~(tied[1:] & (sorted_[1:] == sorted_[:-1])))))
        while rank.max() < n - 1:
            key = rank * n + rank[up]
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            up = up[up]
        order = np.argsort(rank)
    return pos[order], symbol[order], prev[order], kind[order] < 2


def induce_names(text: np.ndarray, seeds: np.ndarray, scratch: Scratch, visit: Callable) -> None:
    """:func:`induce` for a text of names, without common prefixes; seeds of one name are in their order."""
    ranges = Ranges(text, scratch)
    queued, up, lefts, down = (scratch.queue(WIDE) for _ in range(4))
    try:
        for a, b in spans(len(seeds)):
            pos = np.asarray(seeds[a:b])
            _push(queued, ranges, pos, text[pos])
        for k in range(ranges.count):
            if k in ranges.frequent:
                c = ranges.frequent[k]
                for queue in (up, queued):
                    for rows in queue.blocks(k):
                        if queue is up:
                            lefts.push(k, rows)
                        prev = _prior(text, rows["pos"])
                        go = prev >= c if queue is up else prev > c
                        _push(up, ranges, rows["pos"][go] - 1, prev[go])
                continue
            pos, symbol, prev, left = _range(text, ranges, k, up.take(k), queued.take(k), 1)
            rows = np.empty(int(left.sum()), WIDE)
            rows["pos"], rows["symbol"] = pos[left], symbol[left]
            lefts.push(k, rows)
            go = (prev >= symbol) & (prev >= 0)
            go &= ranges.of[np.maximum(prev, 0)] != k
            _push(up, ranges, pos[go] - 1, prev[go])
        _push(down, ranges, np.array([len(text) - 1]), np.asarray(text[-1:]))
        for k in range(ranges.count - 1, -1, -1):
            if k in ranges.frequent:
                c = ranges.frequent[k]
                for rows in down.blocks(k):
                    prev = _prior(text, rows["pos"])
                    visit(rows["pos"], None, prev > c)
                    go = (prev >= 0) & (prev <= c)
                    _push(down, ranges, rows["pos"][go] - 1, prev[go])
                for rows in lefts.blocks(k, last=True):
                    pos = rows["pos"][::-1]
                    visit(pos, None, np.zeros(len(pos), bool))
                    prev = _prior(text, pos)
                    go = (prev >= 0) & (prev < c)
                    _push(down, ranges, pos[go] - 1, prev[go])
                continue
            pos, symbol, prev, small = _range(text, ranges, k, down.take(k), lefts.take(k)[::-1], -1)
            visit(pos, None, small & (prev > symbol))
            go = (prev >= 0) & (prev <= symbol)
            go &= ranges.of[np.maximum(prev, 0)] != k
            _push(down, ranges, pos[go] - 1, prev[go])
    finally:
        for q in (queued, up, lefts, down):
            q.close()


# the recursion -----------------------------------------------------------------------------------------------------------


def _double(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a small string by prefix doubling."""
    n, k = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)  # n * n stays far below 2**63
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key)
        key = key[order]
        fresh = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or k >= n:
            return order
        k *= 2


def _backwards(n: int, scratch: Scratch) -> tuple[np.ndarray, Callable]:
    """An array that is filled from its end with what is visited."""
    out, at = scratch.array(n, INT), [n]

    def put(pos: np.ndarray) -> None:
        out[at[0] - len(pos) : at[0]] = pos[::-1]
        at[0] -= len(pos)

    return out, put


def _by_symbol(text: np.ndarray, seeds: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Seeds of a text of bytes grouped by ascending first symbol."""
    queue, out, at = scratch.queue(INT), scratch.array(len(seeds), INT), 0
    for a, b in spans(len(seeds)):
        pos = np.asarray(seeds[a:b])
        symbol = text[pos]
        order = np.argsort(symbol, kind="stable")
        names, first = np.unique(symbol[order], return_index=True)
        for s, part in zip(names.tolist(), np.split(pos[order], first[1:])):
            queue.push(s, part)
    for s in sorted(queue.parts):
        for rows in queue.blocks(s):
            out[at : at + len(rows)] = rows
            at += len(rows)
    queue.close()
    return out


def sorted_seeds(text: np.ndarray, scratch: Scratch, in_memory: int = IN_MEMORY) -> np.ndarray:
    """Seeds (the last symbol among them) in the order of their suffixes."""
    seeds = find_seeds(text, scratch)
    n = len(seeds)
    if n < 2:
        return seeds
    by, put = _backwards(n, scratch)
    if text.dtype.itemsize <= 2:
        induce(text, _by_symbol(text, seeds, scratch), None, scratch, lambda pos, _, seed: put(pos[seed]))
    else:
        induce_names(text, seeds, scratch, lambda pos, _, seed: put(pos[seed]))
    reduced, name = scratch.array(n, INT), -1
    last, last_size = by[:0], np.zeros(0, np.int64)
    for a, b in spans(n):
        pos = np.asarray(by[a:b])
        at = np.searchsorted(seeds, pos)  # each substring ends with the next seed's first symbol
        size = np.asarray(seeds[np.minimum(at + 1, n - 1)]) - pos + 1
        before, same = np.concatenate((last, pos[:-1])), np.concatenate((last_size, size[:-1])) == (size if a else size[1:])
        equal = np.flatnonzero(same)
        mine = equal if a else equal + 1
        same[equal] = _same(text, before[equal], pos[mine], size[mine])
        names = name + np.cumsum(np.concatenate((np.ones(0 if a else 1, bool), ~same)))
        reduced[at] = names
        name, last, last_size = int(names[-1]), pos[-1:], size[-1:]
    if name + 1 == n:
        return by
    order = suffix_order(reduced, scratch, in_memory)
    for a, b in spans(n):
        by[a:b] = seeds[order[a:b]]
    return by


def suffix_order(names: np.ndarray, scratch: Scratch, in_memory: int = IN_MEMORY) -> np.ndarray:
    """Sorted suffixes of a string of names that ends with its unique smallest."""
    if len(names) <= in_memory:
        return _double(np.asarray(names))
    seeds = sorted_seeds(names, scratch, in_memory)
    order, put = _backwards(len(names), scratch)
    induce_names(names, seeds, scratch, lambda pos, *_: put(pos))
    return order


def repeated_starts(text: np.ndarray, length: int, scratch: Scratch, in_memory: int = IN_MEMORY) -> np.ndarray:
    """For each position whether the string of ``length`` symbols there also starts elsewhere. ``text`` ends with its
    unique smallest symbol; ``length`` is at most 255."""
    seeds = sorted_seeds(text, scratch, in_memory)
    lcp = scratch.array(len(seeds), np.uint8)
    for a, b in spans(len(seeds) - 1):
        lcp[a + 1 : b + 1] = common_prefix(text, np.asarray(seeds[a:b]), np.asarray(seeds[a + 1 : b + 1]), length)
    out = scratch.array(len(text), bool)
    last = [-1]

    def visit(pos: np.ndarray, common: np.ndarray, _) -> None:
        hit = np.flatnonzero(common >= length)
        out[pos[hit]] = True
        out[np.concatenate(([last[0]], pos[:-1]))[hit]] = True
        last[0] = pos[-1]

    induce(text, seeds, lcp, scratch, visit)
    return out
