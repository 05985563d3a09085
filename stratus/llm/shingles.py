"""Hashed word shingles of batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

BASE = 0x9E3779B97F4A7C15
U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= MIX_A
    x ^= x >> U64(27)
    x *= MIX_B
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 21)
        _powers["p"] = np.cumprod(np.full(size, BASE, U64))
        _powers["i"] = np.cumprod(np.full(size, pow(BASE, -1, 1 << 64), U64))
    return _powers["p"], _powers["i"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base**i over prefixes, from the empty one on."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Steps of eight bytes after which a word is left to a digest.
STEPS = 32


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def eight(view: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes at ``at``, no more than are ``left``."""
    return view[at] & MASKS[np.minimum(left, 8)]


def keyed_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """Hashes of byte ranges, eight bytes a step with a non-linear mix. Who does not know ``key`` cannot make two ranges meet."""
    size, view = end - start, eights(data)
    first, add = (U64(k) for k in key)
    h = mix(size.astype(U64) ^ first)
    live = np.arange(len(size))
    for k in range(STEPS):
        live = live[size[live] > 8 * k]
        if not len(live):
            break
        h[live] = mix((h[live] ^ eight(view, start[live] + 8 * k, size[live] - 8 * k)) + add)
    secret = b"".join(k.to_bytes(8, "little") for k in key)
    for i in np.flatnonzero(size > 8 * STEPS).tolist():
        h[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=secret).digest(), "little")
    return h


def shingle_sets(texts: list[bytes], width: int = 5, key: tuple[int, int] = (1, 2)) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of the distinct word shingles, sorted by both; at most 65,535 texts. ``key`` is a secret of the
    job, so that no text can be written to share another's hashes.

    Words are runs of bytes other than space and 9 to 13, with A-Z in lower case. A text with fewer than ``width``
    words has one shingle, its whole sequence; a text without words has none.
    """
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = IS_SPACE[data]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(start):
        return np.zeros(0, np.uint16), np.zeros(0, U64)
    end = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    words = keyed_hash(data, start, end, key)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    doc = (np.searchsorted(begins, start, "right") - 1).astype(np.uint16)
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    factors = mix(np.arange(1, width + 1, dtype=U64)) | U64(1)
    padded = np.concatenate((words, np.zeros(width, U64)))
    hashes = sum(padded[i : i + len(words)] * factors[i] for i in range(width))
    last = (first + n)[doc]
    whole = np.arange(len(words)) + width <= last
    short = np.flatnonzero((n > 0) & (n < width))
    for d in short:  # at most width - 1 words each
        w = words[first[d] : first[d] + n[d]]
        hashes[first[d]] = np.sum(w * factors[: n[d]]) + U64(n[d])
        whole[first[d]] = True
    hashes, doc = mix(hashes[whole]), doc[whole]
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order], kind="stable")]
    hashes, doc = hashes[order], doc[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))
    return doc[new], hashes[new]


def batches(texts: list[bytes], most_bytes: int = 1 << 20, most: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most_bytes`` together; a longer text is a range of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and (held + len(t) > most_bytes or i - start >= most):
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)
