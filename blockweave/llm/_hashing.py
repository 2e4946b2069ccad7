"""Vectorised 64-bit hashes of the words of many texts."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np

#: Bytes hashed at once.  A longer text is taken in blocks that end at white space.
BLOCK = 1 << 20
#: Bytes of a word that is hashed from its parts of eight bytes; a longer one by blake2b.
PARTS = 64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: A-Z to a-z and the ASCII white space 9-13 to a blank; other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, and a random value for each byte."""
    n = BLOCK + 1
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    value = np.random.default_rng(20111).integers(1, 1 << 63, 256, dtype=np.uint64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down), value


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of folded bytes."""
    blank = np.ones(len(data) + 2, bool)
    np.equal(data, 32, out=blank[1:-1])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and bucket hashes of the words of at most BLOCK folded bytes: sums of powers, so not for telling words apart."""
    up, down, value = _powers()
    start, end = _edges(data)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * down[: len(data)], out=total[1:])
    return start, mix((total[end] - total[start]) * up[start] + (end - start).astype(np.uint64))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; what lies behind the end is 0."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))


def _word_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit names of the words of folded bytes.

    Eight bytes at a time go through ``mix``, which is one to one: words of up to eight bytes of one length never share a name,
    and no pattern of letters makes longer ones do so, as it does with sums of powers modulo 2^64.
    """
    start, end = _edges(data)
    size = end - start
    part = eights(data)
    h = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1))
    left = np.flatnonzero(size <= PARTS)
    at = 0
    while len(left):
        x = part[start[left] + at]
        short = np.maximum(0, 8 - (size[left] - at)).astype(np.uint64) * np.uint64(8)
        h[left] = mix((h[left] ^ ((x << short) >> short)) * np.uint64(_BASE))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > PARTS):
        h[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return start, h


def _long_words(data: np.ndarray) -> np.ndarray:
    found, i = [], 0
    while i < len(data):
        j = min(i + BLOCK, len(data))
        if j < len(data) and data[j] != 32:
            blanks = np.flatnonzero(data[i:j] == 32)
            if len(blanks):
                j = i + int(blanks[-1]) + 1
            else:  # one word of a block or more
                after = j
                while after < len(data) and data[after] != 32:
                    rest = np.flatnonzero(data[after : after + BLOCK] == 32)
                    after = after + int(rest[0]) if len(rest) else min(after + BLOCK, len(data))
                found.append(np.frombuffer(blake2b(data[i:after].tobytes(), digest_size=8).digest(), np.uint64))
                i = after
                continue
        found.append(_word_names(data[i:j])[1])
        i = j
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, in order; case of A-Z does not count."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        size, j = len(texts[i]), i + 1
        while j < len(texts) and size + 1 + len(texts[j]) < BLOCK:
            size += 1 + len(texts[j])
            j += 1
        data = FOLD[np.frombuffer(b" ".join(texts[i:j]), np.uint8)]
        if len(data) > BLOCK:
            out.append(_long_words(data))
        else:
            start, h = _word_names(data)
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]])[:-1]
            out += np.split(h, np.searchsorted(start, ends))
        i = j
    return out


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of fewer words, the whole sequence as one."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    h = mix(words[: len(words) - k + 1] + np.uint64(k))
    for i in range(1, k):
        h = mix(h * np.uint64(_BASE) + words[i : len(words) - k + 1 + i])
    return np.unique(h)
