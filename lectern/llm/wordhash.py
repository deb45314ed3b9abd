"""Vectorised word hashing over a batch of texts."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
#: Bytes hashed at once; longer texts form blocks of their own.
BLOCK_BYTES = 1 << 20


def ascii_lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def whitespace_delimiters() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def symbol_delimiters() -> np.ndarray:
    """Every ASCII byte but letters, digits and the apostrophe."""
    t = np.zeros(256, dtype=bool)
    t[:128] = [not (chr(i).isalnum() or chr(i) == "'") for i in range(128)]
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_words(data: bytes, lower: np.ndarray, delimiter: np.ndarray, power: np.ndarray, inverse: np.ndarray):
    """(hash, start, end) of every maximal run of non-delimiter bytes of ``data``."""
    b = lower[np.frombuffer(data, dtype=np.uint8)]
    inside = np.empty(len(b) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(delimiter[b], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start]), start, end


def word_batches(texts, lower: np.ndarray, delimiter: np.ndarray, block: int = BLOCK_BYTES, ends: np.ndarray | None = None):
    """Yield (first, last, hashes, bounds): texts first..last-1, and for text k its words' hashes[bounds[k]:bounds[k+1]].

    ends: a table of bytes that end a sentence; then each word's sentence is
    yielded as well, numbered through the block.

    A null text has no words.  Texts are joined by a space in blocks of about
    ``block`` bytes; a longer text is a block of its own, whole.
    """
    power, inverse = powers(_P, block + 1), powers(_P_INVERSE, block + 1)
    first, parts, size = 0, [], 0

    def flush(last):
        nonlocal power, inverse
        data = b" ".join(parts)
        if len(data) + 1 > len(power):
            power, inverse = powers(_P, len(data) + 1), powers(_P_INVERSE, len(data) + 1)
        h, start, _ = hash_words(data, lower, delimiter, power, inverse)
        begins = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=begins[1:])
        found = first, last, h, np.searchsorted(start, begins)
        return found if ends is None else (*found, np.cumsum(ends[np.frombuffer(data, dtype=np.uint8)], dtype=np.int64)[start])

    for k, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if parts and size + len(raw) > block:
            yield flush(k)
            first, parts, size = k, [], 0
        parts.append(raw)
        size += len(raw) + 1
    if parts:
        yield flush(first + len(parts))
