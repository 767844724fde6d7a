"""Words and word shingles of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return space, mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the (odd) base and of its inverse modulo 2**64."""
    size = max(_PIECE + 1, 1 << int(n).bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for factor in (_BASE, inverse):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if size > _PIECE + 1:  # a huge word: not kept
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def _pieces(data: bytes) -> list[bytes]:
    """Cut at white space into pieces of about a megabyte; a longer word stays whole."""
    if len(data) <= _PIECE:
        return [data]
    space, _ = _tables()
    gaps = np.flatnonzero(space[np.frombuffer(data, np.uint8)])
    out, at = [], 0
    while at < len(data):
        k = np.searchsorted(gaps, at + _PIECE, "right") - 1
        cut = int(gaps[k]) if k >= 0 and gaps[k] > at else (int(gaps[k + 1]) if k + 1 < len(gaps) else len(data))
        out.append(data[at:cut + 1])
        at = cut + 1
    return out


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    space, values = _tables()
    raw = np.frombuffer(data, np.uint8)
    solid = np.concatenate(([False], ~space[raw], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * power[:len(raw)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and where each text's words begin (one more than texts).

    Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z.
    """
    encoded = [lower_ascii(t) for t in texts]
    if sum(map(len, encoded)) + len(encoded) <= 2 * _PIECE:
        joined = b"\n".join(encoded)
        hashes, starts = _hash_piece(joined)
        offsets = np.cumsum([0] + [len(e) + 1 for e in encoded])
        return hashes, np.searchsorted(starts, offsets)
    parts, counts = [], [0]
    for e in encoded:
        own = [_hash_piece(p)[0] for p in _pieces(e)]
        parts += own
        counts.append(sum(map(len, own)))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.cumsum(counts)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; with fewer words the whole sequence is one."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    total = np.full(n - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        total = mix(total + words[j:n - width + 1 + j]) * np.uint64(2 * j + 3)
    return mix(total)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; empty where there are no words."""
    words, at = hashed_words(texts)
    return [np.unique(shingle_hashes(words[at[i]:at[i + 1]], k)) for i in range(len(texts))]
