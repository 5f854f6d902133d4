"""Distinct word shingles of texts as 64-bit hashes, for whole Arrow batches at a time.

A word is a run of bytes other than space and \\x09-\\x0D; A-Z are lower-cased. Hashes are polynomials over the bytes, taken
from one running sum over the batch, so nothing is done per word in Python. All arithmetic is modulo 2**64. With 64 bits, one
wrong pair of equal hashes is expected among some 4 * 10**9 different shingles or texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Texts are hashed in groups of about so many bytes.
GROUP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cached: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _cached or len(_cached[0]) < n:
        size = max(n, 2 * GROUP_BYTES)
        tables = [_powers(_BASE, size), _powers(_INVERSE, size)]
        if size > 8 * GROUP_BYTES:
            return tables[0], tables[1]
        _cached[:] = tables
    return _cached[0], _cached[1]


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one more entry at the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]).translate(_LOWER), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_LETTERS[data] * power[: len(data)])))
    hashes = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    return hashes, np.concatenate(([0], np.searchsorted(first, ends)))


def _groups(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)


def shingle_sets(texts: Sequence[bytes | None], width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, sorted. Fewer words make one shingle, none an empty set."""
    texts = [t or b"" for t in texts]
    for lo, hi in _groups(texts):
        words, starts = word_hashes(texts[lo:hi])
        n = max(len(words) - width + 1, 0)
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            rolled += words[j : j + n] * np.uint64(int(_BASE) + 2 * j * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        rolled = mix(rolled)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                short = words[a:b] * (_BASE + np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(0x1000193))
                yield mix(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)], dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_hash(tokens: np.ndarray) -> int:
    """One signed 64-bit number for a set of shingles."""
    total = np.append(mix(tokens ^ _BASE), np.full(len(tokens), _INVERSE)).sum(dtype=np.uint64)
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def second_hash(tokens: np.ndarray) -> int:
    """Another signed 64-bit number for a set of shingles, independent of set_hash."""
    total = mix(tokens * _INVERSE + _BASE).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])
