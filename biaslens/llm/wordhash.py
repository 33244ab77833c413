"""64-bit hashes of words and of runs of words, in numpy.

A word's hash is the polynomial of its bytes, taken from prefix sums over the
whole buffer (all words at once, no Python object per word), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FINAL = np.uint64(0xC2B2AE3D27D4EB4F)
BASE = 0xD6E8FEB86659FD93        # odd, so it has an inverse modulo 2^64
BUFFER = 1 << 18        # bounds a worker's tables (8 MB) and temporary arrays

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:  # doubling: out[done:2 * done] = out[:done] * base^done
        k = min(done, n - done)
        out[done:done + k] = out[:k] * np.uint64(step)
        done, step = done + k, step * step % (1 << 64)
    return out


class _Tables:
    def __init__(self):
        self.n = 0

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * BUFFER)
            self.up = _powers(BASE, self.n)
            self.down = _powers(pow(BASE, -1, 1 << 64), self.n)


_tables = _Tables()


def _hash_buffer(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of the buffer."""
    raw = np.frombuffer(buffer, dtype=np.uint8)
    _tables.grow(len(raw) + 1)
    gap = np.concatenate([[True], _SPACE[raw], [True]])
    start = np.flatnonzero(gap[:-1] & ~gap[1:])
    end = np.flatnonzero(~gap[:-1] & gap[1:])
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _tables.up[:len(raw)], out=total[1:])
    h = (total[end] - total[start]) * _tables.down[start]
    h ^= (end - start).astype(np.uint64) * MULTIPLIER
    h ^= h >> np.uint64(32)
    h *= FINAL
    return start, h ^ (h >> np.uint64(29))


def _long(text: bytes) -> np.ndarray:
    """Hashes of a text above the buffer size, a piece of whole words at a time."""
    parts, at = [], 0
    while at < len(text):
        to = at + BUFFER
        while to < len(text) and not _SPACE[text[to]]:
            to += 1
        parts.append(_hash_buffer(text[at:to])[1])
        at = to
    return np.concatenate(parts)


def word_hashes(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    held, size = [], 0
    for t in texts:
        if len(t) > BUFFER:
            yield from _flush(held)
            held, size = [], 0
            yield _long(t)
            continue
        if size + len(t) >= BUFFER:
            yield from _flush(held)
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    yield from _flush(held)


def _flush(texts: list[bytes]) -> Iterator[np.ndarray]:
    if texts:
        start, h = _hash_buffer(b" ".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        cut = np.searchsorted(start, ends)
        at = 0
        for to in cut.tolist():
            yield h[at:to]
            at = to


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (empty if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = hashes[:n].copy()
    for i in range(1, k):
        h *= MULTIPLIER
        h ^= h >> np.uint64(29)
        h += hashes[i:n + i]
    h ^= h >> np.uint64(32)
    h *= FINAL
    h ^= h >> np.uint64(29)
    return h


def remixed(h: np.ndarray) -> np.ndarray:
    """One-to-one: spreads hashes that were picked for being small."""
    h = h * FINAL
    return (h ^ (h >> np.uint64(31))) * MULTIPLIER
