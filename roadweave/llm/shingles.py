"""64-bit digests of word shingles, computed for whole batches of texts with numpy.

Words are runs of bytes other than space and 0x09-0x0D; A-Z counts as a-z. A word's digest is a
polynomial over 2^64 with a random value for each byte, taken from prefix sums over all texts of
a batch; a shingle's digest mixes those of its words in order. Equal shingles have equal digests;
for different ones the chance of equal digests is about 2^-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of text that are digested at once; a longer text is digested alone.
BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = [_powers(_BASE, 4096), _powers(_INVERSE, 4096)]


def _power(k: int, n: int) -> np.ndarray:
    if len(_POWERS[k]) < n:
        _POWERS[k] = _powers((_BASE, _INVERSE)[k], max(n, BLOCK))
    return _POWERS[k][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_digests(texts: list[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = np.concatenate(([False], ~_SPACE[data]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _power(0, len(data)), dtype=np.uint64)))
    word = mix64((total[end] - total[start]) * _power(1, len(data))[start] + (end - start).astype(np.uint64))
    borders = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))
    roll = word.copy()
    for k in range(1, width):
        roll[: len(word) - k] = mix64(roll[: len(word) - k] * np.uint64(0xD6E8FEB86659FD93) + word[k:])
    out = []
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(roll[a : b - width + 1]))
        elif b > a:
            x = word[a : a + 1].copy()
            for k in range(a + 1, b):
                x = mix64(x * np.uint64(0xD6E8FEB86659FD93) + word[k : k + 1])
            out.append(mix64(x + np.uint64(int(b - a))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: Iterable[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct digests of its ``width``-word shingles.

    Fewer words count as one shingle; no words give an empty set.
    """
    block: list[bytes] = []
    size = 0
    for t in texts:
        if block and size + len(t) > BLOCK:
            yield from _block_digests(block, width)
            block, size = [], 0
        block.append(t)
        size += len(t) + 1
    if block:
        yield from _block_digests(block, width)
