"""Words separated by ASCII white space, and 64-bit hashes of words and word windows.

A word's hash is a polynomial over its bytes (prefix sums, so one pass over the text),
mixed; a window's hash is a multilinear sum over its words' hashes, mixed. Both depend
on the content alone and are equal on every machine.
"""

from __future__ import annotations

import re

import numpy as np

#: Bytes hashed at once; texts are cut at white space, so memory does not grow with them.
PIECE = 1 << 19
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_P, _PI = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_LANES = np.random.default_rng(40960001).integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _PI)):
            a = np.full(n, base, dtype=np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, dtype=np.uint8)
    solid = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(a) + 1)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _LANES[63])


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes, in order.

    Only a single word longer than ``PIECE`` makes a piece longer than that.
    """
    parts, at = [np.zeros(0, dtype=np.uint64)], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            gap = _GAP.search(raw, end)
            end = gap.start() if gap else len(raw)
        parts.append(_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out += words[k : k + n] * _LANES[k]
    return mix(out)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]
