"""Vectorised word and shingle hashing for Arrow batches of text.

The helpers work on one batch inside a task.  A word's 64-bit hash is a polynomial of
its UTF-8 bytes, read off prefix sums modulo 2**64 and then mixed; a shingle's hash
combines the hashes of its consecutive words.  Memory follows ``CHUNK`` bytes of text
plus eight bytes a word, not the batch.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Which bytes end a word: space and tab to carriage return; or every ASCII byte that is no digit or letter.
WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
PUNCTUATION = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _STEP[1]
    x = x ^ (x >> np.uint64(27))
    x = x * _STEP[2]
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK, 1 << int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size + 1, _BASE, dtype=np.uint64)
        down = np.full(size + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _powers[size] = up, down
    return _powers[size]


def _chunk_hashes(b: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words in one chunk of bytes."""
    edge = np.diff(np.concatenate(([True], sep, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.empty(0, np.uint64)
    up, down = _power_tables(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(texts: list[bytes | None], separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without separators, A-Z lowered) of all texts, and each text's first word index, with the total at the end."""
    joined = b" ".join([t or b"" for t in texts]) + b" "
    b = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    first_byte = np.concatenate(([0], np.cumsum(sizes)))
    starts, hashes, at = [], [], 0
    while at < len(b):
        stop = min(at + CHUNK, len(b))
        while stop < len(b) and not separators[joined[stop - 1]]:
            stop += 1  # a chunk ends behind a separator
        part = b[at:stop]
        part = np.where((part >= 65) & (part <= 90), part | 32, part)
        s, h = _chunk_hashes(part, separators[part])
        starts.append(s + at)
        hashes.append(h)
        at = stop
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.searchsorted(start, first_byte)


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes of ``n`` words; a text of fewer words gives its whole sequence as one, none gives an empty set."""
    h, first = words(texts)
    whole = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        whole = whole * _STEP[0] + h[k : k + len(whole)]
    whole = mix(whole + np.uint64(n))
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(whole[a : z - n + 1]))
        elif z > a:
            short = np.zeros(1, np.uint64)
            for x in h[a:z]:
                short = short * _STEP[0] + x
            out.append(mix(short + np.uint64(z - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
