"""Words of UTF-8 texts as 64-bit hashes, without a Python loop over words.

Both word rules of this package split at ASCII bytes only, so they can run on the bytes: every byte of a multi-byte
character is a word byte. A word's hash is a sum of random numbers drawn for its bytes, each times a power that its place
gives, modulo 2**64, then mixed.
"""

from __future__ import annotations

import numpy as np

_random = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case.
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
#: Words of [^\x20\x09-\x0D]+.
SOLID = np.ones(256, bool)
SOLID[0x20] = SOLID[0x09:0x0E] = False

_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        more[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(more)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word, in bytes."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = member[data]
    edge = np.diff(flags)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Bytes that are worked on at once; the temporary arrays take about 40 times this.
SEGMENT = 1 << 20


def _segment_hashes(data: np.ndarray, member: np.ndarray) -> np.ndarray:
    starts, ends = word_bounds(data, member)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = data[member[data]]
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        parts = _BYTE[inside] * _powers_to(int(lengths.max()))[place]
        return mix(np.add.reduceat(parts, first) + lengths.astype(np.uint64))


def word_hashes(text: bytes, member: np.ndarray, lower: bool) -> np.ndarray:
    """A hash for each word, in order. Long texts are worked on in pieces that end between words."""
    data = np.frombuffer(text, np.uint8)
    if lower:
        data = LOWER[data]
    if len(data) <= SEGMENT:
        return _segment_hashes(data, member)
    out, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and member[data[end]]:
            gaps = np.flatnonzero(~member[data[end : end + SEGMENT]])
            end = end + int(gaps[0]) if len(gaps) else min(end + SEGMENT, len(data))
            if len(gaps):
                break
        out.append(_segment_hashes(data[at:end], member))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = words[:n].copy()
        for j in range(1, k):
            total = total * _GRAM + words[j : j + n]
        return mix(total)
