"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed over a batch's bytes at once."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import mix64

_FACTOR = np.uint64(0x9DDFEA08EB382D69)
_BASE = 0x5851F42D4C957F2F
_POWERS: tuple[np.ndarray, np.ndarray] = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))
#: A random value for each byte, the same for A-Z as for a-z; bytes 9-13 and 32 part words.
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_VALUE = mix64(_LOWER + np.uint64(1))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS = tuple(np.cumprod(np.concatenate([[1], np.full(size, base)]).astype(np.uint64)) for base in (_BASE, pow(_BASE, -1, 2**64)))
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of the text; a word is a maximal run of bytes that are no ASCII white space.

    A word's hash is its polynomial in the base, taken from prefix sums over the whole text.
    """
    raw = np.frombuffer(text, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(~_SPACE[raw], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * power[: len(raw)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * inverse[start] ^ ((end - start).astype(np.uint64) * _FACTOR))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text with fewer words is one shingle, one without words has none."""
    found = word_hashes(text.encode()) if text else np.zeros(0, dtype=np.uint64)
    if not len(found):
        return found
    if len(found) < words:
        h = np.array([len(found)], dtype=np.uint64)
        for k in range(len(found)):
            h = mix64(h * _FACTOR + found[k : k + 1])
        return h
    n = len(found) - words + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        h = mix64(h * _FACTOR + found[k : k + n])
    return np.unique(h)


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
