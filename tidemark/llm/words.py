"""Words of many texts at once, by byte classes in numpy.

A separator class that only holds ASCII bytes splits UTF-8 correctly byte by
byte, so no text is decoded. A word's 64-bit hash mixes its bytes eight at a time, each
step after the one before (no sum of bytes, which structured words can make equal);
long words take BLAKE2b. Callers whose results must not rest on a hash compare the bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_FACTORS = np.random.default_rng(20240608).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes from which a word is hashed by BLAKE2b.
LONG = 64

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space parts: all but space and \t to \r.
BY_SPACE = np.ones(256, bool)
BY_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of alphanumeric words: digits, lower-case letters and all beyond ASCII.
BY_SIGN = np.ones(256, bool)
BY_SIGN[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of each row's first word, and the total
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, seed: int = 0) -> Words:
    """Words of the rows data[offsets[i]:offsets[i+1]] after lower-casing A-Z."""
    data = LOWER[data]
    n = len(data)
    word = inside[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    begin = offsets[:-1][offsets[:-1] < n]
    start[begin] = word[begin]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = word[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, s, e, np.searchsorted(s, offsets), hash_words(data, s, e, seed))


def lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(indices of the words that reach so far, their next eight bytes as integers), eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    which, size, step = np.arange(len(start)), end - start, 0
    while len(which):
        left = size[which] - 8 * step
        found = eights[start[which] + 8 * step]
        cut = np.flatnonzero(left < 8)
        found[cut] &= (np.uint64(1) << (left[cut].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        yield which, found
        which, step = which[left > 8], step + 1


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    size = end - start
    out = np.full(len(start), mix(np.array([seed + 1], np.uint64))[0], np.uint64)
    short = np.flatnonzero(size < LONG)
    own = out[short]
    for which, found in lanes(data, start[short], end[short]):
        own[which] = mix(own[which] ^ found) * _STEP
    out[short] = own
    out = mix(out + size.astype(np.uint64))
    for i in np.flatnonzero(size >= LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def same_words(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the i-th words of both (data, starts, ends) have the same bytes."""
    size = a[2] - a[1]
    out = size == b[2] - b[1]
    for i in np.flatnonzero(out & (size >= LONG)).tolist():
        out[i] = a[0][a[1][i] : a[2][i]].tobytes() == b[0][b[1][i] : b[2][i]].tobytes()
    short = np.flatnonzero(out & (size < LONG))
    for (which, x), (_, y) in zip(*(lanes(data, start[short], end[short]) for data, start, end in (a, b))):
        out[short[which[x != y]]] = False
    return out


def join(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, by the position of the first; runs that cross rows are the caller's to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return join_at(hashes, np.arange(n), k) if n < 1024 else _join(lambda i: hashes[i : i + n], k)


def join_at(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words that begin at the given places."""
    return _join(lambda i: hashes[at + i], k)


def _join(step, k: int) -> np.ndarray:
    out = step(0) * _FACTORS[0]
    for i in range(1, k):
        out += step(i) * _FACTORS[i]
    return mix(out)
