"""Words of many texts as numpy arrays: spans, 64-bit hashes, rolling windows.

A batch of texts is joined into one byte buffer; a 256-entry table tells word bytes from separators, so UTF-8 needs
no decoding. Each word is hashed by multilinear hashing over its bytes, all words of the buffer at once.
"""

from __future__ import annotations

import hashlib

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20_240_607))
_LONGEST = 4096
_BYTE_KEYS = _RANDOM.integers(0, 2**63, size=(2, _LONGEST), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_KEYS = _RANDOM.integers(0, 2**63, size=(2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Separators of words split at ASCII white space.
SPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: Separators where only ASCII letters and digits, and every byte beyond ASCII, belong to words.
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each bit of h over the word, in place."""
    for factor in _MIX:
        h ^= h >> np.uint64(33)
        h *= factor
    h ^= h >> np.uint64(33)
    return h


class Words:
    """Words of several texts: buf holds all bytes; word i spans starts[i]:ends[i]; text t has words first[t]:first[t+1]."""

    def __init__(self, texts: list[bytes], is_separator: np.ndarray, lower: bool = False):
        buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        if lower:
            table = is_separator.copy()
            table[0x41:0x5B] = False
            self.buf, inside = _LOWER[buf], ~table[buf]
        else:
            self.buf, inside = buf, ~is_separator[buf]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.inside, self.starts, self.ends = inside, edges[0::2], edges[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, self.text_starts)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, dtype=np.uint64)
        begin = self.starts[0]
        gaps = np.diff(np.append(self.starts, len(self.buf)))
        place = np.arange(begin, len(self.buf), dtype=np.int64)
        place -= np.repeat(self.starts, gaps)
        place &= _LONGEST - 1
        value = self.buf[begin:].astype(np.uint64)
        value += np.uint64(1)
        value *= _BYTE_KEYS[which][place]
        value *= self.inside[begin:]
        h = np.add.reduceat(value, self.starts - begin)
        lengths = self.ends - self.starts
        for i in np.flatnonzero(lengths > _LONGEST):
            digest = hashlib.blake2b(self.buf[self.starts[i] : self.ends[i]].tobytes(), digest_size=8, person=bytes([which]))
            h[i] = int.from_bytes(digest.digest(), "little")
        h ^= lengths.astype(np.uint64) * _MIX[0]
        return mix(h)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def windows(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each k consecutive hashes; it ignores where texts end."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += h[j : j + n] * _WORD_KEYS[which][j]
    return mix(out)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values."""
    edges = np.flatnonzero(np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[0::2], edges[1::2]
