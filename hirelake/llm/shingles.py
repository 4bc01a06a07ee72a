"""Sets of word shingles as sorted arrays of 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_BITS = np.random.default_rng(20240101)
_BYTE = _BITS.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _BITS.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Fixed value: what separates words (ASCII white space).
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PIECE = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Tables of powers are made once per task."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int):
        if len(self.up) <= n:
            with np.errstate(over="ignore"):
                size = max(n + 1, PIECE + 4096)
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _STEP)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BACK)], dtype=np.uint64)
        return self.up, self.down

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and begin of every word in ``data`` (texts lie one after the other, cut at ``offsets``)."""
        hashes, begins, a, n = [], [], 0, len(data)
        cuts = np.zeros(n + 1, bool)
        cuts[offsets] = True
        while a < n:
            b = min(n, a + PIECE)
            while b < n and not (_SEPARATES[data[b]] or cuts[b]):  # on to the end of the word
                b += 1
            part = _LOWER[data[a:b]]
            apart = _SEPARATES[part]
            first = ~apart & (np.r_[True, apart[:-1]] | cuts[a:b])
            last = ~apart & (np.r_[apart[1:], True] | np.r_[cuts[a + 1 : b], True])
            start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
            up, down = self._powers(len(part) + 1)
            sums = np.r_[np.uint64(0), np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64)]
            hashes.append(_mixed((sums[stop] - sums[start]) * down[start]))
            begins.append(start + a)
            a = b
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(begins)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each text its distinct shingle hashes in ascending order. Texts of fewer words make one shingle of all of them."""
        words, begins = self._words(data, offsets)
        ends = np.searchsorted(begins, offsets)
        n = max(0, len(words) - WORDS + 1)
        joined = np.zeros(n, np.uint64)
        for k in range(WORDS):
            joined += words[k : k + n] * _PLACE[k]
        joined = _mixed(joined)
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= WORDS:
                s = np.sort(joined[a : b - WORDS + 1])
                out.append(s[np.r_[True, s[1:] != s[:-1]]])
            elif b > a:
                few = np.sum(words[a:b] * _PLACE[: b - a], dtype=np.uint64) ^ np.uint64(b - a)
                out.append(_mixed(np.array([few], np.uint64)))
            else:
                out.append(words[:0])
        return out


def fingerprint(shingles: np.ndarray) -> str:
    """128 bits of the whole set in hex."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()
