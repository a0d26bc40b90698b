"""64-bit hashes of words and of runs of words, for operators whose work is in numpy."""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
_PLACE = np.array([int.from_bytes(hashlib.blake2b(b"p%d" % j, digest_size=8).digest(), "little") | 1 for j in range(64)], dtype=_U)


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def hashes_of(words: list[bytes], memo: dict) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=_U, count=len(words))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order, from the words' hashes."""
    acc = np.zeros(max(len(h) - k + 1, 0), _U)
    for j in range(k if len(acc) else 0):
        acc += h[j : j + len(acc)] * _PLACE[j % 64]
        acc = scramble(acc) if k > 64 else acc
    return scramble(acc + _U(k))


class Bitmap:
    """Whether a 64-bit hash may be among those of a table: no false negatives. Its size has a bound, so false positives grow once the table
    outgrows it; what passes must still be joined."""

    MOST = 27  # 2**27 bits, 16 MB

    def __init__(self, hashes: DataFrame, name: str):
        n = hashes.count()
        self.shift = 64 - min(self.MOST, max(16, (16 * n).bit_length()))
        slot = F.shiftrightunsigned(F.col(name), self.shift)
        held = hashes.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 31 as int))) AS b"))
        self.bits = np.zeros(1 << (64 - self.shift - 5), np.uint32)
        for b in held.toArrow().to_batches():
            self.bits[b.column(0).to_numpy()] = b.column(1).to_numpy()

    def __contains__(self, h: int) -> bool:
        slot = (h & 0xFFFFFFFFFFFFFFFF) >> self.shift
        return bool(self.bits[slot >> 5] >> (slot & 31) & 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        slot = h >> _U(self.shift)
        return (self.bits[(slot >> _U(5)).astype(np.int64)] >> (slot & _U(31)).astype(np.uint32) & 1).astype(bool)
