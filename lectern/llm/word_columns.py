"""Words of whole Arrow columns of texts, in numpy, for operators that count them.

A column is worked on in slices of about SLICE bytes. A text longer than that comes in several, cut at a byte where no word or
piece goes on, so memory is bounded by SLICE and the longest stretch without such a byte."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .hashing import scramble

SLICE = 4 << 20
_U = np.uint64
_BY_PLACE = np.random.default_rng(11).integers(1, 1 << 63, 4096, dtype=np.int64).astype(_U) * _U(2) + _U(1)
#: A-Z lower-cased, all other bytes as they are.
LOWER = np.frombuffer(bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)), np.uint8)


def bytes_in(*spans: tuple[int, int]) -> np.ndarray:
    """For each byte whether it lies in one of the spans."""
    held = np.zeros(256, bool)
    for a, b in spans:
        held[a : b + 1] = True
    return held


def gather(batches: Iterable[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Batches joined to tables of about `rows` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def slices(column: pa.Array, ends: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, places where texts begin, bytes), for texts or parts of one; a null is an empty text.

    ends: for each byte whether a long text may be cut behind it."""
    column = column.cast(pa.binary()).fill_null(b"")
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(int(np.searchsorted(at, at[i] + most, "right")) - 1, i + 1)
        if at[j] - at[i] <= most:
            yield i, at[i:j] - at[i], data[at[i] : at[j]]
        else:
            a, end = int(at[i]), int(at[j])
            while a < end:
                b = min(a + most, end)
                while b < end and not ends[data[b - 1]]:
                    found = np.flatnonzero(ends[data[b : min(b + most, end)]])
                    b = b + int(found[0]) + 1 if len(found) else min(b + most, end)
                yield i, np.zeros(1, np.int64), data[a:b]
                a = b
        i = j


class Words:
    """The words of a slice: maximal runs of bytes that `inside` holds, never across texts, with `table` applied to their bytes."""

    def __init__(self, starts: np.ndarray, data: np.ndarray, inside: np.ndarray, table: np.ndarray = LOWER):
        word = inside[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        heads = starts[starts < len(data)]
        begin[heads] = word[heads]
        #: Places of first bytes, and the text of each word.
        self.at = np.flatnonzero(begin)
        self.text = np.searchsorted(starts, self.at, "right") - 1
        self.data = table[data[word]]
        self.offsets = np.append(np.cumsum(word, dtype=np.int32)[self.at] - 1, len(self.data)).astype(np.int32) if len(self.at) else np.zeros(1, np.int32)

    def __len__(self) -> int:
        return len(self.at)

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """Codes of the words, and the words of the codes."""
        values = pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(self.offsets), pa.py_buffer(self.data)]).dictionary_encode()
        return values.indices.to_numpy().astype(np.int64), values.dictionary

    def hashes(self) -> np.ndarray:
        """64-bit hashes."""
        if not len(self):
            return np.zeros(0, _U)
        sizes = np.diff(self.offsets)
        place = np.arange(len(self.data)) - np.repeat(self.offsets[:-1], sizes)
        total = np.add.reduceat((self.data.astype(_U) + _U(1)) * _BY_PLACE[place & 4095], self.offsets[:-1])
        return scramble(total + sizes.astype(_U))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values: a sort, then a scan of runs. values: columns side by side, or one."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[heads], np.add.reduceat(values[order], heads, axis=0)


class Tally:
    """Sums by key of a task's slices, kept as Arrow tables: added up when they have more than `most` rows, and handed on when more than
    `keep` (half of them) are left then."""

    def __init__(self, keys: list[str], sums: list[str], most: int = 1_500_000, keep: int | None = None):
        self.keys, self.sums, self.most, self.keep, self.held, self.n = keys, sums, most, most // 2 if keep is None else keep, [], 0

    def add(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        self.held.append(t)
        self.n += t.num_rows
        if self.n > self.most:
            self._fold()
            if self.n > self.keep:
                yield from self.rest()

    def _fold(self) -> None:
        t = pa.concat_tables(self.held).group_by(self.keys, use_threads=False).aggregate([(s, "sum") for s in self.sums])
        t = t.select(self.keys + [f"{s}_sum" for s in self.sums]).rename_columns(self.keys + self.sums)
        self.held, self.n = [t], t.num_rows

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._fold()
            yield from self.held[0].combine_chunks().to_batches(max_chunksize=1 << 16)
        self.held, self.n = [], 0
