"""Vectorised words, lines, shingles and hashes over the UTF-8 bytes of Arrow strings.

Words are the runs of bytes outside space and 0x09-0x0D. In UTF-8 these bytes never occur inside a
longer character, so working on bytes gives the same words as working on code points.
Hashes are 64 bits wide: a polynomial over byte values drawn by splitmix64, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is handled alone.
SLICE_BYTES = 512 << 10
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: What this process keeps between tasks: by name, how to give it up.
_kept: dict[str, Callable[[], None]] = {}


def keeps(name: str, give_up: Callable[[], None]) -> None:
    """Notes that this process keeps something large until a task that doesn't use it begins."""
    _kept[name] = give_up


def _begin(uses: str | None) -> None:
    for name in [n for n in _kept if n != uses]:
        _kept.pop(name)()
    _trim()


def _trim() -> None:
    """Hands memory that is free back to the system; without this a worker that is reused stays as large as it ever was."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def task(f: Callable, uses: str | None = None) -> Callable:
    """``f`` for ``mapInArrow``, run in a process that keeps nothing of other operators (but what it ``uses``) and no free memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(uses)
        try:
            yield from f(batches)
        finally:
            _trim()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of the texts in them; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` bytes together, or one text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


class SpanHashes:
    """Hashes of any byte ranges of one buffer."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        values = BYTE_VALUES[LOWER_BYTES] if lower else BYTE_VALUES
        forth, self.back = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * forth[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class SequenceHashes:
    """Hashes of any ranges of a sequence of hashes."""

    def __init__(self, hashes: np.ndarray):
        forth, self.back = _power_tables(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes) * forth[: len(hashes)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of ``size`` words that lies in one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = mix(out * BASE + hashes[at + k])
    return out, at


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its lower-cased word windows.

    A text of fewer than ``size`` words has its whole sequence as the one member; without words the set is empty.
    """
    data, offsets = texts_of(column)
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, owner = words_of(part, at)
        hashes = SpanHashes(part, lower=True).of(starts, ends)
        grams, place = windows(hashes, owner, size)
        n_words = np.bincount(owner, minlength=hi - lo)
        bounds = np.concatenate(([0], np.cumsum(np.maximum(n_words - size + 1, 0))))
        word_at = np.concatenate(([0], np.cumsum(n_words)))
        for k in range(hi - lo):
            if n_words[k] >= size:
                yield np.unique(grams[bounds[k] : bounds[k + 1]])
            elif n_words[k]:
                one = np.full(1, n_words[k], np.uint64)
                for h in hashes[word_at[k] : word_at[k + 1]]:
                    one = mix(one * BASE + h)
                yield one
            else:
                yield np.zeros(0, np.uint64)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every \\n-separated line; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate((offsets[:-1], breaks + 1))
    ends = np.concatenate((breaks, offsets[1:]))
    texts = np.concatenate((np.arange(len(offsets) - 1), owner))
    texts_end = np.concatenate((owner, np.arange(len(offsets) - 1)))
    a, b = np.lexsort((starts, texts)), np.lexsort((ends, texts_end))
    return starts[a], ends[b], texts[a]
