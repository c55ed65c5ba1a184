"""Hashes of words and byte strings with numpy, in blocks of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BLOCK = 1 << 20
_BASE = 0xD1342543DE82EF95
_TABLE = np.random.Generator(np.random.PCG64(41)).integers(1, 2**63, 256, dtype=np.uint64)
#: Bytes of white space: 9 to 13 and 32.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, everything else as it is.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def slices(batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what is made of a piece stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def lean(work: Callable) -> Callable:
    """work, for mapInArrow, in a worker that gives what it used back to the system.

    Spark keeps idle workers, a few for each core, beside those that run: what their allocators hold
    would count against the executor. Arrays of over 1 MB come from the system and return to it at once.
    """

    def run(batches):
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX1
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n, BLOCK) + 1
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Of the bytes' random numbers times powers: differences are hashes of ranges, up to a power."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix_sums(data)
    return mix((sums[ends] - sums[starts]) * powers(len(data))[1][starts])


def blocks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, block) of at least BLOCK bytes each, ending where white space stands."""
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not SPACE[data[end]]:
            more = np.flatnonzero(SPACE[data[end : end + BLOCK]])
            end = end + int(more[0]) if len(more) else min(len(data), end + BLOCK)
        yield at, data[at:end]
        at = end


def words(text: bytes, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a text in UTF-8; fold: A-Z count as a-z."""
    out = []
    for at, data in blocks(np.frombuffer(text, np.uint8)):
        edge = np.diff(np.concatenate(([True], SPACE[data], [True])).view(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        out.append((starts + at, ends + at, span_hashes(FOLD[data] if fold else data, starts, ends)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if len(out) > 1 else out[0]


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k hashes that follow each other."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc *= MIX1
        acc += hashes[j : j + n]
    return mix(acc)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of every width values that follow each other."""
    out, size = a, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def winnow(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of width grams: (anchor, first window, last window) of each run of windows whose least gram (of equal ones the last) stands at the same place."""
    n = len(grams)
    low = np.uint64(0xFFFFFFFF)
    ranked = (mix(grams) & ~low) | (low - np.arange(n, dtype=np.uint64))
    at = (low - (sliding_min(ranked, width) & low)).astype(np.int64)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate(([0], cut))
    return at[first], first, np.concatenate((cut, [len(at)])) - 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
