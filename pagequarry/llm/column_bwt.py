"""Burrows-Wheeler transform of a collection, built column by column through sequential files.

Each round inserts one symbol of every sequence that has one left, from the last to the first. The
sorted suffixes so far are a pile for each first symbol; what the file of a round keeps of a suffix is its first
symbol, the place of the suffix behind it (its parent), its place in the texts, and the length of the
prefix that it shares with the one before it, up to a cap. A round reads the last one's file from front to back, in
blocks, three times: the first pass finds where the new suffixes go (parents ascend within a pile, so a suffix
goes where its parent's place says) and who their neighbours are; the second answers what new
neighbours share, one more than the least between their parents, by running counts of the places
below each length; the third merges old and new into the next file. What is held in memory is a block, the
round's new suffixes, one place for each sequence, and how far each old suffix moves.

A symbol is ``width`` bytes, known by a 64-bit hash; a text gives ``width`` sequences, one for each
offset, so every byte starts a suffix.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

from .grams import mix, powers, prefix_sums

#: Suffixes of a block.
ROWS = 1 << 16
KINDS = (np.dtype("<u8"), np.dtype("<i4"), np.dtype("<i4"), np.dtype("u1"))
ROW_BYTES = sum(k.itemsize for k in KINDS)
#: symbol, parent, suffix, common
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Files:
    """The sorted suffixes of a round in a file of the shared folder, read and written in blocks; a round's file goes when the next one's is whole."""

    def __init__(self, fs, folder: str):
        self.fs, self.stem, self.round, self.rows = fs, f"{folder}/{uuid.uuid4().hex}", 0, 0

    def _path(self) -> str:
        return f"{self.stem}-{self.round}"

    def read(self) -> Iterator[tuple[int, Block]]:
        """(place of its first suffix, block)."""
        if not self.rows:
            return
        at = 0
        with self.fs.open_input_stream(self._path()) as f:
            while head := f.read(8):
                n = int.from_bytes(head, "little")
                raw, start, columns = f.read(n * ROW_BYTES), 0, []
                for kind in KINDS:
                    columns.append(np.frombuffer(raw, kind, n, start))
                    start += n * kind.itemsize
                yield at, tuple(columns)
                at += n

    def write(self, blocks: Iterator[Block]) -> None:
        """blocks may read the last round's file while they are made."""
        old, rows, last = self._path() if self.rows else None, 0, f"{self.stem}-{self.round + 1}"
        with self.fs.open_output_stream(last) as f:
            for block in blocks:
                for at in range(0, len(block[0]), ROWS):
                    part = [c[at : at + ROWS] for c in block]
                    f.write(len(part[0]).to_bytes(8, "little") + b"".join(c.astype(k, copy=False).tobytes() for c, k in zip(part, KINDS, strict=True)))
                    rows += len(part[0])
        self.round, self.rows = self.round + 1, rows
        if old:
            self.fs.delete_file(old)

    def close(self) -> None:
        if self.rows:
            self.fs.delete_file(self._path())
            self.rows = 0


def _places(files: Files, symbols: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where new suffixes, sorted by symbol and parent, go among the old ones, and (symbol, parent) of the old ones before and behind them; parent -1 where there is none."""
    k = len(symbols)
    at, before, behind = np.full(k, files.rows, np.int64), np.zeros(k, np.uint64), np.zeros(k, np.uint64)
    before_up, behind_up = np.full(k, -1, np.int64), np.full(k, -1, np.int64)
    done, last = 0, None
    for base, (symbol, parent, _, _) in files.read():
        # within a pile parents ascend: of equal symbols those with lesser parents come first
        near = slice(done, int(np.searchsorted(symbols, symbol[-1], "right")))  # those behind go to later blocks
        left, right = np.searchsorted(symbol, symbols[near], "left"), np.searchsorted(symbol, symbols[near], "right")
        spot = left.copy()
        mixed = np.flatnonzero(right > left)
        if len(mixed):
            # rank of each symbol in the block, so that (rank, parent) is one sortable number
            rank = np.cumsum(np.concatenate(([0], symbol[1:] != symbol[:-1]))).astype(np.int64)
            keys = rank << 32 | parent
            spot[mixed] = np.searchsorted(keys, rank[left[mixed]] << 32 | up[near][mixed])
        inside = int(np.searchsorted(spot, len(symbol), "left"))
        own, where = slice(done, done + inside), spot[:inside]
        at[own] = base + where
        behind[own], behind_up[own] = symbol[where], parent[where]
        first = where == 0
        before[own], before_up[own] = symbol[np.maximum(where - 1, 0)], parent[np.maximum(where - 1, 0)]
        if last:
            before[own], before_up[own] = np.where(first, last[0], before[own]), np.where(first, last[1], before_up[own])
        else:
            before_up[own] = np.where(first, -1, before_up[own])
        done += inside
        last = (symbol[-1], int(parent[-1]))
        if done == k:
            break
    if last and done < k:
        before[done:], before_up[done:] = last
    return at, before, before_up, behind, behind_up


def _shared(files: Files, low: np.ndarray, high: np.ndarray, n_empty: int, cap: int) -> np.ndarray:
    """One more than what all suffixes behind place low up to place high share with their neighbours, cap at most. Places count the empty suffixes, which share nothing."""
    asked = np.concatenate((low, high))
    order = np.argsort(asked, kind="stable")
    places = asked[order] - n_empty
    counts = np.zeros((cap - 1, len(asked)), np.int64)
    counts[:, :] = np.minimum(places + n_empty, n_empty - 1) + 1
    totals, done = np.full(cap - 1, n_empty), int(np.searchsorted(places, 0))
    for base, (_, _, _, common) in files.read():
        end = int(np.searchsorted(places, base + len(common)))
        own = places[done:end] - base
        for t in range(1, cap):
            below = np.cumsum(common < t, dtype=np.int32)
            counts[t - 1, done:end] = totals[t - 1] + below[own]
            totals[t - 1] += int(below[-1])
        done = end
        if done == len(places):
            break
    back = np.empty_like(counts)
    back[:, order] = counts
    n = len(low)
    return (1 + (back[:, :n] == back[:, n:]).sum(0)).astype(np.uint8)


def _merged(files: Files, at: np.ndarray, new: Block, renewed: np.ndarray, common: np.ndarray, moves: np.ndarray, n_empty: int) -> Iterator[Block]:
    """Old and new suffixes in order. renewed: old places whose common prefix is now that in common; moves: how far each old one moves."""
    done = fixed = 0
    for base, (symbol, parent, suffix, shares) in files.read():
        end, to = int(np.searchsorted(at, base + len(symbol))), int(np.searchsorted(renewed, base + len(symbol)))
        shares = shares.copy()
        shares[renewed[fixed:to] - base] = common[fixed:to]
        where = at[done:end] - base
        yield tuple(np.insert(old, where, more[done:end]) for old, more in zip((symbol, _moved(parent, moves, n_empty), suffix, shares), new, strict=True))
        done, fixed = end, to
    yield tuple(more[done:] for more in new)


def _moved(places: np.ndarray, moves: np.ndarray, n_empty: int) -> np.ndarray:
    """Where what stood at places stands when new suffixes have come in; the last of moves is for the empty ones."""
    return (places + moves[np.maximum(places - n_empty, -1)]).astype(np.int32)


def build(texts: list[bytes], width: int, cap: int, files: Files) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffix, common) by blocks: the place in the joined texts of every suffix, sorted, and how many symbols it shares with the one before it, up to cap."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    sums, inverse = prefix_sums(data), powers(len(data))[1]
    n_empty = width * len(texts)
    spot = np.arange(n_empty, dtype=np.int64)  # of each sequence: the place of its last inserted suffix, behind the empty ones
    for r in range(int(sizes.max(initial=0)) // width):
        # a text's suffixes of r + 1 symbols, one for each offset from its end
        at_end = np.flatnonzero(sizes >= width * (r + 1))
        last = sizes[at_end] - width * (r + 1)
        many = np.minimum(last + 1, width)
        text = np.repeat(at_end, many)
        shift = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        place = (ends - sizes)[text] + np.repeat(last, many) - shift
        sequence = text * width + shift
        symbols, up = mix((sums[place + width] - sums[place]) * inverse[place]), spot[sequence]
        order = np.lexsort((up, symbols))
        symbols, up, place, sequence = symbols[order], up[order], place[order], sequence[order]
        at, before, before_up, behind, behind_up = _places(files, symbols, up)
        k = len(at)
        # neighbours: a new suffix and what now stands before it; and what stands behind the last new one of a place
        follows = np.concatenate(([False], at[1:] == at[:-1]))
        before[follows], before_up[follows] = symbols[:-1][follows[1:]], up[:-1][follows[1:]]
        ends_run = np.concatenate((at[1:] != at[:-1], [True])) & (behind_up >= 0)
        pairs_low, pairs_high = np.concatenate((before_up, up[ends_run])), np.concatenate((up, behind_up[ends_run]))
        same = np.concatenate(((before == symbols) & (before_up >= 0), symbols[ends_run] == behind[ends_run]))
        shares = np.zeros(len(same), np.uint8)
        if same.any():
            shares[same] = _shared(files, pairs_low[same], pairs_high[same], n_empty, cap) if cap > 1 else 1
        moves = np.cumsum(np.bincount(at, minlength=files.rows + 1), dtype=np.int32)
        moves[-1] = 0
        new = (symbols, _moved(up, moves, n_empty), place.astype(np.int32), shares[:k])
        files.write(_merged(files, at, new, at[ends_run], shares[k:], moves, n_empty))
        spot[sequence] = n_empty + at + np.arange(k)
        # sequences that have ended stay where they are, and their places no longer matter
    for _, (_, _, suffix, common) in files.read():
        yield suffix, common
    files.close()
