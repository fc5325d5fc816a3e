"""Vectorised text kernels over Arrow string batches.

All kernels look at the UTF-8 bytes of a batch directly: no Python object per word is made.  A block is a run of
whole rows of about ``BLOCK_BYTES`` bytes; one longer row is a block of its own, so texts are never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)

#: The white space of the word definition ``[^\\x20\\x09-\\x0D]+``.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACE_BYTES)] = False
LEAD = (np.arange(256) & 0xC0) != 0x80
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def release_memory() -> None:
    """Gives freed memory back to the system: Python workers live on between stages and would keep their peaks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run):
    """A function over batches that gives its memory back when its task ends."""

    def whole(batches):
        yield from run(batches)
        release_memory()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_FOLDED = _BYTE[FOLD]
#: Bytes that are hashed at a time, so that the tables of powers stay small however long a text is.
WINDOW = 1 << 17


def _powers(base: int) -> np.ndarray:
    step = np.full(WINDOW + 1, base, dtype=np.uint64)
    step[0] = 1
    return np.cumprod(step, dtype=np.uint64)


_POWER, _INVERSE = _powers(_MULT), _powers(_INV)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each of the byte ranges, which are sorted and do not overlap.

    The hash is a polynomial of the bytes; the data is walked in windows, and a range over several of them adds up.
    """
    value, total = _BYTE_FOLDED if fold else _BYTE, np.zeros(len(starts), dtype=np.uint64)
    for at in range(0, len(data), WINDOW):
        first, past = int(np.searchsorted(ends, at, side="right")), int(np.searchsorted(starts, at + WINDOW))
        if first == past:
            continue
        here = value[data[at : at + WINDOW]]
        sums = np.zeros(len(here) + 1, dtype=np.uint64)
        np.cumsum(here * _POWER[: len(here)], out=sums[1:])
        begin, end = starts[first:past] - at, np.minimum(ends[first:past] - at, len(here))
        inside = np.maximum(begin, 0)
        part = (sums[end] - sums[inside]) * _INVERSE[inside]
        if begin[0] < 0:  # only the first range can have begun in an earlier window
            part[:1] *= np.uint64(pow(_MULT, -int(begin[0]), 1 << 64))
        total[first:past] += part
    return mix(total + (ends - starts).astype(np.uint64))


def parts(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Whole rows of a string or binary column in slices of about ``limit`` bytes; a longer row is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield col.slice(a, b - a)
        a = b


@dataclass
class Block:
    """Rows ``first`` to ``first + n`` of a batch: their bytes and the offsets of each row in them."""

    first: int
    n: int
    data: np.ndarray
    off: np.ndarray


def blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole rows of a string or binary column, in blocks; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = pc.fill_null(col, "")
        col = col.cast(pa.large_string()).cast(pa.large_binary())
    else:
        col = pc.fill_null(col, b"").cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield Block(a, b - a, data[off[a] : off[b]], off[a : b + 1] - off[a])
        a = b
    release_memory()


def _bounds(block: Block, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True, which never cross rows."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = member[1:] != member[:-1]
    inner = block.off[(block.off > 0) & (block.off < len(member))]
    change[inner - 1] = True
    at = np.flatnonzero(change) + 1
    starts = np.append(0, at)
    keep = member[starts]
    return starts[keep], np.append(at, len(member))[keep]


class Words:
    """The words of a block: bounds in bytes, 64-bit hashes, and for each row its first word."""

    def __init__(self, block: Block, fold: bool = False, member: np.ndarray | None = None):
        self.block = block
        self.starts, self.ends = _bounds(block, (NOT_SPACE if member is None else member)[block.data])
        self.rows = np.searchsorted(self.starts, block.off)
        self.counts = np.diff(self.rows)
        self.hashes = range_hashes(block.data, self.starts, self.ends, fold)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.block.n), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words in a row, and for each row where its runs begin."""
        w, n = self.hashes, len(self.hashes)
        per_row = np.maximum(self.counts - size + 1, 0)
        first = np.zeros(self.block.n + 1, dtype=np.int64)
        np.cumsum(per_row, out=first[1:])
        if n < size:
            return np.zeros(0, np.uint64), first
        total = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            total += w[k : n - size + 1 + k] * np.uint64(_odd(k))
        begin = np.repeat(self.rows[:-1] - first[:-1], per_row) + np.arange(first[-1])
        return mix(total[begin]), first

    def whole(self, row: int) -> int:
        """One hash for all words of a row; apart from windows' hashes by the number of words."""
        w = self.hashes[self.rows[row] : self.rows[row + 1]]
        total = (w * np.array([_odd(k) for k in range(len(w))], dtype=np.uint64)).sum(dtype=np.uint64)
        salted = (int(total) + 0x5851F42D4C957F2D * len(w)) % (1 << 64)
        return int(mix(np.array([salted], dtype=np.uint64))[0])


def _odd(k: int) -> int:
    return ((k + 1) * 0xD1342543DE82EF95 ^ (k << 17)) & 0xFFFFFFFFFFFFFFFF | 1


def per_row(block: Block, member: np.ndarray) -> np.ndarray:
    """How many bytes of each row are members."""
    out = np.zeros(block.n, dtype=np.int64)
    some = np.flatnonzero(np.diff(block.off))
    if len(some):
        out[some] = np.add.reduceat(member, block.off[some], dtype=np.int64)
    return out


def shingle_sets(block: Block, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its sorted distinct word shingles (lower-cased A-Z) as 64-bit hashes.

    With fewer than ``size`` words the whole sequence is the only shingle; without words there is none.
    """
    words = Words(block, fold=True)
    runs, first = words.windows(size)
    for k in range(block.n):
        if first[k + 1] > first[k]:
            yield k, np.unique(runs[first[k] : first[k + 1]])
        elif words.counts[k]:
            yield k, np.array([words.whole(k)], dtype=np.uint64)
        else:
            yield k, np.zeros(0, dtype=np.uint64)
