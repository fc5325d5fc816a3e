"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of texts is split into pieces by the tokenizer's pattern; its distinct pieces are laid out as one array of
byte tokens.  An inverted index maps the rank of a token pair to the positions where that pair stands now.
Ranks are taken in order from a heap; a rank's positions are merged in all pieces at once, and only the pairs
with the two neighbours of a merged position are looked up again and indexed.

Within a piece the order must be that of the classic algorithm: lowest rank first, leftmost first.  Where a merge
makes a pair of a lower rank than its own (possible in odd vocabularies), that piece takes only its leftmost merge
and its other positions go back to the index, so the lower rank is replayed before them.

The corpus of a replay is a group of texts: each piece gets a number, a text is the array of its pieces' numbers, and
only pieces that are new are replayed.  Numbers and tokens of up to ``CACHE_PIECES`` pieces stay for the later groups
of the same Python worker.  A global table of pieces would have to be joined back to every occurrence, which shuffles
more than the texts themselves.

Defined results: null text is empty text, which has no tokens; null ids decode to null; repeated rows get equal
results; a text of any length is encoded whole, though its pieces are never in memory all together; an empty table gives an empty
one.  The functions are of one column, so no other column clashes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.llm.kernels import parts, release_memory

NONE = np.int32(np.iinfo(np.int32).max)
#: Bytes of the texts that are replayed together: whole batches, a long text alone.
GROUP_BYTES = 8 << 20
#: Pieces that stay for later groups, and their characters.
CACHE_PIECES = 100_000
CACHE_CHARS = 1_000_000
#: Bytes of a batch that are Python strings at a time.
PART_BYTES = 2 << 20


class _Numbers(dict):
    """Pieces in the order they were first asked for; new ones are listed."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Vocabulary:
    """Ranks of a ``.tiktoken`` file; a token's id is its rank, and a pair's rank is that of its joined bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.token: list[bytes] = [b""] * size
        for t, r in ranks.items():
            self.token[r] = t
        self.number = [b"%d" % k for k in range(size)]
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        a, b, c = [], [], []
        for t, r in ranks.items():
            for cut in range(1, len(t)):
                left, right = ranks.get(t[:cut]), ranks.get(t[cut:])
                if left is not None and right is not None:
                    a.append(left)
                    b.append(right)
                    c.append(r)
        keys = np.array(a, np.int64) * size + np.array(b, np.int64)
        by = np.argsort(keys)
        self.size, self.keys, self.values = size, keys[by], np.array(c, np.int32)[by]
        self.numbers, self.chars = _Numbers(), 0
        self.tokens, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}, pattern)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' tokens one after another, and where each piece begins."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        begin = np.append(0, np.cumsum(lengths))
        n = int(begin[-1])
        tok = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[begin[1:] - 1] = -1
        prv[begin[:-1]] = -1
        rank = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self.pair_ranks(tok[inner], tok[inner + 1])
        dead = np.zeros(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r != NONE], r[r != NONE]
            if not len(at):
                return
            by = np.argsort(r, kind="stable")
            at, r = at[by], r[by]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for key, positions in zip(r[np.append(0, cuts)].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if key in index:
                    index[key].append(positions)
                else:
                    index[key] = [positions]
                    heapq.heappush(heap, key)

        add(inner)
        while heap:
            r = heapq.heappop(heap)
            got = index.pop(r)
            p = got[0] if len(got) == 1 else np.concatenate(got)
            p = p[rank[p] == r]
            if not len(p):
                continue
            if len(p) > 1:
                p = _distinct(p)
            every = p
            if len(p) > 1:
                joined = np.append(False, nxt[p[:-1]] == p[1:])
                if joined.any():  # in a run of overlapping pairs every second one merges, from the left
                    k = np.arange(len(p))
                    p = p[(k - np.maximum.accumulate(np.where(joined, 0, k))) % 2 == 0]
            q = nxt[p]
            after, before = nxt[q], prv[p]
            merged = np.full(len(p), r, np.int32)
            chained = np.append(False, before[1:] == q[:-1])
            low = np.zeros(len(p), bool)
            has = after >= 0
            low[has] = self.pair_ranks(merged[has], tok[after[has]]) < r
            has = before >= 0
            low[has] |= self.pair_ranks(np.where(chained, r, tok[before])[has], merged[has]) < r
            if low.any():
                slow = piece[p[low]]
                later = np.isin(piece[p], slow) & np.append(False, piece[p[1:]] == piece[p[:-1]])
                p, q, after = p[~later], q[~later], after[~later]
                back = every[np.isin(piece[every], slow) & ~np.isin(every, p)]
                if len(back):
                    index[r] = [back]
                    heapq.heappush(heap, r)
            tok[p] = r
            dead[q] = True
            rank[q] = NONE
            nxt[p] = after
            has = after >= 0
            prv[after[has]] = p[has]
            rank[p[~has]] = NONE
            inner = p[has]
            rank[inner] = self.pair_ranks(tok[inner], tok[nxt[inner]])
            left = prv[p]
            left = left[left >= 0]
            rank[left] = self.pair_ranks(tok[left], tok[nxt[left]])
            add(_distinct(np.concatenate([inner, left])))
        total = np.append(0, np.cumsum(~dead))
        return tok[~dead], total[begin]

    def _learn(self) -> None:
        """The tokens of all new pieces, behind those of the known ones."""
        raw = [p.encode() for p in self.numbers.new]
        whole = np.array([self.ranks.get(r, -1) for r in raw], np.int64)  # a piece that is a token is that token
        rest = np.flatnonzero(whole < 0)
        tokens, at = self.replay([raw[k] for k in rest]) if len(rest) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        lengths = np.ones(len(raw), np.int64)
        lengths[rest] = np.diff(at)
        ends = np.cumsum(lengths)
        found = np.empty(int(lengths.sum()), np.int32)
        found[(ends - lengths)[whole >= 0]] = whole[whole >= 0]
        found[np.repeat(whole < 0, lengths)] = tokens
        self.begin = np.concatenate([self.begin, self.begin[-1] + ends])
        self.tokens = np.concatenate([self.tokens, found])

    def _forget(self) -> None:
        """New pieces beyond the bounds go: those that came first are mostly the frequent ones."""
        new = self.numbers.new
        room = CACHE_PIECES - (len(self.numbers) - len(new))
        chars = self.chars + np.cumsum([len(p) for p in new[:room]], dtype=np.int64)
        kept = int(np.searchsorted(chars, CACHE_CHARS, side="right"))
        if kept < len(new):
            for p in new[kept:]:
                del self.numbers[p]
            self.begin = self.begin[: len(self.numbers) + 1].copy()
            self.tokens = self.tokens[: self.begin[-1]].copy()
        self.chars = int(chars[kept - 1]) if kept else self.chars
        new.clear()

    def _numbered(self, text: str) -> np.ndarray:
        """The numbers of a text's pieces; a long text's pieces are never in memory all together."""
        number = self.numbers.__getitem__
        if len(text) <= PART_BYTES:
            pieces = self.pattern.findall(text)
            return np.fromiter(map(number, pieces), np.int32, len(pieces))
        return np.fromiter((number(m[0]) for m in self.pattern.finditer(text)), np.int32)

    def encode_batch(self, texts):
        """The ids of each text of a group, in order."""
        rows = [self._numbered(t) for t in texts]
        if self.numbers.new:
            self._learn()
        for row in rows:
            start = self.begin[row]
            n = self.begin[row + 1] - start
            ends = np.cumsum(n)
            yield self.tokens[np.repeat(start - ends + n, n) + np.arange(ends[-1])] if len(row) else self.tokens[:0]
        self._forget()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def digest(self, ids) -> str:
        return hashlib.sha256(b",".join(map(self.number.__getitem__, ids))).hexdigest()


def _strings(t: pa.Array):
    """Texts of a batch, null as empty; few of them are Python strings at a time."""
    for part in parts(t, PART_BYTES):
        for x in part.to_pylist():
            yield x or ""


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary.load(path, pattern)
    return _LOADED[path, pattern]


def _groups(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
    """Batches that are replayed together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _each_batch(v: Vocabulary, batches: Iterator[pa.Array], result) -> Iterator[pa.Array]:
    """``result`` of each batch's lists of ids."""
    for group in _groups(batches):
        ids = v.encode_batch(chain.from_iterable(map(_strings, group)))
        for batch in group:
            yield result(islice(ids, len(batch)))
        next(ids, None)  # to its end
        release_memory()


def encode(text: Column, path: str, pattern: str) -> Column:
    """The token ids of a text."""

    def lists(ids) -> pa.Array:
        rows = list(ids)
        ends = np.cumsum([0, *map(len, rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _each_batch(vocabulary(path, pattern), batches, lists)

    return run.asNondeterministic()(text.cast("string"))


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of token ids; null ids give null."""

    @F.arrow_udf("binary")
    def run(t: pa.Array) -> pa.Array:
        v = vocabulary(path, pattern)
        return pa.array([None if not x.is_valid else v.decode(x.values.to_pylist()) for x in t], pa.binary())

    return run.asNondeterministic()(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """A struct of the number of ids, the digest of the ids, and the digest of the bytes that the ids decode to.

    The same two functions as ``encode`` and ``decode``, without sending the ids through the JVM in between.
    """

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path, pattern)

        def digests(rows) -> pa.Array:
            n, first, second = [], [], []
            for ids in map(np.ndarray.tolist, rows):
                n.append(len(ids))
                first.append(v.digest(ids))
                second.append(hashlib.sha256(v.decode(ids)).hexdigest())
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

        return _each_batch(v, batches, digests)

    return run.asNondeterministic()(text.cast("string"))
