"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), as exact components of near copies.

Two texts link when the Jaccard similarity of their sets of 5-word shingles is at least 0.75.

1. One pass takes each text's set: size and a 128-bit signature.  Texts with equal sets form a class; one row of
   each class (the smallest id) stands for it.
2. Inverted lists over all rows: shingles are dealt by their hash, packed in binary blocks.  Of two sets that link,
   the ``t`` least hashes in common are among the ``n - ceil(0.75 n) + t`` least of either, so with ``t = ceil(n / 8)``
   three eighths of the shingles are dealt.  Each list's task tells only how many of a set's some other set has
   too.  A set with too few of them (T-occurrence over all lists at once) is done; most texts are.  All shingles of
   the others are dealt once, and return with the lengths of their lists, which is the global order, rare first: two sets
   that link share a shingle among the rarest ``n - ceil(0.75 n) + 1`` of either.  The lists of those never become
   pairs: a list's members, cut where neighbouring sizes differ too much to link, are tied to its first one.  The
   components of these ties are blocks: every link lies inside one block.
3. Blocks are cut by a hash of the id into chunks of ``chunk_shingles``, and each chunk is searched in one task by
   T-occurrence queries over its inverted index: the lists of a query's shingles are divided, the short ones merged by
   a heap that skips rows which too few lists can still hold, and the long ones are bits of each row, probed for all
   candidates at once.  A breadth-first search asks only for rows that are not yet in a component, and lists lose the
   rows that are, so a group of near copies costs about its own size.
4. A block of several chunks needs the links between these.  One row of the largest component of each chunk is
   searched with the others' (as a block of its own, by the same steps): mostly this joins them to one large component
   of the block.  A link between different components has an end outside that one, so the rows outside it, and only
   they, are sent to the other chunks as queries, a chunk's weight of them to a task, and searched against that chunk's
   rows only.  Components of all links found are the result; no case is dropped.

Defined results: a text with fewer than five words has one shingle, its whole sequence; without words it has none
and links with nothing (its component is its own id).  Rows that share an id are one node.  Rows without an id are
nodes by their text, above all ids (which are below 2 ** 62): they take the smallest id of their component, or null
where no row of it has one.  An empty table gives an empty one; texts of any length are taken whole.  Other columns
are not looked at, and ``one_of_each`` keeps them whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm import kernels as K
from facetry.llm.connected import components, forest
from facetry.llm.spark_utils import BROADCAST_IDS, cut, sized_broadcast, skew_safe_left_join, whole_row, written

SIZE = 5
#: Nodes of rows without an id begin here.
NO_ID = 1 << 62
#: Similarity of at least PART / WHOLE.
PART, WHOLE = 75, 100
#: Shingles that one search takes: this many, more where a group would be cut in too many chunks, but never above the most.
CHUNK_SHINGLES, MOST_CHUNK_SHINGLES = 50_000, 500_000
#: Chunks that all blocks together have at least, however large a chunk is.
CHUNKS = 200
#: The first pass looks for one in so many of a set's shingles among its least ones.
LEAST_PART = 8
#: Packed postings that one task takes.
POSTINGS_BYTES = 16 << 20
PACK_SHINGLES = 500_000
POSTING = 9.5  # bytes of a packed posting, about
#: Lists are long that have as many rows, and this share of their index's rows: their bits take no more than the postings.
LONG, LONG_SHARE = 16, 1 / 64
#: Rows whose bits are packed at a time.
_PACKED_ROWS = 256


def least_size(n: int) -> int:
    return -(-PART * n // WHOLE)


def needed(n, m):
    """Least overlap of two sets of n and m shingles that link."""
    return -(-PART * (n + m) // (PART + WHOLE))


def least_common(n: int) -> int:
    """How many of the least shingles that a set of n shares with one it links with the first pass asks for."""
    return -(-n // LEAST_PART)


def least_dealt(n: int) -> int:
    """How many of the least shingles of a set of n hold ``least_common`` ones of any set that it links with."""
    return n - least_size(n) + least_common(n)


def signature(s: np.ndarray) -> tuple[int, int]:
    first = K.mix(s)
    return (
        int(first.sum(dtype=np.uint64).view(np.int64)),
        int((K.mix(first + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) ^ np.uint64(len(s))).view(np.int64)),
    )


def _set_pass(batches):
    """Id, set size and signature of each row."""
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        sig = np.zeros((2, batch.num_rows), np.int64)
        for block in K.blocks(batch.column(1)):
            for k, s in K.shingle_sets(block, SIZE):
                at = block.first + k
                n[at] = len(s)
                sig[0, at], sig[1, at] = signature(s)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(sig[0]), pa.array(sig[1])], names=["id", "n", "s1", "s2"])


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, np.int64)


def _blobs(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """The rows of the columns, packed by bucket."""
    by = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[by], [c[by] for c in columns]
    at = _runs(bucket)
    blobs = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _unpacked(batches, *kinds) -> list[np.ndarray] | None:
    """All rows of a partition's blobs."""
    size, parts = sum(np.dtype(t).itemsize for t in kinds), []
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            k, at, part = len(blob) // size, 0, []
            for t in kinds:
                part.append(np.frombuffer(blob, t, k, at))
                at += k * np.dtype(t).itemsize
            parts.append(part)
    return [np.concatenate([x[i] for x in parts]) for i in range(len(kinds))] if parts else None


def _postings(buckets: int, least: bool = False):
    """All shingles of a batch's different sets, or the least of each that are enough to tell which cannot link.  They are
    packed by their low 32 bits (the least differ in the high ones): the low 48 bits and the set's place in the
    pack's own table.  Two shingles that agree in those bits only make a candidate more."""

    def run(batches):
        parts, seen, held = [], set(), 0
        for batch in batches:
            for block in K.blocks(batch.column(0)):
                for _, s in K.shingle_sets(block, SIZE):
                    if len(s) and (mark := signature(s)[0]) not in seen:
                        seen.add(mark)
                        dealt = s[: least_dealt(len(s))].copy() if least else s  # a view would hold the whole set
                        parts.append((dealt, mark, len(s)))
                        held += len(dealt)
                if held >= PACK_SHINGLES:
                    yield from packs(parts)
                    parts, seen, held = [], set(), 0
        yield from packs(parts)

    def packs(parts):
        return (pack(parts[a : a + 60_000]) for a in range(0, len(parts), 60_000))

    def pack(parts):
        size = np.array([n for _, _, n in parts], np.int32)
        mark = np.array([m for _, m, _ in parts], np.int64)
        shingle = np.concatenate([s for s, _, _ in parts])
        row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(s) for s, _, _ in parts])
        bucket = ((shingle & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        shingle, row, bucket = shingle[by], row[by], bucket[by]
        at, blobs = _runs(bucket), []
        for i, j in zip(at[:-1], at[1:], strict=True):
            here = row[i:j]
            first = _runs(here)[:-1]
            place = np.zeros(j - i, np.uint16)
            place[first[1:]] = 1
            place = np.cumsum(place, dtype=np.uint16)
            low = np.ascontiguousarray(shingle[i:j]).view(np.uint8).reshape(-1, 8)[:, :6]
            table = here[first]
            blobs.append(np.array([len(table), j - i], np.uint32).tobytes() + mark[table].tobytes() + size[table].tobytes() + place.tobytes() + low.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def _lists(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """The inverted lists of two sets or more in a partition: shingle, set, set size and list length of each posting."""
    keys, marks, sizes = [], [], []
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            m, k = np.frombuffer(blob, np.uint32, 2).tolist()
            mark, size = np.frombuffer(blob, np.int64, m, 8), np.frombuffer(blob, np.int32, m, 8 + 8 * m)
            place = np.frombuffer(blob, np.uint16, k, 8 + 12 * m)
            key = np.zeros((k, 8), np.uint8)
            key[:, :6] = np.frombuffer(blob, np.uint8, 6 * k, 8 + 12 * m + 2 * k).reshape(k, 6)
            keys.append(key.view(np.uint64).reshape(-1))
            marks.append(mark[place])
            sizes.append(size[place])
    if not keys:
        return None
    key, mark, size = np.concatenate(keys), np.concatenate(marks), np.concatenate(sizes)
    del keys, marks, sizes
    by = np.argsort(key)
    ordered = key[by]
    twice = np.append(ordered[1:] == ordered[:-1], False)
    twice[1:] |= twice[:-1]
    by = by[twice]
    key, mark, size = key[by], mark[by], size[by]
    by = np.lexsort((mark, key))
    key, mark, size = key[by], mark[by], size[by]
    new = np.append(True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]))[: len(key)]  # copies of a set count once
    key, mark, size = key[new], mark[new], size[new]
    at = _runs(key)
    length = np.repeat(np.diff(at), np.diff(at))
    many = length > 1
    return (key[many], mark[many], size[many], length[many].astype(np.int32)) if many.any() else None


def _set_bucket(mark: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix(mark.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _counts(buckets: int):
    """How many shingles of each set are in lists of this partition, packed by set."""

    def run(batches):
        got = _lists(batches)
        if got is not None:
            mark, n = np.unique(got[1], return_counts=True)
            yield _blobs(_set_bucket(mark, buckets), mark, n.astype(np.int32))

    return run


def _sum_counts(batches):
    got = _unpacked(batches, np.int64, np.int32)
    if got is not None:
        by = np.argsort(got[0], kind="stable")
        at = _runs(got[0][by])[:-1]
        mark, total = got[0][by][at], np.add.reduceat(got[1][by].astype(np.int64), at)
        yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(total)], names=["s1", "shared"])


def _orders(buckets: int):
    """Each posting of a partition's lists with its list's length, packed by set."""

    def run(batches):
        got = _lists(batches)
        if got is not None:
            key, mark, size, length = got
            yield _blobs(_set_bucket(mark, buckets), mark, size, length, key)

    return run


def _prefixes(buckets: int):
    """For a partition's sets that can link at all: their rarest shared shingles, packed by shingle."""

    def run(batches):
        got = _unpacked(batches, np.int64, np.int32, np.int32, np.uint64)
        if got is None:
            return
        mark, size, length, key = got
        by = np.lexsort((key, length, mark))
        mark, size, key = mark[by], size[by].astype(np.int64), key[by]
        at = _runs(mark)
        count = np.diff(at)
        own = np.repeat(count, count)
        place = np.arange(len(mark)) - np.repeat(at[:-1], count)
        needs = -(-PART * size // WHOLE)
        keep = (own >= needs) & (place < own - needs + 1)
        if keep.any():
            key = key[keep]
            yield _blobs((K.mix(key) % np.uint64(buckets)).astype(np.int64), key, mark[keep], size[keep].astype(np.int32))

    return run


def _ties(batches):
    """Inverted lists of a partition's shingles, each tied to its first member: fewest ties with those components."""
    got = _unpacked(batches, np.uint64, np.int64, np.int32)
    if got is None:
        return
    shingle, mark, size = got
    by = np.lexsort((size, shingle))
    shingle, mark, size = shingle[by], mark[by], size[by].astype(np.int64)
    new = np.append(True, (shingle[1:] != shingle[:-1]) | (WHOLE * size[:-1] < PART * size[1:]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    tie = mark[first] != mark
    a, b = forest(mark[first][tie], mark[tie])
    for i in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])


def merge_skip(members: memoryview, begin: list[int], end: list[int], least: int) -> tuple[list[int], list[int]]:
    """Rows in at least ``least`` of the sorted lists ``members[begin:end]``, and in how many.

    A heap holds each list's first open row.  A row on too few lists goes together with all rows before the
    ``least``-th list's: those lists jump there by binary search.
    """
    n = len(begin)
    at, rows, counts = list(begin), [], []
    heap = [members[b] * n + k for k, b in enumerate(begin)]
    heapify(heap)
    while len(heap) >= least:
        row = heap[0] // n
        beyond, popped = (row + 1) * n, []
        while heap and heap[0] < beyond:
            popped.append(heappop(heap) % n)
        if len(popped) >= least:
            rows.append(row)
            counts.append(len(popped))
            for k in popped:
                at[k] += 1
                if at[k] < end[k]:
                    heappush(heap, members[at[k]] * n + k)
            continue
        while heap and len(popped) < least - 1:
            popped.append(heappop(heap) % n)
        if not heap:
            break
        target = heap[0] // n
        for k in popped:
            at[k] = bisect_left(members, target, at[k], end[k])
            if at[k] < end[k]:
                heappush(heap, members[at[k]] * n + k)
    return rows, counts


class Index:
    """Inverted lists of some rows' sets, without shingles that only one row has."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), self.sizes)
        values, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = df[token] > 1
        row, token = row[shared], token[shared]
        self.rows_of = np.searchsorted(row, np.arange(len(sets) + 1))
        self.tokens = token
        self._lists(row, token, len(values))

    def _lists(self, row: np.ndarray, token: np.ndarray, n: int) -> None:
        by = np.argsort(token, kind="stable")
        self.members = row[by]
        self._open = memoryview(np.ascontiguousarray(self.members, np.int64))
        self.begin = np.searchsorted(token[by], np.arange(n + 1))
        self._row, self._token, self._n = row, token, n
        self._long_lists()

    def _long_lists(self) -> None:
        """The long lists as bits, one column for each row that is in any list."""
        begin = _runs(self._row)
        self.held = self._row[begin[:-1]]
        length = np.diff(self.begin)
        long = np.flatnonzero(length >= max(LONG, int(len(self.held) * LONG_SHARE)))
        self.place = np.full(self._n, -1)
        self.place[long] = np.arange(len(long))
        self.words = -(-len(long) // 64)
        self.bits = np.zeros((self.words, len(self.held)), np.uint64)
        for a in range(0, len(self.held) if len(long) else 0, _PACKED_ROWS):
            b = min(a + _PACKED_ROWS, len(self.held))
            spot = self.place[self._token[begin[a] : begin[b]]]
            at = np.repeat(np.arange(b - a), np.diff(begin[a : b + 1]))[spot >= 0]
            self.bits[:, a:b] = self._packed(at, spot[spot >= 0], b - a).T

    def _packed(self, row: np.ndarray, spot: np.ndarray, n: int) -> np.ndarray:
        member = np.zeros((n, 64 * self.words), bool)
        member[row, spot] = True
        return np.packbits(member, axis=1).view(np.uint64)

    def forget(self, alive: np.ndarray) -> None:
        """Lists keep the rows that are alive only."""
        keep = alive[self._row]
        self._lists(self._row[keep], self._token[keep], self._n)

    def search(self, x: int, alive: np.ndarray) -> np.ndarray:
        """Rows alive whose overlap with row x is large enough to link (DivideSkip)."""
        n = int(self.sizes[x])
        least = int(needed(n, max(1, least_size(n))))
        tokens = self.tokens[self.rows_of[x] : self.rows_of[x + 1]]
        length = self.begin[tokens + 1] - self.begin[tokens]
        tokens = tokens[length > 0]
        if len(tokens) < least:
            return np.zeros(0, np.int64)
        spot = self.place[tokens]
        long, short = spot[spot >= 0], tokens[spot < 0]
        begin, end = self.begin[short].tolist(), self.begin[short + 1].tolist()
        if len(long) < least:
            rows, counts = merge_skip(self._open, begin, end, least - len(long))
            found, total = np.array(rows, np.int64), np.array(counts, np.int64)
            column = np.searchsorted(self.held, found)
        else:  # the long lists alone can hold enough: no row can be skipped
            found, column = self.held, slice(None)
            rows = np.concatenate([self.members[b:e] for b, e in zip(begin, end, strict=True)]) if begin else np.zeros(0, np.int64)
            total = np.bincount(np.searchsorted(found, rows), minlength=len(found))
        if len(long) and len(found):
            asked = self._packed(np.zeros(len(long), np.int64), long, 1)[0]
            some = np.flatnonzero(asked)
            common = self.bits[some] if isinstance(column, slice) else self.bits[np.ix_(some, column)]
            total = total + np.bitwise_count(common & asked[some, None]).sum(axis=0, dtype=np.int64)
        size = self.sizes[found]
        fits = alive[found] & (total >= needed(n, size)) & (WHOLE * size >= PART * n) & (WHOLE * n >= PART * size)
        return found[fits]


def link_components(sets: list[np.ndarray], seeds: int | None = None) -> np.ndarray:
    """For each set the first row of its component of links.  With ``seeds`` only links between the first ``seeds`` rows
    and the others count."""
    index, m = Index(sets), len(sets)
    alive, label, left, held = np.ones(m, bool), np.arange(m), m, m
    asks = np.arange(m) < (m if seeds is None else seeds)
    for seed in range(int(asks.sum())):
        if not alive[seed]:
            continue
        alive[seed] = False
        left -= 1
        frontier = [seed]
        while frontier and left:
            if left * 2 < held and m > 16:
                index.forget(alive)
                held = left
            x = frontier.pop()
            found = index.search(x, alive if seeds is None else alive & (asks != asks[x]))
            alive[found], label[found] = False, seed
            left -= len(found)
            frontier.extend(found.tolist())
    return label


def _search_blocks(batches):
    """Rows (block, id, query, text) sorted by block: ids and a row of their component, where there is a link.

    Where some rows are no queries, only links between queries and these are looked for.
    """
    current, ids, queries, sets = None, [], [], []

    def flush():
        if len(ids) > 1:
            keys, asks = np.array(ids, np.int64), np.array(queries, bool)
            by = np.lexsort((keys, ~asks))  # queries first, then by id
            label = link_components([sets[i] for i in by], None if asks.all() else int(asks.sum()))
            keys = keys[by]
            linked = keys[label] != keys
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[label][linked]), pa.array(keys[linked])], names=["a", "b"])

    for batch in batches:
        block_of, id_of, query_of = (batch.column(k).to_pylist() for k in range(3))
        for block in K.blocks(batch.column(3)):
            for k, s in K.shingle_sets(block, SIZE):
                at = block.first + k
                if block_of[at] != current:
                    yield from flush()
                    current, ids, queries, sets = block_of[at], [], [], []
                ids.append(id_of[at])
                queries.append(query_of[at])
                sets.append(s)
    yield from flush()


def chunk_shingles(load: int) -> int:
    """Shingles of a chunk where all blocks have ``load``: a group's chunks, and so the rows that go to several of them,
    stay in proportion to the input up to ``MOST_CHUNK_SHINGLES``."""
    return min(MOST_CHUNK_SHINGLES, max(CHUNK_SHINGLES, load // CHUNKS))


def _search(texts: DataFrame, dealt: DataFrame) -> DataFrame:
    """Links ``a, b`` inside blocks; ``dealt`` has ``block, id, query, n`` for each row of a block, ``texts`` ``id, t``."""
    rows, load = dealt.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(8, load // (4 * CHUNK_SHINGLES))
    joined = texts.join(sized_broadcast(dealt.select("id", "block", "query"), rows), "id").select("block", "id", "query", "t")
    return cut(joined.repartition(tasks, "block").sortWithinPartitions("block", "id").mapInArrow(K.trimmed(_search_blocks), "a long, b long"))


def _links(texts: DataFrame, members: DataFrame, chunk: int) -> tuple[DataFrame, bool]:
    """Links that join every component of the blocks ``root``, and whether there were blocks of several chunks.

    ``members`` has ``id, n, root``.
    """
    weights = members.groupBy("root").agg(F.sum("n").alias("w"), F.count("*").alias("m")).filter("m > 1")
    chunks = F.greatest(F.lit(1), F.least(F.ceil(F.col("w") / chunk), F.floor(F.col("m") / 2)))  # so that there are fewer heads than rows
    dealt = members.join(weights, "root").select("id", "n", "root", chunks.alias("chunks"))
    dealt = cut(dealt.withColumn("c", F.pmod(F.xxhash64("id"), "chunks")))
    links = _search(texts, dealt.select(F.xxhash64("root", "c").alias("block"), "id", F.lit(True).alias("query"), "n"))
    large = dealt.filter("chunks > 1")
    if not large.limit(1).count():
        return links, False
    labels = links.select(F.col("b").alias("id"), F.col("a").alias("label"))
    large = cut(large.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
    groups = large.groupBy("root", "c", "label").agg(F.count("*").alias("k"))
    tops = cut(groups.groupBy("root", "c").agg(F.max_by(F.struct("label", "k"), F.struct("k", -F.col("label"))).alias("t")).select("root", "c", F.col("t.label").alias("label"), F.col("t.k").alias("k")))
    heads = large.join(tops.select("root", "c", "label"), ["root", "c", "label"]).filter("id = label").select("id", "n", "root")
    above, _ = _links(texts, heads, chunk)
    joined = components(above).select(F.col("node").alias("label"), F.col("root").alias("whole"))
    tops = tops.join(joined, "label", "left").withColumn("whole", F.coalesce("whole", "label"))
    largest = tops.groupBy("root", "whole").agg(F.sum("k").alias("k")).groupBy("root").agg(F.max_by("whole", F.struct("k", -F.col("whole"))).alias("whole"))
    inside = cut(tops.join(largest, ["root", "whole"]).select("root", "c", "label"))
    outside = large.join(inside, ["root", "c", "label"], "left_anti")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("c")))
    asked = outside.select("id", "n", "root", others.alias("c")).join(tops.select("root", "c"), ["root", "c"])  # no chunk is asked that has no rows
    parts = asked.groupBy("root", "c").agg(F.ceil(F.sum("n") / chunk).alias("parts"))
    asked = asked.join(parts, ["root", "c"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "parts")).select("id", "n", "root", "c", "part", F.lit(True).alias("query"))
    asked = cut(asked)
    there = large.join(asked.select("root", "c", "part").distinct(), ["root", "c"]).select("id", "n", "root", "c", "part", F.lit(False).alias("query"))
    tiles = cut(there.unionByName(asked).select(F.xxhash64("root", "c", "part").alias("block"), "id", "query", "n"))
    return links.unionByName(above).unionByName(_search(texts, tiles)), True


def _node(key: str, text: str) -> Column:
    """A row's node: its id, or a number of its text."""
    of_text = F.shiftrightunsigned(F.xxhash64(F.col(text).cast("string")), 2) + F.lit(NO_ID)
    return F.coalesce(F.col(key).cast("long"), of_text)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row; ids are integers."""
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return _components(docs, key, text, chunk).select(known("id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def _components(docs: DataFrame, key: str, text: str, chunk: int | None = None) -> DataFrame:
    """``id, n, component`` for each row, in nodes."""
    rows = docs.select(_node(key, text).alias("id"), F.col(text).cast("string").alias("t"))
    sets = written(rows.mapInArrow(K.trimmed(_set_pass), "id long, n long, s1 long, s2 long"))
    total, shingles = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = cut(sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")))

    packed = "bucket int, blob binary"
    parts = max(8, int(least_dealt(shingles) * POSTING / POSTINGS_BYTES) + 1)
    few = max(8, parts // 4)
    lists = rows.select("t").mapInArrow(K.trimmed(_postings(parts, least=True)), packed).repartitionById(parts, "bucket")
    shared = lists.mapInArrow(K.trimmed(_counts(few)), packed).repartitionById(few, "bucket").mapInArrow(K.trimmed(_sum_counts), "s1 long, shared long")
    able = classes.join(shared.groupBy("s1").agg(F.sum("shared").alias("shared")), "s1")
    enough = F.ceil(F.ceil(PART * F.col("n") / WHOLE) / LEAST_PART)  # least_common of the smallest set that can link
    able = cut(able.filter(F.col("shared") >= enough).select(F.col("rep").alias("id"), "s1", "n"))

    n_able, shingles = able.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(8, int(shingles * POSTING / POSTINGS_BYTES) + 1)
    texts = rows.join(sized_broadcast(able.select("id"), n_able, BROADCAST_IDS), "id").select("t")
    lists = texts.mapInArrow(K.trimmed(_postings(parts)), packed).repartitionById(parts, "bucket")
    orders = lists.mapInArrow(K.trimmed(_orders(parts)), packed).repartitionById(parts, "bucket")
    ties = orders.mapInArrow(K.trimmed(_prefixes(parts)), packed).repartitionById(parts, "bucket").mapInArrow(K.trimmed(_ties), "a long, b long")
    blocks = components(ties).withColumnRenamed("node", "s1")
    members = cut(able.join(blocks, "s1").select("id", "n", "root"))
    n_members, load = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    texts = written(rows.join(sized_broadcast(members.select("id"), n_members, BROADCAST_IDS), "id").select("id", "t"))
    links, tiled = _links(texts, members, chunk or chunk_shingles(load))
    if tiled:
        found = components(links)
        least = found.groupBy("root").agg(F.min("node").alias("component"))
        roots = found.join(least, "root").select(F.col("node").alias("rep"), "component")
    else:
        roots = links.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("component"))
    known = classes.join(roots, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = known.filter((F.col("copies") > 1) | (F.col("component") != F.col("rep"))).select("s1", "s2", "copies", "component")
    joined = skew_safe_left_join(sets, known, ["s1", "s2"], "copies", total)
    return joined.select("id", "n", F.coalesce("component", "id").alias("component"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the smallest node of each component, with their columns; rows without words all stay."""
    found = written(_components(docs, key, text).select("id", (F.col("component") == F.col("id")).alias("stays")))
    gone = found.filter(~F.col("stays")).select("id").distinct()
    gone = cut(gone.join(found.filter("stays").select("id"), "id", "left_anti"))  # an id that any of its rows keeps stays
    rows = docs.select(whole_row(docs), _node(key, text).alias("id"))
    return rows.join(sized_broadcast(gone, gone.count(), BROADCAST_IDS), "id", "left_anti").select("row.*")
