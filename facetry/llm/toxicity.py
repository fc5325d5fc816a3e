"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled texts train the classifier; labels 0 are used for the class prior alone.
With prior p, the risk of a classifier g is ``p R_P(+1) + max(0, R_U(-1) - p R_P(-1))``: the unlabelled term, less
what the hidden positives put into it, must not turn negative; where it does, the step goes the other way.

Features are hashed: the distinct words of the whole text, and the stems (the first 4, 5 and 6 bytes of longer words)
that two or three words of it have, so that inflected and compound forms of one word count together.  A bucket is kept
if its frequency in positives differs from that in unlabelled texts by ``least_z`` standard errors and ``least_texts``
positives have it (or ten unlabelled texts, where it speaks against toxicity); there is no limit to how many are kept.
The model is linear and trained with numpy on the driver, which sees the kept buckets of the sampled texts only.

The fit reads a bounded sample: at most about ``max_positive`` and ``max_unlabelled`` whole texts of about ``max_bytes``
together, picked by a hash of the id.  Scoring reads every row.

Defined results: null or empty text gets the score of a text without any known feature; without confirmed toxic
texts the score is 0 everywhere, and an empty table of texts gives an empty one; an id with several labels is toxic if
one of them is 1; labels without a text teach the prior only; repeated rows get equal scores; a text of any length is
scored whole.  Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm import kernels as K
from facetry.llm.spark_utils import written

BUCKETS = 1 << 20
#: Bytes of a word's beginning that are its stem, and how many words of a text must have it.
STEMS = (4, 5, 6)
STEM_WORDS = (2, 3)
#: Letters of words: ASCII letters and all bytes of other characters.
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def features(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each distinct feature of each row, sorted by row."""
    words = K.Words(block, fold=True, member=_LETTERS)
    row = words.row_of_word() * BUCKETS
    found = [np.unique(row + _bucket(words.hashes))]
    for size in STEMS:
        longer = words.ends - words.starts > size
        begins = words.starts[longer]
        stems, n = np.unique(row[longer] + _bucket(K.range_hashes(block.data, begins, begins + size, fold=True)), return_counts=True)
        for least in STEM_WORDS:
            kept = stems[n >= least]
            found.append(kept // BUCKETS * BUCKETS + _bucket(K.mix((kept % BUCKETS + least * BUCKETS).astype(np.uint64))))
    key = np.unique(np.concatenate(found))
    return key // BUCKETS, key % BUCKETS


@dataclass
class Classifier:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    trained: bool = True

    def scores(self, text: pa.Array) -> np.ndarray:
        out = np.zeros(len(text))
        if not self.trained:
            return out
        weight = np.zeros(BUCKETS)
        weight[self.buckets] = self.weights
        for block in K.blocks(text):
            row, bucket = features(block)
            z = np.bincount(row, weights=weight[bucket], minlength=block.n) + self.bias
            out[block.first : block.first + block.n] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return out


def choose(a: np.ndarray, b: np.ndarray, n: int, m: int, least_z: float, least_texts: int) -> np.ndarray:
    """Which buckets are kept, of those that ``a`` of n positive and ``b`` of m unlabelled texts have."""
    n, m = max(1, n), max(1, m)
    both = (a + b + 0.5) / (n + m + 1)
    z = (a / n - b / m) / np.sqrt(both * (1 - both) * (1 / n + 1 / m))
    return (np.abs(z) >= least_z) & ((a >= least_texts) | ((z < 0) & (b >= 10)))


def train(p_rows: list[np.ndarray], u_rows: list[np.ndarray], chosen: np.ndarray, prior: float, epochs: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Classifier:
    """From the buckets of positive and of unlabelled texts; ``chosen`` are those that count, in order."""
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))

    def sparse(rows):
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = place[np.concatenate(rows)] if rows else np.zeros(0, np.int64)
        return row[col >= 0], col[col >= 0], len(rows)

    p, u = sparse(p_rows), sparse(u_rows)
    w, b = np.zeros(len(chosen)), np.log(prior / (1 - prior))
    z_of = lambda s: np.bincount(s[0], weights=w[s[1]], minlength=s[2]) + b
    loss, slope = lambda x: np.logaddexp(0, -x), lambda x: -1 / (1 + np.exp(np.clip(x, -50, 50)))

    def gradient(s, d):
        d = d / max(1, s[2])
        return np.append(np.bincount(s[1], weights=d[s[0]], minlength=len(w)), d.sum())

    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, epochs + 1):
        zp, zu = z_of(p), z_of(u)
        negative = loss(-zu).mean() - prior * loss(-zp).mean()
        rest = gradient(u, -slope(-zu)) - prior * gradient(p, -slope(-zp))
        g = prior * gradient(p, slope(zp)) + rest if negative >= 0 else -rest
        g[:-1] += decay * w
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Classifier(chosen, w, float(b))


def _featurise(batches):
    for batch in batches:
        for block in K.blocks(batch.column(0)):
            row, bucket = features(block)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(block.n + 1)).astype(np.int32)), pa.array(bucket.astype(np.int32)))
            part = batch.slice(block.first, block.n)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), lists], names=["p", "u", "f"])


def _count(batches):
    """Positive and unlabelled texts of a partition by bucket."""
    a, b = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        of = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
        bucket = batch.column(2).flatten().to_numpy()
        for total, flag in ((a, batch.column(0)), (b, batch.column(1))):
            total += np.bincount(bucket[flag.to_numpy(zero_copy_only=False)[of]], minlength=BUCKETS)
    some = np.flatnonzero(a + b)
    for i in range(0, len(some), 100_000):
        at = some[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(a[at]), pa.array(b[at])], names=["f", "a", "b"])


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_positive: int = 8000,
    max_unlabelled: int = 24000, max_bytes: int = 256 << 20, least_z: float = 4.5, least_texts: int = 3,
) -> Classifier:
    """From whole texts of ``docs``: those that ``labels`` confirm as toxic, and others as unlabelled."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg((F.max(F.col(label).cast("int")) == 1).alias("__p"))
    n_known, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.col("__p").cast("int")), F.lit(0))).first()
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()
    untrained = Classifier(np.zeros(0, np.int64), np.zeros(0), 0.0, trained=False)
    if not n_toxic or not n_docs:
        return untrained
    draw = lambda c: F.pmod(F.xxhash64(F.lit("toxicity"), c), F.lit(1 << 40))
    below = lambda c, most, n: draw(c) < int(min(1.0, most / max(1, n), max_bytes * n_docs / max(1, n * n_bytes)) * (1 << 40))
    positive = known.filter("__p").filter(below(F.col("__id"), max_positive, n_toxic))  # at most about max_positive ids
    rows = docs.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("__t"), below(F.col(key), max_unlabelled, n_docs).alias("__u"))
    sample = rows.join(F.broadcast(positive), "__id", "left").filter(F.col("__u") | F.col("__p")).select("__t", F.coalesce("__p", F.lit(False)).alias("p"), F.coalesce("__u", F.lit(False)).alias("u"))
    held = written(sample.mapInArrow(_featurise, "p boolean, u boolean, f array<int>"))
    n, m = held.agg(F.coalesce(F.sum(F.col("p").cast("int")), F.lit(0)), F.coalesce(F.sum(F.col("u").cast("int")), F.lit(0))).first()
    if not n or not m:  # no text of either kind
        return untrained
    counts = held.mapInArrow(_count, "f int, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    possible = counts.filter((F.col("a") >= least_texts) | (F.col("b") >= 10)).toArrow()  # at most BUCKETS rows
    f, a, b = (possible.column(k).to_numpy() for k in range(3))
    chosen = np.sort(f[choose(a, b, n, m, least_z, least_texts)]).astype(np.int64)
    kept = np.zeros(BUCKETS, bool)
    kept[chosen] = True

    def slim(batches):
        for batch in batches:
            ends, bucket = batch.column(2).offsets.to_numpy(), batch.column(2).flatten().to_numpy()
            keep = kept[bucket]
            total = np.append(0, np.cumsum(keep))[ends - ends[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(bucket[keep]))], names=["p", "u", "f"])

    got = held.mapInArrow(slim, "p boolean, u boolean, f array<int>").toArrow().combine_chunks()
    flags = [c.to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0, bool) for c in (got.column(0), got.column(1))]
    rows_of = [np.asarray(x, dtype=np.int64) for x in got.column(2).to_pylist()]
    pick = lambda flag: [r for r, x in zip(rows_of, flag, strict=True) if x]
    return train(pick(flags[0]), pick(flags[1]), chosen, min(0.5, max(1e-3, n_toxic / n_known)))


def score(model: Classifier, text: Column) -> Column:
    @F.arrow_udf("double")
    def run(t: pa.Array) -> pa.Array:
        return pa.array(model.scores(t))

    return run.asNondeterministic()(text.cast("string"))
