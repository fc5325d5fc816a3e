"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: position ``p`` of the table holds a bitmask with bit ``l`` set
if position ``p`` of language ``l``'s filter is set.  And-ing the masks at an n-gram's positions gives all
languages that contain the n-gram, in one look for all of them.  A text's score for a language is the number of
its n-grams with that bit, corrected for the false positives which that filter's fill makes certain:
``(hits - n * p) / (1 - p)`` with ``p = fill ** hashes``.  The largest corrected count decides.

An n-gram enters the filter of every language in which its rate is at least ``SHARE`` times that in the language that
uses it most, if it is among the ``capacity`` most frequent ones of some language.  So a language with few texts
keeps n-grams of its own beside one with many.  The fit reads at most about ``max_docs`` labelled texts of each
language, picked by a hash of the id, and gathers n-gram counts only.

Masks are 64 languages wide; more languages take more mask words for each position.

Defined results: null text or text without a letter gives ``und`` with score 0; without any labelled text every text
gives ``und``, and an empty table gives an empty one; of languages with equal counts the first by name wins; a text of
any length is judged whole; repeated rows get equal results; more than ``MAX_LANGUAGES`` labels are an error.  Only
the columns named are looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm import kernels as K
from facetry.llm.spark_utils import cut, is_small

GRAM = 4
SHARE = 0.3
CAPACITY = 60_000
HASHES = 3
BITS = 1 << 20
UNKNOWN = "und"
MAX_LANGUAGES = 1024
#: A text is in a learned language if the language knows at least this share of its n-grams.  Measured with the filters of
#: sf0.1: its documents have 0.536 to 1, ordinary sentences of the four languages 0.38 to 0.46, sentences of eight other
#: languages in Latin letters 0.11 to 0.31.
KNOWN_SHARE = 0.34
#: ASCII letters in lower case; other ASCII becomes a space; bytes of other characters stay.
_NORMAL = np.full(256, 32, dtype=np.uint8)
_NORMAL[128:] = np.arange(128, 256)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)


def _padded(text: pa.Array) -> pa.Array:
    text = pc.fill_null(text, "")
    return pc.binary_join_element_wise(pa.scalar(" "), text, pa.scalar(" "), pa.scalar(""))


def _grams(block: K.Block) -> np.ndarray:
    """The byte n-gram that starts at each byte, as a 32-bit number (they may cross rows; counts leave those out)."""
    d = _NORMAL[block.data].astype(np.uint32)
    n = max(0, len(d) - GRAM + 1)
    g = d[:n].copy()
    for k in range(1, GRAM):
        g |= d[k : n + k] << np.uint32(8 * k)
    return g


#: The n-gram of white space.
_BLANK = int.from_bytes(b" " * GRAM, "little")


def _bounds(block: K.Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's n-grams begin and end among the block's ``n``, without those that cross rows."""
    return np.minimum(block.off[:-1], n), np.minimum(np.maximum(block.off[:-1], block.off[1:] - GRAM + 1), n)


def _in_rows(block: K.Block, marks: np.ndarray) -> np.ndarray:
    """Marked n-grams by row."""
    begin, end = _bounds(block, len(marks))
    total = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=total[1:])
    return total[end] - total[begin]


def _positions(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    h = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = (h >> np.uint64(40)) | np.uint64(1)
    low = np.uint64(bits - 1)
    return [((h + step * np.uint64(k)) & low).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilters:
    languages: list[str]
    table: np.ndarray
    false_positive: np.ndarray

    @classmethod
    def build(cls, languages: list[str], grams: np.ndarray, masks: np.ndarray, bits: int = BITS) -> LanguageFilters:
        """``masks`` has one word of 64 languages for each n-gram, or several in columns."""
        masks = masks.reshape(len(grams), masks.shape[1] if masks.ndim > 1 else 1).astype(np.uint64)
        kind = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
        table = np.zeros((max(1, masks.shape[1]), bits), dtype=kind)
        for at in _positions(grams, bits):
            for word in range(masks.shape[1]):
                np.bitwise_or.at(table[word], at, masks[:, word].astype(kind))
        fill = np.array([((table[k // 64] >> kind(k % 64)) & kind(1)).mean() for k in range(len(languages))])
        return cls(languages, table, fill**HASHES)

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Which languages contain each n-gram: rows of mask words."""
        at = _positions(grams, self.table.shape[1])
        return np.stack([np.bitwise_and.reduce([word[p] for p in at]) for word in self.table])

    def counts(self, block: K.Block) -> tuple[np.ndarray, np.ndarray]:
        """Corrected n-gram counts by row and language, and n-grams by row, for padded texts."""
        g = _grams(block)
        hit = self.lookup(g)
        begin, end = _bounds(block, len(g))
        n = (end - begin).astype(np.float64)
        out = np.zeros((block.n, len(self.languages)))
        total = np.zeros(len(g) + 1, dtype=np.int32)
        for k, p in enumerate(self.false_positive):
            word = hit[k // 64]
            np.cumsum((word >> word.dtype.type(k % 64)) & word.dtype.type(1), out=total[1:], dtype=np.int32)
            out[:, k] = np.maximum(0, ((total[end] - total[begin]) - n * p) / max(1e-9, 1 - p))
        return out, n

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        return self.judge(text)[:2]

    def judge(self, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and the share of the text's n-grams (those of white space only aside) that the language knows."""
        names: list[str] = []
        scores, known_share = np.zeros(len(text)), np.zeros(len(text))
        if not self.languages:
            return [UNKNOWN] * len(text), scores, known_share
        for block in K.blocks(_padded(text)):
            counts, _ = self.counts(block)
            grams = _in_rows(block, _grams(block) != _BLANK)
            plain = K.per_row(block, (_NORMAL[block.data] != 32) & (block.data < 128)) > 0
            best, total = counts.argmax(axis=1), counts.sum(axis=1)
            for k in range(block.n):
                known = plain[k] or any(map(str.isalpha, bytes(block.data[block.off[k] : block.off[k + 1]]).decode("utf-8", "replace")))
                names.append(self.languages[best[k]] if known else UNKNOWN)
                if known and total[k] > 0:
                    scores[block.first + k] = counts[k, best[k]] / total[k]
                    known_share[block.first + k] = counts[k, best[k]] / max(1, grams[k])
        return names, scores, known_share


def _count(batches):
    """Rows (text, language) to counts of n-grams by language, block by block."""
    for batch in batches:
        which = batch.column(1).to_numpy(zero_copy_only=False)
        for k in np.unique(which):
            for block in K.blocks(_padded(batch.column(0).filter(pa.array(which == k)))):
                g = _grams(block)
                inside = np.ones(len(g), dtype=bool)
                for back in range(1, GRAM):
                    across = block.off[1:-1] - back
                    inside[across[(across >= 0) & (across < len(g))]] = False
                value, n = np.unique(g[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(np.full(len(value), k, np.int32)), pa.array(n.astype(np.int64))], names=["g", "l", "n"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = 4000, capacity: int = CAPACITY) -> LanguageFilters:
    """Filters from the labelled rows given: at most about ``max_docs`` whole texts of each language."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang).alias("l")).count().orderBy("l").limit(MAX_LANGUAGES + 1).collect()}
    languages = sorted(sizes)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return LanguageFilters.build([], np.zeros(0, np.uint32), np.zeros((0, 1), np.uint64))
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, max_docs / sizes[name]))])
    number = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)])
    pick = F.pmod(F.xxhash64(F.lit("langid"), F.col(key)), F.lit(1 << 30)) < share[F.col(lang)] * (1 << 30)
    sample = rows.filter(pick).select(F.col(text).cast("string").alias("t"), number[F.col(lang)].alias("l"))

    # Counts of a bounded sample: at most 256 ** GRAM n-grams of each language, whatever the corpus.
    found = cut(sample.mapInArrow(_count, "g long, l int, n long").groupBy("g", "l").agg(F.sum("n").alias("n")))
    total = found.groupBy("l").agg(F.sum("n").alias("total"))
    # Which counts a language's most frequent n-grams have; of those that just miss, as many as there is room for, by hash.
    levels = found.groupBy("l", "n").agg(F.count("*").alias("k"))  # few: a language's different counts
    upto = F.sum("k").over(Window.partitionBy("l").orderBy(F.col("n").desc()))
    room = F.greatest(F.lit(0), F.least(F.col("k"), capacity - (F.col("upto") - F.col("k")))) / F.col("k")
    levels = cut(levels.withColumn("upto", upto).select("l", "n", room.alias("share")))
    placed = found.join(F.broadcast(levels) if is_small(levels) else levels, ["l", "n"])
    wanted = placed.filter(F.pmod(F.xxhash64("g"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("g").distinct()
    rates = found.join(wanted, "g", "left_semi").join(F.broadcast(total), "l").withColumn("rate", F.col("n") / F.col("total"))
    member = rates.withColumn("most", F.max("rate").over(Window.partitionBy("g"))).filter(F.col("rate") >= SHARE * F.col("most"))
    words = -(-len(languages) // 64)
    bit = F.expr("shiftleft(1L, l % 64)")
    masks = [F.coalesce(F.bit_or(F.when(F.floor(F.col("l") / 64) == w, bit)), F.lit(0).cast("long")).alias(f"m{w}") for w in range(words)]
    table = member.groupBy("g").agg(*masks).toArrow()  # at most ``capacity`` rows for each language
    grams = table.column(0).to_numpy().astype(np.uint32)
    return LanguageFilters.build(languages, grams, np.stack([table.column(w + 1).to_numpy().view(np.uint64) for w in range(words)], axis=1))


def identify(filters: LanguageFilters, text: Column) -> Column:
    """A struct ``lang_pred, score, known`` for one text; ``known`` is the share of its n-grams that the language knows."""

    @F.arrow_udf("struct<lang_pred:string,score:double,known:double>")
    def predict(t: pa.Array) -> pa.Array:
        names, scores, known = filters.judge(t)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(known)], names=["lang_pred", "score", "known"])

    return predict.asNondeterministic()(text.cast("string"))
