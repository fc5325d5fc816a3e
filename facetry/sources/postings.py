"""A persisted inverted index: runs of blocks of postings, each run sorted by field and term, and the lengths of fields.

A block is one row for a field and term with the postings of a run's rows as arrays.  A run holds some millions of tokens
and is sorted in the task that analysed them, so a build reads the texts once and shuffles no postings; it grows with
the texts alone.  A query reads those row groups and pages of each run whose least and greatest terms enclose its terms,
never a text, and several tasks share a frequent term.  A term's frequency is the sum of its blocks'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions import analysis
from facetry.schema import SearchSchema

#: ``at`` says where a row's places begin (from 1) in ``positions``; ``df``, ``cf`` and ``heads`` are rows, tokens, and rows whose first token it is.
BLOCK = "field string, term string, df int, cf int, heads int, docs array<long>, tf array<int>, dl array<int>, at array<int>, positions array<int>"
#: Tokens, and bytes of them, that make a run; blocks that leave a task at a time.
RUN_TOKENS, RUN_BYTES, BLOCKS_AT_ONCE = 2_000_000, 64 << 20, 50_000
ROW_GROUP_BYTES = 8 << 20
#: Terms whose frequencies are kept on the driver.
KNOWN_TERMS = 100_000


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(batches) -> Iterator[pa.RecordBatch]:
    """Rows (_doc, field, tokens) in runs; a row is never cut."""
    held, tokens, size = [], 0, 0
    for whole in batches:
        ends, a = np.cumsum(_sizes(whole)), 0
        while a < whole.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + RUN_TOKENS - tokens, side="right")))
            part = whole.slice(a, b - a)
            held, tokens, size, a = [*held, part], tokens + int(ends[b - 1] - (ends[a - 1] if a else 0)), size + part.nbytes, b
            if tokens >= RUN_TOKENS or size >= RUN_BYTES or a < whole.num_rows:
                yield pa.concat_batches(held)
                held, tokens, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    """Rows (_doc, field, tokens) to sorted runs with one block for each term of a field; null tokens hold places and are no terms."""
    ints = lambda x: pa.array(x.astype(np.int32))
    for batch in _runs(batches):
        lengths, flat = _sizes(batch), batch.column(2).flatten()
        kept = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
        if not len(kept):
            continue
        words, fields = flat.take(pa.array(kept)).dictionary_encode(), batch.column(1).dictionary_encode()
        names, terms = fields.dictionary.sort(), words.dictionary.sort()  # by bytes, as files compare
        code = pc.index_in(words.dictionary, terms).to_numpy()[words.indices.to_numpy()]
        of_field = pc.index_in(fields.dictionary, names).to_numpy()[fields.indices.to_numpy()]
        row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), lengths)[kept]
        at = (kept - np.repeat(np.cumsum(lengths) - lengths, lengths)[kept]).astype(np.int32)
        key = of_field.astype(np.int64)[row] * len(terms) + code
        head = np.append(True, row[1:] != row[:-1])
        by = np.argsort(key, kind="stable")  # tokens come by row and place, which stays so
        key, row, at, head = key[by], row[by], at[by], head[by]
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new | np.append(True, row[1:] != row[:-1]))  # the first token of each posting
        block = np.flatnonzero(new[first])  # the first posting of each block
        begins, of, docs = first[block], row[first], batch.column(0).to_numpy(zero_copy_only=False)
        key, postings, tokens = key[begins], np.append(block, len(first)), np.append(begins, len(row))
        n = np.diff(postings)
        posting = lambda x, offsets=ints(postings): pa.ListArray.from_arrays(offsets, x)
        run = pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(key // len(terms))), terms.take(pa.array(key % len(terms))), ints(n), ints(np.diff(tokens)), ints(np.add.reduceat(head.astype(np.int64), begins)),
                posting(pa.array(docs[of])), posting(ints(np.diff(np.append(first, len(row))))), posting(ints(np.bincount(row, minlength=batch.num_rows)[of])),
                posting(ints(first - np.repeat(begins, n) + 1)), pa.ListArray.from_arrays(ints(tokens), pa.array(at)),
            ],
            names=["field", "term", "df", "cf", "heads", "docs", "tf", "dl", "at", "positions"],
        )
        for k in range(0, run.num_rows, BLOCKS_AT_ONCE):
            yield run.slice(k, BLOCKS_AT_ONCE)


def blocks(docs: DataFrame, schema: SearchSchema) -> DataFrame:
    """The postings of all searchable text fields, in runs."""
    each = F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"), analysis.field_tokens(f).alias("tokens")) for f in schema.searchable_text()])).alias("x")
    return docs.select(F.col("_doc").cast("long").alias("_doc"), each).select("_doc", "x.field", "x.tokens").mapInArrow(_blocks, BLOCK)


def write(docs: DataFrame, schema: SearchSchema, path: str, parts: int | None = None) -> None:
    """Builds the index of all searchable text fields below ``path``, in so many files or as the rows lie.

    Rows of fewer files than cores are dealt anew, since a file may be one task's, however large.
    """
    spark = docs.sparkSession
    docs = docs.select("_doc", *[f.name for f in schema.searchable_text()])
    if parts:
        docs = docs.repartition(parts, "_doc")
    elif len(docs.inputFiles()) < spark.sparkContext.defaultParallelism:
        docs = docs.repartition("_doc")
    blocks(docs, schema).write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/blocks")
    written = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    written.groupBy("field").agg(F.sum("heads").alias("n"), F.sum("cf").alias("total")).coalesce(1).write.mode("overwrite").parquet(f"{path}/fields")


@dataclass
class TextIndex:
    """Blocks of one or several builds; ``lengths`` has for each field its rows and their tokens.

    ``live`` says that every row of the index is a row of the collection.  Where it is false, rows that were replaced
    are left out of results, but count in the statistics until their segments are merged.
    """

    blocks: DataFrame
    lengths: dict[str, tuple[int, int]]
    live: bool = True
    known: dict[tuple[str, str], int] = field(default_factory=dict)  # frequencies that were looked up before

    @classmethod
    def open(cls, spark: SparkSession, paths: list[str], live: bool = True) -> TextIndex:
        read = lambda name, schema: spark.read.schema(schema).parquet(*[f"{p}/{name}" for p in paths])
        fields = read("fields", "field string, n long, total long").groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("t")).collect()
        return cls(read("blocks", BLOCK), {r["field"]: (r["n"], r["t"]) for r in fields}, live)

    def postings(self, test, places: bool = False) -> DataFrame:
        """One row for each field, term and row: its frequency, the field's length, and its places if asked for, where the test of field and term holds."""
        if places:
            each = F.transform(F.arrays_zip("docs", "tf", "dl", "at"), lambda x: F.struct(x["docs"], x["tf"], x["dl"], F.slice("positions", x["at"], x["tf"])))
            return self.blocks.filter(test).select("field", "term", F.inline(each).alias("_doc", "tf", "dl", "positions"))
        return self.blocks.filter(test).select("field", "term", F.inline(F.arrays_zip("docs", "tf", "dl")).alias("_doc", "tf", "dl"))

    @property
    def terms(self) -> DataFrame:
        """``field, term, df``, a row for each block."""
        return self.blocks.select("field", "term", "df")

    def frequencies(self, wanted: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """In how many rows the field has the term."""
        new = {x for x in wanted if x not in self.known}
        if new:
            if len(self.known) + len(new) > KNOWN_TERMS:
                self.known.clear()
                new = set(wanted)
            self.known.update(dict.fromkeys(new, 0))
            for r in self.terms.filter(among(new)).groupBy("field", "term").agg(F.sum("df").alias("df")).collect():
                self.known[r["field"], r["term"]] = r["df"]
        return {x: self.known[x] for x in wanted}

    def mean_length(self, name: str) -> float:
        n, total = self.lengths.get(name, (0, 0))
        return total / n if n else 1.0


def among(wanted: set[tuple[str, str]]):
    """A test of ``field`` and ``term`` that reaches the scan."""
    by_field: dict[str, list[str]] = {}
    for name, term in sorted(wanted):
        by_field.setdefault(name, []).append(term)
    test = F.lit(False)
    for k, (name, terms) in enumerate(by_field.items()):
        here = (F.col("field") == name) & F.col("term").isin(terms)
        test = test | here if k else here
    return test
