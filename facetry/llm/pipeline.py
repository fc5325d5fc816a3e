"""From raw documents to token ids: quality rules, language, near copies, source weights, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept.  ``run`` writes each
stage's rows as Parquet into the shared folder and reads them again, so a lost executor never costs more than one
stage.  All stages but the last return the columns of their input, whatever these are called: a stage holds a row as
one struct beside its own columns.

Defined results of the stages:

- quality rules: a null or empty text has too few words and goes; equal texts stay or go together.
- language: a null text or one without a letter goes, and one of which the best language knows too few n-grams.
- near copies: of each group the rows with the smallest id stay (rows that share it all do); rows without words stay.
- mixing: a text without words is never taken; a null source is a source of its own; reruns agree.
- byte-level BPE: one row of token count and digests for each row, null text as empty text.

Every stage gives an empty table for an empty one, and takes texts of any length whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import bpe, jaccard, langid, mixing, quality
from facetry.llm.spark_utils import remove, small_batches, whole_row, written_at

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a rule of policy ``v2`` rejects go."""
    return quality.apply_policy(small_batches(docs), "v2")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of no learned language go: no letters, or too few n-grams that the best language knows."""
    filters = langid.fit(small_batches(docs).filter(~held_out()).select("doc_id", "text", "lang"))
    held = docs.select(whole_row(docs), langid.identify(filters, F.col("text")).alias("p"))
    known = (F.col("p.lang_pred") != langid.UNKNOWN) & (F.col("p.known") >= langid.KNOWN_SHARE)
    return held.filter(known).select("row.*")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays."""
    return jaccard.one_of_each(small_batches(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out so that sources reach their target weights."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    path = str(public_tokenizers.path(TOKENIZER))
    coded = small_batches(docs).select("doc_id", bpe.round_trip(F.col("text"), path, public_tokenizers.PATTERN).alias("c"))
    return coded.select("doc_id", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256")


STAGES = [
    ("quality rules", quality_stage), ("language", language_stage), ("near copies", near_copy_stage), ("mixing", mixing_stage),
    ("byte-level BPE", token_stage),
]

#: SQL has no tokenizer, no learned language filter and no seeded mix: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = written_at(stage(spark, docs, sf_dir))
        if before is not None:  # nothing reads it any more
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
