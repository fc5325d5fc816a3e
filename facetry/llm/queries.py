"""One query for each operator over the standard tables, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import bpe, html_extract, jaccard, langid, mixing, quality, telephony, toxicity, urlfilter, warc
from facetry.llm import pipeline as corpus
from facetry.llm.pipeline import TOKENIZER, held_out
from facetry.llm.spark_utils import small_batches, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    filters = langid.fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    found = docs.select("doc_id", held_out().alias("held_out"), langid.identify(filters, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    docs = _table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", bpe.round_trip(F.col("text"), str(path), public_tokenizers.PATTERN).alias("c"))
    return coded.select("doc_id", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kept = written(docs.select("doc_id", telephony.stored(F.col("text")).alias("s")).select("doc_id", "s.n_bytes", "s.media"))
    return kept.select("doc_id", "n_bytes", telephony.digest(F.col("media"), with_pcm=True).alias("d")).select("doc_id", "n_bytes", "d.*")


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_all(written(warc.bundles(_table(spark, sf_dir, "pages"))))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), urlfilter.rule_table(spark))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = quality.with_ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    measures = [f"ledger.{m}" for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = F.col("ledger.failed")
    return held.select("doc_id", *measures, (~quality.passes(failed, "base")).alias("base_failed"), quality.passes(failed, "v1").alias("kept"), failed.alias("failed_bits"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy ``v1`` rejects, alone and beside the others, from the ledger's bits."""
    return quality.ablation(quality.with_ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")), "v1")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.filter(~held_out()), labels.filter(~held_out()).select("doc_id", "toxic"))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_language_id": op1_language_id, "op2_byte_bpe": op2_byte_bpe, "op3_mixing": op3_mixing, "op4_html_extraction": op4_html_extraction,
    "op5_telephony_audio": op5_telephony_audio, "op6_warc_bundles": op6_warc_bundles, "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_url_filters": op8_url_filters, "op9_quality_rules": op9_quality_rules, "op10_toxicity": op10_toxicity,
    "quality_ablation": quality_ablation, "pipeline": corpus.run,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op6_warc_bundles": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
        bits AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + list_sum(list_transform(range(5), lambda j:
              ((instr('0123456789abcdef', substr(hex, 1 + ((5 * i + j) // 4)::INT, 1)) - 1) >> (3 - (5 * i + j) % 4)::INT & 1) << (4 - j)::INT))::INT, 1)), '') AS payload_digest,
          CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN first <> page_id THEN first END AS refers_to
        FROM bits""",
    "op8_url_filters": r"""
        WITH u AS (SELECT page_id,
            translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
            ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
            FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)""",
    "op9_quality_rules": rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
        win AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS g FROM w, unnest(range(1, len(words) - 3)) AS t(i)),
        rep AS (SELECT doc_id, unnest(list_concat(range(i, i + 5))) AS spot FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
        reps AS (SELECT doc_id, count(DISTINCT spot) AS n FROM rep GROUP BY doc_id),
        lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM w),
        m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
            len(ls) AS n_lines, coalesce(reps.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
            length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
            FROM w JOIN lines USING (doc_id) LEFT JOIN reps USING (doc_id)),
        f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
            + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars > 15 * n_words)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT
            + 64 * (2 * n_upper > n_letters)::BIGINT AS failed_bits FROM m)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
            n_repeat_words::BIGINT AS n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f""",
}
_V1 = {r.name: 1 << r.bit for r in quality.RULES}
ORACLE_SQL["quality_ablation"] = f"""
        WITH q AS ({ORACLE_SQL["op9_quality_rules"]}), r(rule, bit) AS (VALUES {", ".join(f"('{n}', {b})" for n, b in _V1.items())})
        SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_only,
            count(*) FILTER (failed_bits & {sum(_V1.values())} & ~bit = 0) AS n_kept_without FROM q, r GROUP BY rule"""
