"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text.  The ledger holds the measurements and one failure bit per rule.
Policies are versioned sets of rules, that is masks: applying one is ``failed & mask == 0``, and the ablation
report (what each rule rejects alone, and what no other rule of the policy would reject) is bit arithmetic over
the ledger, without a second look at any text.

Defined results: null text counts as empty (no words, so ``too_few_words`` fails); repeated rows get equal
ledgers; an empty table gives an empty ledger; a text of any length is measured whole, at about ten times its bytes of
memory; ``with_ledger`` replaces a column of the input named like the ledger column, ``apply_policy`` keeps all.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm import kernels as K
from facetry.llm.spark_utils import whole_row

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails(measures)`` is true; ``measures`` is a dict of int64 arrays or Columns."""

    bit: int
    name: str
    fails: object


#: The bit of a rule never changes; new rules take new bits.
RULES = (
    Rule(0, "too_few_words", lambda m: m["n_words"] < 10),
    Rule(1, "repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule(2, "symbol_share", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule(3, "duplicate_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule(4, "long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
    Rule(5, "short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule(6, "shouting", lambda m: 2 * m["n_upper"] > m["n_letters"]),
)
#: Rules for any script, which later policies put in the place of ``long_words`` and ``shouting``; SQL has the rules above.
ANY_SCRIPT_RULES = (
    Rule(7, "long_spaced_words", lambda m: m["word_chars"] - m["n_unspaced"] > 15 * m["n_words"]),
    Rule(8, "shouting_any_script", lambda m: (2 * m["n_any_upper"] > m["n_any_letters"]) & (m["n_any_letters"] >= 20)),
)
#: Versions only ever gain entries.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbol_share", "duplicate_lines", "long_words", "short_words", "shouting"),
    "v2": ("too_few_words", "repeated_windows", "symbol_share", "duplicate_lines", "long_spaced_words", "short_words", "shouting_any_script"),
}


def mask_of(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES + ANY_SCRIPT_RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
WINDOW = 5


def measure_block(block: K.Block) -> dict[str, np.ndarray]:
    words = K.Words(block)
    data, n = block.data, block.n
    out = {"n_words": words.counts.astype(np.int64)}
    out["word_chars"] = K.per_row(block, K.NOT_SPACE[data] & K.LEAD[data])
    out["n_symbols"] = K.per_row(block, _SYMBOL[data])
    out["n_upper"] = K.per_row(block, _UPPER[data])
    out["n_letters"] = K.per_row(block, _LETTER[data])
    salt = K.mix(np.arange(1, n + 1, dtype=np.uint64))
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([block.off[:-1], breaks + 1]))
    begins = begins[begins < len(data)]
    row = np.searchsorted(block.off, begins, side="right") - 1
    ends = np.minimum(block.off[row + 1], np.append(breaks, len(data))[np.searchsorted(breaks, begins)])
    with_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, begins)
    row = row[with_word]
    keys = K.range_hashes(data, begins[with_word], ends[with_word]) ^ salt[row]
    out["n_lines"] = np.bincount(row, minlength=n).astype(np.int64)
    _, at = np.unique(keys, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[at], minlength=n)
    out["n_repeat_words"] = _repeated(words, salt)
    return out


def _repeated(words: K.Words, salt: np.ndarray) -> np.ndarray:
    """Words in windows that are found twice or more in their row, the first occurrence included."""
    runs, first = words.windows(WINDOW)
    result = np.zeros(words.block.n, dtype=np.int64)
    if not len(runs):
        return result
    row = np.repeat(np.arange(words.block.n), np.diff(first))
    keys = K.mix(runs ^ salt[row])
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return result
    at = np.flatnonzero(np.isin(keys, np.unique(twice)))
    start = words.rows[row[at]] + (at - first[row[at]])
    change = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + WINDOW, -1)
    covered = np.cumsum(change)[:-1] > 0
    total = np.zeros(len(covered) + 1, dtype=np.int64)
    np.cumsum(covered, out=total[1:])
    return np.diff(total[words.rows])


#: Code points of scripts that do not separate words by spaces, with their punctuation: Thai, Lao, Tibetan, Burmese,
#: Khmer, Japanese and Chinese.
_UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x30FF), (0x31F0, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x1AFF0, 0x1B16F), (0x20000, 0x323AF))


@cache
def _kinds() -> np.ndarray:
    """By code point: 1 for a letter, 2 for a capital, 4 for a script without spaces between words."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category[0] == "L":
            kinds[c] = 3 if category in ("Lu", "Lt") else 1
    for first, last in _UNSPACED:
        kinds[first : last + 1] |= 4
    return kinds


def _any_script_block(block: K.Block) -> dict[str, np.ndarray]:
    data = np.ascontiguousarray(block.data)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(K.LEAD[data], out=before[1:])
    kinds, rows = _kinds()[points], before[block.off]

    def per_row(bit: int) -> np.ndarray:
        total = np.zeros(len(kinds) + 1, dtype=np.int64)
        np.cumsum((kinds & bit) > 0, out=total[1:])
        return np.diff(total[rows])

    return {"n_any_letters": per_row(1), "n_any_upper": per_row(2), "n_unspaced": per_row(4)}


def measure_batch(text: pa.Array, any_script: bool = False) -> dict[str, np.ndarray]:
    parts = [measure_block(b) | (_any_script_block(b) if any_script else {}) for b in K.blocks(text)]
    names = MEASURES + (("n_any_letters", "n_any_upper", "n_unspaced") if any_script else ())
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def _ledger_batch(text: pa.Array, any_script: bool = False) -> pa.Array:
    m = measure_batch(text, any_script)
    failed = np.zeros(len(text), dtype=np.int64)
    for rule in RULES + (ANY_SCRIPT_RULES if any_script else ()):
        failed |= np.asarray(rule.fails(m)).astype(np.int64) << rule.bit
    return pa.StructArray.from_arrays([pa.array(m[k]) for k in MEASURES] + [pa.array(failed)], names=[*MEASURES, "failed"])


def ledger(text: Column, any_script: bool = False) -> Column:
    """A struct of all measurements and the failure bits of one text, on request with those of the rules for any script."""
    kind = ", ".join(f"{k} bigint" for k in (*MEASURES, "failed"))

    @F.arrow_udf(f"struct<{kind.replace(' bigint', ':bigint')}>")
    def evaluate(t: pa.Array) -> pa.Array:
        return _ledger_batch(t, any_script)

    return evaluate.asNondeterministic()(text.cast("string"))  # once for each row, however often it is used


def with_ledger(docs: DataFrame, text: str = "text", name: str = "ledger", any_script: bool = False) -> DataFrame:
    return docs.withColumn(name, ledger(F.col(text), any_script))


def passes(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(F.lit(mask_of(policy))) == 0


def apply_policy(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows that no rule of the policy rejects, with the columns they came with."""
    any_script = any(r.name in POLICIES[policy] for r in ANY_SCRIPT_RULES)
    held = docs.select(whole_row(docs), ledger(F.col(text), any_script).alias("ledger"))
    return held.filter(passes(F.col("ledger.failed"), policy)).select("row.*")


def ablation(ledgers: DataFrame, policy: str = "v1", failed: str = "ledger.failed") -> DataFrame:
    """For each rule of a policy: rows it fails, rows that only it fails, and rows kept without it.

    One pass: counts are kept for each distinct bitmask (at most 2 ** rules of them), never for each row.
    """
    mask, bits = mask_of(policy), {r.name: r.bit for r in RULES + ANY_SCRIPT_RULES}
    by_mask = ledgers.groupBy(F.col(failed).bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bits[name]).alias("bit")) for name in POLICIES[policy]])
    each = by_mask.select("bits", "n", F.explode(rules).alias("r"))
    when = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        when(F.col("bits") == F.col("r.bit")).alias("n_only"),
        when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
    )
