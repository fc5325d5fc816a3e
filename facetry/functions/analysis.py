"""Analyzers: text columns to arrays of tokens.

``standard``, ``simple``, ``keyword`` and ``whitespace`` are Column expressions.  Language analyzers take standard
tokens, drop the language's stop words and stem the others (``stemming``), in one Arrow batch function.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.functions.stemming import stem, stop_words
from facetry.schema import Field

STANDARD = r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*"
LANGUAGES = tuple("ar hy eu bn br bg ca cjk cs da nl en et fi fr gl de el hi hu id ga it lv lt no fa pl pt ro ru sr ckb es sv th tr uk".split())
#: Position gap between two values of one field, which phrases do not cross.
GAP = 100

def names() -> list[str]:
    return ["standard", "simple", "keyword", "whitespace", *[f"lucene.{c}" for c in LANGUAGES]]


def check(name: str) -> str:
    if name not in names():
        raise ValueError(f"Unknown analyzer {name}; known: {', '.join(names())}")
    return name


def _non_empty(x: Column) -> Column:
    return F.filter(x, lambda t: t != "")


def cjk_bigrams(token: str) -> list[str]:
    if not re.search(r"[぀-ヿ㐀-鿿가-힯]", token):
        return [token]
    return [token[i : i + 2] for i in range(len(token) - 1)] or [token]


def _language(code: str, tokens: Column) -> Column:
    stop = stop_words(code)

    @F.arrow_udf("array<string>")
    def run(t: pa.Array) -> pa.Array:
        if code == "cjk":
            rows = t.to_pylist()
            return pa.array([r if r is None else [x for w in r for x in (cjk_bigrams(w) if w is not None else (None,))] for r in rows], pa.list_(pa.string()))
        # Each distinct word of the batch is stemmed once.
        lengths = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False)
        coded = t.flatten().dictionary_encode()
        stems = pa.array([None if w in stop else stem(w, code) for w in coded.dictionary.to_pylist()], pa.string())
        ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), stems.take(coded.indices), mask=t.is_null())

    return run(tokens)


def tokens(name: str, text: Column) -> Column:
    """Tokens of a string column; null text gives null.  A stop word leaves a null token, so phrases do not close up over it."""
    check(name)
    if name == "keyword":
        return F.when(text.isNotNull(), F.array(text))
    if name == "whitespace":
        return _non_empty(F.split(text, r"\s+"))
    if name == "simple":
        return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)
    standard = F.regexp_extract_all(F.lower(text), F.lit(STANDARD), 0)
    return standard if name == "standard" else _language(name.removeprefix("lucene."), standard)


def field_tokens(f: Field, search: bool = False) -> Column:
    """A field's tokens.  Values of a collection follow each other behind a gap of null tokens."""
    name = f.search_analyzer if search else f.index_analyzer
    if not f.is_collection:
        return tokens(name, F.col(f.name))
    if name.startswith("lucene."):
        return _language(name.removeprefix("lucene."), _with_gaps("standard", F.col(f.name)))
    return _with_gaps(name, F.col(f.name))


def _with_gaps(name: str, values: Column) -> Column:
    """Tokens of all values, with GAP null tokens between two of them."""
    gap = F.array_repeat(F.lit(None).cast("string"), GAP)
    return F.aggregate(F.transform(values, lambda v: tokens(name, v)), F.array().cast("array<string>"), lambda all_, x: F.when(F.size(all_) == 0, x).otherwise(F.concat(all_, gap, x)))


def query_tokens(name: str, text: str) -> list[str]:
    """The same analysis of a query's own words, on the driver."""
    check(name)
    if name == "keyword":
        return [text]
    if name == "whitespace":
        return text.split()
    if name == "simple":
        return re.findall(r"[^\W\d_]+", text.lower())
    words = re.findall(r"\w+(?:['’.]\w+)*", text.lower())
    code = name.removeprefix("lucene.")
    if name == "standard":
        return words
    if code == "cjk":
        return [x for w in words for x in cjk_bigrams(w)]
    return [stem(w, code) for w in words if w not in stop_words(code)]
