"""Full-text queries as expressions over leaf columns, scored by BM25.

A query is a small tree.  Compiling it lists its leaves: each becomes one narrow column (a term's frequency, a phrase's
frequency, or whether some token matches).  Matching and scoring are then Column expressions over a table of numbers.

With an index, a row's leaves are an aggregate of its postings: the scan reads the postings of the query's terms only,
and document frequencies and mean lengths come from the dictionary.  Without one, a projection over token arrays gives
the leaves of every row and one aggregate the statistics; that table of row numbers and leaves is persisted, so that texts are
tokenised once, and listed in ``held`` for the caller to release.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions import analysis
from facetry.request import SearchRequest
from facetry.schema import SearchSchema
from facetry.sources.postings import TextIndex, among

MAX_EXPANSIONS = 50


@dataclass(frozen=True)
class TermNode:
    field: str
    term: str
    boost: float = 1.0


@dataclass(frozen=True)
class PhraseNode:
    field: str
    terms: tuple[str, ...]
    slop: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class PatternNode:
    """Any token that matches; a constant score."""

    field: str
    kind: str  # prefix, regex, range
    pattern: tuple
    boost: float = 1.0


@dataclass(frozen=True)
class FuzzyNode:
    field: str
    term: str
    edits: int = 2
    prefix: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class NumberNode:
    """A range over a numeric field; a constant score."""

    field: str
    low: float | None
    high: float | None
    low_open: bool = False
    high_open: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class AllNode:
    boost: float = 1.0


@dataclass(frozen=True)
class BoolNode:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    boost: float = 1.0


def any_of(nodes) -> object:
    nodes = tuple(nodes)
    return nodes[0] if len(nodes) == 1 else BoolNode(should=nodes)


def fields_for(schema: SearchSchema, name: str) -> list[str]:
    """The field named, or all searchable text fields."""
    if name:
        schema.get(name)
        return [name]
    found = [f.name for f in schema.searchable_text()]
    if not found:
        raise ValueError("The schema has no searchable text field")
    return found


def words(text: str) -> list[str]:
    """Query words as they are: lower-cased, split at white space, not analysed."""
    return text.strip().lower().split()


def _needed_words(text: str, what: str) -> list[str]:
    got = words(text)
    if not got:
        raise ValueError(f"{what} is blank")
    return got


def text_node(schema: SearchSchema, text: str, name: str = ""):
    return any_of(TermNode(f, t) for f in fields_for(schema, name) for t in words(text))


def phrase_node(schema: SearchSchema, text: str, name: str = "", slop: int = 0):
    if slop < 0:
        raise ValueError("phrase slop must not be negative")
    terms = tuple(_needed_words(text, "phrase query"))
    return any_of(PhraseNode(f, terms, slop) for f in fields_for(schema, name))


def fuzzy_node(schema: SearchSchema, text: str, name: str = "", max_edits: int = 0, prefix_length: int = 0):
    edits = min(max_edits, 2) if max_edits > 0 else 2
    terms = _needed_words(text, "fuzzy query")
    return any_of(FuzzyNode(f, t, edits, max(0, prefix_length)) for f in fields_for(schema, name) for t in terms)


def prefix_node(schema: SearchSchema, text: str, name: str = ""):
    return any_of(PatternNode(f, "prefix", (text.strip().lower(),)) for f in fields_for(schema, name))


def resolve(schema: SearchSchema, r: SearchRequest):
    """The request's text query: the first kind that is not empty, or None."""
    from facetry.operators.query_string import parse

    if r.query_string.strip():
        return parse(schema, r.query_string, r.default_field)
    if r.text_query.strip():
        return text_node(schema, r.text_query, r.text_field)
    if r.phrase_query:
        return phrase_node(schema, r.phrase_query, r.phrase_field, r.phrase_slop)
    if r.fuzzy_query:
        return fuzzy_node(schema, r.fuzzy_query, r.fuzzy_field, r.max_edits, r.prefix_length)
    if r.prefix_query.strip():
        return prefix_node(schema, r.prefix_query, r.prefix_field)
    return None


# ---- leaves ----


def _tokens(name: str) -> str:
    return f"_tokens_{name}"


def _term_frequency(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(term)))


def sloppy_frequency(places: list[list[int]] | None, slop: int) -> float:
    """Sum of 1 / (1 + width) over matches whose places, less their place in the phrase, differ by at most slop.

    ``places`` has for each word of the phrase where it stands.
    """
    places = [[i - k for i in at] for k, at in enumerate(places or ())]
    if not places or not all(places):
        return 0.0
    at, total, best, shown = [0] * len(places), 0.0, None, None
    while True:
        now = [p[i] for p, i in zip(places, at, strict=True)]
        real = {x + k for k, x in enumerate(now)}
        width = max(now) - min(now)
        low = now.index(min(now))
        if len(real) == len(now) and width <= slop and (best is None or width < best):
            best = width
        if shown is not None and low != shown and best is not None:
            total, best = total + 1 / (1 + best), None
        shown = low
        at[low] += 1
        if at[low] >= len(places[low]):
            return total + (1 / (1 + best) if best is not None else 0.0)


def _places(tokens: Column, term: str) -> Column:
    return F.filter(F.transform(tokens, lambda t, i: F.when(t == F.lit(term), i)), lambda i: i.isNotNull())


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda i: i - by)


def _phrase(places: list[Column], slop: int) -> Column:
    """A phrase's frequency from the places of its words; null where a word is missing."""
    if not slop:
        return F.size(reduce(F.array_intersect, [_shifted(at, k) for k, at in enumerate(places)])).cast("double")

    @F.arrow_udf("double")
    def run(t: pa.Array) -> pa.Array:
        return pa.array([sloppy_frequency(x, slop) for x in t.to_pylist()], pa.float64())

    has_all = reduce(lambda a, b: a & b, [F.coalesce(F.size(at) > 0, F.lit(False)) for at in places])
    return run(F.when(has_all, F.array(*places)))  # other rows send nothing to Python


def edit_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours (optimal string alignment); most + 1 if above."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y)))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        two, one = one, row
    return min(one[-1], most + 1)


def expand_fuzzy(terms: DataFrame, node: FuzzyNode) -> list[TermNode]:
    """The nearest ones of a field's terms, at most MAX_EXPANSIONS, weighted by nearness.

    A JVM filter by length and Levenshtein distance (a swap of neighbours counts two there) leaves a short list of
    distinct terms; only those are measured exactly.
    """
    t, low = node.term, max(0, len(node.term) - node.edits)
    x = F.col("term")
    near = F.length(x).between(low, len(t) + node.edits) & x.startswith(t[: node.prefix]) & (F.levenshtein(x, F.lit(t), 2 * node.edits) >= 0)

    @F.arrow_udf("int")
    def distance(x: pa.Array) -> pa.Array:
        return pa.array([edit_distance(w, t, node.edits) for w in x.to_pylist()], pa.int32())

    best = terms.filter(near).select("term").distinct().withColumn("d", distance("term")).filter(F.col("d") <= node.edits)
    found = best.orderBy("d", "term").limit(MAX_EXPANSIONS).collect()
    return [TermNode(node.field, r["term"], node.boost * (1 - r["d"] / max(1, min(len(r["term"]), len(t))))) for r in found]


# ---- compiling ----


def _rewrite(node, terms_of):
    """Fuzzy nodes become the terms they stand for; ``terms_of`` gives a field's terms."""
    if isinstance(node, FuzzyNode):
        return BoolNode(should=tuple(expand_fuzzy(terms_of(node.field), node)))
    if isinstance(node, BoolNode):
        return replace(node, **{k: tuple(_rewrite(x, terms_of) for x in getattr(node, k)) for k in ("must", "should", "must_not")})
    return node


def _kinds(node) -> set[type]:
    if isinstance(node, BoolNode):
        return set().union(*[_kinds(x) for x in (*node.must, *node.should, *node.must_not)])
    return {type(node)}


def _used_fields(node) -> set[str]:
    if isinstance(node, BoolNode):
        return set().union(*[_used_fields(x) for x in (*node.must, *node.should, *node.must_not)])
    return {node.field} if isinstance(node, (TermNode, PhraseNode, PatternNode, FuzzyNode)) else set()


@dataclass
class _Leaves:
    """Leaf columns of rows with token arrays."""

    schema: SearchSchema
    columns: dict[object, str] = field(default_factory=dict)
    exprs: dict[str, Column] = field(default_factory=dict)

    def add(self, what, expr: Column) -> str:
        if what not in self.columns:
            self.columns[what] = f"_x{len(self.columns)}"
            self.exprs[self.columns[what]] = expr
        return self.columns[what]

    def tf(self, name: str, term: str) -> None:
        self.add(("tf", name, term), F.coalesce(_term_frequency(F.col(_tokens(name)), term), F.lit(0)))

    def length(self, name: str) -> None:
        live = F.size(F.filter(_tokens(name), lambda t: t.isNotNull()))
        self.add(("dl", name), F.coalesce(live, F.lit(0)))

    def phrase(self, node: PhraseNode) -> None:
        freq = _phrase([_places(F.col(_tokens(node.field)), t) for t in node.terms], node.slop)
        self.add(("phrase", node.field, node.terms, node.slop), F.coalesce(freq, F.lit(0.0)))

    def pattern(self, node: PatternNode) -> None:
        self.add(("pattern", node.field, node.kind, node.pattern), F.coalesce(F.exists(_tokens(node.field), _token_test(node)), F.lit(False)))

    def number(self, node: NumberNode) -> None:
        c = F.col(node.field)
        test = c.isNotNull()
        if node.low is not None:
            test &= c > node.low if node.low_open else c >= node.low
        if node.high is not None:
            test &= c < node.high if node.high_open else c <= node.high
        self.add(("number", node), F.coalesce(test, F.lit(False)))

    def visit(self, node) -> None:
        if isinstance(node, BoolNode):
            for x in (*node.must, *node.should, *node.must_not):
                self.visit(x)
        elif isinstance(node, TermNode):
            self.tf(node.field, node.term)
            self.length(node.field)
        elif isinstance(node, PhraseNode):
            for t in node.terms:
                self.tf(node.field, t)
            self.length(node.field)
            self.phrase(node)
        elif isinstance(node, PatternNode):
            self.pattern(node)
        elif isinstance(node, NumberNode):
            self.number(node)


@dataclass
class _IndexLeaves(_Leaves):
    """Leaf columns as aggregates of a row's postings; what needs all of a row's places, or the row itself, comes after."""

    terms: set[tuple[str, str]] = field(default_factory=set)
    patterns: list[Column] = field(default_factory=list)
    after: dict[str, Column] = field(default_factory=dict)

    def _here(self, name: str, term: str) -> Column:
        self.terms.add((name, term))
        return (F.col("field") == name) & (F.col("term") == term)

    def tf(self, name: str, term: str) -> None:
        self.add(("tf", name, term), F.max(F.when(self._here(name, term), F.col("tf"))))

    def length(self, name: str) -> None:
        self.add(("dl", name), F.max(F.when(F.col("field") == name, F.col("dl"))))

    def phrase(self, node: PhraseNode) -> None:
        places = [F.col(self.add(("at", node.field, t), F.first(F.when(self._here(node.field, t), F.col("positions")), ignorenulls=True))) for t in node.terms]
        self._later(("phrase", node.field, node.terms, node.slop), F.coalesce(_phrase(places, node.slop), F.lit(0.0)))

    def pattern(self, node: PatternNode) -> None:
        test = (F.col("field") == node.field) & _token_test(node)(F.col("term"))
        beginning = node.pattern[0] if node.kind == "prefix" else literal_beginning(node.pattern[0]) if node.kind == "regex" else ""
        if beginning:  # a range of terms, which the scan knows by the least and greatest of its pages
            test = (F.col("field") == node.field) & F.col("term").startswith(beginning) & test
        self.patterns.append(test)
        self.add(("pattern", node.field, node.kind, node.pattern), F.max(test))

    def number(self, node: NumberNode) -> None:
        super().number(node)
        name = self.columns["number", node]
        self.after[name] = self.exprs.pop(name)

    def _later(self, what, expr: Column) -> None:
        self.columns[what] = name = f"_x{len(self.columns)}"
        self.after[name] = expr

    def postings(self, index: TextIndex) -> DataFrame:
        tests = [among(self.terms)] if self.terms else []
        return index.postings(reduce(lambda a, b: a | b, tests + self.patterns), any(what[0] == "at" for what in self.columns))

    def rows(self, index: TextIndex) -> DataFrame:
        """``_doc`` and leaves of all rows that have one of the postings."""
        hits = self.postings(index)
        if len(self.terms) == 1 and not self.patterns and not self.after:  # one posting for each row
            plain = {"tf": F.col("tf"), "dl": F.col("dl")}
            return hits.select("_doc", *[plain[what[0]].alias(name) for what, name in self.columns.items()])
        return self.filled(hits.groupBy("_doc").agg(*[e.alias(n) for n, e in self.exprs.items()]))

    def filled(self, rows: DataFrame) -> DataFrame:
        """A term or pattern that a row has no posting of is not in it."""
        empty = {"tf": F.lit(0), "pattern": F.lit(False)}
        return rows.withColumns({name: F.coalesce(name, empty[what[0]]) for what, name in self.columns.items() if what[0] in empty})


def literal_beginning(pattern: str) -> str:
    """The characters that every match of a regular expression begins with."""
    if "|" in pattern:
        return ""
    found = re.match(r"\w*", pattern)[0]
    return found[:-1] if pattern[len(found) : len(found) + 1] in ("*", "?", "{") else found


def _token_test(node: PatternNode):
    if node.kind == "prefix":
        return lambda t: F.coalesce(t.startswith(node.pattern[0]), F.lit(False))
    if node.kind == "regex":
        return lambda t: F.coalesce(t.rlike(f"^(?:{node.pattern[0]})$"), F.lit(False))
    low, high, low_open, high_open = node.pattern

    def inside(t: Column) -> Column:
        test = t.isNotNull()
        if low is not None:
            test &= t > low if low_open else t >= low
        if high is not None:
            test &= t < high if high_open else t <= high
        return test

    return inside


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


@dataclass
class _RowStatistics:
    """Statistics as columns of one row."""

    leaves: _Leaves

    def mean(self, name: str) -> Column:
        dl = self.leaves.columns[("dl", name)]
        return F.col(f"_sum{dl}") / F.col(f"_n{dl}")

    def idf(self, name: str, term: str) -> Column:
        return idf(F.col(f"_n{self.leaves.columns[('dl', name)]}"), F.col(f"_n{self.leaves.columns[('tf', name, term)]}"))


@dataclass
class _IndexStatistics:
    """Statistics as literals, from the dictionary."""

    index: TextIndex
    frequency: dict[tuple[str, str], int]

    def mean(self, name: str) -> Column:
        return F.lit(float(self.index.mean_length(name)))

    def idf(self, name: str, term: str) -> Column:
        n, df = self.index.lengths.get(name, (0, 0))[0], self.frequency.get((name, term), 0)
        return F.lit(math.log(1 + (n - df + 0.5) / (df + 0.5)))


@dataclass
class _Scores:
    """Match and score Columns of a tree, over leaf columns and statistics."""

    leaves: _Leaves
    statistics: object
    k1: float
    b: float

    def bm25(self, name: str, freq: Column, weight: Column) -> Column:
        dl = self.leaves.columns[("dl", name)]
        return weight * freq / (freq + self.k1 * (1 - self.b + self.b * F.col(dl) / self.statistics.mean(name)))

    def idf(self, name: str, term: str) -> Column:
        return self.statistics.idf(name, term)

    def of(self, node) -> tuple[Column, Column]:
        col = self.leaves.columns
        zero = F.lit(0.0)
        if isinstance(node, TermNode):
            tf = F.col(col["tf", node.field, node.term])
            return tf > 0, F.when(tf > 0, node.boost * self.bm25(node.field, tf, self.idf(node.field, node.term))).otherwise(zero)
        if isinstance(node, PhraseNode):
            freq = F.col(col["phrase", node.field, node.terms, node.slop])
            weight = reduce(lambda a, b: a + b, [self.idf(node.field, t) for t in node.terms])
            return freq > 0, F.when(freq > 0, node.boost * self.bm25(node.field, freq, weight)).otherwise(zero)
        if isinstance(node, (PatternNode, NumberNode)):
            key = ("pattern", node.field, node.kind, node.pattern) if isinstance(node, PatternNode) else ("number", node)
            hit = F.col(col[key])
            return hit, F.when(hit, F.lit(float(node.boost))).otherwise(zero)
        if isinstance(node, AllNode):
            return F.lit(True), F.lit(float(node.boost))
        must, should, never = ([self.of(x) for x in part] for part in (node.must, node.should, node.must_not))
        match = reduce(lambda a, b: a & b, [m for m, _ in must], F.lit(True))
        if not must:  # without a required clause one of the others must match; exclusions alone match nothing
            match = reduce(lambda a, b: a | b, [m for m, _ in should], F.lit(False))
        match = reduce(lambda a, b: a & ~b, [m for m, _ in never], match)
        score = reduce(lambda a, b: a + b, [s for _, s in must + should], zero)
        return match, F.when(match, node.boost * score).otherwise(zero)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows over all cores where the files give fewer partitions (one row group is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def score(docs: DataFrame, schema: SearchSchema, node, index: TextIndex | None = None, held: list | None = None) -> DataFrame:
    """Rows that match the tree, with ``_score``; statistics are those of all rows of the index, or of ``docs``."""
    if index is None:
        return _scanned(docs, schema, node, held)
    ids = score_ids(schema, node, index)
    return docs.join(ids, "_doc") if ids is not None else _scored_with_rows(docs, schema, node, index)


def _indexed(schema: SearchSchema, node, index: TextIndex):
    node = _rewrite(node, lambda name: index.terms.filter(F.col("field") == name))
    leaves = _IndexLeaves(schema)
    leaves.visit(node)
    needed = {(what[1], what[2]) for what in leaves.columns if what[0] == "tf"}
    match, points = _Scores(leaves, _IndexStatistics(index, index.frequencies(needed)), schema.k1, schema.b).of(node)
    return leaves, F.coalesce(match, F.lit(False)), points


def score_ids(schema: SearchSchema, node, index: TextIndex) -> DataFrame | None:
    """``_doc, _score`` from postings alone; None where the tree asks for more than terms (numbers, or all rows)."""
    if _kinds(node) & {AllNode, NumberNode}:
        return None
    leaves, match, points = _indexed(schema, node, index)
    if not leaves.exprs:  # a fuzzy term without any near one
        return index.postings(F.lit(False)).select("_doc", F.lit(0.0).alias("_score"))
    return leaves.rows(index).withColumns(leaves.after).filter(match).select("_doc", points.alias("_score"))


def _scored_with_rows(docs: DataFrame, schema: SearchSchema, node, index: TextIndex) -> DataFrame:
    leaves, match, points = _indexed(schema, node, index)
    kept = docs.columns
    rows = leaves.filled(docs.join(leaves.rows(index), "_doc", "left")) if leaves.exprs else docs
    return rows.withColumns(leaves.after).filter(match).select(*kept, points.alias("_score"))


def _scanned(docs: DataFrame, schema: SearchSchema, node, held: list | None) -> DataFrame:
    used = sorted(_used_fields(node))
    tokenised = spread(docs).withColumns({_tokens(n): analysis.field_tokens(schema.get(n)) for n in used})
    node = _rewrite(node, lambda name: tokenised.select(F.explode(F.array_distinct(_tokens(name))).alias("term")).filter("term is not null"))
    leaves = _Leaves(schema)
    leaves.visit(node)
    statistics = _RowStatistics(leaves)
    if not leaves.exprs:
        match, points = _Scores(leaves, statistics, schema.k1, schema.b).of(node)
        return docs.select(*docs.columns, points.alias("_score")).filter(match)
    # numbers only; kept, so that neither the statistics nor the join with the rows tokenises again
    slim = tokenised.select("_doc", *[e.alias(n) for n, e in leaves.exprs.items()]).persist()
    if held is not None:
        held.append(slim)
    counts = []
    for what, name in leaves.columns.items():
        if what[0] == "dl":
            counts += [F.sum(F.col(name).cast("double")).alias(f"_sum{name}"), F.count(F.when(F.col(name) > 0, 1)).alias(f"_n{name}")]
        elif what[0] == "tf":
            counts.append(F.count(F.when(F.col(name) > 0, 1)).alias(f"_n{name}"))
    ready = slim.crossJoin(F.broadcast(slim.agg(*counts))) if counts else slim  # one row of statistics
    match, points = _Scores(leaves, statistics, schema.k1, schema.b).of(node)
    return docs.join(ready.filter(match).select("_doc", points.alias("_score")), "_doc")


def wildcard_to_regex(pattern: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


def python_bm25(tf: float, dl: float, n: int, df: int, mean: float, k1: float = 1.2, b: float = 0.75) -> float:
    """The same score on the driver, for checks."""
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * dl / mean))
