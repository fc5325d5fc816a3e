"""The query string language: terms, phrases, wildcards, fuzzy terms, ranges, boosts, groups and operators.

A clause is optional unless AND or + asks for it; NOT and - exclude.  AND makes both its neighbours required, as
in the classic syntax, rather than binding tighter than OR.
"""

from __future__ import annotations

import re
from dataclasses import replace

from facetry.functions import analysis
from facetry.operators.text import AllNode, BoolNode, FuzzyNode, NumberNode, PatternNode, PhraseNode, TermNode, wildcard_to_regex
from facetry.schema import SearchSchema

_TOKEN = re.compile(
    r"""\s+|(?P<op>(?:AND|OR|NOT)(?=[\s()]|$)|&&|\|\||!|\+|-|\(|\))|(?P<field>[\w.]+):(?=\S)|(?P<all>\*:\*)|"(?P<phrase>(?:\\.|[^"\\])*)"
    |/(?P<regex>(?:\\.|[^/\\])*)/|(?P<open>[\[{])\s*(?P<low>"[^"]*"|\S+)\s+TO\s+(?P<high>"[^"]*"|[^\s\]}]+)\s*(?P<close>[\]}])
    |(?P<fuzzy>~\d*(?:\.\d+)?)|\^(?P<boost>\d+(?:\.\d+)?)|(?P<term>(?:\\.|[^\s()"\[\]{}:^~\\/])+)""",
    re.X,
)


def _scan(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"Cannot parse query at {text[at : at + 20]!r}")
        if m.lastgroup == "close":
            out.append(("range", (m["open"], m["low"].strip('"'), m["high"].strip('"'), m["close"])))
        elif m.lastgroup is not None:
            out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def default_field(schema: SearchSchema, name: str) -> str:
    """The field named, or the first searchable text field in schema order."""
    if name:
        return schema.get(name).name
    found = schema.searchable_text()
    if not found:
        raise ValueError("The schema has no searchable text field")
    return found[0].name


class _Parser:
    def __init__(self, schema: SearchSchema, tokens, name: str):
        self.schema, self.tokens, self.at, self.name = schema, tokens, 0, name

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self):
        token = self.peek()
        self.at += 1
        return token

    def group(self, name: str, nested: bool = False):
        clauses: list[list] = []  # sign and node
        joined = None
        while True:
            kind, value = self.peek()
            if kind is None or (kind == "op" and value == ")"):
                break
            if kind == "op" and value in ("AND", "&&", "OR", "||"):
                if not clauses or joined is not None:
                    raise ValueError(f"Cannot parse query: {value} has no clause before it")
                joined = "AND" if value in ("AND", "&&") else "OR"
                self.take()
                continue
            sign = ""
            while kind == "op" and value in ("+", "-", "!", "NOT"):
                sign = "+" if value == "+" else "-"
                self.take()
                kind, value = self.peek()
            if kind is None or (kind == "op" and value != "("):
                raise ValueError("Cannot parse query: an operator has no clause after it")
            node = self.clause(name)
            if joined == "AND":
                if clauses[-1][0] == "":
                    clauses[-1][0] = "+"
                sign = sign or "+"
            joined = None
            if node is not None:
                clauses.append([sign, node])
        if joined is not None or (not clauses and nested):
            raise ValueError("Cannot parse query: a clause is missing")
        pick = lambda s: tuple(n for sign, n in clauses if sign == s)
        if len(clauses) == 1 and clauses[0][0] != "-":
            return clauses[0][1]
        return BoolNode(pick("+"), pick(""), pick("-"))

    def clause(self, name: str):
        kind, value = self.take()
        if kind == "field":
            self.schema.get(value)
            return self.clause(value)
        if kind == "op" and value == "(":
            node = self.group(name, nested=True)
            if self.take() != ("op", ")"):
                raise ValueError("Cannot parse query: a parenthesis is open")
        elif kind == "all":
            node = AllNode()
        elif kind == "phrase":
            node = self.words(name, re.sub(r"\\(.)", r"\1", value), phrase=True)
        elif kind == "regex":
            node = PatternNode(name, "regex", (value,))
        elif kind == "range":
            node = self.range(name, *value)
        elif kind == "term":
            node = self.term(name, value)
        else:
            raise ValueError(f"Cannot parse query: {value!r} is out of place")
        while self.peek()[0] in ("fuzzy", "boost"):
            kind, value = self.take()
            if kind == "boost":
                node = replace(node, boost=node.boost * float(value)) if node is not None else None
            elif isinstance(node, PhraseNode):
                node = replace(node, slop=int(float(value[1:] or 0)))
            elif isinstance(node, TermNode):
                node = FuzzyNode(name, node.term, min(2, int(float(value[1:] or 2)) or 2))
        return node

    def term(self, name: str, value: str):
        if value == "*":
            return PatternNode(name, "regex", (".*",))
        if re.search(r"(?<!\\)[*?]", value):
            if value[0] in "*?":
                raise ValueError("Cannot parse query: a wildcard cannot come first")
            return PatternNode(name, "regex", (wildcard_to_regex(value.lower()),))
        return self.words(name, re.sub(r"\\(.)", r"\1", value), phrase=False)

    def words(self, name: str, text: str, phrase: bool):
        f = self.schema.get(name)
        if f.is_numeric:
            return NumberNode(name, float(text), float(text))
        terms = tuple(analysis.query_tokens(f.search_analyzer, text))
        if not terms:
            return None
        if len(terms) == 1:
            return TermNode(name, terms[0])
        return PhraseNode(name, terms) if phrase else BoolNode(should=tuple(TermNode(name, t) for t in terms))

    def range(self, name: str, opened: str, low: str, high: str, closed: str):
        f = self.schema.get(name)
        ends = [None if x == "*" else x for x in (low, high)]
        if f.is_numeric:
            return NumberNode(name, *[None if x is None else float(x) for x in ends], opened == "{", closed == "}")
        return PatternNode(name, "range", (*[x.lower() if x is not None else None for x in ends], opened == "{", closed == "}"))


def parse(schema: SearchSchema, text: str, name: str = ""):
    """The query tree; ValueError where the text is no query."""
    p = _Parser(schema, _scan(text), "")
    node = p.group(default_field(schema, name))
    if p.at < len(p.tokens):
        raise ValueError("Cannot parse query: a parenthesis was not open")
    return node
