"""Operators for large text corpora: language, quality, near copies, mixing, tokens, pages and media.

Nothing else in the library imports this subpackage.  Each module holds one operator with its own general
interface; :mod:`facetry.llm.queries` wires them to the standard tables.
"""
