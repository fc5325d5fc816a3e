"""Sorting, limits, offsets and cursors; the last sort key is always the row number ``_doc``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions import geo
from facetry.request import Cursor, Sort
from facetry.schema import SearchSchema

DEFAULT_TOP, MAX_TOP, MAX_OFFSET = 10, 10_000, 10_000


def top_k(k: int) -> int:
    return min(k, MAX_TOP) if k > 0 else DEFAULT_TOP


def offset(n: int) -> int:
    if n > MAX_OFFSET:
        raise ValueError(f"offset {n} is above {MAX_OFFSET}; use search_after")
    return max(0, n)


def sort_keys(schema: SearchSchema, sort: tuple[Sort, ...]) -> list[tuple[str, Column, bool]]:
    """Name, value and direction of each key; a missing number counts as 0, a missing text comes lowest."""
    keys = []
    for i, s in enumerate(sort):
        f = schema.get(s.field)
        if not f.sortable:
            raise ValueError(f"Field {s.field} is not sortable")
        if f.is_collection or f.type == "VECTOR":
            raise ValueError(f"Sort not supported for {f.type}")
        c = F.col(f.name)
        if f.type == "GEO_POINT":
            if s.geo_origin is None:
                raise ValueError("A geo sort needs an origin")
            if s.descending:
                raise ValueError("A geo sort cannot be descending")
            geo.check_point(*s.geo_origin)
            c = F.coalesce(geo.haversine(c["lat"], c["lon"], *s.geo_origin), F.lit(float("inf")))
        elif f.is_numeric:
            c = F.coalesce(c, F.lit(0).cast({"INT32": "int", "DOUBLE": "double"}.get(f.base, "long")))
        elif f.base == "BOOLEAN":
            c = F.when(c, "T").when(~c, "F")
        keys.append((f"_sort{i}", c, s.descending))
    return keys


def _order(keys) -> list[Column]:
    return [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, _, down in keys]


def _after(name: str, down: bool, value) -> tuple[Column, Column]:
    """Strictly after the value, and at it, with null lowest."""
    c = F.col(name)
    if value is None:
        return (F.lit(False) if down else c.isNotNull()), c.isNull()
    later = (c < F.lit(value)) | c.isNull() if down else c > F.lit(value)
    return F.coalesce(later, F.lit(False)), F.coalesce(c == F.lit(value), F.lit(False))


def _typed(schema: SearchSchema, s: Sort, value):
    f = schema.get(s.field)
    if value is None or f.base in ("STRING", "BOOLEAN"):
        return value
    return float(value) if f.base in ("DOUBLE", "GEO_POINT") else int(value)  # ValueError where it is no number


def page(matched: DataFrame, schema: SearchSchema, k: int = 0, skip: int = 0, sort: tuple[Sort, ...] = (), after: Cursor | None = None) -> DataFrame:
    """One page in order, with the sort keys as ``_sort0`` and so on, by one top-k pass."""
    skip, k = offset(skip), top_k(k)
    after = after if after is not None and after.doc >= 0 else None
    keys = sort_keys(schema, sort)
    rows = matched.withColumns({n: c for n, c, _ in keys}) if keys else matched
    if after is not None:
        skip = 0
        same, later = F.lit(True), F.lit(False)
        values = [_typed(schema, s, v) for s, v in zip(sort, after.values, strict=True)] if keys else [after.score]
        for (name, _, down), v in zip(keys or [("_score", None, True)], values, strict=True):
            beyond, at = _after(name, down, v)
            later, same = later | (same & beyond), same & at
        rows = rows.filter(later | (same & (F.col("_doc") > after.doc)))
    order = _order(keys) if keys else [F.desc("_score")]
    rows = rows.orderBy(*order, "_doc")
    return (rows.limit(k + skip).offset(skip) if skip else rows.limit(k)).orderBy(*order, "_doc")


def cursor(rows: list, n_sort: int) -> Cursor | None:
    """The cursor after a collected page (of at most MAX_TOP rows)."""
    if not rows:
        return None
    last = rows[-1]
    return Cursor(last["_score"], last["_doc"], tuple(last[f"_sort{i}"] for i in range(n_sort)))
