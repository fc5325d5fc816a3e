"""Structured filters as boolean Columns; they never change a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry import request as R
from facetry.functions import geo
from facetry.schema import SearchSchema

_INTEGER = ("INT32", "INT64", "DATE_TIME_OFFSET")


def _literal(base: str, value: str):
    if base in _INTEGER:
        n = int(value)  # ValueError where it is no integer
        bound = 1 << (31 if base == "INT32" else 63)
        if not -bound <= n < bound:
            raise ValueError(f"{value} is out of range")
        return F.lit(n).cast("int" if base == "INT32" else "long")
    if base == "DOUBLE":
        return F.lit(float(value))
    if base == "BOOLEAN":
        return F.lit({"T": True, "F": False}.get(value))
    return F.lit(value)


def _any(f, test) -> Column:
    return F.exists(F.col(f.name), test) if f.is_collection else test(F.col(f.name))


def _field(schema: SearchSchema, name: str):
    f = schema.get(name)
    if not f.filterable:
        raise ValueError(f"Field {name} is not filterable")
    return f


def to_column(schema: SearchSchema, clause) -> Column:
    """One filter clause; the result may be null, which does not pass."""
    if isinstance(clause, R.Compound):
        return _compound(schema, clause)
    if not hasattr(clause, "field"):
        raise ValueError("A filter clause has no predicate")
    f = _field(schema, clause.field)
    if isinstance(clause, R.Term):
        if f.base not in ("STRING", "BOOLEAN", *_INTEGER, "DOUBLE"):
            raise ValueError(f"Term filter not supported for {f.type}")
        value = _literal(f.base, clause.value)
        return F.array_contains(F.col(f.name), value) if f.is_collection else F.col(f.name) == value
    if isinstance(clause, R.Range):
        if not f.is_numeric:
            raise ValueError(f"Range filter not supported for {f.type}")
        low = _literal(f.base, clause.min) if clause.min else None
        high = _literal(f.base, clause.max) if clause.max else None

        def inside(x: Column) -> Column:
            test = x.isNotNull()
            if low is not None:
                test &= x > low if clause.min_exclusive else x >= low
            if high is not None:
                test &= x < high if clause.max_exclusive else x <= high
            return test

        return _any(f, inside)
    if isinstance(clause, R.Exists):
        if not f.sortable and not f.is_numeric:
            raise ValueError(f"Exists filter needs a sortable or numeric field: {f.name}")
        return F.col(f.name).isNotNull() if clause.must_exist else F.col(f.name).isNull()
    if isinstance(clause, (R.GeoDistance, R.GeoBox)):
        if f.base != "GEO_POINT":
            raise ValueError(f"Geo filter not supported for {f.type}")
        if isinstance(clause, R.GeoDistance):
            return _any(f, lambda p: geo.within(p, clause.lat, clause.lon, clause.meters))
        return _any(f, lambda p: geo.in_box(p, clause.top, clause.left, clause.bottom, clause.right))
    raise ValueError("A filter clause has no predicate")


def _compound(schema: SearchSchema, c: R.Compound) -> Column:
    if not (c.must or c.should or c.must_not):
        raise ValueError("Compound filter is empty")
    parts = [to_column(schema, x) for x in c.must]
    if c.should:
        parts.append(reduce(lambda a, b: a | b, [F.coalesce(to_column(schema, x), F.lit(False)) for x in c.should]))
    parts += [~F.coalesce(to_column(schema, x), F.lit(False)) for x in c.must_not]
    return reduce(lambda a, b: a & b, parts)


def combine(schema: SearchSchema, filters, tenant: str = "") -> Column | None:
    """All filters and the tenant's rows; None where nothing is asked.

    Without expiry there are no system columns, so a tenant matches nothing.
    """
    parts = [to_column(schema, x) for x in filters]
    if tenant:
        parts.append(F.col("_tenant_id") == tenant if schema.ttl_enabled else F.lit(False))
    return reduce(lambda a, b: a & b, parts) if parts else None
