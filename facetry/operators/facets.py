"""Facets: exact counts over all matching rows, those of a request in one pass.

A row gives one small entry (field, bucket) for each facet and value; one aggregate counts them, and what is left to
do (labels, order, the first ones) is done on the buckets.  A facet is ``value, count, from, to``; ``from`` and ``to``
are null for terms and dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.request import Facet
from facetry.schema import Field, SearchSchema

DEFAULT_COUNT = 10
MAX_RANGES = 10_000
ORDERS = ("COUNT_DESC", "COUNT_ASC", "VALUE_ASC", "VALUE_DESC")
DATE_LABELS = {"MINUTE": "yyyy-MM-dd'T'HH:mm'Z'", "HOUR": "yyyy-MM-dd'T'HH:mm'Z'", "DAY": "yyyy-MM-dd", "MONTH": "yyyy-MM", "YEAR": "yyyy"}


def _number(v: Column, is_double: bool) -> Column:
    return v.cast("string") if is_double else v.cast("long").cast("string")


def _label(f: Field, v: Column) -> Column:
    if f.base == "BOOLEAN":
        return F.when(v, "T").otherwise("F")
    if f.base == "DOUBLE":
        return F.when((v == F.floor(v)) & (F.abs(v) < 9e18), v.cast("long").cast("string")).otherwise(v.cast("string"))
    return v.cast("string")


def check(schema: SearchSchema, spec: Facet) -> Field:
    f = schema.get(spec.field)
    if not f.facetable:
        raise ValueError(f"Field {f.name} is not facetable")
    if f.base in ("GEO_POINT", "VECTOR"):
        raise ValueError(f"Facets not supported for {f.type}")
    if spec.sort not in ORDERS:
        raise ValueError(f"Unknown facet order {spec.sort}")
    if spec.values and (spec.interval > 0 or spec.date_interval):
        raise ValueError("values and interval exclude each other")
    return f


def _is_date(f: Field, spec: Facet) -> bool:
    return bool(spec.date_interval) and f.base == "DATE_TIME_OFFSET"


def _is_range(f: Field, spec: Facet) -> bool:
    return not _is_date(f, spec) and spec.interval > 0 and f.is_numeric


_MS = {"MINUTE": 60_000, "HOUR": 3_600_000, "DAY": 86_400_000}
_EPOCH = "1970-01-01"


def _unit(spec: Facet) -> str:
    return spec.date_interval if spec.date_interval in DATE_LABELS else "DAY"


def _day(ms: Column) -> Column:
    return F.date_add(F.lit(_EPOCH).cast("date"), F.floor(ms / 86_400_000).cast("int"))


def _bucket(f: Field, spec: Facet, v: Column) -> Column:
    """A value's entry: text of a term, number of a range or date bucket, and the value as a number."""
    text, at, number = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("double")
    if _is_date(f, spec):
        unit = _unit(spec)
        at = F.floor(v / _MS[unit]) * _MS[unit] if unit in _MS else F.date_diff(F.trunc(_day(v), unit), F.lit(_EPOCH).cast("date")).cast("long") * 86_400_000
    elif _is_range(f, spec):
        number = v.cast("double")
        at = F.floor(number / F.lit(float(spec.interval)))
    else:
        text = _label(f, v)
        if f.base in ("INT32", "INT64", "DATE_TIME_OFFSET"):
            number = v.cast("double")
    return F.struct(F.lit(spec.field).alias("field"), text.alias("s"), at.cast("long").alias("at"), number.alias("x"))


def _entries(f: Field, spec: Facet) -> Column:
    """The entries of a row; texts of a collection count once for each row, numbers as often as they occur."""
    c = F.col(f.name)
    values = F.array(c) if not f.is_collection else c if f.is_numeric else F.array_distinct(c)
    return F.transform(F.filter(F.coalesce(values, F.array()) if f.is_collection else values, lambda v: v.isNotNull()), lambda v: _bucket(f, spec, v))


def _for(specs: list[tuple[Field, Facet]], value, otherwise=None) -> Column:
    """A Column by field."""
    out = F.lit(otherwise)
    for f, spec in specs:
        out = F.when(F.col("field") == f.name, value(f, spec)).otherwise(out)
    return out


def _first(spec: Facet) -> int:
    return spec.count if spec.count > 0 else DEFAULT_COUNT


def _counted(matched: DataFrame, chosen: list[tuple[Field, Facet]]) -> tuple[DataFrame, list[Column], list[Column]]:
    """Buckets of all facets with their counts, the order within a field, and the columns of a result."""
    if len(chosen) == 1 and not chosen[0][0].is_collection:  # one entry at most for each row
        f, spec = chosen[0]
        entries = matched.filter(F.col(f.name).isNotNull()).select(_bucket(f, spec, F.col(f.name)).alias("e"))
    else:
        entries = matched.select(F.explode(F.concat(*[_entries(f, s) for f, s in chosen])).alias("e"))
    buckets = entries.groupBy("e.field", "e.s", "e.at")
    counts = buckets.agg(F.count("*").alias("count"), F.min("e.x").alias("low"), F.max("e.x").alias("high"))
    terms = [(f, s) for f, s in chosen if not _is_date(f, s) and not _is_range(f, s)]
    dates = [(f, s) for f, s in chosen if _is_date(f, s)]
    ranged = [(f, s) for f, s in chosen if _is_range(f, s)]
    if any(s.values for _, s in terms):
        wanted = _for([x for x in terms if x[1].values], lambda _, s: F.col("s").isin(list(s.values)))
        counts = counts.filter(F.coalesce(wanted, F.lit(True)))
    value, begins, ends = F.col("s"), F.lit(None).cast("string"), F.lit(None).cast("string")
    if dates:
        moment = lambda s: F.timestamp_millis("at").cast("timestamp_ntz") if _unit(s) in ("MINUTE", "HOUR") else _day(F.col("at"))
        value = F.coalesce(value, _for(dates, lambda _, s: F.date_format(moment(s), DATE_LABELS[_unit(s)])))
    if ranged:
        # Buckets lie on multiples of the width; the value at the last upper bound, alone in its bucket, is in none.
        # By text too, so that the many terms of other facets are not gathered.
        whole, width = Window.partitionBy("field", "s"), _for(ranged, lambda _, s: F.lit(float(s.interval)))
        counts = counts.withColumn("w", width).withColumn("first", F.min("at").over(whole)).withColumn("top", F.max("high").over(whole))
        n = F.greatest(F.lit(1), F.ceil((F.col("top") - F.col("first") * F.col("w")) / F.col("w")))
        n = F.when(n > MAX_RANGES, F.raise_error(F.lit(f"more than {MAX_RANGES} buckets; use a larger interval")).cast("long")).otherwise(n)
        counts = counts.filter(F.col("w").isNull() | (F.col("at") - F.col("first") < n))
        begin = F.col("at") * F.col("w")
        begins, ends = (_for(ranged, lambda f, _, v=v: _number(v, f.base == "DOUBLE")) for v in (begin, begin + F.col("w")))
        value = F.coalesce(value, F.concat(begins, F.lit("-"), ends))
    sign = {"COUNT_DESC": -1, "COUNT_ASC": 1}
    by_count = _for(terms, lambda _, s: F.col("count") * sign.get(s.sort, 0)) if terms else F.col("count") * 0
    down = _for([x for x in terms if x[1].sort == "VALUE_DESC"], lambda _, s: F.lit(True), False)
    number = F.coalesce(F.col("at").cast("double"), "low")
    order = [by_count.asc(), F.when(down, -number).otherwise(number).asc(), F.when(~down, F.col("s")).asc(), F.when(down, F.col("s")).desc()]
    return counts, order, [value.alias("value"), F.col("count"), begins.alias("from"), ends.alias("to")]


def facets(matched: DataFrame, schema: SearchSchema, specs) -> DataFrame:
    """``field, place, value, count, from, to`` of all facets; of two on one field the last counts."""
    chosen = [(check(schema, s), s) for s in {s.field: s for s in specs}.values()]
    counts, order, columns = _counted(matched, chosen)
    own = {s.field: MAX_RANGES if _is_range(f, s) else _first(s) for f, s in chosen}
    placed = counts.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(*order)))
    # The first bound, one number, cuts before the shuffle.
    best = placed.filter(F.col("place") <= max(own.values())).filter(F.col("place") <= _for(chosen, lambda _, s: F.lit(own[s.field])))
    return best.select("field", "place", *columns)


def facet(matched: DataFrame, schema: SearchSchema, spec: Facet) -> DataFrame:
    """``value, count, from, to`` of one facet, in order, by one top-k pass over its buckets."""
    f = check(schema, spec)
    counts, order, columns = _counted(matched, [(f, spec)])
    return counts.orderBy(*order).limit(MAX_RANGES if _is_range(f, spec) else _first(spec)).select(*columns)


def by_field(rows: list, specs) -> dict[str, list]:
    """Collected rows of ``facets`` as lists by field."""
    out: dict[str, list] = {s.field: [] for s in specs}
    for r in sorted(rows, key=lambda r: r["place"]):
        out[r["field"]].append(r)
    return out
