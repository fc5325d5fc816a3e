"""Documents into typed rows, and operations into the next version of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.schema import SearchSchema

UPDATE, DELETE = 0, 1
#: Seconds that a tier lives; 0 is for ever.
TIERS = {"WORKING": 300, "EPISODIC": 86_400, "SEMANTIC": 0}
#: An operation: what to do, with which JSON document, in which order.
OPERATION = T.StructType(
    [
        T.StructField("seq", T.LongType()), T.StructField("action", T.IntegerType()), T.StructField("document", T.StringType()),
        T.StructField("tenant", T.StringType()), T.StructField("tier", T.StringType()), T.StructField("ttl_seconds", T.LongType()),
        T.StructField("at_ms", T.LongType()),
    ]
)


def ttl_seconds(tier: Column, custom: Column) -> Column:
    by_tier = F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), F.coalesce(tier, F.lit("SEMANTIC")))
    return F.when(custom > 0, custom).otherwise(F.coalesce(by_tier.cast("long"), F.lit(0).cast("long")))


def _loose(kind: T.DataType) -> T.DataType:
    """JSON is read as text first, so that a boolean in a number's place still converts."""
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType):
        return T.ArrayType(T.StringType())
    return kind if isinstance(kind, (T.ArrayType, T.StructType)) else T.StringType()


def _coerce(raw: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType):
        return F.when(raw.isNotNull(), F.transform(raw, lambda x: _coerce(x, kind.elementType)))
    if isinstance(kind, T.BooleanType):
        return F.lower(raw).isin("true", "t", "1")
    if isinstance(kind, (T.IntegerType, T.LongType)):
        yes = F.when(raw == "true", "1").when(raw == "false", "0").otherwise(raw)
        return F.coalesce(yes.try_cast(kind), yes.try_cast("double").try_cast(kind))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return raw.try_cast(kind)
    return raw


def parse(ops: DataFrame, schema: SearchSchema) -> DataFrame:
    """Operations with typed columns, the raw JSON as ``_src``, and ``error``: null, or why the item is rejected."""
    struct = [x for x in schema.struct().fields if not x.name.startswith("_") or x.name in {f.name for f in schema.fields}]
    loose = T.StructType([T.StructField(x.name, _loose(x.dataType)) for x in struct])
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    # One row from each document's struct: a plain column of it would be parsed again for every field that is read.
    parsed = F.inline_outer(F.array(F.from_json("document", loose))).alias(*[f"__v{i}" for i in range(len(struct))])
    rows = ops.withColumn("__k", F.json_object_keys("document")).select("*", parsed)
    typed = {x.name: _coerce(F.col(f"__v{i}"), x.dataType) for i, x in enumerate(struct)}
    rows = rows.withColumns(typed).withColumn("_src", F.col("document"))
    unknown = F.array_except("__k", known)
    error = F.when(F.col("__k").isNull(), "Invalid JSON").when(F.col(schema.key).isNull(), "Missing key")
    error = error.when(F.col(schema.key) == "", "Empty key")
    error = error.when((F.col("action") == UPDATE) & (F.size(unknown) > 0), F.concat(F.lit("Unknown field: "), F.array_join(unknown, ", ")))
    for f in schema.fields:
        c = F.col(f.name)
        if f.type == "VECTOR":
            bad = c.isNotNull() & ((F.size(c) == 0) | F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            error = error.when(bad, f"Invalid vector: {f.name}")
            if f.dimension:
                error = error.when(c.isNotNull() & (F.size(c) != f.dimension), f"Vector {f.name} needs {f.dimension} numbers")
        elif f.type == "GEO_POINT":
            error = error.when(c.isNotNull() & (c["lat"].isNull() | c["lon"].isNull()), f"Geo point {f.name} needs lat and lon")
    return rows.withColumn("error", error).drop("__k", *[f"__v{i}" for i in range(len(struct))])


def whole_request_error(parsed: DataFrame) -> DataFrame:
    """The rows that reject a whole request: JSON that cannot be read, or a document without its key."""
    return parsed.filter(F.col("error").isin("Invalid JSON", "Missing key"))


def latest(parsed: DataFrame, schema: SearchSchema) -> DataFrame:
    """Of each key the last valid operation; the aggregate combines before it shuffles."""
    valid = parsed.filter("error is null")
    whole = F.struct(*valid.columns)
    return valid.groupBy(F.col(schema.key).alias("__key")).agg(F.max_by(whole, F.col("seq")).alias("o")).select("o.*")


def stamped(rows: DataFrame, schema: SearchSchema) -> DataFrame:
    """Document rows with the system columns, by the operation's own clock (a replay stamps the same)."""
    keep = [f.name for f in schema.fields]
    if not schema.ttl_enabled:
        return rows.select(*keep, "_src", F.col("seq").alias("_doc"))
    ttl = ttl_seconds(F.col("tier"), F.col("ttl_seconds"))
    return rows.select(
        *keep, F.coalesce("tier", F.lit("SEMANTIC")).alias("_memory_tier"), F.when(ttl > 0, F.col("at_ms") + ttl * 1000).otherwise(F.lit(0).cast("long")).alias("_ttl_expires_at"),
        F.col("at_ms").alias("_indexed_at"), F.col("tenant").alias("_tenant_id"), "_src", F.col("seq").alias("_doc"),
    )


def merge(current: DataFrame, parsed: DataFrame, schema: SearchSchema) -> DataFrame:
    """The rows after the operations: a key's rows that are older than its last operation leave, that update comes in.

    An operation that is older than the row it meets changes nothing.
    """
    key = schema.key
    # Numbers only: cheaper than the whole rows of the last operations, which are needed once.
    touched = parsed.filter("error is null").groupBy(F.col(key).alias("__key")).agg(F.max("seq").alias("__seq"))
    kept = current.join(touched, (current[key] == F.col("__key")) & (current["_doc"] < F.col("__seq")), "left_anti")
    known = current.select(F.col(key).alias("__key"), F.col("_doc").alias("__doc"))
    new = latest(parsed, schema).filter(F.col("action") == UPDATE)
    new = new.join(known, (new[key] == F.col("__key")) & (F.col("__doc") >= new["seq"]), "left_anti")
    return kept.unionByName(stamped(new, schema).select(*current.columns))


def delete_where(current: DataFrame, predicate: Column) -> DataFrame:
    return current.filter(~F.coalesce(predicate, F.lit(False)))


def _has_expired(now_ms: int) -> Column:
    at = F.coalesce(F.col("_ttl_expires_at"), F.lit(0))  # 0 is never
    return (at >= 1) & (at <= now_ms)


def expired(current: DataFrame, now_ms: int) -> DataFrame:
    return current.filter(_has_expired(now_ms))


def sweep(current: DataFrame, now_ms: int) -> DataFrame:
    """Without the rows that have expired."""
    return current.filter(~_has_expired(now_ms))


def upsert_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order, as a window (ties: any one)."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r")
