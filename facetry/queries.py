"""The query catalogue: one registered query for each operator over the standard tables, with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry import request as R
from facetry.functions import analysis
from facetry.operators import facets as facet_ops
from facetry.operators import paging, vector
from facetry.plans import search
from facetry.request import SearchRequest
from facetry.schema import Field, SearchSchema
from facetry.sources import ingest, postings
from facetry.sources.collection import NONE, Collection, Files, Registry
from facetry.streaming import upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The clock of all requests that need one.
NOW_MS = 1_706_745_600_000


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _key(name: str = "id") -> Field:
    return Field(name, "STRING", key=True, filterable=True, sortable=True)


def _all(name: str, kind: str, **more) -> Field:
    return Field(name, kind, **({"filterable": True, "sortable": True, "facetable": True} | more))


# ---- the tables as collections: a schema, the rows in Spark, and the same rows in SQL ----


_SCHEMAS: dict[tuple, object] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is looked up once for a session, as a catalog does."""
    key, path = (spark.sparkContext.applicationId, sf_dir, name), f"{sf_dir}/{name}.parquet"
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def _ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


PART = SearchSchema((_key(), _all("name", "STRING", searchable=True), _all("brand", "STRING"), _all("kind", "STRING", searchable=True), _all("size", "INT32"), _all("price", "DOUBLE"), _all("small", "BOOLEAN"), _all("note", "STRING"), _all("weight", "INT64")))
PART_SQL = """(SELECT p_partkey AS _doc, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size,
  p_retailprice AS price, p_size < 10 AS small, nullif(p_brand, 'Brand#11') AS note, CAST(nullif(p_size, 7) AS BIGINT) AS weight FROM part)"""


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "part")
    return t.select(
        F.col("p_partkey").alias("_doc"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_size") < 10).alias("small"),
        F.nullif("p_brand", F.lit("Brand#11")).alias("note"), F.nullif("p_size", F.lit(7)).cast("long").alias("weight"),
    )


ORDERS = SearchSchema((_key(), _all("customer", "INT64"), _all("status", "STRING"), _all("total", "DOUBLE"), _all("date", "DATE_TIME_OFFSET"), _all("priority", "STRING")))
ORDERS_SQL = """(SELECT o_orderkey AS _doc, CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS total,
  epoch_ms(o_orderdate) AS date, o_orderpriority AS priority FROM orders)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "orders")
    return t.select(
        F.col("o_orderkey").alias("_doc"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"), _ms("o_orderdate").alias("date"), F.col("o_orderpriority").alias("priority"),
    )


EVENTS = SearchSchema((_key(), _all("date", "DATE_TIME_OFFSET"), _all("user", "INT64"), _all("event", "STRING", searchable=True), _all("value", "DOUBLE"), Field("props", "STRING")), ttl_enabled=True)
EVENTS_SQL = """(SELECT event_id AS _doc, CAST(event_id AS VARCHAR) AS id, epoch_ms(ts) AS date, user_id AS "user", event_type AS event, value, props,
  epoch_ms(ts) AS _indexed_at, 'tenant' || CAST(user_id % 5 AS VARCHAR) AS _tenant_id FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "events")
    return t.select(
        F.col("event_id").alias("_doc"), F.col("event_id").cast("string").alias("id"), _ms("ts").alias("date"), F.col("user_id").alias("user"),
        F.col("event_type").alias("event"), "value", "props", _ms("ts").alias("_indexed_at"), F.concat(F.lit("tenant"), (F.col("user_id") % 5).cast("string")).alias("_tenant_id"),
    )


PLACES = SearchSchema((_key(), _all("segment", "STRING"), _all("place", "GEO_POINT", facetable=False)))
PLACES_SQL = """(SELECT c_custkey AS _doc, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, CAST((c_custkey * 37) % 180 - 90 AS DOUBLE) AS lat,
  CAST((c_custkey * 73) % 360 - 180 AS DOUBLE) AS lon FROM customer)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    point = F.struct(((k * 37) % 180 - 90).cast("double").alias("lat"), ((k * 73) % 360 - 180).cast("double").alias("lon"))
    return _read(spark, sf_dir, "customer").select(k.alias("_doc"), k.cast("string").alias("id"), F.col("c_mktsegment").alias("segment"), point.alias("place"))


TEXTS = SearchSchema((_key(), Field("text", "STRING", searchable=True), _all("lang", "STRING"), _all("source", "STRING"), _all("chars", "INT64")))
TEXTS_SQL = "(SELECT doc_id AS _doc, CAST(doc_id AS VARCHAR) AS id, text, lang, source, n_chars AS chars FROM documents)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "documents")
    return t.select(F.col("doc_id").alias("_doc"), F.col("doc_id").cast("string").alias("id"), "text", "lang", "source", F.col("n_chars").alias("chars"))


BASKETS = SearchSchema((_key(), _all("flags", "STRING_COLLECTION"), _all("quantities", "INT32_COLLECTION"), _all("prices", "DOUBLE_COLLECTION")))
BASKETS_SQL = """(SELECT l_orderkey AS _doc, CAST(l_orderkey AS VARCHAR) AS id, list(l_returnflag) AS flags, list(CAST(l_quantity AS INTEGER)) AS quantities,
  list(l_extendedprice) AS prices FROM lineitem GROUP BY l_orderkey)"""


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "lineitem")
    lists = [F.collect_list(F.col(c).cast(k)).alias(n) for c, k, n in (("l_returnflag", "string", "flags"), ("l_quantity", "int", "quantities"), ("l_extendedprice", "double", "prices"))]
    return t.groupBy(F.col("l_orderkey").alias("_doc")).agg(*lists).withColumn("id", F.col("_doc").cast("string"))


VECTORS = SearchSchema((_key(), Field("embedding", "VECTOR", dimension=64), _all("label", "INT32")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").alias("_doc"), F.col("vec_id").cast("string").alias("id"), "embedding", "label")


#: A fixed query vector by a rule, the same on both sides.
QUERY_VECTOR = tuple(((i * 7) % 13 - 6) / 10 for i in range(64))
_QV = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"


# ---- scratch folders and text indexes ----


def _scratch(spark: SparkSession) -> str:
    """A folder that all executors share; only a local master may go without one that the session names."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="facetry-")
    return f"{base}/facetry-{uuid.uuid4().hex}"


_INDEXES: dict[tuple, tuple[str, postings.TextIndex]] = {}


def text_index(spark: SparkSession, d: str, source, schema: SearchSchema) -> postings.TextIndex:
    """The persisted index of a table, built once for a session, as a collection builds it once for a version."""
    key = (spark.sparkContext.applicationId, d, source.__name__)
    if key not in _INDEXES or not Files(spark, _INDEXES[key][0]).exists(f"{_INDEXES[key][0]}/fields"):
        path = _scratch(spark)
        postings.write(source(spark, d), schema, path)
        _INDEXES[key] = path, postings.TextIndex.open(spark, [path])
    return _INDEXES[key][1]


# ---- filters, scans and counts ----


def _filtered(source, schema: SearchSchema, *filters, tenant: str = "") -> Query:
    """Ids of all rows that pass."""
    return lambda spark, d: search.matched_rows(source(spark, d), schema, SearchRequest(filters=filters, tenant_id=tenant)).select(F.col("_doc").alias("doc"), F.col("_score").alias("score"))


def _filter_sql(rows: str, where: str) -> str:
    return f"SELECT _doc AS doc, 1.0::DOUBLE AS score FROM {rows} WHERE {where}"


def _page(source, schema: SearchSchema, r: SearchRequest, *columns: str, digits: int = 6) -> Query:
    """One page: ids, rounded scores, and other columns of the rows."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        index = text_index(spark, d, source, schema) if r.has_text() else None
        rows = search.plan(source(spark, d), schema, r, index).rows
        return rows.select(F.col("_doc").alias("doc"), F.round("_score", digits).alias("score"), *columns)

    return query


_TERM, _RANGE = R.Term, R.Range
for _name, _schema, _source, _rows, _filters, _where in (
    ("filter_term_string", PART, part, PART_SQL, (_TERM("brand", "Brand#12"),), "brand = 'Brand#12'"),
    ("filter_term_int", PART, part, PART_SQL, (_TERM("size", "12"),), "size = 12"),
    ("filter_term_long", ORDERS, orders, ORDERS_SQL, (_TERM("customer", "37"),), "customer = 37"),
    ("filter_term_double", PART, part, PART_SQL, (_TERM("price", "950.5"),), "price = 950.5"),
    ("filter_term_bool", PART, part, PART_SQL, (_TERM("small", "T"),), "small"),
    ("filter_term_date", ORDERS, orders, ORDERS_SQL, (_TERM("date", "820454400000"),), "date = 820454400000"),
    ("filter_range_int_incl", PART, part, PART_SQL, (_RANGE("size", "10", "20"),), "size BETWEEN 10 AND 20"),
    ("filter_range_int_excl", PART, part, PART_SQL, (_RANGE("size", "10", "20", True, True),), "size > 10 AND size < 20"),
    ("filter_range_int_open", PART, part, PART_SQL, (_RANGE("size", "40"),), "size >= 40"),
    ("filter_range_int_empty", PART, part, PART_SQL, (_RANGE("size", "20", "10"),), "false"),
    ("filter_range_long_incl", ORDERS, orders, ORDERS_SQL, (_RANGE("customer", "5", "15"),), "customer BETWEEN 5 AND 15"),
    ("filter_range_long_excl", ORDERS, orders, ORDERS_SQL, (_RANGE("customer", "5", "15", True, True),), "customer > 5 AND customer < 15"),
    ("filter_range_double_incl", PART, part, PART_SQL, (_RANGE("price", "940", "960.25"),), "price BETWEEN 940 AND 960.25"),
    ("filter_range_double_excl", PART, part, PART_SQL, (_RANGE("price", "940", "960.25", True, True),), "price > 940 AND price < 960.25"),
    ("filter_range_double_open", PART, part, PART_SQL, (_RANGE("price", "", "950"),), "price <= 950"),
    ("filter_range_date", ORDERS, orders, ORDERS_SQL, (_RANGE("date", "820454400000", "852076800000", False, True),), "date >= 820454400000 AND date < 852076800000"),
    ("filter_implicit_and", PART, part, PART_SQL, (_TERM("small", "T"), _RANGE("price", "970")), "small AND price >= 970"),
    ("filter_compound_must", PART, part, PART_SQL, (R.Compound(must=(_TERM("small", "F"), _RANGE("price", "980"))),), "NOT small AND price >= 980"),
    ("filter_compound_should", PART, part, PART_SQL, (R.Compound(should=(_TERM("brand", "Brand#12"), _RANGE("size", "45"))),), "brand = 'Brand#12' OR size >= 45"),
    ("filter_compound_must_not", PART, part, PART_SQL, (R.Compound(must_not=(_TERM("note", "Brand#12"),)),), "note IS DISTINCT FROM 'Brand#12'"),
    ("filter_compound_nested", PART, part, PART_SQL, (R.Compound(must=(_RANGE("size", "5"),), should=(_TERM("small", "T"), R.Compound(must=(_RANGE("price", "960"),), must_not=(_TERM("note", "Brand#13"),)))),), "size >= 5 AND (small OR (price >= 960 AND note IS DISTINCT FROM 'Brand#13'))"),
    ("filter_exists", PART, part, PART_SQL, (R.Exists("note"),), "note IS NOT NULL"),
    ("filter_not_exists", PART, part, PART_SQL, (R.Exists("weight", False),), "weight IS NULL"),
    ("filter_collection_term", BASKETS, baskets, BASKETS_SQL, (_TERM("flags", "R"),), "list_contains(flags, 'R')"),
    ("filter_collection_range", BASKETS, baskets, BASKETS_SQL, (_RANGE("quantities", "48"),), "len(list_filter(quantities, lambda q: q >= 48)) > 0"),
    ("filtered_browse", ORDERS, orders, ORDERS_SQL, (_TERM("status", "F"),), "status = 'F'"),
):
    _add(_name, _filtered(_source, _schema, *_filters), _filter_sql(_rows, _where))

_add("tenant_scope", _filtered(events, EVENTS, R.Term("event", "click"), tenant="tenant2"), _filter_sql(EVENTS_SQL, "event = 'click' AND _tenant_id = 'tenant2'"))
_add("tenant_without_ttl", _filtered(part, PART, tenant="tenant2"), _filter_sql(PART_SQL, "false"))
_add("match_all_topk", _page(part, PART, SearchRequest(top_k=25)), f"SELECT _doc AS doc, 1.0::DOUBLE AS score FROM {PART_SQL} ORDER BY _doc LIMIT 25")
_add("count_filtered", lambda s, d: search.count(orders(s, d), ORDERS, (R.Term("status", "O"),)), f"SELECT count(*) AS count FROM {ORDERS_SQL} WHERE status = 'O'")
_add("lookup_keys", lambda s, d: search.lookup(part(s, d), PART, ["5", "17", "3", "none"]).select("id", "name"), f"SELECT id, name FROM {PART_SQL} WHERE id IN ('5', '17', '3', 'none')")

# ---- geo ----


def _haversine_sql(lat: float, lon: float) -> str:
    return f"2 * 6371008.7714 * asin(sqrt(least(1.0, pow(sin((radians({lat}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin((radians({lon}) - radians(lon)) / 2), 2))))"


_add("geo_distance", _filtered(places, PLACES, R.GeoDistance("place", 40.5, -74.25, 2_000_000)), _filter_sql(PLACES_SQL, f"{_haversine_sql(40.5, -74.25)} <= 2000000"))
_add("geo_bbox", _filtered(places, PLACES, R.GeoBox("place", 50.5, -20.5, 10.5, 60.5)), _filter_sql(PLACES_SQL, "lat BETWEEN 10.5 AND 50.5 AND lon BETWEEN -20.5 AND 60.5"))
_add("geo_bbox_dateline", _filtered(places, PLACES, R.GeoBox("place", 50.5, 150.5, -50.5, -150.5)), _filter_sql(PLACES_SQL, "lat BETWEEN -50.5 AND 50.5 AND (lon >= 150.5 OR lon <= -150.5)"))


def _geo_sort(spark: SparkSession, d: str) -> DataFrame:
    matched = search.matched_rows(places(spark, d), PLACES, SearchRequest())
    return paging.page(matched, PLACES, 20, 0, (R.Sort("place", geo_origin=(51.5, -0.125)),)).select(F.col("_doc").alias("doc"), F.round("_sort0", 3).alias("meters"))


_add("geo_sort", _geo_sort, f"SELECT _doc AS doc, round({_haversine_sql(51.5, -0.125)}, 3) AS meters FROM {PLACES_SQL} ORDER BY {_haversine_sql(51.5, -0.125)}, _doc LIMIT 20")

# ---- facets ----


def _facet(source, schema: SearchSchema, spec: R.Facet, *filters, columns=("value", "count")) -> Query:
    return lambda s, d: facet_ops.facet(search.matched_rows(source(s, d), schema, SearchRequest(filters=filters)), schema, spec).select(*columns)


def _terms_sql(rows: str, label: str, order: str, n: int = 10, where: str = "true") -> str:
    return f"SELECT {label} AS value, count(*) AS count FROM {rows} WHERE {where} GROUP BY 1 HAVING value IS NOT NULL ORDER BY {order} LIMIT {n}"


_BOOL, _DOUBLE = "CASE WHEN small THEN 'T' ELSE 'F' END", "CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END"
for _name, _spec, _sql in (
    ("facet_terms_string", R.Facet("brand"), _terms_sql(PART_SQL, "brand", "count DESC, value")),
    ("facet_terms_bool", R.Facet("small"), _terms_sql(PART_SQL, _BOOL, "count DESC, value")),
    ("facet_terms_int", R.Facet("size", 15), f"SELECT CAST(size AS VARCHAR) AS value, count(*) AS count FROM {PART_SQL} GROUP BY size ORDER BY count(*) DESC, size LIMIT 15"),
    ("facet_terms_double", R.Facet("price", 12, "VALUE_ASC"), _terms_sql(PART_SQL, _DOUBLE, "value", 12)),
    ("facet_order_count_asc", R.Facet("kind", 5, "COUNT_ASC"), _terms_sql(PART_SQL, "kind", "count, value", 5)),
    ("facet_order_value_asc", R.Facet("size", 5, "VALUE_ASC"), f"SELECT CAST(size AS VARCHAR) AS value, count(*) AS count FROM {PART_SQL} GROUP BY size ORDER BY size LIMIT 5"),
    ("facet_order_value_desc", R.Facet("size", 5, "VALUE_DESC"), f"SELECT CAST(size AS VARCHAR) AS value, count(*) AS count FROM {PART_SQL} GROUP BY size ORDER BY size DESC LIMIT 5"),
    ("facet_values", R.Facet("brand", values=("Brand#12", "Brand#23", "none")), _terms_sql(PART_SQL, "brand", "count DESC, value", 10, "brand IN ('Brand#12', 'Brand#23', 'none')")),
    ("facet_nulls", R.Facet("weight", 60, "VALUE_ASC"), f"SELECT CAST(weight AS VARCHAR) AS value, count(*) AS count FROM {PART_SQL} WHERE weight IS NOT NULL GROUP BY weight"),
):
    _add(_name, _facet(part, PART, _spec), _sql)

_add("facet_filtered", _facet(part, PART, R.Facet("brand", 5), R.Range("price", "960")), _terms_sql(PART_SQL, "brand", "count DESC, value", 5, "price >= 960"))
_add("facet_collection", _facet(baskets, BASKETS, R.Facet("flags")), f"SELECT f AS value, count(*) AS count FROM (SELECT unnest(list_distinct(flags)) AS f FROM {BASKETS_SQL}) GROUP BY f")
_add("facet_collection_numeric", _facet(baskets, BASKETS, R.Facet("quantities", 7)), f"SELECT CAST(q AS VARCHAR) AS value, count(*) AS count FROM (SELECT unnest(quantities) AS q FROM {BASKETS_SQL}) GROUP BY q ORDER BY count(*) DESC, q LIMIT 7")


def _range_sql(rows: str, c: str, width: int, text: str) -> str:
    return f"""WITH m AS (SELECT floor(min({c}) / {width}) * {width} AS s, greatest(1, ceil((max({c}) - floor(min({c}) / {width}) * {width}) / {width})) AS n FROM {rows}),
      i AS (SELECT s, CAST(floor(({c} - s) / {width}) AS BIGINT) AS i FROM {rows}, m WHERE {c} IS NOT NULL AND floor(({c} - s) / {width}) < n)
      SELECT {text.format("s + i * " + str(width))} || '-' || {text.format("s + i * " + str(width) + " + " + str(width))} AS value, count(*) AS count,
        {text.format("s + i * " + str(width))} AS "from", {text.format("s + i * " + str(width) + " + " + str(width))} AS "to" FROM i GROUP BY s, i"""


_ALL = ("value", "count", "from", "to")
_add("facet_range", _facet(part, PART, R.Facet("price", interval=10), columns=_ALL), _range_sql(PART_SQL, "price", 10, "CAST(CAST({} AS DOUBLE) AS VARCHAR)"))
_add("facet_range_boundary", _facet(part, PART, R.Facet("size", interval=10), columns=_ALL), _range_sql(PART_SQL, "size", 10, "CAST(CAST({} AS BIGINT) AS VARCHAR)"))
_SEVERAL = (R.Facet("brand", 5), R.Facet("size", 4, "VALUE_DESC"), R.Facet("price", interval=25), R.Facet("kind", 3, "COUNT_ASC"))
_add("facet_multi", lambda s, d: facet_ops.facets(part(s, d), PART, _SEVERAL).select("field", "value", "count"), f"""
    SELECT 'brand' AS field, * FROM ({_terms_sql(PART_SQL, "brand", "count DESC, value", 5)}) UNION ALL
    SELECT 'size', CAST(size AS VARCHAR), n FROM (SELECT size, count(*) AS n FROM {PART_SQL} GROUP BY size ORDER BY size DESC LIMIT 4) UNION ALL
    SELECT 'kind', * FROM ({_terms_sql(PART_SQL, "kind", "count, value", 3)}) UNION ALL
    SELECT 'price', value, count FROM ({_range_sql(PART_SQL, "price", 25, "CAST(CAST({} AS DOUBLE) AS VARCHAR)")})""")
for _unit, _format, _count in (("MINUTE", "%Y-%m-%dT%H:%MZ", 20), ("HOUR", "%Y-%m-%dT%H:%MZ", 30), ("DAY", "%Y-%m-%d", 0), ("MONTH", "%Y-%m", 0), ("YEAR", "%Y", 0)):
    _source, _schema, _rows = (events, EVENTS, EVENTS_SQL) if _unit in ("MINUTE", "HOUR", "DAY") else (orders, ORDERS, ORDERS_SQL)
    _add(
        f"facet_date_{_unit.lower()}", _facet(_source, _schema, R.Facet("date", _count, date_interval=_unit)),
        f"SELECT strftime(date_trunc('{_unit}', make_timestamp(date * 1000)), '{_format}') AS value, count(*) AS count FROM {_rows} GROUP BY 1 ORDER BY 1 LIMIT {_count or 10}",
    )

# ---- sorting and paging ----

_SORT = R.Sort
_add("sort_single", _page(orders, ORDERS, SearchRequest(sort=(_SORT("total", True),), top_k=20), "total"), f"SELECT _doc AS doc, 1.0::DOUBLE AS score, total FROM {ORDERS_SQL} ORDER BY total DESC, _doc LIMIT 20")
_add("sort_multi", _page(orders, ORDERS, SearchRequest(sort=(_SORT("priority"), _SORT("date", True)), top_k=20), "priority", "date"), f"SELECT _doc AS doc, 1.0::DOUBLE AS score, priority, date FROM {ORDERS_SQL} ORDER BY priority, date DESC, _doc LIMIT 20")
_add("sort_nulls", _page(part, PART, SearchRequest(sort=(_SORT("note"), _SORT("weight")), top_k=50), "note", "weight"), f"SELECT _doc AS doc, 1.0::DOUBLE AS score, note, weight FROM {PART_SQL} ORDER BY note NULLS FIRST, coalesce(weight, 0), _doc LIMIT 50")
_add("offset_page", _page(orders, ORDERS, SearchRequest(sort=(_SORT("total"),), top_k=15, offset=30), "total"), f"SELECT _doc AS doc, 1.0::DOUBLE AS score, total FROM {ORDERS_SQL} ORDER BY total, _doc LIMIT 15 OFFSET 30")
_add("search_after_score", _page(orders, ORDERS, SearchRequest(top_k=15, search_after=R.Cursor(1.0, 120))), f"SELECT _doc AS doc, 1.0::DOUBLE AS score FROM {ORDERS_SQL} WHERE _doc > 120 ORDER BY _doc LIMIT 15")
_add("search_after_sort", _page(orders, ORDERS, SearchRequest(top_k=15, sort=(_SORT("priority"), _SORT("total", True)), search_after=R.Cursor(1.0, 50, ("2-HIGH", "200000"))), "priority", "total"), f"SELECT _doc AS doc, 1.0::DOUBLE AS score, priority, total FROM {ORDERS_SQL} WHERE priority > '2-HIGH' OR (priority = '2-HIGH' AND (total < 200000 OR (total = 200000 AND _doc > 50))) ORDER BY priority, total DESC, _doc LIMIT 15")


def _projected(spark: SparkSession, d: str) -> DataFrame:
    p = search.plan(events(spark, d), EVENTS, SearchRequest(filters=(R.Term("event", "purchase"),), top_k=20, source_fields=("props", "value", "unknown")))
    source = F.from_json("source", "props string, value double")
    return p.page.select("doc_id", source["props"].alias("props"), F.round(source["value"], 6).alias("value"))


_add("project_source_fields", _projected, f"SELECT id AS doc_id, props, round(value, 6) AS value FROM {EVENTS_SQL} WHERE event = 'purchase' ORDER BY _doc LIMIT 20")

# ---- analysis ----


def _analysed(name: str) -> Query:
    """Counts of all tokens."""
    return lambda s, d: texts(s, d).select(F.explode(analysis.tokens(name, F.col("text"))).alias("token")).filter("token is not null").groupBy("token").agg(F.count("*").alias("n"))


_STANDARD = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+(?:[''’.][\p{{L}}\p{{N}}_]+)*')"
for _name, _expr in (("standard", _STANDARD.format("text")), ("simple", r"regexp_extract_all(lower(text), '\p{L}+')"), ("keyword", "[text]"), ("whitespace", r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')")):
    _add(f"analyze_{_name}", _analysed(_name), f"SELECT token, count(*) AS n FROM (SELECT unnest({_expr}) AS token FROM documents) GROUP BY token")
_add("analyze_language", _analysed("lucene.en"))

# ---- full text ----


def _bm25_sql(rows: str, columns: dict[str, str], terms: list[tuple[str, str]], match: str = "", where: str = "true", weights: dict[int, float] | None = None, limit: int = 10, score: str = "", extra: dict[str, str] | None = None) -> str:
    """Term frequencies by row, statistics, and the sum of BM25; ``tf0`` and so on are the terms in order."""
    tokens = ", ".join(f"{_STANDARD.format(c)} AS tk_{n}" for n, c in columns.items())
    tf = ", ".join(f"len(list_filter(tk_{f}, lambda t: t = '{t}')) AS tf{i}" for i, (f, t) in enumerate(terms))
    dl = ", ".join(f"coalesce(len(tk_{n}), 0) AS dl_{n}" for n in columns)
    more = "".join(f", {e} AS {n}" for n, e in (extra or {}).items())
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    st = ", ".join(f"count(*) FILTER (dl_{n} > 0) AS n_{n}, sum(dl_{n})::DOUBLE / count(*) FILTER (dl_{n} > 0) AS av_{n}" for n in columns)
    idf = lambda i: f"ln(1 + (n_{terms[i][0]} - df{i} + 0.5) / (df{i} + 0.5))"
    one = lambda i: f"{(weights or {}).get(i, 1.0)} * CASE WHEN tf{i} > 0 THEN {idf(i)} * tf{i} / (tf{i} + 1.2 * (0.25 + 0.75 * dl_{terms[i][0]} / av_{terms[i][0]})) ELSE 0 END"
    total = score.format(idf=[idf(i) for i in range(len(terms))]) if score else " + ".join(one(i) for i in range(len(terms)))
    match = match or " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""WITH d AS (SELECT *, {tokens} FROM {rows}), c AS (SELECT *, {tf}, {dl}{more} FROM d), s AS (SELECT {df}, {st} FROM c),
      r AS (SELECT _doc AS doc, {total} AS raw FROM c, s WHERE ({match}) AND ({where}))
      SELECT doc, round(raw, 6) AS score FROM r ORDER BY raw DESC, doc LIMIT {limit}"""


_TEXT = {"text": "text"}
_PARTS = {"name": "name", "kind": "kind"}
_add("bm25_single", _page(texts, TEXTS, SearchRequest(text_query="idiot")), _bm25_sql(TEXTS_SQL, _TEXT, [("text", "idiot")]))
_add("bm25_multi", _page(texts, TEXTS, SearchRequest(text_query=" Idiot trash  anon licensed")), _bm25_sql(TEXTS_SQL, _TEXT, [("text", t) for t in ("idiot", "trash", "anon", "licensed")]))
_add("bm25_multifield", _page(part, PART, SearchRequest(text_query="Ring small")), _bm25_sql(PART_SQL, _PARTS, [(f, t) for f in _PARTS for t in ("ring", "small")]))
_add("bm25_filtered", _page(texts, TEXTS, SearchRequest(text_query="trash clown", filters=(R.Term("lang", "en"),))), _bm25_sql(TEXTS_SQL, _TEXT, [("text", "trash"), ("text", "clown")], where="lang = 'en'"))
_add("min_score_page", _page(texts, TEXTS, SearchRequest(text_query="trash clown", top_k=30, min_score=2.0)), f"SELECT * FROM ({_bm25_sql(TEXTS_SQL, _TEXT, [('text', 'trash'), ('text', 'clown')], limit=30)}) WHERE score >= 2.0")
_add("prefix", _page(texts, TEXTS, SearchRequest(prefix_query="Disgu", top_k=50)), f"SELECT _doc AS doc, 1.0::DOUBLE AS score FROM {TEXTS_SQL} WHERE len(list_filter({_STANDARD.format('text')}, lambda t: starts_with(t, 'disgu'))) > 0 ORDER BY _doc LIMIT 50")


def _phrase_sql(terms: list[str], limit: int = 10) -> str:
    m = len(terms)
    here = " AND ".join(f"tk_text[i + {k}] = '{t}'" for k, t in enumerate(terms))
    freq = f"len(list_filter(range(1, len(tk_text) - {m - 2}), lambda i: {here}))"
    total = f"({' + '.join('{idf[%d]}' % i for i in range(m))}) * fr / (fr + 1.2 * (0.25 + 0.75 * dl_text / av_text))"
    return _bm25_sql(TEXTS_SQL, _TEXT, [("text", t) for t in terms], match="fr > 0", score=total, extra={"fr": freq}, limit=limit)


_add("phrase_exact", _page(texts, TEXTS, SearchRequest(phrase_query="All rights reserved")), _phrase_sql(["all", "rights", "reserved"]))
_add("phrase_slop", _page(texts, TEXTS, SearchRequest(phrase_query="licensed apache", phrase_slop=2)), _bm25_sql(
    TEXTS_SQL, _TEXT, [("text", "licensed"), ("text", "apache")], match="fr > 0", score="({idf[0]} + {idf[1]}) * fr / (fr + 1.2 * (0.25 + 0.75 * dl_text / av_text))",
    extra={"fr": "list_sum(list_transform(list_filter(range(1, len(tk_text) + 1), lambda i: tk_text[i] = 'licensed' AND list_contains(tk_text[i + 1 : i + 3], 'apache')), lambda i: 1.0 / list_position(tk_text[i + 1 : i + 3], 'apache')))"},
))


def _fuzzy(word: str, edits: int, prefix: int) -> tuple[Query, str]:
    r = SearchRequest(fuzzy_query=word, fuzzy_field="text", max_edits=edits, prefix_length=prefix, top_k=20)
    sql = f"""WITH d AS (SELECT _doc, {_STANDARD.format("text")} AS tk FROM {TEXTS_SQL}), st AS (SELECT count(*) FILTER (len(tk) > 0) AS n, sum(len(tk))::DOUBLE / count(*) FILTER (len(tk) > 0) AS av FROM d),
      p AS (SELECT _doc, dl, term, count(*) AS tf FROM (SELECT _doc, len(tk) AS dl, unnest(tk) AS term FROM d) GROUP BY ALL),
      x AS (SELECT term, count(*) AS df, damerau_levenshtein(term, '{word}') AS e FROM p WHERE starts_with(term, '{word[:prefix]}') AND abs(length(term) - {len(word)}) <= {edits} AND damerau_levenshtein(term, '{word}') <= {edits} GROUP BY term ORDER BY e, term LIMIT 50),
      r AS (SELECT _doc AS doc, sum((1 - e / least(length(term), {len(word)})::DOUBLE) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS raw FROM p JOIN x USING (term), st GROUP BY _doc)
      SELECT doc, round(raw, 6) AS score FROM r ORDER BY round(raw, 9) DESC, doc LIMIT 20"""
    return _page(texts, TEXTS, r), sql


_add("fuzzy1", *_fuzzy("idoit", 1, 0))
_add("fuzzy2", *_fuzzy("stupdi", 2, 0))
_add("fuzzy_prefix_len", *_fuzzy("worthlss", 2, 4))


def _qs(text: str, **more) -> Query:
    return _page(texts, TEXTS, SearchRequest(query_string=text, **({"top_k": 20} | more)))


def _qs_sql(terms: list[str], **more) -> str:
    return _bm25_sql(TEXTS_SQL, _TEXT, [("text", t) for t in terms], **({"limit": 20} | more))


_add("qs_or", _qs("idiot OR trash"), _qs_sql(["idiot", "trash"]))
_add("qs_and", _qs("idiot AND trash"), _qs_sql(["idiot", "trash"], match="tf0 > 0 AND tf1 > 0"))
_add("qs_not", _qs("idiot NOT trash"), _qs_sql(["idiot", "trash"], match="tf0 > 0 AND tf1 = 0"))
_add("qs_plus_minus", _qs("+idiot clown -trash"), _qs_sql(["idiot", "clown", "trash"], match="tf0 > 0 AND tf2 = 0"))
_add("qs_field", _page(part, PART, SearchRequest(query_string="kind:small AND name:ring", top_k=20)), _bm25_sql(PART_SQL, _PARTS, [("kind", "small"), ("name", "ring")], match="tf0 > 0 AND tf1 > 0", limit=20))
_add("qs_phrase", _qs('"all rights reserved"'), _phrase_sql(["all", "rights", "reserved"], 20))
_add("qs_wildcard", _qs("disgus?in*"), f"SELECT _doc AS doc, 1.0::DOUBLE AS score FROM {TEXTS_SQL} WHERE len(list_filter({_STANDARD.format('text')}, lambda t: regexp_full_match(t, 'disgus.in.*'))) > 0 ORDER BY _doc LIMIT 20")
_add("qs_fuzzy", _page(texts, TEXTS, SearchRequest(query_string="idoit~1", top_k=20)), _fuzzy("idoit", 1, 0)[1])
_add("qs_range", _page(part, PART, SearchRequest(query_string="price:[950 TO 951.5]", top_k=40)), f"SELECT _doc AS doc, 1.0::DOUBLE AS score FROM {PART_SQL} WHERE price BETWEEN 950 AND 951.5 ORDER BY _doc LIMIT 40")
_add("qs_term_range", _qs("[idio TO idiou}"), f"SELECT _doc AS doc, 1.0::DOUBLE AS score FROM {TEXTS_SQL} WHERE len(list_filter({_STANDARD.format('text')}, lambda t: t >= 'idio' AND t < 'idiou')) > 0 ORDER BY _doc LIMIT 20")
_add("qs_boost", _qs("idiot^2.5 OR trash"), _qs_sql(["idiot", "trash"], weights={0: 2.5}))
_add("qs_group", _qs("(idiot OR trash) AND clown"), _qs_sql(["idiot", "trash", "clown"], match="(tf0 > 0 OR tf1 > 0) AND tf2 > 0"))
_add("qs_regex", _qs("/disgust.*/"), f"SELECT _doc AS doc, 1.0::DOUBLE AS score FROM {TEXTS_SQL} WHERE len(list_filter({_STANDARD.format('text')}, lambda t: starts_with(t, 'disgust'))) > 0 ORDER BY _doc LIMIT 20")
_add("qs_all", _qs("*:* NOT trash", top_k=30), f"SELECT _doc AS doc, 1.0::DOUBLE AS score FROM {TEXTS_SQL} WHERE NOT list_contains({_STANDARD.format('text')}, 'trash') ORDER BY _doc LIMIT 30")


def _text_facet(spark: SparkSession, d: str) -> DataFrame:
    r = SearchRequest(text_query="idiot trash", filters=(R.Range("chars", "1000"),))
    matched = search.matched_rows(texts(spark, d), TEXTS, r, text_index(spark, d, texts, TEXTS))
    return facet_ops.facet(matched, TEXTS, R.Facet("source", 8)).select("value", "count")


_add("facet_text_filtered", _text_facet, _terms_sql(TEXTS_SQL, "source", "count DESC, value", 8, f"chars >= 1000 AND list_has_any({_STANDARD.format('text')}, ['idiot', 'trash'])"))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """Without an index: texts are tokenised for the query."""
    held: list[DataFrame] = []
    hits = search.matched_rows(texts(spark, d), TEXTS, SearchRequest(text_query="idiot trash"), held=held)
    return hits.orderBy(F.desc("_score"), "_doc").limit(10).select(F.col("_doc").alias("doc"), F.round("_score", 6).alias("score"))


_add("bm25_scan", _scanned, _bm25_sql(TEXTS_SQL, _TEXT, [("text", "idiot"), ("text", "trash")]))

# ---- vectors and hybrid ----

_E = "list_transform(embedding, lambda x: x::DOUBLE)"
_DOT = f"list_dot_product({_E}, {_QV})"
_SIMILARITY_SQL = {
    "COSINE": f"(1 + {_DOT} / (sqrt(list_dot_product({_E}, {_E})) * sqrt(list_dot_product({_QV}, {_QV})))) / 2", "DOT_PRODUCT": f"(1 + {_DOT}) / 2",
    "EUCLIDEAN": f"1 / (1 + pow(list_distance({_E}, {_QV}), 2))", "MAXIMUM_INNER_PRODUCT": f"CASE WHEN {_DOT} < 0 THEN 1 / (1 - {_DOT}) ELSE {_DOT} + 1 END",
}


def _knn(kind: str, k: int, where=None, top: int = 100) -> Query:
    schema = SearchSchema((_key(), Field("embedding", "VECTOR", dimension=64, similarity=kind), _all("label", "INT32")))
    r = SearchRequest(vector=R.Vector("embedding", QUERY_VECTOR, k), filters=(where,) if where else (), top_k=top)
    return _page(vectors, schema, r)


def _knn_sql(kind: str, k: int, where: str = "true") -> str:
    return f"SELECT vec_id AS doc, round({_SIMILARITY_SQL[kind]}, 6) AS score FROM embeddings WHERE {where} ORDER BY {_SIMILARITY_SQL[kind]} DESC, vec_id LIMIT {k}"


for _name, _kind in (("cosine", "COSINE"), ("dot", "DOT_PRODUCT"), ("l2", "EUCLIDEAN"), ("mip", "MAXIMUM_INNER_PRODUCT")):
    _add(f"knn_{_name}", _knn(_kind, 10), _knn_sql(_kind, 10))
_add("knn_filtered", _knn("COSINE", 10, R.Range("label", "3", "5")), _knn_sql("COSINE", 10, "label BETWEEN 3 AND 5"))
_add("knn_k_lt_topk", _knn("COSINE", 4, top=50), _knn_sql("COSINE", 4))
def vector_index(spark: SparkSession, d: str) -> vector.VectorIndex:
    """The persisted lists of the embeddings, built once for a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LISTS or not Files(spark, _LISTS[key][0]).exists(_LISTS[key][0]):
        path = f"{_scratch(spark)}/lists"
        _LISTS[key] = path, vector.VectorIndex.build(vectors(spark, d), VECTORS, "embedding", path)
    return _LISTS[key][1]


_LISTS: dict[tuple, tuple[str, vector.VectorIndex]] = {}


_add("knn_index_all_lists", lambda s, d: vector_index(s, d).knn(QUERY_VECTOR, 10, probe=1 << 30).select(F.col("_doc").alias("doc"), F.round("_score", 6).alias("score")), _knn_sql("COSINE", 10))
_add("knn_index", lambda s, d: vector_index(s, d).knn(QUERY_VECTOR, 10).select(F.col("_doc").alias("doc"), F.round("_score", 6).alias("score")))

MIXED = SearchSchema((*TEXTS.fields, Field("embedding", "VECTOR", dimension=64)))


def mixed(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).join(vectors(spark, d).select("_doc", "embedding"), "_doc", "left")


def _hybrid(*filters) -> Query:
    r = SearchRequest(text_query="idiot trash", text_field="text", vector=R.Vector("embedding", QUERY_VECTOR), filters=filters, top_k=20)
    return lambda s, d: search.plan(mixed(s, d), MIXED, r, text_index(s, d, texts, TEXTS)).page.select(F.col("_doc").alias("doc"), F.round("_score", 8).alias("score"))


def _hybrid_sql(where: str = "true") -> str:
    by_text = _bm25_sql(TEXTS_SQL, _TEXT, [("text", "idiot"), ("text", "trash")], where=where, limit=20)
    ids = f"SELECT _doc FROM {TEXTS_SQL} WHERE {where}"
    return f"""WITH t AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS r FROM ({by_text})),
      v AS (SELECT doc, row_number() OVER (ORDER BY s DESC, doc) AS r FROM (SELECT vec_id AS doc, {_SIMILARITY_SQL["COSINE"]} AS s FROM embeddings WHERE vec_id IN ({ids}) ORDER BY s DESC, doc LIMIT 20)),
      f AS (SELECT doc, sum(1 / (60.0 + r)) AS raw FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY doc)
      SELECT doc, round(raw, 8) AS score FROM f ORDER BY raw DESC, doc LIMIT 20"""


_add("hybrid_rrf", _hybrid(), _hybrid_sql())
_add("hybrid_rrf_filtered", _hybrid(R.Term("lang", "en")), _hybrid_sql("lang = 'en'"))
_add("recency_decay", _page(events, EVENTS, SearchRequest(half_life_seconds=86_400, now_ms=NOW_MS, top_k=25, filters=(R.Term("event", "purchase"),)), digits=9), f"SELECT _doc AS doc, round(exp(-ln(2) / 86400000 * greatest(0, {NOW_MS} - _indexed_at)), 9) AS score FROM {EVENTS_SQL} WHERE event = 'purchase' ORDER BY exp(-ln(2) / 86400000 * greatest(0, {NOW_MS} - _indexed_at)) DESC, _doc LIMIT 25")

# ---- writes ----

USERS = SearchSchema((_key(), _all("event", "STRING"), _all("value", "DOUBLE")), ttl_enabled=True)
_LAST = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)"


def _ops(spark: SparkSession, d: str) -> DataFrame:
    """Events as operations on their users: errors delete, all else replaces; every third is short-lived."""
    doc = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("event"), "value"))
    tier = F.when(F.col("event_id") % 3 == 0, "WORKING").otherwise("SEMANTIC")
    return _read(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", ingest.DELETE).otherwise(ingest.UPDATE).alias("action"), doc.alias("document"),
        F.lit("t").alias("tenant"), tier.alias("tier"), F.lit(0).cast("long").alias("ttl_seconds"), _ms("ts").alias("at_ms"),
    )


def _none(spark: SparkSession, schema: SearchSchema) -> DataFrame:
    return spark.createDataFrame([], Collection.struct(schema))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return ingest.merge(_none(spark, USERS), ingest.parse(_ops(spark, d), USERS), USERS)




def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "event", F.round("value", 6).alias("value"), F.col("_doc").alias("doc"))


_UPSERT_SQL = f"SELECT CAST(user_id AS VARCHAR) AS id, event_type AS event, round(value, 6) AS value, event_id AS doc FROM {_LAST} WHERE r = 1 AND event_type <> 'error'"
_add("upsert_latest", lambda s, d: _shown(_merged(s, d)), _UPSERT_SQL)
_add("delete_key", lambda s, d: _shown(ingest.merge(_merged(s, d), ingest.parse(s.createDataFrame([(10**9, ingest.DELETE, '{"id": "7"}', None, None, 0, NOW_MS)], ingest.OPERATION), USERS), USERS)), _UPSERT_SQL + " AND user_id <> 7")
_add("delete_by_query", lambda s, d: ingest.delete_where(part(s, d), search.combine(PART, (R.Term("note", "Brand#12"), R.Range("size", "10")))).select("id"), f"SELECT id FROM {PART_SQL} WHERE NOT coalesce(note = 'Brand#12' AND size >= 10, false)")
_add("ttl_sweep", lambda s, d: _shown(ingest.sweep(_merged(s, d), NOW_MS)), f"SELECT CAST(user_id AS VARCHAR) AS id, event_type AS event, round(value, 6) AS value, event_id AS doc FROM {_LAST} WHERE r = 1 AND event_type <> 'error' AND (event_id % 3 <> 0 OR epoch_ms(ts) + 300000 > {NOW_MS})")
_add("upsert_window", lambda s, d: ingest.upsert_rows(_read(s, d, "events"), "user_id", "event_id").select("user_id", F.col("event_id").alias("doc")), f"SELECT user_id, event_id AS doc FROM {_LAST} WHERE r = 1")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    root = _scratch(spark)
    users = Collection.create(spark, f"{root}/users", USERS)
    for k in range(3):
        upsert.append_operations(spark, f"{root}/ops", _ops(spark, d).filter(F.pmod(F.col("seq"), F.lit(3)) == k))
    upsert.merge_batches(upsert.read_operations(spark, f"{root}/ops"), users, f"{root}/checkpoint").awaitTermination()
    users.refresh()
    return _shown(users.df)


_add("stream_upsert", _streamed, _UPSERT_SQL)


def _late(spark: SparkSession, d: str) -> DataFrame:
    """The log's files come in the wrong order, one in each batch: the later operation of a key still wins."""
    root = _scratch(spark)
    users = Collection.create(spark, f"{root}/users", USERS)
    ops = _ops(spark, d)
    first, second = ops.agg(F.percentile_approx("seq", [1 / 3, 2 / 3])).first()[0] or (0, 0)  # bounds of three parts, in bounded memory
    third = F.when(F.col("seq") > second, 3).when(F.col("seq") > first, 2).otherwise(1)
    for k in (3, 1, 2):
        upsert.append_operations(spark, f"{root}/ops", ops.filter(third == k))
    upsert.merge_batches(upsert.read_operations(spark, f"{root}/ops", 1), users, f"{root}/checkpoint").awaitTermination()
    users.refresh()
    return _shown(users.df)


_add("stream_out_of_order", _late, _UPSERT_SQL)


def _compacted(spark: SparkSession, d: str) -> DataFrame:
    c = Collection.create(spark, f"{_scratch(spark)}/users", USERS)
    merged = _merged(spark, d).select(*c.df.columns)
    for k in range(2):
        c.load(merged.filter(F.pmod(F.col("_doc"), F.lit(2)) == k), 10**6)
    c.compact()
    return _shown(c.df)


_add("compaction", _compacted, _UPSERT_SQL)


# ---- ingest of all types, bulk statuses, life of a collection ----

GOODS = SearchSchema(
    (
        _key(), _all("small", "BOOLEAN"), _all("size", "INT32"), _all("big", "INT64"), _all("price", "DOUBLE"), _all("made", "DATE_TIME_OFFSET"),
        Field("place", "GEO_POINT", filterable=True, sortable=True), Field("shape", "VECTOR", dimension=2), _all("words", "STRING_COLLECTION", searchable=True),
        _all("numbers", "INT32_COLLECTION"), _all("flags", "BOOLEAN_COLLECTION"),
    ),
    ttl_enabled=True,
)


def _goods_ops(spark: SparkSession, d: str) -> DataFrame:
    """Parts as JSON documents; every seventh has its numbers as texts, every eleventh lacks most fields."""
    k, size = F.col("p_partkey"), F.col("p_size")
    loose = lambda c, text: F.when(k % 7 == 0, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    full = F.concat(
        F.lit('{"id": "'), k.cast("string"), F.lit('", "small": '), F.when(size < 10, F.when(k % 2 == 0, "true").otherwise('"1"')).otherwise("false"),
        F.lit(', "size": '), loose(size, size.cast("string")), F.lit(', "big": '), loose(k, (k * 1000003).cast("string")),
        F.lit(', "price": '), loose(k, size.cast("string")), F.lit(', "made": '), (k * 86_400_000).cast("string"), F.lit(', "place": {"lat": '), (k % 90).cast("string"),
        F.lit(', "lon": '), (-(k % 180)).cast("string"), F.lit('}, "shape": ['), size.cast("string"), F.lit(", 0.5], "), F.lit('"words": ["'), F.col("p_brand"), F.lit('", "'),
        F.col("p_type"), F.lit('"], "numbers": [1, "2", '), size.cast("string"), F.lit('], "flags": [true, false]}'),
    )
    document = F.when(k % 11 == 0, F.concat(F.lit('{"id": "'), k.cast("string"), F.lit('"}'))).otherwise(full)
    tier = F.when(k % 3 == 0, "WORKING").when(k % 3 == 1, "EPISODIC")
    return _read(spark, d, "part").select(
        k.alias("seq"), F.lit(ingest.UPDATE).alias("action"), document.alias("document"), F.lit("t").alias("tenant"), tier.alias("tier"),
        F.when(k % 5 == 0, 60).otherwise(0).cast("long").alias("ttl_seconds"), F.lit(NOW_MS).alias("at_ms"),
    )


def _typed(spark: SparkSession, d: str) -> DataFrame:
    parsed = ingest.stamped(ingest.parse(_goods_ops(spark, d), GOODS), GOODS)
    shown = parsed.select(
        "id", "small", "size", "big", "price", "made", F.col("place.lat").alias("lat"), F.col("place.lon").alias("lon"), F.col("shape")[0].cast("double").alias("x"),
        F.array_join("words", "|").alias("words"), F.expr("aggregate(numbers, 0, (a, x) -> a + x)").alias("total"), F.col("flags")[0].alias("flag"),
        F.col("_memory_tier").alias("tier"), F.col("_ttl_expires_at").alias("expires"), F.col("_tenant_id").alias("tenant"),
    )
    return shown.select(*[F.col(c).cast("string").alias(c) for c in shown.columns])


_FULL = "CASE WHEN p_partkey % 11 <> 0 THEN {} END"
_add("ingest_types", _typed, f"""SELECT COLUMNS(*)::VARCHAR FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, {_FULL.format("p_size < 10")} AS small, {_FULL.format("p_size")} AS size,
  {_FULL.format("p_partkey * 1000003")} AS big, {_FULL.format("p_size::DOUBLE")} AS price, {_FULL.format("p_partkey * 86400000")} AS made,
  {_FULL.format("(p_partkey % 90)::DOUBLE")} AS lat, {_FULL.format("(-(p_partkey % 180))::DOUBLE")} AS lon, {_FULL.format("p_size::DOUBLE")} AS x,
  {_FULL.format("p_brand || '|' || p_type")} AS words, {_FULL.format("3 + p_size")} AS total, {_FULL.format("true")} AS flag,
  CASE p_partkey % 3 WHEN 0 THEN 'WORKING' WHEN 1 THEN 'EPISODIC' ELSE 'SEMANTIC' END AS tier,
  CASE WHEN p_partkey % 5 = 0 THEN {NOW_MS} + 60000 WHEN p_partkey % 3 = 0 THEN {NOW_MS} + 300000 WHEN p_partkey % 3 = 1 THEN {NOW_MS} + 86400000 ELSE 0 END AS expires,
  't' AS tenant FROM part)""")


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    document = (
        F.when(k % 6 == 0, F.lit('{"id": ""}')).when(k % 6 == 1, F.lit("{no json")).when(k % 6 == 2, F.lit('{"size": 1}'))
        .when(k % 6 == 3, F.concat(F.lit('{"id": "'), k.cast("string"), F.lit('", "other": 1}'))).when(k % 6 == 4, F.concat(F.lit('{"id": "'), k.cast("string"), F.lit('", "shape": [1]}')))
        .otherwise(F.concat(F.lit('{"id": "'), k.cast("string"), F.lit('"}')))
    )
    ops = _goods_ops(spark, d).join(_read(spark, d, "part").select(k.alias("seq"), document.alias("odd")), "seq").withColumn("document", F.col("odd")).drop("odd")
    return ingest.parse(ops, GOODS).select("seq", "error")


_add("bulk_statuses", _statuses, """SELECT p_partkey AS seq, CASE p_partkey % 6 WHEN 0 THEN 'Empty key' WHEN 1 THEN 'Invalid JSON' WHEN 2 THEN 'Missing key'
  WHEN 3 THEN 'Unknown field: other' WHEN 4 THEN 'Vector shape needs 2 numbers' END AS error FROM part""")


def _goods(spark: SparkSession, d: str) -> Collection:
    c = Collection.create(spark, f"{_scratch(spark)}/goods", GOODS)
    c.apply(_goods_ops(spark, d), 10**6, report=False)
    return c


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """The stored JSON as it came, of all rows that match: a page would end at its 10,000th."""
    r = SearchRequest(filters=(R.Range("size", "45"),), include_source=True)
    return search.project(search.matched_rows(_goods(spark, d).df, GOODS, r), GOODS, r).select("doc_id", "source")


_add("include_source", lambda s, d: _sources(s, d).withColumn("source", F.regexp_replace("source", " ", "")), """SELECT CAST(p_partkey AS VARCHAR) AS doc_id,
  '{"id":"' || p_partkey || '","small":false,"size":' || n || ',"big":' || CASE WHEN p_partkey % 7 = 0 THEN '"' || p_partkey * 1000003 || '"' ELSE (p_partkey * 1000003)::VARCHAR END
  || ',"price":' || n || ',"made":' || p_partkey * 86400000 || ',"place":{"lat":' || p_partkey % 90 || ',"lon":' || -(p_partkey % 180) || '},"shape":[' || p_size || ',0.5],"words":["'
  || replace(p_brand, ' ', '') || '","' || replace(p_type, ' ', '') || '"],"numbers":[1,"2",' || p_size || '],"flags":[true,false]}' AS source
  FROM (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN '"' || p_size || '"' ELSE p_size::VARCHAR END AS n FROM part) WHERE p_size >= 45 AND p_partkey % 11 <> 0""")


def _schema_swapped(spark: SparkSession, d: str) -> DataFrame:
    """The schema loses and gains fields; the documents are projected anew, and another handle sees it."""
    c = _goods(spark, d)
    kept = SearchSchema((_key(), _all("size", "INT64"), _all("price", "STRING"), Field("words", "STRING_COLLECTION", searchable=True)), ttl_enabled=True)
    c.update_schema(kept)
    shown = Collection.open(spark, c.root).df.select("id", "size", "price", F.size("words").alias("n_words"), F.col("_tenant_id").alias("tenant"))
    return shown.select(*[F.col(x).cast("string").alias(x) for x in shown.columns])


_add("schema_update", _schema_swapped, f"""SELECT COLUMNS(*)::VARCHAR FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, {_FULL.format("p_size::BIGINT")} AS size, {_FULL.format("p_size::VARCHAR")} AS price,
  {_FULL.format("2")} AS n_words, 't' AS tenant FROM part)""")


def _collection_search(spark: SparkSession, d: str) -> DataFrame:
    """Two writers' batches, a deletion by query, expiry, and a merge; then a text search by the collection's own index."""
    c, ops = _goods(spark, d), _goods_ops(spark, d)
    Collection.open(spark, c.root).apply(ops.filter("seq % 4 = 0").withColumn("document", F.concat(F.lit('{"id": "'), F.col("seq").cast("string"), F.lit('", "words": ["steel again"]}'))).withColumn("seq", F.col("seq") + 10**6), 3 * 10**6, report=False)
    c.refresh()
    c.delete_by_query((R.Range("size", "30", "35"),))
    c.sweep(NOW_MS + 100_000)
    c.compact()
    hits = search.matched_rows(c.df, GOODS, SearchRequest(text_query="again 12"), c.text_index())
    return hits.select("id", (F.col("_score") > 0).alias("found"))


_add("collection_search", _collection_search, """SELECT CAST(p_partkey AS VARCHAR) AS id, true AS found FROM part WHERE p_partkey % 5 <> 0 AND
  (p_partkey % 4 = 0 OR (p_partkey % 11 <> 0 AND p_size NOT BETWEEN 30 AND 35 AND regexp_matches(lower(p_brand || ' ' || p_type), '\\b12\\b')))""")


def _with_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Facets and the total are of all matches, whatever the page; the result is a request's, collected."""
    r = SearchRequest(filters=(R.Range("size", "5"),), facets=(R.Facet("brand", 5), R.Facet("small")), top_k=7, sort=(R.Sort("size"),), search_after=R.Cursor(1.0, 50, ("20",)))
    found = search.run(part(spark, d), PART, r)
    rows = [(f, x["value"], x["count"]) for f, each in found.facets.items() for x in each]
    return spark.createDataFrame([*rows, ("total", "", found.total), ("hits", str(found.hits[-1]["_doc"]) if found.hits else "", len(found.hits))], "field string, value string, count long")


_add("facets_with_cursor", _with_cursor, f"""WITH h AS (SELECT _doc FROM {PART_SQL} WHERE size >= 5 AND (size > 20 OR (size = 20 AND _doc > 50)) ORDER BY size, _doc LIMIT 7),
  l AS (SELECT arg_max(_doc, r) AS _doc, count(*) AS n FROM (SELECT _doc, row_number() OVER () AS r FROM h))
  SELECT 'brand' AS field, * FROM ({_terms_sql(PART_SQL, "brand", "count DESC, value", 5, "size >= 5")}) UNION ALL
  SELECT 'small', * FROM ({_terms_sql(PART_SQL, _BOOL, "count DESC, value", 10, "size >= 5")}) UNION ALL
  SELECT 'total', '', count(*) FROM {PART_SQL} WHERE size >= 5 UNION ALL SELECT 'hits', coalesce(_doc::VARCHAR, ''), n FROM l""")


def _restarted(spark: SparkSession, d: str) -> DataFrame:
    """A stream that is stopped between two parts of the log and started again, with a line that is no JSON."""
    root = _scratch(spark)
    users = Collection.create(spark, f"{root}/users", USERS)
    for k in range(2):
        upsert.append_operations(spark, f"{root}/ops", _ops(spark, d).filter(F.pmod(F.col("seq"), F.lit(2)) == k))
        spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(f"{root}/ops")
        upsert.merge_batches(upsert.read_operations(spark, f"{root}/ops"), users, f"{root}/checkpoint").awaitTermination()
    return _shown(Collection.open(spark, users.root).df)


_add("stream_restart", _restarted, _UPSERT_SQL)
_add("hybrid_ignores_sort", lambda s, d: search.plan(mixed(s, d), MIXED, SearchRequest(text_query="idiot trash", text_field="text", vector=R.Vector("embedding", QUERY_VECTOR), sort=(R.Sort("chars"),), search_after=R.Cursor(0.5, 7, (3,)), top_k=20), text_index(s, d, texts, TEXTS)).page.select(F.col("_doc").alias("doc"), F.round("_score", 8).alias("score")), _hybrid_sql())
_add("text_recency", _page(events, EVENTS, SearchRequest(text_query="click purchase", half_life_seconds=86_400, now_ms=NOW_MS, top_k=30), digits=9), f"""
  SELECT doc, round(raw * exp(-ln(2) / 86400000 * greatest(0, {NOW_MS} - _indexed_at)), 9) AS score FROM
  ({_bm25_sql(EVENTS_SQL, {"event": "event"}, [("event", "click"), ("event", "purchase")], limit=10**9).replace("round(raw, 6) AS score", "raw")}) AS b JOIN {EVENTS_SQL} AS e ON e._doc = b.doc
  ORDER BY raw * exp(-ln(2) / 86400000 * greatest(0, {NOW_MS} - _indexed_at)) DESC, doc LIMIT 30""")


# ---- rules of requests and collections ----

_add("filter_operator_ignored", _filtered(part, PART, R.Compound(must=(_TERM("small", "T"), _RANGE("price", "970")), operator="OR")), _filter_sql(PART_SQL, "small AND price >= 970"))
_add("hybrid_text_weight", lambda s, d: search.plan(mixed(s, d), MIXED, SearchRequest(text_query="idiot trash", text_field="text", text_weight=0.9, vector=R.Vector("embedding", QUERY_VECTOR), top_k=20), text_index(s, d, texts, TEXTS)).page.select(F.col("_doc").alias("doc"), F.round("_score", 8).alias("score")), _hybrid_sql())
_PREFIXED = f"(SELECT _doc AS doc, 1.0 AS score FROM {TEXTS_SQL} WHERE len(list_filter({_STANDARD.format('text')}, lambda t: starts_with(t, 'disgu'))) > 0 ORDER BY _doc LIMIT 20)"
_add("hybrid_prefix", lambda s, d: search.plan(mixed(s, d), MIXED, SearchRequest(prefix_query="Disgu", vector=R.Vector("embedding", QUERY_VECTOR), top_k=20), text_index(s, d, texts, TEXTS)).page.select(F.col("_doc").alias("doc"), F.round("_score", 8).alias("score")), f"""
    WITH t AS (SELECT doc, row_number() OVER (ORDER BY doc) AS r FROM {_PREFIXED}),
      v AS (SELECT doc, row_number() OVER (ORDER BY s DESC, doc) AS r FROM (SELECT vec_id AS doc, {_SIMILARITY_SQL["COSINE"]} AS s FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY s DESC, doc LIMIT 20)),
      f AS (SELECT doc, sum(1 / (60.0 + r)) AS raw FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY doc)
      SELECT doc, round(raw, 8) AS score FROM f ORDER BY raw DESC, doc LIMIT 20""")

BY_FIELD = SearchSchema((_key(), Field("name", "STRING", searchable=True, index_analyzer="whitespace", search_analyzer="whitespace"), Field("kind", "STRING", searchable=True, index_analyzer="keyword", search_analyzer="keyword")))


def _by_field(spark: SparkSession, d: str) -> DataFrame:
    """Each field has its own analyzer; only the query string analyses the query's words, the text query lower-cases them."""
    rows = part(spark, d).select("_doc", "id", "name", "kind")
    found = lambda **r: search.matched_rows(rows, BY_FIELD, SearchRequest(**r)).select("_doc")
    parts = {"query string": found(query_string="kind:STANDARD AND name:ring"), "text": found(text_query="STANDARD", text_field="kind"), "whole value": found(query_string='name:"small ring"')}
    each = [df.select(F.lit(k).alias("how"), F.col("_doc").alias("doc")) for k, df in parts.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


_add("analyzer_per_field", _by_field, f"""SELECT 'query string' AS how, _doc AS doc FROM {PART_SQL} WHERE kind = 'STANDARD' AND list_contains(string_split(name, ' '), 'ring')
  UNION ALL SELECT 'whole value', _doc FROM {PART_SQL} WHERE name LIKE 'small ring' OR name LIKE 'small ring %' OR name LIKE '% small ring' OR name LIKE '% small ring %'""")


def _top_rules(spark: SparkSession, d: str) -> DataFrame:
    pages = [search.plan(orders(spark, d), ORDERS, SearchRequest(top_k=k)).page.agg(F.lit(k).cast("long").alias("asked"), F.count("*").alias("n")) for k in (-1, 0, 7, 20_000)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


_add("top_k_rules", _top_rules, "SELECT asked::BIGINT AS asked, least(most, (SELECT count(*) FROM orders)) AS n FROM (VALUES (-1, 10), (0, 10), (7, 7), (20000, 10000)) AS v(asked, most)")


def _visible(spark: SparkSession, d: str) -> DataFrame:
    """What a reader sees after writes that do and do not refresh it."""
    c, seen = _goods(spark, d), []
    seen.append(("written", c.count()))
    c.apply(_goods_ops(spark, d).withColumn("document", F.concat(F.lit('{"id": "new'), F.col("seq").cast("string"), F.lit('"}'))).withColumn("seq", F.col("seq") + 2 * 10**6), 4 * 10**6, refresh=NONE, report=False)
    seen.append(("not refreshed", c.count()))
    c.refresh()
    seen.append(("refreshed", c.count()))
    return spark.createDataFrame(seen, "what string, n long")


_add("refresh_policy", _visible, "SELECT * FROM (VALUES ('written', 1), ('not refreshed', 1), ('refreshed', 2)) AS v(what, k) JOIN (SELECT count(*) AS c FROM part) ON true".replace("SELECT *", "SELECT what, k * c AS n"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    """A registry's collections: created, closed, opened again with their rows, and names that are refused."""
    registry, found = Registry(spark, _scratch(spark)), []
    for name in ("parts", "default", "other"):
        registry.create(name, GOODS.to_json())
    registry.get("parts").apply(_goods_ops(spark, d), 10**6, report=False)
    registry.close("parts")
    found += [(f"open after closing: {n}", 0) for n in registry.list()]
    found.append(("rows of parts", registry.open("parts").count()))
    for name in ("", "a b", "x" * 65, "parts"):
        try:
            registry.create(name, GOODS.to_json())
        except ValueError:
            found.append((f"refused: {name[:3]}", len(name)))
    return spark.createDataFrame(found, "what string, n long")


_add("registry", _names, """SELECT 'rows of parts' AS what, count(*) AS n FROM part UNION ALL
  SELECT * FROM (VALUES ('open after closing: default', 0), ('open after closing: other', 0), ('refused: ', 0), ('refused: a b', 3), ('refused: xxx', 65), ('refused: par', 5)) AS v""")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """BM25 with a term filter, ten best."""
    return QUERIES["bm25_filtered"](spark, d)
