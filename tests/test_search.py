"""Search behaviour on small hand-written collections."""

import json
import math

import pytest
from pyspark.sql import functions as F

from facetry import request as R
from facetry.operators import facets, modifiers, paging, text
from facetry.operators.query_string import parse
from facetry.plans import search
from facetry.request import SearchRequest as Q
from facetry.schema import Field, SearchSchema
from facetry.sources import ingest, postings

NOW = 1_646_500_000_000


def field(name, kind, flags="", **more):
    return Field(name, kind, key="K" in flags, searchable="S" in flags, filterable="F" in flags, sortable="O" in flags, facetable="A" in flags, **more)


#: A seed bank's plants.
SCHEMA = SearchSchema(
    (
        field("id", "STRING", "KF"), field("name", "STRING", "SFO"), field("notes", "STRING", "S"), field("family", "STRING", "FA"), field("hardy", "BOOLEAN", "FOA"),
        field("height", "DOUBLE", "FOA"), field("seeds", "INT32", "FOA"), field("drawer", "INT64", "FO"), field("sown", "DATE_TIME_OFFSET", "FOA"),
        field("shape", "VECTOR", dimension=4),
    ),
    ttl_enabled=True,
)
ROWS = [
    ("p1", "Harbour Thistle", "spiny perennial that tolerates salt wind", "aster", True, 1.2, 340, 11, 1609459200000, [1, 0, 0, 0], "north"),
    ("p2", "Marsh Mallow Root", "soft roots grow in salt marsh meadows", "mallow", True, 0.9, 60, 12, 1612137600000, [0, 1, 0, 0], "north"),
    ("p3", "Desert Lantern", "opens after rain and sleeps through drought", "cactus", False, 0.25, 15, 13, 1614556800000, [0, 0, 1, 0], "south"),
    ("p4", "Climbing Lantern Vine", "perennial vine with paper lantern pods", "nightshade", True, 3.5, 220, 14, 1617235200000, [0.8, 0.6, 0, 0], "south"),
    ("p5", "Salt Meadow Rush", "wind bent rush of the salt meadow edge", "rush", True, 0.6, 900, 15, 1640995200000, [0, 0.6, 0.8, 0], "north"),
    ("p6", "Dwarf Marsh Orchid", "pale orchid that waits years for rain", "orchid", False, 0.3, 5000, 16, 1643673600000, [0, 0, 0, 1], "south"),
    ("p7", "Thistle of the Dunes", "perennial thistle of open dunes", "aster", True, 0.75, 410, 17, 1646092800000, [0.6, 0, 0, 0.8], "north"),
]


def collection(spark, schema, documents, tenants=None, at=None):
    ops = [(i, 0, json.dumps(d), (tenants or {}).get(d["id"]), None, 0, (at or {}).get(d["id"], NOW)) for i, d in enumerate(documents)]
    parsed = ingest.parse(spark.createDataFrame(ops, ingest.OPERATION), schema)
    assert parsed.filter("error is not null").count() == 0
    return spark.createDataFrame(ingest.stamped(parsed, schema).collect(), ingest.stamped(parsed, schema).schema).coalesce(1).cache()


@pytest.fixture(scope="module")
def docs(spark):
    names = [f.name for f in SCHEMA.fields]
    return collection(spark, SCHEMA, [dict(zip(names, r[:10], strict=True)) for r in ROWS], {r[0]: r[10] for r in ROWS})


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    postings.write(docs, SCHEMA, path, parts=3)
    return postings.TextIndex.open(spark, [path])


def ids(docs, schema=SCHEMA, index=None, **request):
    return [h["doc_id"] for h in search.plan(docs, schema, Q(**request), index).page.collect()]


def test_filters(docs):
    assert ids(docs, filters=(R.Term("hardy", "F"),)) == ["p3", "p6"]
    assert ids(docs, filters=(R.Range("height", "5", "1"),)) == []
    assert ids(docs, filters=(R.Range("seeds", "60", "410", True),)) == ["p1", "p4", "p7"]
    assert ids(docs, filters=(R.Term("family", "aster"), R.Range("height", "", "1"))) == ["p7"]
    assert ids(docs, filters=(R.Compound(must_not=(R.Term("family", "aster"),)),)) == ["p2", "p3", "p4", "p5", "p6"]
    assert ids(docs, filters=(R.Compound(should=(R.Term("id", "p1"), R.Compound(must=(R.Range("height", "3"),)))),)) == ["p1", "p4"]
    assert ids(docs, filters=(R.Exists("height"),)) == [r[0] for r in ROWS]
    assert ids(docs, filters=(R.Exists("height", False),)) == []
    assert ids(docs, tenant_id="south") == ["p3", "p4", "p6"]
    assert search.count(docs, SCHEMA, (R.Term("hardy", "T"),), "north").first()[0] == 4


@pytest.mark.parametrize(
    "bad",
    [R.Term("notes", "x"), R.Term("none", "x"), R.Term("seeds", "many"), R.Range("name", "a"), R.Exists("family"), R.Compound(), R.GeoDistance("height", 0, 0, 1)],
)
def test_bad_filters(docs, bad):
    with pytest.raises(ValueError):
        search.plan(docs, SCHEMA, Q(filters=(bad,)))


def test_missing_values_and_must_not(spark):
    schema = SearchSchema((field("id", "STRING", "KF"), field("tag", "STRING", "FO"), field("depth", "DOUBLE", "FO"), field("tags", "STRING_COLLECTION", "FA")))
    rows = collection(spark, schema, [{"id": "u", "tag": "x", "depth": 1.0, "tags": ["p", "p", "q"]}, {"id": "v"}, {"id": "w", "tag": "y", "depth": -5.0, "tags": ["q"]}])
    assert ids(rows, schema, filters=(R.Compound(must_not=(R.Term("tag", "x"),)),)) == ["v", "w"]
    assert ids(rows, schema, filters=(R.Exists("tag", False),)) == ["v"]
    assert ids(rows, schema, filters=(R.Term("tags", "p"),)) == ["u"]
    assert ids(rows, schema, sort=(R.Sort("depth"),)) == ["w", "v", "u"]  # a missing number is 0
    assert ids(rows, schema, sort=(R.Sort("tag", True),)) == ["w", "u", "v"]
    got = facets.facet(rows, schema, R.Facet("tags")).collect()
    assert [(r["value"], r["count"]) for r in got] == [("q", 2), ("p", 1)]  # once for each row
    assert ids(rows, schema, tenant_id="t") == []  # no expiry, no tenants


@pytest.fixture(params=["scan", "index"])
def how(request, index):
    return index if request.param == "index" else None


def test_text(docs, how):
    found = lambda **request: ids(docs, index=how, **request)
    assert found(text_query=" SALT  wind ", text_field="notes") == ["p1", "p5", "p2"]
    assert set(found(text_query="lantern")) == {"p3", "p4"}
    assert found(text_query="lantern", filters=(R.Term("id", "p4"),)) == ["p4"]
    assert found(phrase_query="marsh mallow", phrase_field="name") == ["p2"]
    assert found(phrase_query="mallow marsh", phrase_field="name") == []
    assert found(phrase_query="salt edge", phrase_field="notes", phrase_slop=2) == ["p5"]
    assert found(phrase_query="salt edge", phrase_field="notes") == []
    assert found(prefix_query="Dun") == ["p7"]
    assert found(fuzzy_query="orchd", fuzzy_field="name", max_edits=1) == ["p6"]
    assert found(fuzzy_query="lantren", fuzzy_field="name", max_edits=1) == ["p3", "p4"]  # a swap is one edit
    assert found(fuzzy_query="zzzzzz", max_edits=1) == [] and found(text_query="nowhere") == []
    for bad in ({"phrase_query": "x", "phrase_slop": -1}, {"phrase_query": "  "}, {"fuzzy_query": " "}, {"text_query": "x", "text_field": "none"}):
        with pytest.raises(ValueError):
            search.plan(docs, SCHEMA, Q(**bad), how)


def test_bm25_value(docs, how):
    hit = search.plan(docs, SCHEMA, Q(text_query="orchid", text_field="name"), how).page.first()
    assert math.isclose(hit["_score"], text.python_bm25(1, 3, 7, 1, 20 / 7), rel_tol=1e-9)


QUERY_STRINGS = {
    "thist* OR orch*": {"p1", "p7", "p6"}, "notes:perennial NOT notes:vine": {"p1", "p7"}, 'name:"salt meadow"': ["p5"], "height:[0.5 TO 0.9]": ["p2", "p5", "p7"],
    "seeds:{60 TO 220]": ["p4"], "(lantern OR mallow) AND vine": ["p4"], "orchd~1 rush^3": ["p5", "p6"], "/lan.ern/": ["p3", "p4"],
    "*:* NOT lantern": ["p1", "p2", "p5", "p6", "p7"], "marsh AND seeds:[1000 TO *]": ["p6"], "[dv TO ev]": ["p6"], "+thistle -dunes": ["p1"], "OR-ange NOT thistle": [],
}


@pytest.mark.parametrize("query", list(QUERY_STRINGS))
def test_query_string(docs, how, query):
    got, expected = ids(docs, index=how, query_string=query, default_field="name"), QUERY_STRINGS[query]
    assert got == expected if isinstance(expected, list) else set(got) == expected


def test_bad_query_strings():
    for bad in ("AND OR NOT", "*x", '"open', "(a", "a)", "none:x", "a AND"):
        with pytest.raises(ValueError):
            parse(SCHEMA, bad)


def test_index_reads_the_terms_only(docs, index):
    plan = search.plan(docs, SCHEMA, Q(text_query="salt", text_field="notes"), index).matched._jdf.queryExecution().toString()
    assert "EqualTo(term,salt)" in plan and "notes#" not in plan.split("== Physical Plan ==")[1]
    prefix = search.plan(docs, SCHEMA, Q(prefix_query="dun"), index).matched._jdf.queryExecution().toString()
    assert "StringStartsWith(term,dun)" in prefix


def test_vectors_and_hybrid(docs, how):
    near = R.Vector("shape", (1.0, 0.0, 0.0, 0.0), 2)
    assert ids(docs, vector=near) == ["p1", "p4"]
    assert ids(docs, vector=near, top_k=5) == ["p1", "p4"]
    assert ids(docs, vector=near, filters=(R.Term("family", "aster"),)) == ["p1", "p7"]
    assert ids(docs, vector=near, tenant_id="south") == ["p4", "p3"]
    hits = search.plan(docs, SCHEMA, Q(vector=R.Vector("shape", (1.0, 0.0, 0.0, 0.0)), text_query="perennial"), how).page.collect()
    assert [h["doc_id"] for h in hits[:3]] == ["p1", "p7", "p4"]
    assert math.isclose(hits[0]["_score"], 1 / 61 + 1 / 62)
    with pytest.raises(ValueError):
        search.plan(docs, SCHEMA, Q(vector=near, text_query="perennial", facets=(R.Facet("family"),)))
    with pytest.raises(ValueError):
        search.plan(docs, SCHEMA, Q(vector=R.Vector("shape", (1.0,))))
    # a sort and a cursor are left aside in hybrid search
    same = search.plan(docs, SCHEMA, Q(vector=R.Vector("shape", (1.0, 0.0, 0.0, 0.0)), text_query="perennial", sort=(R.Sort("seeds"),), search_after=R.Cursor(0.1, 3)), how)
    assert same.page.collect() == hits


@pytest.mark.parametrize("sort", [(R.Sort("seeds"),), (R.Sort("name", True),), (R.Sort("height"),), (R.Sort("hardy"), R.Sort("drawer", True)), ()])
def test_cursor_pages_join_up(docs, sort):
    everything, seen, after = ids(docs, sort=sort), [], None
    for _ in range(3):
        page = search.plan(docs, SCHEMA, Q(sort=sort, top_k=3, search_after=after))
        rows = page.page.collect()
        seen += [r["doc_id"] for r in rows]
        after = paging.cursor(rows, page.n_sort)
    assert seen == everything and len(seen) == len(ROWS)


def test_text_cursor_pages_join_up(docs, how):
    everything, seen, after = ids(docs, index=how, text_query="salt perennial rain"), [], None
    for _ in range(4):
        rows = search.plan(docs, SCHEMA, Q(text_query="salt perennial rain", top_k=2, search_after=after), how).page.collect()
        seen += [r["doc_id"] for r in rows]
        after = paging.cursor(rows, 0) or after
    assert seen == everything and len(seen) == 7


def test_paging_rules(docs):
    assert len(ids(docs, top_k=0)) == 7 and ids(docs, top_k=2, offset=3) == ["p4", "p5"] and ids(docs, offset=-1)[0] == "p1"
    assert ids(docs, min_score=0.5) == [r[0] for r in ROWS] and ids(docs, min_score=1.5) == []
    with pytest.raises(ValueError):
        ids(docs, offset=10_001)
    for bad in (R.Sort("family"), R.Sort("none"), R.Sort("shape")):
        with pytest.raises(ValueError):
            ids(docs, sort=(bad,))


def test_recency(spark):
    schema = SearchSchema((field("id", "STRING", "KF"), field("title", "STRING", "S")), ttl_enabled=True)
    at = {"old": NOW - 72_000_000, "mid": NOW - 7_200_000, "new": NOW - 60_000}
    rows = collection(spark, schema, [{"id": k, "title": "equal words"} for k in at], at=at)
    assert ids(rows, schema, text_query="words", half_life_seconds=7200, now_ms=NOW) == ["new", "mid", "old"]
    score = {h["doc_id"]: h["_score"] for h in search.plan(rows, schema, Q(half_life_seconds=7200, now_ms=NOW)).page.collect()}
    assert math.isclose(score["mid"], 0.5)


def test_modifiers_run_in_order(docs):
    twice = lambda df: df.withColumn("_score", F.col("_score") * 2)
    more = lambda df: df.withColumn("_score", F.col("_score") + 1)
    scored = docs.withColumn("_score", F.lit(1.0))
    assert modifiers.pipeline(scored, [twice, more]).first()["_score"] == 3 and modifiers.pipeline(scored, [more, twice]).first()["_score"] == 4


def test_geo(spark):
    schema = SearchSchema((field("id", "STRING", "KF"), field("place", "GEO_POINT", "FO")))
    points = {"reykjavik": (64.1466, -21.9426), "lisbon": (38.7223, -9.1393), "auckland": (-36.8509, 174.7645), "suva": (-18.1248, 178.4501), "apia": (-13.8333, -171.7667)}
    rows = collection(spark, schema, [{"id": k, "place": {"lat": a, "lon": b}} for k, (a, b) in points.items()])
    assert ids(rows, schema, filters=(R.GeoDistance("place", 38.7, -9.1, 50_000),)) == ["lisbon"]
    assert ids(rows, schema, filters=(R.GeoDistance("place", 38.7, -9.1, 4_000_000),)) == ["reykjavik", "lisbon"]
    assert ids(rows, schema, sort=(R.Sort("place", geo_origin=(-20.0, 179.0)),))[0] == "suva"
    assert set(ids(rows, schema, filters=(R.GeoBox("place", 0, 170, -40, -170),))) == {"auckland", "suva", "apia"}  # across the date line
    for bad in (R.Sort("place"), R.Sort("place", True, (0.0, 0.0)), R.Sort("place", geo_origin=(91.0, 0.0))):
        with pytest.raises(ValueError):
            ids(rows, schema, sort=(bad,))
    for bad in (R.GeoBox("place", 0, 0, 10, 10), R.GeoDistance("place", 0, 0, -1)):
        with pytest.raises(ValueError):
            ids(rows, schema, filters=(bad,))


def rows_of(df):
    return [(r["value"], r["count"]) for r in df.collect()]


def test_facets(docs):
    facet = lambda *a, **k: rows_of(facets.facet(docs, SCHEMA, R.Facet(*a, **k)))
    assert facet("family") == [("aster", 2), ("cactus", 1), ("mallow", 1), ("nightshade", 1), ("orchid", 1), ("rush", 1)]
    assert facet("family", 2, "VALUE_ASC") == [("aster", 2), ("cactus", 1)] and facet("family", 1, "VALUE_DESC") == [("rush", 1)]
    assert facet("hardy") == [("T", 5), ("F", 2)]
    assert facet("seeds", 2, "VALUE_DESC") == [("5000", 1), ("900", 1)]
    # 5000, the last upper bound, is in no bucket
    assert facet("seeds", interval=1000) == [("0-1000", 6)]
    assert facet("height", interval=1) == [("0.0-1.0", 5), ("1.0-2.0", 1), ("3.0-4.0", 1)]
    assert facet("sown", date_interval="YEAR") == [("2021", 4), ("2022", 3)]
    assert facet("sown", 1, date_interval="HOUR") == [("2021-01-01T00:00Z", 1)]
    assert facet("family", values=("rush",)) == [("rush", 1)]
    for bad in (R.Facet("none"), R.Facet("drawer"), R.Facet("seeds", interval=1, values=("1",)), R.Facet("family", sort="UP")):
        with pytest.raises(ValueError):
            facets.facet(docs, SCHEMA, bad)
    with pytest.raises(Exception, match="buckets"):
        facets.facet(docs, SCHEMA, R.Facet("seeds", interval=0.01)).collect()


def test_several_facets_at_once_equal_each(docs):
    specs = [R.Facet("family", 2, "VALUE_DESC"), R.Facet("hardy", sort="COUNT_ASC"), R.Facet("seeds", interval=500), R.Facet("height", interval=2), R.Facet("sown", 3, date_interval="MONTH")]
    found = facets.by_field(facets.facets(docs, SCHEMA, specs).collect(), specs)
    for s in specs:
        assert [(r["value"], r["count"], r["from"], r["to"]) for r in found[s.field]] == [tuple(r) for r in facets.facet(docs, SCHEMA, s).collect()]
    last = facets.facets(docs, SCHEMA, [R.Facet("family", 1), R.Facet("family", 3)])
    assert last.count() == 3
    assert facets.by_field(facets.facets(docs.filter("id is null"), SCHEMA, specs).collect(), specs) == {s.field: [] for s in specs}


def test_run_gives_one_result(docs, how):
    persistent = docs.sparkSession.sparkContext._jsc.getPersistentRDDs
    before = len(persistent())
    result = search.run(docs, SCHEMA, Q(text_query="perennial", facets=(R.Facet("family"), R.Facet("hardy")), source_fields=("name", "none"), top_k=1), index=how)
    assert result.total == 3 and len(result.hits) == 1 and result.next.doc == result.hits[0]["_doc"]
    assert [(r["value"], r["count"]) for r in result.facets["family"]] == [("aster", 2), ("nightshade", 1)]
    assert [(r["value"], r["count"]) for r in result.facets["hardy"]] == [("T", 3)]
    assert json.loads(result.hits[0]["source"]).keys() == {"name"}
    assert len(persistent()) <= before  # what was kept for the request is released


def test_facets_do_not_follow_the_cursor(docs):
    first = search.run(docs, SCHEMA, Q(facets=(R.Facet("family"),), top_k=3))
    second = search.run(docs, SCHEMA, Q(facets=(R.Facet("family"),), top_k=3, search_after=first.next))
    assert [h["doc_id"] for h in second.hits] == ["p4", "p5", "p6"] and second.facets == first.facets and second.total == first.total == 7


def test_whole_source(docs):
    hit = search.run(docs, SCHEMA, Q(filters=(R.Term("id", "p3"),), include_source=True)).hits[0]
    assert json.loads(hit["source"])["notes"] == ROWS[2][2]


def test_source_fields_keep_what_the_document_holds(spark):
    schema = SearchSchema((field("id", "STRING", "KF"), field("place", "GEO_POINT", "F"), field("size", "DOUBLE", "F"), field("a b", "STRING")))
    ops = [(0, 0, '{"id": "x", "place": {"lat": 1, "lon": 2, "note": "by hand"}, "size": "12.50", "a b": "é"}', None, None, 0, NOW), (1, 0, '{"id": "y"}', None, None, 0, NOW)]
    rows = ingest.stamped(ingest.parse(spark.createDataFrame(ops, ingest.OPERATION), schema), schema)
    got = search.plan(rows, schema, Q(source_fields=("place", "size", "a b", "none"))).page.collect()
    assert json.loads(got[0]["source"]) == {"place": {"lat": 1, "lon": 2, "note": "by hand"}, "size": "12.50", "a b": "é"} and got[1]["source"] == "{}"
    assert search.plan(rows, schema, Q(source_fields=("none",))).page.first()["source"] == "{}"


def test_a_late_search_says_so(spark, docs):
    from pyspark.sql import types as T

    slow = F.udf(lambda x: __import__("time").sleep(20) or x, T.StringType())
    result = search.run(docs.withColumn("name", slow("name")), SCHEMA, Q(sort=(R.Sort("name"),), timeout_ms=400))
    assert result.timed_out and result.hits == [] and not result.exact


def test_edit_distance_and_sloppy_phrase():
    assert [text.edit_distance(a, b, 2) for a, b in (("abc", "acb"), ("ca", "abc"), ("a", "a"), ("kitten", "sitting"))] == [1, 3, 0, 3]
    assert text.sloppy_frequency([[0], [2]], 1) == 0.5
    assert text.sloppy_frequency([[0], [2]], 0) == 0.0
    assert text.sloppy_frequency([[1], [0]], 2) == 1 / 3
    assert [text.literal_beginning(p) for p in ("mach.*", "a*b", "ab?c", "x|y", "ab{2}", ".*")] == ["mach", "", "a", "", "a", ""]
