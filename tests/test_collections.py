"""Schemas, writing, versions, the registry and streaming."""

import json
import threading

import pyarrow as pa
import pytest

from facetry import request as R
from facetry.functions import analysis, stemming
from facetry.operators import text
from facetry.request import SearchRequest
from facetry.schema import Field, SearchSchema
from facetry.sources import collection as C
from facetry.sources import ingest, postings
from facetry.streaming import upsert

NOW = 1_700_000_000_000
SCHEMA = SearchSchema((Field("id", "STRING", key=True, filterable=True), Field("title", "STRING", searchable=True), Field("n", "INT32", filterable=True), Field("v", "VECTOR", dimension=2)), ttl_enabled=True)


def doc(key, **more):
    return json.dumps({"id": key} | more)


def test_schema_rules():
    again = SearchSchema.from_json(SCHEMA.to_json())
    assert again == SCHEMA and again.struct()["n"].metadata["filterable"]
    for bad in ([], [Field("a", "STRING", key=True), Field("b", "STRING", key=True)], [Field("a", "INT32", key=True)], [Field("a", "STRING", key=True), Field("b", "THING")]):
        with pytest.raises(ValueError):
            SearchSchema(tuple(bad))
    assert SearchSchema.from_json('{"fields": [{"name": "id", "type": "STRING", "key": true}, {"name": "v", "type": "VECTOR", "dimensions": 4}]}').get("v").dimension == 4


def test_life_of_a_collection(spark, tmp_path):
    registry = C.Registry(spark, str(tmp_path))
    c = registry.create("books", SCHEMA.to_json())
    errors = c.index([{"document": doc("a", title="one")}, {"document": doc("b", n=True)}, {"document": doc("a", title="two", n="7")}, {"document": doc("", n=1)}, {"document": doc("x", other=1)}, {"document": doc("y", v=[1.0])}], NOW)
    assert [bool(e) for e in errors] == [False, False, False, True, True, True]
    assert {r["id"]: (r["title"], r["n"]) for r in c.df.collect()} == {"a": ("two", 7), "b": (None, 1)}
    for bad in ("{", '{"title": "no key"}'):
        with pytest.raises(ValueError):
            c.index([{"document": doc("z")}, {"document": bad}], NOW)
    assert c.count() == 2 and c.lookup(["a", "none"]) == [doc("a", title="two", n="7")] and c.lookup([]) == []
    c.index([{"document": doc("b"), "action": ingest.DELETE}, {"document": doc("none"), "action": ingest.DELETE}, {"document": doc("c", n=3), "tier": "WORKING", "tenant": "t"}], NOW)
    assert sorted(r["id"] for r in c.df.collect()) == ["a", "c"] and c.count(tenant="t") == 1
    pinned = c.df
    assert c.sweep(NOW + 299_000) == 0 and c.sweep(NOW + 300_000) == 1
    assert pinned.count() == 2 and c.count() == 1  # the old version stays as it was
    c.index([{"document": doc("d", n=i)} for i in range(3)], NOW, refresh=C.NONE)
    assert c.count() == 1
    c.refresh()
    assert c.count((R.Term("n", "2"),)) == 1
    assert c.delete_by_query((R.Range("n", "2"),)) == 2
    with pytest.raises(ValueError):
        c.delete_by_query((), "t")
    c.index([{"document": doc(str(i), title="Machine words")} for i in range(6)], NOW)
    assert c.search(SearchRequest(text_query="machine", top_k=2)).total == 6
    assert c.compact()[1] == 1 and c.health()["doc_count"] == 6 and c.health()["segment_count"] == 1
    assert c.search(SearchRequest(text_query="machine", top_k=2)).total == 6
    wider = SearchSchema((*SCHEMA.fields, Field("extra", "INT64", filterable=True)), ttl_enabled=True)
    c.update_schema(wider)
    c.index([{"document": doc("w", extra=5)}], NOW)
    registry.close("books")
    again = registry.open("books", mode=C.READ)
    assert again.schema == wider and again.count((R.Term("extra", "5"),)) == 1 and registry.list() == ["books"]
    with pytest.raises(RuntimeError):
        again.index([{"document": doc("q")}], NOW)
    assert again.vacuum() == []  # others may still read what is younger than an hour
    assert again.vacuum(retain_ms=0) and again.count() == again.df.count() > 0
    for bad in ("", "a b", "x" * 65, "books"):
        with pytest.raises(ValueError):
            registry.create(bad, SCHEMA.to_json())
    with pytest.raises(RuntimeError):
        registry.create("other", '{"fields": []}')
    with pytest.raises(ValueError):
        registry.get("missing")


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    users = C.Collection.create(spark, f"{tmp_path}/users", SCHEMA)
    ops = [(i, ingest.DELETE if i % 7 == 0 else ingest.UPDATE, doc(str(i % 5), n=i), None, None, 0, NOW) for i in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, ingest.OPERATION)
    for part in (ops[:15], ops[15:]):
        upsert.append_operations(spark, f"{tmp_path}/ops", frame(part))
        upsert.merge_batches(upsert.read_operations(spark, f"{tmp_path}/ops", 1), users, f"{tmp_path}/cp").awaitTermination()
    (tmp_path / "ops" / "broken.json").write_text("{not json\n")
    upsert.merge_batches(upsert.read_operations(spark, f"{tmp_path}/ops"), users, f"{tmp_path}/cp").awaitTermination()
    users.refresh()
    last = {}
    for _, action, document, *_ in ops:
        d = json.loads(document)
        last[d["id"]] = None if action == ingest.DELETE else d["n"]
    assert {r["id"]: r["n"] for r in users.df.collect()} == {k: v for k, v in last.items() if v is not None}


def test_analyzers(spark):
    one = spark.createDataFrame([("The Quick-brown fox's 3.5 URLs, naïve_x",)], "t string")
    got = {n: one.select(analysis.tokens(n, one["t"])).first()[0] for n in ("standard", "simple", "keyword", "whitespace", "lucene.en")}
    assert got["standard"] == ["the", "quick", "brown", "fox's", "3.5", "urls", "naïve_x"]
    assert got["simple"] == ["the", "quick", "brown", "fox", "s", "urls", "naïve", "x"]
    assert got["keyword"] == ["The Quick-brown fox's 3.5 URLs, naïve_x"] and got["whitespace"][1] == "Quick-brown"
    assert "the" not in got["lucene.en"] and "url" in got["lucene.en"]
    assert got["lucene.en"][0] is None  # a stop word holds its place
    assert analysis.query_tokens("lucene.cjk", "東京都") == ["東京", "京都"] and len(analysis.names()) == 42
    with pytest.raises(ValueError):
        analysis.tokens("lucene.ja", one["t"])


def test_stemmers(spark):
    pairs = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam triplicate:triplic electrical:electr hopefulness:hope revival:reviv adjustment:adjust adoption:adopt probate:probat rate:rate controll:control roll:roll generalizations:gener"
    for word, expected in (x.split(":") for x in pairs.split()):
        assert stemming.stem(word, "en") == expected
    alike = {"de": "häusern hausern", "fr": "nationalement nationale", "es": "rápidamente rápida", "ru": "книгами книга", "sv": "flickorna flickor", "fi": "talossa talosta", "el": "θάλασσες θάλασσα", "pt": "canções canção"}
    for code, words in alike.items():
        one, other = (stemming.stem(w, code) for w in words.split())
        assert one == other or code in ("fr", "es", "pt") and one[:4] == other[:4]
    one = spark.createDataFrame([("Die Häuser und der Garten", 1), (None, 2), ("", 3)], "t string, k int")
    got = {r["k"]: r["x"] for r in one.select("k", analysis.tokens("lucene.de", one["t"]).alias("x")).collect()}
    assert got == {1: [None, "haus", None, None, "gart"], 2: None, 3: []}
    assert all(analysis.tokens(n, one["t"]) is not None for n in analysis.names())


def test_phrases_do_not_cross_values(spark):
    schema = SearchSchema((Field("id", "STRING", key=True), Field("tags", "STRING_COLLECTION", searchable=True)))
    rows = spark.createDataFrame([("a", ["red apple", "green pear"], 0), ("b", ["apple green"], 1)], "id string, tags array<string>, _doc long")
    light = SearchSchema((Field("id", "STRING", key=True), Field("tags", "STRING_COLLECTION", searchable=True, index_analyzer="lucene.de")))
    assert [r["id"] for r in text.score(rows, light, text.phrase_node(light, "apple green")).collect()] == []
    assert [r["id"] for r in text.score(rows, light, text.phrase_node(light, "appl green")).collect()] == ["b"]
    assert [r["id"] for r in text.score(rows, schema, text.phrase_node(schema, "apple green")).collect()] == ["b"]


def test_late_operations_lose(spark, tmp_path):
    c = C.Collection.create(spark, f"{tmp_path}/late", SCHEMA)
    frame = lambda *rows: spark.createDataFrame([(seq, action, document, None, None, 0, NOW) for seq, action, document in rows], ingest.OPERATION)
    c.apply(frame((10, 0, doc("a", n=10)), (11, 0, doc("b", n=11)), (12, 1, doc("c"))), 13)
    c.apply(frame((8, 0, doc("a", n=8)), (9, 1, doc("b")), (5, 0, doc("c", n=5)), (7, 0, doc("d", n=7))), 13)
    expected = {"a": 10, "b": 11, "d": 7}
    assert {r["id"]: r["n"] for r in c.df.collect()} == expected
    c.apply(frame((8, 0, doc("a", n=8)), (7, 0, doc("d", n=7))), 13)  # a replay gives the same rows
    assert c.df.count() == 3 and {r["id"]: r["n"] for r in c.df.collect()} == expected
    c.compact()
    c.apply(frame((6, 0, doc("a", n=6)), (4, 0, doc("c", n=4))), 13)  # tombstones outlive the compaction
    assert {r["id"]: r["n"] for r in c.df.collect()} == expected
    current = spark.createDataFrame(c.df.collect(), c.df.schema)
    merged = ingest.merge(current, ingest.parse(frame((3, 0, doc("a", n=3)), (20, 0, doc("b", n=20)), (2, 1, doc("d"))), SCHEMA), SCHEMA)
    assert {r["id"]: r["n"] for r in merged.collect()} == {"a": 10, "b": 20, "d": 7}


def test_two_writers_lose_nothing(spark, tmp_path):
    C.Collection.create(spark, f"{tmp_path}/shared", SCHEMA)
    failed = []

    def write(name):
        try:
            mine = C.Collection.open(spark, f"{tmp_path}/shared")
            for k in range(4):
                mine.index([{"document": doc(f"{name}{k}", n=k)}, {"document": doc("both", title=name, n=k)}], NOW)
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(name,)) for name in "xy"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    c = C.Collection.open(spark, f"{tmp_path}/shared")
    rows = c.df.collect()
    assert sorted(r["id"] for r in rows) == sorted(["both", *[f"{n}{k}" for n in "xy" for k in range(4)]]) and c.commit.n == 8
    assert len({r["_doc"] for r in rows}) == len(rows) and c.commit.next_seq == 16


def test_a_commit_number_is_taken_once(spark, tmp_path):
    files = C.Files(spark, str(tmp_path))
    assert files.create_new(f"{tmp_path}/1.json", "a") and not files.create_new(f"{tmp_path}/1.json", "b")
    assert files.read(f"{tmp_path}/1.json") == "a" and files.names(str(tmp_path)) == ["1.json"]
    with pytest.raises(ValueError):
        C.Collection.create(spark, f"{tmp_path}/c", SCHEMA) and C.Collection.create(spark, f"{tmp_path}/c", SCHEMA)
    one, two = C.Collection.open(spark, f"{tmp_path}/c"), C.Collection.open(spark, f"{tmp_path}/c")
    one.index([{"document": doc("a")}], NOW)
    two.index([{"document": doc("b")}], NOW)  # on top of the first writer's
    assert two.count() == 2
    base = one.latest()
    two.compact()
    stale = [base]
    one.latest = lambda: stale.pop() if stale else C.Collection.latest(one)
    with pytest.raises(C.Conflict):  # what it would merge is merged already
        one.compact()


def test_many_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "MAX_SEGMENTS", 3)
    plain = SearchSchema((Field("id", "STRING", key=True), Field("n", "INT32", filterable=True)))
    c = C.Collection.create(spark, f"{tmp_path}/many", plain)
    for k in range(6):
        c.index([{"document": doc("same", n=k)}, {"document": doc(f"k{k}", n=k)}], NOW)
    assert len(c.commit.segments) <= 3 and {r["id"]: r["n"] for r in c.df.collect()} == {"same": 5} | {f"k{k}": k for k in range(6)}


def test_a_batch_of_a_stream_counts_once(spark, tmp_path):
    c = C.Collection.create(spark, f"{tmp_path}/epochs", SCHEMA)
    ops = spark.createDataFrame([(0, 0, doc("a", n=1), None, None, 0, NOW)], ingest.OPERATION)
    c.apply(ops, 1, report=False, epoch=("s", 0))
    c.apply(ops, 1, report=False, epoch=("s", 0))
    assert c.df.count() == 1 and c.commit.n == 1 and c.commit.epochs == {"s": 0}


def test_typed_ingest(spark):
    schema = SearchSchema(
        (
            Field("id", "STRING", key=True), Field("b", "BOOLEAN"), Field("i", "INT32"), Field("l", "INT64"), Field("d", "DOUBLE"), Field("t", "DATE_TIME_OFFSET"),
            Field("g", "GEO_POINT"), Field("v", "VECTOR", dimension=2), Field("ss", "STRING_COLLECTION"), Field("ii", "INT32_COLLECTION"), Field("bb", "BOOLEAN_COLLECTION"),
        )
    )
    documents = [
        '{"id": "1", "b": true, "i": 5, "l": "7", "d": 2, "t": 1700000000000, "g": {"lat": 1.5, "lon": -2}, "v": [1, 0.5], "ss": ["x", "y"], "ii": [1, "2"], "bb": [true, false]}',
        '{"id": "2", "b": "f", "i": 3.9, "d": "1e3", "ss": [], "nested": 1}', '{"id": "3", "b": "1", "i": "x", "l": null}', '{"id": "4", "g": {"lat": 1}}', '{"id": "5", "v": [1]}',
    ]
    ops = spark.createDataFrame([(k, 0, t, None, None, 0, NOW) for k, t in enumerate(documents)], ingest.OPERATION)
    got = {r["id"]: r for r in ingest.parse(ops, schema).collect()}
    one = got["1"]
    assert (one["b"], one["i"], one["l"], one["d"], one["t"], tuple(one["g"]), one["v"], one["ss"], one["ii"], one["bb"]) == (True, 5, 7, 2.0, 1700000000000, (1.5, -2.0), [1.0, 0.5], ["x", "y"], [1, 2], [True, False])
    assert one["error"] is None and one["_src"] == documents[0]
    assert got["2"]["error"] == "Unknown field: nested" and (got["2"]["b"], got["2"]["i"], got["2"]["d"]) == (False, 3, 1000.0)
    assert (got["3"]["b"], got["3"]["i"], got["3"]["l"], got["3"]["error"]) == (True, None, None, None)
    assert "lat and lon" in got["4"]["error"] and "2 numbers" in got["5"]["error"]


def test_index_of_collections_keeps_gaps(spark, tmp_path):
    schema = SearchSchema((Field("id", "STRING", key=True), Field("tags", "STRING_COLLECTION", searchable=True)))
    rows = spark.createDataFrame([("a", ["red apple", "green pear"], 0), ("b", ["apple green"], 1), ("c", None, 2), ("d", [], 3)], "id string, tags array<string>, _doc long")
    postings.write(rows, schema, str(tmp_path / "index"), parts=2)
    index = postings.TextIndex.open(spark, [str(tmp_path / "index")])
    assert [r["id"] for r in text.score(rows, schema, text.phrase_node(schema, "apple green"), index).collect()] == ["b"]
    assert index.lengths == {"tags": (2, 6)}


def test_index_scores_equal_scan_scores(spark, tmp_path):
    schema = SearchSchema((Field("id", "STRING", key=True), Field("title", "STRING", searchable=True), Field("body", "STRING", searchable=True)))
    rows = spark.createDataFrame([(str(i), f"w{i % 3} w{i % 5}", " ".join(f"w{k}" for k in range(i)), i) for i in range(12)], "id string, title string, body string, _doc long")
    parts = [rows.filter("_doc % 2 = 0"), rows.filter("_doc % 2 = 1")]  # two segments
    for k, part in enumerate(parts):
        postings.write(part, schema, str(tmp_path / str(k)), parts=2)
    index = postings.TextIndex.open(spark, [str(tmp_path / str(k)) for k in range(2)])
    for node in (text.text_node(schema, "w1 w4"), text.phrase_node(schema, "w1 w2 w3", slop=1), text.fuzzy_node(schema, "w1", max_edits=1), text.prefix_node(schema, "w1")):
        found, scan = (text.score(rows, schema, node, i).collect() for i in (index, None))
        assert found and {r["_doc"]: round(r["_score"], 9) for r in found} == {r["_doc"]: round(r["_score"], 9) for r in scan}


def test_index_is_built_in_sorted_runs(spark, tmp_path, monkeypatch):
    """No shuffle of postings: each task sorts bounded runs of its own, over batches, and cuts no row."""
    monkeypatch.setattr(postings, "RUN_TOKENS", 5)
    batch = lambda first, *texts: pa.RecordBatch.from_arrays([pa.array(range(first, first + len(texts))), pa.array(["f"] * len(texts)), pa.array(texts, pa.list_(pa.string()))], names=["_doc", "field", "tokens"])
    runs = list(postings._blocks([batch(0, ["b", None, "a", "b"], None), batch(2, ["a"], ["c"] * 7, ["é", "z", "a"])]))
    assert [r["term"] for run in runs for r in run.to_pylist()] == ["a", "b", "c", "a", "z", "é"] and [run.num_rows for run in runs] == [2, 1, 3]
    a, b = runs[0].to_pylist()
    assert (a["docs"], a["tf"], a["dl"], a["at"], a["positions"], a["heads"]) == ([0, 2], [1, 1], [3, 1], [1, 2], [2, 0], 1)
    assert (b["docs"], b["df"], b["cf"], b["positions"], b["heads"]) == ([0], 1, 2, [0, 3], 1)
    monkeypatch.undo()
    schema = SearchSchema((Field("id", "STRING", key=True), Field("title", "STRING", searchable=True)))
    rows = spark.createDataFrame([(str(i), f"w{i % 3} common", i) for i in range(9)], "id string, title string, _doc long")
    assert "Exchange" not in postings.blocks(rows, schema)._jdf.queryExecution().executedPlan().toString()
    postings.write(rows, schema, str(tmp_path / "index"))
    index = postings.TextIndex.open(spark, [str(tmp_path / "index")])
    assert sorted(x.name for x in tmp_path.joinpath("index").iterdir()) == ["blocks", "fields"]
    assert index.frequencies({("title", "common"), ("title", "w1"), ("title", "none")}) == {("title", "common"): 9, ("title", "w1"): 3, ("title", "none"): 0}


def test_no_task_sorts_a_whole_batch(spark, tmp_path, monkeypatch):
    """Operations of one file are dealt before they are sorted, and a merge sorts so many rows in a task at most."""
    plain, plans = SearchSchema((Field("id", "STRING", key=True), Field("n", "INT32", filterable=True))), []
    parse = ingest.parse
    monkeypatch.setattr(ingest, "parse", lambda ops, schema: plans.append(ops._jdf.queryExecution().analyzed().toString()) or parse(ops, schema))
    monkeypatch.setattr(C, "FILE_ROWS", 2, raising=False)
    c = C.Collection.create(spark, f"{tmp_path}/dealt", plain)
    c.index([{"document": doc(f"k{k}", n=k)} for k in range(9)], NOW)
    c.compact()
    assert "RepartitionByExpression [seq" in plans[0]
    assert len(list(tmp_path.joinpath("dealt", c.commit.segments[0], "rows").glob("part-*.parquet"))) > 1 and c.df.count() == 9
