"""The corpus pipeline against plain versions of its stages."""

import collections
import importlib.util
import os
import random

import numpy as np
import pyarrow as pa

from facetry.llm import jaccard, pipeline, spark_utils

DATA = "/root/testdata/sf0.001"
_spec = importlib.util.spec_from_file_location("plain", os.path.join(os.path.dirname(__file__), "test_operators.py"))
plain = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(plain)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in pipeline.STAGES:
        before, kept = kept, stage(spark, kept, DATA).cache()
        ids = collections.Counter(r["doc_id"] for r in kept.collect())
        if name == "quality rules":
            rejected = [r for r in before.collect() if (m := plain.plain_quality(r["text"]))[0] < 10 or 100 * m[4] > 20 * m[0]]
            assert rejected and not {r["doc_id"] for r in rejected} & set(ids)
        if name == "near copies":
            groups = plain.plain_components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert set(ids) == {g for _, g in groups.values()}
        if name == "mixing":
            assert set(ids.values()) <= {1, 2}
        if name == "byte-level BPE":
            assert ids == collections.Counter(r["doc_id"] for r in before.collect())
        else:
            assert kept.columns == columns
    assert pipeline.run(spark, DATA).count() == kept.count()


def test_language_stage_rejects_unlearned_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    foreign = [
        "Kot śpi na kanapie, podczas gdy deszcz powoli pada na miasto, a ludzie szybko chodzą pod parasolami",
        "Kedi kanepede uyurken yağmur yavaşça şehrin üzerine yağıyor ve insanlar hızla yürüyor her sabah",
        "Kissa nukkuu sohvalla, kun sade putoaa hitaasti kaupungin ylle ja ihmiset kävelevät nopeasti",
        "Paka analala kwenye kochi wakati mvua inanyesha polepole juu ya mji na watu wanatembea haraka",
    ]
    clean = [(r["doc_id"], r["text"]) for r in pipeline.quality_stage(spark, docs, DATA).collect()]
    odd = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate([*foreign, "1234 5678 !!", None])], "doc_id long, text string")
    given = docs.unionByName(odd, allowMissingColumns=True)
    kept = {r["doc_id"] for r in pipeline.language_stage(spark, given, DATA).collect()}
    assert clean and kept >= {i for i, _ in clean} and not any(i >= 10**9 for i in kept)


def test_near_copies_of_a_large_group_are_searched_in_bounded_parts(spark, monkeypatch):
    """Half of the group's rows link with nothing: they are asked of all chunks, but not all in one task, nor of each other there."""
    rnd, rows, searched = random.Random(3), [], []
    for k in range(800):
        w = [f"g{j}" for j in range(500)]
        for j in rnd.sample(range(5, 495, 5), 16 if k % 2 else 1):
            w[j] = f"x{k}-{j}"
        rows.append((k, " ".join(w)))
    search = jaccard._search

    def watched(texts, dealt):
        searched.extend(r["sum(n)"] for r in dealt.groupBy("block").sum("n").collect())
        return search(texts, dealt)

    monkeypatch.setattr(jaccard, "_search", watched)
    kept = pipeline.near_copy_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == {0, *range(1, 800, 2)}
    assert len(searched) > 16 and max(searched) < 150_000


def test_near_copies_of_more_rows_than_are_broadcast_shuffle_no_texts(spark, monkeypatch):
    """The rows that go are told by their ids, which are few, not by those of all rows that stay."""
    monkeypatch.setattr(spark_utils, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 10, raising=False)
    rows = [(k, " ".join(f"w{j}-{min(k, 194)}" for j in range(30))) for k in range(200)] + [(3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = pipeline.near_copy_stage(spark, docs, "")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(195), 3])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_first_pass_of_near_copies_deals_part_of_the_shingles(spark):
    """At most half of them, and of each two sets that link as many in common as the pass asks for."""
    rnd, rows = random.Random(5), []
    for n in [*range(5, 60), 200, 801]:
        w = [f"t{n}-{j}" for j in range(n)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[: -max(1, (n - 4) // 4)]))]  # the second has three quarters
    rows += [(len(rows) + k, " ".join(rnd.choices("abcdefgh", k=3000))) for k in range(3)]
    texts = pa.record_batch([pa.array([t for _, t in rows])], names=["t"])
    dealt = lambda *how: sum(int(np.frombuffer(b, np.uint32, 2)[1]) for r in jaccard._postings(8, *how)([texts]) for b in r.column(1).to_pylist())
    assert 0 < dealt(True) <= dealt() / 2
    got = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain.plain_components(rows)
