"""Every registered query on the smallest tables: its SQL, or its contract against plain versions."""

import base64
import collections
import hashlib
import os
import re
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

from facetry.llm import queries
from facetry.llm.pipeline import TOKENIZER

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def run(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, sql = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    plain = lambda rows: sorted(str(tuple(r[n] for n in names)) for r in rows)
    assert plain(df.collect()) == plain([dict(zip(sql.columns, r, strict=True)) for r in sql.fetchall()])


def test_language(spark):
    docs, got = {r["doc_id"]: r for r in table("documents")}, run(spark, "op1_language_id")
    assert sorted(r["doc_id"] for r in got) == sorted(docs) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    known = {r["lang"] for r in docs.values() if r["lang"] and not held_out(r["doc_id"])}
    assert all(r["lang_pred"] in known if any(map(str.isalpha, docs[r["doc_id"]]["text"] or "")) else r["lang_pred"] == "und" for r in got)
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert sum(right) / len(right) >= 0.97


def test_tokens(spark):
    import tiktoken

    with open(P.path(TOKENIZER), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in run(spark, "op2_byte_bpe")}
    for r in table("documents"):
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())


def test_mix(spark):
    got, docs = run(spark, "op3_mixing"), {r["doc_id"]: r for r in table("documents")}
    sizes = collections.Counter()
    for r in docs.values():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, capped, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set(), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * level > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    taken = collections.Counter()
    for r in got:
        source = docs[r["doc_id"]]["source"]
        target = 2 * sizes[source] if source in capped else weight[source] * level
        assert r["size"] == len(WORD.findall(docs[r["doc_id"]]["text"] or "")) and r["source_size"] == sizes[source]
        assert abs(r["target"] - target) < 1e-6 * max(1, target) and r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[docs_source] - (2 * sizes[docs_source] if docs_source in capped else weight[docs_source] * level)) <= largest for docs_source in order)


def test_pages(spark):
    pages, got = {r["page_id"]: r for r in table("pages")}, run(spark, "op4_html_extraction")
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert not re.search(r"<[a-z/]", r["text"]) and all(x == re.sub(r"\s+", " ", x).strip() != "" for x in r["text"].split("\n") if r["text"])


def test_media(spark):
    docs, by_text = {r["doc_id"]: r for r in table("documents")}, collections.defaultdict(set)
    for r in run(spark, "op5_telephony_audio"):
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert hashlib.sha256(bytes(r["pcm"])).hexdigest() == r["pcm_sha256"] and len(r["pcm"]) == r["pcm_bytes"]
        by_text[raw].add((r["feature"], r["media_sha256"], r["media_bytes"], r["pcm_sha256"]))
    assert all(len(v) == 1 for v in by_text.values()) and len({f.split(";")[0] for v in by_text.values() for f, *_ in v}) == 3


def test_near_copies(spark):
    from test_operators import plain_components

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op7_ngram_jaccard")}
    assert got == plain_components([(r["doc_id"], r["text"]) for r in table("documents")])


def test_toxicity_of_held_out_rows(spark):
    """On 10,000 documents; in the smallest tables too few are toxic."""
    data = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{data}/labels.parquet").to_pylist()}
    got = queries.QUERIES["op10_toxicity"](spark, data).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    found = collections.Counter((labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None)
    assert found[1, 1] / (found[1, 1] + found[1, 0]) >= 0.9 and found[0, 1] / (found[0, 0] + found[0, 1]) <= 0.01
