"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetry.llm import bpe, html_extract, jaccard, langid, mixing, pipeline, quality, telephony, toxicity, urlfilter, warc
from facetry.llm import kernels as K

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_multi_50k.tiktoken"))
WORD = re.compile(r"[^\x20\x09-\x0d]+")
#: Names that operators use inside.
CLASH = "cut whole EXTRA row p ledger failed __k __u __c __r size id n block label top key kind target component stack rate known".split()
LONG = " ".join(f"w{i} Ünd" for i in range(250_000))


def text_of(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["the", "of", "and", "there", "with"]) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, repeated and long texts, and columns of other names."""
    rows = [(k, text_of(k), "en", f"s{k % 3}") for k in range(30)]
    rows += [(3, text_of(3), "en", "s0")] * 2 + [(40, None, "en", "s1"), (41, "", None, "s1"), (42, text_of(1), "en", None), (None, text_of(99), None, None), (None, None, None, None)]
    rows += [(50, LONG, "en", "s2"), (51, " \n\t", "en", "s2"), (52, "1234 !?", "en", "s0")]
    rows = [(*r, *[f"{c}-{i}" for c in CLASH]) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def whole(df):
    return collections.Counter(str(tuple(r)) for r in df.collect())


def test_stages_keep_rows_as_they_are(spark, odd):
    kept = odd
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, "").cache()
        assert out.columns == odd.columns and set(whole(out)) <= set(whole(kept))
        assert stage(spark, kept.filter("false"), "").count() == 0
        kept = out
    tokens = pipeline.token_stage(spark, odd, "")
    assert tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and tokens.count() == odd.count()
    assert pipeline.token_stage(spark, odd.filter("false"), "").count() == 0


def test_quality_stage(spark, odd):
    kept = [r["doc_id"] for r in pipeline.quality_stage(spark, odd, "").collect()]
    assert not {40, 41, 51, 52} & set(kept) and kept.count(3) == 3 and 50 in kept
    assert quality.with_ledger(odd.drop("ledger")).filter("doc_id = 50").select("ledger.n_words").first()[0] == 500_000
    names = quality.ablation(quality.with_ledger(odd.filter("false")))
    assert {(r["n_failed"], r["n_only"], r["n_kept_without"]) for r in names.collect()} <= {(0, 0, 0)}


def test_hashes_of_ranges_do_not_depend_on_windows(monkeypatch):
    data = np.frombuffer(b"abc def  abc " * 40 + b"x" * 400, np.uint8)
    block = K.Block(0, 1, data, np.array([0, len(data)]))
    expected = K.Words(block).hashes.tolist()
    monkeypatch.setattr(K, "WINDOW", 7)
    monkeypatch.setattr(K, "_POWER", K._powers(K._MULT))
    monkeypatch.setattr(K, "_INVERSE", K._powers(K._INV))
    assert K.Words(block).hashes.tolist() == expected and len(set(expected)) == 3


# ---- language ----


def test_a_language_with_few_texts_keeps_its_grams(spark):
    rnd = random.Random(2)
    big = [(k, " ".join(f"{rnd.choice(['alpha', 'beta', 'gamma'])}{rnd.random()}" for _ in range(300)), "big") for k in range(120)]
    small = [(1000 + k, "маленький язык имеет мало текстов", "sm") for k in range(3)]
    filters = langid.fit(spark.createDataFrame(big + small, "doc_id long, text string, lang string"), capacity=200)
    assert filters.predict(pa.array(["маленький язык имеет мало текстов", big[0][1]]))[0] == ["sm", "big"]


def test_more_languages_than_a_word_has_bits(spark):
    rows = [(3 * i + k, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}{chr(97 + i * 7 % 26)}" for w in ("ada", "olo", "umu", "ixi")), f"l{i:03}") for i in range(90) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(docs)
    assert filters.table.shape[0] == 2 and docs.withColumn("p", langid.identify(filters, F.col("text"))).filter("p.lang_pred <> lang").count() == 0


def test_languages_of_odd_texts(spark, odd):
    docs = spark.createDataFrame([(1, "aaaa bbbb", "x"), (2, "aaaa bbbb", "y"), (3, None, "x"), (4, "cccc", None)], "doc_id long, text string, lang string")
    filters = langid.fit(docs)
    assert filters.predict(pa.array(["aaaa bbbb", None, "", "123", "x" * 3_000_000]))[0] == ["x", "und", "und", "und", "x"]  # ties: the first by name
    empty = langid.fit(docs.filter("false"))
    assert docs.withColumn("p", langid.identify(empty, F.col("text"))).filter("p.lang_pred <> 'und'").count() == 0
    assert docs.filter("false").withColumn("p", langid.identify(filters, F.col("text"))).count() == 0
    got = odd.select("doc_id", langid.identify(langid.fit(odd), F.col("text")).alias("found")).collect()
    assert {r["found"]["lang_pred"] for r in got} == {"en", "und"}


def test_filters_agree_with_plain_sets(spark):
    """Against exact n-gram sets: the Bloom filters change no decision that is not a near tie."""
    rnd = random.Random(4)
    stems = {k: ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(80)] for k in ("aa", "bb", "cc")}
    shared = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(40)]
    rows = [(i, " ".join(rnd.choice(stems[k] + shared) for _ in range(25)), k) for i, k in enumerate(list(stems) * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(docs.filter("doc_id % 5 <> 0"))
    counts = {k: collections.Counter() for k in stems}
    grams = lambda t: [f" {t} "[i : i + 4] for i in range(len(t) - 1)]
    for i, t, k in rows:
        if i % 5:
            counts[k].update(grams(t))
    total = {k: sum(c.values()) for k, c in counts.items()}
    rate = lambda k, g: counts[k][g] / total[k]
    held = {k: {g for g in counts[k] if rate(k, g) >= langid.SHARE * max(rate(x, g) for x in stems)} for k in stems}
    got = filters.predict(pa.array([t for _, t, _ in rows]))[0]
    for (_, t, _), found in zip(rows, got, strict=True):
        hits = {k: sum(g in held[k] for g in grams(t)) for k in stems}
        assert hits[found] >= max(hits.values()) - 2


# ---- tokens ----


def test_tokens_of_odd_and_long_texts(spark, odd):
    import tiktoken

    v = bpe.vocabulary(PATH, P.PATTERN)
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    got = odd.select("doc_id", "text", bpe.round_trip(F.col("text"), PATH, P.PATTERN).alias("c")).collect()
    for r in got:
        ids = library.encode_ordinary(r["text"] or "")
        assert (r["c"]["n_tokens"], r["c"]["decoded_sha256"]) == (len(ids), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert odd.filter("false").select(bpe.encode(F.col("text"), PATH, P.PATTERN).alias("x")).count() == 0
    nulls = spark.createDataFrame([(None,), ([],), ([72, 105],)], "ids array<int>")
    assert [r[0] for r in nulls.select(bpe.decode(F.col("ids"), PATH, P.PATTERN)).collect()] == [None, b"", v.decode([72, 105])]


def test_bounded_caches_give_the_same_ids(monkeypatch):
    for name, value in (("GROUP_BYTES", 300), ("CACHE_PIECES", 20), ("CACHE_CHARS", 90), ("PART_BYTES", 50)):
        monkeypatch.setattr(bpe, name, value)
    v = bpe.Vocabulary(bpe.vocabulary(PATH, P.PATTERN).ranks, P.PATTERN)
    plain = bpe.vocabulary(PATH, P.PATTERN)
    texts = [text_of(k, 1 + k) for k in range(30)] + ["", "東京" * 40]
    arrays = [pa.array(texts[k : k + 3]) for k in range(0, len(texts), 3)]
    got = [x.tolist() for part in bpe._each_batch(v, iter(arrays), list) for x in part]
    assert got == [x.tolist() for x in plain.encode_batch(texts)] and len(v.numbers) <= 20 and v.chars <= 90


# ---- mixing ----


def test_mix_of_odd_rows(spark, odd):
    report = mixing.mix_report(odd).collect()
    assert len(report) == odd.count() and all(r["taken"] == r["copies"] == 0 for r in report if r["size"] == 0)
    assert all(r["copies"] <= 2 for r in report)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in report)
    clamped = spark.createDataFrame([(k, t, "a" if k < 3 else "b", "x") for k, t in enumerate(["", "w " * 10, None, "v " * 500, "u " * 400])], "doc_id long, text string, source string, Cut string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(clamped).collect()}
    assert copies[0] == copies[2] == 0 and copies[1] == 2  # the small source is clamped at two epochs
    assert mixing.mix(odd.filter("false")).count() == 0


# ---- pages ----


def plain_extract(rows):
    """Pairs by a plain look at all pages of a host; lines by a plain dynamic programme."""
    address = re.compile(r"^(?:[^/?#]*://)?([^/?#]*)([^?#]*)", re.S)
    parsed = {i: html_extract.lines_of(h) for i, _, h in rows}
    at = {i: address.match(u or "").groups() for i, u, _ in rows}

    def shared(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        i, j, found = len(a), len(b), set()
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                found.add(i)
            elif best[i - 1][j] >= best[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return found

    out = {}
    for i, _, h in rows:
        host, path = at[i]
        lines = parsed[i]
        inside = any(kind == html_extract.MAIN for _, kind in lines)
        content = [k for k, (_, kind) in enumerate(lines) if kind == (html_extract.MAIN if inside else html_extract.OUTSIDE)]
        common = lambda p: next((k for k, (x, y) in enumerate(zip(p, path, strict=False)) if x != y), min(len(p), len(path)))  # noqa: E731, B023
        others = sorted((x for x in rows if at[x[0]][0] == host and x[2] != h and parsed[x[0]]), key=lambda x: at[x[0]][1])
        before = [x for x in others if at[x[0]][1] < path][::-1]
        near = sorted(before, key=lambda x: -common(at[x[0]][1])) + [x for x in others if at[x[0]][1] > path]
        near = sorted(near, key=lambda x: -common(at[x[0]][1]))  # stable: of equally near ones those before come first
        text = [lines[k][0] for k in content]
        for x in near[: 2 * html_extract.REACH]:
            same = shared([t for t, _ in lines], [t for t, _ in parsed[x[0]]])
            size = sum(len(lines[k][0]) for k in content)
            if sum(len(lines[k][0]) for k in content if k in same) <= (0.5 if inside else 0.9) * size:
                text = [lines[k][0] for k in content if k not in same]
                break
        out[i] = "\n".join(text)
    return out


def test_extraction_equals_a_plain_one(spark):
    rnd, rows = random.Random(8), []
    for k in range(60):
        host, section = f"h{k % 3}.example", rnd.choice("abc")
        body = "".join(f"<p>Own words {rnd.random()} of page {k}</p>" for _ in range(rnd.randrange(2, 6)))
        menu = "<div>Home</div><div>News</div><div>Imprint</div>"
        main = f"<article><p>Share this</p>{body}<p>Section {section}</p></article>" if k % 2 else f"<div>Section {section}</div>{body}"
        rows.append((k, f"http://{host}/{section}/{k:03}", f"<nav>x</nav>{menu}{main}<footer>y</footer>"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    expected = plain_extract(rows)
    assert got == expected and sum("Share this" not in t for t in got.values()) > 40
    alone = {i: html_extract.main_text(html_extract.lines_of(h)) for i, _, h in rows}
    assert sum(got[i] != alone[i] for i in got) > 50  # the neighbours decide most pages


def test_pages_with_odd_columns_ties_and_copies(spark):
    page = lambda *own: "".join(f"<p>{x}</p>" for x in ("Top", *own, "End"))
    rows = [(1, "http://a.b/x1", page("left one")), (2, "http://a.b/x2", page("middle")), (3, "http://a.b/x3", page("right one")), (4, None, None), (4, None, None), (None, "http://a.b/x2", page("middle"))]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, path string")
    got = collections.Counter((r["page_id"], r["text"]) for r in html_extract.extract(pages).collect())
    assert got == collections.Counter([(1, "left one"), (2, "middle"), (3, "right one"), (4, ""), (4, ""), (None, "middle")])


def test_long_pages_take_seconds():
    began = time.time()
    equal = html_extract.lines_of("<p>x</p>" * 60_000 + "<p>end</p>")
    other = html_extract.lines_of("<p>begin</p>" + "<p>x</p>" * 60_000)
    assert len(html_extract.shared_lines([t for t, _ in equal], [t for t, _ in other])) == 60_000
    assert html_extract.lines_of("<b><i>x</u>" * 100_000)[0][0].startswith("xx")
    assert time.time() - began < 20


# ---- media and archives ----


def test_media_of_odd_rows(spark, odd):
    stored = odd.select("doc_id", "text", telephony.stored(F.col("text")).alias("kept"))
    got = stored.select("text", "kept.*", telephony.digest(F.col("kept.media"), with_pcm=True).alias("d")).collect()
    for r in got:
        raw = (r["text"] or "").encode()
        assert r["n_bytes"] == len(raw) and r["d"]["payload_bytes"] == max(64, -(-len(raw) // 64) * 64)
        assert hashlib.sha256(bytes(r["d"]["pcm"])).hexdigest() == r["d"]["pcm_sha256"] and len(r["d"]["pcm"]) == r["d"]["pcm_bytes"]
    assert odd.filter("false").select(telephony.stored(F.col("text"))).count() == 0
    broken = spark.createDataFrame([(None,), (bytearray(b"no wave"),)], "media binary")
    assert [tuple(r["d"]) for r in broken.select(telephony.digest(F.col("media")).alias("d")).collect()] == [(None,) * 8] * 2


def test_features_equal_plain_ones():
    for text in ("", "abc", text_of(5, 400), "ü" * 777):
        _, payload = telephony.payload_of(text)
        for codec in (telephony.MULAW, telephony.ALAW, telephony.IMA):
            parsed = telephony.parse_wave(telephony.store(payload, codec))
            (samples,) = telephony.decode_all([parsed])
            x = [int(v) for v in samples]
            crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
            assert telephony._feature(codec, samples) == f"{telephony.NAMES[codec]};n={len(x)};power={sum(v * v for v in x) // len(x)};crossings={crossings};peak={max(map(abs, x))}"
            assert parsed[3] == payload and zlib.crc32(parsed[3][-64:]) == zlib.crc32(payload[-64:])


def test_archives_of_odd_rows(spark):
    long = "x" * 3_000_000
    rows = [(1, "a", "u", "z"), (1, "a", "u", "z"), (2, "b", None, "z"), (None, "a", "u", "z"), (None, "c", "u", "z"), (3, None, "u", "z"), (4, "", "u", "z"), (5, long, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, digest string")
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_all(warc.bundles(pages)).collect())
    assert got == collections.Counter(
        [(1, 1, "response", None)] * 2 + [(2, 1, "response", None), (None, 1, "revisit", 1), (None, 1, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 3_000_000, "response", None)]
    )


# ---- near copies ----


def test_rows_without_an_id_link(spark):
    base = text_of(7, 80).split()
    near = lambda k: " ".join([*base[:k], "changed", *base[k + 1 :]])
    rows = [(1, " ".join(base)), (None, near(40)), (2, near(10)), (None, text_of(8)), (None, text_of(8)), (9, text_of(9)), (None, None)]
    docs = spark.createDataFrame([(*r, "i", "b") for r in rows], "doc_id long, text string, id string, block string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_copies(docs).collect())
    assert got == collections.Counter([(1, 1), (None, 1), (2, 1), (None, None), (None, None), (9, 9), (None, None)])
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and collections.Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 9: 1, None: 3}


def test_chained_and_hot_blocks(spark):
    """A chain of near copies, a large group, and rows that share passages only; chunks of a few rows."""
    rnd, rows = random.Random(6), []
    chain = [f"c{k}" for k in range(120)]
    for k in range(12):  # each links with the next ones only
        rows.append((k, " ".join([*chain[4 * k :], *[f"d{j}" for j in range(4 * k)]])))
    group = [f"g{k}" for k in range(90)]
    for k in range(60):
        w = list(group)
        w[rnd.randrange(90)] = f"x{k}"
        rows.append((100 + k, " ".join(w)))
    passage = " ".join(f"q{k}" for k in range(30))
    rows += [(300 + k, f"{passage} {text_of(500 + k, 40)}") for k in range(30)]
    from test_operators import plain_components

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (200, 1000):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(docs, chunk=chunk).collect()}
        assert got == plain_components(rows)


def test_searches_across_chunks_are_bounded(spark, monkeypatch):
    """Half of a group links with nothing and goes to all its chunks: each search takes a few chunks' shingles."""
    rnd, rows, searched = random.Random(9), [], []
    for k in range(160):
        w = [f"g{j}" for j in range(100)]
        for j in rnd.sample(range(100), 1 if k % 2 else 4):
            w[j] = f"x{k}"
        rows.append((k, " ".join(w)))
    search = jaccard._search

    def watched(texts, dealt):
        searched.extend(r["w"] for r in dealt.groupBy("block").agg(F.sum("n").alias("w")).collect())
        return search(texts, dealt)

    monkeypatch.setattr(jaccard, "_search", watched)
    from test_operators import plain_components

    got = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), chunk=1000).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows)
    assert len(searched) > 20 and max(searched) < 4000


# ---- URLs ----


def test_rules_that_tie_or_are_odd(spark):
    rules = [
        ("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("a.com", "/x/y", "allow"), ("a.com", "", "block"), ("com", None, "allow"), ("", "/", "block"), (None, "/", "block"),
        ("b.a.com", "/x", "allow"), ("c.org", "/é", "block"),
    ]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = ["http://a.com/x", "http://a.com/x/y/z", "http://a.com/", "http://b.a.com/x/y", "http://b.a.com/x", "http://z.com/x", "http://c.org/ét", "http://c.org/e", "http:///x", None, "http://q.b.a.com"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls * 20)], "page_id long, url string, host string")

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest)[0].lower()
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(len(h + (p or "")), len(h), h + (p or ""), v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    for parts in (1, 9):
        got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(pages, table, parts=parts).collect()}
        assert got == {k: plain(u) for k, u in enumerate(urls * 20)}
    assert urlfilter.judge(pages.filter("false"), table).count() == 0
    assert {(r["rule"], r["verdict"]) for r in urlfilter.judge(pages, table.filter("false"), default="block").collect()} == {(None, "block")}


def test_many_nested_rules(spark):
    rnd = random.Random(3)
    path = lambda: "/" + "/".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 6)))
    rules = list({(h, path()): None for h in ("x.com", "y.x.com", "com") for _ in range(30)})
    table = spark.createDataFrame([(*r, rnd.choice(["allow", "block"])) for r in rules], "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, f"http://{rnd.choice(['x.com', 'y.x.com', 'z.y.x.com', 'o.org'])}{path()}") for k in range(300)], "page_id long, url string")
    verdict = {r["host"] + r["path"]: r["verdict"] for r in table.collect()}
    for r in urlfilter.judge(pages, table, parts=7).collect():
        fits = [(len(h + p), h + p) for h, p in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert len(r["rule"] or "") == (max(fits)[0] if fits else 0) and r["verdict"] == verdict.get(r["rule"], "allow")


# ---- toxicity ----


def plain_features(text):
    words = re.findall(r"[a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = {("word", w) for w in words}
    for size in toxicity.STEMS:
        stems = collections.Counter(w.encode()[:size] for w in words if len(w.encode()) > size)
        out |= {("stem", s, least) for s, n in stems.items() for least in toxicity.STEM_WORDS if n >= least}
    return out


def test_features_equal_plain_counts():
    texts = ["Some words and somewhat someone, SOME", "", None, "grüße grüßen grüßlich", "a", text_of(3, 30)]
    for block in K.blocks(pa.array(texts)):
        row, bucket = toxicity.features(block)
        assert np.bincount(row, minlength=block.n).tolist() == [len(plain_features(t)) for t in texts]
        assert not set(bucket[row == 0]) & set(bucket[row == 3])


def test_training_equals_a_plain_one():
    rnd = random.Random(1)
    rows = lambda n, toxic: [np.array(sorted({rnd.randrange(6) for _ in range(4)} | ({7} if toxic else set()))) for _ in range(n)]
    p, u = rows(12, True), rows(20, False) + rows(4, True)
    chosen, prior, steps = np.arange(8), 0.2, 25
    got = toxicity.train(p, u, chosen, prior, epochs=steps)
    w, b = [0.0] * 8, math.log(prior / (1 - prior))
    m, v = [0.0] * 9, [0.0] * 9
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for t in range(1, steps + 1):
        z = lambda x: b + sum(w[k] for k in x)  # noqa: E731, B023
        loss = lambda s: math.log1p(math.exp(-s))
        negative = sum(loss(-z(x)) for x in u) / len(u) - prior * sum(loss(-z(x)) for x in p) / len(p)
        slopes = [(x, sigmoid(z(x)) / len(u)) for x in u] + [(x, -prior * sigmoid(z(x)) / len(p)) for x in p]
        if negative >= 0:
            slopes += [(x, -prior * (1 - sigmoid(z(x))) / len(p)) for x in p]
        else:
            slopes = [(x, -s) for x, s in slopes]
        g = [sum(s for x, s in slopes if k in x) + 1e-4 * w[k] for k in range(8)] + [sum(s for _, s in slopes)]
        m = [0.9 * a + 0.1 * x for a, x in zip(m, g, strict=True)]
        v = [0.999 * a + 0.001 * x * x for a, x in zip(v, g, strict=True)]
        move = [0.1 * (a / (1 - 0.9**t)) / (math.sqrt(c / (1 - 0.999**t)) + 1e-8) for a, c in zip(m, v, strict=True)]
        w, b = [a - c for a, c in zip(w, move, strict=False)], b - move[8]
    assert np.allclose(got.weights, w, atol=1e-9) and abs(got.bias - b) < 1e-9


def test_toxicity_of_odd_rows(spark, odd):
    rows = [(k, text_of(k) + (" vile nasty" if k % 4 == 0 else "")) for k in range(80)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(60)] + [(0, 0), (None, 1), (5000, 0), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    score = lambda t: model.scores(pa.array([t], pa.string()))[0]
    assert score("vile and nasty of there1") > 0.5 > score(None) == score("") and 0 <= score(LONG) < 0.5
    assert odd.select(toxicity.score(model, F.col("text")).alias("s")).filter("s is null or s < 0 or s > 1").count() == 0
    assert docs.filter("false").select(toxicity.score(model, F.col("text"))).count() == 0
    assert not toxicity.fit(docs.filter("false"), labels).trained and not toxicity.fit(docs, labels.filter("false")).trained
    small = toxicity.fit(docs, labels, max_bytes=1)  # next to nothing is read, and nothing is learned
    assert 0 <= small.scores(pa.array(["vile"]))[0] <= 1
