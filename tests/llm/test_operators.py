"""The text-corpus operators against plain versions, with odd rows: nulls, empty and long texts, copies, no rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetry.llm import bpe, html_extract, jaccard, langid, mixing, pipeline, quality, telephony, toxicity, urlfilter, warc
from facetry.llm import kernels as K
from facetry.llm.connected import components, local_components

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
RND = random.Random(5)
VOCABULARY = [f"{a}{b}" for a in ("ba", "cé", "Du", "fo", "gi") for b in ("n", "rt", "ling", "s.", "ß", "x")]


def sentence(n):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n))


def texts():
    base = [sentence(RND.randrange(1, 120)) for _ in range(40)]
    near = []
    for t in base[:15]:
        words = t.split()
        for _ in range(3):
            w = list(words)
            w[RND.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    lines = ["one line here\nother\none line here\n\n \none line here", "a b c d e f a b c d e a b c d e", "x", "  ", "", None, "\n", "#*$ %% <b>&|", "ABC DEF ABCDEF!!"]
    return base + near + base[:10] + lines + [" ".join(f"w{i % 977}" for i in range(30_000)), "ÀÉ 東京 ñ\x0b\x0c\r\t\x1f\x85　y"]


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s0"][i % 4 if i % 5 else 0], 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("doc_id < 0")


# ---- quality ----


def plain_quality(t):
    t = t or ""
    w = WORD.findall(t)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, nothing):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r["ledger"][n] for n in names) for r in quality.with_ledger(docs).collect()}
    assert got == {i: plain_quality(t) for i, t in enumerate(TEXTS)}
    assert quality.with_ledger(nothing).count() == 0


def test_policy_and_ablation(docs):
    kept = quality.apply_policy(docs, "base")
    expected = [i for i, t in enumerate(TEXTS) if (m := plain_quality(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]]
    assert sorted(r["doc_id"] for r in kept.collect()) == expected and kept.columns == docs.columns
    bits = [r[0] for r in quality.with_ledger(docs).select("ledger.failed").collect()]
    report = {r["rule"]: r for r in quality.ablation(quality.with_ledger(docs), "v1").collect()}
    for rule in quality.RULES:
        bit = 1 << rule.bit
        r = report[rule.name]
        assert (r["n_failed"], r["n_only"], r["n_kept_without"]) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))


def test_policy_v2_judges_any_script(spark):
    clean = {
        1: "Компания IBM сегодня сообщила что новые машины будут готовы к концу этого года и очень дёшевы",
        2: "Η εταιρεία IBM ανακοίνωσε σήμερα ότι οι νέες μηχανές θα είναι έτοιμες στο τέλος του χρόνου",
        3: " ".join(f"{k}今天天气很好我们一起去公园散步然后回家吃饭。" for k in range(12)),
        4: " ".join(f"{k}วันนี้อากาศดีเราไปเดินเล่นที่สวนสาธารณะด้วยกัน" for k in range(12)),
    }
    bad = {5: clean[1].upper(), 6: "THIS TEXT IS SHOUTED FROM ITS FIRST TO ITS VERY LAST WORD", 7: " ".join("x" * 20 + str(k) for k in range(12))}
    rows = spark.createDataFrame(list((clean | bad).items()), "doc_id long, text string")
    assert {r["doc_id"] for r in quality.apply_policy(rows, "v2").collect()} == set(clean)
    assert quality.with_ledger(rows, any_script=False).filter("ledger.failed >= 128").count() == 0
    assert {r["doc_id"] for r in pipeline.quality_stage(spark, rows, "").collect()} == set(clean)


# ---- language ----


def test_language(spark):
    rnd, words = random.Random(1), {"aa": "the of and there with".split(), "bb": "der und nicht eine für".split(), "cc": "les être une dans où".split()}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "", "bb"), (902, "12 ... 9", None), (903, "Ω", None)], "doc_id long, text string, lang string")
    filters = langid.fit(docs)
    got = {r["doc_id"]: (r["p"]["lang_pred"], r["p"]["score"]) for r in docs.withColumn("p", langid.identify(filters, F.col("text"))).collect()}
    assert sum(got[i][0] == k for i, _, k in rows) == len(rows) and all(0 <= s <= 1 for _, s in got.values())
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3 and got[903][0] in words
    unknown = langid.fit(docs.filter("lang is null"))
    assert unknown.predict(pa.array(["the of"]))[0] == ["und"]


def test_bit_slices_hold_every_gram_and_correct_false_positives():
    grams = np.arange(0, 40_000, dtype=np.uint32)
    masks = (grams % 3 == 0).astype(np.uint64) | ((grams % 5 == 0).astype(np.uint64) << np.uint64(1))
    f = langid.LanguageFilters.build(["a", "b"], grams, masks, bits=1 << 16)
    hit = f.lookup(grams)[0]
    assert ((hit & masks) == masks).all()  # no false negatives
    absent = np.arange(10**6, 10**6 + 50_000, dtype=np.uint32)
    rate = [((f.lookup(absent)[0] >> k) & 1).mean() for k in range(2)]
    assert np.allclose(rate, f.false_positive, rtol=0.2)


# ---- near copies ----


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("limit", [jaccard.CHUNK_SHINGLES, 600, 60])  # the small ones cut blocks into chunks
def test_near_copies(docs, limit):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(docs, chunk=limit).collect()}
    assert got == plain_components(list(enumerate(TEXTS)))


def test_near_copies_of_few_or_odd_rows(spark, nothing):
    assert jaccard.near_copies(nothing).count() == 0
    odd = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b"), (5, None), (6, "A  B")], "doc_id long, text string")
    got = sorted(jaccard.near_copies(odd).collect(), key=str)
    assert sorted((r["n_shingles"], r["component_id"]) for r in got) == [(0, 5), (1, 3), (1, 3), (1, 3), (1, 3)]
    assert sorted(str(r["doc_id"]) for r in jaccard.one_of_each(odd).collect())[:2] == ["3", "3"]


def test_search_divides_lists_and_misses_nothing():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = [np.unique(np.where(rnd.random(400) < p, rnd.integers(0, 1 << 60, 400).astype(np.uint64), base)) for p in np.linspace(0, 0.3, 300)]
    index, alive = jaccard.Index(sets), np.ones(300, bool)
    for x in (0, 150, 299):
        expected = [j for j, s in enumerate(sets) if j != x and 100 * len(np.intersect1d(s, sets[x])) >= 75 * len(np.union1d(s, sets[x]))]
        assert [j for j in index.search(x, alive).tolist() if j != x] == expected


def near_sets(n, rates):
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 1 << 60, n).astype(np.uint64)
    return [np.unique(np.where(rnd.random(n) < p, rnd.integers(0, 1 << 60, n).astype(np.uint64), base)) for p in rates]


def test_large_groups_are_searched_by_bits(monkeypatch):
    """Rows around the least similarity: what the heap reads stays near the group's size, not its square."""
    sets, read = near_sets(200, np.linspace(0.1, 0.22, 300)), []
    merge = jaccard.merge_skip
    monkeypatch.setattr(jaccard, "merge_skip", lambda members, begin, end, least: read.append(sum(end) - sum(begin)) or merge(members, begin, end, least))
    label = jaccard.link_components(sets)
    links = [(i, j) for i, s in enumerate(sets) for j in range(i) if 100 * len(np.intersect1d(s, sets[j])) >= 75 * len(np.union1d(s, sets[j]))]
    a, b = np.array(links).T
    nodes, roots = local_components(a, b)
    expected = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    assert label.tolist() == [expected.get(i, i) for i in range(300)] and len(set(label.tolist())) > 20
    assert sum(read) < 2 * sum(map(len, sets))


def test_queries_of_other_chunks_ask_for_the_chunks_rows_only():
    sets = near_sets(100, [0, 0, 0.02]) + [s + np.uint64(1) for s in near_sets(90, [0, 0])]  # the last two link with each other, the third row with the first two
    assert jaccard.link_components(sets, 2).tolist() == [0, 0, 0, 3, 4]
    assert jaccard.link_components([sets[0], sets[1], sets[3]], 2).tolist() == [0, 1, 2]  # queries of one chunk were searched there


def test_chunks_grow_with_the_load():
    assert [jaccard.chunk_shingles(n) for n in (0, 12_000_000, 60_000_000, 10**10)] == [50_000, 60_000, 300_000, 500_000]


def test_heap_merge_skips_and_counts():
    rnd = np.random.default_rng(6)
    for _ in range(60):
        lists = [np.sort(rnd.choice(120, rnd.integers(1, 50), replace=False)) for _ in range(rnd.integers(1, 12))]
        ends = np.cumsum([len(x) for x in lists])
        seen = collections.Counter(np.concatenate(lists).tolist())
        for least in range(1, len(lists) + 2):
            rows, counts = jaccard.merge_skip(memoryview(np.concatenate(lists)), [0, *ends[:-1].tolist()], ends.tolist(), least)
            assert list(zip(rows, counts, strict=True)) == sorted((r, n) for r, n in seen.items() if n >= least)


def test_components_by_contraction(spark):
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(-(1 << 40), 1 << 40, 300), rnd.integers(-(1 << 40), 1 << 40, 300)
    b[:150] = a[100:250]
    nodes, roots = local_components(a, b)
    edges = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges, finish=20).collect()}
    groups = lambda d: sorted(tuple(sorted(k for k in d if d[k] == r)) for r in set(d.values()))
    assert groups(got) == groups(dict(zip(nodes.tolist(), roots.tolist(), strict=True)))


# ---- mixing ----


def test_mix(docs, nothing):
    rows = {r["doc_id"]: r for r in mixing.mix_report(docs).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(TEXTS)}
    assert {i: r["size"] for i, r in rows.items()} == size
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    names = ["s0", "s1", "s2", None]
    total = {n: sum(size[i] for i in size if source[i] == n) for n in names}
    weight, capped, share = dict(zip(names, (5, 2, 1, 5), strict=True)), set(), 1.5 * sum(size.values())
    while True:
        level = (share - sum(2 * total[n] for n in capped)) / sum(weight[n] for n in names if n not in capped)
        more = {n for n in names if n not in capped and weight[n] * level > 2 * total[n]}
        if not more:
            break
        capped |= more
    for n in names:
        target = 2 * total[n] if n in capped else weight[n] * level
        mine = [r for i, r in rows.items() if source[i] == n]
        assert all(abs(r["target"] - target) < 1e-6 and r["source_size"] == total[n] and r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= max(size[i] for i in size if source[i] == n)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs.repartition(5)).collect()}
    assert again == {i: r["taken"] for i, r in rows.items()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({i: r["copies"] for i, r in rows.items() if r["copies"]})
    assert mixing.mix_report(nothing).count() == 0


def test_radix_descent_hits_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EXACT_ROWS", 40)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "if(id % 3 = 0, 'a', if(id % 7 = 0, 'b', 'c')) as source")
    sums = mixing.mix_report(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert len(sums) == 3 and all(abs(r["t"] - r["target"]) <= 2 for r in sums)


# ---- tokens ----


def test_bpe_equals_the_library(docs):
    import tiktoken

    path = str(P.path("byte_bpe_multi_50k.tiktoken"))
    v = bpe.vocabulary(path, P.PATTERN)
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    odd = ["a" * 5000, " " * 3000, "ab" * 900, "<|endoftext|> it's 12,5€ 東京 👩‍👧", "\n\n \t x"]
    assert [x.tolist() for x in v.encode_batch(odd)] == [library.encode_ordinary(t) for t in odd]
    for r in docs.select("text", bpe.round_trip(F.col("text"), path, P.PATTERN).alias("c"), bpe.decode(bpe.encode(F.col("text"), path, P.PATTERN), path, P.PATTERN).alias("d")).collect():
        ids, raw = library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()
        assert r["c"]["n_tokens"] == len(ids) and bytes(r["d"]) == raw
        assert r["c"]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["c"]["decoded_sha256"] == hashlib.sha256(raw).hexdigest()


@pytest.mark.parametrize("seed", range(6))
def test_replay_keeps_the_classic_order(seed):
    """Vocabularies in which a merge can make a pair of lower rank."""
    import tiktoken

    rnd = random.Random(seed)
    more = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(2, 6))) for _ in range(60)})
    rnd.shuffle(more)
    ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(more)}
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 50))) for _ in range(200)]
    assert [x.tolist() for x in bpe.Vocabulary(ranks, P.PATTERN).encode_batch(words)] == [library.encode_ordinary(w) for w in words]


# ---- pages ----


def test_page_lines_and_main_text():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c <p>x</p> --><div class="ad">Buy</div>
    <div id="cookie-notice">OK?</div><article><h1>Title &amp; more</h1><p>One <b>bold
     word</b>.<br><p>Two&nbsp;x &#233;<div class="comments">I say</div><form>f</form></article><aside>side</aside><footer>&copy; me</footer>"""
    assert html_extract.main_text(html_extract.lines_of(page), None) == "Title & more\nOne bold word.\nTwo x é"
    assert html_extract.lines_of(None) == [] and html_extract.lines_of("plain < text &am") == [("plain < text &am", 0)]


def test_shared_lines_are_a_longest_common_subsequence():
    rnd = random.Random(2)
    for _ in range(60):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html_extract.shared_lines(a, b))
        it = iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in it for i in found)


def test_differencing_deletes_a_template_without_landmarks(spark, nothing):
    body = lambda k: f"<div>Home</div><div>News</div><p>Own text number {k}</p><div>Imprint</div>"
    same = "<nav>n</nav><article><p>Copied</p></article>"
    rows = [(k, f"http://h.example/a/{k}", body(k)) for k in range(5)] + [(k, f"http://g.example/b/{k}", same) for k in (7, 8)] + [(9, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    assert all(got[k][1] == f"Own text number {k}" for k in range(5)) and got[7][1] == got[8][1] == "Copied" and got[9] == (None, "", 0)
    assert html_extract.extract(pages.filter("page_id < 0")).count() == 0


def test_differencing_decides_inside_an_article():
    page = lambda *own: html_extract.lines_of("<article>" + "".join(f"<p>{x}</p>" for x in ("Share", *own, "Read more")) + "</article>Imprint")
    one, other = page("The first article's own text.", "Its end."), page("Quite another story, told at length.")
    assert html_extract.main_text(one, other) == "The first article's own text.\nIts end."
    revised = page("The first article's own text.", "Its end, revised.")
    assert html_extract.main_text(one, revised) == html_extract.main_text(one, None) == "Share\nThe first article's own text.\nIts end.\nRead more"


def test_copies_without_landmarks_keep_their_text(spark):
    page = lambda *own: "".join(f"<div>{x}</div>" for x in ("Home", "News", *own, "Imprint"))
    long = "A text of some length that is copied under neighbouring paths, with much more to say than the site's menu. " * 3
    rows = [(k, f"http://h.example/a/{k:03}", page(long.strip())) for k in range(30)]
    rows += [(k, f"http://h.example/a/{k:03}", page(long.strip(), f"Copy {k}")) for k in range(30, 33)]
    rows += [(40, "http://h.example/b/1", page("Another text.")), (41, "http://h.example/b/2", page()), (42, "http://h.example/b/3", page("A third one."))]
    rows += [(k, f"http://only.example/{k}", "<p>Nothing but copies</p>") for k in (50, 51)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert all(got[k] == long.strip() for k in range(30)) and all(got[k] == f"{long.strip()}\nCopy {k}" for k in range(30, 33))
    assert [got[k] for k in (40, 41, 42, 50, 51)] == ["Another text.", "", "A third one.", "Nothing but copies", "Nothing but copies"]


def test_pairs_do_not_depend_on_the_number_of_pages_or_ranges(spark):
    sibling = lambda k: f"<div>Home</div><div>Section {k // 2}</div><p>Own text of page {k}</p>"
    rows = [(k, f"http://h.example/a/{k // 2:03}-{k % 2}", sibling(k)) for k in range(500)]
    rows += [(k, f"http://h.example/b/{k}", "<div>Home</div><p>A copied text of more length than the menu</p>") for k in range(1000, 1100)] + [(1100, "http://h.example/c/", "<div>Home</div><p>Last</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = lambda **more: {r["page_id"]: r["text"] for r in html_extract.extract(pages, **more).collect()}
    first = found()
    assert first == {k: f"Own text of page {k}" for k in range(500)} | dict.fromkeys(range(1000, 1100), "A copied text of more length than the menu") | {1100: "Last"}
    assert found(parts=1) == found(parts=23) == first


def test_a_word_in_a_name_does_not_lose_the_article():
    text = lambda html: html_extract.main_text(html_extract.lines_of(html), None)
    for wrapper in ("site has-sidebar", "no-sidebar", "sidebar", "page comments-open"):
        assert text(f'<div class="{wrapper}"><p>menu</p><article class="post comments-open"><p>Own</p></article></div>') == "Own"
        assert text(f'<form><div id="{wrapper}"><main role="search"><p>Own</p></main></div></form>') == "Own"
    inside = '<h1 class="header">A</h1><section id="related-work"><h2 id="search">B</h2><p>C</p></section>'
    assert text(f"<article>{inside}</article>") == "A\nB\nC"
    assert text('<div class="no-sidebar"><p>Own</p></div><div class="sidebar">s</div><div id="cookie-notice">c</div><div class="site-footer">f</div>') == "Own"
    assert text('<article>Own<section class="comments"><article>I say</article></section></article><aside><article>Teaser</article></aside>') == "Own"


def test_urls(spark):
    urls = {
        1: "https://WWW.Example.com/en/x?y#z", 2: "http://a.example.com/en/", 3: "http://example.com/fr/", 4: "http://x.net/es/1", 5: "http://net/es", 6: None, 7: "no scheme",
        8: "http://com/", 9: "http://notexample.com/en/", 10: "https://example.com?u=http://b.net/es/", 11: "http://x.org/en/", 12: "http://www.example.com:80/en/",
    }
    pages = spark.createDataFrame(list(urls.items()) + [(20 + i, "http://b.example.com/en/") for i in range(200)], "page_id long, url string")

    def plain(u):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    for parts in (1, 7):
        got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(pages, urlfilter.rule_table(spark), parts=parts).collect()}
        assert got == {i: plain(u) for i, u in urls.items()} | {20 + i: plain("http://b.example.com/en/") for i in range(200)}


# ---- media and archives ----


def test_telephony_tables_and_adpcm():
    assert telephony.MULAW_TABLE[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0] and telephony.ALAW_TABLE[[0, 85, 213, 170]].tolist() == [-5504, -8, 8, 32256]
    rnd = np.random.default_rng(1)
    blocks = rnd.integers(0, 256, (7, 64)).astype(np.uint8)

    def one(block):
        value, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(int(block[2]), 88)
        out = [value]
        for k in range(120):
            n = (int(block[4 + k // 2]) >> (4 * (k % 2))) & 15
            step = int(telephony.IMA_STEPS[index])
            d = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            index = max(0, min(88, index + int(telephony.IMA_MOVES[n & 7])))
            out.append(value)
        return out

    assert telephony.decode_ima(blocks).tolist() == [one(b) for b in blocks]
    x = np.array([0, 100, 200, 300], np.int16)
    assert telephony.resample(x)[0::2].tolist() == x.tolist() and telephony.resample(x)[3] == 150


def test_media_round_trip(docs):
    got = docs.select("text", telephony.stored(F.col("text")).alias("s")).select("text", "s.*", telephony.digest(F.col("s.media")).alias("d"), telephony.pcm(F.col("s.media")).alias("p")).collect()
    for r in got:
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        d = r["d"]
        assert (r["n_bytes"], d["payload_bytes"], d["payload_sha256"], d["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert d["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and d["media_bytes"] == len(r["media"]) and d["pcm_sha256"] == hashlib.sha256(bytes(r["p"])).hexdigest()
        assert telephony.parse_wave(bytes(r["p"]))[:2] == (telephony.PCM, 16000)
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r["text"] or ""].add((r["d"]["feature"], r["d"]["media_sha256"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_archives(spark, tmp_path):
    htmls = ["<p>a</p>", "<p>b</p>", "", None, "<p>a</p>", "x" * 700_000, "<p>a</p>", "é" * 10]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\n", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").repartition(2)
    archives = warc.bundles(pages).cache()
    got = {r["page_id"]: tuple(r)[1:] for r in warc.read_all(archives).collect()}
    for i, h in enumerate(htmls):
        payload = (h or "").encode()
        first = max(j for j, x in enumerate(htmls) if (x or "") == (h or ""))
        assert got[i] == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first == i else "revisit", None if first == i else first)
    wanted = spark.createDataFrame([(warc.record_id(5),), (warc.record_id(99),)], "record_id string")
    (hit,) = warc.fetch(archives, wanted).collect()
    assert warc.parse_record(bytes(hit["raw"]))[2] == b"x" * 700_000
    assert warc.read_all(warc.bundles(pages, least_bytes=100)).filter("record_type = 'revisit'").count() == 0
    for r in warc.export(archives, str(tmp_path)).collect():
        import zstandard

        with open(r["path"], "rb") as f:
            assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().startswith(b"WARC/1.1\r\n")
    assert warc.read_all(warc.bundles(pages.filter("page_id < 0"))).count() == 0


# ---- toxicity ----


def test_toxicity(spark):
    rnd = random.Random(9)
    words, bad = [f"word{i}" for i in range(300)], ["awful", "vile", "nasty"]
    rows = []
    for i in range(900):
        toxic = i % 6 == 0
        w = [rnd.choice(words) for _ in range(40)] + ([rnd.choice(bad) for _ in range(4)] if toxic else [])
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 500], "doc_id long, toxic int")
    model = toxicity.fit(docs.filter("doc_id < 500"), labels)
    odd = spark.createDataFrame([(2000, None), (2001, "")], "doc_id long, text string")
    score = {r["doc_id"]: r["s"] for r in docs.union(odd).withColumn("s", toxicity.score(model, F.col("text"))).collect()}
    assert all((score[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 500) and score[2000] == score[2001] < 0.5
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert none.scores(pa.array(["vile"])).tolist() == [0.0]


def test_blocks_keep_rows_whole():
    col = pa.array(["ab", None, "c" * 50, "", "d"])
    parts = list(K.blocks(col, limit=10))
    assert [(b.first, b.n, bytes(b.data)) for b in parts] == [(0, 2, b"ab"), (2, 1, b"c" * 50), (3, 2, b"d")]
