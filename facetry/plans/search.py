"""One search request as DataFrame plans: matched rows, a page of them, facets, and the total."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators import facets as facet_ops
from facetry.operators import paging, text, vector
from facetry.operators.filters import combine
from facetry.operators.hybrid import rrf
from facetry.operators.modifiers import pipeline, recency_decay
from facetry.request import Cursor, SearchRequest
from facetry.schema import SearchSchema
from facetry.sources.postings import TextIndex


@dataclass
class SearchPlan:
    """Lazy results of a request; each is a plan until an action asks for it."""

    matched: DataFrame
    rows: DataFrame  # of the page, with all columns
    page: DataFrame  # as hits
    facets: DataFrame | None = None
    n_sort: int = 0
    held: list[DataFrame] = field(default_factory=list)  # what was persisted for it

    def total(self) -> int:
        return self.matched.count()

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


@dataclass
class SearchResult:
    hits: list
    total: int
    exact: bool
    facets: dict[str, list]
    next: Cursor | None
    timed_out: bool = False


def _with_filter(df: DataFrame, where: Column | None) -> DataFrame:
    return df if where is None else df.filter(where)


def matched_rows(docs: DataFrame, schema: SearchSchema, r: SearchRequest, index: TextIndex | None = None, held: list | None = None) -> DataFrame:
    """All rows that the request's query and filters match, with ``_score``."""
    where = combine(schema, r.filters, r.tenant_id)
    node = text.resolve(schema, r)
    if node is not None:
        scored = _with_filter(text.score(docs, schema, node, index, held), where)
    elif r.vector is not None:
        scored = vector.knn(docs, schema, r.vector.field, r.vector.vector, r.vector.k, where)
    else:
        scored = _with_filter(docs, where).withColumn("_score", F.lit(1.0))
    return pipeline(scored, _modifiers(schema, r))


def _best_ids(schema: SearchSchema, r: SearchRequest, index: TextIndex | None) -> DataFrame | None:
    """``_doc, _score`` where the index alone decides the page, so that only the page's rows are read; else None."""
    node = text.resolve(schema, r)
    plain = not (r.filters or r.tenant_id or r.sort or r.facets or _modifiers(schema, r))
    return text.score_ids(schema, node, index) if node is not None and index is not None and index.live and plain else None


def _modifiers(schema: SearchSchema, r: SearchRequest) -> list:
    return [recency_decay(r.half_life_seconds, r.now_ms)] if r.half_life_seconds is not None and schema.ttl_enabled else []


def _hybrid(docs: DataFrame, schema: SearchSchema, r: SearchRequest, index: TextIndex | None, held: list) -> tuple[DataFrame, DataFrame]:
    if r.facets:
        raise ValueError("Facets are not supported in hybrid search")
    skip, k = paging.offset(r.offset), paging.top_k(r.top_k)
    where, n = combine(schema, r.filters, r.tenant_id), skip + k
    by_text = _best_ids(schema, replace(r, sort=()), index)  # a sort is left aside here
    if by_text is None:
        by_text = pipeline(_with_filter(text.score(docs, schema, text.resolve(schema, r), index, held), where), _modifiers(schema, r))
    by_text = by_text.orderBy(F.desc("_score"), "_doc").limit(n).select("_doc", "_score")
    by_vector = vector.knn(docs, schema, r.vector.field, r.vector.vector, r.vector.k or n, where)
    fused = rrf([by_text, by_vector], n)
    best = docs.join(F.broadcast(fused), "_doc").select(*docs.columns, "_score")  # at most MAX_TOP + MAX_OFFSET rows
    return fused, best.orderBy(F.desc("_score"), "_doc").offset(skip).limit(k).orderBy(F.desc("_score"), "_doc")


def _some_fields(page: DataFrame, names: list[str]) -> Column:
    """Top-level fields as JSON: from the stored document, with whatever they hold, where it is kept; else from columns."""
    if "_src" not in page.columns:
        return F.to_json(F.struct(*names))
    stored = F.parse_json("_src")
    return F.to_json(F.struct(*[F.variant_get(stored, f"$['{n}']", "variant").alias(n) for n in names]))


def project(page: DataFrame, schema: SearchSchema, r: SearchRequest) -> DataFrame:
    """Hits: ``doc_id, _score, _doc``, sort keys, and ``source`` where it is asked for."""
    keys = [c for c in page.columns if c.startswith("_sort")]
    out = [F.col(schema.key).alias("doc_id"), "_score", "_doc", *keys]
    if r.source_fields:
        known = [f.name for f in schema.fields if f.name in r.source_fields]
        out.append(_some_fields(page, known).alias("source") if known else F.lit("{}").alias("source"))
    elif r.include_source:
        out.append(F.col("_src").alias("source") if "_src" in page.columns else F.to_json(F.struct(*[f.name for f in schema.fields])).alias("source"))
    return page.select(*out)


def plan(docs: DataFrame, schema: SearchSchema, r: SearchRequest, index: TextIndex | None = None) -> SearchPlan:
    """``docs`` has the schema's columns and ``_doc``, the row's number in ingest order; ``index`` its postings."""
    n_sort, found, held = 0, None, []
    if r.vector is not None and r.has_text():
        matched, rows = _hybrid(docs, schema, r, index, held)
    elif (ids := _best_ids(schema, r, index)) is not None:
        matched = ids
        best = paging.page(ids, schema, r.top_k, r.offset, (), r.search_after)
        # At most MAX_TOP rows; the limit, which cuts none, orders them without a second look at ranges.
        rows = docs.join(F.broadcast(best), "_doc").orderBy(F.desc("_score"), "_doc").limit(paging.top_k(r.top_k))
    else:
        matched = matched_rows(docs, schema, r, index, held)
        rows = paging.page(matched, schema, r.top_k, r.offset, r.sort, r.search_after)
        n_sort, found = len(r.sort), facet_ops.facets(matched, schema, r.facets) if r.facets else None
    if r.min_score > 0 and not n_sort:  # after paging: the page is not filled up again
        rows = rows.filter(F.col("_score") >= r.min_score)
    return SearchPlan(matched, rows, project(rows, schema, r), found, n_sort, held)


DEFAULT_TIMEOUT_MS = 30_000


def run(docs: DataFrame, schema: SearchSchema, r: SearchRequest, cache: bool = True, index: TextIndex | None = None) -> SearchResult:
    """Runs a request.  Matched rows feed the page, the total and the facets, so they are kept for the time of it."""
    sc = docs.sparkSession.sparkContext
    p = plan(docs, schema, r, index)
    limit = DEFAULT_TIMEOUT_MS if r.timeout_ms == 0 else r.timeout_ms
    group, late = f"search-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(limit / 1000, stop) if limit > 0 else None
    sc.setJobGroup(group, "search", interruptOnCancel=True)
    if cache and r.facets:
        p.held.append(p.matched.persist())
    if timer:
        timer.start()
    try:
        hits = p.page.collect()
        total = p.total()
        found = facet_ops.by_field(p.facets.collect(), r.facets) if p.facets is not None else {}
    except Exception:
        if late.is_set():
            return SearchResult([], 0, False, {}, None, True)
        raise
    finally:
        if timer:
            timer.cancel()
        p.release()
        sc.setLocalProperty("spark.jobGroup.id", None)
    return SearchResult(hits, total, r.min_score <= 0, found, paging.cursor(hits, p.n_sort))


def count(docs: DataFrame, schema: SearchSchema, filters=(), tenant: str = "") -> DataFrame:
    return _with_filter(docs, combine(schema, filters, tenant)).agg(F.count("*").alias("count"))


def lookup(docs: DataFrame, schema: SearchSchema, keys) -> DataFrame:
    """Rows of the keys that exist, in ingest order; neither tenant nor expiry counts."""
    return docs.filter(F.col(schema.key).isin([str(k) for k in keys])).orderBy("_doc")
