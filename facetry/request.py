"""Search requests as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Term:
    field: str
    value: str


@dataclass(frozen=True)
class Range:
    field: str
    min: str = ""
    max: str = ""
    min_exclusive: bool = False
    max_exclusive: bool = False


@dataclass(frozen=True)
class Exists:
    field: str
    must_exist: bool = True


@dataclass(frozen=True)
class GeoDistance:
    field: str
    lat: float
    lon: float
    meters: float


@dataclass(frozen=True)
class GeoBox:
    field: str
    top: float
    left: float
    bottom: float
    right: float


@dataclass(frozen=True)
class Compound:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    operator: str = "AND"  # accepted; only the three lists decide


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False
    geo_origin: tuple[float, float] | None = None


@dataclass(frozen=True)
class Facet:
    field: str
    count: int = 0
    sort: str = "COUNT_DESC"
    interval: float = 0.0
    values: tuple[str, ...] = ()
    date_interval: str = ""


@dataclass(frozen=True)
class Vector:
    field: str
    vector: tuple[float, ...]
    k: int = 0


@dataclass(frozen=True)
class Cursor:
    score: float = 0.0
    doc: int = -1
    values: tuple = ()


@dataclass(frozen=True)
class SearchRequest:
    text_query: str = ""
    text_field: str = ""
    phrase_query: str = ""
    phrase_field: str = ""
    phrase_slop: int = 0
    fuzzy_query: str = ""
    fuzzy_field: str = ""
    max_edits: int = 0
    prefix_length: int = 0
    prefix_query: str = ""
    prefix_field: str = ""
    query_string: str = ""
    default_field: str = ""
    vector: Vector | None = None
    text_weight: float = 0.0  # accepted and not used
    filters: tuple = ()
    tenant_id: str = ""
    sort: tuple[Sort, ...] = ()
    top_k: int = 0
    offset: int = 0
    search_after: Cursor | None = None
    min_score: float = 0.0
    include_source: bool = False
    source_fields: tuple[str, ...] = ()
    facets: tuple[Facet, ...] = ()
    half_life_seconds: int | None = None
    timeout_ms: int = 0
    now_ms: int = 0  # the clock of the request: results do not depend on when they run
    extra: dict = field(default_factory=dict, compare=False)

    def has_text(self) -> bool:
        return any(x.strip() for x in (self.text_query, self.phrase_query, self.fuzzy_query, self.prefix_query, self.query_string))
