"""Collection schemas: declared fields with types and capabilities, as Spark columns."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

GEO = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
SCALARS = {
    "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "INT32": T.IntegerType(), "INT64": T.LongType(), "DOUBLE": T.DoubleType(),
    "DATE_TIME_OFFSET": T.LongType(), "GEO_POINT": GEO,
}
#: Names of all field types; dates are epoch milliseconds.
TYPES = {**SCALARS, "VECTOR": T.ArrayType(T.FloatType()), **{f"{k}_COLLECTION": T.ArrayType(v) for k, v in SCALARS.items()}}
ALIASES = {"FLOAT": "DOUBLE"}
SIMILARITIES = ("COSINE", "DOT_PRODUCT", "EUCLIDEAN", "MAXIMUM_INNER_PRODUCT")
#: Columns that a collection with expiry has besides its own.
SYSTEM = (("_memory_tier", T.StringType()), ("_ttl_expires_at", T.LongType()), ("_indexed_at", T.LongType()), ("_tenant_id", T.StringType()))


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    key: bool = False
    searchable: bool = False
    filterable: bool = False
    sortable: bool = False
    facetable: bool = False
    index_analyzer: str = "standard"
    search_analyzer: str = "standard"
    dimension: int | None = None
    similarity: str = "COSINE"

    @property
    def is_collection(self) -> bool:
        return self.type.endswith("_COLLECTION")

    @property
    def base(self) -> str:
        return self.type.removesuffix("_COLLECTION")

    @property
    def is_text(self) -> bool:
        return self.base == "STRING"

    @property
    def is_numeric(self) -> bool:
        return self.base in ("INT32", "INT64", "DOUBLE", "DATE_TIME_OFFSET")


@dataclass(frozen=True)
class SearchSchema:
    fields: tuple[Field, ...]
    k1: float = 1.2
    b: float = 0.75
    ttl_enabled: bool = False
    hnsw: dict = field(default_factory=dict)  # accepted; exact search needs none of it

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError("field names must be unique")
        for f in self.fields:
            if f.type not in TYPES:
                raise ValueError(f"Unknown field type {f.type} of field {f.name}")
            if f.similarity not in SIMILARITIES:
                raise ValueError(f"Unknown similarity {f.similarity} of field {f.name}")
        keys = [f for f in self.fields if f.key]
        if len(keys) != 1:
            raise ValueError(f"Schema must have exactly one key field, found {len(keys)}")
        if keys[0].type != "STRING":
            raise ValueError("The key field must be a STRING")

    @property
    def key(self) -> str:
        return next(f.name for f in self.fields if f.key)

    def get(self, name: str) -> Field:
        found = next((f for f in self.fields if f.name == name), None)
        if found is None:
            raise ValueError(f"Unknown field: {name}")
        return found

    def searchable_text(self) -> list[Field]:
        return [f for f in self.fields if f.searchable and f.is_text]

    def struct(self) -> T.StructType:
        """Document columns with their capabilities as metadata, and the system columns where documents expire."""
        own = [T.StructField(f.name, TYPES[f.type], True, {k: v for k, v in asdict(f).items() if v is not None}) for f in self.fields]
        return T.StructType(own + [T.StructField(n, t) for n, t in SYSTEM if self.ttl_enabled])

    def to_json(self) -> str:
        names = {"index_analyzer": "indexAnalyzer", "search_analyzer": "searchAnalyzer", "similarity": "similarityFunction"}
        fields = [{names.get(k, k): v for k, v in asdict(f).items() if v is not None} for f in self.fields]
        return json.dumps({"fields": fields, "bm25Config": {"k1": self.k1, "b": self.b}, "ttlEnabled": self.ttl_enabled, "hnswConfig": self.hnsw})

    @classmethod
    def from_json(cls, text: str) -> SearchSchema:
        raw = json.loads(text)
        fields = []
        for x in raw.get("fields", []):
            kind = ALIASES.get(x["type"], x["type"])
            fields.append(
                Field(
                    x["name"], kind, *[bool(x.get(k, False)) for k in ("key", "searchable", "filterable", "sortable", "facetable")],
                    x.get("indexAnalyzer") or "standard", x.get("searchAnalyzer") or x.get("indexAnalyzer") or "standard",
                    x.get("dimension", x.get("dimensions")), x.get("similarityFunction") or "COSINE",
                )
            )
        bm25 = raw.get("bm25Config") or {}
        return cls(tuple(fields), bm25.get("k1", 1.2), bm25.get("b", 0.75), bool(raw.get("ttlEnabled", False)), raw.get("hnswConfig") or {})

    def with_ttl(self) -> SearchSchema:
        return replace(self, ttl_enabled=True)
