"""Exact nearest neighbours, and a persisted index of inverted lists around coarse centroids.

The index keeps every row, partitioned by its nearest centroid; a query scores the rows of the lists whose centroids
are nearest to it, exactly, and reads no other files.  ``probe`` says how many lists (all of them give the exact
result); without it as many as gave the build's wanted recall on its sample, where neighbours were looked up exactly.
Centroids are fitted on a bounded sample of ``SAMPLE`` rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.vectors import similarity_score
from facetry.schema import SearchSchema

DEFAULT_K = 10


def knn(df: DataFrame, schema: SearchSchema, field: str, vector, k: int = 0, where: Column | None = None) -> DataFrame:
    """The k nearest rows among those that pass the filter, scored; one top-k pass without a full sort."""
    f = schema.get(field)
    if f.type != "VECTOR":
        raise ValueError(f"Field {field} is not a vector")
    if not vector or (f.dimension and len(vector) != f.dimension):
        raise ValueError(f"A vector of {f.dimension} numbers is needed, not {len(vector)}")
    rows = df.filter(F.col(field).isNotNull() & (F.size(field) == len(vector)))
    rows = rows if where is None else rows.filter(where)
    scored = rows.withColumn("_score", similarity_score(f.similarity, F.col(field), vector))
    return scored.orderBy(F.desc("_score"), "_doc").limit(k if k > 0 else DEFAULT_K)


#: Rows that centroids are fitted on, at most about.
SAMPLE = 20_000
ROUNDS = 12
#: Sampled rows whose neighbours say how many lists are needed.
ASKED, NEIGHBOURS = 200, 10


def _unit(kind: str, x: np.ndarray) -> np.ndarray:
    """Vectors as lists are built on: for cosine by direction, else as they are."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if kind == "COSINE" else x


def fit_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Means of Lloyd's algorithm; an empty list takes the point that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        distance = nearest_distances(x, centroids)
        near = distance.argmin(axis=1)
        n = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        far = np.argsort(-distance[np.arange(len(x)), near], kind="stable")[: int((n == 0).sum())]
        total[n == 0], n[n == 0] = x[far], 1
        centroids = total / n[:, None]
    return centroids


def nearest_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, without the points' own squares, which change no order."""
    return (centroids * centroids).sum(axis=1) - 2 * x @ centroids.T


def _list_order(kind: str, q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Lists of each query, nearest first."""
    inner = kind in ("DOT_PRODUCT", "MAXIMUM_INNER_PRODUCT")
    return np.argsort(-(q @ centroids.T) if inner else nearest_distances(q, centroids), axis=1, kind="stable")


def lists_needed(kind: str, x: np.ndarray, centroids: np.ndarray, recall: float) -> int:
    """So many nearest lists hold that part of the neighbours of sampled rows."""
    q = x[:: max(1, len(x) // ASKED)]
    near = np.argsort(-(q @ x.T) if kind != "EUCLIDEAN" else nearest_distances(q, x), axis=1, kind="stable")[:, :NEIGHBOURS]
    own = nearest_distances(x, centroids).argmin(axis=1)
    place = np.argsort(_list_order(kind, q, centroids), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


@dataclass
class VectorIndex:
    rows: DataFrame  # with a column ``_list``
    centroids: np.ndarray
    schema: SearchSchema
    field: str
    probe: int

    @classmethod
    def build(cls, df: DataFrame, schema: SearchSchema, field: str, path: str, lists: int | None = None, recall: float = 0.97) -> VectorIndex:
        """Writes the rows of ``df`` that have the vector, one folder for each list."""
        f = schema.get(field)
        whole = df.filter(F.col(field).isNotNull() & (F.size(field) > 0))
        n = whole.count()
        share = min(1.0, SAMPLE / max(1, n))
        sample = whole.filter(F.pmod(F.xxhash64("_doc"), F.lit(1 << 30)) < int(share * (1 << 30))).select(field).toArrow()
        x = _unit(f.similarity, np.array(sample.column(0).to_pylist(), dtype=np.float64).reshape(sample.num_rows, -1 if sample.num_rows else 1))
        centroids = fit_centroids(x, lists or max(1, int(n**0.5))) if len(x) else np.zeros((1, f.dimension or 1))
        probe = lists_needed(f.similarity, x, centroids, recall) if len(x) else 1

        @F.arrow_udf("int")
        def list_of(v: pa.Array) -> pa.Array:
            y = _unit(f.similarity, v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1))
            return pa.array(nearest_distances(y, centroids).argmin(axis=1).astype(np.int32))

        # A large list is dealt over several files by row number.
        placed = whole.withColumn("_list", list_of(F.col(field)))
        placed.write.mode("overwrite").partitionBy("_list").parquet(path)
        return cls(df.sparkSession.read.schema(placed.schema).parquet(path), centroids, schema, field, probe)

    def knn(self, vector, k: int = 0, probe: int = 0, where: Column | None = None) -> DataFrame:
        """The k nearest rows of the ``probe`` nearest lists, scored."""
        kind = self.schema.get(self.field).similarity
        order = _list_order(kind, _unit(kind, np.array([vector], dtype=np.float64)), self.centroids)[0]
        chosen = [int(c) for c in order[: probe or self.probe]]
        return knn(self.rows.filter(F.col("_list").isin(chosen)), self.schema, self.field, vector, k, where).drop("_list")
