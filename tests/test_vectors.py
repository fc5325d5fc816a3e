"""The persisted vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import vector
from facetry.schema import Field, SearchSchema


@pytest.mark.parametrize("kind", ["COSINE", "EUCLIDEAN", "DOT_PRODUCT", "MAXIMUM_INNER_PRODUCT"])
def test_index_finds_nearly_all_neighbours(spark, tmp_path, kind):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 3
    x = np.concatenate([centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 8)), rng.normal(size=(100, 8)) * 4])
    schema = SearchSchema((Field("id", "STRING", key=True), Field("v", "VECTOR", dimension=8, similarity=kind), Field("n", "INT32", filterable=True)))
    rows = spark.createDataFrame([(str(k), [float(c) for c in v], k % 5, k) for k, v in enumerate(x)] + [("none", None, 0, 9000)], "id string, v array<float>, n int, _doc long")
    index = vector.VectorIndex.build(rows, schema, "v", str(tmp_path / "lists"))
    assert index.rows.count() == 800 and len(index.centroids) == 28 and index.probe <= 28
    ids = lambda df: [r["_doc"] for r in df.collect()]
    hit = total = 0
    for q in range(0, 800, 100):  # every hundredth row asks
        exact = ids(vector.knn(rows, schema, "v", x[q].tolist(), 10))
        assert ids(index.knn(x[q].tolist(), 10, probe=100)) == exact
        hit, total = hit + len(set(exact) & set(ids(index.knn(x[q].tolist(), 10)))), total + len(exact)
    assert hit >= 0.9 * total
    where = F.col("n") == 3
    assert ids(index.knn(x[3].tolist(), 5, 100, where)) == ids(vector.knn(rows, schema, "v", x[3].tolist(), 5, where))


def test_a_query_reads_its_lists_only(spark, tmp_path):
    schema = SearchSchema((Field("id", "STRING", key=True), Field("v", "VECTOR", dimension=2)))
    rows = spark.createDataFrame([(str(k), [float(k % 2), 1.0 - k % 2], k) for k in range(40)], "id string, v array<float>, _doc long")
    index = vector.VectorIndex.build(rows, schema, "v", str(tmp_path / "lists"), lists=2)
    plan = index.knn([1.0, 0.0], 3, probe=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_list" in plan
    empty = vector.VectorIndex.build(rows.filter("false"), schema, "v", str(tmp_path / "none"))
    assert empty.knn([1.0, 0.0], 3).count() == 0
