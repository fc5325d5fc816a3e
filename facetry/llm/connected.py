"""Connected components of an edge table, by contraction.

Each round every node takes the smallest id among itself and its neighbours; edges are renamed to those ids and
made distinct, and the smaller graph is solved in the same way.  Ids should be in random order (hashes), so that
a round removes a constant share of the nodes.  Once few edges remain, one task finishes them with union-find.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.spark_utils import cut

#: Edges that one task takes (16 bytes each); above it another round of contraction follows.
FINISH_EDGES = 300_000


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edges with the same components: each node with the smallest of its component."""
    nodes, roots = local_components(a, b)
    keep = nodes != roots
    return roots[keep], nodes[keep]


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(), batch.column(1).to_numpy()


def _thin(batches):
    for batch in batches:
        if batch.num_rows:
            a, b = forest(*_arrays(batch))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _finish(batches):
    got = [_arrays(b) for b in batches if b.num_rows]
    if got:
        nodes, roots = local_components(np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame, finish: int = FINISH_EDGES) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (long, not null); root is the component's smallest node
    where one task finished the graph, and one of its nodes otherwise."""
    held = cut(edges.select("a", "b").mapInArrow(_thin, "a long, b long"))
    if held.count() <= finish:
        return held.coalesce(1).mapInArrow(_finish, "node long, root long")
    both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parent = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p")))
    first = parent.select(F.col("node").alias("a"), F.col("p").alias("pa"))
    second = parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
    renamed = held.join(first, "a").join(second, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct()
    rest = components(renamed, finish)
    return parent.join(rest.withColumnRenamed("node", "p"), "p", "left").select("node", F.coalesce("root", "p").alias("root"))
