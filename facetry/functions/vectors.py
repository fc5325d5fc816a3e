"""Vector similarities as scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _scores(kind: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of the rows of ``x``."""
    if kind == "EUCLIDEAN":
        return 1 / (1 + ((x - q) ** 2).sum(axis=1))
    product = x @ q
    if kind == "COSINE":
        with np.errstate(divide="ignore", invalid="ignore"):
            return (1 + product / (np.sqrt((x * x).sum(axis=1)) * np.sqrt(q @ q))) / 2
    if kind == "DOT_PRODUCT":
        return (1 + product) / 2
    return np.where(product < 0, 1 / (1 - np.minimum(product, 0)), product + 1)


def similarity_score(kind: str, column: Column, query) -> Column:
    """Score of a vector column against a literal vector; higher is nearer.

    A batch of vectors is one matrix in Arrow's own memory, so a row costs a product, not a step of an interpreter for
    each number.  Vectors that are null, of another length, or hold a null have no score.
    """
    q = np.array([float(x) for x in query])

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(v), len(q)), False).to_numpy(zero_copy_only=False)
        flat = v.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)  # a null number is nan
        out = np.full(len(v), np.nan)
        out[fits] = _scores(kind, flat.astype(np.float64).reshape(-1, len(q)), q)
        return pa.array(out, mask=np.isnan(out))

    return run(column)
