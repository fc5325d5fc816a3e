"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lists: list[DataFrame], top: int, doc: str = "_doc") -> DataFrame:
    """``_doc, _score`` of the best rows of lists that are each already cut to their best rows (bounded, so one
    task can rank them)."""
    best = Window.orderBy(F.desc("_score"), doc)
    parts = [x.select(doc, (1 / (F.lit(RRF_K) + F.row_number().over(best))).alias("r")) for x in lists]
    fused = reduce(DataFrame.unionByName, parts).groupBy(doc).agg(F.sum("r").alias("_score"))
    return fused.orderBy(F.desc("_score"), doc).limit(top)
