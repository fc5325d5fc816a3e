"""Score modifiers: DataFrame to DataFrame, applied in order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_HALF_LIFE = 3600


def recency_decay(half_life_seconds: int, now_ms: int, indexed_at: str = "_indexed_at"):
    half = half_life_seconds if half_life_seconds > 0 else DEFAULT_HALF_LIFE

    def apply(df: DataFrame) -> DataFrame:
        at = F.coalesce(F.col(indexed_at), F.lit(0))
        age = F.greatest(F.lit(0), F.lit(now_ms) - at)
        factor = F.when(at <= 0, F.lit(1.0)).otherwise(F.exp(F.lit(-math.log(2) / (half * 1000)) * age))
        return df.withColumn("_score", F.col("_score") * factor)

    return apply


def pipeline(df: DataFrame, steps) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df
