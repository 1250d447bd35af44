"""Weighted reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (0.6, 0.4)
FINAL = 15


def fuse(legs: list[DataFrame], weights: tuple[float, ...] = WEIGHTS, constant: float = 0.0, k: int = FINAL, key: str = "doc_id") -> DataFrame:
    """query_id, key, rank, score: sums of weight / (constant + rank) over legs(query_id, key, rank).

    Ties go by the leg that names the key first, the rank there, then the key. A union and one aggregation: cheaper than a full outer join.
    A key that a leg names twice counts twice: fused by a digest of the text, chunks of equal text are one.
    """
    every = reduce(DataFrame.unionByName, [leg.select("query_id", key, "rank", F.lit(i).alias("leg"), F.lit(float(w)).alias("w")) for i, (leg, w) in enumerate(zip(legs, weights, strict=True))])
    both = every.groupBy("query_id", key).agg(F.sum(F.col("w") / (F.col("rank") + constant)).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "first", F.col(key))
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", key, "rank", "score")
