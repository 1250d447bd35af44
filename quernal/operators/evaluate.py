"""Evaluation: stratified samples, batch quotas, and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def category(c: Column) -> Column:
    """A file's topic by its name, the first rule that holds."""
    n = F.lower(c)
    has = lambda x: F.contains(n, F.lit(x))
    return F.when(has("user") | has("pessoa"), "people").when(has("project"), "projects").when(F.startswith(n, F.lit("enriched_")), "groups").otherwise("institutional")


def shuffled(key: Column, seed: int = 42) -> Column:
    """An order that depends on seed and key alone, the same in SQL engines."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified(df: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """At most quota rows of each stratum, by seeded order; quotas(stratum, quota)."""
    w = Window.partitionBy(stratum).orderBy(shuffled(F.col(key), seed), key)
    return df.join(quotas, stratum).withColumn("pick", F.row_number().over(w)).filter("pick <= quota")


def batch_quotas(batches: DataFrame, quota: int) -> DataFrame:
    """batches(batch, n_batches) with `asked`: an equal share each, at least one, until the quota is met; the last batch takes what is left."""
    per = F.greatest(F.lit(1), F.floor(F.lit(quota) / F.col("n_batches")))
    left = F.greatest(F.lit(0), F.lit(quota) - per * F.col("batch"))
    return batches.withColumn("asked", F.when(F.col("batch") == F.col("n_batches") - 1, left).otherwise(F.least(per, left)).cast("bigint"))


def ranking(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, precision, recall, reciprocal_rank, ndcg at k for queries that have relevant documents.

    hits(query_id, doc_id, rank), relevant(query_id, doc_id).
    """
    truth = relevant.select("query_id", "doc_id").distinct()
    size = truth.groupBy("query_id").agg(F.count("*").alias("n"))
    good = hits.filter(F.col("rank") <= k).join(truth, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return size.join(good, "query_id", "left").select("query_id", zero(F.col("h") / k).alias("precision"), zero(F.col("h") / F.col("n")).alias("recall"), zero(1 / F.col("first")).alias("reciprocal_rank"), zero(F.col("dcg") / ideal).alias("ndcg"))


def answer_overlap(records: DataFrame) -> DataFrame:
    """records(question, answer, ground_truth, contexts) with token-overlap stand-ins for the four judged metrics."""
    from quernal.functions.text import tokens

    t = lambda c: F.array_distinct(tokens(F.coalesce(c, F.lit(""))))
    share = lambda a, b: F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))
    context = t(F.array_join("contexts", " "))
    hit = F.size(F.filter("contexts", lambda c: share(t(F.col("ground_truth")), t(c)) >= 0.5)) / F.nullif(F.size("contexts"), F.lit(0))
    return records.withColumns({"context_precision": F.coalesce(hit, F.lit(0.0)), "context_recall": share(t(F.col("ground_truth")), context), "faithfulness": share(t(F.col("answer")), context), "answer_relevancy": share(t(F.col("question")), t(F.col("answer")))})
