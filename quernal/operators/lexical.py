"""BM25 over a postings table (Robertson and Zaragoza 2009), idf without negative values."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernal.functions.text import tokens
from quernal.session import cut, ship

K1, B, TOP = 1.5, 0.75, 10
#: So many terms of queries go to all tasks at a time.
BLOCK_TERMS = 500_000
#: Queries to a batch, and documents whose scores for a batch are held at a time.
BATCH, ROWS = 2048, 1024
#: Terms are numbered within so many parts.
PARTS = 16
#: A term that no text can have, one for each document.
MARK = "\u0001"


@dataclass
class Index:
    """postings(term, doc_id, tf, dl) and stats(n_docs, total_dl): idf is derived at query time, so batches can be appended."""

    postings: DataFrame
    stats: DataFrame

    def write(self, path: str) -> None:
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark, path: str) -> Index:  # noqa: ANN001
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"))


def build(docs: DataFrame, key: str = "doc_id") -> Index:
    """Postings without a shuffle by document: a document's term counts come from its own token array."""
    words = docs.select(F.col(key).alias("doc_id"), tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("dl", F.size("t"))
    stats = words.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_dl"))
    return Index(words.select("doc_id", "dl", F.explode("t").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")), stats)


def term_stats(index: Index) -> DataFrame:
    n = index.stats.select("n_docs")
    df = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("term", "df", "idf")


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))


def score(docs: DataFrame, queries: DataFrame, key: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """query_id, key, score for every document that shares a term with a query.

    One pass over the documents: the queries' terms, at most BLOCK_TERMS at a time, meet the documents' tokens before anything is shuffled, and a mark that
    every document has beside its tokens carries its length, so that the corpus figures come from the same pass. Its result, postings of query terms
    alone, is cut by a checkpoint as three aggregations read it.
    """
    wanted = query_terms(queries)
    terms = cut(wanted.select("term").distinct())
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    words = docs.select(F.col(key).alias("doc_id"), tokens(F.coalesce("text", F.lit(""))).alias("t"))
    words = words.select("doc_id", F.size("t").alias("dl"), F.explode(F.array_append("t", F.lit(MARK))).alias("term"))
    parts = []
    for k in range(blocks):
        some = terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k)
        some = some.union(terms.sparkSession.createDataFrame([(MARK,)], "term string")) if k == 0 else some
        parts.append(words.join(F.broadcast(some), "term", "left_semi"))
    postings = cut(reduce(DataFrame.union, parts).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")))
    mark = F.col("term") == MARK
    stats = postings.filter(mark).agg(F.sum("tf").alias("n_docs"), (F.coalesce(F.sum(F.col("tf") * F.col("dl")), F.lit(0)) / F.sum("tf")).alias("avgdl"))
    return _scored(postings.filter(~mark), stats, wanted, k1, b).withColumnRenamed("doc_id", key)


def _scored(postings: DataFrame, stats: DataFrame, wanted: DataFrame, k1: float, b: float) -> DataFrame:
    # a count by term rather than a window: a term of all documents is combined map-side, and the counts are as few as query terms
    df = postings.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return df.withColumn("part", part).select("term", "doc_id", "part").join(wanted, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def search_index(index: Index, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """score, from a stored index."""
    stats = index.stats.agg(F.sum("n_docs").alias("n_docs"), (F.sum("total_dl") / F.sum("n_docs")).alias("avgdl"))
    return _scored(index.postings.join(query_terms(queries).select("term").distinct(), "term", "left_semi"), stats, query_terms(queries), k1, b)


def best_of(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one query's scores the k best and their keys, by score to six places, then key."""
    rounded = np.round(scores, 6)
    if len(scores) > k:
        least = np.partition(rounded, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(rounded >= least)
        scores, keys, rounded = scores[some], keys[some], rounded[some]
    order = np.lexsort((keys, -rounded))[:k]
    return scores[order], keys[order]


class _Batch:
    """A block of queries: which of them have a term, and what each term weighs."""

    def __init__(self, ids: list, terms: np.ndarray, owners: np.ndarray, idf: np.ndarray, avgdl: float, k1: float, b: float) -> None:
        order = np.argsort(terms, kind="stable")
        self.ids, self.owners, self.idf, self.avgdl, self.k1, self.b = ids, owners[order], idf, avgdl, k1, b
        self.first = np.searchsorted(terms[order], np.arange(len(idf) + 1))

    def scores(self, row: np.ndarray, term: np.ndarray, dl: np.ndarray) -> np.ndarray:
        """Documents by queries, from the documents' terms; row and term name each occurrence."""
        pair, tf = np.unique(term * len(dl) + row, return_counts=True)
        term, row = pair // len(dl), pair % len(dl)
        part = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl[row] / self.avgdl))
        out = np.zeros((len(dl), len(self.ids)))
        edges = [*np.flatnonzero(np.diff(term, prepend=-1)).tolist(), len(term)]
        for lo, hi in itertools.pairwise(edges):
            t = term[lo]
            q = self.owners[self.first[t] : self.first[t + 1]]
            if len(q):
                out[row[lo:hi, None], q] += part[lo:hi, None]
        return out


def _ranker(batch: _Batch, k: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = [(np.zeros(0), np.zeros(0, object))] * len(batch.ids)
        for whole in it:
            for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                keys, dl, hits = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), b.column(2)
                row = np.repeat(np.arange(b.num_rows), hits.value_lengths().to_numpy())
                s = batch.scores(row, hits.flatten().to_numpy().astype(np.int64), dl.astype(float))
                for j in np.flatnonzero(s.any(axis=0)).tolist():
                    some = np.flatnonzero(s[:, j])
                    found, names = best[j]
                    best[j] = best_of(np.concatenate([found, s[some, j]]), np.concatenate([names, keys[some]]) if len(names) else keys[some], k)
        rows = [(q, n, v) for q, (found, names) in zip(batch.ids, best, strict=True) for v, n in zip(found.tolist(), names.tolist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def nearest(docs: DataFrame, queries: DataFrame, k: int = TOP, key: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """query_id, key, rank, score: the k documents of the greatest BM25 score for each query; what `top(score(..))` gives.

    The pass over the documents is that of `score`; what it keeps is a row a document with its occurrences of query terms. Tasks then multiply those by blocks of BATCH
    queries and pass on k a query, so that no row is made for a pair of document and query.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = cut(queries.filter("query_id is not null").select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term")).distinct())
    w = Window.partitionBy("part").orderBy("term")
    terms = asked.select("term").distinct().withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)))
    terms = cut(terms.withColumn("tid", (F.row_number().over(w) - 1) * PARTS + F.col("part")).select("term", "tid"))
    n_terms = terms.count()
    blocks = max(1, -(-n_terms // BLOCK_TERMS))
    words = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), tokens(F.coalesce("text", F.lit(""))).alias("t"))
    words = words.select("key", F.size("t").alias("dl"), F.explode(F.array_append("t", F.lit(MARK))).alias("term"))
    mark = spark.createDataFrame([(MARK, -1)], "term string, tid bigint")
    parts = [words.join(F.broadcast(terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i).union(mark)), "term") for i in range(blocks)]
    # the mark keeps documents without a query term in the corpus figures; rows that share a key are one document
    held = cut(reduce(DataFrame.union, parts).groupBy("key").agg(F.max("dl").alias("dl"), F.filter(F.collect_list("tid"), lambda t: t >= 0).alias("hits")))
    n, avgdl = held.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    df = held.select(F.explode(F.array_distinct("hits")).alias("tid")).groupBy("tid").count().collect()
    idf = np.zeros(1 + (terms.agg(F.max("tid")).first()[0] if n_terms else 0))
    for r in df:
        idf[r["tid"]] = math.log(1 + (n - r["count"] + 0.5) / (r["count"] + 0.5))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    found = spark.createDataFrame([], schema)
    batches = -(-asked.select("query_id").distinct().count() // BATCH)
    for i in range(batches):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == i).join(terms, "term").select("query_id", "tid").collect()
        ids = list(dict.fromkeys(r.query_id for r in some))
        at = {q: j for j, q in enumerate(ids)}
        batch = _Batch(ids, np.array([r.tid for r in some], np.int64), np.array([at[r.query_id] for r in some], np.int64), idf, avgdl or 1.0, k1, b)
        found = found.union(held.filter("size(hits) > 0").mapInArrow(_ranker(batch, k, to_arrow_schema(schema)), schema))
    return top(found, k, key)


def top(scores: DataFrame, k: int = TOP, key: str = "doc_id") -> DataFrame:
    """query_id, key, rank, score: by score to six places, then key. WindowGroupLimit cuts before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", key, "rank", "score")
