"""Sharding by extendible hashing.

A document's hash is the first BITS bits of the MD5 of its doc_id (of its text where doc_id is null). A bucket is a hash prefix; it begins
as the empty prefix that holds everything, and a bucket over its byte limit is split on the next bit, and only such buckets are. A bucket is final when its
texts' UTF-8 bytes fit `limit`, or when it holds one single hash, which no bit can split; such a shard may be over the limit and is marked so.

Sizes are summed once, by the longest prefix that is likely to be needed; those of shorter prefixes follow level by level, each from the one below it. In
the directory every prefix of that depth, some 2 ** (SPARE + 1) a shard at most, points to its bucket; it is joined to the documents by their prefix, and Spark
broadcasts it only if it is small. Prefixes still over the limit at that depth are summed again, deeper, from their own documents alone.

Defined cases: null and empty texts have 0 bytes and are placed all the same. Rows that repeat a doc_id share a hash, so a shard. An empty
table has no shards. Empty halves of split buckets have no row. Extra columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernal.session import cut

BITS = 60
LIMIT = 1 << 20
#: Bits looked at beyond those that evenly spread documents need.
SPARE = 3


def _prefix(h: str, depth: str) -> str:
    return f"shiftright({h}, {BITS} - {depth})"


def place(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, shard (its bits as text), depth, doc_bytes, shard_bytes, oversize: a row for each document."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("bigint")
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), h.alias("h"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("doc_bytes"))
    sized = cut(sized)
    total = sized.agg(F.coalesce(F.sum("doc_bytes"), F.lit(0))).first()[0]
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    placed, low, rest = None, 0, sized
    while True:
        cell = F.expr(_prefix("h", str(depth))).alias("prefix")
        level = cut(rest.groupBy(cell).agg(F.sum("doc_bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        levels = [level.withColumn("depth", F.lit(depth))]
        for d in range(depth - 1, low - 1, -1):
            level = cut(level.groupBy(F.shiftright("prefix", 1).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
            levels.append(level.withColumn("depth", F.lit(d)))
        nodes = reduce(DataFrame.union, levels).withColumn("final", (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")) | (F.col("depth") == BITS))
        up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("final").alias("above"))
        leaf = nodes.withColumn("parent", F.shiftright("prefix", 1)).join(up, ["depth", "parent"], "left").filter("final and not coalesce(above, false)")
        # the directory: all prefixes of this depth point to their bucket
        first = F.expr(f"shiftleft(prefix, {depth} - depth)")
        pointers = F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - depth)") - 1)).alias("cell")
        directory = cut(leaf.select(pointers, "depth", "prefix", F.col("bytes").alias("shard_bytes")))
        here = rest.withColumn("cell", cell).join(directory, "cell")
        placed = here if placed is None else placed.unionByName(here)
        deepest = nodes.filter((F.col("depth") == depth) & ~F.col("final")).select(F.col("prefix").alias("cell"))
        if depth == BITS or deepest.isEmpty():
            break
        rest = cut(rest.join(deepest, F.expr(_prefix("h", str(depth))) == F.col("cell"), "left_semi"))
        low, depth = depth + 1, min(BITS, depth + SPARE)
    shard = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')")).alias("shard")
    return placed.select("doc_id", shard, "depth", "doc_bytes", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize"))


def oracle(limit: int = LIMIT) -> str:
    """The same placement in DuckDB SQL, from the sums of all prefixes of all depths."""
    return f"""
WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, {BITS // 4}) AS BIGINT) AS h,
  CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS doc_bytes FROM documents),
n AS (SELECT k AS depth, h >> ({BITS} - k) AS prefix, sum(doc_bytes) AS b, min(h) AS lo, max(h) AS hi
  FROM d, (SELECT unnest(range(0, {BITS + 1})) AS k) GROUP BY 1, 2),
f AS (SELECT depth, prefix, CAST(b AS BIGINT) AS shard_bytes FROM n WHERE b <= {limit} OR lo = hi OR depth = {BITS}),
c AS (SELECT doc_id, h, doc_bytes, min(depth) AS depth FROM d JOIN f ON prefix = h >> ({BITS} - depth) GROUP BY doc_id, h, doc_bytes)
SELECT doc_id, left(lpad(bin(h), {BITS}, '0'), CAST(c.depth AS INTEGER)) AS shard, CAST(c.depth AS INTEGER) AS depth, doc_bytes, shard_bytes,
  shard_bytes > {limit} AS oversize FROM c JOIN f ON f.depth = c.depth AND f.prefix = h >> ({BITS} - c.depth)
"""
