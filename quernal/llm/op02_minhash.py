"""MinHash near-dedup with tensored banding.

Each text becomes the set of its SHINGLE-word shingles (letters and digits only, in small letters; a shorter
text is one shingle). Two collections of SIDES short minhash groups, ROWS values each, are computed a text:
2 * SIDES * ROWS minhashes. Each pair of a group of the first and a group of the second collection makes a table
key, so SIDES ** 2 tables of 2 * ROWS values come from about a square root of the minhashes that they would
need independently. With Jaccard similarity s a pair shares a key with probability (1 - (1 - s**ROWS)**SIDES)**2.

Texts that are equal byte for byte are grouped first, by MD5. Their representatives (the smallest doc_id) meet
in tables: in each table key's bucket everyone is a candidate with the bucket's leader. Candidates are verified by
the exact Jaccard similarity of their shingle sets, THRESHOLD at least. As a bucket may hold several groups,
further rounds compare the groups that are left in a bucket by members drawn anew, while they join any and more pairs
are left than the buckets have rows. Then all pairs of documents that share a bucket but not yet a group are verified, but for those whose
set sizes alone are too far apart; buckets over BLOCK documents are spread over cells of two blocks. So every pair that shares a key is compared
or in one group. Groups are the connected components of
verified pairs, by iterated hooking onto the smallest neighbour; the document with the smallest doc_id stays.

Defined cases: rows with a null doc_id or null text are never compared and stay. Empty texts are equal to each other, texts
without a word compare only byte for byte. Rows that repeat a doc_id with the same text are copies: one stays. Where a doc_id has several
texts it is one document with all of them: it is near whatever one of them is near. Of ties in anything the smallest doc_id wins.
An empty table gives an empty result. Extra columns don't matter; `drop_copies` returns all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernal.llm.words import Block, blocks, grams, mix, whole, words
from quernal.session import cut, release, ship, unused

SHINGLE = 3
SIDES = 10
ROWS = 3
THRESHOLD = 0.6
#: So many ids, 8 bytes each, may be broadcast.
BROADCAST_IDS = 1 << 20
#: A bucket's pairs are made from blocks of about so many documents, two at a time.
BLOCK = 1000
_SEEDS = np.random.default_rng(7).integers(0, 2**63, 2 * SIDES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.random.default_rng(8).integers(0, 2**63, 2 * SIDES, dtype=np.uint64)


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, row by row and with repeats, and n+1 positions of the rows among them."""
    w = words(block)
    count = np.diff(w.first)
    long = np.flatnonzero(whole(w.first, SHINGLE))
    made = grams(w.hash, SHINGLE)[long]
    row = w.row()
    at = row[long]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        one = np.array([mix(np.bitwise_xor.reduce(mix(w.hash[w.first[i] : w.first[i + 1]] + np.arange(count[i], dtype=np.uint64)), keepdims=True))[0] for i in short], dtype=np.uint64)
        made, at = np.concatenate([made, one]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        made, at = made[order], at[order]
    return made, np.searchsorted(at, np.arange(len(block) + 1))


def sides(block: Block) -> np.ndarray:
    """The 2 * SIDES group hashes of each row, as int64; 0 throughout for a row without a word."""
    made, first = shingles(block)
    out = np.zeros((len(block), 2 * SIDES), np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out.view(np.int64)
    starts = first[full]
    for k in range(2 * SIDES):
        g = np.full(len(full), _SALTS[k])
        for seed in _SEEDS[k * ROWS : (k + 1) * ROWS]:
            x = made * seed
            x ^= x >> np.uint64(32)
            x *= seed
            g = mix(g ^ np.minimum.reduceat(x, starts))
        out[full, k] = g | np.uint64(1)
    return out.view(np.int64)


def _signed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        found = [sides(x) for x in blocks(b.column(1))]
        flat = np.concatenate(found).reshape(-1) if found else np.zeros(0, np.int64)
        s = pa.FixedSizeListArray.from_arrays(pa.array(flat), 2 * SIDES).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), s], names=["doc_id", "text_hash", "sides"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        values, ends = [np.zeros(0, np.uint64)], [0]
        for x in blocks(b.column(1)):
            made, first = shingles(x)
            for i in range(len(x)):
                one = np.unique(made[first[i] : first[i + 1]])
                values.append(one)
                ends.append(ends[-1] + len(one))
        s = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(values).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), s], names=["doc_id", "shingles"])


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ids. Up to BROADCAST_IDS ids go to the rows, else both are shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _alike(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches THRESHOLD."""
    sets = _only(sets, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    enough = both >= THRESHOLD * (F.size("sa") + F.size("sb") - both)
    return pairs.join(left, "a").join(right, "b").filter((F.size("sa") > 0) & enough).select("a", "b").distinct()


def _across(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents of one bucket in two groups whose set sizes allow THRESHOLD."""
    sizes = sets.groupBy("doc_id").agg(F.min(F.size("shingles")).alias("least"), F.max(F.size("shingles")).alias("most"))
    blocks_ = F.ceil(F.count("*").over(Window.partitionBy("key")) / BLOCK).cast("bigint")
    rows = mixed.join(sizes, "doc_id").withColumn("blocks", blocks_).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "group", "block", "least", "most")
    left, right = (rows.select("key", "i", "j", *(F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "group", "block", "least", "most"))) for side in "ab")
    near = (F.col("a_most") >= THRESHOLD * F.col("b_least")) & (F.col("b_most") >= THRESHOLD * F.col("a_least"))
    apart = F.expr("a_doc_id < b_doc_id and a_group <> b_group and (i = j or a_block <> b_block)")
    return left.join(right, ["key", "i", "j"]).filter(apart & near).select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group): for each end of an edge (a, b) the smallest id of its connected component.

    Rounds of hooking every node's larger neighbours onto its smallest one, then every node's smaller ones;
    what is left is a star for each component. A round is two aggregations over the edges.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    before = -1
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        down = big.groupBy("b").agg(F.min("a").alias("m"))
        small = big.join(down, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        edges = cut(small.filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("bigint")), F.lit(0))).first()
        if tuple(now) == before:
            return edges.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("group"))
        before = tuple(now)


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of): each document that isn't the one that stays of its group, and that one."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    signed = texts.withColumn("text_hash", F.unhex(F.md5("text"))).mapInArrow(_signed, "doc_id bigint, text_hash binary, sides array<bigint>")
    same = Window.partitionBy("text_hash")
    signed = signed.withColumns({"first_id": F.min("doc_id").over(same), "turn": F.row_number().over(same.orderBy("doc_id"))})
    signed = cut(signed.select("doc_id", "first_id", "turn", "sides"))
    copies = signed.filter("doc_id > first_id").select(F.col("first_id").alias("a"), F.col("doc_id").alias("b"))

    pair = F.sequence(F.lit(0), F.lit(SIDES * SIDES - 1))
    key = F.explode(F.transform(pair, lambda k: F.xxhash64(k, F.col("sides")[(k / SIDES).cast("int")], F.col("sides")[k % SIDES + SIDES])))
    keys = signed.filter("turn = 1 and sides[0] <> 0").select("doc_id", key.alias("key"))
    bucket = Window.partitionBy("key")
    met = cut(keys.withColumn("lead", F.min("doc_id").over(bucket)).withColumn("last", F.max("doc_id").over(bucket)).filter("lead <> last").select("key", "doc_id", "lead"))
    sets = cut(_only(texts, met.select("doc_id").distinct()).mapInArrow(_sets, "doc_id bigint, shingles array<bigint>"))
    pairs = met.filter("doc_id > lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    met = met.drop("lead")
    enough = met.count()
    tried, edges, rounds = None, None, 0
    while True:
        pairs = cut(pairs)
        good = cut(_alike(sets, pairs))
        tried = pairs if tried is None else tried.union(pairs)
        joined = not good.isEmpty()
        if joined or not rounds:
            # the stars of the rounds before stand for all their edges
            label = components(good if edges is None else edges.union(good))
            edges = label.select(F.col("group").alias("a"), F.col("doc_id").alias("b"))
            seen = met.join(label, "doc_id", "left").select("key", "doc_id", F.coalesce("group", "doc_id").alias("group"))
            mixed = seen.withColumns({"lo": F.min("group").over(bucket), "hi": F.max("group").over(bucket)}).filter("lo <> hi").select("key", "doc_id", "group")
            mixed = cut(mixed)
            met = mixed.select("key", "doc_id")
        rounds += 1
        release(spark)
        sizes = mixed.groupBy("key", "group").count().groupBy("key").agg(F.sum("count").alias("n"), F.sum(F.expr("double(count) * count")).alias("within"))
        apart = sizes.agg(F.coalesce(F.sum(F.expr("(double(n) * n - within) / 2")), F.lit(0.0))).first()[0]
        if not joined or apart <= enough:
            break
        one = mixed.groupBy("key", "group").agg(F.min_by("doc_id", F.xxhash64("key", "doc_id", F.lit(rounds))).alias("doc_id"))
        turn = F.xxhash64("key", "group", F.lit(rounds))
        lead = one.withColumn("lead", F.min_by("doc_id", turn).over(bucket)).filter("doc_id <> lead")
        ordered = lead.select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b")).distinct()
        pairs = ordered.join(tried, ["a", "b"], "left_anti")
    pairs = cut(_across(mixed, sets).join(tried, ["a", "b"], "left_anti"))
    edges = edges.union(cut(_alike(sets, pairs)))
    return components(edges.union(copies)).filter("doc_id <> group").select("doc_id", F.col("group").alias("duplicate_of"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one document left of each group, all columns kept. Of rows with one doc_id and text the first by all columns as JSON stays."""
    columns = docs.columns
    mine = unused(columns, "gone")
    here = docs["doc_id"].cast("bigint")
    gone = cut(groups(docs)).select(F.col("doc_id").alias(mine))
    left = docs.join(gone, here == gone[mine], "left_anti")
    twice = cut(docs.filter(docs["doc_id"].isNotNull() & docs["text"].isNotNull()).groupBy(here.alias(mine)).agg(F.count("*").alias("n")).filter("n > 1").select(mine))
    release(docs.sparkSession)
    if twice.isEmpty():
        return left
    repeated = left.filter(docs["text"].isNotNull()).join(twice, here == twice[mine], "left_semi")
    row = F.struct(*[docs[c] for c in columns])
    again = repeated.groupBy(here, docs["text"]).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    once = left.join(twice, (here == twice[mine]) & docs["text"].isNotNull(), "left_anti")
    return once.union(again)
