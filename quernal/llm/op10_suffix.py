"""Suffix-array dedup without the array: repeated passages of LENGTH words or more, within and across documents.

A difference cover as prefilter of hashed passages. DIFFERENCES is a difference cover modulo V: for any two word positions
i and j some delta < V makes both i + delta and j + delta sample positions. So two passages that agree on LENGTH words hold a pair of
sample suffixes that agree on DEPTH = LENGTH - V + 1 words. The sample, a fifth of the suffixes, is
counted first, by hashes of DEPTH words; those that occur once drop out. A suffix can agree with another for LENGTH words only if it reaches a
sample suffix that is left within V words; these suffixes alone are counted by hashes of their first LENGTH words, and those
that occur again are the repeats. Neither step holds a text, nothing is sorted by words, and no ranks are made.

Words are runs between ASCII white space, compared as they are. The result has a row for each maximal span of repeated
words of a document: doc_id, start_word, n_words, and copies: how many places hold the span's most frequent LENGTH words.

Defined cases: rows with a null doc_id or text have no spans. Texts under LENGTH words have none either. A row that is there
twice is a text that occurs twice, so all of its passages repeat; rows that share a doc_id are one document, whose
spans are the union of the rows' spans. Repeats inside one text count, overlapping ones too. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernal.llm.words import SPACE, blocks, grams, whole, words
from quernal.session import ship

LENGTH = 50
V = 31
DIFFERENCES = (1, 5, 11, 24, 25, 27)
DEPTH = LENGTH - V + 1
assert {(a - b) % V for a in DIFFERENCES for b in DIFFERENCES} == set(range(V))
_SAMPLED = np.isin(np.arange(V), DIFFERENCES)


def _sampled(first: np.ndarray) -> np.ndarray:
    """The sample positions of a block whose prefix of DEPTH words lies in their row."""
    ok = whole(first, DEPTH)
    inside = np.arange(len(ok)) - np.repeat(first[:-1], np.diff(first))[: len(ok)]
    return np.flatnonzero(ok & _SAMPLED[inside % V])


def _sample(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for x in blocks(b.column(1)):
            w = words(x, SPACE)
            at = _sampled(w.first)
            if len(at):
                row = pa.array(np.searchsorted(w.first, at, "right") - 1 + x.first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.array(grams(w.hash, DEPTH)[at].view(np.int64))], names=["doc_id", "prefix"])


def _suffixes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ranks = b.column(2)
        offs, flat = ranks.offsets.to_numpy(), ranks.values.to_numpy().view(np.uint64)
        for x in blocks(b.column(1)):
            w = words(x, SPACE)
            at = _sampled(w.first)
            g = grams(w.hash, DEPTH)[at]
            lo, hi = offs[x.first], offs[x.first + len(x)]
            known = np.isin(g, flat[lo:hi])
            at = at[known]
            near = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(near, np.maximum(at - V + 1, 0), 1)
            np.add.at(near, at + 1, -1)
            ok = whole(w.first, LENGTH)
            i = np.flatnonzero(ok & (np.cumsum(near)[: len(ok)] > 0))
            if len(i):
                row = np.searchsorted(w.first, i, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + x.first)), pa.array((i - w.first[row]).astype(np.int32)), pa.array(grams(w.hash, LENGTH)[i].view(np.int64))], names=["doc_id", "word", "prefix"])


def _spans(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = []
        for k, (at, n) in enumerate(zip(b.column(1), b.column(2), strict=True)):
            at, n = at.values.to_numpy(), n.values.to_numpy()
            order = np.argsort(at)
            at, n = at[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], np.diff(at) > LENGTH]))
            last = np.concatenate([new[1:], [len(at)]]) - 1
            out.append((np.full(len(new), k), at[new], at[last] - at[new] + LENGTH, np.maximum.reduceat(n, new)))
        if out:
            k, start, size, most = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(most.astype(np.int64))], names=["doc_id", "start_word", "n_words", "copies"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, copies: the maximal repeated spans of each document."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    bucket = Window.partitionBy("prefix")
    sample = texts.mapInArrow(_sample, "doc_id bigint, prefix bigint")
    ranked = sample.withColumn("n", F.count("*").over(bucket)).filter("n > 1").groupBy("doc_id").agg(F.collect_set("prefix").alias("ranks"))
    suffixes = texts.join(ranked, "doc_id").mapInArrow(_suffixes, "doc_id bigint, word int, prefix bigint")
    tied = suffixes.withColumn("n", F.count("*").over(bucket)).filter("n > 1").groupBy("doc_id").agg(F.collect_list("word").alias("at"), F.collect_list("n").alias("n"))
    return tied.mapInArrow(_spans, "doc_id bigint, start_word int, n_words int, copies bigint")
