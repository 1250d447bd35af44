"""Benchmark decontamination by latent semantic retrieval.

1. Every text is cut into passages of PASSAGE words (letters and digits, small letters). Each word of the corpus counts in one of COLUMNS hashed
   columns; one distributed pass gives the document frequency of each column over all passages and a sketch of the passage-term matrix A.
2. The sketch is the randomised part of the SVD: each passage is added, with a random sign, to one of SKETCH rows. Weighting columns by TF-IDF
   commutes with it, so frequencies and sketch come from the same pass; sketches of tasks add up. The singular vectors of the weighted sketch
   are the right singular vectors of A to within its error. Texts and items are compared in RANK latent dimensions, each divided by its singular
   value, so that what all passages have in common doesn't drown what tells them apart.
3. Candidate search: a text and an item are compared if the text has at all PARAPHRASE of the item's words (whatever lacks them can't pass step 4). The latent vectors of
   WINDOWS tiles of TILE words in a row are compared with the item; a cosine of COSINE or more makes a candidate.
4. A candidate is checked on stretches of the text that begin at its tiles: the longest common subsequence of words with the item has to be NEAR of the
   item's words, or PARAPHRASE of them with the answer check: half the distinct words of the item's answer, its last sentence, occur in the stretch.

An item of fewer than SHORT words has no context to retrieve it by: it is found where all its words follow each other.

The result has a row for each text and item that it leaks: doc_id, item_id, lcs_words, item_words, verbatim (NEAR was reached).

What goes to all tasks is the latent vectors of the columns and the items. The former don't grow with the corpus; of the items BLOCK at a time are sent, a
larger benchmark takes several passes of steps 3 and 4 with the one basis of step 2, so an item's result doesn't depend on the others.

Defined cases: null or empty texts leak nothing; rows with a null doc_id are searched too and keep their null. Items with a null text or without a word
match nothing. Rows that repeat a doc_id are merged in `leaks`: the best finding counts. Equal items each get their row. An empty table on either side gives an
empty result. `drop_leaks` judges each row by its own text, whatever its doc_id, and keeps all columns; extra columns don't matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernal.llm.words import Block, Words, blocks, grams, mix, whole, words
from quernal.session import ship

BITS = 15
COLUMNS = 1 << BITS
SKETCH = 512
RANK = 128
PASSAGE = 64
TILE = 16
WINDOWS = (2, 3, 5)
COSINE = 0.3
NEAR, PARAPHRASE = 0.9, 0.6
STRETCH = 1.5
SHORT = 5
BLOCK = 4096
#: A sketch travels in so many pieces.
_CHUNKS = 64
_SENTENCE = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def column(h: np.ndarray) -> np.ndarray:
    """The columns of word hashes."""
    return (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


def masks_of(item: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, h in enumerate(item.tolist()):
        out[h] = out.get(h, 0) | 1 << k
    return out


class Item:
    """A benchmark item: its id, word hashes, the distinct ones with counts, their positions as bits, and the words of its answer."""

    def __init__(self, item_id: int, w: Words, data: np.ndarray) -> None:
        self.id, self.words, self.size = item_id, w.hash, len(w.hash)
        self.kinds, self.counts = np.unique(w.hash, return_counts=True)
        self.masks = masks_of(w.hash)
        ends = np.concatenate([[0], np.cumsum(_SENTENCE[data])])
        self.answer = frozenset(w.hash[ends[w.end - 1] == ends[w.start[-1]]].tolist())


def items_of(rows: list[tuple[int, str | None]]) -> list[Item]:
    """The items that have a word."""
    out = []
    for item_id, text in rows:
        for b in blocks(pa.array([text or ""])):
            w = words(b)
            if len(w.hash):
                out.append(Item(item_id, w, b.data))
    return out


class Postings:
    """Which items have a word how often; for finding the items of which a row has enough words."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        word = np.concatenate([np.zeros(0, np.uint64), *(i.kinds for i in items)])
        order = np.argsort(word, kind="stable")
        self.terms, first = np.unique(word[order], return_index=True)
        self.first = np.append(first, len(word))
        self.item = np.repeat(np.arange(len(items)), [len(i.kinds) for i in items])[order]
        self.count = np.concatenate([np.zeros(0, np.int64), *(i.counts for i in items)])[order]
        self.need = np.array([math.ceil(PARAPHRASE * i.size - 1e-9) for i in items])
        self.kinds = [np.searchsorted(self.terms, i.kinds) for i in items]
        self.present = np.zeros(1 << 16, dtype=bool)
        self.present[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words of the items, and which term each is."""
        at = np.flatnonzero(self.present[(w.hash >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.terms, w.hash[at]), len(self.terms) - 1)
        ok = self.terms[k] == w.hash[at]
        return at[ok], k[ok]

    def candidates(self, w: Words, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and items such that the row has `need` of the item's words, order and repeats aside."""
        row = np.searchsorted(w.first, at, "right") - 1
        pair = np.unique(row * len(self.terms) + k)
        row, k = pair // len(self.terms), pair % len(self.terms)
        n = self.first[k + 1] - self.first[k]
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[k], n)
        rows = len(w.first) - 1
        has = np.bincount(np.repeat(row, n) * len(self.items) + self.item[post], weights=self.count[post], minlength=rows * len(self.items))
        return np.nonzero(has.reshape(rows, -1) >= self.need)


def _sketched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's passages in the sketch, and document frequencies in a row after it; whole numbers throughout."""
    sums = np.zeros((SKETCH + 1) * COLUMNS, np.int32)
    total = 0
    for b in it:
        ids = b.column(0).fill_null(-1).to_numpy().view(np.uint64)
        for x in blocks(b.column(1)):
            w = words(x)
            if not len(w.hash):
                continue
            size = -(-np.diff(w.first) // PASSAGE)
            first = np.concatenate([[0], np.cumsum(size)])
            row = w.row()
            inside = (np.arange(len(row)) - w.first[row]) // PASSAGE
            cell, col = first[row] + inside, column(w.hash)
            of = np.repeat(np.arange(len(x)), size)
            turn = mix(mix(ids[x.first + of]) + (np.arange(first[-1]) - first[of]).astype(np.uint64))
            sign = np.where(turn >> np.uint64(63), 1, -1).astype(np.int32)
            np.add.at(sums, (turn % np.uint64(SKETCH)).astype(np.int64)[cell] * COLUMNS + col, sign[cell])
            np.add.at(sums, SKETCH * COLUMNS + np.unique(cell * COLUMNS + col) % COLUMNS, 1)
            total += int(first[-1])
    codec = pa.Codec("zstd", 1)
    parts = [codec.compress(p.tobytes(), asbytes=True) for p in np.array_split(sums, _CHUNKS)]
    yield pa.RecordBatch.from_arrays([pa.array([*range(_CHUNKS), -1]), pa.array([*parts, codec.compress(np.array([total]).tobytes(), asbytes=True)], pa.binary())], names=["chunk", "sums"])


def _piece(chunk: int) -> tuple[np.dtype, int]:
    """Type and length of a chunk's numbers."""
    n = (SKETCH + 1) * COLUMNS
    return (np.dtype(np.int64), 1) if chunk < 0 else (np.dtype(np.int32), n // _CHUNKS + (chunk < n % _CHUNKS))


def _added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have: dict[int, np.ndarray] = {}
    codec = pa.Codec("zstd", 1)
    for b in it:
        for k, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            kind, n = _piece(k)
            v = np.frombuffer(codec.decompress(s.as_buffer(), n * kind.itemsize), kind).astype(np.int64)
            have[k] = have[k] + v if k in have else v
    for k, v in have.items():
        # sums of many tasks may be large; 32 bits of a float are enough for the axes
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([codec.compress(v.astype(np.float32 if k >= 0 else np.float64).tobytes(), asbytes=True)], pa.binary())], names=["chunk", "sums"])


def basis(texts: DataFrame) -> np.ndarray:
    """COLUMNS x RANK at most: the latent vector of a word of each column, TF-IDF weight and singular values taken in."""
    sums = texts.mapInArrow(_sketched, "chunk bigint, sums binary").repartition("chunk").mapInArrow(_added, "chunk bigint, sums binary")
    flat, passages, codec = np.zeros((SKETCH + 1) * COLUMNS, np.float32), 0.0, pa.Codec("zstd", 1)
    starts = np.cumsum([0, *(_piece(k)[1] for k in range(_CHUNKS))])
    for k, s in sums.toLocalIterator():
        n = _piece(k)[1]
        if k < 0:
            passages = np.frombuffer(codec.decompress(s, n * 8), np.float64)[0]
        else:
            flat[starts[k] : starts[k] + n] = np.frombuffer(codec.decompress(s, n * 4), np.float32)
    flat = flat.reshape(SKETCH + 1, COLUMNS)
    return latent(flat[:SKETCH], flat[SKETCH].copy(), passages)


def latent(a: np.ndarray, df: np.ndarray, passages: float) -> np.ndarray:
    """The latent vectors from the sketch, which is weighted in place, the document frequencies and the number of passages."""
    weight = (np.log((1 + passages) / (1 + df)) + 1).astype(np.float32)
    a *= weight
    values, left = np.linalg.eigh((a @ a.T).astype(np.float64))
    keep = [k for k in range(len(values) - 1, -1, -1) if values[k] > max(1e-6 * values[-1], 1e-9)][:RANK]
    if not keep:
        return np.zeros((COLUMNS, 1), np.float32)
    out = a.T @ (left[:, keep] / values[keep]).astype(np.float32)
    out *= weight[:, None]
    return out


def lcs(a: list[int], masks: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence of a and the item of `size` words whose positions by word are bits in masks."""
    full = (1 << size) - 1
    v = full
    for x in a:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def possible(item: Item, at: np.ndarray, k: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Which of the stretches of `span` words from `starts` share enough words with the item, order aside: a bound on the subsequence.

    at: positions of the text's words; k: the number of each among the item's distinct words, -1 for other words.
    """
    least = PARAPHRASE * item.size
    hit = np.flatnonzero(k >= 0)
    at, k = at[hit], k[hit]
    lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + span)
    some = np.flatnonzero(hi - lo >= least)
    if not len(some):
        return starts[:0]
    a, b = lo[some[0]], hi[some[-1]]
    seen = np.zeros((b - a + 1, len(item.kinds)), np.int32)
    seen[np.arange(1, b - a + 1), k[a:b]] = 1
    np.cumsum(seen, axis=0, out=seen)
    return starts[some[np.minimum(seen[hi[some] - a] - seen[lo[some] - a], item.counts).sum(axis=1) >= least]]


def matched(text: np.ndarray, item: Item, starts: np.ndarray, span: int) -> tuple[int, bool, bool]:
    """The best (common words, verbatim, accepted) over the stretches of `text` from the given places."""
    n = item.size
    best = (0, False, False)
    for s in starts.tolist():
        part = text[s : s + span].tolist()
        common = lcs(part, item.masks, n)
        near = common >= NEAR * n
        ok = near or common >= PARAPHRASE * n and 2 * len(item.answer & set(part)) >= len(item.answer)
        best = max(best, (common, near, ok), key=lambda b: (b[2], b[0]))
        if common == n:
            break
    return best


class Search:
    """Finds leaked items in blocks of texts; vectors: the latent vectors of the columns, and after them one of no word."""

    def __init__(self, items: list[Item], vectors: np.ndarray) -> None:
        self.vectors = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        self.long = [i for i in items if i.size >= SHORT]
        self.short = [i for i in items if i.size < SHORT]
        self.postings = Postings(self.long)
        self.number = np.full(len(self.postings.terms), -1)
        self.back = np.array([math.ceil(STRETCH * i.size / TILE) for i in self.long], np.int64)
        q = np.array([vectors[column(i.words)].sum(axis=0) for i in self.long]).reshape(len(self.long), -1)
        self.queries = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

    def windows(self, h: np.ndarray) -> np.ndarray:
        """Latent vectors of length 1 of the WINDOWS tiles from each tile of a text, as (window, tile, dimension)."""
        n = -(-len(h) // TILE)
        col = np.full(n * TILE, COLUMNS)
        col[: len(h)] = column(h)
        z = np.zeros((n + max(WINDOWS), self.vectors.shape[1]), np.float32)
        np.einsum("ijk->ik", self.vectors[col].reshape(n, TILE, -1), out=z[:n])
        s = np.stack([sum(z[k : k + n] for k in range(w)) for w in WINDOWS])
        s /= np.maximum(np.sqrt(np.einsum("ijk,ijk->ij", s, s)), 1e-12)[:, :, None]
        return s

    def row(self, h: np.ndarray, at: np.ndarray, term: np.ndarray, items: np.ndarray) -> Iterator[tuple[Item, int, bool]]:
        """The items of those given that a text leaks, by retrieval and checks; at, term: the text's words that any item has."""
        close = self.windows(h) @ self.queries[items].T >= COSINE
        tiles = close.shape[1]
        edge = np.zeros((tiles + 1) * len(items), np.int32)
        for n, hits in zip(WINDOWS, close, strict=True):
            t, j = np.nonzero(hits)
            np.add.at(edge, np.maximum(t - self.back[items[j]], 0) * len(items) + j, 1)
            np.add.at(edge, np.minimum(t + n, tiles) * len(items) + j, -1)
        wanted = np.cumsum(edge.reshape(tiles + 1, -1)[:-1], axis=0) > 0
        for j in np.flatnonzero(wanted.any(axis=0)).tolist():
            item = self.long[items[j]]
            span = math.ceil(STRETCH * item.size) + TILE
            kinds = self.postings.kinds[items[j]]
            self.number[kinds] = np.arange(len(kinds))
            starts = possible(item, at, self.number[term], np.flatnonzero(wanted[:, j]) * TILE, span)
            self.number[kinds] = -1
            if len(starts):
                common, near, ok = matched(h, item, starts, span)
                if ok:
                    yield item, common, near

    def block(self, x: Block) -> Iterator[tuple[int, Item, int, bool]]:
        """(row, item, common words, verbatim) for each finding in a block."""
        w = words(x)
        if not len(w.hash):
            return
        if self.long:
            at, term = self.postings.hits(w)
            rows, items = self.postings.candidates(w, at, term)
            edges = [*np.flatnonzero(np.diff(rows, prepend=-1)).tolist(), len(rows)]
            for a, b in itertools.pairwise(edges):
                r = int(rows[a])
                lo, hi = np.searchsorted(at, w.first[r : r + 2])
                for found in self.row(w.hash[w.first[r] : w.first[r + 1]], at[lo:hi] - w.first[r], term[lo:hi], items[a:b]):
                    yield r, *found
        for n in {i.size for i in self.short}:
            g = grams(w.hash, n)
            whole_ = whole(w.first, n)
            for i in (i for i in self.short if i.size == n):
                at = np.flatnonzero(whole_ & (g == grams(i.words, n)[0]))
                for r in np.unique(np.searchsorted(w.first, at, "right") - 1).tolist():
                    yield r, i, n, True


_SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("item_id", T.LongType()), ("lcs_words", T.IntegerType()), ("item_words", T.IntegerType()), ("verbatim", T.BooleanType()))])


def _found(search: Search) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, found = [], []
            for x in blocks(b.column(1)):
                for r, item, common, near in search.block(x):
                    rows.append(r + x.first)
                    found.append((item.id, common, item.size, near))
            if rows:
                item, common, size, near = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(item, pa.int64()), pa.array(common, pa.int32()), pa.array(size, pa.int32()), pa.array(near)], names=_SCHEMA.names)

    return run


def _searches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, Iterator[Search]]:
    """The texts as (doc_id, text), and a search for each block of items."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    runs = math.ceil(bench.count() / BLOCK)

    def made() -> Iterator[Search]:
        vectors = None
        for k in range(runs):
            some = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(runs)) == k).collect()
            items = items_of([(r.item_id, r.text) for r in some])
            if items:
                vectors = basis(texts) if vectors is None else vectors
                yield Search(items, vectors)

    return texts, made()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs_words, item_words, verbatim: which documents hold which items."""
    texts, searches = _searches(docs, benchmark)
    found = docs.sparkSession.createDataFrame([], _SCHEMA)
    for search in searches:
        found = found.union(texts.mapInArrow(_found(search), _SCHEMA))
    best = F.max(F.struct("lcs_words", "item_words", "verbatim")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _leaky(search: Search) -> Callable[[Column], Column]:
    @F.arrow_udf(T.BooleanType())
    def leaky(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), dtype=bool)
        for x in blocks(text):
            for r, *_ in search.block(x):
                out[r + x.first] = True
        return pa.array(out)

    return leaky


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds an item, all columns kept."""
    _, searches = _searches(docs, benchmark)
    out = docs
    for search in searches:
        out = out.filter(~_leaky(search)(docs["text"].cast("string")))
    return out
