"""Packing by non-negative least squares over length combinations.

Texts are cut into pieces of WINDOW tokens at most; a token is a UTF-8 byte, plus one end token for each text, unless `tokens`
gives another column of lengths. Piece lengths go up to the next multiple of UNIT, so the histogram has WINDOW / UNIT bins. All
combinations of up to PARTS bins that fill a window exactly are enumerated; non-negative least squares finds repeat counts that
reproduce the histogram (short supply weighs WEIGHT times as much as surplus), counts are rounded down and filled from the pieces. What is left
over is packed greedily, longest first, each piece into the fullest window that still takes it.

The histogram covers all documents. Pieces are then spread by hash over shards of about SHARD pieces; each shard applies its own
part of the combinations and packs its own residuals, so no task holds more than a shard's lengths, and texts never move.

A result row is a piece: doc_id, piece, start, n_tokens, window (text, unique), offset in the window. Sums of n_tokens by window never pass WINDOW.

Defined cases: null and empty texts have no tokens and no row. Texts longer than WINDOW give several pieces, counted from 0. A null
doc_id is carried through. Repeated rows are packed each for itself. Equal lengths are taken in the order of doc_id, then
piece. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernal.session import cut, ship

WINDOW = 8192
UNIT = 64
PARTS = 3
WEIGHT = 4.0
SHARD = 50_000
SCHEMA = "doc_id bigint, piece bigint, start bigint, n_tokens int, window string, offset int"


def combinations(bins: int, parts: int = PARTS) -> list[tuple[int, ...]]:
    """All multisets of at most `parts` bin numbers 1..bins with sum `bins`."""
    out: list[tuple[int, ...]] = [(bins,)]
    for n in range(2, parts + 1):
        for c in combinations_with_replacement(range(1, bins), n - 1):
            if (rest := bins - sum(c)) >= c[-1]:
                out.append((*c, rest))
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by accelerated projected gradients."""
    x = np.zeros(a.shape[1])
    if not b.any():
        return x
    step = 1 / np.linalg.norm(a, 2) ** 2
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        if (y - new) @ (new - x) > 0:
            t = 1.0
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def solve(histogram: np.ndarray, mixes: list[tuple[int, ...]]) -> np.ndarray:
    """Repeat counts, as shares of one: how often each combination is used for each piece there is."""
    bins = len(histogram)
    a = np.zeros((bins, len(mixes)))
    for k, m in enumerate(mixes):
        np.add.at(a[:, k], np.array(m) - 1, 1)
    share = histogram / max(1, histogram.sum())
    row = np.where(np.arange(bins) >= bins // 2, WEIGHT, 1.0)
    return nnls(a * row[:, None], share * row)


def pack(lengths: np.ndarray, counts: np.ndarray, mixes: list[tuple[int, ...]], window: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, in the order given, its window's number and its offset there."""
    bins = window // unit
    bin_of = -(-lengths // unit)
    queue: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        queue[int(bin_of[i])].append(i)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    windows = 0
    for k in np.argsort(-counts, kind="stable"):
        n = int(counts[k])
        if n < 1:
            break
        need: dict[int, int] = defaultdict(int)
        for m in mixes[k]:
            need[m] += 1
        for _ in range(min(n, *(len(queue[m]) // c for m, c in need.items()))):
            at = 0
            for m in mixes[k]:
                i = queue[m].pop()
                where[i], offset[i] = windows, at
                at += int(lengths[i])
            windows += 1
    room: list[list[int]] = [[] for _ in range(bins + 1)]
    filled: dict[int, int] = {}
    spare = 0
    for b in range(bins, 0, -1):
        for i in reversed(queue[b]):
            fit = next((r for r in range(b, bins + 1) if spare >> r & 1), None)
            if fit is None:
                w, left = windows, bins
                filled[w] = 0
                windows += 1
            else:
                w, left = room[fit].pop(), fit
                if not room[fit]:
                    spare &= ~(1 << fit)
            where[i], offset[i] = w, filled[w]
            filled[w] += int(lengths[i])
            if left - b:
                room[left - b].append(w)
                spare |= 1 << (left - b)
    return where, offset


def _packer(shares: np.ndarray, mixes: list[tuple[int, ...]], window: int, unit: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["n_tokens", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", na_position="first")
        where, offset = pack(pieces["n_tokens"].to_numpy(), np.floor(shares * len(pieces) + 1e-9), mixes, window, unit)
        return pieces[["doc_id", "piece", "start", "n_tokens"]].assign(window=[f"{key[0]}-{w}" for w in where.tolist()], offset=offset.astype(np.int32))

    return run


def windows(docs: DataFrame, window: int = WINDOW, unit: int = UNIT, tokens: Column | None = None, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start, n_tokens, window, offset: where each piece of each text goes."""
    ship(docs.sparkSession)
    n = F.octet_length(F.col("text").cast("string")) if tokens is None else tokens
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), n.cast("bigint").alias("n")).filter("n > 0").withColumn("n", F.col("n") + 1)
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / window).cast("bigint"))).alias("piece")
    cells = sized.select("doc_id", "n", piece).select("doc_id", "piece", (F.col("piece") * window).alias("start"), F.least(F.lit(window), F.col("n") - F.col("piece") * window).cast("int").alias("n_tokens"))
    cells = cut(cells)
    found = cells.groupBy(F.ceil(F.col("n_tokens") / unit).alias("bin")).count().collect()
    histogram = np.zeros(window // unit)
    for r in found:
        histogram[r["bin"] - 1] = r["count"]
    mixes = combinations(window // unit)
    shares = solve(histogram, mixes)
    used = np.flatnonzero(shares > 0)
    shards = max(1, -(-int(histogram.sum()) // shard))
    keyed = cells.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return keyed.groupBy("shard").applyInPandas(_packer(shares[used], [mixes[k] for k in used], window, unit), SCHEMA)
