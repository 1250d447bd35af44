"""URL filters: logistic regression on hashed character n-grams of host and path.

Features are the character n-grams (SIZES) of host and path, in small letters with a mark at either end, hashed to DIMENSIONS with host and path
apart; a feature's value is its count over the square root of the number of n-grams. Training is on the driver, from a small
labelled table (url, label 0/1, 1 for unwanted) of which at most TRAIN_ROWS rows are used, by full-batch accelerated gradients with an L2 penalty,
classes weighted alike. The weights, DIMENSIONS floats whatever the data, go to the tasks, which score all URLs block by block in numpy.

Result: page_id, url, host, score (log odds, six places), unwanted (score over 0).

Defined cases: a null URL, or one without a host, has a null score and isn't unwanted; null page_ids and repeated rows are carried through; very
long URLs are scored over all their n-grams; an empty table gives an empty result; extra columns aren't read. A labelled table without
both classes gives score 0 to all. Null labels or URLs in it are left out.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.llm.words import Block, blocks, grams, mix, per_row, whole
from quernal.session import ship

SIZES = (3, 4, 5)
DIMENSIONS = 1 << 16
TRAIN_ROWS = 20_000
PENALTY = 1e-3
_PARTS = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?P<host>[^/?#:]*)(?::[0-9]*)?(?P<path>[^?#]*)"


def split(urls: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Host and path of each URL in small letters; null where there is no host."""
    found = pc.extract_regex(pc.utf8_lower(urls), _PARTS)
    host, path = pc.struct_field(found, "host"), pc.struct_field(found, "path")
    ok = pc.fill_null(pc.not_equal(host, ""), False)
    none = pa.scalar(None, pa.string())
    return pc.if_else(ok, host, none), pc.if_else(ok, path, none)


def _characters(x: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block and where its rows begin among them."""
    points = np.frombuffer(x.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((x.data & 0xC0) != 0x80)])
    return points, starts[x.offsets]


def _features(part: pa.Array, salt: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each block its first row, where its rows begin, and for each size the hashed n-grams and which of them lie within one row."""
    marked = pc.binary_join_element_wise("^", pc.fill_null(part, ""), "$", "")
    for x in blocks(marked):
        points, first = _characters(x)
        h = mix(points.astype(np.uint64) * np.uint64(salt))
        yield x.first, first, [((grams(h, n) % np.uint64(DIMENSIONS)).astype(np.int64), whole(first, n)) for n in SIZES]


_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def scores(host: pa.Array, path: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros(len(host)), np.zeros(len(host))
    for part, salt in zip((host, path), _SALTS, strict=True):
        for at, first, found in _features(part, salt):
            rows = slice(at, at + len(first) - 1)
            for k, ok in found:
                pad = np.zeros(int(first[-1]) - len(k))
                total[rows] += per_row(np.concatenate([np.where(ok, weights[k], 0.0), pad]), first)
                count[rows] += per_row(np.concatenate([ok.astype(float), pad]), first)
    return total / np.sqrt(np.maximum(count, 1)) + bias


def train(urls: list[str], labels: list[int], rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(DIMENSIONS), 0.0
    host, path = split(pa.array(urls, pa.string()))
    rows, cols = [], []
    for part, salt in zip((host, path), _SALTS, strict=True):
        for at, first, found in _features(part, salt):
            of = np.repeat(np.arange(len(first) - 1), np.diff(first)) + at
            for k, ok in found:
                rows.append(of[: len(k)][ok])
                cols.append(k[ok])
    row, col = np.concatenate(rows), np.concatenate(cols)
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))[row]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w = z = np.zeros(DIMENSIONS)
    b = c = 0.0
    t, step = 1.0, 4.0 / max(1.0, float(np.max(np.bincount(row, value**2, minlength=len(y)))) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, value * z[col], minlength=len(y)) + c)))
        g = weight * (p - y)
        new_w = z - step * (np.bincount(col, value * g[row], minlength=DIMENSIONS) + PENALTY * z)
        new_b = c - step * g.sum()
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, c = new_w + (t - 1) / after * (new_w - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new_w, new_b, after
    return w, float(b)


def _scored(weights: np.ndarray, bias: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            host, path = split(b.column(1))
            s = np.round(scores(host, path, weights, bias), 6)
            known = pc.is_valid(host)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), host, pc.if_else(known, pa.array(s), pa.scalar(None, pa.float64())), pc.and_(known, pa.array(s > 0))], names=["page_id", "url", "host", "score", "unwanted"])

    return run


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table that comes with the package, labelled_urls.csv."""
    with (Path(__file__).parent / "labelled_urls.csv").open(encoding="utf-8", newline="") as f:
        return [(r["url"], int(r["label"])) for r in csv.DictReader(f)]


def score_urls(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, score, unwanted, a row for each row of pages."""
    spark: SparkSession = pages.sparkSession
    ship(spark)
    if labelled is None:
        table = labelled_urls()
    else:
        some = labelled.select("url", F.col("label").cast("int").alias("label")).filter("url is not null and label is not null")
        table = [tuple(r) for r in some.orderBy(F.xxhash64("url"), "url", "label").limit(TRAIN_ROWS).collect()]
    weights, bias = train([u for u, _ in table], [y for _, y in table])
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string")).mapInArrow(_scored(weights, bias), "page_id bigint, url string, host string, score double, unwanted boolean")
