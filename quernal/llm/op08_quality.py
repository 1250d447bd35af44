"""Quality rules: repetition coverage.

For each text, how many of its characters lie inside word n-grams that the text has had before, for several n,
and inside lines that it has had before. Words are runs between ASCII white space; a word's characters are its
code points. Each occurrence of an n-gram after its first covers its words, and a covered word counts once
however many n-grams cover it. A line is what lies between line feeds; lines of white space alone are left out;
each occurrence of a line after its first counts.

A document is rejected if for some n the share of covered characters among the characters of its words
is over LIMITS[n], or the share of the repeated lines' characters is over LINE_LIMIT.

Defined cases: a null or empty text, and one of white space alone, has no words and counts 0 throughout; it is
kept, as there is nothing that it repeats. Texts shorter than n words have no n-gram. A null doc_id is carried
through; repeated rows are measured each for itself; an empty table gives an empty result. Extra columns,
whatever their names, don't matter: `measure` reads doc_id and text alone, `keep` returns the rows as they are.
The work is one pass without a shuffle, over blocks of about 1 MB, so that memory doesn't follow the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernal.llm.words import LINE, SPACE, Block, Words, blocks, chars, grams, mix, per_row, whole, words
from quernal.session import ship

#: Largest share of characters in repeated n-grams, by n.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in repeated lines.
LINE_LIMIT = 0.30
NAMES = ("n_words", "word_chars", *(f"dup{n}_chars" for n in LIMITS), "line_chars", "dup_line_chars")


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occurred before."""
    out = np.ones(len(keys), dtype=bool)
    if len(keys):
        order = np.argsort(keys)
        fresh = np.flatnonzero(np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]))
        out[np.minimum.reduceat(order, fresh)] = False
    return out


def _measure(block: Block) -> dict[str, np.ndarray]:
    w: Words = words(block, SPACE)
    size = chars(block.data, w.start, w.end)
    row = w.row()
    salt = mix(row.astype(np.uint64) + np.uint64(1))
    out = {"n_words": np.diff(w.first), "word_chars": per_row(size, w.first)}
    for n in LIMITS:
        g = grams(w.hash, n)
        at = np.flatnonzero(whole(w.first, n))
        at = at[repeated(g[at] + salt[at])]
        step = np.zeros(len(size) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + n, -1)
        out[f"dup{n}_chars"] = per_row(size * (np.cumsum(step)[:-1] > 0), w.first)
    line = words(block, LINE)
    filled = (SPACE[block.data] != 0).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(filled)])
    size = chars(block.data, line.start, line.end) * (total[line.end] > total[line.start])
    again = repeated(line.hash + mix(line.row().astype(np.uint64) + np.uint64(1)))
    out["line_chars"] = per_row(size, line.first)
    out["dup_line_chars"] = per_row(size * again, line.first)
    return out


def _measured(column: pa.Array | pa.ChunkedArray) -> list[pa.Array]:
    parts: dict[str, list[np.ndarray]] = {n: [] for n in NAMES}
    for b in blocks(column):
        for n, x in _measure(b).items():
            parts[n].append(x)
    return [pa.array(np.concatenate(parts[n]).astype(np.int64) if parts[n] else np.zeros(0, np.int64)) for n in NAMES]


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        yield pa.RecordBatch.from_arrays([b.column(0), *_measured(b.column(1))], names=["doc_id", *NAMES])


def _keeps(n: dict) -> object:
    """The rule, on columns or numbers of measures by name. In whole numbers: no rounding anywhere."""
    ok = n["dup_line_chars"] * 100 <= n["line_chars"] * round(LINE_LIMIT * 100)
    for k, limit in LIMITS.items():
        ok = ok & (n[f"dup{k}_chars"] * 100 <= n["word_chars"] * round(limit * 100))
    return ok


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and `keep`, a row for each row of docs."""
    ship(docs.sparkSession)
    schema = "doc_id bigint, " + ", ".join(f"{n} bigint" for n in NAMES)
    found = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_batches, schema)
    return found.withColumn("keep", _keeps({n: F.col(n) for n in NAMES}))


@F.arrow_udf(T.BooleanType())
def _kept(text: pa.Array) -> pa.Array:
    return pa.array(_keeps({n: x.to_numpy() for n, x in zip(NAMES, _measured(text), strict=True)}))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules don't reject, with all their columns."""
    ship(docs.sparkSession)
    return docs.filter(_kept(docs["text"].cast("string")))


def oracle() -> str:
    """The same measures in DuckDB SQL."""
    space = r"[\t\n\x0b\x0c\r ]+"
    pads = ", ".join(f"max(d{n}) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in LIMITS)
    dups = ", ".join(f"CASE WHEN g{n} IS NOT NULL AND i > min(i) OVER (PARTITION BY rid, g{n}) THEN 1 ELSE 0 END AS d{n}" for n in LIMITS)
    lead = ", ".join("w || ' ' || " + " || ' ' || ".join(f"lead(w, {k}) OVER o" for k in range(1, n)) + f" AS g{n}" for n in LIMITS)
    sums = ", ".join(f"CAST(coalesce(sum(CASE WHEN c{n} = 1 THEN length(w) END), 0) AS BIGINT) AS dup{n}_chars" for n in LIMITS)
    rule = " AND ".join([f"coalesce(dup_line_chars, 0) * 100 <= coalesce(line_chars, 0) * {round(LINE_LIMIT * 100)}", *(f"coalesce(dup{n}_chars, 0) * 100 <= coalesce(word_chars, 0) * {round(x * 100)}" for n, x in LIMITS.items())])
    names = ", ".join(f"CAST(coalesce({n}, 0) AS BIGINT) AS {n}" for n in NAMES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
s AS (SELECT rid, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS ws FROM d WHERE text IS NOT NULL),
u AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM s),
g AS (SELECT rid, i, w, {lead} FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, w, {dups} FROM g),
c AS (SELECT rid, w, {pads} FROM r),
m AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, {sums} FROM c GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
f AS (SELECT rid, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\t\n\x0b\x0c\r ]') GROUP BY rid, line),
n AS (SELECT rid, sum(length(line) * n) AS line_chars, sum(length(line) * (n - 1)) AS dup_line_chars FROM f GROUP BY rid)
SELECT doc_id, {names}, ({rule}) AS keep FROM d LEFT JOIN m USING (rid) LEFT JOIN n USING (rid)
"""
