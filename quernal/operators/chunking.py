"""Chunking: header sections, fixed and recursive splits, context prefixes, filters and content ids."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernal.functions.text import strip, title_case
from quernal.session import ship, unused

HEADERS = ("document_title", "entity_name", "section", "item_name")
SIZE, OVERLAP = 1500, 250
SEPARATORS = tuple("\n\n|\n| |".split("|"))
LEAST = 50
#: Texts that a task holds in pieces at a time.
SLICE = 50


_MARK = re.compile("(#{1,4})(?: +(.*))?")
_CHUNK = T.StructType([T.StructField("chunk_no", T.IntegerType()), T.StructField("text", T.StringType())])
_SECTION = T.StructType([T.StructField("sid", T.LongType()), *[T.StructField(h, T.StringType()) for h in HEADERS], T.StructField("text", T.StringType())])


def split_sections(text: str) -> list[tuple]:
    """(number, the four headers that hold, text) of each section; a header ends those of its level and below."""
    out: list[tuple] = []
    names: list[str | None] = [None] * len(HEADERS)
    held: list[str] = []
    sid, fenced = 0, False
    for line in text.split("\n"):
        bare = line.strip(" ")
        fence = bare.startswith("```")
        found = None if fenced or fence or not bare.startswith("#") else _MARK.fullmatch(bare)
        if found:
            if held:
                out.append((sid, *names, "\n".join(held)))
                held = []
            sid += 1
            level = len(found[1])
            names[level - 1 :] = [(found[2] or "").strip(" "), *[None] * (len(HEADERS) - level)]
        fenced ^= fence
        held.append(line)
    return [*out, (sid, *names, "\n".join(held))]


def _pieces(docs: DataFrame, kept: list[str], split: Callable[[str | None], list[tuple]], added: T.StructType) -> DataFrame:
    """kept columns and those of `added`: a row for each piece of a text.

    A task holds the pieces of SLICE texts at a time, so that its memory is that of an Arrow batch of texts, however many rows the table has.
    """
    ship(docs.sparkSession)
    own = list(to_arrow_schema(added))
    schema = T.StructType([*docs.select(*kept).schema, *added])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                found = [split(t) for t in part.column(len(kept)).to_pylist()]
                rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                values = list(zip(*itertools.chain.from_iterable(found), strict=True)) or [()] * len(own)
                columns = [*[part.column(i).take(rows) for i in range(len(kept))], *[pa.array(v, f.type) for v, f in zip(values, own, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select(*kept, F.col("text").cast("string").alias(unused(kept, "text"))).mapInArrow(run, schema)


def sections(docs: DataFrame, key: str = "doc_id", rest: tuple[str, ...] = ()) -> DataFrame:
    """key, rest, sid, the four header columns and text: one row for each section, headers kept in its text.

    Sections are numbered from 0, the lines before the first header, where there are any. Hash marks inside code fences are no headers. A document
    is cut where it stands, in Arrow batches: nothing is shuffled.
    """
    return _pieces(docs, [key, *rest], lambda t: [] if t is None else split_sections(t), _SECTION)


def fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs with chunk_no and text, cut every size - overlap characters; native, no shuffle."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - overlap), F.lit(size - overlap))
    rest = [c for c in docs.columns if c != "text"]
    return docs.filter(F.col("text").isNotNull()).select(*rest, "text", F.posexplode(starts).alias("chunk_no", "start")).withColumn("text", F.substr("text", F.col("start"), F.lit(size))).drop("start")


def split_recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces split at the first separator that occurs, too long ones again at finer ones, then joined up to `size` with an overlap of whole pieces."""
    if len(text) <= size:
        return [text] if text.strip() else []
    k = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep = separators[k]
    parts = text.split(sep) if sep else [text[i : i + size] for i in range(0, len(text), size - overlap)]
    if not sep:
        return [p for p in parts if p.strip()]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held and sep.join(held).strip():
            out.append(sep.join(held))

    for p in parts:
        if len(p) > size:
            flush()
            held.clear()
            out.extend(split_recursive(p, size, overlap, separators[k + 1 :]))
            continue
        if held and len(sep.join([*held, p])) > size:
            flush()
            while held and (len(sep.join(held)) > overlap or len(sep.join([*held, p])) > size):
                held.pop(0)
        held.append(p)
    flush()
    return out


def recursive(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs with chunk_no and text by recursive splits, in Arrow batches; no shuffle."""
    return _pieces(docs, [c for c in docs.columns if c != "text"], lambda t: list(enumerate(split_recursive(t or "", size, overlap))), _CHUNK)


def useful(c: Column) -> Column:
    """Neither an empty listing nor under LEAST characters without its hyphens."""
    low = F.lower(c)
    return ~F.contains(low, F.lit("no projects found")) & ~F.contains(low, F.lit("no public records found")) & (F.length(strip(F.replace(c, F.lit("-"), F.lit("")))) >= LEAST)


def doc_type(file: Column, folders: Column) -> Column:
    """Kind of document by file name and the folders of its path."""
    name = F.lower(file)
    return (
        F.when(name == "enriched_api-users.md", "researcher_profile").when(name == "enriched_projects_full.md", "research_project").when(F.array_contains(folders, "news"), "news_article")
        .when(F.startswith(name, F.lit("enriched_")), "research_group").otherwise("general_research_data")
    )


def with_prefix(text: Column, kind: Column, entity: Column, section: Column, item: Column) -> Column:
    """[Context: Kind | About: .. | Section: .. | Item: ..] and the text; what is null is left out."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    return F.concat(F.lit("["), F.concat_ws(" | ", part("Context", title_case(F.replace(kind, F.lit("_"), F.lit(" ")))), part("About", entity), part("Section", section), part("Item", item)), F.lit("]\n"), text)


def chunk_id(*parts: Column) -> Column:
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def distinct(chunks: DataFrame, order: list[str], key: str = "chunk_id") -> DataFrame:
    """One row for each id, the first by `order`: a map-side combined aggregation rather than a sort."""
    rest = [c for c in chunks.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("s")
    return chunks.groupBy(key).agg(first).select(key, "s.*")
