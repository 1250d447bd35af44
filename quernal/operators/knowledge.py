"""The knowledge base: files to sections to chunks with context, ready for both search legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernal.operators import chunking

#: What a chunk says about itself, beside its text.
COLUMNS = ("chunk_id", "source_file", "type", "is_enriched", *chunking.HEADERS, "chunk_no", "text")


def build(files: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """One row a chunk, with COLUMNS, from files(path, file_name, folders, content, is_enriched).

    Header sections first, then recursive splits inside them; chunks without content are dropped, the rest get their file's type, a line of context
    before the text, and an id from text and metadata, by which equal chunks are one. All up to the last step is one pass without a shuffle.
    """
    named = files.select("path", "file_name", "folders", "is_enriched", F.col("content").alias("text"))
    parts = chunking.recursive(chunking.sections(named, rest=("file_name", "folders", "is_enriched"), key="path"), size, overlap)
    typed = parts.filter(chunking.useful(F.col("text"))).withColumn("type", chunking.doc_type(F.col("file_name"), F.col("folders")))
    text = chunking.with_prefix(F.col("text"), F.col("type"), F.col("entity_name"), F.col("section"), F.col("item_name"))
    about = [F.col("file_name"), F.col("type"), F.col("is_enriched"), *[F.col(h) for h in chunking.HEADERS]]
    chunks = typed.withColumn("text", text).withColumn("chunk_id", chunking.chunk_id(F.col("text"), *about)).withColumnRenamed("file_name", "source_file")
    return chunking.distinct(chunks.select(*COLUMNS, "path", "sid"), ["path", "sid", "chunk_no"]).select(*COLUMNS)


def counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_before, n_after, n_dropped of a deduplication, in one row."""
    n = before.agg(F.count("*").alias("n_before")).join(after.agg(F.count("*").alias("n_after")))
    return n.withColumn("n_dropped", F.col("n_before") - F.col("n_after"))


def warm(chunks: DataFrame) -> int:
    """Keeps an index in the executors' memory, spilling to their disks, and gives its number of rows."""
    return chunks.persist().count()
