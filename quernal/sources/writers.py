"""Sinks: JSON, Markdown, CSV, and an upsert by content id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.functions.text import filename, slug
from quernal.session import cut

FORMATS = ("json", "markdown", "both")


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in folders by a column's values if one is named."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


def write_text(df: DataFrame, path: str, text: str = "markdown", by: str | None = None) -> None:
    """One text a row, in folders by a column's values if one is named. A text may hold line feeds; they stay."""
    out = df.select(F.col(text).alias("value"), *([by] if by else [])).write.mode("overwrite").option("lineSep", "\n")
    (out.partitionBy(by) if by else out).text(path)


def write(df: DataFrame, path: str, kind: str = "both", text: str = "markdown", by: str | None = None) -> dict[str, str]:
    """By format: json, markdown or both; the folders written, by format. Another format is an error."""
    if kind not in FORMATS:
        raise ValueError(f"format {kind} isn't one of {', '.join(FORMATS)}")
    done = {}
    if kind != "markdown":
        write_json(df.drop(text), f"{path}/json", by)
        done["json"] = f"{path}/json"
    if kind != "json":
        write_text(df, f"{path}/markdown", text, by)
        done["markdown"] = f"{path}/markdown"
    return done


def wrapped(df: DataFrame, name: str, *order: str) -> DataFrame:
    """One row of JSON {name: [items]}: for exports that fit one file; large tables are better kept as lines."""
    item = F.struct(*order, F.struct(*df.columns).alias("item"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda s: s["item"])
    return df.agg(F.to_json(F.struct(items.alias(name))).alias("value"))


def combined(df: DataFrame, entry: str, order: list[str]) -> DataFrame:
    """One row: a count, then all entries in order, as a single document."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(entry).alias("__entry"))))
    return df.agg(F.concat(F.lit("# News\n\nTotal: "), F.count("*").cast("string"), F.lit("\n\n"), F.array_join(F.transform(ordered, lambda s: s["__entry"]), "")).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def file_path(category: Column, sub: Column, name: Column, extension: str = "md") -> Column:
    """category/sub/name by slugs and a safe file name; a null sub is left out."""
    return F.concat_ws("/", slug(category), slug(sub), F.concat(filename(name), F.lit(f".{extension}")))


def upsert(spark: SparkSession, fresh: DataFrame, path: str, key: str = "chunk_id") -> int:
    """Appends the rows whose id the table at path doesn't have; the number appended.

    Ids are digests of the content, so an id that is there needs no update, and a repeated run adds nothing.
    """
    first = fresh.dropDuplicates([key])
    try:
        have = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = None
    new = cut(first if have is None else first.join(have, key, "left_anti"))
    n = new.count()
    if n or have is None:
        new.write.mode("append").parquet(path)
    return n
