"""Sources: JSON wrappers, Markdown trees, news files, paginated REST, PDF, and the dispatcher over them."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quernal.functions import html
from quernal.functions.text import strip_prefix, summary
from quernal.session import cut, ship


def load_config(path: str) -> dict:
    """A YAML or JSON file as a dictionary; a missing or unreadable one is an empty dictionary."""
    try:
        raw = Path(path).read_text(encoding="utf-8")
    except OSError:
        return {}
    try:
        found = json.loads(raw)
    except ValueError:
        try:
            import yaml
        except ImportError:
            return {}
        try:
            found = yaml.safe_load(raw)
        except yaml.YAMLError:
            return {}
    return found if isinstance(found, dict) else {}


def setting(config: dict, *keys: str, default: object = None):  # noqa: ANN201
    """A nested setting, the default where a level is missing."""
    for k in keys:
        if not isinstance(config, dict) or k not in config:
            return default
        config = config[k]
    return config


def is_enabled(config: dict, source: str) -> bool:
    return bool(setting(config, "sources", source, "enabled", default=False))


def located(path: str, base: str) -> str:
    """A relative path below base; an absolute one as it is."""
    return path if os.path.isabs(path) or "://" in path else f"{base.rstrip('/')}/{path}"


def missing(paths: list[str]) -> list[str]:
    """The local paths that don't exist."""
    return [p for p in paths if not Path(p).exists()]


class Dispatcher:
    """Runs sources by name; one that isn't known or fails is reported, and the others go on."""

    def __init__(self, config: dict, sources: dict[str, Callable[[], DataFrame]]) -> None:
        self.config, self.sources = config, sources

    def run(self, wanted: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """DataFrames and failures by source; all that the configuration enables unless some are named."""
        frames, failed = {}, {}
        for name in wanted if wanted is not None else [s for s in self.sources if is_enabled(self.config, s)]:
            if name not in self.sources:
                failed[name] = "unknown source"
                continue
            try:
                frames[name] = self.sources[name]()
            except Exception as e:  # noqa: BLE001
                failed[name] = f"{type(e).__name__}: {e}"
        return frames, failed


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON files of one object each; what can't be parsed is in _corrupt_record."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).json(path)


def unwrap(df: DataFrame, key: str | None = None) -> DataFrame:
    """The items of a wrapper with a single array of objects, one a row; other records as they are."""
    columns = [c for c in df.columns if c != "_corrupt_record"]
    name = key or (columns[0] if len(columns) == 1 else None)
    kind = dict(df.dtypes).get(name, "") if name else ""
    if not kind.startswith("array<struct"):
        return df
    return df.select(F.explode(name).alias("i")).select("i.*")


def markdown_files(spark: SparkSession, folder: str, excluded: tuple[str, ...] = ("api",)) -> DataFrame:
    """path, file_name, folders, content of the Markdown files below folder, without those in an excluded folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folders"), F.col("value").alias("content"))
    return named.filter(~F.arrays_overlap("folders", F.array(*[F.lit(x) for x in excluded]))) if excluded else named


def knowledge_files(spark: SparkSession, enriched: str, raw: str) -> DataFrame:
    """Enriched files, and the raw ones of which there is no enriched version."""
    new = markdown_files(spark, enriched, ()).withColumn("is_enriched", F.lit(True))
    old = markdown_files(spark, raw).withColumn("is_enriched", F.lit(False))
    done = new.select(strip_prefix(F.col("file_name")).alias("file_name")).distinct()
    return new.unionByName(old.join(done, "file_name", "left_anti").select(*new.columns))


def group_documents(spark: SparkSession, folder: str) -> DataFrame:
    """slug, content and summary of the group files; the summary is the extractive one, `enrich.summaries` gives a model's."""
    files = markdown_files(spark, folder, ()).select(F.regexp_replace("file_name", r"\.md$", "").alias("slug"), "content")
    return files.withColumn("summary", summary(F.col("content")))


def in_order(files: DataFrame) -> DataFrame:
    """The files by path, with pos counting from 0 in that order within each folder."""
    w = Window.partitionBy(F.array_join("folders", "/")).orderBy("path")
    return files.withColumn("pos", F.row_number().over(w) - 1)


def zipped(contents: Column, metadata: Column) -> Column:
    """An array of (content, metadata) by position; the shorter array gives nulls."""
    return F.transform(F.arrays_zip(contents.alias("content"), metadata.alias("metadata")), lambda x: F.struct(x["content"].alias("content"), x["metadata"].alias("metadata")))


def _by_page(pages: DataFrame, make: Callable[..., dict], schema: str, *columns: str) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [make(*(None if pd.isna(v) else v for v in r)) for r in pdf[list(columns)].itertuples(index=False)]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pd.concat([pdf[["url"]].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

    ship(pages.sparkSession)
    return pages.select("url", *[c for c in columns if c != "url"]).mapInPandas(run, f"url string, {schema}")


def news(pages: DataFrame) -> DataFrame:
    """url, title, date, image_url, content of news pages(url, html)."""
    return _by_page(pages, html.news_article, "title string, date string, image_url string, content string", "html")


def publication_cards(pages: DataFrame) -> DataFrame:
    return _by_page(pages, html.publication_card, "kind string, title string, doi string", "html")


def publication_details(pages: DataFrame) -> DataFrame:
    return _by_page(pages, html.publication_details, "abstract string, keywords array<string>", "html", "url")


def menu(pages: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """url, text, href of the navigation items in the pages' headers; ignored texts are left out."""
    found = _by_page(pages, lambda h: {"items": [{"text": t, "href": x} for t, x in html.navigation(h, ignored)]}, "items array<struct<text:string,href:string>>", "html")
    return found.select("url", F.inline("items"))


def seed_links(entries: DataFrame, main_url: str) -> DataFrame:
    """category, name, url: an entry(category, name, href) with a target keeps it, others get a hyphenated name below main_url."""
    made = F.concat(F.lit(main_url + "/"), F.lower(F.replace("name", F.lit(" "), F.lit("-"))))
    return entries.select("category", "name", F.coalesce(F.nullif("href", F.lit("")), made).alias("url"))


def or_default(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """found, or the fallback where it is empty."""
    return fallback if found.isEmpty() else found


class _Page(InputPartition):
    def __init__(self, page: int, found: dict | None = None) -> None:
        super().__init__(page)
        self.found = found


class PagedRest(DataSource):
    """POST requests by page number: `spark.read.format("paged_rest").options(url=.., per_page=.., last_page=.., token=.., timeout=..)`.

    Page and page size are query parameters, the body is empty. The first page is fetched while planning, as it tells the last page; its failure fails the
    read. One partition for each page, so pages are fetched in parallel by the executors. Items are JSON texts; a page that fails is a row with its error, and
    `until_failure` leaves out what a sequential reader would not have reached.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "page int, item string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def _fetch(self, page: int) -> dict:
        from urllib.parse import urlencode
        from urllib.request import Request, urlopen

        url = self.options["url"]
        query = urlencode({"page": page, "per_page": int(self.options.get("per_page", 100))})
        head = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.options['token']}"} if self.options.get("token") else {})
        with urlopen(Request(f"{url}{'&' if '?' in url else '?'}{query}", b"", head, method="POST"), timeout=float(self.options.get("timeout", 30))) as r:  # noqa: S310
            found = json.load(r)
        return found if isinstance(found, dict) else {"data": found}

    def partitions(self) -> list[InputPartition]:
        first = self._fetch(1)
        last = self.options.get("last_page") or setting(first, "meta", "last_page", default=1)
        return [_Page(1, first), *(_Page(k) for k in range(2, int(last) + 1))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            found = partition.found or self._fetch(partition.value)
        except (OSError, ValueError) as e:
            yield partition.value, None, f"{type(e).__name__}: {e}"
            return
        for item in found.get("data") or []:
            yield partition.value, json.dumps(item, ensure_ascii=False), None


def until_failure(pages: DataFrame) -> DataFrame:
    """page, item of the pages before the first that failed."""
    failed = pages.filter("error is not null").agg(F.coalesce(F.min("page"), F.lit(2**31 - 1)).alias("stop"))
    return pages.filter("error is null").join(F.broadcast(failed), F.col("page") < F.col("stop")).select("page", "item")


def endpoint(spark: SparkSession, url: str, **options: object) -> DataFrame | None:
    """The items of one endpoint, fetched once; None if its first page fails, what came before a later page's failure otherwise."""
    ship(spark)
    spark.dataSource.register(PagedRest)
    try:
        return cut(until_failure(cut(spark.read.format("paged_rest").options(url=url, **{k: str(v) for k, v in options.items() if v is not None}).load())))
    except Exception as e:  # noqa: BLE001
        logging.getLogger(__name__).warning("%s: %s", url, e)
        return None


def endpoints(spark: SparkSession, urls: dict[str, str], **options: object) -> dict[str, DataFrame | None]:
    """Every endpoint's items by name, one endpoint after the other."""
    return {name: endpoint(spark, url, **options) for name, url in urls.items()}


def _get(url: str, timeout: float) -> str:
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def fetch_pages(addresses: DataFrame, timeout: float = 10, get: Callable[[str, float], str] = _get) -> DataFrame:
    """url, html, error: each address(url) fetched by the executors; a failure is a row with its error and no html."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for url in pdf["url"]:
                try:
                    rows.append((url, get(url, timeout), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    ship(addresses.sparkSession)
    return addresses.select("url").mapInPandas(run, "url string, html string, error string")


def pdf_texts(spark: SparkSession, folder: str, convert: Callable[[bytes], str]) -> DataFrame:
    """path, content of the PDF files below folder; `convert` turns one file's bytes into Markdown and runs in batches."""
    run = F.pandas_udf(lambda s: s.map(convert).astype(object), "string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(folder)
    return files.select("path", run("content").alias("content"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
