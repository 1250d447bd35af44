"""Whole runs over configured sources: fetch, save, convert, crawl, enrich, index, report; and the command line."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.functions import html, render
from quernal.operators import crawl, observe
from quernal.sources import readers, writers
from quernal.sources.readers import setting


@dataclass
class Settings:
    """What the sources need, from a configuration's sections, with defaults where they say nothing."""

    static_seeds: list[str] = field(default_factory=list)
    static_domain: str = ""
    api_urls: dict[str, str] = field(default_factory=dict)
    api_token_name: str = "API_TOKEN"
    api_page: int = 100
    api_timeout: float = 30
    categories: list[str] = field(default_factory=list)
    news_host: str = ""
    kind: str = "both"
    folder: str = "data"

    @classmethod
    def of(cls, config: dict) -> Settings:
        g = lambda *keys, default=None: setting(config, *keys, default=default)
        made = cls()
        return cls(
            g("sources", "static", "seeds", default=[]), g("sources", "static", "domain", default=""), g("sources", "api", "endpoints", default={}), g("sources", "api", "token_env", default=made.api_token_name),
            int(g("sources", "api", "per_page", default=made.api_page)), float(g("sources", "api", "timeout", default=made.api_timeout)), g("sources", "api", "categories", default=[]),
            g("sources", "news", "host", default=""), g("output", "format", default=made.kind), g("output", "folder", default=made.folder),
        )


def capabilities() -> dict[str, dict]:
    """What each kind of content can be written as."""
    return {kind: {"json": True, "markdown": kind != "publications", "folders_by": by} for kind, by in (("pages", "category"), ("news", None), ("api", "endpoint"), ("publications", None))}


def converted(df: DataFrame, path: str, kind: str, text: str = "markdown") -> dict:
    """Writes in the format asked for: format, json_files, markdown_files (folders), success and errors. A format that isn't one is an error of its own."""
    if kind not in writers.FORMATS:
        raise ValueError(f"format {kind} isn't one of {', '.join(writers.FORMATS)}")
    done: dict = {"format": kind, "json_files": [], "markdown_files": [], "success": True, "errors": []}
    for one in ("json", "markdown") if kind == "both" else (kind,):
        try:
            done[f"{one}_files"] += writers.write(df, path, one, text).values()
        except Exception as e:  # noqa: BLE001
            done["errors"].append(f"{one}: {type(e).__name__}: {str(e).splitlines()[0]}")
    done["success"] = not done["errors"]
    return done


def convert_news(news: DataFrame, path: str, kind: str = "both", source: str = "news") -> dict:
    """News articles as JSON and as front-matter Markdown entries."""
    entry = render.news_entry(F.col("title"), F.col("date"), F.col("image_url"), F.col("content"), F.col("url"), F.lit(source))
    return converted(news.withColumn("markdown", entry), path, kind)


def convert_api(items: DataFrame, path: str, name: str, kind: str = "both") -> dict:
    """An endpoint's JSON items as they are and as Markdown documents."""
    return converted(items.withColumn("markdown", render.json_to_markdown(F.col("item"), F.lit(name))), f"{path}/{name}", kind)


def convert_publications(publications: DataFrame, path: str, kind: str = "json") -> dict:
    """Publications as JSON; asked for Markdown, it says that there is none."""
    done = converted(publications.withColumn("markdown", F.lit(None).cast("string")), path, "json") if kind != "markdown" else {"format": kind, "json_files": [], "markdown_files": [], "success": False, "errors": []}
    if kind != "json":
        done |= {"format": kind, "errors": [*done["errors"], "publications have no Markdown form"]}
    return done


def save_all(found: dict[str, DataFrame | None], path: str, kind: str = "json") -> dict[str, bool]:
    """Saves each endpoint's items; whether that went well, by name. What wasn't fetched isn't saved."""
    return {name: df is not None and convert_api(df, path, name, kind)["success"] for name, df in found.items()}


def static_source(spark: SparkSession, s: Settings, get: Callable[[str, float], str] = readers._get) -> DataFrame:
    """Page records from the seeds on, level by level: fetch, parse, queue the internal links that aren't known, until nothing is left."""
    fresh = spark.createDataFrame([(u,) for u in s.static_seeds if u.startswith("http")], "url string")
    known, fetched = fresh, []
    while not fresh.isEmpty():
        level = writers.cut(readers.fetch_pages(fresh, get=get))
        fetched.append(level)
        ok = level.filter("html is not null").select(F.xxhash64("url").alias("page_id"), "url", "html")
        found = crawl.links(html.parsed(ok), s.static_domain)
        fresh = writers.cut(crawl.site(ok, found).select(F.col("dst").alias("url")).distinct().join(known, "url", "left_anti"))
        known = known.union(fresh)
    if not fetched:
        raise ValueError("no seeds")
    pages = readers.union(fetched).filter("html is not null").select(F.xxhash64("url").alias("page_id"), "url", "html")
    return crawl.records(html.parsed(pages))


def api_source(spark: SparkSession, s: Settings) -> DataFrame:
    """All endpoints' items with their endpoint's name; an error if the token or every endpoint is missing."""
    token = os.environ.get(s.api_token_name)
    if not token:
        raise ValueError(f"{s.api_token_name} isn't set")
    found = readers.endpoints(spark, s.api_urls, token=token, per_page=s.api_page, timeout=s.api_timeout)
    frames = [df.withColumn("endpoint", F.lit(name)) for name, df in found.items() if df is not None]
    if not frames:
        raise ValueError("no endpoint could be fetched")
    return readers.union(frames)


def news_source(spark: SparkSession, listing: DataFrame, host: str, get: Callable[[str, float], str] = readers._get) -> tuple[DataFrame, DataFrame]:
    """The articles behind a listing's hrefs(href, pos), and a report; an error if there is no link. Articles that can't be fetched are counted."""
    links = crawl.scroll_links(listing, host)
    if links.isEmpty():
        raise ValueError("no news links")
    pages = writers.cut(readers.fetch_pages(links, get=get))
    report = pages.agg(F.count("*").alias("n_links"), F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
    return readers.news(pages.filter("html is not null")), report


def publication_source(spark: SparkSession, cards: DataFrame, get: Callable[[str, float], str] = readers._get) -> DataFrame:
    """url, kind, title, doi, abstract, keywords: cards(url, html) and, where one has a DOI, what its publisher's page tells."""
    first = writers.cut(readers.publication_cards(cards))
    behind = readers.fetch_pages(first.filter("doi is not null").select(F.col("doi").alias("url")).distinct(), get=get)
    details = readers.publication_details(behind.filter("html is not null")).withColumnRenamed("url", "doi")
    return first.join(details, "doi", "left").select("url", "kind", "title", "doi", "abstract", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def sources(spark: SparkSession, s: Settings) -> dict[str, Callable[[], DataFrame]]:
    """The sources a configuration can enable, by name."""
    listing = lambda: spark.createDataFrame([(h, i) for i, h in enumerate(s.static_seeds)], "href string, pos int")
    return {"static": lambda: static_source(spark, s), "api": lambda: api_source(spark, s), "news": lambda: news_source(spark, listing(), s.news_host)[0]}


def run(spark: SparkSession, config: dict, wanted: list[str] | None = None) -> tuple[bool, DataFrame]:
    """Runs the wanted or enabled sources and writes what they give; whether all went well, and a row for each source."""
    s = Settings.of(config)
    frames, failed = readers.Dispatcher(config, sources(spark, s)).run(wanted)
    rows = []
    for name, df in frames.items():
        try:
            writers.write_json(df, f"{s.folder}/{name}")
            rows.append((name, True, None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, False, str(e).splitlines()[0]))
    rows += [(name, False, why) for name, why in failed.items()]
    results = spark.createDataFrame(rows, "source string, success boolean, error string")
    return bool(observe.source_report(results).first().all_ok), results


def main(arguments: list[str] | None = None) -> int:
    """`python -m quernal.drivers --source static --source api --config file`: 0 if all went well, 1 if a source failed, 2 without a configuration."""
    parser = argparse.ArgumentParser(prog="quernal")
    parser.add_argument("--source", action="append", choices=["static", "api", "news"])
    parser.add_argument("--config", default="config.yaml")
    given = parser.parse_args(arguments)
    config = readers.load_config(given.config)
    if not config:
        print(f"no configuration in {Path(given.config).resolve()}")
        return 2
    from quernal.session import session

    ok, results = run(session(), config, given.source)
    results.show(truncate=False)
    return 0 if ok else 1


if __name__ == "__main__":
    raise SystemExit(main())
