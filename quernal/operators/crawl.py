"""Crawl steps over parsed pages: links, images, records, and the frontier by anti joins."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernal.functions import html, urls
from quernal.functions.text import clean
from quernal.session import cut

EXTERNAL_LINKS = 5


def links(parsed: DataFrame, domain: str, key: str = "page_id", base: str = "url") -> DataFrame:
    """key, base, pos, text, href, target, internal: the links worth following, targets resolved."""
    each = parsed.select(key, base, F.posexplode("links").alias("pos", "l")).select(key, base, "pos", F.col("l.text").alias("text"), F.col("l.href").alias("href"))
    kept = each.filter(urls.followed(F.col("text"), F.col("href")))
    return kept.withColumn("target", resolved(F.col(base), F.col("href"))).withColumn("internal", urls.is_internal(F.col("target"), domain))


def resolved(base: Column, href: Column) -> Column:
    """The target of a link; in Python only where there are dot segments."""
    return F.when(F.contains(href, F.lit("./")), urls.resolve(base, href)).otherwise(urls.resolve_simple(base, href))


def site(pages: DataFrame, found: DataFrame, base: str = "url") -> DataFrame:
    """src, dst: the internal links worth following of a site's pages, between normalised addresses. found: `links` of the pages."""
    dst = urls.normalize(F.col("target"))
    inside = found.filter("internal").select(urls.normalize(F.col(base)).alias("src"), dst.alias("dst"))
    return inside.filter(urls.skip_reason(F.col("dst")) == "").distinct()


def walk(pages: DataFrame, found: DataFrame, seeds: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """url, depth, known: all addresses a crawl of pages(url) reaches from the seeds(url), by default all pages that may be one, and whether there is a page of it."""
    first = (pages if seeds is None else seeds).filter(urls.is_seed(F.col("url"))).select(urls.normalize(F.col("url")).alias("url"))
    edges = cut(site(pages, found))
    have = pages.select(urls.normalize(F.col("url")).alias("url")).distinct().withColumn("known", F.lit(True))
    return frontier(first.filter(urls.skip_reason(F.col("url")) == ""), edges, depth, "url").join(have, "url", "left").select("url", "depth", F.coalesce("known", F.lit(False)).alias("known"))


def crawl_report(reached: DataFrame, found: DataFrame) -> DataFrame:
    """n_urls, n_known, most_steps of a walk and n_links, n_external, n_repeats of its pages' links, in one row."""
    one = reached.agg(F.count("*").alias("n_urls"), F.count_if("known").alias("n_known"), F.coalesce(F.max("depth"), F.lit(0)).alias("most_steps"))
    links_ = found.groupBy(urls.normalize(F.col("target")).alias("target")).agg(F.count("*").alias("n"), F.count_if(~F.col("internal")).alias("out"))
    return one.join(links_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"), F.coalesce(F.sum("out"), F.lit(0)).alias("n_external"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeats")))


def scroll_links(found: DataFrame, host: str) -> DataFrame:
    """url, pos: the distinct targets of hrefs(href, pos) in order of first sight, those without a host below `host`."""
    return found.select(urls.absolutize(F.col("href"), host).alias("url"), "pos").filter("url is not null and url <> ''").groupBy("url").agg(F.min("pos").alias("pos"))


def first_links(found: DataFrame, n: int = EXTERNAL_LINKS, key: str = "page_id") -> DataFrame:
    """The first n links of each page with k, their number from 1."""
    w = Window.partitionBy(key).orderBy("pos")
    return found.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)


def external_records(found: DataFrame, visited: DataFrame, category: str = "category") -> DataFrame:
    """The first external link of each page that wasn't visited: its title mark and category; such pages aren't followed further."""
    first = first_links(found.filter(~F.col("internal")), 1)
    fresh = first.join(visited.select(F.col("url").alias("target")), "target", "left_anti")
    return fresh.withColumns({"title": F.concat(F.lit("[EXTERNAL] "), "text"), "category": F.concat(F.col(category), F.lit(" (External)"))})


def images(parsed: DataFrame, key: str = "page_id", base: str = "url") -> DataFrame:
    """key, pos, alt, src: images with a source, resolved."""
    each = parsed.select(key, base, F.posexplode("images").alias("pos", "i")).filter("i.src <> ''")
    return each.select(key, "pos", clean(F.col("i.alt")).alias("alt"), resolved(F.col(base), F.col("i.src")).alias("src"))


def records(parsed: DataFrame) -> DataFrame:
    """The parsed pages as records: url, title, page_name, category and content(paragraphs, titles)."""
    content = F.struct(html.paragraphs(parsed).alias("paragraphs"), html.headings(parsed).alias("titles")).alias("content")
    name = urls.page_name(F.col("url"))
    return parsed.select("page_id", "url", html.title(parsed).alias("title"), name.alias("page_name"), F.coalesce(F.nullif(F.regexp_extract(urls.path(F.col("url")), "^/([^/]+)/", 1), F.lit("")), F.lit("root")).alias("category"), content)


def frontier(seeds: DataFrame, edges: DataFrame, depth: int | None = None, node: str = "page_id") -> DataFrame:
    """node, depth: what is reached from the seeds along edges(src, dst), at its least depth; in any number of steps unless `depth` limits them.

    One level a round: the level's edges, less what was seen before. Every level is cut by a checkpoint, so a plan never grows with depth.
    """
    level = cut(seeds.select(node).distinct().withColumn("depth", F.lit(0)))
    seen = level
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        out = edges.join(level.select(F.col(node).alias("src")), "src", "left_semi").select(F.col("dst").alias(node)).distinct()
        level = cut(out.join(seen.select(node), node, "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def enqueue(found: DataFrame, seen: DataFrame) -> DataFrame:
    """url, pos, reason, duplicate: targets normalised, with the reason to skip them and whether they were seen or come again."""
    named = found.select(urls.normalize(F.col("target")).alias("url"), "pos")
    first = named.groupBy("url").agg(F.min("pos").alias("pos"), F.count("*").alias("times"))
    known = seen.select("url").distinct().withColumn("known", F.lit(True))
    return first.join(known, "url", "left").select("url", "pos", urls.skip_reason(F.col("url")).alias("reason"), F.coalesce("known", F.lit(False)).alias("known"), (F.col("times") - 1).alias("repeats"))
