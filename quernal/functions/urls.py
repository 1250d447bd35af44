"""URL functions on columns."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernal.functions.text import slug
from quernal.session import ship

TRACKING = ("utm_", "PHPSESSID=")


def normalize(c: Column) -> Column:
    """Without fragment, tracking parameters (their names as given) and slashes at the end; in small letters. Null gives ''."""
    u = F.substring_index(F.coalesce(c, F.lit("")), "#", 1)
    at = F.locate("?", u)
    base = F.rtrim(F.when(at > 0, F.left(u, at - 1)).otherwise(u), F.lit("/"))
    given = F.split(F.substr(u, at + 1), "&", -1)
    kept = F.filter(given, lambda p: ~(F.startswith(p, F.lit(TRACKING[0])) | F.startswith(p, F.lit(TRACKING[1]))))
    query = F.when((at > 0) & (F.size(kept) > 0), F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.lower(F.concat(base, query))


_REASONS = (("download-file", "a download"), ("/login", "sign-in page /login"), ("/logout", "sign-in page /logout"), ("/register", "sign-in page /register"), ("/search", "a search page"), ("/people", "a people directory"))


def skip_reason(c: Column) -> Column:
    """Why a normalised URL isn't crawled, the first reason that holds; '' if it is."""
    out = F.when(F.coalesce(c, F.lit("")) == "", "no URL")
    for part, reason in _REASONS:
        out = out.when(F.contains(c, F.lit(part)), reason)
    return out.otherwise("")


def followed(text: Column, href: Column) -> Column:
    """Links with text and a target that is neither an anchor, nor script, nor a download."""
    return (F.coalesce(text, F.lit("")) != "") & (F.coalesce(href, F.lit("")) != "") & ~F.startswith(href, F.lit("#")) & ~F.startswith(href, F.lit("javascript:")) & ~F.contains(href, F.lit("download-file"))


def netloc(c: Column) -> Column:
    return F.regexp_extract(c, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(c: Column) -> Column:
    return F.regexp_extract(c, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_internal(c: Column, domain: str) -> Column:
    host = netloc(c)
    return F.contains(host, F.lit(domain)) | (host == "")


def is_seed(c: Column) -> Column:
    return F.coalesce(F.startswith(c, F.lit("http")), F.lit(False))


def page_name(c: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(path(c), "/", -1), -1), F.lit("")), F.lit("index"))


@F.pandas_udf(T.StringType())
def _join(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(base, href, strict=True)], dtype=object)


def resolve(base: Column, href: Column) -> Column:
    """RFC 3986 resolution in Python, for all cases."""
    ship(SparkSession.active())
    return _join(base, href)


def resolve_simple(base: Column, href: Column) -> Column:
    """Resolution in generated code of absolute, scheme-relative and host-relative targets without dot segments; others beside the base's last segment."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), netloc(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(F.rlike(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(root, folder, href))
    )


def absolutize(c: Column, host: str) -> Column:
    return F.when(F.startswith(c, F.lit("/")), F.concat(F.lit(host), c)).otherwise(c)


def external_name(c: Column, parent: Column) -> Column:
    return F.concat(F.lit("external-"), F.replace(F.replace(netloc(c), F.lit("."), F.lit("-")), F.lit("www-"), F.lit("")), F.lit("-"), parent)


def with_category(pages: DataFrame, menu: DataFrame, name: str = "page_name") -> DataFrame:
    """pages with `category`: category/submenu slugs from menu(category, submenu), or the page's own slug.

    A menu is a site's navigation, small by nature; Spark broadcasts it if it is.
    """
    first = menu.groupBy("submenu").agg(F.min_by("category", "category").alias("__category"))
    both = pages.join(first, pages[name] == first["submenu"], "left")
    return both.withColumn("category", F.when(F.col("__category").isNotNull(), F.concat_ws("/", slug(F.col("__category")), slug(F.col("submenu")))).otherwise(slug(F.col(name)))).drop("__category", "submenu")
