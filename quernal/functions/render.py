"""Markdown rendering. Fixed schemas in generated code; JSON of unknown depth in Python, by Arrow batches."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernal.functions.text import clean, default, label, plain_description, strip
from quernal.session import ship

RULE = "-" * 80
NO_IMAGE = "![Image not found](No image)"


def _key(k: str) -> str:
    return k.replace("_", " ").title()


def _bare(text: str) -> str:
    import re

    if not text.startswith("<"):
        return text
    out = re.sub("<[^>]+>", "", text)
    for a, b in {"&nbsp;": " ", "&quot;": '"', "&amp;": "&"}.items():
        out = out.replace(a, b)
    return out.strip()


def scalar(value: object) -> str:
    if value is None:
        return "*None*"
    if value is True or value is False:
        return "✓ Yes" if value else "✗ No"
    return _bare(value) if isinstance(value, str) else str(value)


def render(value: object, depth: int = 0) -> str:
    """A JSON value as Markdown: objects as bold keys, lists as bullets or numbered items, two spaces a level."""
    pad = "\n" + "  " * depth
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            head = f"{pad}**{_key(k)}:**"
            out.append(head + (render(v, depth + 1) if isinstance(v, (dict, list)) and v else f" {render(v, depth)}"))
        return "".join(out)
    if isinstance(value, list):
        if not value:
            return "Empty"
        if isinstance(value[0], dict):
            return "".join(f"{pad}**Item {n}:**{render(v, depth + 1) if isinstance(v, dict) else ' ' + scalar(v)}" for n, v in enumerate(value, 1))
        return "".join(f"{pad}- {v if isinstance(v, str) else render(v, depth + 1)}" for v in value)
    return scalar(value)


def document(text: str | None, title: str = "") -> str | None:
    """A JSON text as a Markdown document; None if it can't be read. A `data` list is unwrapped."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return None
    if isinstance(value, dict) and isinstance(value.get("data"), list):
        value = value["data"]
    parts = [f"# {title}\n"] if title else []
    for item in value if isinstance(value, list) else [value]:
        if isinstance(value, list) and isinstance(item, dict) and ("name" in item or "title" in item):
            parts.append(f"### {item['name'] if 'name' in item else item['title']}\n")
        parts.append(render(item))
        if isinstance(value, list):
            parts.append(f"\n{RULE}\n")
    return "\n".join(parts)


@F.pandas_udf(T.StringType())
def _documents(text: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([document(x, t or "") for x, t in zip(text, title, strict=True)], dtype=object)


def json_to_markdown(text: Column, title: Column) -> Column:
    """`document` of each JSON text."""
    ship(SparkSession.active())
    return _documents(text, title)


def flag(c: Column) -> Column:
    return F.when(c.isNull(), "*None*").when(c, "✓ Yes").otherwise("✗ No")


def image_link(url: Column, title: Column) -> Column:
    bare = strip(F.coalesce(url, F.lit("")))
    shown = F.concat(F.lit("!["), title, F.lit("]("), url, F.lit(' "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('")'))
    return F.when((bare == "") | (bare == "No image found"), NO_IMAGE).otherwise(shown)


def news_entry(title: Column, date: Column, image: Column, content: Column, url: Column, source: Column) -> Column:
    t, d = default(title, "Untitled News"), default(date, "Unknown Date")
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), t), F.concat(F.lit("date: "), d), F.concat(F.lit("source: "), source), F.concat(F.lit("url: "), default(url, "")), F.lit("---"))
    return F.concat_ws("\n\n", head, image_link(default(image, "No image found"), t), F.concat(F.lit("*Published: "), d, F.lit("*")), default(content, ""), F.lit("---\n\n"))


def _bold(name: str, v: Column, missing: str = "N/A") -> Column:
    return F.concat(F.lit(f"**{name}:** "), F.coalesce(v.cast("string"), F.lit(missing)))


def profile(name: Column, aliases: Column, fields: dict[str, Column], groups: Column, publications: Column, projects: Column) -> Column:
    """A person's page. groups, publications and projects are arrays of ready lines."""
    known = F.when(F.size(aliases) > 0, F.concat(F.lit("**Aliases / Known As:** "), F.array_join(aliases, ", ")))
    listed = F.when(F.size(groups) > 0, F.concat(F.lit("**Research Groups:**\n"), F.array_join(groups, "\n")))
    section = lambda title, lines, none: F.concat(F.lit(f"\n### {title}\n"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(f"- {none}")))
    return F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce(name, F.lit("Unknown"))), known, *[_bold(k, v) for k, v in fields.items()], listed, section("Publications", publications, "No public records found."), section("Projects", projects, "No projects found."), F.lit(f"\n{RULE}\n"))


def group_page(slug: Column, description: Column, members: Column, content: Column) -> Column:
    """A group's page; members is an array of ready lines."""
    return F.concat(F.lit("# Group: "), F.upper(slug), F.lit("\n\n**AI Short Description:** "), description, F.lit("\n\n## Associated Researchers\n"), F.array_join(members, "\n"), F.lit("\n\n## Original Content\n"), content)


def project_page(title: Column, fields: dict[str, Column], description: Column, members: Column) -> Column:
    """A project's page; members is an array of ready lines."""
    about = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("**Description:** "), plain_description(description), F.lit("\n")))
    people = F.when(F.size(members) > 0, F.concat(F.lit("### Associated Members\n"), F.array_join(members, "\n")))
    return F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce(title, F.lit("Unknown Title"))), *[_bold(k, v) for k, v in fields.items()], about, people, F.lit(f"\n{RULE}\n"))


def page_markdown(title: Column, url: Column, category: Column, paragraphs: Column, noise: tuple[str, ...] = ()) -> Column:
    """A page as Markdown: head, then its paragraphs' lines without blank ones and those that hold a `noise` text, such as a site's navigation run together."""
    lines = F.flatten(F.transform(paragraphs, lambda p: F.split(p, "\n", -1)))
    kept = F.filter(F.transform(lines, strip), lambda x: reduce(lambda a, n: a & ~F.contains(x, F.lit(n)), noise, x != ""))
    head = F.concat(F.lit("# "), title, F.lit("\n\n**Source:** ["), url, F.lit("]("), url, F.lit(")\n**Category:** "), F.coalesce(category, F.lit("")), F.lit("\n\n---\n\n"))
    return F.concat(head, F.when(F.size(kept) > 0, F.concat(F.lit("## Content\n\n"), F.array_join(kept, "\n\n"), F.lit("\n"))).otherwise(F.lit("")))


__all__ = ["clean", "document", "flag", "group_page", "image_link", "json_to_markdown", "label", "news_entry", "page_markdown", "profile", "project_page", "render", "scalar"]
