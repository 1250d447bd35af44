"""A register of queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Register:
    """Queries by name; `sql` of a query is DuckDB SQL over views of the same tables."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_clean(x: str) -> str:
    out = f"coalesce({x}, '')"
    for p in (r"\{\{[^}]*\}\}", r"\{%[^%]*%\}", r"\[\[[^\]]*\]\]", r"<!--[^-]*-->"):
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    return sql_strip(f"regexp_replace({out}, '{SPACE}+', ' ', 'g')")


def sql_title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '(\p{{L}}+|[^\p{{L}}]+)'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')"


def sql_slug(x: str) -> str:
    kept = rf"regexp_replace(lower({x}), '[^a-z0-9\x{{9}}-\x{{d}}\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}-]', '', 'g')"
    return f"regexp_replace(regexp_replace({kept}, '{SPACE}+', '-', 'g'), '^-+|-+$', '', 'g')"


def sql_tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
