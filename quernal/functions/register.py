"""The library's functions under names that SQL texts can use."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernal.functions import html, render
from quernal.operators import chunking
from quernal.session import ship

#: Column expressions as SQL functions: (name, parameters, body).
EXPRESSIONS = (
    ("short_sha", "x STRING", "left(x, 7)"),
    ("plain_query", "x STRING", "trim(translate(x, '\\'\"', ''))"),
    ("file_stem", "x STRING", "regexp_replace(x, '[.][^.]*$', '')"),
    ("without_prefix", "x STRING, prefix STRING", "CASE WHEN startswith(x, prefix) THEN substr(x, length(prefix) + 1) ELSE x END"),
)


def _scalar(of, kind: T.DataType):  # noqa: ANN001, ANN202
    return F.pandas_udf(lambda s: pd.Series([of(x) for x in s], dtype=object), kind)


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for this session and gives their names: expressions that Spark inlines, and Arrow functions for HTML, JSON and chunks."""
    ship(spark)
    for name, parameters, body in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS STRING RETURN {body}")
    parts = T.ArrayType(T.StringType())
    made = {
        "html_title": _scalar(lambda x: html.extract(x)["title_tag"], T.StringType()),
        "html_paragraphs": _scalar(lambda x: [p["text"] for p in html.extract(x)["paragraphs"]], parts),
        "json_markdown": _scalar(render.document, T.StringType()),
        "text_chunks": _scalar(lambda x: chunking.split_recursive(x or ""), parts),
    }
    for name, f in made.items():
        spark.udf.register(name, f)

    class Sections:
        def eval(self, text: str):  # noqa: ANN202
            yield from chunking.split_sections(text or "")

    columns = ", ".join(["sid bigint", *[f"{h} string" for h in chunking.HEADERS], "text string"])
    spark.udtf.register("text_sections", F.udtf(Sections, returnType=columns))
    return [name for name, *_ in EXPRESSIONS] + [*made, "text_sections"]
