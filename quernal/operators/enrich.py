"""Enrichment by a language model that is plugged in: retries, fallbacks, relations of people and groups, question records."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernal.functions import text
from quernal.session import ship

TRIES, FIRST_WAIT = 3, 1.0
FAILED = "Description could not be made."


class RateLimited(Exception):
    """What a client raises for a call that may succeed later."""


def attempt(call: Callable[[str], str], prompt: str, tries: int = TRIES, wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The call's answer; None after `tries` refusals, with doubled waits between, or at once after any other error."""
    for k in range(tries):
        try:
            return call(prompt)
        except RateLimited:
            if k + 1 < tries:
                sleep(wait * 2**k)
        except Exception:  # noqa: BLE001
            return None
    return None


def generated(df: DataFrame, prompt: Column, client: Callable[[], Callable[[str], str]], out: str, failed: str = FAILED, workers: int | None = None, wait: float = FIRST_WAIT) -> DataFrame:
    """df with `out`, a model's answer to the prompt; `failed` where none came, null where the prompt is null.

    client makes a callable from prompt to answer, once a task. `workers` is how many tasks, so how many calls, run at a time; by default as the rows lie.
    """
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def ask(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = client()
        for prompts in it:
            found = [None if p is None else attempt(call, p, wait=wait) or failed for p in prompts]
            yield pd.Series(found, dtype=object)

    return (df.repartition(workers) if workers else df).withColumn(out, ask(prompt))


def summaries(df: DataFrame, of: str, client: Callable[[], Callable[[str], str]] | None = None, out: str = "summary", least: int = 10, **options: object) -> DataFrame:
    """df with a short description of the column `of`: a model's, or without one the first sentences. Texts under `least` characters get a fixed line."""
    plain = text.summary(F.col(of))
    if client is None:
        return df.withColumn(out, plain)
    enough = F.length(text.strip(F.coalesce(F.col(of), F.lit("")))) >= least
    made = generated(df, F.when(enough, F.concat(F.lit("Describe in two sentences:\n"), F.col(of))), client, out, **options)
    return made.withColumn(out, F.coalesce(out, plain))


def joined(items: Column, none: str = "None", mark: str = ", ") -> Column:
    """The items in one line, a word of its own for an empty or null array."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, mark)).otherwise(F.lit(none))


def titles(items: Column, field: str = "title") -> Column:
    """The titles of an array of items, those that have one."""
    return F.filter(F.transform(items, lambda x: x[field]), lambda t: F.coalesce(t, F.lit("")) != "")


def focus(df: DataFrame, titles_: Column, client: Callable[[], Callable[[str], str]] | None = None, out: str = "focus", most: int = 20, **options: object) -> DataFrame:
    """df with what a person works on, from at most the first `most` titles."""
    plain = text.research_focus(titles_, most)
    if client is None:
        return df.withColumn(out, plain)
    given = F.when(F.coalesce(F.size(titles_), F.lit(0)) > 0, F.array_join(F.slice(titles_, 1, most), "\n"))
    return generated(df, given, client, out, **options).withColumn(out, F.coalesce(out, plain))


def dry_run(df: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """The first `limit` rows by `order`, for trial runs; all of them without a limit."""
    return df if limit is None else df.orderBy(order).limit(limit)


def with_question(metrics: DataFrame, questions: DataFrame, *columns: str, key: str = "query_id") -> DataFrame:
    """Metric rows with columns of their questions, such as topic and difficulty; each question once."""
    first = questions.groupBy(key).agg(*[F.min(c).alias(c) for c in columns])
    return metrics.join(first, key, "left")
