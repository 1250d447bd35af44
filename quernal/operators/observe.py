"""Run reports and event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 10


def run_report(events: DataFrame, by: str, failed: Column, shown: int = SHOWN) -> DataFrame:
    """by, n_events, n_failed, total, duration_us, all_ok and the first failed ids, by map-side combined aggregates.

    The list of failed ids is sorted and cut after aggregation; its group holds only failures.
    """
    first = F.slice(F.array_sort(F.collect_list(F.when(failed, F.col("event_id")))), 1, shown)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    listed = F.nullif(F.array_join(first, ","), F.lit(""))
    return events.groupBy(by).agg(F.count("*").alias("n_events"), F.count_if(failed).alias("n_failed"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"), (F.max(micros("ts")) - F.min(micros("ts"))).alias("duration_us"), F.bool_and(F.col("value") >= 0).alias("all_ok"), listed.alias("first_failed"))


def windows(events: DataFrame, length: str = "1 hour", by: str = "event_type") -> DataFrame:
    """window_start, by, n, total over tumbling windows; works on a stream too, given a watermark."""
    grouped = events.groupBy(F.window("ts", length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), by, "n", "total")


def source_report(results: DataFrame) -> DataFrame:
    """results(source, success): n_sources, n_ok, all_ok in one row."""
    return results.agg(F.count("*").alias("n_sources"), F.count_if("success").alias("n_ok"), F.coalesce(F.bool_and("success"), F.lit(True)).alias("all_ok"))


def conversion_report(items: DataFrame, text: str = "content", image: str = "image_url") -> DataFrame:
    """found, processed, skipped, characters and images of a conversion in one row."""
    ok = F.length(F.trim(F.coalesce(text, F.lit("")))) > 0
    pictured = F.coalesce(F.col(image), F.lit("")).isin("", "No image found")
    return items.agg(F.count("*").alias("found"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("skipped"), F.coalesce(F.sum(F.when(ok, F.length(text))), F.lit(0)).alias("characters"), F.count_if(~pictured).alias("images"), F.count_if(pictured).alias("images_missing"))
