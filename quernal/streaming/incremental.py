"""Structured Streaming: incremental chunk upserts, and event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernal.operators import chunking, observe
from quernal.sources import writers


def chunks_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_no, text, chunk_id of useful fixed chunks; the same for tables and streams."""
    cut = chunking.fixed(docs.select(key, "text")).filter(chunking.useful(F.col("text")))
    return cut.withColumn("chunk_id", chunking.chunk_id(F.col("text")))


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Chunks of the Parquet files that arrive in source go to target, each id once; ends when all files are read.

    A batch that is run again after a failure adds nothing that is there, as ids are digests of the content.
    """
    arriving = spark.readStream.schema(schema).parquet(source)
    return chunks_of(arriving).writeStream.foreachBatch(lambda df, _: writers.upsert(df.sparkSession, df, target) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_stream(events: DataFrame, late: str = "1 hour", length: str = "1 hour") -> DataFrame:
    """observe.windows over a stream of events(event_id, ts, ..): repeats within the watermark count once, later rows are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return observe.windows(timed.dropDuplicatesWithinWatermark(["event_id"]), length)
