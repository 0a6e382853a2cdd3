"""Streaming ingest: new captures as they arrive, and rolling counts over events.

Additions to the batch operators: the same parse runs inside a stream, and the
counts use a watermark, so state is bounded by the lateness allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.pages import parse_pages
from weftline.rules import Site


def parse_stream(pages: DataFrame, out: str, checkpoint: str, site: Site | None = None) -> StreamingQuery:
    """Parse pages (url, html) of a stream into a Parquet table; exactly once by the checkpoint."""
    return parse_pages(pages, site).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; `events` (ts, event_type, value) may be a stream or a table."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")
