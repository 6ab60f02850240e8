"""Streaming forms of the activity window and of the memory of failed addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instant(name: str) -> Column:
    """A stored time without zone, read as UTC."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(name)).cast("timestamp")


def sliding_counts(events: DataFrame, length: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events of each type in sliding windows; ``events`` has ts and event_type and may be a stream."""
    marked = events.select(instant("ts").alias("ts"), "event_type").withWatermark("ts", late)
    return marked.groupBy(F.window("ts", length, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "event_type", "n")


def first_failures(failures: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each failed key once within the watermark: the negative cache of a crawl."""
    return failures.withColumn("ts", instant("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rates(events: DataFrame, now_ms: int, remaining: int | None = None, period_ms: int = 300_000) -> DataFrame:
    """One row: requests, page requests and loaded pages a minute since the first event of the last period, and ``eta_min``.

    ``events`` has ms and kind.  An estimate is given from five loaded pages a minute on.  Without time since
    that event, requests and loaded pages count as none and a millisecond is taken as the time.
    """
    recent = events.where(F.col("ms") >= now_ms - period_ms)
    count = lambda kind: F.count_if(F.col("kind") == kind)
    sums = recent.agg(count("web-request").alias("a"), count("lj-page-request").alias("p"), count("loaded-page").alias("l"), (F.lit(now_ms) - F.coalesce(F.min("ms"), F.lit(0))).alias("t"))
    none = F.col("t") == 0
    each = lambda n: 60000.0 * n / F.greatest("t", F.lit(1))
    loaded = each(F.when(none, 0).otherwise(F.col("l")))
    eta = F.when((loaded >= 5) & (F.lit(remaining) > 0), F.floor(F.lit(remaining) / loaded))
    return sums.select(each(F.when(none, 0).otherwise(F.col("a"))).alias("requests"), each(F.col("p")).alias("page_requests"), loaded.alias("loaded_pages"), eta.cast("int").alias("eta_min"))
