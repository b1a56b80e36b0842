"""Event-time windows: assignment, the watermark of each log partition, lateness.

The watermark is the running maximum of occurred_at over a partition's distinct
events in offset order, this event included, less the allowed lateness. It is a
function of the log alone, so a restart can't lose it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gaugeworks.functions.scalar import millis_between, seconds, window_start


def assigned(events: DataFrame, window_seconds: int) -> DataFrame:
    start = window_start(F.col("occurred_at"), window_seconds)
    return events.withColumn("window_start", start).withColumn("window_end", F.col("window_start") + seconds(window_seconds))


def progress(events: DataFrame, lateness_seconds: int, chunk: int = 100_000, carried: DataFrame | None = None) -> DataFrame:
    """Adds watermark. Chunks of offsets keep a large partition from being one task: a running maximum in each
    chunk, raised by the maximum of the chunks before it. carried: partition, max_occurred_at of earlier batches."""
    c = events.withColumn("__chunk", F.floor(F.col("offset") / chunk))
    tops = c.groupBy("partition", "__chunk").agg(F.max("occurred_at").alias("__top"))  # a row a chunk
    before = Window.partitionBy("partition").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("partition", "__chunk", F.max("__top").over(before).alias("__before"))
    inner = Window.partitionBy("partition", "__chunk").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = c.withColumn("__run", F.max("occurred_at").over(inner)).join(tops.hint("merge"), ["partition", "__chunk"])  # the rows lie so already; else those of a small batch may be what is broadcast
    known = ["__run", "__before"]
    if carried is not None:
        rows = rows.join(carried.select("partition", F.col("max_occurred_at").alias("__carried")), "partition", "left")
        known.append("__carried")
    return rows.withColumn("watermark", F.greatest(*known) - seconds(lateness_seconds)).drop("__chunk", *known)


def classified(events: DataFrame, window_seconds: int, lateness_seconds: int, **options) -> DataFrame:
    """Adds window_start, window_end, watermark and is_late."""
    return assigned(progress(events, lateness_seconds, **options), window_seconds).withColumn("is_late", F.col("watermark") >= F.col("window_end"))


def final_watermarks(events: DataFrame, lateness_seconds: int) -> DataFrame:
    return events.groupBy("partition").agg((F.max("occurred_at") - seconds(lateness_seconds)).alias("watermark"))


def late_arrivals(rows: DataFrame) -> DataFrame:
    """Audit rows. lateness_ms is the event's distance from its window's end, watermark_lateness_ms that of the watermark beyond it."""
    late = rows.where("is_late")
    return late.select("event_id", "tenant_id", "metric", "window_start", "quantity", millis_between(F.col("occurred_at"), F.col("window_end")).alias("lateness_ms"), millis_between(F.col("window_end"), F.col("watermark")).alias("watermark_lateness_ms"), "occurred_at", "received_at")


def watermark_lag(watermarks: DataFrame, reference) -> DataFrame:
    """Seconds that the watermark is behind `reference`, 0 at least and where there is none."""
    gap = F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", F.col("watermark"), reference) / 1e6)
    return watermarks.withColumn("lag_seconds", F.coalesce(gap, F.lit(0.0)))


def status(aggregates: DataFrame, now) -> DataFrame:
    code = F.when(F.col("revision") > 0, "CORRECTED").when(F.col("sealed_at").isNotNull(), "SEALED").when(F.col("window_end") <= now, "SEALING").otherwise("OPEN")
    return aggregates.withColumn("status", code)
