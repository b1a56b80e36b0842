"""Views on the pipeline: offsets, checkpoints, skew, lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def end_offsets(log: DataFrame) -> DataFrame:
    return log.groupBy("partition").agg((F.max("offset") + 1).alias("end_offset"), F.count("*").alias("event_count"))


def replayed_from(log: DataFrame, starts: dict[int, int]) -> DataFrame:
    """Rows at or after each partition's start offset (0 where none is given)."""
    start = F.lit(0)
    for p, o in sorted(starts.items()):
        if o < 0:
            raise ValueError("offsets are not negative")
        start = F.when(F.col("partition") == p, F.lit(o)).otherwise(start)
    return log.where(F.col("offset") >= start)


def checkpoints(consumed: DataFrame) -> DataFrame:
    """The last consumed offset of each partition."""
    return consumed.groupBy("partition").agg(F.max("offset").alias("offset"))


def skew(log: DataFrame) -> DataFrame:
    """Share of the log by partition, and how many tenants a partition shares with others (0: all are whole)."""
    spread = log.groupBy("tenant_id", "partition").agg(F.count("*").alias("n"))
    split = spread.groupBy("tenant_id").agg(F.count("*").alias("parts"))
    return spread.join(split, "tenant_id").groupBy("partition").agg(F.sum("n").alias("events"), F.count("*").alias("tenants"), F.count_if(F.col("parts") > 1).alias("split_tenants"))


def overview(lags: DataFrame, watermarks: DataFrame, now) -> DataFrame:
    rows = lags.join(watermarks, "partition", "left")
    gap = F.greatest(F.lit(0).cast("long"), F.floor(F.timestamp_diff("MICROSECOND", F.col("watermark"), now) / 1000).cast("long"))
    return rows.select("partition", "end_offset", "lag", F.coalesce(gap, F.lit(0).cast("long")).alias("watermark_lag_ms"))


def buffer_percent(depth: Column, shed_mark: int) -> Column:
    """Filling of the produce buffer, 100 at most, a half rounded up."""
    return F.least(F.lit(100), F.floor(depth / shed_mark * 100 + 0.5).cast("int"))


def pipeline_status(lags: DataFrame, outcome_rows: DataFrame, processed: DataFrame, outbox: DataFrame, now, high_mark: int = 10_000, shed_mark: int = 15_000) -> DataFrame:
    """One row: depth of the buffer (what is not consumed yet) and its marks, and the counts of shed events, known ids and messages to send."""
    one = lags.agg(F.coalesce(F.sum("lag"), F.lit(0)).cast("long").alias("buffer_depth"))
    for count in (outcome_rows.agg(F.count_if(F.col("outcome") == "LOW_PRIORITY_SHED").alias("shed_count")), processed.agg(F.count("*").alias("bloom_count")), outbox.agg(F.count_if(F.col("published_at").isNull()).alias("outbox_pending"))):
        one = one.join(F.broadcast(count), how="full_outer", on=F.lit(True))  # a row each
    marks = (F.lit(high_mark).alias("high_watermark"), F.lit(shed_mark).alias("shed_watermark"), buffer_percent(F.col("buffer_depth"), shed_mark).alias("buffer_percent"))
    return one.select(F.lit("healthy").alias("status"), now.alias("timestamp"), "buffer_depth", *marks, "shed_count", "bloom_count", "outbox_pending")


def health(status: DataFrame) -> DataFrame:
    return status.select("status", "buffer_depth", "timestamp")


def metrics(status: DataFrame) -> DataFrame:
    return status.select("buffer_depth", "shed_count", "bloom_count")


def tenant(tenants: DataFrame, tenant_id: str) -> DataFrame:
    return tenants.where(F.col("tenant_id") == tenant_id)


def tenant_list(tenants: DataFrame) -> DataFrame:
    return tenants.orderBy("tenant_id")


def tenant_upsert(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """The last change of each tenant wins; created_at is that of the first row. changes: with a sequence number `seq`."""
    rows = existing.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes)
    rest = [c for c in existing.columns if c not in ("tenant_id", "created_at")]
    out = rows.groupBy("tenant_id").agg(F.max_by(F.struct(*rest), "seq").alias("r"), F.min_by("created_at", "seq").alias("created_at"))
    return out.select("tenant_id", *(F.col(f"r.{c}").alias(c) for c in rest), "created_at")
