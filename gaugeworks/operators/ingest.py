"""Admission of events: validation, shedding, outcomes, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

REQUIRED = ("event_id", "tenant_id", "metric", "quantity", "occurred_at", "received_at")
MAX_BATCH = 1000
#: Fixed texts of the outcomes.
MESSAGES = {
    "OK": "Accepted for ingestion",
    "DUPLICATE_EVENT": "Event already acknowledged (idempotent)",
    "LOW_PRIORITY_SHED": "Event shed due to critical produce buffer saturation",
    "INVALID_SCHEMA": "Event does not fit the schema",
}


def invalid(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | c(name).isNull()
    return missing | (F.length(F.trim(c("event_id"))) == 0) | (c("quantity") < 0)


def validated(events: DataFrame) -> DataFrame:
    """Adds reason_code: INVALID_SCHEMA or OK."""
    return events.withColumn("reason_code", F.when(F.coalesce(invalid(), F.lit(True)), "INVALID_SCHEMA").otherwise("OK"))


def check_batch(n: int) -> None:
    if not 1 <= n <= MAX_BATCH:
        raise ValueError(f"a batch has 1 to {MAX_BATCH} events, not {n}")


def stamped(events: DataFrame, now: Column) -> DataFrame:
    """The arrival time replaces what the sender said."""
    return events.withColumn("received_at", now)


def shed(events: DataFrame, depth: Column, shed_mark: int = 15_000, high_mark: int = 10_000) -> DataFrame:
    """Adds over_high_mark (a warning only) and is_shed: low priority at or beyond the shed mark."""
    return events.withColumn("over_high_mark", depth >= high_mark).withColumn("is_shed", (depth >= shed_mark) & (F.col("priority") == "low"))


def outcomes(deliveries: DataFrame, order: list[str]) -> DataFrame:
    """One row for each delivery: outcome, accepted and message. deliveries: with reason_code (validation) and is_shed.

    A repeated id is accepted, as a duplicate; the first admitted delivery is the one that counts. The others need no place in
    the order: they are spread, so that the deliveries without an id don't meet in one task.
    """
    admitted = (F.col("reason_code") == "OK") & ~F.col("is_shed")
    apart = F.when(~F.coalesce(admitted, F.lit(False)), F.xxhash64(*order))
    earlier = F.row_number().over(Window.partitionBy("event_id", apart).orderBy(*order)) - 1
    code = F.when(F.col("reason_code") != "OK", F.col("reason_code")).when(F.col("is_shed"), "LOW_PRIORITY_SHED").when(earlier > 0, "DUPLICATE_EVENT").otherwise("OK")
    said = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    return deliveries.withColumn("outcome", code).withColumn("accepted", F.col("outcome").isin("OK", "DUPLICATE_EVENT")).withColumn("message", F.element_at(said, F.col("outcome")))


def results(outcome_rows: DataFrame, batch: list[str], order: list[str]) -> DataFrame:
    """The result of each id in each batch: that of its last delivery, since later ones overwrite."""
    last = F.max_by(F.struct("accepted", F.col("outcome").alias("reason_code"), "message"), F.struct(*order))
    return outcome_rows.groupBy(*batch, "event_id").agg(last.alias("r")).select(*batch, "event_id", "r.*")


def result_maps(outcome_rows: DataFrame, batch: list[str], order: list[str]) -> DataFrame:
    """One row a batch: its results by event id. A batch has MAX_BATCH events at most (`check_batch`)."""
    entry = F.struct("event_id", F.struct("event_id", "accepted", "reason_code", "message"))
    return results(outcome_rows, batch, order).where("event_id IS NOT NULL").groupBy(*batch).agg(F.map_from_entries(F.collect_list(entry)).alias("results"))


def response(outcome_rows: DataFrame, batch: list[str], order: list[str]) -> DataFrame:
    """Counts by batch over deliveries, and the last outcome of each id (later deliveries overwrite)."""
    last = outcome_rows.groupBy(*batch, "event_id").agg(F.max_by("outcome", F.struct(*order)).alias("outcome"), F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    return last.groupBy(*batch).agg(F.sum("a").alias("accepted_count"), F.sum("r").alias("rejected_count"), F.count("*").alias("result_count"), F.count_if(F.col("outcome") == "DUPLICATE_EVENT").alias("duplicate_results"))


def routed(events: DataFrame, hot: list[str], main_topic: str = "usage-events", hot_topic: str = "usage-events-hot") -> DataFrame:
    return events.withColumn("topic", F.when(F.col("tenant_id").isin(*hot), hot_topic).otherwise(main_topic) if hot else F.lit(main_topic))
