"""Reconciliation of served totals against the log, behind a completion gate."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.operators.aggregates import KEY, totals
from gaugeworks.sources.usage import MONEY, numbered_globally, written


def consumer_lag(end_offsets: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Rows behind: end - (checkpoint + 1), 0 at least; all of them without a checkpoint."""
    bad = F.raise_error(F.lit("offsets are not negative"))
    rows = end_offsets.join(checkpoints.select("partition", F.col("offset").alias("checkpoint")), "partition", "left")
    lag = F.when((F.col("end_offset") < 0) | (F.col("checkpoint") < 0), bad.cast("long")).when(F.col("checkpoint").isNull(), F.col("end_offset")).otherwise(F.greatest(F.lit(0).cast("long"), F.col("end_offset") - F.col("checkpoint") - 1))
    return rows.withColumn("lag", lag)


def gate(watermark: Column, window_end: Column, lag: Column, pending: Column) -> Column:
    """The first condition that isn't met yet; null if the window is settled. A lag that isn't known is none that is met."""
    return F.when(watermark.isNull() | (watermark < window_end), "WATERMARK_BEFORE_WINDOW_END").when(lag.isNull() | (lag > 0), "CONSUMER_LAG").when(pending > 0, "OUTBOX_PENDING")


def iso(at: Column) -> Column:
    """ISO 8601 in UTC, microseconds only if there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.date_format(at, "SSSSSS") == "000000", "").otherwise(F.date_format(at, ".SSSSSS")), F.lit("+00:00"))


def evidence(kind: Column, reason: Column, watermark: Column, window_end: Column, lag: Column, pending: Column, recomputed: Column, served: Column, late: Column, difference: Column) -> Column:
    """What the class rests on, in words. The wordings are fixed values."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    why = (
        F.when(reason == "WATERMARK_BEFORE_WINDOW_END", F.concat(F.lit("Watermark ("), F.coalesce(iso(watermark), F.lit("unknown")), F.lit(") has not yet passed window_end ("), iso(window_end), F.lit(")")))
        .when(reason == "CONSUMER_LAG", F.concat(F.lit("Consumer partition lag is "), text(lag), F.lit(" (pipeline still actively processing events)")))
        .otherwise(F.concat(F.lit("Outbox has "), text(pending), F.lit(" pending messages for this window")))
    )
    return (
        F.when(kind == "UNSETTLED", F.concat(F.lit("Gated out: "), why))
        .when(kind == "MATCH", "Exact match: recomputed and served quantities agree perfectly.")
        .when(kind == "LATE_ARRIVAL", F.concat(F.lit("Difference of "), text(difference), F.lit(" matches known audited late arrivals ("), text(late), F.lit(").")))
        .otherwise(F.concat(F.lit("Genuine unexplained discrepancy: recomputed="), text(recomputed), F.lit(", served="), text(served), F.lit(", diff="), text(difference), F.lit(".")))
    )


def recomputed(events: DataFrame) -> DataFrame:
    """Replay: totals of the deduplicated log."""
    return totals(events, [*KEY, "window_end", "partition"])


def reconciled(replay: DataFrame, served: DataFrame, late: DataFrame, watermarks: DataFrame, lags: DataFrame, pending: DataFrame, gated: bool = True) -> DataFrame:
    """All windows at once. difference = recomputed - served.

    UNSETTLED behind the gate; then MATCH for no difference, LATE_ARRIVAL if the late events make up the difference, else REAL.
    """
    zero = F.lit(0).cast(MONEY)
    left = replay.select(*KEY, F.col("window_end").alias("e1"), F.col("partition").alias("p1"), F.col("quantity").alias("replayed"))
    right = served.select(*KEY, F.col("window_end").alias("e2"), F.col("partition").alias("p2"), F.col("quantity").alias("served"))
    rows = left.join(right, KEY, "full_outer").select(*KEY, F.coalesce("e1", "e2").alias("window_end"), F.coalesce("p1", "p2").alias("partition"), F.coalesce("replayed", zero).alias("recomputed_quantity"), F.coalesce("served", zero).alias("served_quantity"))
    sums = late.groupBy(*KEY).agg(F.sum("quantity").cast(MONEY).alias("late_quantity"))
    rows = rows.join(sums, KEY, "left").join(watermarks.select("partition", "watermark"), "partition", "left").join(lags.select("partition", "lag"), "partition", "left").join(pending, KEY, "left")
    rows = rows.withColumn("late_quantity", F.coalesce("late_quantity", zero)).withColumn("difference", (F.col("recomputed_quantity") - F.col("served_quantity")).cast(MONEY))
    reason = gate(F.col("watermark"), F.col("window_end"), F.col("lag"), F.coalesce("pending", F.lit(0))) if gated else F.lit(None).cast("string")
    rows = rows.withColumn("gate_reason", reason)
    kind = F.when(F.col("gate_reason").isNotNull(), "UNSETTLED").when(F.col("difference") == 0, "MATCH").when(F.abs("difference") == F.col("late_quantity"), "LATE_ARRIVAL").otherwise("REAL")
    said = evidence(F.col("divergence_class"), *map(F.col, ("gate_reason", "watermark", "window_end", "lag", "pending", "recomputed_quantity", "served_quantity", "late_quantity", "difference")))
    return rows.withColumn("divergence_class", kind).withColumn("evidence", said)


HISTORY = "sequence long, tenant_id string, metric string, window_start timestamp_ntz, window_end timestamp_ntz, recomputed_quantity decimal(38,9), served_quantity decimal(38,9), late_quantity decimal(38,9), difference decimal(38,9), divergence_class string, gate_reason string, evidence string"


class History:
    """An append-only record of reconciliation runs under `path`, numbered on from run to run.

    A run lies in a folder of its own, named by its id; its last number is written when its rows are. A run that is recorded
    again keeps its first number and overwrites its rows, so recording is idempotent by run id. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self) -> list:
        """run_id, first, last of the runs recorded as a whole, in order."""
        try:
            return sorted(self.spark.read.schema("first long, last long, run_id string").parquet(f"{self.path}/runs").collect(), key=lambda r: r.first)  # a row a run
        except AnalysisException as none:
            if none.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def record(self, run_id: str, judged: DataFrame) -> None:
        """Append what `reconciled` found, in the order of window, tenant and metric."""
        known = self.runs()
        first = next((r.first for r in known if r.run_id == run_id), max((r.last for r in known), default=0) + 1)
        later = [r for r in known if r.first > first]
        columns = [c.split()[0] for c in HISTORY.split(", ")[1:]]
        rows = numbered_globally(judged.select(*columns), ["window_start", "tenant_id", "metric"], "sequence", first)
        rows = written(rows)
        last = first - 1 + rows.count()
        if later and last != next(r.last for r in known if r.run_id == run_id):
            raise ValueError("a run that others follow can't change its length")
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/run_id={run_id}")
        self.spark.createDataFrame([(first, last)], "first long, last long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/runs/run_id={run_id}")

    def rows(self) -> DataFrame:
        """All rows of the runs recorded as a whole, with their run_id."""
        runs = [r.run_id for r in self.runs()]
        if not runs:
            return self.spark.createDataFrame([], f"{HISTORY}, run_id string")
        return self.spark.read.schema(f"{HISTORY}, run_id string").parquet(f"{self.path}/rows").where(F.col("run_id").isin(*runs))

    def newest(self, n: int = 50) -> DataFrame:
        return self.rows().orderBy(F.desc("sequence")).limit(n)
