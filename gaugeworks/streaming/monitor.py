"""What a running query says of itself: counts by batch, events a second, lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gaugeworks.operators import reconcile

PROGRESS = "run_id string, batch long, input_rows long, deliveries long, processed long, duplicates long, events_per_second double, lag long"
#: What sources say is still to come, in rows or files: fixed names.
OUTSTANDING = ("maxOffsetsBehindLatest", "numFilesOutstanding")


def observed(out: DataFrame) -> DataFrame:
    """A metering stream (`keyed_state.metering`) that reports the counts of each batch with its progress."""
    return out.observe("metering", F.coalesce(F.sum("deliveries"), F.lit(0)).alias("deliveries"), F.coalesce(F.sum("processed"), F.lit(0)).alias("processed"))


def as_row(progress) -> tuple:
    """A progress event as a row of PROGRESS: events a second are those of its batch, lag is what the sources hold back."""
    counts = progress.observedMetrics.get("metering")
    deliveries, processed = (counts["deliveries"], counts["processed"]) if counts else (0, 0)
    said = [int(float((s.metrics or {}).get(name, 0))) for s in progress.sources for name in OUTSTANDING]
    return (str(progress.runId), progress.batchId, progress.numInputRows, deliveries, processed, deliveries - processed, float(progress.processedRowsPerSecond or 0), sum(said))


class Progress(StreamingQueryListener):
    """Keeps the last `most` progress events of the queries of a session. Add it with spark.streams.addListener."""

    def __init__(self, most: int = 10_000):
        self.rows: list[tuple] = []
        self.most = most
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows.append(as_row(event.progress))
        del self.rows[: -self.most]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)] = event.exception


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PROGRESS)


def throughput(progress: DataFrame) -> DataFrame:
    """By run: rows, and rows a second over its batches with input."""
    busy = progress.where("input_rows > 0")
    return busy.groupBy("run_id").agg(F.sum("input_rows").alias("rows"), (F.sum("input_rows") / F.sum(F.col("input_rows") / F.col("events_per_second"))).alias("rows_per_second"))


def lag(spark: SparkSession, checkpoint: str, end_offsets: DataFrame) -> DataFrame:
    """Rows of the log behind, by partition, from the state of a metering stream as its last batch left it; the stream may be running."""
    marks = spark.read.format("statestore").option("stateVarName", "mark").load(checkpoint)
    return reconcile.consumer_lag(end_offsets, marks.select(F.col("key.partition").alias("partition"), F.col("value.offset").alias("offset")))
