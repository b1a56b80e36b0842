"""Sliding counters fed batch by batch: a batch adds its sums by pane, readers add the panes of the batches up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.operators import quota

DAY = 86_400


class SlidingCounters:
    """Usage over the last `length` panes of `pane_seconds`, by tenant and metric. Batches are idempotent by number; sums lie in folders by day, of which a check reads those in reach."""

    KEY = ["tenant_id", "metric"]

    def __init__(self, spark: SparkSession, path: str, pane_seconds: int, length: int):
        self.spark, self.path, self.pane, self.length = spark, path.rstrip("/"), pane_seconds, length

    def process(self, events: DataFrame, batch: int) -> None:
        sums = quota.panes(events, self.pane, self.KEY)
        day = F.floor(F.col("pane") * self.pane / DAY).cast("int")
        sums.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/panes/batch={batch}")

    def sums(self, last: int | None = None) -> DataFrame:
        """Panes of all batches; with `last`, only those that a check at that pane needs."""
        rows = self.spark.read.schema("tenant_id string, metric string, pane long, quantity decimal(38,9), event_count long, batch int, day int").parquet(f"{self.path}/panes")
        if last is not None:
            rows = rows.where(F.col("day").between((last - self.length + 1) * self.pane // DAY, last * self.pane // DAY))
        return quota.merged_panes(rows, self.KEY)

    def windows(self) -> DataFrame:
        """Totals of every window that holds an event."""
        return quota.sliding_totals(self.sums(), self.KEY, self.pane, self.length)

    def usage(self, at: int) -> DataFrame:
        """Usage of the window that ends with the pane of a time (seconds since 1970)."""
        last = at // self.pane
        return quota.sliding_usage_at(self.sums(last), self.KEY, self.pane, self.length, F.lit(last))

    def checked(self, tenants: DataFrame, at: int, proposed: int = 0, as_of: Column | None = None) -> DataFrame:
        """The quota check on the sliding usage."""
        return quota.checked(self.usage(at), tenants, proposed, as_of)

    def start(self, stream: DataFrame, **trigger):
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
