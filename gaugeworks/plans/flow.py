"""The metering flow over a data set, built up lazily from the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugeworks.operators import aggregates, dedup, observe, outbox, quota, windows
from gaugeworks.sources import usage

WINDOW, LATENESS = 86_400, 3_600
NOW, CUT, RANGE = "2024-02-10 00:00:00", "2024-01-20 00:00:00", ("2024-01-05 00:00:00", "2024-01-25 00:00:00")


#: Tables that several queries of a session read, by application, data set and name.
TABLES: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


def at(text: str):
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


class Flow:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is written by the first query of the session that needs it: a long session so keeps one of each data set, not one a query."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in TABLES or not usage.exists(self.spark, TABLES[key][0]):
            df = make()
            TABLES[key] = usage.write_table(df), df.schema
        path, schema = TABLES[key]
        return self.spark.read.schema(schema).parquet(path)

    def stored(self) -> Flow:
        """The same flow with its revisions written too, for queries that read them several times."""
        x = Flow(self.spark, self.sf_dir)
        x.rows = x.unique = x.kept = self.kept
        x.revisions = self.once("revisions", lambda: self.revisions)
        return x

    @cached_property
    def log(self) -> DataFrame:
        return usage.usage_log(self.spark, self.sf_dir)

    @cached_property
    def unique(self) -> DataFrame:
        return dedup.first_occurrences(self.log)

    @cached_property
    def rows(self) -> DataFrame:
        return windows.classified(self.unique, WINDOW, LATENESS)

    @cached_property
    def kept(self) -> DataFrame:
        """The classified rows, written once: what seals, corrects and audits reads them several times, and each time would make the log anew."""
        return self.once("kept", lambda: self.rows)

    @cached_property
    def watermarks(self) -> DataFrame:
        return windows.final_watermarks(self.unique, LATENESS)

    @cached_property
    def sealed(self) -> DataFrame:
        return aggregates.sealed(self.kept)

    @cached_property
    def corrections(self) -> DataFrame:
        return aggregates.corrections(self.kept, self.sealed)

    @cached_property
    def revisions(self) -> DataFrame:
        return self.sealed.unionByName(self.corrections)

    @cached_property
    def latest(self) -> DataFrame:
        return aggregates.latest(self.revisions)

    @cached_property
    def tenants(self) -> DataFrame:
        return usage.tenants(self.spark)

    @cached_property
    def usage(self) -> DataFrame:
        return quota.counters(self.unique)

    @cached_property
    def consumed(self) -> DataFrame:
        return self.log.where((F.col("received_at") < at(CUT)) & (F.col("partition") < 3))

    @cached_property
    def lags(self) -> DataFrame:
        from gaugeworks.operators import reconcile

        return reconcile.consumer_lag(observe.end_offsets(self.log).select("partition", "end_offset"), observe.checkpoints(self.consumed))

    @cached_property
    def messages(self) -> DataFrame:
        return self.once("messages", lambda: outbox.messages(self.revisions))

    @cached_property
    def outbox(self) -> DataFrame:
        """Messages in a state to relay from: a third published, some with failed attempts."""
        rows = self.messages.drop("payload")
        published = F.when(F.col("id") % 3 == 0, F.col("created_at") + F.expr("INTERVAL '1' MINUTE"))
        return rows.withColumn("published_at", published).withColumn("attempts", F.when(F.col("id") % 7 == 0, F.floor(F.col("id") / 7) % 7).otherwise(0).cast("int"))

    @cached_property
    def served(self) -> DataFrame:
        """Served totals with faults: every third day still at revision 0, one tenant's errors at half."""
        old = aggregates.latest(self.revisions.where("revision = 0")).where("day(window_start) % 3 = 0")
        new = self.latest.where("day(window_start) % 3 <> 0")
        half = (F.col("tenant_id") == "tenant_3") & (F.col("metric") == "error")
        return old.unionByName(new).withColumn("quantity", F.when(half, (F.col("quantity") / 2).cast(usage.MONEY)).otherwise(F.col("quantity")))
