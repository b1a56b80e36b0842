"""Metering as a stream: the batch operators on one micro-batch at a time, with state between them.

Every batch writes its revisions, its newly processed ids and a snapshot of the
small state (watermarks, open windows) under its batch number, overwriting what
an earlier try of the same batch left, and reads the state of the batch before.
Results so don't depend on where batches are cut, nor on restarts. What grows
with history is read in part: revisions lie in folders by the day of their
window, of which a batch reads those that its late events fall in; processed ids
lie in folders by the day they came, of which a batch reads those that
`keep_seconds` reaches back to (all of them, unless it is given: then an id that
comes again later than that counts as new; `keyed_state` looks ids up instead).
Each batch also appends its late arrivals to the audit and a message for each
revision to the outbox; numbers are handed out to batches in ranges, the last of
a batch being part of its state, which is written when all else is: what readers
see ends with the last batch that is whole. Spark's own watermark isn't used: it
would drop late rows, and is one for the whole query instead of one a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.operators import aggregates, dedup, outbox, windows
from gaugeworks.operators.aggregates import KEY
from gaugeworks.sources.usage import MONEY

OPEN = "tenant_id string, metric string, partition int, window_start timestamp_ntz, window_end timestamp_ntz, quantity decimal(38,9), event_count long"
MARKS = "partition int, max_occurred_at timestamp_ntz"
REVISION = "tenant_id string, metric string, partition int, window_start timestamp_ntz, window_end timestamp_ntz, quantity decimal(38,9), event_count long, revision int, sealed_at timestamp_ntz"
LATE = "event_id string, tenant_id string, metric string, window_start timestamp_ntz, quantity decimal(38,9), lateness_ms long, watermark_lateness_ms long, occurred_at timestamp_ntz, received_at timestamp_ntz"
MESSAGE = "id long, aggregate_key string, payload string, tenant_id string, metric string, window_start timestamp_ntz, revision int, quantity decimal(38,9), event_count long, created_at timestamp_ntz"
#: What metering reads of a log record.
EVENT = ["partition", "offset", "event_id", "tenant_id", "metric", "quantity", "occurred_at", "received_at"]
LATEST = ["tenant_id", "metric", "window_start", "quantity", "event_count", "revision"]


def filesystem(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def child(spark: SparkSession, path, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name)


class MeteringStream:
    def __init__(self, spark: SparkSession, path: str, window_seconds: int = 60, lateness_seconds: int = 30, keep_seconds: int | None = None):
        self.spark, self.path, self.window, self.lateness, self.keep = spark, path.rstrip("/"), window_seconds, lateness_seconds, keep_seconds

    def read(self, name: str, schema: str, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/state/batch={batch}/{name}")

    def write(self, df: DataFrame, place: str, day: str | None = None) -> None:
        """day: the time column whose days are folders."""
        out = df if day is None else df.withColumn("day", F.to_date(day))
        writer = out.write.mode("overwrite")
        (writer if day is None else writer.partitionBy("day")).parquet(f"{self.path}/{place}")

    def history(self, name: str, schema: str, batch: int) -> DataFrame:
        """What all batches before this one wrote, with its day."""
        if batch <= 0:
            return self.spark.createDataFrame([], f"{schema}, batch int, day date")
        return self.spark.read.schema(f"{schema}, batch int, day date").parquet(f"{self.path}/{name}").where(F.col("batch") < batch)

    def processed(self, batch: int, events: DataFrame) -> DataFrame:
        """Ids of the batches before this one, as far back as they are kept."""
        known = self.history("processed", "event_id string", batch)
        if self.keep is not None and batch:
            since = events.agg(F.to_date(F.min("received_at") - F.expr(f"INTERVAL '{self.keep}' SECOND"))).first()[0]
            known = known.where(F.col("day") >= F.lit(since)) if since else known
        return known.select("event_id")

    def known(self, rows: DataFrame, batch: int) -> DataFrame:
        """The latest revisions of the days that late events of this batch fall in."""
        days = [r.day for r in rows.where("is_late").select(F.to_date("window_start").alias("day")).distinct().collect()]  # a value a day
        return aggregates.latest(self.history("revisions", REVISION, batch).where(F.col("day").isin(*days)) if days else self.spark.createDataFrame([], REVISION)).select(*LATEST)

    def revisions(self) -> DataFrame:
        return self.spark.read.schema(f"{REVISION}, batch int, day date").parquet(f"{self.path}/revisions").drop("batch", "day")

    def latest(self) -> DataFrame:
        return aggregates.latest(self.revisions())

    def numbers(self, batch: int) -> int:
        """The last message number handed out up to a batch."""
        return 0 if batch < 0 else self.read("numbers", "last long", batch).first()[0]

    def last_batch(self) -> int:
        """The last batch that is whole, or -1."""
        fs, path = filesystem(self.spark, f"{self.path}/state")
        done = [int(x.getPath().getName().removeprefix("batch=")) for x in fs.listStatus(path)] if fs.exists(path) else []
        return max((b for b in done if fs.exists(child(self.spark, path, f"batch={b}/numbers/_SUCCESS"))), default=-1)

    def late_arrivals(self) -> DataFrame:
        """The audit of all batches that are whole."""
        return self.history("late", LATE, self.last_batch() + 1).drop("batch", "day")

    def outbox(self) -> DataFrame:
        """The messages of all batches that are whole."""
        return self.history("outbox", MESSAGE, self.last_batch() + 1).drop("batch", "day")

    def process(self, events: DataFrame, batch: int) -> None:
        marks, waiting = self.read("marks", MARKS, batch - 1), self.read("open", OPEN, batch - 1)
        events = events.select(*EVENT)
        fresh = dedup.unprocessed(dedup.first_occurrences(events, order=("partition", "offset")), self.processed(batch, events)).persist()  # watermarks read it twice
        rows = windows.classified(fresh, self.window, self.lateness, carried=marks).persist()
        try:
            tops = rows.groupBy("partition").agg(F.max("occurred_at").alias("max_occurred_at")).unionByName(marks).groupBy("partition").agg(F.max("max_occurred_at").alias("max_occurred_at"))
            watermark = tops.select("partition", (F.col("max_occurred_at") - F.expr(f"INTERVAL '{self.lateness}' SECOND")).alias("watermark"))
            gathered = waiting.unionByName(aggregates.on_time(rows).select(*waiting.columns)).groupBy("tenant_id", "metric", "partition", "window_start", "window_end").agg(F.sum("quantity").cast(MONEY).alias("quantity"), F.sum("event_count").alias("event_count"))
            judged = gathered.join(watermark, "partition").withColumn("done", F.col("watermark") >= F.col("window_end"))
            done = judged.where("done").join(aggregates.first_crossings(rows, judged.where("done")), ["partition", "window_end"], "left").withColumn("revision", F.lit(0)).select(*aggregates.COLUMNS)
            state = self.known(rows, batch).unionByName(done.select(*LATEST))
            fixes = self.corrected(rows, state)
            self.write(done.unionByName(fixes), f"revisions/batch={batch}", "window_start")
            self.write(rows.select("event_id", "received_at"), f"processed/batch={batch}", "received_at")
            self.write(windows.late_arrivals(rows), f"late/batch={batch}", "window_start")
            made = self.history("revisions", REVISION, batch + 1).where(F.col("batch") == batch).drop("batch", "day")
            first = self.numbers(batch - 1) + 1
            self.write(outbox.messages(made, first), f"outbox/batch={batch}", "window_start")
            self.write(tops, f"state/batch={batch}/marks")
            self.write(judged.where("NOT done").select(*waiting.columns), f"state/batch={batch}/open")
            self.write(made.agg((F.count("*") + first - 1).alias("last")), f"state/batch={batch}/numbers")
        finally:
            rows.unpersist()
            fresh.unpersist()

    @staticmethod
    def corrected(rows: DataFrame, state: DataFrame) -> DataFrame:
        """Corrections on top of the last revision known, numbered on from it."""
        last = state.groupBy(*KEY).agg(F.max("revision").alias("__rev"))
        fixes = aggregates.corrections(rows, state.join(last, (KEY)).where("revision = __rev").drop("__rev", "revision"))
        return fixes.join(last, KEY, "left").withColumn("revision", (F.col("revision") + F.coalesce("__rev", F.lit(0))).cast("int")).drop("__rev").select(*aggregates.COLUMNS)

    def start(self, stream: DataFrame, **trigger):
        """stream: log records. A replayed batch overwrites its own directories."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
