"""The outbox relay as a stream: a pass at each tick of a clock, with attempts that survive restarts.

A pass takes the messages with the smallest ids that are neither delivered nor dead, at most `n`, delivers them, and writes what
came of it under its number: the log of tries, then the state (messages that failed and will be tried again, and the id up to which messages have been taken).
A message that failed `attempts` times is a dead letter. A pass that is tried again reads the same state and overwrites what it wrote, so
a message can be delivered twice but not be lost: the sink knows it by its key. State grows with what fails, not with what was sent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.operators.outbox import MAX_ATTEMPTS, RELAY_BATCH
from gaugeworks.streaming.micro_batches import child, filesystem

TRIED = "id long, aggregate_key string, attempts int, delivered boolean, tried_at timestamp_ntz"
PENDING = "id long, attempts int"


class Relay:
    """messages: a function to the outbox as it stands (id, aggregate_key, payload; ids only ever grow).
    deliver: from messages with their attempts so far to id and delivered; `outbox.webhook` is one."""

    def __init__(self, spark: SparkSession, path: str, messages: Callable[[], DataFrame], deliver: Callable[[DataFrame], DataFrame], n: int = RELAY_BATCH, attempts: int = MAX_ATTEMPTS):
        self.spark, self.path, self.messages, self.deliver, self.n, self.attempts = spark, path.rstrip("/"), messages, deliver, n, attempts

    def last_pass(self, before: int) -> int:
        """The last pass before this one whose state is whole; passes without work leave none."""
        fs, path = filesystem(self.spark, f"{self.path}/state")
        names = [x.getPath().getName().removeprefix("pass=") for x in fs.listStatus(path)] if fs.exists(path) else []
        numbers = sorted((int(p) for p in names if int(p) < before), reverse=True)
        return next((p for p in numbers if fs.exists(child(self.spark, path, f"pass={p}/cursor/_SUCCESS"))), -1)

    def fresh(self, upto: int) -> DataFrame:
        """The first `n` messages beyond an id. Ids mostly follow on each other, so the next `n` ids are looked at first: a pass reads what it takes, not all that is still to come."""
        ids = self.messages().select("id", F.lit(0).alias("attempts"))
        near = ids.where(F.col("id").between(upto + 1, upto + self.n))
        if near.count() == self.n:
            return near
        return ids.where(F.col("id") > upto).orderBy("id").limit(self.n)

    def state(self, before: int) -> tuple[DataFrame, int]:
        """Messages to try again, and the id up to which messages have been taken."""
        last = self.last_pass(before)
        if last < 0:
            return self.spark.createDataFrame([], PENDING), 0
        place = f"{self.path}/state/pass={last}"
        return self.spark.read.schema(PENDING).parquet(f"{place}/pending"), self.spark.read.schema("upto long").parquet(f"{place}/cursor").first()[0]

    def run(self, number: int) -> int:
        """One pass; returns how many messages it tried."""
        pending, upto = self.state(number)
        chosen = pending.unionByName(self.fresh(upto)).orderBy("id").limit(self.n)
        ids = chosen.collect()  # n at most
        if not ids:
            return 0
        chosen = F.broadcast(self.spark.createDataFrame(ids, PENDING))
        sent = self.messages().where(F.col("id").between(ids[0].id, ids[-1].id)).select("id", "aggregate_key", "payload").join(chosen, "id")
        answers = self.deliver(sent).select("id", "delivered")
        tried = sent.drop("payload").join(answers, "id", "left").select("id", "aggregate_key", (F.col("attempts") + 1).cast("int").alias("attempts"), F.coalesce("delivered", F.lit(False)).alias("delivered"), F.localtimestamp().alias("tried_at"))
        place = f"{self.path}/log/pass={number}"
        tried.write.mode("overwrite").parquet(place)
        outcome = self.spark.read.schema(TRIED).parquet(place)
        again = outcome.where(~F.col("delivered") & (F.col("attempts") < self.attempts)).select("id", "attempts")
        state = f"{self.path}/state/pass={number}"
        pending.join(chosen.select("id"), "id", "left_anti").unionByName(again).coalesce(1).write.mode("overwrite").parquet(f"{state}/pending")
        self.spark.createDataFrame([(max(upto, ids[-1].id),)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{state}/cursor")
        return len(ids)

    def log(self) -> DataFrame:
        """All tries of the passes that are whole."""
        last = self.last_pass(1 << 62)
        if last < 0:
            return self.spark.createDataFrame([], f"{TRIED}, pass long")
        return self.spark.read.schema(f"{TRIED}, pass long").parquet(f"{self.path}/log").where(F.col("pass") <= last)

    def outbox(self) -> DataFrame:
        """The messages with published_at and attempts, as the outbox operators read them: attempts are those that failed."""
        tries = self.log().groupBy("id").agg(F.min(F.when(F.col("delivered"), F.col("tried_at"))).alias("published_at"), F.count_if(~F.col("delivered")).cast("int").alias("attempts"))
        return self.messages().join(tries, "id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))

    def start(self, every: str = "1 second"):
        """A pass at each tick. The clock's checkpoint numbers the passes on after a restart."""
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return clock.writeStream.foreachBatch(lambda _, number: self.run(number) and None).option("checkpointLocation", f"{self.path}/checkpoint").trigger(processingTime=every).start()
