"""Outbox: a message for each revision, relayed first in, first out, to an idempotent sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeworks.functions.scalar import aggregate_key
from gaugeworks.sources.usage import WIRE_TIMES, numbered_globally

MAX_ATTEMPTS = 5
RELAY_BATCH = 100


def messages(revs: DataFrame, start: int = 1) -> DataFrame:
    """A message for each revision, numbered on from `start` in the order of tenant, metric, window and revision."""
    key = aggregate_key(F.col("tenant_id"), F.col("metric"), F.col("window_start"), F.col("revision"))
    payload = F.to_json(F.struct("tenant_id", "metric", "window_start", "window_end", F.col("quantity").cast("string").alias("quantity"), "event_count", "revision", "sealed_at"), WIRE_TIMES)
    rows = revs.withColumn("aggregate_key", key).withColumn("payload", payload).withColumn("created_at", F.col("sealed_at"))
    out = numbered_globally(rows, ["tenant_id", "metric", "window_start", "revision"], start=start)
    return out.select("id", "aggregate_key", "payload", "tenant_id", "metric", "window_start", "revision", "quantity", "event_count", "created_at")


def unpublished(outbox: DataFrame, n: int = RELAY_BATCH) -> DataFrame:
    return outbox.where(F.col("published_at").isNull() & (F.col("attempts") < MAX_ATTEMPTS)).orderBy("id").limit(n)


def status(outbox: DataFrame) -> DataFrame:
    open_ = F.col("published_at").isNull()
    dead = F.col("attempts") >= MAX_ATTEMPTS
    return outbox.agg(F.count_if(~open_).alias("published"), F.count_if(open_ & ~dead).alias("pending"), F.count_if(open_ & dead).alias("dead_letters"), F.count("*").alias("total"))


def pending(outbox: DataFrame) -> DataFrame:
    """Unpublished messages of each window, over all its revisions."""
    return outbox.where("published_at IS NULL").groupBy("tenant_id", "metric", "window_start").agg(F.count("*").alias("pending"))


def relayed(outbox: DataFrame, deliveries: DataFrame, now, n: int = RELAY_BATCH) -> DataFrame:
    """The outbox after one pass. deliveries: id, delivered. Those tried either leave or gain an attempt."""
    tried = unpublished(outbox, n).select("id").join(deliveries, "id", "left").withColumn("delivered", F.coalesce("delivered", F.lit(False)))
    after = outbox.join(tried, "id", "left")
    return after.withColumn("published_at", F.when(F.col("delivered"), now).otherwise(F.col("published_at"))).withColumn("attempts", F.col("attempts") + F.when(F.col("delivered") == F.lit(False), 1).otherwise(0)).drop("delivered")


def recent(outbox: DataFrame, n: int = 50) -> DataFrame:
    return outbox.orderBy(F.desc("id")).limit(n)


def delivery_counts(deliveries: DataFrame) -> DataFrame:
    """What an idempotent sink holds: one row a key, with how often it came."""
    return deliveries.groupBy("aggregate_key").agg(F.count("*").alias("delivery_count"))


def of_window(outbox: DataFrame, tenant_id: str, metric: str, window_start: str) -> DataFrame:
    """Messages of all revisions of one window: those whose key begins with tenant:metric:start (in UTC, without its offset)."""
    return outbox.where(F.col("aggregate_key").startswith(f"{tenant_id}:{metric}:{window_start}+"))


def memory_sink(df: DataFrame, failing: bool = False) -> DataFrame:
    """Deliveries to a sink that takes everything, or nothing while it fails: id and delivered."""
    return df.select("id", F.lit(not failing).alias("delivered"))


def webhook(df: DataFrame, url: str, timeout: float = 5.0) -> DataFrame:
    """POST {aggregate_key, payload} with the key as idempotency header; id and delivered (200, 201 or 202). Run it from foreachBatch."""

    def send(batches):
        import json
        import urllib.request
        from http.client import HTTPException

        import pandas as pd

        for pdf in batches:
            done = []
            for m in pdf.itertuples():
                try:
                    body = json.dumps({"aggregate_key": m.aggregate_key, "payload": json.loads(m.payload)}).encode()
                    request = urllib.request.Request(url, body, {"Content-Type": "application/json", "X-Idempotency-Key": m.aggregate_key})
                    with urllib.request.urlopen(request, timeout=timeout) as answer:
                        done.append(answer.status in (200, 201, 202))
                except (OSError, HTTPException):
                    done.append(False)
            yield pd.DataFrame({"id": pdf["id"], "delivered": done})

    return df.select("id", "aggregate_key", "payload").mapInPandas(send, "id long, delivered boolean")
