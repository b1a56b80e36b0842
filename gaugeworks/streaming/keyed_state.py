"""Metering with keyed state: one stateful operator a log partition, another for ids with an expiry.

State lies in RocksDB (`with_rocksdb`) and is read and written by key, ids by pages of a bounded number of them (`Paged`), so what a batch costs
depends on the batch and on the windows still open, not on what came before. A log partition is one key: its rows come in offset order and its watermark is its own.
A batch of one partition is held in memory by its task; the source's limit for a batch bounds it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.functions.scalar import window_start

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
#: What the metering operator emits; a row has the columns of its kind. Times are microseconds.
OUTPUT = "kind string, partition int, tenant_id string, metric string, window_start long, quantity decimal(38,9), event_count long, revision int, sealed_at long, event_id string, occurred_at long, received_at long, deliveries long, processed long"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), at)


def from_micros(n: Column) -> Column:
    return F.expr(EPOCH) + F.make_dt_interval(secs=(n / 1_000_000).cast("decimal(20,6)"))


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, as stateful operators need.

    State expires with the batches that bring rows: in processing time a batch without rows always asks for one more, and a stream that is to end with its source wouldn't.
    """
    session = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return session


class Paged:
    """Ids with a number each in map state, many ids a row: each call from the worker to the store costs as much as hundreds of ids in one.

    An id's page is the last bits of its CRC-32. When pages would hold more than `full` ids on average they are split, each into pages of its own, so
    that an id costs the same however many there are. With `keep` (milliseconds) an id is gone that long after its number was last set, in processing time.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, keep: int | None, full: int = 1024):
        self.keep, self.full = keep, full
        self.size = handle.getValueState(f"{name}_size", "bits int, ids long")
        self.pages = handle.getMapState(name, "page long", "ids string", keep)

    @staticmethod
    def hashes(ids: list) -> np.ndarray:
        return np.fromiter((0 if i is None else crc32(i.encode()) for i in ids), np.int64, len(ids))

    def read(self, page: int, now: int) -> dict:
        """id: (number, when it was set), of those not gone."""
        held = self.pages.getValue((page,))
        entries = {i: (number, at) for i, number, at in zip(*json.loads(held[0]))} if held else {}
        return entries if self.keep is None else {i: x for i, x in entries.items() if x[1] + self.keep > now}

    def write(self, page: int, entries: dict) -> None:
        numbers, times = zip(*entries.values())
        self.pages.updateValue((page,), (json.dumps([list(entries), numbers, times]),))

    def split(self, bits: int, more: int, now: int) -> int:
        """Split every page by `more` bits; returns how many ids there are."""
        held = 0
        for (page,) in [tuple(k) for k in self.pages.keys()]:
            entries, parts = self.read(page, now), {}
            held += len(entries)
            for i, place in zip(entries, (self.hashes(list(entries)) & ((1 << (bits + more)) - 1)).tolist()):
                parts.setdefault(place, {})[i] = entries[i]
            if page not in parts:
                self.pages.removeKey((page,))
            for place, part in parts.items():
                self.write(place, part)
        return held

    def visit(self, ids: list, now: int, decide: Callable[[int, tuple | None], int | None]) -> None:
        """Calls decide with each place in `ids`, those of one id in their order, and the id's (number, when) or None; sets the number that it returns."""
        hashes = self.hashes(ids)
        bits, held = self.size.get() or (0, 0)
        wanted = held + len(np.unique(hashes))
        if wanted > self.full << bits:
            more = int(2 * wanted // (self.full << bits)).bit_length()
            held = self.split(bits, more, now)
            bits += more
        pages = hashes & ((1 << bits) - 1)
        order = np.argsort(pages, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(pages[order])) + 1):
            page = int(pages[part[0]])
            entries, changed = self.read(page, now), False
            held -= len(entries)
            for k in part.tolist():
                if (number := decide(k, entries.get(ids[k]))) is not None:
                    entries[ids[k]] = number, now
                    changed = True
            held += len(entries)
            if changed:
                self.write(page, entries)
        self.size.update((bits, held))


def tables(rows: Iterator, columns: list[str], n: int = 10_000) -> Iterator[pd.DataFrame]:
    """Rows as tables of `n` at most."""
    rows = iter(rows)
    while part := list(islice(rows, n)):
        yield pd.DataFrame(part, columns=columns, dtype=object)


class Metering(StatefulProcessor):
    """One log partition: its watermark, ids it has processed, open windows, and the last total of each sealed window.

    `keep_seconds` lets ids and sealed totals expire in processing time that long after they were written (never, unless given).
    """

    def __init__(self, window_seconds: int, lateness_seconds: int, keep_seconds: int | None = None):
        self.window, self.lateness = window_seconds * 1_000_000, lateness_seconds * 1_000_000
        self.keep = None if keep_seconds is None else keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = "tenant_id string, metric string, window_start long"
        self.mark = handle.getValueState("mark", "max_occurred_at long, offset long")
        self.seen = Paged(handle, "seen", self.keep)
        self.open = handle.getMapState("open", key, "quantity decimal(38,9), event_count long")
        self.sealed = handle.getMapState("sealed", key, "quantity decimal(38,9), event_count long, revision int", self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("offset")
        top, offset = self.mark.get() or (None, -1)
        deliveries, last = len(batch), int(batch["offset"].iloc[-1])
        offsets, new = batch["offset"].to_numpy(), np.zeros(deliveries, bool)

        def first(k: int, held: tuple | None) -> int | None:
            if held is None:
                new[k] = True
                return int(offsets[k])

        self.seen.visit(batch["event_id"].tolist(), 0 if self.keep is None else timerValues.getCurrentProcessingTimeInMs(), first)
        fresh = batch[new]
        del batch
        yield from self.labelled([{"kind": "batch", "deliveries": deliveries, "processed": len(fresh)}], key)
        if len(fresh):
            tops = np.maximum.accumulate(fresh["occurred_at"].to_numpy())
            tops = tops if top is None else np.maximum(tops, top)
            top = int(tops[-1])
            yield from self.labelled(self.metered(fresh, tops - self.lateness), key)
        self.mark.update((top, max(offset, last)))

    @staticmethod
    def labelled(rows, key) -> Iterator[pd.DataFrame]:
        return (t.assign(partition=key[0]) for t in tables(rows, COLUMNS))

    def metered(self, fresh: pd.DataFrame, watermarks: np.ndarray) -> Iterator[dict]:
        late = watermarks >= fresh["window_start"].to_numpy() + self.window
        sums: dict[tuple, list] = {}
        timely = fresh[~late]
        for *window, quantity in zip(*(timely[c].tolist() for c in ("tenant_id", "metric", "window_start", "quantity"))):
            total = sums.setdefault(tuple(window), [0, 0])
            total[0] += quantity
            total[1] += 1
        for window, (quantity, n) in sums.items():
            before = self.open.getValue(window)
            self.open.updateValue(window, (quantity + before[0], n + before[1]) if before else (quantity, n))
        last: dict[tuple, tuple] = {}  # of the windows that this batch seals or corrects
        for window, (quantity, n) in [(tuple(k), tuple(v)) for k, v in self.open.iterator()]:
            if (end := window[2] + self.window) <= watermarks[-1]:
                last[window] = quantity, n, 0
                yield self.revision(window, quantity, n, 0, watermarks[np.searchsorted(watermarks, end)])
                self.open.removeKey(window)
        for row, watermark in zip(fresh[late].itertuples(), watermarks[late]):
            window = (row.tenant_id, row.metric, row.window_start)
            if window not in last:
                last[window] = self.sealed.getValue(window) or (0, 0, 0)
            quantity, n, revision = last[window]
            last[window] = quantity + row.quantity, n + 1, revision + 1
            yield self.revision(window, *last[window], watermark)
            yield {"kind": "late", "tenant_id": row.tenant_id, "metric": row.metric, "window_start": row.window_start, "quantity": row.quantity, "sealed_at": int(watermark), "event_id": row.event_id, "occurred_at": row.occurred_at, "received_at": row.received_at}
        for window, total in last.items():
            self.sealed.updateValue(window, total)

    @staticmethod
    def revision(window: tuple, quantity, n: int, revision: int, at) -> dict:
        return {"kind": "revision", "tenant_id": window[0], "metric": window[1], "window_start": window[2], "quantity": quantity, "event_count": n, "revision": revision, "sealed_at": int(at)}


def metering(stream: DataFrame, window_seconds: int, lateness_seconds: int, keep_seconds: int | None = None) -> DataFrame:
    """Rows of OUTPUT from a stream of log records: revisions, late arrivals, and for each batch of a partition how many came and counted."""
    start = window_start(F.col("occurred_at"), window_seconds)
    rows = stream.select("partition", "offset", "event_id", "tenant_id", "metric", "quantity", micros(F.col("occurred_at")).alias("occurred_at"), micros(F.col("received_at")).alias("received_at"), micros(start).alias("window_start"))
    processor = Metering(window_seconds, lateness_seconds, keep_seconds)
    return rows.groupBy("partition").transformWithStateInPandas(processor, OUTPUT, "update", "none" if keep_seconds is None else "processingTime")


def revisions(out: DataFrame, window_seconds: int) -> DataFrame:
    rows = out.where("kind = 'revision'")
    end = from_micros(F.col("window_start") + window_seconds * 1_000_000)
    return rows.select("tenant_id", "metric", "partition", from_micros(F.col("window_start")).alias("window_start"), end.alias("window_end"), "quantity", "event_count", "revision", from_micros(F.col("sealed_at")).alias("sealed_at"))


def late_arrivals(out: DataFrame, window_seconds: int) -> DataFrame:
    """The audit rows, as `windows.late_arrivals` has them."""
    rows = out.where("kind = 'late'")
    end = F.col("window_start") + window_seconds * 1_000_000
    millis = lambda n: F.greatest(F.lit(0).cast("long"), F.floor(n / 1000).cast("long"))
    return rows.select(
        "event_id", "tenant_id", "metric", from_micros(F.col("window_start")).alias("window_start"), "quantity", millis(end - F.col("occurred_at")).alias("lateness_ms"), millis(F.col("sealed_at") - end).alias("watermark_lateness_ms"),
        from_micros(F.col("occurred_at")).alias("occurred_at"), from_micros(F.col("received_at")).alias("received_at"),
    )


def accounting(out: DataFrame) -> DataFrame:
    """Deliveries, ids processed and duplicates of each partition, added up over the batches."""
    return out.where("kind = 'batch'").groupBy("partition").agg(F.sum("deliveries").alias("deliveries"), F.sum("processed").alias("processed"), F.sum(F.col("deliveries") - F.col("processed")).alias("duplicates"))


def restored(spark: SparkSession, checkpoint: str, window_seconds: int) -> DataFrame:
    """Open windows, watermark base and offset of each partition as a stopped metering stream left them: read from its state, no stream is started."""

    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    marks = state("mark").select(F.col("key.partition").alias("partition"), F.col("value.offset").alias("offset"), from_micros(F.col("value.max_occurred_at")).alias("max_occurred_at"))
    waiting = state("open").select(F.col("key.partition").alias("partition"), "user_map_key.*", "user_map_value.*")
    end = from_micros(F.col("window_start") + window_seconds * 1_000_000)
    return waiting.join(F.broadcast(marks), "partition").select("tenant_id", "metric", "partition", from_micros(F.col("window_start")).alias("window_start"), end.alias("window_end"), "quantity", "event_count", "offset", "max_occurred_at")  # a row a partition


class Expiring(StatefulProcessor):
    """Ids of one bucket with the time each was last accepted; a refused sighting doesn't move it.

    What decides is the sightings' own time. An entry is dropped when it wasn't written for `keep_seconds` of processing time.
    """

    def __init__(self, ttl_seconds: int, keep_seconds: int):
        self.ttl, self.keep = ttl_seconds * 1_000_000, keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = Paged(handle, "accepted", self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("at")
        ids, times, good = batch["id"].tolist(), batch["at"].to_numpy(), np.zeros(len(batch), bool)

        def accept(k: int, held: tuple | None) -> int | None:
            if held is None or times[k] >= held[0] + self.ttl:
                good[k] = True
                return int(times[k])

        self.accepted.visit(ids, timerValues.getCurrentProcessingTimeInMs(), accept)
        yield batch.loc[good, ["id", "at"]]


def accepted_by_ttl(sightings: DataFrame, key: str, at: str, ttl_seconds: int, keep_seconds: int | None = None, buckets: int = 64) -> DataFrame:
    """A stream of sightings, less those within the TTL of the last accepted one: what `dedup.accepted_by_ttl` does to a table.

    Sightings of an id come in the order of time, but for those of one batch. keep_seconds: how long an id is kept in processing time
    (twice the TTL by default); a replay that runs behind its own times by more than the rest of it would accept too much.
    """
    rows = sightings.select(F.col(key).cast("string").alias("id"), micros(F.col(at)).alias("at")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    out = rows.groupBy("bucket").transformWithStateInPandas(Expiring(ttl_seconds, keep_seconds or 2 * ttl_seconds), "id string, at long", "update", "processingTime")
    return out.select(F.col("id").alias(key), from_micros(F.col("at")).alias("accepted_at"))
