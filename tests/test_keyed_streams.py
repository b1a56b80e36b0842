"""Keyed state, relay, sliding counters, run records: results depend neither on cuts nor on restarts."""

import collections
import random
import time
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import aggregates, dedup, outbox, reconcile, windows
from gaugeworks.sources import usage
from gaugeworks.streaming import keyed_state, monitor, replay
from gaugeworks.streaming.micro_batches import MeteringStream
from gaugeworks.streaming.relay import Relay
from gaugeworks.streaming.sliding import SlidingCounters

DAY, HOUR = 86_400, 3_600
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    return usage.written(usage.usage_log(spark, "/root/testdata/sf0.001").drop("seq", "redelivery"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def expected(log):
    rows = usage.written(windows.classified(dedup.first_occurrences(log, order=("partition", "offset")), DAY, HOUR))
    revisions = usage.written(aggregates.revisions(rows))
    messages = outbox.messages(revisions).drop("id")
    return {"revisions": rows_of(revisions), "late": rows_of(windows.late_arrivals(rows)), "accounting": rows_of(dedup.stats(log)), "messages": rows_of(messages)}


@pytest.mark.parametrize("cuts", [[], [40], [15, 100, 180]])
def test_keyed_metering(spark, log, expected, tmp_path, cuts):
    """One query a file group: each later one is a restart. Progress events add up; the lag is read from the state."""
    session = keyed_state.with_rocksdb(spark)
    said = monitor.Progress()
    session.streams.addListener(said)
    edges, rates = [0, *cuts, 1 << 40], []
    for a, b in zip(edges, edges[1:]):
        log.where((F.col("offset") >= a) & (F.col("offset") < b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = session.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
        query = replay.drained(monitor.observed(keyed_state.metering(stream, DAY, HOUR)), str(tmp_path))
        rates += [monitor.as_row(p) for p in query.recentProgress if p.numInputRows]
        # state rows written: the batch's ids and windows, not the history's
        assert all(p.stateOperators[0].numRowsUpdated <= 4 * p.numInputRows + 8 for p in query.recentProgress if p.numInputRows)
    out = spark.read.schema(keyed_state.OUTPUT).parquet(f"{tmp_path}/out")
    columns = aggregates.COLUMNS
    assert rows_of(keyed_state.revisions(out, DAY).select(*columns)) == expected["revisions"]
    assert rows_of(keyed_state.late_arrivals(out, DAY)) == expected["late"]
    assert rows_of(keyed_state.accounting(out)) == expected["accounting"]
    counts = monitor.table(spark, rates)
    total = counts.agg(F.sum("deliveries"), F.sum("processed"), F.sum("duplicates")).first()
    assert tuple(total) == tuple(sum(r[k] for r in expected["accounting"]) for k in (1, 2, 3))
    assert all(r.rows > 0 and r.rows_per_second > 0 for r in monitor.throughput(counts).collect())
    ends = log.groupBy("partition").agg((F.max("offset") + 11).alias("end_offset"))
    assert {r.lag for r in monitor.lag(session, f"{tmp_path}/checkpoint", ends).collect()} == {10}
    deadline = time.time() + 20
    while len([r for r in said.rows if r[2]]) < len(rates) and time.time() < deadline:
        time.sleep(0.2)
    assert sorted(r[:6] for r in said.rows if r[2]) == sorted(r[:6] for r in rates)
    session.streams.removeListener(said)


@pytest.mark.parametrize("cuts", [[60], [15, 100, 180]])
def test_audit_and_outbox_of_the_stream(spark, log, expected, tmp_path, cuts):
    stream = MeteringStream(spark, str(tmp_path), DAY, HOUR)
    edges = [0, *cuts, 1 << 40]
    assert stream.outbox().count() == 0
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        part = log.where((F.col("offset") >= a) & (F.col("offset") < b))
        stream.process(part, n)
        if n == 1:
            MeteringStream(spark, str(tmp_path), DAY, HOUR).process(part, n)  # tried again by another driver
    assert rows_of(stream.late_arrivals()) == expected["late"]
    messages = stream.outbox()
    assert rows_of(messages.drop("id")) == expected["messages"]
    assert sorted(r.id for r in messages.select("id").collect()) == list(range(1, len(expected["messages"]) + 1))
    # what a batch that isn't whole has written isn't seen
    stream.write(messages, f"outbox/batch={n + 1}", "window_start")
    assert stream.outbox().count() == len(expected["messages"])


def test_ttl_in_random_batches(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"k{r.randint(0, 12)}", T0 + timedelta(seconds=r.randint(0, 3000))) for _ in range(400)]
    seen = spark.createDataFrame(rows, "id string, at timestamp_ntz")
    cuts = sorted(r.sample(range(3000), 3))
    part = sum(((F.col("at") >= F.lit(T0 + timedelta(seconds=c))).cast("int") for c in cuts), F.lit(0))
    stream = replay.streamed(keyed_state.with_rocksdb(spark), seen, part)
    replay.drained(keyed_state.accepted_by_ttl(stream, "id", "at", 300, buckets=4), str(tmp_path))
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == rows_of(dedup.accepted_by_ttl(seen, "id", "at", 300))


def fails(message: int, attempt: int) -> bool:
    """A sink that takes about two tries in three, and never takes every nineteenth message."""
    return message % 19 == 0 or (message * 7919 + attempt * 104_729) % 3 == 0


def test_relay_survives_restarts(spark, tmp_path):
    """Passes by ever new relays, some tried again: oldest first, each key delivered or dead after five tries."""
    messages = spark.range(1, 121).select("id", F.concat(F.lit("key-"), F.col("id").cast("string")).alias("aggregate_key"), F.lit("{}").alias("payload"))
    bad = (F.col("id") % 19 == 0) | ((F.col("id") * 7919 + F.col("attempts") * 104_729) % 3 == 0)
    deliver = lambda df: df.select("id", (~bad).alias("delivered"))
    relay = lambda: Relay(spark, str(tmp_path), lambda: messages, deliver, n=50)
    number = 0
    while relay().run(number):
        if number in (0, 3):
            relay().run(number)
        number += 1
    tries = relay().log().collect()
    waiting = {i: 0 for i in range(1, 121)}
    for k in range(number):  # the same by a plain queue
        chosen = sorted(waiting)[:50]
        assert sorted(t.id for t in tries if t["pass"] == k) == chosen
        for i in chosen:
            if not fails(i, waiting[i]):
                del waiting[i]
            else:
                waiting[i] += 1
                if waiting[i] == 5:
                    del waiting[i]
    assert not waiting
    after = relay().outbox()
    dead = {i for i in range(1, 121) if all(fails(i, a) for a in range(5))}
    status = outbox.status(after).first()
    assert (status.published, status.pending, status.dead_letters) == (120 - len(dead), 0, len(dead)) and len(dead) >= 6
    assert {r.id for r in after.where("published_at IS NULL").collect()} == dead
    assert max(collections.Counter(t.id for t in tries if t.delivered).values()) == 1


def test_relay_runs_by_its_clock(spark, tmp_path):
    messages = spark.range(1, 31).select("id", F.col("id").cast("string").alias("aggregate_key"), F.lit("{}").alias("payload"))
    relay = Relay(spark, str(tmp_path), lambda: messages, outbox.memory_sink, n=20)
    for upto in (20, 30):
        query = relay.start("200 milliseconds")
        deadline = time.time() + 60
        while relay.log().count() < upto and time.time() < deadline:
            time.sleep(0.3)
        query.stop()
    assert outbox.status(relay.outbox()).first().published == 30


@pytest.mark.parametrize("cuts", [[], [500, 1500]])
def test_sliding_counters(spark, tmp_path, cuts):
    r = random.Random(8)
    rows = [("a" if r.random() < 0.9 else "b", "m", Decimal(r.randint(1, 9)), T0 + timedelta(seconds=r.choice([r.randint(0, 2000), r.randint(9000, 9100)]))) for _ in range(600)]
    df = spark.createDataFrame(rows, "tenant_id string, metric string, quantity decimal(38,9), occurred_at timestamp_ntz")
    counters = SlidingCounters(spark, str(tmp_path), 60, 5)
    edges = [T0 + timedelta(seconds=s) for s in (0, *cuts, 1 << 20)]
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        for _ in range(1 + n % 2):
            counters.process(df.where((F.col("occurred_at") >= F.lit(a)) & (F.col("occurred_at") < F.lit(b))), n)
    want = collections.defaultdict(lambda: [Decimal(0), 0])
    for tenant, _, q, at in rows:
        pane = int((at - T0).total_seconds()) // 60
        for k in range(pane - 4, pane + 1):
            total = want[tenant, T0 + timedelta(seconds=60 * k)]
            total[0] += q
            total[1] += 1
    got = counters.windows().collect()
    assert {(x.tenant_id, x.window_start): [x.quantity, x.event_count] for x in got} == want and len(got) == len(want)
    at = int(T0.replace(tzinfo=timezone.utc).timestamp()) + 700
    assert {x.tenant_id: x.usage for x in counters.usage(at).collect()} == {t: want[t, T0 + timedelta(seconds=420)][0] for t in "ab"}
    tenants = spark.createDataFrame([("a", "pro", {"m": Decimal(1)}, T0), ("b", "pro", {"m": Decimal(10**6)}, T0)], "tenant_id string, plan string, quotas map<string,decimal(38,9)>, created_at timestamp_ntz")
    assert {x.tenant_id: x.allowed for x in counters.checked(tenants, at).collect()} == {"a": False, "b": True}


def test_record_of_runs(spark, tmp_path):
    columns = reconcile.HISTORY.removeprefix("sequence long, ")
    row = lambda k, kind: ("t", "m", T0 + timedelta(days=k), T0 + timedelta(days=k + 1), Decimal(1), Decimal(1), Decimal(0), Decimal(0), kind, None, "e")
    history = reconcile.History(spark, str(tmp_path))
    assert history.newest().count() == 0
    one, two = (spark.createDataFrame([row(k, kind) for k in range(n)], columns) for n, kind in ((5, "MATCH"), (3, "REAL")))
    history.record("first", one)
    history.record("second", two)
    history.record("first", one)  # again
    rows = history.newest(6).collect()
    assert [(r.sequence, r.run_id, r.divergence_class) for r in rows] == [(8, "second", "REAL"), (7, "second", "REAL"), (6, "second", "REAL"), (5, "first", "MATCH"), (4, "first", "MATCH"), (3, "first", "MATCH")]
    with pytest.raises(ValueError):
        history.record("first", two)


def test_wire_rows_and_options_of_the_log_sink(spark, log):
    """What the sink would hand to the connector: a key and a value that reads back, and its options."""
    sent = usage.to_json(log)
    assert sent.columns == ["key", "value"] and sent.schema["value"].dataType.simpleString() == "string"
    back = usage.decoded(sent)
    assert rows_of(back.select("event_id", "quantity", "occurred_at")) == rows_of(log.select("event_id", "quantity", "occurred_at"))
    assert {r.key for r in sent.select("key").distinct().collect()} == {r.tenant_id for r in log.select("tenant_id").distinct().collect()}
    assert usage.kafka_sink_options("h:1", "usage", "/c") == {"kafka.bootstrap.servers": "h:1", "topic": "usage", "checkpointLocation": "/c", "kafka.acks": "all", "kafka.enable.idempotence": "true"}


class Store:
    """What a state handle gives, kept in a dict; counts the calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    getValueState = getMapState = lambda self, name, *_: self.__dict__.setdefault(name, Store())

    def called(self):
        self.calls += 1
        return self.rows

    get = lambda self: self.called().get(())
    update = lambda self, value: self.called().update({(): value})
    getValue = lambda self, key: self.called().get(key)
    updateValue = lambda self, key, value: self.called().update({key: value})
    removeKey = lambda self, key: self.called().pop(key, None)
    keys = lambda self: iter(list(self.called()))


@pytest.mark.parametrize("keep", [None, 50])
def test_ids_in_pages(keep):
    """As a dict with expiry, over pages that split as they fill; the store is called by page, not by id."""
    r, store, plain = random.Random(3), Store(), {}
    paged = keyed_state.Paged(store, "ids", keep, full=64)
    for now in range(0, 400, 20):
        batch = [None if r.random() < 0.01 else f"{r.choice('aé')}\"{r.randint(0, 3000)}" for _ in range(r.choice([1, 700]))]
        got, want = [], []

        def decide(k, held):
            got.append((k, held))
            return k if held is None or k % 3 == 0 else None

        paged.visit(batch, now, decide)
        for k, i in enumerate(batch):
            held = plain.get(i)
            held = held if held is None or keep is None or held[1] + keep > now else None
            want.append((k, held))
            if held is None or k % 3 == 0:
                plain[i] = (k, now)
        assert sorted(got) == want
    assert max(len(paged.read(p, 0)) for (p,) in store.ids.rows) <= 4 * 64 and len(store.ids.rows) > 8


def test_state_of_many_ids_is_few_rows(spark, tmp_path):
    rows = spark.range(4000).select(F.lit(0).alias("partition"), F.col("id").alias("offset"), F.concat(F.lit("e"), (F.col("id") % 3900).cast("string")).alias("event_id"), F.lit("t").alias("tenant_id"), F.lit("m").alias("metric"), F.lit(1).cast(usage.MONEY).alias("quantity"), F.lit(T0).cast("timestamp_ntz").alias("occurred_at"), F.lit(T0).cast("timestamp_ntz").alias("received_at"))
    stream = replay.streamed(keyed_state.with_rocksdb(spark), rows, F.floor(F.col("offset") / 2000))
    query = replay.drained(keyed_state.metering(stream, DAY, HOUR), str(tmp_path))
    assert rows_of(keyed_state.accounting(spark.read.schema(keyed_state.OUTPUT).parquet(f"{tmp_path}/out"))) == [(0, 4000, 3900, 100)]
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.numInputRows) < 50


def test_large_parts_are_several_files(spark, tmp_path):
    rows = spark.range(3000).select("id", (F.col("id") / 1000).cast("int").alias("part"))
    files = replay.cut(rows, F.col("part"), f"{tmp_path}/in", rows_a_file=250)
    assert files == 4 and len(list((tmp_path / "in").glob("*.parquet"))) == 12
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    seen = []
    stream.writeStream.foreachBatch(lambda df, n: seen.append((n, rows_of(df.groupBy("part").count())))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == [(n, [(n, 1000)]) for n in range(3)]


def test_ids_and_numbers_are_not_broadcast(spark, log, tmp_path):
    """Small as the files of ids are, they grow with history: joins with them shuffle."""
    known = usage.written(log.select("event_id"))
    assert "BroadcastHashJoin" not in dedup.unprocessed(log, known)._jdf.queryExecution().executedPlan().toString()
    rows = windows.progress(log, HOUR)
    rows.collect()
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()


def test_watermarks_read_a_batch_once(spark, log, tmp_path):
    """A batch's new events are kept, with the columns that metering needs, for what reads them twice."""
    stream, kept = MeteringStream(spark, str(tmp_path), DAY, HOUR), []
    classified = windows.classified
    try:
        windows.classified = lambda events, *a, **k: kept.append((events.is_cached, set(events.columns))) or classified(events, *a, **k)
        stream.process(log, 0)
    finally:
        windows.classified = classified
    assert kept == [(True, {"partition", "offset", "event_id", "tenant_id", "metric", "quantity", "occurred_at", "received_at"})]


def test_relay_takes_fresh_messages_from_near_ids(spark, tmp_path):
    """With gaps the search goes on beyond the near ids; without, only those are read. States are looked at newest first."""
    messages = spark.createDataFrame([(i,) for i in (*range(1, 41), *range(45, 90, 2))], "id long")
    relay = Relay(spark, str(tmp_path), lambda: messages, outbox.memory_sink, n=20)
    ids = lambda upto: sorted(r.id for r in relay.fresh(upto).collect())
    assert ids(0) == list(range(1, 21)) and "Sort" not in relay.fresh(0)._jdf.queryExecution().toString()
    assert ids(30) == [*range(31, 41), *range(45, 65, 2)] and ids(80) == [81, 83, 85, 87, 89] and ids(89) == []
