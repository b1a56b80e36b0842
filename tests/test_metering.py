"""Invariants of the metering operators on small tables."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.scalar import bloom_positions, bloom_size, drift_percent, key_partition
from gaugeworks.operators import aggregates, dedup, ingest, observe, outbox, quota, reconcile, windows
from gaugeworks.sources import usage

T0 = datetime(2024, 1, 1, 12, 0)
SCHEMA = "event_id string, tenant_id string, metric string, quantity decimal(38,9), occurred_at timestamp_ntz, received_at timestamp_ntz, priority string, partition int, offset long"


def log(spark, rows):
    """rows: (id, quantity, seconds after T0)"""
    return spark.createDataFrame([(str(i), "t", "m", Decimal(q), T0 + timedelta(seconds=s), T0 + timedelta(seconds=n), "high", 0, n) for n, (i, q, s) in enumerate(rows)], SCHEMA)


def chain(df, window=60, lateness=30):
    rows = windows.classified(dedup.first_occurrences(df), window, lateness)
    return {(r.window_start, r.revision): (int(r.quantity), r.event_count) for r in aggregates.revisions(rows).collect()}


def test_late_event_in_the_sealing_batch_adds_to_the_sealed_total(spark):
    got = chain(log(spark, [("a", 100, 10), ("b", 50, 120), ("c", 25, 20)]))
    assert got == {(T0, 0): (100, 1), (T0, 1): (125, 2)}


def test_only_late_events_start_at_revision_one(spark):
    assert chain(log(spark, [("b", 50, 300), ("c", 25, 20)])) == {(T0, 1): (25, 1)}


def test_replays_change_nothing_and_are_seen_without_dedup(spark):
    rows = [("a", 10, 1)] * 100 + [("b", 1, 200)]
    assert chain(log(spark, rows)) == {(T0, 0): (10, 1)}
    undeduplicated = windows.classified(log(spark, rows), 60, 30)
    assert aggregates.sealed(undeduplicated).first().event_count == 100


def test_watermark_includes_the_event_and_never_goes_back(spark):
    df = windows.progress(log(spark, [("a", 1, 0), ("b", 1, -10), ("c", 1, 60)]), 30, chunk=1)
    assert [r.watermark - T0 for r in df.orderBy("offset").collect()] == [timedelta(seconds=s) for s in (-30, -30, 30)]


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_watermark_does_not_depend_on_chunks(spark, chunk):
    rows = [(str(i), 1, (i * 37) % 101) for i in range(40)]
    key = lambda c: [r.watermark for r in windows.progress(log(spark, rows), 30, chunk=c).orderBy("offset").collect()]
    assert key(chunk) == key(7)


def test_window_alignment_and_lag(spark):
    df = windows.assigned(spark.createDataFrame([(datetime(2024, 1, 1, 12, 1, 45, 123456),)], "occurred_at timestamp_ntz"), 60)
    assert (df.first().window_start, df.first().window_end) == (datetime(2024, 1, 1, 12, 1), datetime(2024, 1, 1, 12, 2))
    marks = spark.createDataFrame([(0, T0 + timedelta(seconds=30)), (1, None)], "partition int, watermark timestamp_ntz")
    assert [r.lag_seconds for r in windows.watermark_lag(marks, F.lit(T0 + timedelta(seconds=90)).cast("timestamp_ntz")).orderBy("partition").collect()] == [60.0, 0.0]


def test_exact_decimals(spark):
    assert spark.range(1_000_000).agg(F.sum(F.lit("0.0001").cast("decimal(38,9)"))).first()[0] == Decimal(100)


@pytest.mark.parametrize("proposed, allowed", [(100, True), (500, True), (600, False)])
def test_quota_limit_is_inclusive(spark, proposed, allowed):
    tenants = spark.createDataFrame([("t", "pro", {"m": Decimal(10000)}, T0)], "tenant_id string, plan string, quotas map<string,decimal(38,9)>, created_at timestamp_ntz")
    counts = spark.createDataFrame([("t", "m", Decimal(9500)), ("t", "free", Decimal(10**9)), ("x", "m", Decimal(10**6))], "tenant_id string, metric string, usage decimal(38,9)")
    got = {(r.tenant_id, r.metric): r.allowed for r in quota.checked(counts, tenants, proposed).collect()}
    assert got == {("t", "m"): allowed, ("t", "free"): True, ("x", "m"): False}


def test_drift(spark):
    df = spark.createDataFrame([(Decimal(105), Decimal(100)), (Decimal(100), Decimal(100)), (Decimal(0), Decimal(0)), (Decimal(3), Decimal(0))], "a decimal(38,9), e decimal(38,9)")
    assert [r[0] for r in df.select(drift_percent(F.col("a"), F.col("e"))).collect()] == [5.0, 0.0, 0.0, 100.0]


def test_shedding_and_outcomes(spark):
    df = log(spark, [("a", 1, 0), ("a", 1, 0), (" ", 1, 0), ("b", -1, 0), ("c", 1, 0)]).withColumn("priority", F.when(F.col("event_id") == "c", "low").otherwise("high"))
    rows = ingest.outcomes(ingest.shed(ingest.validated(df), F.lit(2000), 1500, 1000), ["offset"]).orderBy("offset").collect()
    assert [(r.outcome, r.accepted) for r in rows] == [("OK", True), ("DUPLICATE_EVENT", True), ("INVALID_SCHEMA", False), ("INVALID_SCHEMA", False), ("LOW_PRIORITY_SHED", False)]
    with pytest.raises(ValueError):
        ingest.check_batch(1001)


def test_partitions_are_stable_and_spread(spark):
    got = [r.p for r in spark.range(500).select(key_partition(F.concat(F.lit("tenant_"), F.col("id").cast("string")), 8).alias("p")).collect()]
    assert set(got) == set(range(8))
    import zlib

    assert got[17] == zlib.crc32(b"tenant_17") % 8
    with pytest.raises(ValueError):
        key_partition(F.lit("x"), 0)


def test_consumer_lag(spark):
    ends = spark.createDataFrame([(0, 100), (1, 100), (2, 100), (3, 10)], "partition int, end_offset long")
    points = spark.createDataFrame([(0, 99), (1, 49), (3, 99)], "partition int, offset long")
    assert [r.lag for r in reconcile.consumer_lag(ends, points).orderBy("partition").collect()] == [0, 50, 100, 0]
    with pytest.raises(Exception, match="not negative"):
        reconcile.consumer_lag(spark.createDataFrame([(0, -1)], ends.schema), points).collect()


def test_gate_trilogy(spark):
    rows = windows.classified(log(spark, [(str(i), 5, i % 60) for i in range(400)] + [("end", 0, 200)]), 60, 30)
    replay = reconcile.recomputed(rows).where(F.col("window_start") == F.lit(T0).cast("timestamp_ntz"))
    nothing = replay.where("false").withColumn("revision", F.lit(0))
    marks = windows.final_watermarks(rows, 30)
    late = rows.where("is_late")
    pending = spark.createDataFrame([], "tenant_id string, metric string, window_start timestamp_ntz, pending long")
    lag = lambda n: spark.createDataFrame([(0, n)], "partition int, lag long")
    kind = lambda served, n, gated: [(r.divergence_class, int(r.difference)) for r in reconcile.reconciled(replay, served, late, marks, lag(n), pending, gated).collect()]
    assert kind(nothing, 7, True) == [("UNSETTLED", 2000)]
    assert kind(nothing, 7, False) == [("REAL", 2000)]
    assert kind(replay, 0, True) == [("MATCH", 0)]


def test_late_divergence(spark):
    rows = windows.classified(log(spark, [("a", 200, 10), ("b", 1, 120), ("c", 50, 20)]), 60, 30)
    first = aggregates.latest(aggregates.revisions(rows).where("revision = 0"))
    marks, lag = windows.final_watermarks(rows, 30), spark.createDataFrame([(0, 0)], "partition int, lag long")
    pending = spark.createDataFrame([], "tenant_id string, metric string, window_start timestamp_ntz, pending long")
    got = reconcile.reconciled(reconcile.recomputed(rows), first, rows.where("is_late"), marks, lag, pending).orderBy("window_start").first()
    assert (got.divergence_class, int(got.difference)) == ("LATE_ARRIVAL", 50)


def test_outbox_relay(spark):
    box = spark.createDataFrame([(1, None, 0), (2, None, 4), (3, None, 5), (4, T0, 0)], "id long, published_at timestamp_ntz, attempts int")
    tried = spark.createDataFrame([(1, True), (2, False)], "id long, delivered boolean")
    after = {r.id: (r.published_at is not None, r.attempts) for r in outbox.relayed(box, tried, F.lit(T0).cast("timestamp_ntz")).collect()}
    assert after == {1: (True, 0), 2: (False, 5), 3: (False, 5), 4: (True, 0)}


def test_ttl_is_anchored_at_the_last_accepted(spark):
    seen = spark.createDataFrame([("a", T0 + timedelta(hours=h)) for h in (0, 20, 30, 50, 60)], "id string, t timestamp_ntz")
    got = sorted((r.accepted_at - T0).total_seconds() / 3600 for r in dedup.accepted_by_ttl(seen, "id", "t", 86_400).collect())
    assert got == [0, 30, 60]


def test_ttl_query_holds_all_events(spark):
    import __spark_entry__ as entry

    sf, expected = "/root/testdata/sf0.001", set()
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        start = r.ts + timedelta(hours=48 if r.event_id % 20 == 0 else 2 if r.event_id % 7 == 0 else 0)
        last = None
        for at in sorted(start + timedelta(minutes=m, hours=20 * k) for k in range(r.event_id % 6 + 1) for m in ((0, 10) if r.event_id % 50 == 0 else (0,))):
            if last is None or at >= last + timedelta(hours=24):
                expected.add((str(r.event_id), last := at))
    got = [tuple(r) for r in entry.queries()["dedup_ttl"](spark, sf).collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_append_guard(spark, tmp_path):
    rows = windows.classified(log(spark, [("a", 200, 10), ("b", 1, 120), ("c", 50, 20)]), 60, 30)
    revs = aggregates.revisions(rows)
    aggregates.append_strict(revs.where("false"), revs, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        aggregates.append_strict(revs, revs, str(tmp_path / "t"))


def test_codec_keeps_every_digit(spark):
    df = log(spark, [("a", "0.123456789", 0)]).withColumn("idempotency_key", F.lit(None).cast("string")).withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    back = usage.decoded(usage.to_json(df)).first()
    assert back.quantity == Decimal("0.123456789") and back.metadata == {"k": "v"} and back.occurred_at == T0


def test_sizes(spark):
    assert bloom_size(1_000_000, 0.01) == (9585058, 6) and bloom_size(1, 0.5)[0] == 64
    depths = spark.createDataFrame([(2000,), (0,), (750,), (757,), (758,)], "d long")
    assert [r[0] for r in depths.select(observe.buffer_percent(F.col("d"), 1500)).collect()] == [100, 0, 50, 50, 51]


def test_bloom_positions(spark):
    import hashlib

    number = lambda s: int(hashlib.sha256(s.encode()).hexdigest(), 16)
    items = ["", "tenant_1", "é🙂", "x" * 300]
    got = spark.createDataFrame([(i,) for i in items], "i string").select(bloom_positions(F.col("i"), 9585058, 6)).collect()
    assert [list(r[0]) for r in got] == [[(number(i) + k * number(i + ":salt")) % 9585058 for k in range(6)] for i in items]


def test_result_map_holds_the_last_result_of_each_id(spark):
    df = log(spark, [("a", 1, 0), ("a", 1, 0), ("b", -1, 0)])
    rows = ingest.outcomes(ingest.shed(ingest.validated(df), F.lit(0)), ["offset"])
    got = ingest.result_maps(rows, ["partition"], ["offset"]).first().results
    assert {k: tuple(v) for k, v in got.items()} == {"a": ("a", True, "DUPLICATE_EVENT", "Event already acknowledged (idempotent)"), "b": ("b", False, "INVALID_SCHEMA", "Event does not fit the schema")}


def test_pipeline_status(spark):
    lags = spark.createDataFrame([(0, 7), (1, 5)], "partition int, lag long")
    outcome = spark.createDataFrame([("LOW_PRIORITY_SHED",), ("OK",)], "outcome string")
    box = spark.createDataFrame([(1, None), (2, T0)], "id long, published_at timestamp_ntz")
    status = observe.pipeline_status(lags, outcome, spark.range(3), box, F.lit(T0).cast("timestamp_ntz"), 10, 20)
    assert tuple(status.first()) == ("healthy", T0, 12, 10, 20, 60, 1, 3, 1)
    assert tuple(observe.health(status).first()) == ("healthy", 12, T0) and tuple(observe.metrics(status).first()) == (12, 1, 3)
    assert observe.pipeline_status(lags.where("false"), outcome.where("false"), spark.range(0), box.where("false"), F.lit(T0).cast("timestamp_ntz")).first().buffer_depth == 0


def test_unknown_lag_is_unsettled(spark):
    rows = windows.classified(log(spark, [("a", 5, 0), ("end", 0, 200)]), 60, 30)
    pending = spark.createDataFrame([], "tenant_id string, metric string, window_start timestamp_ntz, pending long")
    none = spark.createDataFrame([], "partition int, lag long")
    got = reconcile.reconciled(reconcile.recomputed(rows), reconcile.recomputed(rows), rows.where("is_late"), windows.final_watermarks(rows, 30), none, pending).orderBy("window_start").first()
    assert (got.divergence_class, got.gate_reason) == ("UNSETTLED", "CONSUMER_LAG") and "lag is unknown" in got.evidence


@pytest.mark.parametrize("chunk", [1, 3, 100_000])
def test_corrections_do_not_depend_on_chunks(spark, chunk):
    rows = windows.classified(log(spark, [("a", 100, 10), ("b", 50, 120)] + [(f"l{i}", i, 20 + i) for i in range(9)]), 60, 30)
    got = aggregates.corrections(rows, aggregates.sealed(rows), chunk).orderBy("revision").collect()
    assert [(r.revision, int(r.quantity), r.event_count) for r in got] == [(k + 1, 100 + sum(range(k + 1)), k + 2) for k in range(9)]


def test_webhook(spark):
    import http.server
    import json
    import threading

    seen = []

    class Sink(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["X-Idempotency-Key"], body))
            self.send_response(int(body["payload"]["code"]))
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Sink)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    messages = spark.createDataFrame([(i, f"k{i}", json.dumps({"code": c})) for i, c in enumerate((200, 201, 202, 204, 400, 500))], "id long, aggregate_key string, payload string")
    got = {r.id: r.delivered for r in outbox.webhook(messages, f"http://127.0.0.1:{server.server_port}/").collect()}
    server.shutdown()
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False}
    assert sorted(seen, key=str)[0] == ("k0", {"aggregate_key": "k0", "payload": {"code": 200}})
    assert {r.delivered for r in outbox.webhook(messages, f"http://127.0.0.1:{server.server_port}/", 1.0).collect()} == {False}
    assert {r.delivered for r in outbox.memory_sink(messages, failing=True).collect()} == {False}


def test_stored_tables(spark, tmp_path):
    for _ in range(2):  # the second time changes nothing
        usage.bootstrap(spark, "metering_test", str(tmp_path))
    assert {t.name for t in spark.catalog.listTables("metering_test")} == set(usage.SCHEMAS)
    assert spark.table("metering_test.aggregates").columns == ["tenant_id", "metric", "window_start", "window_end", "quantity", "event_count", "revision", "sealed_at", "computed_at"]
    spark.sql("DROP DATABASE metering_test CASCADE")


def test_synthetic_source_is_deterministic(spark):
    a, b = (usage.synthetic(spark, 500).select("event_id", "tenant_id", "quantity").collect() for _ in range(2))
    assert a == b and sum(r.tenant_id == "tenant_0" for r in a) > 300


def test_sliding_usage_by_running_sums(spark):
    """At the edges of the reach, with ties, nulls and events before 1970; and no frame that would be added up anew for each event."""
    spread = [T0 + timedelta(seconds=(i * i * 37) % 400) for i in range(150)] + [datetime(1969, 12, 31, 23, 59, 30), datetime(1970, 1, 1, 0, 0, 20)] + [None] * 3
    rows = [(str(i), "t" if i % 5 else "u", "m", None if i % 11 == 0 else Decimal(i), at) for i, at in enumerate(spread)]
    got = quota.sliding_usage(spark.createDataFrame(rows, "event_id string, tenant_id string, metric string, quantity decimal(38,9), occurred_at timestamp_ntz"), 50)
    want = {}
    for i, tenant, _, _, at in rows:
        reach = [q for _, u, _, q, then in rows if u == tenant and q is not None and (then is None if at is None else then is not None and at - timedelta(seconds=50) <= then <= at)]
        want[i] = sum(reach) if reach else None
    assert {r.event_id: r.trailing_quantity for r in got.collect()} == want
    assert "specifiedwindowframe(RangeFrame, -INTERVAL" not in got._jdf.queryExecution().toString()
