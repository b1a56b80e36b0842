"""Queries that run as streams over the given events, cut into batches; their SQL is that of the batch flow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gaugeworks.operators import reconcile
from gaugeworks.plans.flow import LATENESS, NOW, WINDOW, Flow, at
from gaugeworks.plans.registry import SQL, audited, query
from gaugeworks.sources import usage
from gaugeworks.streaming import keyed_state, replay
from gaugeworks.streaming.micro_batches import MeteringStream
from gaugeworks.streaming.relay import Relay
from gaugeworks.streaming.sliding import SlidingCounters

#: Where streams that several queries read have been run, by application, data set and kind.
RAN: dict[tuple[str, str, str], str] = {}
CUTS = 3


def ran(x: Flow, kind: str, run: Callable[[str], None]) -> str:
    """The folder that a stream has been run into, once a session."""
    key = (x.spark.sparkContext.applicationId, x.sf_dir, kind)
    if key not in RAN or not usage.exists(x.spark, RAN[key]):
        path = replay.folder(x.spark)
        run(path)
        RAN[key] = path
    return RAN[key]


def parts(log: DataFrame):
    """Numbers of batches: ranges of offsets that cut each log partition."""
    most = log.agg(F.max("offset")).first()[0] or 0
    return F.floor(F.col("offset") * CUTS / (most + 1))


def keyed(x: Flow, log: DataFrame, kind: str) -> str:
    """The metering operator with keyed state over a log, a part a batch, stopped and started again in between."""

    def run(path: str) -> None:
        session = keyed_state.with_rocksdb(x.spark)
        rows = usage.written(log.select("partition", "offset", "event_id", "tenant_id", "metric", "quantity", "occurred_at", "received_at"))
        out = lambda place, files: keyed_state.metering(session.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(place), WINDOW, LATENESS)
        part = parts(rows)
        for first, last in ((0, 0), (1, CUTS)):
            files = replay.cut(rows.where(part.between(first, last)), part, f"{path}/log")
            replay.drained(out(f"{path}/log", files), path)

    return ran(x, kind, run)


def keyed_output(x: Flow) -> DataFrame:
    return x.spark.read.schema(keyed_state.OUTPUT).parquet(f"{keyed(x, x.log, 'keyed')}/out")


@query("revs", 'SELECT tenant_id, metric, "partition", window_start, window_end, quantity, event_count, revision, sealed_at FROM revs')
def keyed_revisions(x: Flow):
    return keyed_state.revisions(keyed_output(x), WINDOW)


@query()
def keyed_late_arrivals(x: Flow):
    return keyed_state.late_arrivals(keyed_output(x), WINDOW)


@query()
def keyed_accounting(x: Flow):
    return keyed_state.accounting(keyed_output(x))


@query()
def restored_state(x: Flow):
    """What a metering stream stopped at the cut left in its state store."""
    path = keyed(x, x.consumed, "consumed")
    return keyed_state.restored(keyed_state.with_rocksdb(x.spark), f"{path}/checkpoint", WINDOW)


@query()
def keyed_ttl(x: Flow):
    seen = usage.deliveries(x.spark, x.sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("seq") % 6).cast("int"))))
    seen = usage.written(seen.select("event_id", (F.col("received_at") + F.make_dt_interval(hours=F.col("k") * 20)).alias("t")))

    def run(path: str) -> None:
        session = keyed_state.with_rocksdb(x.spark)
        stream = replay.streamed(session, seen, F.floor(F.dayofyear("t") / 13))
        replay.drained(keyed_state.accepted_by_ttl(stream, "event_id", "t", 86_400), path)

    return x.spark.read.parquet(f"{ran(x, 'ttl', run)}/out")


def micro_batched(x: Flow) -> MeteringStream:
    def run(path: str) -> None:
        rows = usage.written(x.log.drop("seq", "redelivery"))
        MeteringStream(x.spark, path, WINDOW, LATENESS).start(replay.streamed(x.spark, rows, parts(rows))).awaitTermination()

    return MeteringStream(x.spark, ran(x, "micro", run), WINDOW, LATENESS)


@query()
def stream_late_arrivals(x: Flow):
    return micro_batched(x).late_arrivals()


@query("outb", "SELECT aggregate_key, tenant_id, metric, window_start, revision, quantity, event_count, created_at FROM outb")
def stream_outbox(x: Flow):
    """The messages that the stream wrote, but for their numbers: those go by batches."""
    return micro_batched(x).outbox().drop("id", "payload")


@query("outb", "SELECT count(*) AS messages, CAST(1 AS BIGINT) AS first, count(*) AS last, CAST(0 AS BIGINT) AS out_of_order FROM outb")
def stream_outbox_numbers(x: Flow):
    """Numbers without gaps, each revision of a window after the one before."""
    rows = micro_batched(x).outbox()
    one, two = (rows.select("tenant_id", "metric", "window_start", (F.col("revision") + k).alias("revision"), F.col("id").alias(name)) for k, name in ((1, "before"), (0, "after")))
    wrong = one.join(two.hint("merge"), ["tenant_id", "metric", "window_start", "revision"]).agg(F.count_if(F.col("before") > F.col("after")).alias("out_of_order"))
    return rows.agg(F.count("*").alias("messages"), F.min("id").alias("first"), F.max("id").alias("last")).crossJoin(wrong)  # a row each


@query("outb", "SELECT id, aggregate_key, id % 7 < 5 AS is_published, CAST(least(id % 7, 5) AS INTEGER) AS attempts FROM outb")
def stream_relay(x: Flow):
    """Passes of the relay, each by a relay that is started anew, to a sink that fails each message as often as its number says."""
    messages = x.messages
    deliver = lambda df: df.select("id", (F.col("attempts") >= F.col("id") % 7).alias("delivered"))

    def run(path: str) -> None:
        number = 0
        while Relay(x.spark, path, lambda: messages, deliver, n=20_000).run(number):
            number += 1

    after = Relay(x.spark, ran(x, "relay", run), lambda: messages, deliver).outbox()
    return after.select("id", "aggregate_key", F.col("published_at").isNotNull().alias("is_published"), "attempts")


def sliding(x: Flow) -> SlidingCounters:
    def run(path: str) -> None:
        rows = usage.written(x.unique.select("tenant_id", "metric", "occurred_at", "quantity", "offset"))
        SlidingCounters(x.spark, path, 21_600, 2).start(replay.streamed(x.spark, rows, parts(rows))).awaitTermination()

    return SlidingCounters(x.spark, ran(x, "sliding", run), 21_600, 2)


@query("uniq", """, s AS (SELECT tenant_id, metric, make_timestamp((epoch_us(occurred_at) // 21600000000) * 21600000000 - k * 21600000000) AS window_start, quantity FROM uniq, range(2) r(k))
SELECT tenant_id, metric, window_start, sum(quantity) AS quantity, count(*) AS event_count FROM s GROUP BY ALL""")
def sliding_counters(x: Flow):
    return sliding(x).windows()


@query("quotas", """, u AS (SELECT tenant_id, metric, sum(quantity)::DECIMAL(38,9) AS usage FROM uniq WHERE occurred_at >= TIMESTAMP '2024-01-15 06:00:00' AND occurred_at < TIMESTAMP '2024-01-15 18:00:00' GROUP BY ALL)
SELECT tenant_id, metric, usage AS current_usage, l AS "limit", coalesce(usage + 900 <= l, true) AS allowed, CASE WHEN coalesce(usage + 900 <= l, true) THEN 'OK' ELSE 'QUOTA_EXCEEDED' END AS reason_code, true AS approximate
FROM (SELECT u.*, CASE WHEN t.tenant_id IS NULL THEN CAST(1000000 AS DECIMAL(38,9)) ELSE q."limit" END AS l FROM u LEFT JOIN ten t USING (tenant_id) LEFT JOIN quotas q USING (tenant_id, metric))""")
def sliding_quota(x: Flow):
    """The quota check on the twelve hours that end with the pane of 2024-01-15 17:59:59."""
    return sliding(x).checked(x.tenants, 1_705_341_599, 900, at(NOW)).drop("as_of")


@query("judged", """, runs AS (SELECT 'run-1' AS run_id, *, coalesce(gate_reason, 'SETTLED') AS reason FROM judged UNION ALL SELECT 'run-2' AS run_id, *, 'SETTLED' AS reason FROM judged)
SELECT * FROM (SELECT row_number() OVER (ORDER BY run_id, window_start, tenant_id, metric) AS sequence, run_id, tenant_id, metric, window_start, difference, CASE WHEN reason <> 'SETTLED' THEN 'UNSETTLED' WHEN difference = 0 THEN 'MATCH' WHEN abs(difference) = late_quantity THEN 'LATE_ARRIVAL' ELSE 'REAL' END AS divergence_class
FROM runs) ORDER BY sequence DESC LIMIT 500""")
def reconcile_runs(x: Flow):
    """A gated and an ungated run, the first recorded twice; the newest 500 results."""

    def run(path: str) -> None:
        history = reconcile.History(x.spark, path)
        for run_id, gated in (("run-1", True), ("run-1", True), ("run-2", False)):
            history.record(run_id, audited(x, gated))

    rows = reconcile.History(x.spark, ran(x, "runs", run)).newest(500)
    return rows.select("sequence", "run_id", "tenant_id", "metric", "window_start", "difference", "divergence_class")


SQL |= {new: SQL[old] for new, old in (("keyed_late_arrivals", "late_arrivals"), ("keyed_accounting", "dedup_stats"), ("restored_state", "checkpoint_state"), ("keyed_ttl", "dedup_ttl"), ("stream_late_arrivals", "late_arrivals"))}
