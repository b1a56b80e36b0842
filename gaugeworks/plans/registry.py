"""Queries and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gaugeworks.functions.scalar import bloom_positions, bloom_size, key_partition
from gaugeworks.operators import aggregates, dedup, ingest, observe, outbox, quota, reconcile, windows
from gaugeworks.plans.flow import CUT, LATENESS, NOW, RANGE, WINDOW, Flow, at
from gaugeworks.sources import usage

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: Common tables of the SQL, each on top of the ones before it.
CTES = {
    "raw": """SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS seq, 'tenant_' || (user_id % 10) AS tenant_id, event_type AS metric,
        CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(38,9)) AS quantity, ts AS occurred_at,
        ts + CASE WHEN event_id % 20 = 0 THEN INTERVAL 2 DAY WHEN event_id % 7 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS received_at,
        CASE WHEN event_type = 'view' THEN 'low' ELSE 'high' END AS priority, CAST(user_id % 10 % 4 AS INTEGER) AS "partition", 0 AS redelivery FROM events""",
    "sent": """SELECT * FROM raw UNION ALL SELECT * REPLACE (received_at + INTERVAL 10 MINUTE AS received_at, 1 AS redelivery) FROM raw WHERE seq % 50 = 0""",
    "log": """SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY received_at, seq, redelivery) - 1 AS "offset" FROM sent""",
    "uniq": """SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at, "partition", "offset") = 1""",
    "prog": """SELECT *, window_start + INTERVAL 1 DAY AS window_end, watermark >= window_start + INTERVAL 1 DAY AS is_late FROM (SELECT *, date_trunc('day', occurred_at)::TIMESTAMP AS window_start,
        max(occurred_at) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING) - INTERVAL 1 HOUR AS watermark FROM uniq)""",
    "marks": """SELECT "partition", max(occurred_at) - INTERVAL 1 HOUR AS watermark FROM uniq GROUP BY 1""",
    "rev0": """SELECT o.*, 0 AS revision, (SELECT min(p.watermark) FROM prog p WHERE p."partition" = o."partition" AND p.watermark >= o.window_end) AS sealed_at
        FROM (SELECT tenant_id, metric, "partition", window_start, window_end, sum(quantity) AS quantity, count(*) AS event_count FROM prog WHERE NOT is_late GROUP BY ALL) o
        JOIN marks m ON m."partition" = o."partition" AND m.watermark >= o.window_end""",
    "corr": """SELECT p.tenant_id, p.metric, p."partition", p.window_start, p.window_end,
        CAST(coalesce(b.quantity, 0) + sum(p.quantity) OVER w AS DECIMAL(38,9)) AS quantity, coalesce(b.event_count, 0) + count(*) OVER w AS event_count,
        CAST(count(*) OVER w AS INTEGER) AS revision, p.watermark AS sealed_at
        FROM prog p LEFT JOIN rev0 b USING (tenant_id, metric, window_start) WHERE p.is_late
        WINDOW w AS (PARTITION BY p.tenant_id, p.metric, p.window_start ORDER BY p."offset" ROWS UNBOUNDED PRECEDING)""",
    "revs": """SELECT tenant_id, metric, "partition", window_start, window_end, quantity, event_count, revision, sealed_at FROM rev0 UNION ALL
        SELECT tenant_id, metric, "partition", window_start, window_end, quantity, event_count, revision, sealed_at FROM corr""",
    "latest": """SELECT * FROM revs QUALIFY row_number() OVER (PARTITION BY tenant_id, metric, window_start ORDER BY revision DESC) = 1""",
    "ten": """SELECT 'tenant_' || i AS tenant_id, ['free','pro','enterprise'][i % 3 + 1] AS plan, CAST([1000,50000,1000000][i % 3 + 1] AS DECIMAL(38,9)) AS lim FROM range(9) t(i)""",
    "quotas": """SELECT tenant_id, plan, metric, lim AS "limit" FROM ten, (VALUES ('signup'), ('purchase'), ('view'), ('click')) v(metric)""",
    "cnt": """SELECT tenant_id, metric, sum(quantity) AS usage, round(sum(CAST(quantity AS DOUBLE)), 2) AS approximate_usage FROM uniq GROUP BY ALL""",
    "ends": """SELECT "partition", max("offset") + 1 AS end_offset, count(*) AS event_count FROM log GROUP BY 1""",
    "ckpt": f"""SELECT "partition", max("offset") AS "offset" FROM log WHERE received_at < TIMESTAMP '{CUT}' AND "partition" < 3 GROUP BY 1""",
    "lags": """SELECT e."partition", end_offset, c."offset" AS checkpoint, CASE WHEN c."offset" IS NULL THEN end_offset ELSE greatest(0, end_offset - c."offset" - 1) END AS lag FROM ends e LEFT JOIN ckpt c USING ("partition")""",
    "outb": """SELECT *, CASE WHEN id % 3 = 0 THEN created_at + INTERVAL 1 MINUTE END AS published_at, CAST(CASE WHEN id % 7 = 0 THEN (id // 7) % 7 ELSE 0 END AS INTEGER) AS attempts FROM (
        SELECT row_number() OVER (ORDER BY tenant_id, metric, window_start, revision) AS id,
        tenant_id || ':' || metric || ':' || strftime(window_start, '%Y-%m-%dT%H:%M:%S') || '+00:00:rev' || revision AS aggregate_key,
        tenant_id, metric, window_start, revision, quantity, event_count, sealed_at AS created_at FROM revs)""",
    "served": """SELECT * REPLACE (CASE WHEN tenant_id = 'tenant_3' AND metric = 'error' THEN CAST(quantity / 2 AS DECIMAL(38,9)) ELSE quantity END AS quantity) FROM (
        SELECT * FROM revs WHERE revision = 0 AND day(window_start) % 3 = 0 UNION ALL SELECT * FROM latest WHERE day(window_start) % 3 <> 0)""",
    "recon": """SELECT coalesce(r.tenant_id, s.tenant_id) AS tenant_id, coalesce(r.metric, s.metric) AS metric, coalesce(r.window_start, s.window_start) AS window_start,
        coalesce(r.window_end, s.window_end) AS window_end, coalesce(r."partition", s."partition") AS "partition", coalesce(r.quantity, 0)::DECIMAL(38,9) AS recomputed_quantity, coalesce(s.quantity, 0)::DECIMAL(38,9) AS served_quantity
        FROM (SELECT tenant_id, metric, "partition", window_start, window_end, sum(quantity) AS quantity FROM prog GROUP BY ALL) r FULL JOIN served s USING (tenant_id, metric, window_start)""",
    "judged": """SELECT c.*, coalesce(l.q, 0)::DECIMAL(38,9) AS late_quantity, recomputed_quantity - served_quantity AS difference,
        CASE WHEN m.watermark IS NULL OR m.watermark < c.window_end THEN 'WATERMARK_BEFORE_WINDOW_END' WHEN g.lag > 0 THEN 'CONSUMER_LAG' WHEN coalesce(o.pending, 0) > 0 THEN 'OUTBOX_PENDING' END AS gate_reason
        FROM recon c LEFT JOIN (SELECT tenant_id, metric, window_start, sum(quantity) AS q FROM prog WHERE is_late GROUP BY ALL) l USING (tenant_id, metric, window_start)
        LEFT JOIN marks m ON m."partition" = c."partition" LEFT JOIN lags g ON g."partition" = c."partition"
        LEFT JOIN (SELECT tenant_id, metric, window_start, count(*) AS pending FROM outb WHERE published_at IS NULL GROUP BY ALL) o USING (tenant_id, metric, window_start)""",
}
NAMES = list(CTES)


def with_ctes(upto: str, body: str, recursive: str = "") -> str:
    used = NAMES[: NAMES.index(upto) + 1]
    head = ",\n".join(f"{n} AS (\n{CTES[n]})" for n in used)
    return f"WITH {recursive}{head}\n{body}"


def query(upto: str | None = None, sql: str | None = None, recursive: str = ""):
    def add(f: Callable[[Flow], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Flow(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_ctes(upto, sql, recursive) if upto else sql
        return f

    return add


WIN = 'tenant_id, metric, "partition", window_start, window_end, quantity, event_count, revision, sealed_at'


# sources and sinks


@query("log", "SELECT event_id, tenant_id, metric, quantity, occurred_at, received_at, priority FROM log")
def event_json_roundtrip(x: Flow):
    return usage.decoded(usage.to_json(x.log)).select("event_id", "tenant_id", "metric", "quantity", "occurred_at", "received_at", "priority")


@query("log", 'SELECT "partition", "offset", event_id, tenant_id, received_at, redelivery FROM log')
def partitioned_log(x: Flow):
    return x.log.select("partition", "offset", "event_id", "tenant_id", "received_at", "redelivery")


@query("log", 'SELECT "partition", "offset", event_id FROM log WHERE "offset" >= CASE "partition" WHEN 0 THEN 100 WHEN 2 THEN 2000 ELSE 0 END')
def replay_from_offset(x: Flow):
    return observe.replayed_from(x.log, {0: 100, 2: 2000}).select("partition", "offset", "event_id")


@query("ends", "SELECT * FROM ends")
def end_offsets(x: Flow):
    return observe.end_offsets(x.log)


@query("revs", f"SELECT {WIN}, revision = 0 AND day(window_start) <= 10 AS is_duplicate FROM revs")
def append_guard(x: Flow):
    return aggregates.appended(x.sealed.where("day(window_start) <= 10"), x.revisions)


@query("quotas", """SELECT tenant_id, plan, TIMESTAMP '2024-01-01' AS created_at, metric, "limit" FROM quotas WHERE tenant_id < 'tenant_6'
UNION ALL SELECT 'tenant_' || i, 'custom', CASE WHEN i < 9 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-15' END, 'view', CAST(77.5 AS DECIMAL(38,9)) FROM range(6, 12) r(i)""")
def tenant_upsert(x: Flow):
    """Plan and quotas of the last change, created_at of the first row; a row for each quota."""
    limits = lambda metric, limit: F.create_map(F.lit(metric), F.lit(limit).cast(usage.MONEY))
    change = lambda plan, seq, quotas: x.spark.range(6, 12).select(F.concat(F.lit("tenant_"), F.col("id").cast("string")).alias("tenant_id"), F.lit(plan).alias("plan"), quotas.alias("quotas"), at("2024-01-15 00:00:00").alias("created_at"), F.lit(seq).cast("long").alias("seq"))
    after = observe.tenant_upsert(x.tenants, change("trial", 1, limits("click", "1")).unionByName(change("custom", 2, limits("view", "77.5"))))
    return after.select("tenant_id", "plan", "created_at", F.explode("quotas").alias("metric", "limit"))


@query("quotas", 'SELECT tenant_id, plan, metric, "limit" FROM quotas')
def tenant_list(x: Flow):
    return quota.quotas(observe.tenant_list(x.tenants))


@query("quotas", """SELECT tenant_id, plan, metric, "limit" FROM quotas WHERE tenant_id = 'tenant_4'""")
def tenant_lookup(x: Flow):
    return quota.quotas(observe.tenant(x.tenants, "tenant_4"))


@query("outb", "SELECT aggregate_key, CAST(1 + (id % 13 = 0)::INT AS BIGINT) AS delivery_count FROM outb WHERE published_at IS NOT NULL")
def sink_delivery_counts(x: Flow):
    sent = x.outbox.where("published_at IS NOT NULL")
    return outbox.delivery_counts(sent.unionByName(sent.where("id % 13 = 0")))


# projections and filters


@query("log", f"SELECT event_id, redelivery, occurred_at, TIMESTAMP '{NOW}' AS received_at FROM log")
def stamp_received(x: Flow):
    return ingest.stamped(x.log, at(NOW)).select("event_id", "redelivery", "occurred_at", "received_at")


def faulty(log: DataFrame) -> DataFrame:
    return log.withColumn("event_id", F.when(F.col("seq") % 97 == 0, " ").otherwise(F.col("event_id"))).withColumn("quantity", F.when(F.col("seq") % 89 == 0, -F.col("quantity") - 1).otherwise(F.col("quantity")).cast(usage.MONEY)).withColumn("tenant_id", F.when(F.col("seq") % 83 == 0, None).otherwise(F.col("tenant_id")))


@query("log", "SELECT seq, redelivery, CASE WHEN seq % 97 = 0 OR seq % 83 = 0 OR (seq % 89 = 0 AND quantity > -1) OR quantity < 0 AND seq % 89 <> 0 THEN 'INVALID_SCHEMA' ELSE 'OK' END AS reason_code FROM log")
def validate_events(x: Flow):
    return ingest.validated(faulty(x.log)).select("seq", "redelivery", "reason_code")


@query("log", """SELECT metric, "offset" >= 1000 AS over_high_mark, "offset" >= 1500 AND priority = 'low' AS is_shed, count(*) AS n FROM log GROUP BY ALL""")
def shed_low_priority(x: Flow):
    return ingest.shed(x.log, F.col("offset"), 1500, 1000).groupBy("metric", "over_high_mark", "is_shed").agg(F.count("*").alias("n"))


OUTCOMES = """oc AS (SELECT *, CASE WHEN bad THEN 'INVALID_SCHEMA' WHEN shed THEN 'LOW_PRIORITY_SHED' WHEN coalesce(sum((NOT bad AND NOT shed)::INT) OVER (PARTITION BY event_id ORDER BY received_at, "partition", "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'DUPLICATE_EVENT' ELSE 'OK' END AS outcome
FROM (SELECT *, quantity < 0 AS bad, "offset" >= 1500 AND priority = 'low' AS shed FROM log))"""


SAID = "CASE {0} WHEN 'OK' THEN 'Accepted for ingestion' WHEN 'DUPLICATE_EVENT' THEN 'Event already acknowledged (idempotent)' WHEN 'LOW_PRIORITY_SHED' THEN 'Event shed due to critical produce buffer saturation' ELSE 'Event does not fit the schema' END"


def judged_deliveries(x: Flow) -> DataFrame:
    return ingest.outcomes(ingest.shed(ingest.validated(x.log), F.col("offset"), 1500, 1000), ["received_at", "partition", "offset"])


@query("log", f""", {OUTCOMES} SELECT "partition", "offset", event_id, outcome, outcome IN ('OK', 'DUPLICATE_EVENT') AS accepted, {SAID.format("outcome")} AS message FROM oc""")
def ingest_outcomes(x: Flow):
    return judged_deliveries(x).select("partition", "offset", "event_id", "outcome", "accepted", "message")


@query("log", f""", {OUTCOMES}, lasts AS (SELECT "partition", "offset" // 250 AS batch, event_id, max_by(outcome, "offset") AS reason_code FROM oc GROUP BY ALL)
SELECT "partition", batch, event_id, reason_code, reason_code IN ('OK', 'DUPLICATE_EVENT') AS accepted, {SAID.format("reason_code")} AS message FROM lasts""")
def ingest_results(x: Flow):
    """The maps of results by event id, a row for each entry."""
    rows = judged_deliveries(x).withColumn("batch", F.floor(F.col("offset") / 250))
    entries = ingest.result_maps(rows, ["partition", "batch"], ["offset"]).select("partition", "batch", F.explode("results").alias("event_id", "r"))
    return entries.select("partition", "batch", "event_id", "r.reason_code", "r.accepted", "r.message")


@query("log", f""", {OUTCOMES}, lasts AS (SELECT "partition", "offset" // 250 AS batch, event_id, max_by(outcome, "offset") AS o, count_if(outcome IN ('OK', 'DUPLICATE_EVENT')) AS a, count_if(outcome NOT IN ('OK', 'DUPLICATE_EVENT')) AS r FROM oc GROUP BY ALL)
SELECT "partition", batch, CAST(sum(a) AS BIGINT) AS accepted_count, CAST(sum(r) AS BIGINT) AS rejected_count, count(*) AS result_count, CAST(count_if(o = 'DUPLICATE_EVENT') AS BIGINT) AS duplicate_results FROM lasts GROUP BY ALL""")
def ingest_batches(x: Flow):
    rows = judged_deliveries(x).withColumn("batch", F.floor(F.col("offset") / 250))
    return ingest.response(rows, ["partition", "batch"], ["offset"])


@query("log", """SELECT tenant_id, CASE WHEN tenant_id IN ('tenant_1', 'tenant_7') THEN 'usage-events-hot' ELSE 'usage-events' END AS topic, count(*) AS n FROM log GROUP BY ALL""")
def route_hot(x: Flow):
    return ingest.routed(x.log, ["tenant_1", "tenant_7"]).groupBy("tenant_id", "topic").agg(F.count("*").alias("n"))


@query("log", """, bit AS (SELECT tenant_id, 0 AS b, CAST(4294967295 AS BIGINT) AS crc FROM (SELECT DISTINCT tenant_id FROM log)
UNION ALL SELECT tenant_id, b + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END FROM (SELECT tenant_id, b, CASE WHEN b % 8 = 0 THEN xor(crc, ascii(substr(tenant_id, b // 8 + 1, 1))::BIGINT) ELSE crc END AS c FROM bit WHERE b < 8 * length(tenant_id)))
SELECT tenant_id, CAST(xor(crc, 4294967295::BIGINT) % 8 AS INTEGER) AS "partition" FROM bit WHERE b = 8 * length(tenant_id)""", "RECURSIVE ")
def partition_for_key(x: Flow):
    return x.log.select("tenant_id").distinct().withColumn("partition", key_partition(F.col("tenant_id"), 8))


@query("prog", "SELECT event_id, occurred_at, window_start, window_end FROM prog")
def window_assign(x: Flow):
    return windows.assigned(x.unique, WINDOW).select("event_id", "occurred_at", "window_start", "window_end")


@query("prog", "SELECT event_id, tenant_id, metric, window_start, quantity, CAST(floor(date_diff('microsecond', occurred_at, window_end) / 1000) AS BIGINT) AS lateness_ms, CAST(floor(date_diff('microsecond', window_end, watermark) / 1000) AS BIGINT) AS watermark_lateness_ms, occurred_at, received_at FROM prog WHERE is_late")
def late_arrivals(x: Flow):
    return windows.late_arrivals(x.rows)


@query("latest", f"SELECT tenant_id, metric, window_start, quantity, revision FROM latest WHERE window_start >= TIMESTAMP '{RANGE[0]}' AND window_end <= TIMESTAMP '{RANGE[1]}'")
def usage_range(x: Flow):
    return aggregates.within(x.latest, at(RANGE[0]), at(RANGE[1])).select("tenant_id", "metric", "window_start", "quantity", "revision").orderBy("window_start", "tenant_id", "metric")


@query("outb", "SELECT id, aggregate_key, quantity, created_at, attempts FROM outb WHERE published_at IS NULL AND attempts < 5 ORDER BY id LIMIT 100")
def outbox_unpublished(x: Flow):
    return outbox.unpublished(x.outbox).select("id", "aggregate_key", "quantity", "created_at", "attempts")


@query("outb", "SELECT CAST(count_if(published_at IS NOT NULL) AS BIGINT) AS published, CAST(count_if(published_at IS NULL AND attempts < 5) AS BIGINT) AS pending, CAST(count_if(published_at IS NULL AND attempts >= 5) AS BIGINT) AS dead_letters, count(*) AS total FROM outb")
def outbox_status(x: Flow):
    return outbox.status(x.outbox)


@query("latest", f"""SELECT tenant_id, metric, window_start, revision, CASE WHEN revision > 0 THEN 'CORRECTED' ELSE 'SEALED' END AS status FROM latest
UNION ALL SELECT o.tenant_id, o.metric, o.window_start, 0, CASE WHEN o.window_end <= TIMESTAMP '{NOW}' THEN 'SEALING' ELSE 'OPEN' END FROM (SELECT DISTINCT tenant_id, metric, "partition", window_start, window_end FROM prog WHERE NOT is_late) o JOIN marks m ON m."partition" = o."partition" AND m.watermark < o.window_end""")
def window_status(x: Flow):
    unsealed = aggregates.open_windows(x.kept, x.watermarks).withColumn("revision", F.lit(0)).withColumn("sealed_at", F.lit(None).cast("timestamp_ntz"))
    return windows.status(x.latest.unionByName(unsealed), at(NOW)).select("tenant_id", "metric", "window_start", "revision", "status")


# joins


@query("uniq", f"SELECT event_id, tenant_id, metric, quantity FROM uniq WHERE received_at >= TIMESTAMP '{CUT}'")
def dedup_against_processed(x: Flow):
    return dedup.unprocessed(x.unique, x.log.where(F.col("received_at") < at(CUT)).select("event_id").distinct()).select("event_id", "tenant_id", "metric", "quantity")


@query("cnt", """SELECT c.tenant_id, c.metric, c.usage AS current_usage, l AS "limit", coalesce(c.usage + 100 <= l, true) AS allowed, CASE WHEN coalesce(c.usage + 100 <= l, true) THEN 'OK' ELSE 'QUOTA_EXCEEDED' END AS reason_code
FROM (SELECT c.*, CASE WHEN t.tenant_id IS NULL THEN CAST(1000000 AS DECIMAL(38,9)) ELSE q."limit" END AS l FROM cnt c LEFT JOIN ten t USING (tenant_id) LEFT JOIN quotas q USING (tenant_id, metric)) c""".replace("SELECT c.tenant_id", f"SELECT TIMESTAMP '{NOW}' AS as_of, true AS approximate, c.tenant_id"))
def quota_check(x: Flow):
    return quota.checked(x.usage, x.tenants, 100, at(NOW))


DRIFT = """SELECT tenant_id, metric, approximate, exact, CAST(abs(approximate - exact) AS DECIMAL(38,9)) AS drift, CASE WHEN exact = 0 THEN CASE WHEN approximate = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END ELSE round(CAST(abs(approximate - exact) AS DOUBLE) / CAST(exact AS DOUBLE) * 100, 6) END AS drift_percent
FROM (SELECT coalesce(c.tenant_id, e.tenant_id) AS tenant_id, coalesce(c.metric, e.metric) AS metric, coalesce(usage, 0)::DECIMAL(38,9) AS approximate, coalesce(quantity, 0)::DECIMAL(38,9) AS exact FROM cnt c FULL JOIN e USING (tenant_id, metric))"""


@query("cnt", f", e AS (SELECT tenant_id, metric, quantity FROM latest WHERE window_start = TIMESTAMP '2024-01-10') {DRIFT}")
def drift_window(x: Flow):
    return quota.drift(x.usage, x.latest.where(F.col("window_start") == at("2024-01-10 00:00:00")))


@query("cnt", f", e AS (SELECT tenant_id, metric, sum(quantity) AS quantity FROM latest GROUP BY ALL) {DRIFT}")
def drift_range(x: Flow):
    return quota.drift(x.usage, aggregates.totals(x.latest, ["tenant_id", "metric"]))


@query("cnt", f"""SELECT q.tenant_id, q.plan, q.metric, q."limit", coalesce(c.usage, 0)::DECIMAL(38,9) AS approximate_usage, coalesce(e.quantity, 0)::DECIMAL(38,9) AS exact_usage,
CASE WHEN coalesce(e.quantity, 0) > 0 THEN round_even(CAST(abs(coalesce(c.usage, 0) - e.quantity) AS DOUBLE) / CAST(e.quantity AS DOUBLE) * 100, 2) ELSE 0.0::DOUBLE END AS drift_percent
FROM quotas q LEFT JOIN cnt c USING (tenant_id, metric) LEFT JOIN (SELECT tenant_id, metric, sum(quantity) AS quantity FROM latest WHERE window_start >= TIMESTAMP '{RANGE[0]}' AND window_end <= TIMESTAMP '{RANGE[1]}' GROUP BY ALL) e USING (tenant_id, metric)""")
def tenant_overview(x: Flow):
    return quota.overview(x.tenants, x.usage, aggregates.totals(aggregates.within(x.latest, at(RANGE[0]), at(RANGE[1])), ["tenant_id", "metric"]))


@query("corr", f"SELECT {WIN} FROM corr")
def revisions(x: Flow):
    return x.corrections


def audited(x: Flow, gated: bool = True) -> DataFrame:
    x = x.stored()
    return reconcile.reconciled(reconcile.recomputed(x.rows), x.served, x.rows.where("is_late"), x.watermarks, x.lags, outbox.pending(x.outbox), gated)


def judged(x: Flow, gated: bool) -> DataFrame:
    return audited(x, gated).select("tenant_id", "metric", "window_start", "recomputed_quantity", "served_quantity", "late_quantity", "difference", "gate_reason", "divergence_class")


VERDICT = "CASE WHEN difference = 0 THEN 'MATCH' WHEN abs(difference) = late_quantity THEN 'LATE_ARRIVAL' ELSE 'REAL' END"


@query("judged", f"SELECT tenant_id, metric, window_start, recomputed_quantity, served_quantity, late_quantity, difference, gate_reason, CASE WHEN gate_reason IS NOT NULL THEN 'UNSETTLED' ELSE {VERDICT} END AS divergence_class FROM judged")
def reconcile_gated(x: Flow):
    return judged(x, True)


@query("judged", f"SELECT tenant_id, metric, window_start, recomputed_quantity, served_quantity, late_quantity, difference, CAST(NULL AS VARCHAR) AS gate_reason, {VERDICT} AS divergence_class FROM judged")
def reconcile_ungated(x: Flow):
    return judged(x, False)


ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({0}, '%f') = '000000' THEN '' ELSE '.' || strftime({0}, '%f') END || '+00:00'"


@query("judged", f"""SELECT tenant_id, metric, window_start, CASE gate_reason
WHEN 'WATERMARK_BEFORE_WINDOW_END' THEN 'Gated out: Watermark (' || coalesce({ISO.format("m.watermark")}, 'unknown') || ') has not yet passed window_end (' || {ISO.format("window_end")} || ')'
WHEN 'CONSUMER_LAG' THEN 'Gated out: Consumer partition lag is ' || coalesce(CAST(g.lag AS VARCHAR), 'unknown') || ' (pipeline still actively processing events)'
WHEN 'OUTBOX_PENDING' THEN 'Gated out: Outbox has ' || (SELECT count(*) FROM outb o WHERE o.published_at IS NULL AND (o.tenant_id, o.metric, o.window_start) = (j.tenant_id, j.metric, j.window_start)) || ' pending messages for this window'
ELSE CASE WHEN difference = 0 THEN 'Exact match: recomputed and served quantities agree perfectly.' WHEN abs(difference) = late_quantity THEN 'Difference of ' || difference || ' matches known audited late arrivals (' || late_quantity || ').'
ELSE 'Genuine unexplained discrepancy: recomputed=' || recomputed_quantity || ', served=' || served_quantity || ', diff=' || difference || '.' END END AS evidence
FROM judged j LEFT JOIN marks m ON m."partition" = j."partition" LEFT JOIN lags g ON g."partition" = j."partition" """)
def reconcile_evidence(x: Flow):
    return audited(x).select("tenant_id", "metric", "window_start", "evidence")


@query("judged", """SELECT "partition", coalesce(gate_reason, 'SETTLED') AS reason, count(*) AS n FROM judged GROUP BY ALL""")
def completion_gate(x: Flow):
    return audited(x).groupBy("partition", F.coalesce("gate_reason", F.lit("SETTLED")).alias("reason")).agg(F.count("*").alias("n"))


@query("lags", 'SELECT "partition", end_offset, checkpoint, lag FROM lags')
def consumer_lag(x: Flow):
    return x.lags


@query("outb", f"""SELECT id, aggregate_key, CASE WHEN tried AND id % 11 <> 0 THEN TIMESTAMP '{NOW}' ELSE published_at END AS published_at, CAST(attempts + (tried AND id % 11 = 0)::INT AS INTEGER) AS attempts
FROM (SELECT *, id IN (SELECT id FROM outb WHERE published_at IS NULL AND attempts < 5 ORDER BY id LIMIT 100) AS tried FROM outb)""")
def outbox_relay(x: Flow):
    x = x.stored()
    return outbox.relayed(x.outbox, x.outbox.select("id", (F.col("id") % 11 != 0).alias("delivered")), at(NOW)).select("id", "aggregate_key", "published_at", "attempts")


# aggregations


@query("rev0", 'SELECT tenant_id, metric, window_start, window_end, quantity, event_count FROM rev0')
def window_rev0(x: Flow):
    return x.sealed.select("tenant_id", "metric", "window_start", "window_end", "quantity", "event_count")


@query("log", "SELECT tenant_id, metric, sum(quantity) AS quantity, count(*) AS event_count FROM log GROUP BY ALL")
def salted_totals(x: Flow):
    return aggregates.salted_totals(x.log, ["tenant_id", "metric"])


@query(None, "SELECT CAST(sum(CAST(0.0001 AS DECIMAL(38,9))) AS DECIMAL(38,9)) AS total, count(*) AS n FROM range(1000000)")
def exact_sum(x: Flow):
    return x.spark.range(1_000_000).agg(F.sum(F.lit("0.0001").cast(usage.MONEY)).cast(usage.MONEY).alias("total"), F.count("*").alias("n"))


@query("cnt", "SELECT * FROM cnt")
def counter_usage(x: Flow):
    return x.usage


@query("cnt", "SELECT tenant_id, metric, coalesce(e.quantity, c.usage)::DECIMAL(38,9) AS usage, e.quantity IS NOT NULL AS overridden FROM cnt c FULL JOIN (SELECT tenant_id, metric, quantity FROM latest WHERE window_start = TIMESTAMP '2024-01-10') e USING (tenant_id, metric)")
def counter_sync(x: Flow):
    return quota.synced(x.usage, x.latest.where(F.col("window_start") == at("2024-01-10 00:00:00")))


@query("latest", f"SELECT tenant_id, metric, sum(quantity) AS quantity, count(*) AS event_count FROM latest WHERE window_start >= TIMESTAMP '{RANGE[0]}' AND window_end <= TIMESTAMP '{RANGE[1]}' GROUP BY ALL")
def usage_total(x: Flow):
    return aggregates.totals(aggregates.within(x.latest, at(RANGE[0]), at(RANGE[1])), ["tenant_id", "metric"])


@query("prog", 'SELECT tenant_id, metric, window_start, window_end, "partition", sum(quantity) AS quantity, count(*) AS event_count FROM prog GROUP BY ALL')
def recompute(x: Flow):
    return reconcile.recomputed(windows.assigned(x.unique, WINDOW))


@query("prog", "SELECT tenant_id, metric, window_start, sum(quantity) AS quantity, count(*) AS event_count FROM prog WHERE is_late GROUP BY ALL")
def late_sum(x: Flow):
    return aggregates.totals(x.rows.where("is_late"), aggregates.KEY)


@query("outb", "SELECT tenant_id, metric, window_start, count(*) AS pending FROM outb WHERE published_at IS NULL GROUP BY ALL")
def outbox_pending(x: Flow):
    return outbox.pending(x.outbox)


@query("ckpt", 'SELECT "partition", "offset" FROM ckpt')
def checkpoint_offsets(x: Flow):
    return observe.checkpoints(x.consumed)


@query("uniq", 'SELECT event_id, tenant_id, metric, quantity, occurred_at, received_at, "partition", "offset" FROM uniq')
def dedup_events(x: Flow):
    return x.unique.select("event_id", "tenant_id", "metric", "quantity", "occurred_at", "received_at", "partition", "offset")


@query("log", """, s AS (SELECT tenant_id, "partition", count(*) AS n FROM log GROUP BY ALL), k AS (SELECT tenant_id, count(*) AS parts FROM s GROUP BY ALL)
SELECT "partition", CAST(sum(n) AS BIGINT) AS events, count(*) AS tenants, CAST(count_if(parts > 1) AS BIGINT) AS split_tenants FROM s JOIN k USING (tenant_id) GROUP BY ALL""")
def partition_skew(x: Flow):
    return observe.skew(x.log)


@query("uniq", """, o AS (SELECT metric, quantity, row_number() OVER (PARTITION BY metric ORDER BY quantity) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM uniq)
SELECT metric, q AS quantile, quantity AS value FROM o, (VALUES (0.5::DOUBLE), (0.99::DOUBLE), (0.999::DOUBLE), (1.0::DOUBLE)) v(q) WHERE i = least(CAST(floor(n * q) AS BIGINT), n - 1)""")
def index_percentile(x: Flow):
    return aggregates.index_percentiles(x.unique, "metric", "quantity", [0.5, 0.99, 0.999, 1.0])


@query("prog", "SELECT tenant_id, metric, window_start, CAST(grouping_id(tenant_id, metric, window_start) AS BIGINT) AS level, sum(quantity) AS quantity, count(*) AS event_count FROM prog GROUP BY ROLLUP (tenant_id, metric, window_start)")
def usage_rollup(x: Flow):
    rows = windows.assigned(x.unique, WINDOW).rollup("tenant_id", "metric", "window_start")
    return rows.agg(F.grouping_id("tenant_id", "metric", "window_start").cast("long").alias("level"), F.sum("quantity").cast(usage.MONEY).alias("quantity"), F.count("*").alias("event_count"))


# event time


@query("prog", 'SELECT "partition", "offset", event_id, occurred_at, watermark FROM prog')
def watermark_progress(x: Flow):
    return windows.progress(x.unique, LATENESS).select("partition", "offset", "event_id", "occurred_at", "watermark")


@query("prog", "SELECT event_id, window_start, watermark, is_late FROM prog")
def late_flag(x: Flow):
    return x.rows.select("event_id", "window_start", "watermark", "is_late")


@query("rev0", 'SELECT "partition", tenant_id, metric, window_start, window_end, sealed_at FROM rev0')
def window_seal(x: Flow):
    return x.sealed.select("partition", "tenant_id", "metric", "window_start", "window_end", "sealed_at")


@query("revs", f"SELECT {WIN} FROM revs")
def all_revisions(x: Flow):
    return x.revisions


@query("latest", f"SELECT {WIN} FROM latest")
def latest_revision(x: Flow):
    return x.latest


@query("revs", f"SELECT {WIN} FROM revs WHERE sealed_at <= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY tenant_id, metric, window_start ORDER BY revision DESC) = 1")
def as_of_revision(x: Flow):
    return aggregates.latest(x.revisions, at(CUT))


@query("marks", """SELECT tenant_id, metric, p."partition", window_start, window_end, sum(quantity) AS quantity, count(*) AS event_count FROM prog p JOIN marks m ON m."partition" = p."partition" AND m.watermark < window_end WHERE NOT is_late GROUP BY ALL""")
def open_windows(x: Flow):
    return aggregates.open_windows(x.rows, x.watermarks)


@query("marks", f"""SELECT "partition", watermark, CAST(greatest(0, date_diff('microsecond', watermark, TIMESTAMP '{NOW}') / 1e6) AS DOUBLE) AS lag_seconds FROM marks""")
def watermark_lag(x: Flow):
    return windows.watermark_lag(x.watermarks, at(NOW))


@query("uniq", "SELECT event_id, tenant_id, metric, occurred_at, sum(quantity) OVER (PARTITION BY tenant_id, metric ORDER BY occurred_at RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)::DECIMAL(38,9) AS trailing_quantity FROM uniq")
def sliding_usage(x: Flow):
    return quota.sliding_usage(x.unique, 2 * 86_400)


@query("uniq", """, s AS (SELECT tenant_id, make_timestamp((epoch_us(occurred_at) // 21600000000) * 21600000000 - k * 21600000000) AS window_start, quantity FROM uniq, range(2) r(k))
SELECT tenant_id, window_start, sum(quantity) AS quantity, count(*) AS event_count FROM s GROUP BY ALL""")
def sliding_windows(x: Flow):
    rows = x.unique.groupBy("tenant_id", F.window("occurred_at", "12 hours", "6 hours").alias("w")).agg(F.sum("quantity").cast(usage.MONEY).alias("quantity"), F.count("*").alias("event_count"))
    return rows.select("tenant_id", F.col("w.start").alias("window_start"), "quantity", "event_count")


@query(None, """SELECT elements, false_positives, bits, CAST(greatest(1, floor(bits / elements * ln(2))) AS INTEGER) AS hashes
FROM (SELECT *, greatest(64, CAST(floor(-elements * ln(false_positives) / power(ln(2), 2)) AS BIGINT)) AS bits FROM (VALUES (1000000::BIGINT, 0.01::DOUBLE), (100000, 0.01), (1, 0.5)) v(elements, false_positives))""")
def bloom_sizing(x: Flow):
    return x.spark.createDataFrame([(n, p, *bloom_size(n, p)) for n, p in ((1_000_000, 0.01), (100_000, 0.01), (1, 0.5))], "elements long, false_positives double, bits long, hashes int")


#: SHA-256 of ? as a number, modulo 958,505: digits in four words of 16.
REST = "0::HUGEINT"
for k in range(4):
    REST = f"(({REST}) * 18446744073709551616::HUGEINT + CAST('0x' || substr(sha256(?), {16 * k + 1}, 16) AS UBIGINT)) % 958505"


@query(None, f"""SELECT 'tenant_' || i AS item, k AS nth, CAST((one + k * two) % 958505 AS BIGINT) AS position FROM (SELECT i, {REST.replace('?', "'tenant_' || i")} AS one, {REST.replace('?', "'tenant_' || i || ':salt'")} AS two FROM range(10) t(i)), range(6) h(k)""")
def bloom_hashes(x: Flow):
    """Bits of the tenants' names in a filter of 958,505 bits and 6 hash functions."""
    items = x.spark.range(10).select(F.concat(F.lit("tenant_"), F.col("id").cast("string")).alias("item"))
    return items.select("item", F.posexplode(bloom_positions(F.col("item"), 958_505, 6)).alias("nth", "position")).select("item", F.col("nth").cast("long").alias("nth"), "position")


@query("sent", """, s AS (SELECT event_id, list(DISTINCT received_at + k * INTERVAL 20 HOUR) AS ts FROM sent, range(6) r(k) WHERE k <= seq % 6 GROUP BY 1),
acc AS (SELECT event_id, ts, list_min(ts) AS t FROM s UNION ALL SELECT event_id, ts, list_min([x FOR x IN ts IF x >= t + INTERVAL 24 HOUR]) FROM acc WHERE list_max(ts) >= t + INTERVAL 24 HOUR)
SELECT event_id, t AS accepted_at FROM acc""", "RECURSIVE ")
def dedup_ttl(x: Flow):
    seen = usage.deliveries(x.spark, x.sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("seq") % 6).cast("int"))))
    return dedup.accepted_by_ttl(seen.select("event_id", (F.col("received_at") + F.make_dt_interval(hours=F.col("k") * 20)).alias("t")), "event_id", "t", 86_400)


@query("log", 'SELECT "partition", count(*) AS deliveries, count(DISTINCT event_id) AS processed, count(*) - count(DISTINCT event_id) AS duplicates FROM log GROUP BY ALL')
def dedup_stats(x: Flow):
    return dedup.stats(x.log)


@query("ckpt", f""", u AS (SELECT * FROM uniq WHERE received_at < TIMESTAMP '{CUT}' AND "partition" < 3), m AS (SELECT "partition", max(occurred_at) AS max_occurred_at FROM u GROUP BY 1)
SELECT p.tenant_id, p.metric, p."partition", p.window_start, p.window_end, sum(p.quantity) AS quantity, count(*) AS event_count, c."offset", m.max_occurred_at FROM prog p JOIN u USING (event_id) JOIN ckpt c ON c."partition" = p."partition" JOIN m ON m."partition" = p."partition"
WHERE NOT p.is_late AND m.max_occurred_at - INTERVAL 1 HOUR < p.window_end GROUP BY ALL""")
def checkpoint_state(x: Flow):
    unique = dedup.first_occurrences(x.consumed)
    rows = windows.classified(unique, WINDOW, LATENESS)
    marks = unique.groupBy("partition").agg(F.max("occurred_at").alias("max_occurred_at"))
    return aggregates.open_windows(rows, windows.final_watermarks(unique, LATENESS)).join(observe.checkpoints(x.consumed), "partition").join(marks, "partition")


# limits and views


@query("revs", f"SELECT {WIN} FROM revs ORDER BY window_start DESC, revision DESC, tenant_id, metric LIMIT 50")
def recent_windows(x: Flow):
    return aggregates.recent(x.revisions)


@query("outb", "SELECT id, aggregate_key, published_at, attempts FROM outb ORDER BY id DESC LIMIT 50")
def recent_outbox(x: Flow):
    return outbox.recent(x.outbox).select("id", "aggregate_key", "published_at", "attempts")


@query("cnt", """SELECT c.tenant_id, c.metric, CAST(coalesce(CASE WHEN q."limit" > 0 THEN least(100, round(CAST(c.usage AS DOUBLE) / CAST(q."limit" AS DOUBLE) * 100)) END, 0) AS INTEGER) AS utilisation_percent FROM cnt c LEFT JOIN quotas q USING (tenant_id, metric)""")
def quota_utilisation(x: Flow):
    return quota.utilisation(x.usage, x.tenants)


@query("lags", f"""SELECT l."partition", l.end_offset, l.lag, CAST(coalesce(floor(greatest(0, date_diff('microsecond', m.watermark, TIMESTAMP '{NOW}')) / 1000), 0) AS BIGINT) AS watermark_lag_ms FROM lags l LEFT JOIN marks m ON m."partition" = l."partition" """)
def pipeline_overview(x: Flow):
    return observe.overview(x.lags, x.watermarks, at(NOW))


@query("outb", f"""SELECT 'healthy' AS status, TIMESTAMP '{NOW}' AS timestamp, CAST((SELECT sum(lag) FROM lags) AS BIGINT) AS buffer_depth, 10000 AS high_watermark, 15000 AS shed_watermark,
least(100, CAST(floor((SELECT sum(lag) FROM lags) / 15000 * 100 + 0.5) AS INTEGER)) AS buffer_percent, (SELECT count(*) FROM log WHERE quantity >= 0 AND "offset" >= 1500 AND priority = 'low') AS shed_count,
(SELECT count(DISTINCT event_id) FROM log WHERE received_at < TIMESTAMP '{CUT}' AND "partition" < 3) AS bloom_count, (SELECT count(*) FROM outb WHERE published_at IS NULL) AS outbox_pending""")
def pipeline_status(x: Flow):
    return observe.pipeline_status(x.lags, judged_deliveries(x), x.consumed.select("event_id").distinct(), x.outbox, at(NOW))


@query("outb", "SELECT id, aggregate_key, revision FROM outb WHERE starts_with(aggregate_key, 'tenant_2:view:2024-01-10T00:00:00:') OR starts_with(aggregate_key, 'tenant_2:view:2024-01-10T00:00:00+')")
def outbox_of_window(x: Flow):
    return outbox.of_window(x.outbox, "tenant_2", "view", "2024-01-10T00:00:00").select("id", "aggregate_key", "revision")


@query("outb", "SELECT id, aggregate_key, tenant_id, metric, window_start, revision, quantity, event_count, created_at FROM outb")
def outbox_rows(x: Flow):
    return x.messages.drop("payload")


@query("outb", "SELECT id, tenant_id, metric, quantity, event_count, revision, created_at AS sealed_at FROM outb")
def outbox_payload(x: Flow):
    """The JSON payloads, read back: amounts travel as text and keep every digit."""
    body = "tenant_id string, metric string, quantity string, event_count long, revision int, sealed_at timestamp_ntz"
    rows = x.messages.select("id", F.from_json("payload", body, usage.WIRE_TIMES).alias("p"))
    return rows.select("id", "p.tenant_id", "p.metric", F.col("p.quantity").cast(usage.MONEY).alias("quantity"), "p.event_count", "p.revision", "p.sealed_at")


@query("judged", f"SELECT tenant_id, metric, window_start, difference, CASE WHEN gate_reason IS NOT NULL THEN 'UNSETTLED' ELSE {VERDICT} END AS divergence_class FROM judged ORDER BY window_start DESC, tenant_id, metric LIMIT 50")
def reconcile_history(x: Flow):
    return judged(x, True).orderBy(F.desc("window_start"), "tenant_id", "metric").limit(50).select("tenant_id", "metric", "window_start", "difference", "divergence_class")


def sql_uniform(salt: int) -> str:
    one = f"((id % 2147483648) * 1640531527 + {salt * 374_761_393}) & 4294967295"
    two = f"(xor({one}, ({one}) >> 15) * 1540483477) & 4294967295"
    return f"(xor({two}, ({two}) >> 13) % 1000000 / 1000000)"


@query(None, f"""SELECT 'event_' || id AS event_id, 'tenant_' || CASE WHEN {sql_uniform(1)} < 0.8 THEN 0 ELSE CAST(1 + floor({sql_uniform(2)} * 9) AS BIGINT) END AS tenant_id, 'api_calls' AS metric,
CAST(1 + floor({sql_uniform(4)} * 10) AS DECIMAL(38,9)) AS quantity, TIMESTAMP '2024-01-01' + to_seconds(id) AS occurred_at, TIMESTAMP '2024-01-01' + to_seconds(id + CASE WHEN {sql_uniform(3)} < 0.05 THEN 120 ELSE 0 END) AS received_at,
CAST(NULL AS VARCHAR) AS idempotency_key, 'high' AS priority FROM range(10000) t(id)""")
def synthetic_events(x: Flow):
    return usage.synthetic(x.spark, 10_000).drop("metadata")


@query("prog", """SELECT tenant_id, metric, sum(quantity) AS raw_quantity FROM prog GROUP BY ALL""")
def conservation(x: Flow):
    """What is sealed or still open adds up to what came in."""
    both = x.latest.select("tenant_id", "metric", "quantity").unionByName(aggregates.open_windows(x.kept, x.watermarks).select("tenant_id", "metric", "quantity"))
    return both.groupBy("tenant_id", "metric").agg(F.sum("quantity").cast(usage.MONEY).alias("raw_quantity"))


from gaugeworks.plans import streams  # noqa: E402, F401  adds its own
