"""Results must not depend on where micro-batches are cut, nor on restarts."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import aggregates, dedup, windows
from gaugeworks.sources import usage
from gaugeworks.streaming.micro_batches import MeteringStream

DAY, HOUR = 86_400, 3_600


@pytest.fixture(scope="module")
def log(spark):
    return usage.usage_log(spark, "/root/testdata/sf0.001").drop("seq", "redelivery").cache()


def revisions(df):
    return sorted((r.tenant_id, r.metric, r.window_start, r.revision, r.quantity, r.event_count, r.sealed_at) for r in df.collect())


@pytest.fixture(scope="module")
def expected(log):
    unique = dedup.first_occurrences(log, order=("partition", "offset"))
    return revisions(aggregates.revisions(windows.classified(unique, DAY, HOUR)))


@pytest.mark.parametrize("cuts", [[], [40], [15, 100, 180]])
def test_cuts(spark, log, expected, tmp_path, cuts):
    stream = MeteringStream(spark, str(tmp_path), DAY, HOUR)
    edges = [0, *cuts, 1 << 40]
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        part = log.where((F.col("offset") >= a) & (F.col("offset") < b))
        stream.process(part, n)
        if n == 1:
            stream.process(part, n)  # a batch that is tried again
    assert revisions(stream.revisions()) == expected


def test_ids_are_kept_for_a_time(spark, log, tmp_path):
    """Within the time kept a repeated id counts once; after it, it is new. Only the days within reach are read."""
    stream = MeteringStream(spark, str(tmp_path), DAY, HOUR, keep_seconds=2 * DAY)
    one = log.where("offset < 3")
    later = lambda days: one.withColumn("received_at", F.col("received_at") + F.make_dt_interval(days=F.lit(days))).withColumn("offset", F.col("offset") + 1000 * days)
    stream.process(one, 0)
    n = one.select("event_id").distinct().count()
    for batch, days, new in ((1, 1, 0), (2, 40, n)):
        stream.process(later(days), batch)
        assert spark.read.parquet(f"{tmp_path}/processed").where(F.col("batch") == batch).count() == new


def test_rows_of_the_log_connector(spark, log, expected, tmp_path):
    """The wire form as the connector's rows (key, value, partition, offset), from files in its place."""
    import json

    record = [f.name for f in usage.LOG_RECORD.fields]
    sent = log.select("partition", "offset", F.col("tenant_id").alias("__key"), F.struct(*(F.col(c).cast("string").alias(c) if c == "quantity" else F.col(c) for c in record[2:])).alias("e"))
    raw = sent.select(F.col("__key").cast("binary").alias("key"), F.to_json("e", usage.WIRE_TIMES).cast("binary").alias("value"), "partition", "offset")
    assert [r.value for r in raw.orderBy("partition", "offset").select(F.col("value").cast("string").alias("value")).limit(5).collect()] == [r.value for r in usage.to_json(log.orderBy("partition", "offset")).limit(5).collect()]
    raw.coalesce(1).write.parquet(str(tmp_path / "topic"))
    stream = MeteringStream(spark, str(tmp_path / "out"), DAY, HOUR)
    rows = usage.records(usage.file_source(spark, str(tmp_path / "topic"), raw.schema))
    query = stream.start(rows)
    query.awaitTermination(300)
    assert query.exception() is None and revisions(stream.revisions()) == expected
    assert json.loads(usage.starting_offsets("usage", {1: 7, 0: 3})) == {"usage": {"0": 3, "1": 7}}
    assert usage.kafka_options("h:1", "usage") == {"kafka.bootstrap.servers": "h:1", "subscribe": "usage", "startingOffsets": "earliest"}


def test_restart(spark, log, expected, tmp_path):
    files, out = str(tmp_path / "in"), str(tmp_path / "out")
    record = [f.name for f in usage.LOG_RECORD.fields]
    for a, b in ((0, 60), (60, 1 << 40)):
        log.where((F.col("offset") >= a) & (F.col("offset") < b)).select(*record).coalesce(1).write.mode("append").parquet(files)
        stream = MeteringStream(spark, out, DAY, HOUR)
        query = stream.start(usage.file_source(spark, files))
        query.awaitTermination(300)
        assert query.exception() is None
    assert revisions(stream.revisions()) == expected
