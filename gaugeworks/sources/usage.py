"""Usage events: schemas, the partitioned log, codecs and generators.

Times are UTC in TIMESTAMP_NTZ columns, so no session time zone can shift them.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

MONEY = T.DecimalType(38, 9)

USAGE_EVENT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("tenant_id", T.StringType()), T.StructField("metric", T.StringType()), T.StructField("quantity", MONEY),
    T.StructField("occurred_at", T.TimestampNTZType()), T.StructField("received_at", T.TimestampNTZType()), T.StructField("idempotency_key", T.StringType()), T.StructField("priority", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
#: Microseconds survive the wire.
WIRE_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Declared schemas of what is stored.
SCHEMAS = {
    "tenants": "tenant_id STRING NOT NULL, plan STRING NOT NULL, quotas MAP<STRING, DECIMAL(38,9)> NOT NULL, created_at TIMESTAMP_NTZ NOT NULL",
    "aggregates": "tenant_id STRING NOT NULL, metric STRING NOT NULL, window_start TIMESTAMP_NTZ NOT NULL, window_end TIMESTAMP_NTZ NOT NULL, quantity DECIMAL(38,9) NOT NULL, event_count BIGINT NOT NULL, revision INT NOT NULL, sealed_at TIMESTAMP_NTZ, computed_at TIMESTAMP_NTZ NOT NULL",
    "processed_events": "event_id STRING NOT NULL, tenant_id STRING NOT NULL, processed_at TIMESTAMP_NTZ NOT NULL",
    "outbox": "id BIGINT NOT NULL, aggregate_key STRING NOT NULL, payload STRING NOT NULL, created_at TIMESTAMP_NTZ NOT NULL, published_at TIMESTAMP_NTZ, attempts INT NOT NULL",
    "checkpoints": "consumer STRING NOT NULL, `partition` INT NOT NULL, `offset` BIGINT NOT NULL, state STRING NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL",
    "late_arrivals": "event_id STRING NOT NULL, tenant_id STRING NOT NULL, metric STRING NOT NULL, window_start TIMESTAMP_NTZ NOT NULL, quantity DECIMAL(38,9) NOT NULL, lateness_ms BIGINT NOT NULL, occurred_at TIMESTAMP_NTZ NOT NULL, received_at TIMESTAMP_NTZ NOT NULL",
}


def bootstrap(spark: SparkSession, database: str, path: str) -> None:
    """Create the stored tables under `path`, where they don't exist yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, schema in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({schema}) USING parquet LOCATION '{path.rstrip('/')}/{name}'")


LOG_RECORD = T.StructType([T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), *USAGE_EVENT.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, by: list, order: list, name: str = "offset", start: int = 0) -> DataFrame:
    """Append-order numbers within each log partition."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1 + F.lit(start).cast("long"))


def numbered_in_chunks(df: DataFrame, by: list, chunk: Column, order: list, name: str = "offset", start: int = 0) -> DataFrame:
    """The same where `chunk` never falls in the order given: rows are numbered within a chunk, and each chunk
    starts after the rows of the chunks before it, so a large log partition is many tasks."""
    rows = df.withColumn("__chunk", chunk)
    sizes = rows.groupBy(*by, "__chunk").agg(F.count("*").alias("__n"))  # a row a chunk
    before = sizes.select(*by, "__chunk", (F.sum("__n").over(Window.partitionBy(*by).orderBy("__chunk")) - F.col("__n")).alias("__before"))
    inner = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "__chunk").orderBy(*order)))
    return inner.join(before, [*by, "__chunk"]).withColumn(name, F.col("__before") + F.col("__rn") - 1 + F.lit(start).cast("long")).drop("__chunk", "__before", "__rn")


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows dealt out by ranges of the order and sorted, written once: __part is the range, __place the place in it from 0. A hot group is many ranges."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    return placed.withColumn("__part", F.shiftright("__place", 33)).withColumn("__place", F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)))


def numbered_globally(df: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """start, start + 1, ... over all rows in the order given, which no two rows may share if the numbers are to be the same in each run.

    A row's number is its place in its range after the rows of the ranges before. Only a count for each range comes to the driver.
    """
    placed = ranged(df, order)
    starts, before = [], start
    for r in sorted(placed.groupBy("__part").agg(F.count("*").alias("n")).collect()):  # a row a range
        starts.append((r["__part"], before))
        before += r.n
    firsts = F.broadcast(df.sparkSession.createDataFrame(starts, "__part long, __before long"))
    return placed.join(firsts, "__part").withColumn(name, F.col("__before") + F.col("__place")).drop("__part", "__before", "__place")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without one makes its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='gaugeworks-')}"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def write_table(df: DataFrame) -> str:
    """Write `df` as a Parquet table in the folder that all executors share; it goes with the session. Returns its path."""
    sc = df.sparkSession.sparkContext
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """`df` from a table written once, for what several parts of a query read."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At-least-once deliveries made from `events`: delays for late rows, every 50th event twice."""
    e = table(spark, sf_dir, "events")
    late = F.when(F.col("event_id") % 20 == 0, F.expr("INTERVAL '2' DAY")).when(F.col("event_id") % 7 == 0, F.expr("INTERVAL '0 02' DAY TO HOUR")).otherwise(F.expr("INTERVAL '0' DAY"))
    first = e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("seq"), F.concat(F.lit("tenant_"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"), F.col("event_type").alias("metric"),
        F.col("value").cast("decimal(18,2)").cast(MONEY).alias("quantity"), F.col("ts").cast("timestamp_ntz").alias("occurred_at"), (F.col("ts").cast("timestamp_ntz") + late).alias("received_at"),
        F.lit(None).cast("string").alias("idempotency_key"), F.when(F.col("event_type") == "view", "low").otherwise("high").alias("priority"), F.create_map(F.lit("props"), F.col("props")).alias("metadata"),
        (F.col("user_id") % 10 % 4).cast("int").alias("partition"), F.lit(0).alias("redelivery"),
    )
    again = first.where(F.col("seq") % 50 == 0).withColumn("received_at", F.col("received_at") + F.expr("INTERVAL '10' MINUTE")).withColumn("redelivery", F.lit(1))
    return first.unionByName(again)


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_in_chunks(deliveries(spark, sf_dir), ["partition"], F.to_date("received_at"), ["received_at", "seq", "redelivery"])


def tenants(spark: SparkSession) -> DataFrame:
    """tenant_0 to tenant_8 (tenant_9 is unknown on purpose): plan and quotas; `error` has none."""
    n = F.col("id")
    limit = F.element_at(F.array(*(F.lit(x).cast(MONEY) for x in (1000, 50000, 1000000))), (n % 3 + 1).cast("int"))
    quotas = F.map_from_arrays(F.array(*(F.lit(m) for m in ("signup", "purchase", "view", "click"))), F.array(limit, limit, limit, limit))
    plan = F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("enterprise")), (n % 3 + 1).cast("int"))
    return spark.range(9).select(F.concat(F.lit("tenant_"), n.cast("string")).alias("tenant_id"), plan.alias("plan"), quotas.alias("quotas"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("created_at"))


def to_json(df: DataFrame) -> DataFrame:
    """Wire form: key and JSON value, the quantity as text so that no digit is lost."""
    body = F.struct(*(F.col(f.name).cast("string").alias(f.name) if f.name == "quantity" else F.col(f.name) for f in USAGE_EVENT.fields))
    return df.select(F.col("tenant_id").alias("key"), F.to_json(body, WIRE_TIMES).alias("value"))


def from_json(value: Column) -> Column:
    wire = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "quantity" else f for f in USAGE_EVENT.fields])
    return F.from_json(value, wire, WIRE_TIMES)


def decoded(df: DataFrame, value: str = "value") -> DataFrame:
    rows = df.withColumn("__e", from_json(F.col(value)))
    return rows.select(*(F.col(f"__e.{f.name}").cast(f.dataType).alias(f.name) for f in USAGE_EVENT.fields))


def kafka_source(spark: SparkSession, servers: str, topic: str, starting_offsets: str = "earliest") -> DataFrame:
    """Streaming log reader (needs the Kafka connector on the classpath)."""
    return records(spark.readStream.format("kafka").options(**kafka_options(servers, topic, starting_offsets)).load())


def kafka_options(servers: str, topic: str, starting_offsets: str = "earliest") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting_offsets}


def starting_offsets(topic: str, offsets: dict[int, int]) -> str:
    """Where to go on from, in the connector's form: the next offset of each partition."""
    return json.dumps({topic: {str(p): n for p, n in sorted(offsets.items())}})


def records(raw: DataFrame) -> DataFrame:
    """Log records from the connector's rows (key, value, partition, offset)."""
    body = raw.select("partition", "offset", from_json(F.col("value").cast("string")).alias("e"))
    return body.select("partition", "offset", *(F.col(f"e.{f.name}").cast(f.dataType).alias(f.name) for f in USAGE_EVENT.fields))


def kafka_sink_options(servers: str, topic: str, checkpoint: str) -> dict[str, str]:
    """All replicas acknowledge, and a retried send is written once."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint, "kafka.acks": "all", "kafka.enable.idempotence": "true"}


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Streaming log writer (needs the Kafka connector on the classpath): rows keyed by tenant."""
    return to_json(df).writeStream.format("kafka").options(**kafka_sink_options(servers, topic, checkpoint))


def file_source(spark: SparkSession, path: str, schema: T.StructType = LOG_RECORD, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def uniform(n: Column, salt: int) -> Column:
    """A number in [0, 1) from a whole number, by 32-bit integer steps that any SQL has."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    x = low(F.pmod(n, F.lit(1 << 31)) * F.lit(1_640_531_527) + F.lit(salt * 374_761_393))
    x = low(x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(1_540_483_477))
    x = x.bitwiseXOR(F.shiftright(x, 13))
    return (x % 1_000_000) / 1_000_000


def synthetic(spark: SparkSession, n: int, tenant_count: int = 10, hot_share: float = 0.8, late_share: float = 0.05, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """Deterministic events: a hot tenant, whole quantities from 1 to 10, some late."""
    u = lambda salt: uniform(F.col("id"), salt)
    tenant = F.when(u(1) < hot_share, F.lit(0)).otherwise(1 + F.floor(u(2) * (tenant_count - 1)))
    at = F.expr(f"TIMESTAMP_NTZ'{start}'") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))
    delay = F.when(u(3) < late_share, 120).otherwise(0)
    return spark.range(n).select(
        F.concat(F.lit("event_"), F.col("id").cast("string")).alias("event_id"), F.concat(F.lit("tenant_"), tenant.cast("string")).alias("tenant_id"), F.lit("api_calls").alias("metric"), (1 + F.floor(u(4) * 10)).cast(MONEY).alias("quantity"),
        at.alias("occurred_at"), (at + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))).alias("received_at"), F.lit(None).cast("string").alias("idempotency_key"), F.lit("high").alias("priority"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("metadata"),
    )
