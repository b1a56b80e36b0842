"""Deduplication. The authoritative check is always made; a Bloom filter is only ever Spark's own join filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gaugeworks.sources.usage import ranged, written


def first_occurrences(log: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("received_at", "partition", "offset")) -> DataFrame:
    """The first row of each id; rn = 1 lets Spark cut each task's rows before the shuffle."""
    return log.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def unprocessed(events: DataFrame, processed: DataFrame, key: str = "event_id") -> DataFrame:
    """Ids processed grow with history, though their files look small: they never go through the driver as a broadcast."""
    return events.join(processed.select(key).hint("merge"), key, "left_anti")


def stats(log: DataFrame, key: str = "event_id") -> DataFrame:
    """Deliveries, distinct ids and duplicates by partition."""
    per = log.groupBy("partition", key).agg(F.count("*").alias("n"))
    return per.groupBy("partition").agg(F.sum("n").alias("deliveries"), F.count("*").alias("processed"), (F.sum("n") - F.count("*")).alias("duplicates"))


def next_at_or_after(points: DataFrame, key: str, at: str, ttl: Column) -> DataFrame:
    """key, at, next: of each point, the first point of the same key that comes a TTL or more after it (null if none does). No two points are alike.

    Points and the times looked for are sorted together by ranges, so a hot key is many tasks; in a range the answer is the next
    point in the order, and for what stands after the last point of its range it is the first point of a later one.
    """
    both = points.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(points.schema[at].dataType).alias("came")).unionByName(
        points.select(F.col(key).alias("k"), (F.col(at) + ttl).alias("t"), F.lit(0).alias("kind"), F.col(at).alias("came"))
    )
    placed = ranged(both, ["k", "t", "kind"])
    point = F.when(F.col("kind") == 1, F.struct("k", "t"))
    heads, follows = [], None
    found = placed.where("kind = 1").groupBy("__part").agg(F.min(F.struct("__place", "k", "t")).alias("head"))
    firsts = {r["__part"]: r.head for r in found.collect()}  # a row a range
    for p in range(max(firsts, default=-1), -1, -1):
        heads.append((p, *((follows.k, follows.t) if follows else (None, None))))
        follows = firsts.get(p, follows)
    kinds = placed.schema
    heads = F.broadcast(placed.sparkSession.createDataFrame(heads, T.StructType([T.StructField("__part", T.LongType()), T.StructField("hk", kinds["k"].dataType), T.StructField("ht", kinds["t"].dataType)])))
    backward = Window.partitionBy("__part").orderBy(F.desc("__place")).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("__next", F.last(point, ignorenulls=True).over(backward)).where("kind = 0").join(heads, "__part", "left")
    after = F.coalesce("__next", F.struct(F.col("hk").alias("k"), F.col("ht").alias("t")))
    return rows.select(F.col("k").alias(key), F.col("came").alias(at), F.when(after["k"] == F.col("k"), after["t"]).alias("next"))


def accepted_by_ttl(sightings: DataFrame, key: str, at: str, ttl_seconds: int) -> DataFrame:
    """Sightings that a set with expiry lets through: the first, then each that comes a TTL or more after the last accepted one.

    A refused sighting doesn't extend the expiry; one without an id or a time is none. Each sighting points to the next that
    would be accepted after it; from the first one of an id the pointers are followed, in rounds of one, two, four, ... steps.
    No id's sightings meet in one row or task.
    """
    ttl = F.expr(f"INTERVAL '{ttl_seconds}' SECOND")
    points = sightings.select(key, at).where(F.col(key).isNotNull() & F.col(at).isNotNull()).distinct()
    spans = written(points.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last")))
    many = points.join(spans.where(F.col("last") >= F.col("first") + ttl).select(key, "first"), key)
    jump = written(next_at_or_after(many, key, at, ttl).where("next IS NOT NULL"))
    fresh = reached = spans.select(key, F.col("first").alias("accepted_at"))
    while True:
        # those reached so far are the first 2^k of each id, and jump goes 2^k ahead
        fresh = written(reached.join(jump, (reached[key] == jump[key]) & (reached["accepted_at"] == jump[at])).select(reached[key], F.col("next").alias("accepted_at")))
        if not fresh.limit(1).count():
            return reached
        reached = written(reached.unionByName(fresh))
        step = jump.select(F.col(key).alias("k2"), F.col(at).alias("t2"), F.col("next").alias("further"))
        jump = written(jump.join(step, (jump[key] == step["k2"]) & (jump["next"] == step["t2"])).select(key, at, F.col("further").alias("next")))
