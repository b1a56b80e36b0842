"""Selection, numbering and pointers where one group holds nearly all rows."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import aggregates, dedup
from gaugeworks.sources import usage

T0 = datetime(2024, 1, 1)


def plain_percentiles(rows, quantiles):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    return {(g, q): sorted(vs)[min(int(len(vs) * q), len(vs) - 1)] for g, vs in groups.items() for q in quantiles}


@pytest.mark.parametrize("most, splitters", [(10_000, 64), (5, 4), (1, 3)])
def test_index_percentiles_by_bracketing(spark, most, splitters):
    r = random.Random(2)
    values = {"many": [r.random() for _ in range(600)], "ties": [float(r.choice([1, 1, 1, 1, 2, 5])) for _ in range(400)], "one": [3.0], "same": [7.0] * 300, None: [float(k) for k in range(50)], "wide": [10.0 ** r.randint(-12, 12) for _ in range(200)]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    quantiles = [0.0, 0.5, 0.9, 0.99, 1.0]
    got = {(x.g, x.quantile): x.value for x in aggregates.index_percentiles(df, "g", "v", quantiles, most, splitters).collect()}
    assert got == plain_percentiles(rows, quantiles)


def test_one_group_of_distinct_values(spark):
    """200,000 distinct values in one group: at most `most` of them are ever sorted together."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 200_000).cast("decimal(38,9)").alias("v"))
    got = {x.quantile: x.value for x in aggregates.index_percentiles(df, "g", "v", [0.5, 0.999], most=1000).collect()}
    assert got == {0.5: Decimal(100_000), 0.999: Decimal(199_800)}


def test_numbers_of_a_hot_group_come_from_many_tasks(spark):
    hot = F.when(F.col("id") % 10 > 0, "hot").otherwise("cold")
    df = spark.range(20_000).select(hot.alias("tenant"), (F.col("id") * 7 % 20_000).alias("window"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # such small ranges would be put together
    try:
        placed = usage.ranged(df, ["tenant", "window"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.where("tenant = 'hot'").select("__part").distinct().count() > 1
    rows = usage.numbered_globally(df, ["tenant", "window"]).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 20_001)) and [(r.tenant, r.window) for r in rows] == sorted((r.tenant, r.window) for r in rows)
    assert usage.numbered_globally(df.where("false"), ["tenant", "window"]).count() == 0


def plain_ttl(rows, ttl):
    out, last = set(), {}
    for key, at in sorted(r for r in rows if None not in r):
        if key not in last or at >= last[key] + timedelta(seconds=ttl):
            last[key] = at
            out.add((key, at))
    return out


def test_ttl_by_pointers(spark):
    r = random.Random(4)
    rows = [(f"k{r.randint(0, 30)}", T0 + timedelta(seconds=r.randint(0, 4000), microseconds=r.choice([0, 0, 1]))) for _ in range(1500)]
    rows += [("hot", T0 + timedelta(seconds=3 * k)) for k in range(3000)] + [(None, T0), ("k1", None), ("single", T0), ("edge", T0), ("edge", T0 + timedelta(seconds=100))]
    df = spark.createDataFrame(rows, "id string, at timestamp_ntz").repartition(6)
    got = dedup.accepted_by_ttl(df, "id", "at", 100).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == plain_ttl(rows, 100)
    assert dedup.accepted_by_ttl(df.where("false"), "id", "at", 100).count() == 0


def test_ttl_of_an_id_with_a_million_sightings(spark):
    """One id, a sighting a second: every sixtieth is let through, and no task holds them all."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("at"))
    got = dedup.accepted_by_ttl(df, "id", "at", 60)
    assert got.count() == 16_667 and got.where("second(accepted_at) <> 0").count() == 0
