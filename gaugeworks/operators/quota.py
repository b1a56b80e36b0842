"""Approximate counters, quota checks and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeworks.functions.scalar import drift_percent, percent
from gaugeworks.sources.usage import MONEY

DEFAULT_LIMIT = 1_000_000
BROADCAST_ROWS = 200_000


def quotas(tenants: DataFrame) -> DataFrame:
    return tenants.select("tenant_id", "plan", F.explode("quotas").alias("metric", "limit"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, if a count proves the side small enough; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def counters(events: DataFrame) -> DataFrame:
    """Cumulative usage by tenant and metric, exact and as the approximate path keeps it (doubles)."""
    return events.groupBy("tenant_id", "metric").agg(F.sum("quantity").cast(MONEY).alias("usage"), F.round(F.sum(F.col("quantity").cast("double")), 2).alias("approximate_usage"))


def synced(counts: DataFrame, exact: DataFrame) -> DataFrame:
    """Counters overridden by exact totals where there are any."""
    return counts.select("tenant_id", "metric", "usage").join(exact.select("tenant_id", "metric", F.col("quantity").alias("exact")), ["tenant_id", "metric"], "full_outer").select("tenant_id", "metric", F.coalesce("exact", "usage").cast(MONEY).alias("usage"), F.col("exact").isNotNull().alias("overridden"))


def checked(usage: DataFrame, tenants: DataFrame, proposed: int = 0, as_of=None) -> DataFrame:
    """allowed if usage + proposed <= limit; a metric without quota is unlimited, an unknown tenant has the default limit.

    as_of: the time of the check, now if none is given. Counters are the approximate path, so every result says so.
    """
    known = small(tenants.select("tenant_id", "plan"))
    limits = quotas(tenants).drop("plan")
    rows = usage.join(known, "tenant_id", "left").join(small(limits), ["tenant_id", "metric"], "left")
    limit = F.when(F.col("plan").isNull(), F.lit(DEFAULT_LIMIT).cast(MONEY)).otherwise(F.col("limit"))
    allowed = limit.isNull() | (F.col("usage") + F.lit(proposed).cast(MONEY) <= limit)
    return rows.select("tenant_id", "metric", F.col("usage").alias("current_usage"), limit.alias("limit"), F.coalesce(allowed, F.lit(True)).alias("allowed")).withColumn("reason_code", F.when(F.col("allowed"), "OK").otherwise("QUOTA_EXCEEDED")).withColumn("as_of", F.localtimestamp() if as_of is None else as_of).withColumn("approximate", F.lit(True))


def drift(usage: DataFrame, exact: DataFrame) -> DataFrame:
    """Counter against exact total; either side may be missing."""
    both = usage.select("tenant_id", "metric", F.col("usage").alias("approximate")).join(exact.select("tenant_id", "metric", F.col("quantity").alias("exact")), ["tenant_id", "metric"], "full_outer")
    zero = F.lit(0).cast(MONEY)
    both = both.withColumn("approximate", F.coalesce("approximate", zero)).withColumn("exact", F.coalesce("exact", zero))
    return both.withColumn("drift", F.abs(F.col("approximate") - F.col("exact")).cast(MONEY)).withColumn("drift_percent", drift_percent(F.col("approximate"), F.col("exact")))


def utilisation(usage: DataFrame, tenants: DataFrame) -> DataFrame:
    """Percent of the quota used, 100 at most; 0 without a quota."""
    rows = usage.join(small(quotas(tenants).drop("plan")), ["tenant_id", "metric"], "left")
    share = F.least(F.lit(100), F.round(percent(F.col("usage"), F.col("limit"))).cast("int"))
    return rows.select("tenant_id", "metric", F.coalesce(F.when(F.col("limit") > 0, share), F.lit(0)).alias("utilisation_percent"))


def overview(tenants: DataFrame, usage: DataFrame, exact: DataFrame) -> DataFrame:
    """A row for each tenant and metric with a quota: limit, both usages and the drift to two places (0 where exact is 0)."""
    zero = F.lit(0).cast(MONEY)
    rows = quotas(tenants).join(usage.select("tenant_id", "metric", F.col("usage").alias("a")), ["tenant_id", "metric"], "left").join(exact.select("tenant_id", "metric", F.col("quantity").alias("e")), ["tenant_id", "metric"], "left")
    rows = rows.withColumn("approximate_usage", F.coalesce("a", zero)).withColumn("exact_usage", F.coalesce("e", zero))
    gap = F.abs(F.col("approximate_usage") - F.col("exact_usage"))
    return rows.select("tenant_id", "plan", "metric", "limit", "approximate_usage", "exact_usage", F.when(F.col("exact_usage") > 0, F.bround(percent(gap, F.col("exact_usage")), 2)).otherwise(0.0).alias("drift_percent"))


def sliding_usage(events: DataFrame, seconds: int) -> DataFrame:
    """Usage over the `seconds` that end with each event.

    Time is cut in stretches of that length, and each event also stands in the next stretch, at the time from which it is
    out of reach: so a hot tenant is a task a stretch. Usage is then all of the stretch before, and what has come since,
    less what has left: running sums, so an event costs the same however many are in reach.
    """
    length = seconds * 1_000_000
    at = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("occurred_at"))
    stretch = F.floor(at / length)
    twice = events.select("event_id", "tenant_id", "metric", "occurred_at", "quantity", at.alias("__at"), F.posexplode(F.array(stretch, stretch + 1)).alias("__left", "__stretch"))
    # an event at the very edge is still in reach: those that come stand before those that leave; one without a time never leaves
    twice = twice.where("__left = 0 OR __at IS NOT NULL").withColumn("__at", F.col("__at") + F.col("__left") * length)
    whole = Window.partitionBy("tenant_id", "metric", "__stretch")
    upto = whole.orderBy("__at", "__left").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    came, left = F.when(F.col("__left") == 0, F.col("quantity")), F.when(F.col("__left") == 1, F.col("quantity"))
    zero = F.lit(0).cast(MONEY)
    total = F.coalesce(F.sum(came).over(upto), zero) + F.coalesce(F.sum(left).over(whole), zero) - F.coalesce(F.sum(left).over(upto), zero)
    known = F.count(came).over(upto) + F.count(left).over(whole) - F.count(left).over(upto)
    rows = twice.withColumn("trailing_quantity", F.when(known > 0, total.cast(MONEY))).where("__left = 0")
    return rows.select("event_id", "tenant_id", "metric", "occurred_at", "trailing_quantity")


def panes(events: DataFrame, pane_seconds: int, key: list[str]) -> DataFrame:
    """Sums by key and pane, a pane being `pane_seconds` of event time: pane (its number since 1970), quantity, event_count."""
    n = F.floor(F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("occurred_at")) / pane_seconds)
    return events.groupBy(*key, n.alias("pane")).agg(F.sum("quantity").cast(MONEY).alias("quantity"), F.count("*").alias("event_count"))


def merged_panes(sums: DataFrame, key: list[str]) -> DataFrame:
    """Panes of several batches added up."""
    return sums.groupBy(*key, "pane").agg(F.sum("quantity").cast(MONEY).alias("quantity"), F.sum("event_count").alias("event_count"))


def sliding_totals(sums: DataFrame, key: list[str], pane_seconds: int, length: int) -> DataFrame:
    """Totals of all windows of `length` panes, one pane apart, that hold an event: window_start, quantity, event_count.

    A total is the difference of two prefix sums over the key's panes, at the window's end and at its start; so a pane is
    added once, however many windows it lies in. sums: one row a key and pane.
    """
    starts = sums.select(*key, F.explode(F.sequence(F.col("pane") - length + 1, F.col("pane"))).alias("start")).distinct()
    zero = F.lit(0).cast(MONEY)
    point = lambda at, sign: starts.select(*key, at.alias("pane"), zero.alias("quantity"), F.lit(0).cast("long").alias("event_count"), F.lit(sign).alias("sign"), "start")
    rows = sums.select(*key, "pane", "quantity", "event_count", F.lit(0).alias("sign"), F.lit(None).cast("long").alias("start"))
    rows = rows.unionByName(point(F.col("start"), -1)).unionByName(point(F.col("start") + length, 1))
    before = Window.partitionBy(*key).orderBy("pane").rangeBetween(Window.unboundedPreceding, -1)
    upto = rows.withColumn("q", F.coalesce(F.sum("quantity").over(before), zero)).withColumn("n", F.coalesce(F.sum("event_count").over(before), F.lit(0))).where("sign <> 0")
    out = upto.groupBy(*key, "start").agg(F.sum(F.col("q") * F.col("sign")).cast(MONEY).alias("quantity"), F.sum(F.col("n") * F.col("sign")).alias("event_count"))
    start = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.col("start") * pane_seconds).cast("decimal(20,6)"))
    return out.select(*key, start.alias("window_start"), "quantity", "event_count")


def sliding_usage_at(sums: DataFrame, key: list[str], pane_seconds: int, length: int, pane: Column) -> DataFrame:
    """Usage of the `length` panes that end with `pane`, by key, as a counter for `checked`: only these panes are read."""
    held = sums.where((F.col("pane") > pane - length) & (F.col("pane") <= pane))
    return held.groupBy(*key).agg(F.sum("quantity").cast(MONEY).alias("usage"))
