"""Sealed totals (revision 0), corrections by late events, and reads over revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gaugeworks.operators.quota import small
from gaugeworks.sources.usage import MONEY, written

KEY = ["tenant_id", "metric", "window_start"]
COLUMNS = ["tenant_id", "metric", "partition", "window_start", "window_end", "quantity", "event_count", "revision", "sealed_at"]


def totals(events: DataFrame, key: list[str]) -> DataFrame:
    return events.groupBy(*key).agg(F.sum("quantity").cast(MONEY).alias("quantity"), F.count("*").alias("event_count"))


def salted_totals(events: DataFrame, key: list[str], salts: int = 16, by: str = "event_id") -> DataFrame:
    """The same in two stages, for keys so hot that even partial sums of one key meet in one place: exact for decimals."""
    salted = events.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    part = totals(salted, [*key, "bucket"])
    return part.groupBy(*key).agg(F.sum("quantity").cast(MONEY).alias("quantity"), F.sum("event_count").alias("event_count"))


def on_time(rows: DataFrame) -> DataFrame:
    return totals(rows.where("NOT is_late"), ["tenant_id", "metric", "partition", "window_start", "window_end"])


def first_crossings(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """partition, window_end, sealed_at: the first watermark at or past each window end.

    Of the watermarks between two window ends only the least matters, so what is ordered is a row or two a window.
    """
    points = ends.select("partition", "window_end").distinct()
    size = F.timestamp_diff("MICROSECOND", F.col("window_start"), F.col("window_end"))
    steps = F.floor(F.timestamp_diff("MICROSECOND", F.col("window_end"), F.col("watermark")) / size)
    marks = rows.groupBy("partition", "window_end", steps.alias("steps")).agg(F.min("watermark").alias("at"))
    both = points.select("partition", F.col("window_end").alias("at"), F.lit(0).alias("kind")).unionByName(marks.select("partition", "at", F.lit(1).alias("kind")))
    after = Window.partitionBy("partition").orderBy("at", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("sealed_at", F.min(F.when(F.col("kind") == 1, F.col("at"))).over(after))
    return found.where("kind = 0").select("partition", F.col("at").alias("window_end"), "sealed_at")


def sealed(rows: DataFrame) -> DataFrame:
    """Revision 0: all on-time events of every window that its own partition's watermark has passed."""
    done = on_time(rows)
    crossed = first_crossings(rows, done).where("sealed_at IS NOT NULL")
    return done.join(crossed, ["partition", "window_end"]).withColumn("revision", F.lit(0)).select(*COLUMNS)


def open_windows(rows: DataFrame, watermarks: DataFrame) -> DataFrame:
    return on_time(rows).join(watermarks, "partition", "left").where("watermark IS NULL OR watermark < window_end").drop("watermark")


def corrections(rows: DataFrame, base: DataFrame, chunk: int = 100_000) -> DataFrame:
    """One revision for each late event, each on top of the one before; without a revision 0 from a base of 0.

    A window's late events are summed by chunks of offsets, and within a chunk on top of the chunks before it.
    """
    late = rows.where("is_late").withColumn("__chunk", F.floor(F.col("offset") / chunk))
    sums = late.groupBy(*KEY, "__chunk").agg(F.sum("quantity").alias("__q"), F.count("*").alias("__n"))  # a row a chunk
    earlier = Window.partitionBy(*KEY).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(MONEY)
    before = sums.select(*KEY, "__chunk", F.coalesce(F.sum("__q").over(earlier), zero).alias("__q"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"))
    before = before.join(base.select(*KEY, F.col("quantity").alias("__q0"), F.col("event_count").alias("__n0")), KEY, "left")
    inner = Window.partitionBy(*KEY, "__chunk").orderBy("offset")
    nth = F.col("__n") + F.row_number().over(inner)
    quantity = (F.coalesce("__q0", zero) + F.col("__q") + F.sum("quantity").over(inner.rowsBetween(Window.unboundedPreceding, 0))).cast(MONEY)
    return late.join(before, [*KEY, "__chunk"]).select("tenant_id", "metric", "partition", "window_start", "window_end", quantity.alias("quantity"), (F.coalesce("__n0", F.lit(0)) + nth).cast("long").alias("event_count"), nth.cast("int").alias("revision"), F.col("watermark").alias("sealed_at"))


def revisions(rows: DataFrame) -> DataFrame:
    base = sealed(rows)
    return base.unionByName(corrections(rows, base))


def latest(revs: DataFrame, as_of=None) -> DataFrame:
    """The highest revision of each window, as of a time if given; pre-aggregated before the shuffle."""
    seen = revs if as_of is None else revs.where(F.col("sealed_at") <= as_of)
    rest = [c for c in seen.columns if c not in KEY]
    return seen.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "revision").alias("r")).select(*KEY, *(F.col(f"r.{c}").alias(c) for c in rest))


def within(aggregates: DataFrame, start, end) -> DataFrame:
    """Windows that lie in the range as a whole."""
    return aggregates.where((F.col("window_start") >= start) & (F.col("window_end") <= end))


def recent(aggregates: DataFrame, n: int = 50) -> DataFrame:
    return aggregates.orderBy(F.desc("window_start"), F.desc("revision"), "tenant_id", "metric").limit(n)


def appended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """`new` after an append under the key (tenant, metric, window, revision): what exists already is an error column, not a row lost."""
    key = [*KEY, "revision"]
    known = existing.select(*key).withColumn("__known", F.lit(True))
    return new.join(known, key, "left").withColumn("is_duplicate", F.coalesce("__known", F.lit(False))).drop("__known")


def append_strict(existing: DataFrame, new: DataFrame, path: str) -> None:
    """Append `new` under `path`, or raise if a key and revision exists. One writer at a time: check and append are two steps."""
    checked = appended(existing, new)
    if checked.where("is_duplicate").limit(1).count():
        raise ValueError("an aggregate with this key and revision exists")
    checked.drop("is_duplicate").write.mode("append").parquet(path)


def index_percentiles(rows: DataFrame, group: str, value: str, quantiles: list[float], most: int = 10_000, splitters: int = 64) -> DataFrame:
    """The element at index min(int(n * q), n - 1) of each group's sorted values; null values don't count.

    Selection by bracketing: the values of a bracket are cut at approximate percentiles of it, counts say which piece holds the
    index, and that piece is the next bracket, until it is one value or has at most `most` rows; only those are sorted. Each round
    divides a bracket by about `splitters`, and counts are made in each task before they meet, so a group of any size is many tasks.
    """
    rows = written(rows.select(F.struct(F.col(group).alias("g")).alias("g"), F.col(value).alias("v")).where("v IS NOT NULL"))  # a struct meets its like also where it holds a null
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("q", F.explode(F.array(*(F.lit(float(x)) for x in quantiles))))
    # k: the index within the bracket, of n rows from lo to hi
    brackets = written(sizes.select("g", "q", "n", "lo", "hi", F.least(F.floor(F.col("n") * F.col("q")), F.col("n") - 1).alias("k")))
    found, bracket = [], ["g", "lo", "hi"]
    while True:
        found.append(brackets.where("lo = hi").select("g", "q", F.col("lo").alias("v")))
        few = inside(rows, brackets.where(f"lo < hi AND n <= {most}"))
        rank = F.row_number().over(Window.partitionBy("g", "q").orderBy("v")) - 1
        found.append(few.withColumn("r", rank).where("r = k").select("g", "q", "v"))
        large = brackets.where(f"lo < hi AND n > {most}")
        if not large.limit(1).count():
            break
        ranges = large.select(*bracket).distinct()
        cuts = inside(rows, ranges).groupBy(*bracket).agg(F.percentile_approx("v", [i / splitters for i in range(1, splitters)], 20 * splitters).alias("cuts"))
        # a value that is a splitter has a piece of its own, so repeated values can't hold a bracket together
        piece = F.size(F.filter("cuts", lambda c: c < F.col("v"))) * 2 + F.array_contains("cuts", F.col("v")).cast("int")
        counts = inside(rows, written(cuts)).groupBy(*bracket, piece.alias("piece")).agg(F.count("*").alias("m"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
        below = F.sum("m").over(Window.partitionBy(*bracket).orderBy("piece")) - F.col("m")  # 2 * splitters rows
        placed = large.join(counts.withColumn("below", below), bracket).where("k >= below AND k < below + m")
        brackets = written(placed.select("g", "q", F.col("m").alias("n"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), (F.col("k") - F.col("below")).alias("k")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("g.g").alias(group), F.col("q").alias("quantile"), F.col("v").alias("value"))


def inside(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Rows (g, v) with each bracket of their group that they lie in."""
    b = small(brackets.withColumnRenamed("g", "g2"))
    return rows.join(b, (rows["g"] == F.col("g2")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("g2")
