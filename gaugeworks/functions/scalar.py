"""Column functions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from gaugeworks.sources.usage import MONEY


def window_start(at: Column, seconds: int) -> Column:
    """Start of the epoch-aligned tumbling window [start, start + seconds)."""
    return F.window(at, f"{seconds} seconds")["start"]


def seconds(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' SECOND")


def millis_between(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.floor(F.timestamp_diff("MICROSECOND", start, end) / 1000).cast("long"))


def key_partition(key: Column, n: int) -> Column:
    """CRC-32 of the key modulo n: the same in every process."""
    if n <= 0:
        raise ValueError("a log has at least one partition")
    return (F.crc32(F.encode(key, "UTF-8")) % n).cast("int")


def aggregate_key(tenant: Column, metric: Column, start: Column, revision: Column) -> Column:
    return F.concat_ws(":", tenant, metric, F.concat(F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), F.concat(F.lit("rev"), revision.cast("string")))


def percent(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double") * 100


def drift_percent(approximate: Column, exact: Column) -> Column:
    """|approximate - exact| as a share of exact; where exact is 0: 0 if equal, else 100."""
    gap = F.abs(approximate - exact)
    return F.when(exact == 0, F.when(gap == 0, 0.0).otherwise(100.0)).otherwise(F.round(percent(gap, exact), 6))


def money(value) -> Column:
    return F.lit(value).cast(MONEY)


def bloom_positions(item: Column, bits: int, hashes: int) -> Column:
    """The bits of an item in a Bloom filter, by double hashing: (h1 + i * h2) mod bits, h1 and h2 being SHA-256 of the item and of the item with ":salt"."""

    def rest(text: Column) -> Column:
        digits = F.sha2(text, 256)
        words = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.conv(F.substring(digits, 4 * k + 1, F.lit(4)), 16, 10).cast("long"))
        return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: (acc * 65_536 + w) % bits)

    both = F.struct(rest(item).alias("one"), rest(F.concat(item, F.lit(":salt"))).alias("two"))
    return F.transform(F.array(both), lambda h: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (h["one"] + i * h["two"]) % bits))[0]


def bloom_size(elements: int, false_positives: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter."""
    bits = max(64, int(-elements * math.log(false_positives) / math.log(2) ** 2))
    return bits, max(1, int(bits / elements * math.log(2)))
