"""Exact repeated passages by prefix-free parsing.

A byte goes if a string of `length` bytes that covers it also starts anywhere
else. Rolling-hash triggers cut each text into phrases: a trigger is the least
rolling hash in a stretch of `length - KEY` window starts, so every window has
one (`trigger of a window`), found from the window's bytes alone. Equal windows
thus have equal triggers at equal places, and the `KEY` bytes after a trigger
are equal too.

1. Triggers whose key occurs once in the corpus have no repeated window. Only
   the others are kept: a row is a trigger with the range [a, b] of the windows
   that it stands for, and a 128-bit digest of all their bytes.
2. Rows with equal digests are one dictionary entry. If it has two or more
   occurrences, all its windows repeat; hot passages so cost one row a task.
3. Keys with several entries need an order. Each entry's left part is a
   dictionary phrase and its right part the parse that follows. The entries are
   sorted by the right parts (the parse's suffix array, with the lengths of
   common prefixes) and by the reversed left parts (the dictionary's suffixes).
   A window that begins n bytes before the trigger is in corpus order by its n
   byte dictionary suffix, then by its parse suffix; neighbours in that order
   with a common prefix of `length` bytes repeat. Only windows of one key can
   be neighbours, so each group of entries is ordered on its own, many in a task.
4. A key with more than `bucket` entries is split by longer contexts. Windows
   that begin lo to hi bytes before the trigger are equal only where the lo
   bytes before it and the length - hi bytes after it are, so the range of n is
   halved and each half's entries are dealt out by these bytes. Entries alone in
   their part go; those that agree in all bytes of the half are one entry from
   there on, and if there are two or more, all their windows in it repeat. Parts
   small enough are ordered as in 3, others halved again; a part of one n only
   has one entry left.
5. The ranges found are joined with the texts, and the bytes cut.

Ranges of hashes are of at most 2 * length bytes, for which `length` is 256 at
most: polynomials modulo 2^64 can't be trusted with longer ones. Texts are
identified by a 64-bit hash of id and text, so that repeated ids stay apart;
equal rows get equal results.

Defined cases: a null text is empty; texts under `length` bytes keep all;
matches never cross texts; an empty table gives no rows; further columns are
not read; texts are used whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import joined_by_hot_keys, materialize, released
from .neardup import mix, powers

U = np.uint64
KEY, GRAM = 32, 16
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Ranges:
    """Digests of byte ranges of one array."""

    def __init__(self, raw: np.ndarray):
        self.sums = []
        for base in BASES:
            up, down = powers(len(raw) + 1, base)
            self.sums.append((np.concatenate([[U(0)], np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)])]), down))

    def digest(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        total, down = self.sums[which]
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def least_in_stretch(h: np.ndarray, size: int) -> np.ndarray:
    """min(h[s : s + size]) for every s with a whole stretch."""
    n = len(h)
    full = np.pad(h, (0, -n % size), constant_values=U(2**64 - 1)).reshape(-1, size)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def triggers(texts: list[bytes], length: int):
    """(text, trigger, first window, last window) of all texts, places by text; the joined bytes; where texts begin."""
    size = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, raw, begin
    h = (raw.astype(U) + U(1)) * U(0xBF58476D1CE4E5B9)
    step = 1
    while step < GRAM:  # h covers `step` bytes, then twice as many
        h = h[:-step] * U(0x94D049BB133111EB + 2 * step) + h[step:]
        step *= 2
    h = (mix(h) & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    stretch = length - KEY
    where = (least_in_stretch(h, stretch) & U(0xFFFFFFFF)).astype(np.int64)
    windows = np.maximum(size - length + 1, 0)
    s = np.arange(windows.sum()) + np.repeat(begin - (np.cumsum(windows) - windows), windows)
    text = np.repeat(np.arange(len(texts)), windows)
    t = where[s]
    new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (text[1:] != text[:-1])])) if len(s) else none
    last = np.concatenate([new[1:], [len(s)]])[: len(new)] - 1
    return text[new], t[new], s[new], s[last], raw, begin


def portions(texts: list[bytes], most: int = 1_000_000):
    part, n, at = [], 0, 0
    for i, t in enumerate(texts):
        if part and n + len(t) > most:
            yield at, part
            part, n, at = [], 0, i
        part.append(t)
        n += len(t)
    if part:
        yield at, part


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=[*columns])


def trigger_rows(docs: DataFrame, length: int, whole: bool) -> DataFrame:
    """docs: rid, text. key; if whole also rid, t, a, b and the digest f1, f2 of the bytes [a, b + length)."""

    def run(batches):
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for at, part in portions(texts):
                text, t, a, b, raw, begin = triggers(part, length)
                if not len(t):
                    continue
                ranges = Ranges(raw)
                key = ranges.digest(t, t + KEY, 0).astype(np.int64)
                if not whole:
                    yield batch_of(key=key)
                    continue
                shape = mix((t - a).astype(U))
                f1, f2 = (mix(ranges.digest(a, b + length, k) ^ shape).astype(np.int64) for k in (0, 1))
                off = begin[text]
                yield batch_of(key=key, rid=rid[at + text], t=(t - off).astype(np.int32), a=(a - off).astype(np.int32), b=(b - off).astype(np.int32), f1=f1, f2=f2)

    return docs.mapInArrow(released(run), "key long, rid long, t int, a int, b int, f1 long, f2 long" if whole else "key long")


#: An entry of a group `g`, which asks for windows n in [low, high]: its place, those of them that it has, and the bytes before and after its trigger.
ENTRY = {"g": pa.int64(), "low": pa.int32(), "high": pa.int32(), "rid": pa.int64(), "t": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "n": pa.int64(), "left": pa.binary(), "right": pa.binary()}
ENTRY_DDL = "g long, low int, high int, rid long, t int, lo int, hi int, n long, left binary, right binary"


def contexts(docs: DataFrame, entries: DataFrame, length: int) -> DataFrame:
    """entries: rid, key, t, a, b, n. Adds the bytes before and after the trigger."""
    rows = entries.groupBy("rid").agg(F.collect_list(F.struct("key", "t", "a", "b", "n")).alias("at"))  # at most a text's own triggers

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ENTRY}
            for rid, text, at in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), batch.column("at").to_pylist()):
                data = (text or "").encode()
                for x in at:
                    t, a, b = x["t"], x["a"], x["b"]
                    for k, v in zip(ENTRY, (x["key"], 0, length - KEY, rid, t, t - b, t - a, x["n"], data[a:t], data[t : b + length])):
                        out[k].append(v)
            yield batch_of(**{k: pa.array(v, ENTRY[k]) for k, v in out.items()})

    return docs.join(rows, "rid").select("rid", "text", "at").mapInArrow(released(run), ENTRY_DDL)


def sorted_with_lcp(strings: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each string within (group, string) order, and each rank's common prefix with the one before (-1 across groups)."""
    head = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    body = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)
    rows = np.ascontiguousarray(np.concatenate([head, body], 1))
    order = np.argsort(rows.view(f"S{width + 4}").ravel(), kind="stable")  # compares bytes; padding is equal to nothing else of its length
    size = np.array([len(s) for s in strings])[order]
    ordered = body[order]
    lcp = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        differ = ordered[1:] != ordered[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width)
        lcp[1:] = np.where(group[order][1:] == group[order][:-1], np.minimum(common, np.minimum(size[1:], size[:-1])), -1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, lcp


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], near: np.ndarray, far: np.ndarray, length: int) -> np.ndarray:
    """entries x (window's distance before its trigger): whether the window repeats among the entries of its group.

    near, far: the least and greatest distance of an entry's windows.
    """
    width = length
    parse_rank, parse_lcp = sorted_with_lcp(right, group, width)
    dict_rank, dict_lcp = sorted_with_lcp([s[::-1] for s in left], group, width)
    out = np.zeros((len(left), length - KEY), bool)
    for n in range(int(near.min()), int(far.max()) + 1):
        rows = np.flatnonzero((near <= n) & (n <= far))
        if len(rows) < 2:
            continue
        suffix = np.cumsum(dict_lcp < n)[dict_rank[rows]]  # equal for equal last n bytes of the phrase
        follow = np.cumsum(parse_lcp < length - n)[parse_rank[rows]]  # equal for equal next length - n bytes
        order = np.lexsort([follow, suffix])
        x, y = suffix[order], follow[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        out[rows[order[hit]], n] = True
    return out


def spans_of(mask: np.ndarray, rid: np.ndarray, t: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of repeated windows as byte ranges."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return batch_of(rid=rid[row], start=(t[row] - after + 1).astype(np.int32), end=(t[row] - first + length).astype(np.int32))


def ordered_spans(entries: DataFrame, length: int) -> DataFrame:
    """By the corpus order of each group; a group's entries are together and few."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            groups = batch.column("g").to_numpy()
            if not len(groups):
                continue
            cut = int(np.flatnonzero(groups != groups[-1])[-1]) + 1 if groups[0] != groups[-1] else 0
            if held and held[-1].column("g")[0].as_py() != groups[0]:
                yield solve(pa.Table.from_batches(held))
                held = []
            if cut:
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    def solve(table: pa.Table) -> pa.RecordBatch:
        t, lo, hi, n, rid = (table.column(c).to_numpy() for c in ("t", "lo", "hi", "n", "rid"))
        _, group = np.unique(table.column("g").to_numpy(), return_inverse=True)
        mask = repeated_windows(group, table.column("left").to_pylist(), table.column("right").to_pylist(), lo, hi, length)
        mask[n > 1] = False  # those are whole already
        return spans_of(mask, rid, t, length)

    few = entries.repartition("g").sortWithinPartitions("g")
    return few.mapInArrow(released(run), "rid long, start int, end int")


def halved(entries: DataFrame, length: int) -> DataFrame:
    """Each entry in the half or halves of its group's range in which it has windows, in a group by the bytes that these windows share at least; s1, s2: digest of all their bytes."""

    def number(digest: bytes) -> int:
        return int.from_bytes(digest, "big", signed=True)

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in (*ENTRY, "s1", "s2")}
            for row in zip(*(batch.column(k).to_pylist() for k in ENTRY)):
                x = dict(zip(ENTRY, row))
                left, right, middle = x["left"], x["right"], (x["low"] + x["high"]) // 2
                for low, high in ((x["low"], middle), (middle + 1, x["high"])):
                    near, far = max(x["lo"], low), min(x["hi"], high)
                    if near > far:
                        continue
                    shared = hashlib.blake2b(b"%d:%d:" % (low, x["g"]) + left[len(left) - low :] + right[: length - high], digest_size=8).digest()
                    whole = hashlib.blake2b(b"%d:%d:" % (near, far) + left[len(left) - far :] + right[: length - near], digest_size=16).digest()
                    half = {"g": number(shared), "low": low, "high": high, "lo": near, "hi": far, "s1": number(whole[:8]), "s2": number(whole[8:])}
                    for k, v in (x | half).items():
                        out[k].append(v)
            yield batch_of(**{k: pa.array(v, ENTRY.get(k, pa.int64())) for k, v in out.items()})

    return entries.mapInArrow(released(run), ENTRY_DDL + ", s1 long, s2 long")


def grouped_spans(entries: DataFrame, length: int, bucket: int) -> list[DataFrame]:
    """Ranges of the repeated windows of all groups. Groups of more than `bucket` entries are split, at most log2(length) times."""
    out: list[DataFrame] = []
    place = F.struct("rid", "t")
    while True:
        sizes = materialize(entries.groupBy("g").agg(F.count("*").alias("members")).where("members > 1"))
        sized = joined_by_hot_keys(entries, sizes, ["g"], place, "members")
        out.append(ordered_spans(sized.where(F.col("members") <= bucket), length))
        if not sizes.where(F.col("members") > bucket).limit(1).count():
            return out
        parts = materialize(halved(sized.where(F.col("members") > bucket), length))
        same = ["g", "lo", "s1", "s2"]
        # one entry for all that agree in every byte of the half; its windows begin at t - hi to t - lo
        rest = [F.min_by(c, place).alias(c) for c in ENTRY if c not in (*same, "n")]
        again = materialize(parts.groupBy(*same).agg(F.count("*").alias("n"), *rest))
        whole = joined_by_hot_keys(parts.select(*same, "rid", "t", "hi"), again.where("n > 1").select(*same, "n"), same, place)
        out.append(whole.select("rid", (F.col("t") - F.col("hi")).alias("start"), (F.col("t") - F.col("lo") + length).cast("int").alias("end")))
        entries = again.where("low < high").select(*ENTRY)  # where they are the same, all entries of a group agree


def repeated_ranges(docs: DataFrame, length: int, bucket: int) -> DataFrame:
    """docs: rid, text. Byte ranges (rid, start, end) that repeated windows cover; together all of them."""
    place = F.struct("rid", "t")
    counts = materialize(trigger_rows(docs, length, False).groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    rows = materialize(joined_by_hot_keys(trigger_rows(docs, length, True), counts, ["key"], place, "c").drop("c"))
    entry = ["key", "f1", "f2"]
    entries = materialize(rows.groupBy(*entry).agg(F.count("*").alias("n"), F.min(F.struct("rid", "t", "a", "b")).alias("at")))
    twice = entries.where("n > 1").select(*entry, "n")
    whole = joined_by_hot_keys(rows, twice, entry, place).select("rid", F.col("a").alias("start"), (F.col("b") + length).cast("int").alias("end"))
    several = materialize(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    mixed = joined_by_hot_keys(entries.select("key", "at.*", "n"), several, ["key"], place, "c")
    mixed = materialize(contexts(docs, mixed, length))
    out = whole
    for spans in grouped_spans(mixed, length, bucket):
        out = out.unionByName(spans)
    return materialize(out)


def with_row_ids(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`rid`, a number that no two rows share unless they agree in id and text: 64 bits of both, and 64 other bits for rows that share the first ones with different rows.

    Of 4e10 rows some eighty do; they are found first, from the numbers alone. Their second numbers could only meet another row's by a chance of one in millions.
    """
    bits = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("one"), F.xxhash64(F.lit(1), F.col(key), F.col(text)).alias("two"))
    shared = materialize(bits.groupBy("one").agg(F.min("two").alias("least"), F.max("two").alias("most")).where("least <> most").select(F.col("one").alias("__shared")))
    one, two = F.xxhash64(F.col(key), F.col(text)), F.xxhash64(F.lit(1), F.col(key), F.col(text))
    if not shared.limit(1).count():
        return docs.withColumn("rid", one)
    return docs.join(shared, one == F.col("__shared"), "left").withColumn("rid", F.when(F.col("__shared").isNull(), one).otherwise(two)).drop("__shared")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, bucket: int = 2000, keep: list[str] | None = None, kept_text: bool = False) -> DataFrame:
    """key, `keep`, n_bytes, n_removed, n_spans, kept_sha256; with kept_text also the remaining bytes."""
    if not KEY < length <= 256:
        raise ValueError(f"length must be over {KEY} and at most 256 bytes")
    keep = [key, *(keep or [])]
    numbered = with_row_ids(docs, key, text)
    plain = numbered.select("rid", F.col(text).alias("text"))
    found = repeated_ranges(plain.where(F.octet_length("text") >= length), length, bucket)
    ranges = found.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__ranges"))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            n, gone, spans, digest, rest = [], [], [], [], []
            for t, ranges in zip(batch.column("__text").to_pylist(), batch.column("__ranges").to_pylist()):
                data = (t or "").encode()
                parts, at, runs, end = [], 0, 0, -1
                for r in ranges or []:
                    if r["start"] > end:
                        parts.append(data[at : r["start"]])
                        runs += 1
                    end = at = max(end, r["end"])
                left = b"".join([*parts, data[at:]])
                n.append(len(data))
                gone.append(len(data) - len(left))
                spans.append(runs)
                digest.append(hashlib.sha256(left).hexdigest())
                rest.append(left)
            more = {"n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if kept_text:
                more["kept"] = pa.array(rest, pa.binary())
            yield batch_of(**{c: batch.column(c) for c in keep}, **more)

    rows = numbered.select("rid", *keep, F.col(text).alias("__text")).join(ranges, "rid", "left").select(*keep, "__text", "__ranges")
    return rows.mapInArrow(released(run), f"{kept}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_text)
