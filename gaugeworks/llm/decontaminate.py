"""Benchmark decontamination by a prefix-filtered set join.

The windows of the benchmark items are sets of word shingles (single words).
Shingles are ordered by rarity, counted over all documents; for containment
1.0 the necessary prefix of a window is its rarest shingle, so a document is
joined with a window only where it holds that shingle. The shingle's place in
the window bounds where the window can begin (it must lie within the
document's length), and the words there are compared exactly.

The benchmark is the stated query set: it goes to the workers in blocks of at
most `block_bytes` of item text, each block one map-only pass over the
documents; nothing of the documents is shuffled.

Defined cases: null or wordless documents have no words and no hits; null,
wordless or id-less items take no part; repeated items and repeated ids count
once; documents with a null or repeated id are judged row by row; texts of any
length are read whole; of a window's equally rare words the least is its prefix;
an empty table of documents gives no rows, one of items no hits; further columns
of either table are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import released

#: Fixed: A-Z are lower-cased, every other ASCII character but digits and letters parts words.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(BYTES).split() if text else []


def windows(item: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return {tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))} if item else set()


def rarity(docs: DataFrame, vocabulary: set[bytes], text: str) -> dict[bytes, int]:
    """Occurrences in all documents of the words in `vocabulary`, which bounds what is gathered."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                found.update(filter(vocabulary.__contains__, words(t.as_py())))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), pa.array([*found.values()], pa.int64())], names=["word", "n"])

    counts = docs.select(text).mapInArrow(released(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counts.collect()}


def prefix_index(items: list[tuple[str, list[bytes]]], size: int, count: dict[bytes, int]) -> dict:
    """{rarest word: {(its place, window length): {window: item ids}}}"""
    index: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for item, ws in items:
        for w in windows(ws, size):
            at = min(range(len(w)), key=lambda i: (count.get(w[i], 0), w[i], i))
            if count.get(w[at], 0):  # a window with a word that no document has occurs nowhere
                index[w[at]][at, len(w)][w].add(item)
    return {k: {p: dict(ws) for p, ws in v.items()} for k, v in index.items()}


def matches(ws: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged [start, end) runs of hit words, and the items that hit."""
    runs, items, n = [], set(), len(ws)
    for p, w in enumerate(ws):
        if w in index:
            for (at, m), known in index[w].items():
                s = p - at
                if s >= 0 and s + m <= n and (ids := known.get(tuple(ws[s : s + m]))):
                    runs.append((s, s + m))
                    items |= ids
    return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


RUNS, ITEMS = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 2 << 20, keep: list[str] | None = None) -> DataFrame:
    """One row for each document row: key, `keep`, n_words, n_hit, n_items, items, hits (runs of words), items_sha256, contaminated."""
    keep = [key, *(keep or [])]
    query = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    blocks = max(1, math.ceil((query.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / block_bytes))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = docs.select(*keep, F.col(text).alias("__text"), F.lit(None).cast("array<array<int>>").alias("__runs"), F.lit(None).cast("array<string>").alias("__items"))
    for k in range(blocks):
        rows = query.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()
        items = [(r.i, words(r.t)) for r in rows]
        count = rarity(docs, {w for _, ws in items for w in ws}, text) if items else {}
        index = docs.sparkSession.sparkContext.broadcast(prefix_index(items, window, count))
        out = one_block(out, index, keep, kept, k == blocks - 1)
    return out


def one_block(docs: DataFrame, index, keep: list[str], kept: str, last: bool) -> DataFrame:
    def run(batches):
        known = index.value
        for batch in batches:
            texts, runs, items, n = batch.column("__text"), [], [], []
            for t, r, i in zip(texts, batch.column("__runs").to_pylist(), batch.column("__items").to_pylist()):
                ws = words(t.as_py())
                now, ids = matches(ws, known)
                n.append(len(ws))
                runs.append(merged([*map(tuple, r or []), *now]))
                items.append(sorted({*(i or []), *ids}))
            columns = [batch.column(c) for c in keep]
            if not last:
                yield pa.RecordBatch.from_arrays([*columns, texts, pa.array(runs, RUNS), pa.array(items, ITEMS)], names=[*keep, "__text", "__runs", "__items"])
                continue
            hit = [sum(e - s for s, e in r) for r in runs]
            more = {
                "n_words": pa.array(n, pa.int64()), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array(map(len, items), pa.int64()), "items": pa.array(items, ITEMS), "hits": pa.array(runs, RUNS),
                "items_sha256": pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()), "contaminated": pa.array([h > 0 for h in hit], pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays([*columns, *more.values()], names=[*keep, *more])

    tail = "n_words long, n_hit long, n_items long, items array<string>, hits array<array<int>>, items_sha256 string, contaminated boolean" if last else "__text string, __runs array<array<int>>, __items array<string>"
    return docs.mapInArrow(released(run), f"{kept}, {tail}")
