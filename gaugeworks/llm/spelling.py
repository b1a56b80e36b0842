"""Spelling variants: words one edit apart, by shared-prefix and shared-suffix blocks of the vocabulary.

Words are runs of A-Z, a-z and U+00C0 to U+00FF (only A-Z is lower-cased) of at least `least` code points that occur at
least twice. Two words are near if one inserted, deleted or replaced code point makes one the other. One edit leaves a half of
the longer word intact, so two near words share the first half or the second: they meet in a block of words with
one prefix (of the forward dictionary) or one suffix (of the reversed one). A block with more than `most` words is
subdivided: what is left between the shared prefix and the shared suffix is halved again, and the edit lies in one half, the
other being shared. That ends when one code point is left: such a block holds words that are all near to each other, one for each letter of the alphabet at most.
`most` only says how a block is worked, not what is found. Blocks are counted before their rows meet, the words of each are compared
with those that follow in it, and a word leaves a block with its count of near words and the best of them, never with pairs. A pair that meets in several
blocks counts in the one that covers the first place where the words differ.

A word's form is its near word with the largest n (ties: the first in code-point order), if that is `ratio` times its own or more; its root is where forms lead in the end
(n grows at each step, so they end). Null texts have no words; a null doc_id is the empty text in the check sum; repeated rows count again. An empty table has no words.
Texts are read in pieces, so a very long one needs memory for itself and its distinct words; very long words are compared without matrices. Other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import joined_by_hot_keys, materialize, released

RUN = re.compile(rb"(?:[a-z]++|(?:\xc3[\x80-\xbf])++)++")
APART = re.compile(rb"[^a-z\x80-\xbf\xc3]")
PIECE = 1 << 22
HELD = 200_000
#: Longer words aren't laid out as matrices; matrices have so many cells at most.
WIDE, CELLS = 256, 1 << 22


def pieces(data: bytes) -> Iterator[Counter]:
    """Runs of a text with their counts, from a piece of it at a time, cut between runs."""
    at = 0
    while at < len(data):
        cut = APART.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield Counter(RUN.findall(data, at, end))
        at = end


def misspelt(run: bytes, h: int) -> str:
    word = run.decode()
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def counted(least: int, every: int):
    def run(batches):
        held: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                first = zlib.crc32(((doc_id.as_py() or "") + ":").encode())
                for found in pieces((text.as_py() or "").encode("utf-8", "surrogatepass").lower()):
                    for one, n in found.items():
                        if len(one) >= least:
                            h = zlib.crc32(one, first)
                            word = misspelt(one, h) if h % every == 0 else one.decode()
                            if len(word) >= least:
                                held[word] += n
                    if len(held) > HELD:
                        yield out()
        yield out()

    return run


def vocabulary(docs: DataFrame, least: int = 7, every: int = 31, often: int = 2) -> DataFrame:
    """word, n. Counts are made in each task before they are shuffled."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    words = rows.mapInArrow(released(counted(least, every)), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def keyed(rows: DataFrame) -> DataFrame:
    """A block: length of the longer word, lengths of the shared prefix and suffix, and both."""
    return rows.withColumn("key", F.expr("concat(lpad(size, 9, '0'), ':', p, ':', s, ':', left(word, p), right(word, s))"))


def halved(rows: DataFrame) -> DataFrame:
    """Each row in the two blocks that halve what its block leaves open."""
    open_ = F.col("size") - F.col("p") - F.col("s")
    half = F.floor(open_ / 2).cast("int")
    both = F.array(F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s")), F.struct(F.col("p").alias("p"), (F.col("s") + open_ - half).cast("int").alias("s")))
    return keyed(rows.select("word", "n", "size", F.explode(both).alias("b")).select("word", "n", "size", "b.p", "b.s"))


def blocks(words: DataFrame, most: int = 64) -> DataFrame:
    """Rows of all blocks that can hold near words, each of at most `most` words or with one open place."""
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("size"), F.lit(0).alias("p"), F.lit(0).alias("s"))
    ready = []
    while True:
        rows = materialize(halved(rows))
        counts = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        met = materialize(joined_by_hot_keys(rows, materialize(counts), ["key"], F.col("word"), "m"))
        small = f"m <= {most} OR size - p - s <= 1"
        ready.append(met.where(small).drop("m"))
        rows = met.where(f"NOT ({small})").drop("m")
        if not rows.limit(1).count():
            break
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out


def near_pairs(words: list[bytes], block: np.ndarray, size: int, p: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of near words of one block each. Rows of a block stand together, all blocks being of one `size`."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    last = np.r_[np.flatnonzero(np.diff(block)), n - 1]
    after = last[np.searchsorted(last, np.arange(n))] - np.arange(n)
    left = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
    right = np.frombuffer(b"".join(w.rjust(size, b"\0") for w in words), np.uint8).reshape(n, size)[:, ::-1]
    one, two = [], []
    for d in range(1, int(after.max(initial=0)) + 1):
        i = np.flatnonzero(after >= d)
        i = i[np.maximum(lengths[i], lengths[i + d]) == size]
        ahead = (left[i] != left[i + d]).argmax(1)  # different words differ somewhere
        good = (ahead >= p[i]) & (ahead < size - s[i])
        i, ahead = i[good], ahead[good]
        behind = (right[i] != right[i + d]).argmax(1)
        i = i[ahead + behind >= size - 1]
        one.append(i)
        two.append(i + d)
    return (np.concatenate(one), np.concatenate(two)) if one else (np.empty(0, np.int64), np.empty(0, np.int64))


def common(a: bytes, b: bytes) -> int:
    """Length of the shared prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def near_pairs_of_long_words(words: list[bytes], block: np.ndarray, size: int, p: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = []
    for i, a in enumerate(words):
        j = i + 1
        while j < len(words) and block[j] == block[i]:
            if max(len(a), len(words[j])) == size:
                ahead = common(a, words[j])
                if p[i] <= ahead < size - s[i] and ahead + common(a[::-1], words[j][::-1]) >= size - 1:
                    pairs.append((i, j))
            j += 1
    return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)


def compared(batches):
    """Per row of a block: how many words of it are near, and the best of them. Rows come sorted by key; a block may span batches."""
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table):
        keys = np.array(table.column("key").to_pylist(), object)
        block = np.r_[0, np.cumsum(keys[1:] != keys[:-1])]
        size, p, s, n = (table.column(c).to_numpy() for c in ("size", "p", "s", "n"))
        words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        start = 0
        edges = np.r_[np.flatnonzero(np.diff(block)) + 1, len(block)]
        while start < len(words):
            # whole blocks of one size, as many as fit
            same = np.searchsorted(size, size[start], "right")
            room = max(start + max(1, CELLS // int(size[start])), edges[np.searchsorted(edges, start, "right")])
            end = int(edges[np.searchsorted(edges, min(same, room), "right") - 1])
            part = slice(start, end)
            find = near_pairs if size[start] <= WIDE else near_pairs_of_long_words
            i, j = find(words[part], block[part], int(size[start]), p[part], s[part])
            if len(i):
                i, j = np.r_[i, j] + start, np.r_[j, i] + start
                place = {w: k for k, w in enumerate(sorted({words[x] for x in np.unique(j)}))}
                rank = np.fromiter((place[words[x]] for x in j), np.int64, len(j))
                order = np.lexsort((rank, -n[j], i))
                i, j = i[order], j[order]
                me, at, near = np.unique(i, return_index=True, return_counts=True)
                best = j[at]
                yield pa.RecordBatch.from_arrays([pa.array([words[x].decode("latin-1") for x in me], pa.string()), pa.array(near, pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[x].decode("latin-1") for x in best], pa.string())], names=["word", "near", "best_n", "best"])
            start = end

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        cut = batch.num_rows
        while cut and keys[cut - 1] == keys[batch.num_rows - 1]:
            cut -= 1
        # the last block of a batch may go on in the next
        if cut or (held and held[-1].column("key")[-1] != keys[0]):
            if cut:
                held.append(batch.slice(0, cut))
            yield from out(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from out(pa.Table.from_batches(held))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: forms are followed to the end, twice as far in each round (a form has ten times the occurrences, so rounds are few)."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        further = now.alias("a").join(now.select(F.col("word").alias("w"), F.col("root").alias("r")), F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("w").isNotNull().alias("moved"))
        further = materialize(further)
        now = further.drop("moved")
        if not further.where("moved").limit(1).count():
            return now


def variants(docs: DataFrame, least: int = 7, every: int = 31, often: int = 2, ratio: int = 10, most: int = 64) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row a word."""
    words = materialize(vocabulary(docs, least, every, often))
    met = blocks(words, most).repartition("key").sortWithinPartitions("key").mapInArrow(released(compared), "word string, near long, best_n long, best string")
    near = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("b"))
    rows = words.join(near, "word", "left")
    counts = F.when(-F.col("b.m") >= ratio * F.col("n"), -F.col("b.m"))
    judged = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), counts.alias("form_n"), F.when(counts.isNotNull(), F.col("b.best")).alias("form")))
    ends = roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
