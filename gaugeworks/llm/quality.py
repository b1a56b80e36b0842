"""Quality classifier: a linear-chain CRF labels every line good or bad.

A line's features are its own and those of the lines before and after it. The
CRF is fitted on lines that take their document's label, from a bounded sample
of labelled rows outside the held-out fold (`sample` documents of each label).
A document's score is the mean over its lines of the forward-backward
marginal of "good", weighted by line length.

Defined cases: a null text is the empty text; an empty text is one empty line
and gets its score; texts are scored whole; rows are scored one by one, so
repeated ids stay; labels that are null or whose id is null teach nothing; a
repeated labelled id teaches once a row; with no labels of one kind the score
is 1 or 0 throughout (1 with no labels at all). Scoring reads the text only;
further columns are not read, whatever their names; an empty table of documents
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import crf
from .common import held_out, released

CLASSES = np.zeros(256, np.int64)  # one-hot positions: 0 other
for i, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:?'\"-()", b"!", b"|", b"#$%&*@^~_=+<>/\\{}[]`"), 1):
    CLASSES[list(chars)] = i
CLASSES[128:] = 9
EDGES = np.array([1e-9, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.8])


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, characters by line, lines by document); features are 0/1 columns as active indices."""
    lines, counts, size, distinct, mean, same, again, ends = [], [], [], [], [], [], [], []
    for text in texts:
        own = text.split("\n")
        counts.append(len(own))
        lines += own
        seen: dict[str, int] = {}
        for x in own:
            seen[x] = seen.get(x, 0) + 1
        before = None
        for x in own:
            ws = x.split()
            n = len(ws)
            size.append(len(x))
            distinct.append(len(set(ws)) / n if n else 1.0)
            mean.append(len(x) / n if n else 0.0)
            same.append(x == before)
            again.append(seen[x] > 1 and n > 0)
            ends.append(x[-1:] in (".", "!", "?", ":"))
            before = x
    data = np.frombuffer(("\n".join(lines) + "\n").encode(), np.uint8)
    breaks = np.flatnonzero(data == 10)  # lines hold no line break of their own
    begins = np.concatenate([[0], breaks[:-1] + 1])
    length = breaks - begins
    line_of = np.repeat(np.arange(len(lines)), length + 1)
    counted = np.bincount(line_of * 10 + CLASSES[data], minlength=len(lines) * 10).reshape(-1, 10)
    share = counted[:, 1:] / np.maximum(length, 1)[:, None]
    n_size = np.array(size, np.int64)
    cols = [np.searchsorted(EDGES, share[:, k]) + 9 * k for k in range(9)]  # 9 x 9
    at = 81
    cols.append(at + np.minimum(np.log2(n_size + 1).astype(int), 10))
    at += 11
    cols.append(at + np.minimum((np.array(distinct) * 8).astype(int), 8))
    at += 9
    cols.append(at + np.minimum(np.array(mean, float).astype(int) // 2, 8))
    at += 9
    for flag in (same, again, ends):
        cols.append(at + np.array(flag, int))
        at += 2
    return np.stack(cols, 1).astype(np.int32), n_size, np.array(counts, np.int64)


WIDTH = 81 + 11 + 9 + 9 + 6  # own columns; then those of the line before and of the line after, each with a "none"


def neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    start = crf.starts_of(counts)
    before = np.concatenate([np.full((1, own.shape[1]), -1, own.dtype), own[:-1]])
    before[start] = -1
    after = np.concatenate([own[1:], np.full((1, own.shape[1]), -1, own.dtype)])
    after[start + counts - 1] = -1
    return np.concatenate([own, np.where(before < 0, 3 * WIDTH, before + WIDTH), np.where(after < 0, 3 * WIDTH + 1, after + 2 * WIDTH)], 1)


class Model:
    def __init__(self, weights, move, first):
        self.weights, self.move, self.first, self.constant = weights, move, first, None

    def scores(self, texts: list[str]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        out: list[float] = []
        for part in parts(texts):
            own, size, counts = line_features(part)
            active = neighbours(own, counts)
            emit = self.weights[active].sum(1)
            good = crf.marginals(emit, counts, self.move, self.first)[1][:, 1]
            weight = size + 1.0
            start = crf.starts_of(counts)
            out += (np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start)).clip(0, 1).tolist()
        return out


def parts(texts: list[str], most: int = 4_000_000):
    """Runs of texts of some characters; a longer text stands alone."""
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > most:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t) + 1
    if part:
        yield part


def fit(texts: list[str], labels: list[int], piece: int = 64, rounds: int = 120) -> Model:
    """Long documents are cut into sequences of `piece` lines; all their lines teach."""
    model = Model(None, None, None)
    if len(set(labels)) < 2:
        model.constant = float(labels[0]) if labels else 1.0
        return model
    own, _, counts = line_features(texts)
    active = neighbours(own, counts)
    label = np.repeat(np.array(labels, np.int64), counts)
    lengths = np.concatenate([[piece] * (c // piece) + [c % piece] * bool(c % piece) for c in counts.tolist()]).astype(np.int64)
    # what lines look like is learnt from each document alike, however long; which label follows which is counted line by line
    weight = np.repeat(1 / counts, counts) * len(label) / len(texts)
    weights = np.zeros((3 * WIDTH + 2, 2))
    flat = active.ravel()

    def gradient(diff):
        g = np.empty_like(weights)
        for s in range(2):
            g[:, s] = np.bincount(flat, np.repeat(diff[:, s], active.shape[1]), minlength=len(weights))
        return g

    return Model(*crf.train(lambda w: w[active].sum(1), gradient, weights, label, lengths, 2, rounds, weight=weight))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, key: str, text: str, label: str) -> list:
    """At most `sample` rows of each label: those with the smallest hash of the id."""
    known = labels.where(~held_out(key) & F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("__k"), F.col(label).alias("__y"), F.xxhash64(F.col(key)).alias("__h"))
    picked = [known.where(F.col("__y") == y).orderBy("__h", "__k").limit(sample) for y in (0, 1)]
    ids = [(r["__k"], r["__y"]) for p in picked for r in p.collect()]  # at most 2 * sample small rows
    if not ids:
        return []
    few = docs.sparkSession.createDataFrame(ids, known.select("__k", "__y").schema)
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(few), "__k")
    return rows.orderBy("__k", "__t").limit(4 * sample).collect()


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 800, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """key, `keep`, held_out, score, predicted."""
    rows = training_rows(docs, labels, sample, key, text, label)
    model = docs.sparkSession.sparkContext.broadcast(fit([r["__t"] or "" for r in rows], [r["__y"] for r in rows]))
    keep = [key, *(keep or [])]
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            scores = model.value.scores([t or "" for t in batch.column("__text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("__held"), pa.array(scores, pa.float64())], names=[*keep, "held_out", "score"])

    scored = docs.select(*keep, held_out(key).alias("__held"), F.col(text).alias("__text")).mapInArrow(released(run), f"{kept}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
