"""Language identification by a byte convolutional network, in numpy.

A text is cut into windows of `WINDOW` bytes that cover all of it; the last is
padded with zeros. Filters of several widths slide over a window's bytes; the
ReLU of each filter's largest response goes through a softmax layer. Windows
are scored in batches; a document's distribution is the mean of those of its
windows, weighted by their bytes.

A filter over bytes is a sum of table rows, one for each place; for speed the
rows of two neighbouring bytes are added up beforehand (bytes first go to 64
classes), which changes nothing in the result.

The network is trained by Adam on windows from a bounded sample of rows
outside the held-out fold (`sample` documents of each language, every language
with such a row).

Defined cases: `und` with score 0 for a null text or one without a letter;
rows whose language is null teach nothing; with no language to learn from
every text is `und`; texts are read whole, row by row, repeated ids stay; of
languages with equal scores the first by name is predicted; an empty table gives
no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import held_out, released
from .crf import Adam

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 8
#: Byte classes: ASCII letters fold to lower case, other ASCII to a few groups, bytes from 0x80 by their low six bits.
CLASS = np.zeros(256, np.int64)
for c in range(1, 256):
    CLASS[c] = 2 + (c | 32) - 97 if chr(c).isascii() and chr(c).isalpha() else 1 if c < 128 else 28 + (c & 63) % 36


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes by window and place, bytes by window, windows by text)"""
    n = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    data = np.frombuffer(b"".join(t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, n.tolist())), np.uint8).reshape(-1, WINDOW)
    size = np.full(len(data), WINDOW, np.int64)
    size[np.cumsum(n) - 1] = [len(t) - (k - 1) * WINDOW for t, k in zip(texts, n.tolist())]
    return CLASS[data], size, n


class Network:
    """tables[w]: width x 64 x FILTERS"""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [rng.normal(0, 0.3, (w, 64, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def responses(self, x: np.ndarray, w: int, table: np.ndarray) -> np.ndarray:
        places = x.shape[1] - w + 1
        r = table[0][x[:, :places]]
        for j in range(1, w):
            r += table[j][x[:, j : j + places]]
        return r

    def distributions(self, x: np.ndarray) -> np.ndarray:
        """By pair tables; x: windows x places."""
        top = []
        pair = x[:, :-1] * 64 + x[:, 1:]
        for w, t in zip(WIDTHS, self.tables):
            places = x.shape[1] - w + 1
            r = (t[0][:, None] + t[1][None]).reshape(-1, FILTERS)[pair[:, :places]]
            if w == 3:
                r += t[2][x[:, 2:]]
            if w == 4:
                r += (t[2][:, None] + t[3][None]).reshape(-1, FILTERS)[pair[:, 2:]]
            top.append(r.max(1))
        return softmax(np.maximum(np.concatenate(top, 1) + self.shift, 0) @ self.out + self.bias)

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int, batch: int = 128, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        adam = Adam([*self.tables, self.shift, self.out, self.bias], rate)
        for _ in range(rounds):
            at = rng.integers(0, len(x), min(batch, len(x)))
            xb, rows = x[at], np.arange(len(at))
            found = [self.responses(xb, w, t) for w, t in zip(WIDTHS, self.tables)]
            where = [r.argmax(1) for r in found]  # windows x filters
            h = np.concatenate([np.take_along_axis(r, k[:, None], 1)[:, 0] for r, k in zip(found, where)], 1) + self.shift
            act = np.maximum(h, 0)
            p = softmax(act @ self.out + self.bias)
            p[rows, y[at]] -= 1
            p /= len(at)
            dh = (p @ self.out.T) * (h > 0)
            grads = []
            for i, (w, k) in enumerate(zip(WIDTHS, where)):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                g = np.zeros_like(self.tables[i])
                for j in range(w):
                    np.add.at(g[j], (xb[rows[:, None], k + j], np.arange(FILTERS)[None]), d)
                grads.append(g)
            adam.step([*grads, dh.sum(0), act.T @ p + 1e-4 * self.out, p.sum(0)])

    def scores(self, texts: list[bytes], part: int = 1024) -> np.ndarray:
        """Distribution over the languages by text."""
        out = []
        for some in portions(texts):
            x, size, n = windows(some)
            p = np.concatenate([self.distributions(x[i : i + part]) for i in range(0, len(x), part)]) * (size + 1e-6)[:, None]
            total = np.add.reduceat(p, np.cumsum(n) - n)
            out.append(total / total.sum(1, keepdims=True))
        return np.concatenate(out)


def portions(texts: list[bytes], most: int = 2_000_000):
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > most:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t) + WINDOW
    if part:
        yield part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], rounds: int = 400, per_text: int = 12, seed: int = 7) -> Network | None:
    """Up to `per_text` windows of each text, evenly spread over it, teach."""
    known = sorted(set(langs))
    if not known:
        return None
    net = Network(known, seed)
    xs, ys = [], []
    for t, lang in zip(texts, langs):
        x, size, _ = windows([t.encode()])
        x = x[size >= min(16, int(size.max()))]
        xs.append(x[np.unique(np.linspace(0, len(x) - 1, min(per_text, len(x))).astype(int))])
        ys.append(np.full(len(xs[-1]), known.index(lang)))
    net.train(np.concatenate(xs), np.concatenate(ys), rounds)
    return net


def training_rows(docs: DataFrame, sample: int, key: str, text: str, lang: str) -> list:
    """At most `sample` texts of each language: those with the smallest hash of the id."""
    spark, kinds = docs.sparkSession, "__k " + docs.schema[key].dataType.simpleString() + ", __l " + docs.schema[lang].dataType.simpleString()
    known = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    hashed = known.select(F.col(key).alias("__k"), F.col(lang).alias("__l"), F.xxhash64(F.col(key)).alias("__h"))
    sizes = {r[0]: r[1] for r in hashed.groupBy("__l").count().collect()}

    def least(share: dict) -> list:
        """The rows chosen, looked for among that share of a language's hashes."""
        bounds = spark.createDataFrame([(v, -(2.0**63) + 2.0**64 * min(1.0, p)) for v, p in share.items()], kinds.split(", ")[1] + ", __b double")
        some = hashed.join(F.broadcast(bounds), "__l").where(F.col("__h") <= F.col("__b"))
        first = Window.partitionBy("__l").orderBy("__h", "__k")
        return some.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= sample).select("__k", "__l").collect()

    if not sizes:
        return []
    ids = least({v: 2 * sample / n for v, n in sizes.items()})
    found = Counter(r["__l"] for r in ids)
    if short := {v for v, n in sizes.items() if found[v] < min(sample, n)}:
        ids = [r for r in ids if r["__l"] not in short] + least(dict.fromkeys(short, 1.0))
    few = spark.createDataFrame(ids, kinds).distinct()
    rows = known.select(F.col(key).alias("__k"), F.col(lang).alias("__l"), F.col(text).alias("__t")).join(F.broadcast(few), ["__k", "__l"])
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("__l").orderBy("__k", "__t"))).where(F.col("__n") <= 4 * sample).drop("__n").orderBy("__k", "__l", "__t").collect()


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 250) -> DataFrame:
    """key, held_out, lang_pred, score."""
    rows = training_rows(docs, sample, key, text, lang)
    net = docs.sparkSession.sparkContext.broadcast(fit([r["__t"] for r in rows], [r["__l"] for r in rows]))

    def run(batches):
        known = net.value
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            judged = [i for i, t in enumerate(texts) if known and t and any(map(str.isalpha, t))]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            if judged:
                p = known.scores([texts[i].encode() for i in judged])
                for i, k, v in zip(judged, p.argmax(1).tolist(), p.max(1).tolist()):
                    pred[i], score[i] = known.langs[k], min(1.0, v)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("__held"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[key, "held_out", "lang_pred", "score"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return docs.select(key, held_out(key).alias("__held"), F.col(text).alias("__text")).mapInArrow(released(run), schema)
