"""Nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample (those with the smallest hash of the
id; `sample` rows, or `per_list` a list if that is more): k-means, after which a
list that holds more than `balance` times the mean of the sample is split. They
are joined into a graph (each with its nearest ones) that lives in memory and is
searched best-first in batches. Every vector is posted to its nearest list and,
as a boundary vector, to up to `copies` lists whose centroids are nearly as
near, unless an already chosen centroid is nearer to that centroid than the
vector is. A query reads its nearest list, and those whose centroids are within `ratio`
times the distance of its `base`-th nearest one, however many these are; if they
hold fewer than k candidates it reads all. (The distance of the very nearest one
varies too much to compare with.)

What ratio recall needs depends on the vectors and their number, so unless it is
given it is measured in each run: for `trial` rows that are no queries (those
with the smallest hash of the id) the true neighbours are found among all rows, and the ratio is
the least whose lists hold `target` of them. Vectors in clusters are pruned to
few lists; vectors without structure need a large share of all. An infinite
ratio reads all lists, which is exact.

Every row is indexed. Lists and their queries are dealt out in blocks of
bounded size, so a list with a third of all rows (equal vectors) is many tasks.
Distances are exact, in double precision, on the original vectors.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another dimension than the most
frequent one, nor rows with a null id; repeated ids are rows of their own (a copy with the
query's id is a candidate); ties go to the smaller id; fewer than k candidates are all returned; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, released


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


def kmeans(x: np.ndarray, k: int, balance: float, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        part = max(1, 8_000_000 // len(c))
        near = np.concatenate([squares(x[i : i + part], c).argmin(1) for i in range(0, len(x), part)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    more = []
    for j in np.flatnonzero(n > balance * len(x) / len(c)):
        own = x[near == j]
        parts = int(np.ceil(len(own) * len(c) / (balance * len(x))))
        more.append(kmeans(own, parts, np.inf, 4, seed + 1))
        c[j] = np.nan
    return np.concatenate([c[~np.isnan(c).any(1)], *more]) if more else c


class Graph:
    def __init__(self, centroids: np.ndarray, degree: int = 24, seed: int = 5):
        self.c, n = centroids, len(centroids)
        rng = np.random.default_rng(seed)
        near = np.concatenate([np.argsort(squares(centroids[i : i + 256], centroids), 1)[:, 1 : degree + 1] for i in range(0, n, 256)]) if n > 1 else np.zeros((n, 0), int)
        far = rng.integers(0, n, (n, 4))  # a few long edges keep the graph connected
        self.edges = np.concatenate([near, far], 1)
        self.entry = rng.permutation(n)[:16]
        self.norm = (centroids * centroids).sum(1)

    def search(self, x: np.ndarray, k: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids found and their distances, nearest first; best-first with a beam of `width`."""
        n, rows = len(self.c), np.arange(len(x))[:, None]
        k = min(k, n)
        width = min(n, width or max(k + k // 2, 16))
        seen = np.zeros((len(x), n), bool)
        seen[:, self.entry] = True
        ids = np.repeat(self.entry[None], len(x), 0)
        dist = squares(x, self.c[self.entry])
        done = np.zeros(ids.shape, bool)
        own = (x * x).sum(1)[:, None]
        while True:
            order = np.argsort(dist, 1)[:, :width]
            ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
            waiting = np.where(done, np.inf, dist)
            if np.isinf(waiting.min(1)).all():
                break
            step = np.argsort(waiting, 1)[:, :4]
            live = ~np.isinf(waiting[rows, step])
            done[rows, step] = True
            new = self.edges[ids[rows, step]].reshape(len(x), -1)
            fresh = ~seen[rows, new] & np.repeat(live, self.edges.shape[1], 1)
            first = np.sort(np.where(fresh, new, n), 1)
            first[:, 1:][first[:, 1:] == first[:, :-1]] = n
            most = int((first < n).sum(1).max(initial=0))
            first = np.sort(first, 1)[:, :most]
            real = first < n
            at = np.where(real, first, 0)
            r, cidx = np.nonzero(real)
            seen[r, first[r, cidx]] = True
            d = np.where(real, own - 2 * np.einsum("bd,bmd->bm", x, self.c[at]) + self.norm[at], np.inf)
            ids, dist, done = np.concatenate([ids, at], 1), np.concatenate([dist, np.maximum(d, 0)], 1), np.concatenate([done, ~real], 1)
        return ids[:, :k], np.sqrt(dist[:, :k])

    def postings(self, x: np.ndarray, copies: int, slack: float, spread: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs."""
        ids, dist = self.search(x, copies)
        keep = (dist <= (1 + slack) * dist[:, :1]) & np.isfinite(dist)
        for j in range(1, ids.shape[1]):
            for i in range(j):
                between = np.sqrt(((self.c[ids[:, i]] - self.c[ids[:, j]]) ** 2).sum(1))
                keep[:, j] &= ~(keep[:, i] & (spread * between < dist[:, j]))
        keep[:, 0] = True
        row, j = np.nonzero(keep)
        return row, ids[row, j]

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All centroids and their distances, nearest first; exact."""
        dist = squares(x, self.c)
        ids = np.argsort(dist, 1, kind="stable")
        return ids, np.sqrt(np.take_along_axis(dist, ids, 1))

    def probes(self, x: np.ndarray, ratio: float, base: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the lists within `ratio` times the distance of the `base`-th nearest one. The beam grows until it holds one that isn't."""
        n = len(self.c)
        k, base = max(32, 2 * base), min(base, n)
        while True:
            # where most lists are wanted the graph saves nothing
            ids, dist = self.search(x, k) if k < n / 4 else self.ranked(x)
            if ids.shape[1] == n or (dist[:, -1] > ratio * dist[:, base - 1]).all():
                break
            k *= 4
        keep = (dist <= ratio * dist[:, base - 1 : base]) & np.isfinite(dist)
        keep[:, 0] = True
        row, j = np.nonzero(keep)
        return row, ids[row, j]


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top(ids: np.ndarray, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties by id, then row."""
    if len(score) > k:
        bound = np.partition(score, k - 1)[k - 1]
        some = np.flatnonzero(score <= bound)
    else:
        some = np.arange(len(score))
    return some[np.lexsort([rows[some], ids[some], score[some]])[:k]]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fine).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (size[0].d if size else 0))


class Index:
    """Posting lists of `vectors`, and the ratio to search them with."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100, sample: int = 16_000, per_list: int = 8, most_lists: int = 16_384, balance: float = 2.0, copies: int = 2, slack: float = 0.1, ratio: float | None = None, base: int = 4, trial: int = 100, target: float = 0.95):
        self.k, self.base, self.spark = k, base, vectors.sparkSession
        self.rows = materialize(usable(vectors, key, vector).withColumn("row", F.monotonically_increasing_id()))
        self.n, self.kind = self.rows.count(), dict(self.rows.dtypes)["id"]
        self.queries, self.others = self.rows.where(F.col("id") % every == 0), self.rows.where(F.col("id") % every != 0)
        if not self.n:
            return
        lists = int(min(most_lists, max(1, 2 * np.sqrt(self.n))))
        sample = max(sample, per_list * lists)
        cut = self.rows.select(F.xxhash64("id").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        fitted = matrix(self.rows.where(F.xxhash64("id") <= cut).select("v").limit(2 * sample).toArrow().column("v"))
        self.graph = self.spark.sparkContext.broadcast(Graph(kmeans(fitted, min(lists, len(fitted)), balance)))  # at most 2 * most_lists vectors
        self.posted = materialize(self.listed(self.rows, lambda g, x: g.postings(x, copies, slack)))
        self.ratio = self.needed(trial, target) if ratio is None else ratio

    def listed(self, df: DataFrame, find) -> DataFrame:
        """`df` with a row for each list that find(graph, vectors) gives."""
        graph = self.graph

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    row, one = find(graph.value, matrix(part.column("v")))
                    part = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int32)), *part.columns], names=["list", *part.schema.names])

        return df.mapInArrow(released(run), "list int, " + ", ".join(f"`{c}` {t}" for c, t in df.dtypes))

    def asked(self) -> DataFrame:
        ratio, base = self.ratio, self.base
        return self.listed(self.queries, lambda g, x: g.probes(x, ratio, base))

    def needed(self, trial: int, target: float) -> float:
        """The ratio with which `trial` rows that are no queries find `target` of their true neighbours."""
        asked = self.others.orderBy(F.xxhash64("id"), "row").limit(trial).select("row", "v").toArrow()
        if not asked.num_rows:
            return 1.0
        own, y = asked.column("row").to_numpy(), matrix(asked.column("v"))
        q, row = true_neighbours(self.rows, own, y, self.k)
        if not len(q):
            return 1.0
        true = F.broadcast(self.spark.createDataFrame([(r,) for r in np.unique(row).tolist()], "row long"))
        where: dict[int, list[int]] = {}
        for r in self.posted.join(true, "row").select("row", "list").collect():  # at most trial * k * copies
            where.setdefault(r.row, []).append(r["list"])
        dist = np.sqrt(squares(y, self.graph.value.c))
        order = np.sort(dist, 1)
        far = np.maximum(order[:, min(self.base, order.shape[1]) - 1], 1e-12)
        # the nearest list is read in any case
        ratios = np.sort([0.0 if least <= order[i, 0] else least / far[i] for i, least in ((i, dist[i, where[r]].min()) for i, r in zip(q.tolist(), row.tolist()))])
        return float(ratios[int(np.ceil(target * len(ratios))) - 1] * (1 + 1e-6))

    def share_read(self) -> float:
        """Postings read by all queries, of rows times queries."""
        sizes = self.posted.groupBy("list").agg(F.count("*").alias("n"))
        return self.asked().groupBy("list").agg(F.count("*").alias("m")).join(sizes, "list").agg(F.sum(F.col("n") * F.col("m"))).first()[0] / (self.n * self.queries.count())

    def search(self, block: int = 20_000) -> DataFrame:
        """query_id, rank, vec_id, score."""
        if not self.n:
            return self.spark.createDataFrame([], f"query_id {self.kind}, rank int, vec_id {self.kind}, score double")
        k, result = self.k, f"q long, query_id {self.kind}, row long, vec_id {self.kind}, score double"
        found = materialize(scanned(self.posted, materialize(self.asked()), k, block, result))
        enough = found.groupBy("q").agg(F.count_distinct("row").alias("n"))
        short = self.queries.join(enough.where(F.col("n") >= min(k, self.n - 1)), F.col("row") == F.col("q"), "left_anti")
        if short.count():
            everywhere = self.listed(short, lambda g, x: (np.repeat(np.arange(len(x)), len(g.c)), np.tile(np.arange(len(g.c)), len(x))))
            found = found.unionByName(scanned(self.posted, materialize(everywhere), k, block, result))
        best = Window.partitionBy("q").orderBy("score", "vec_id", "row")
        ranked = found.dropDuplicates(["q", "row"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, block: int = 20_000, **options) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`; the options are those of Index."""
    return Index(vectors, key, vector, k, **options).search(block)


def true_neighbours(rows: DataFrame, own: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the query, row) of the k nearest rows of each of a few queries (row, vector), by brute force."""
    sent = rows.sparkSession.sparkContext.broadcast((own, y))

    def run(batches):  # one row a task: the k best of each query among the task's rows
        own, y = sent.value
        best = [(np.zeros(0, np.int64), None, np.zeros(0))] * len(own)
        for batch in batches:
            x, row, ids = matrix(batch.column("v")), batch.column("row").to_numpy(), batch.column("id").to_numpy(zero_copy_only=False)
            for i in range(len(own)):
                d = np.sqrt(((x - y[i]) ** 2).sum(1))
                d[row == own[i]] = np.inf
                some = top(ids, row, d, k)
                r, a, s = best[i]
                r, a, s = np.concatenate([r, row[some]]), ids[some] if a is None else np.concatenate([a, ids[some]]), np.concatenate([s, d[some]])
                some = top(a, r, s, k)
                some = some[np.isfinite(s[some])]
                best[i] = r[some], a[some], s[some]
        full = [(i, *b) for i, b in enumerate(best) if len(b[0])]
        if full:
            q = np.repeat([b[0] for b in full], [len(b[1]) for b in full])
            columns = [q, *(np.concatenate([b[j] for b in full]) for j in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array([c.tolist()], pa.list_(t)) for c, t in zip(columns, (pa.int64(), pa.int64(), kind, pa.float64()))], names=["q", "row", "id", "score"])

    kind = rows.limit(0).toArrow().schema.field("id").type
    parts = rows.mapInArrow(released(run), f"q array<long>, row array<long>, id array<{dict(rows.dtypes)['id']}>, score array<double>").toArrow()
    if not parts.num_rows:
        return np.zeros(0, int), np.zeros(0, int)
    q, row, ids, score = (parts.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("q", "row", "id", "score"))
    order = np.lexsort([row, ids, score, q])
    q, row = q[order], row[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], row[place < k]


def scanned(posted: DataFrame, asked: DataFrame, k: int, block: int, result: str) -> DataFrame:
    """Each list against its queries; the k best of each query in each block of the list."""
    sizes = posted.groupBy("list").agg(F.count("*").alias("n"))
    counts = asked.groupBy("list").agg(F.count("*").alias("m"))
    plan = {r["list"]: (-(-r.n // block), -(-r.m // block)) for r in sizes.join(counts, "list").collect()}  # a row a list, of which there is a bounded number
    if not plan:
        return posted.sparkSession.createDataFrame([], result)

    def blocks(i: int):
        split = {a: p for a, p in plan.items() if p[i] > 1}
        return F.element_at(F.create_map(*(F.lit(x) for a, p in sorted(split.items()) for x in (a, p[i]))), F.col("list")) if split else F.lit(None).cast("int")

    rows, asks = F.coalesce(blocks(0), F.lit(1)), F.coalesce(blocks(1), F.lit(1))
    p = posted.withColumn("part", F.pmod(F.xxhash64("row"), rows).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), asks - 1)))
    a = asked.withColumn("part", F.explode(F.sequence(F.lit(0), rows - 1))).withColumn("ask", F.pmod(F.xxhash64("row"), asks).cast("int"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        q, query, row, vec, score = [], [], [], [], []
        if left.num_rows and right.num_rows:
            x, y = matrix(left.column("v")), matrix(right.column("v"))
            lr, li, rr = left.column("row").to_numpy(), left.column("id").to_numpy(), right.column("row").to_numpy()
            for i, own in enumerate(y):
                d = np.sqrt(((x - own) ** 2).sum(1))
                d[lr == rr[i]] = np.inf
                best = top(li, lr, d, k)
                best = best[np.isfinite(d[best])]
                q += [rr[i]] * len(best)
                query += [right.column("id")[i].as_py()] * len(best)
                row += lr[best].tolist()
                vec += li[best].tolist()
                score += d[best].tolist()
        return pa.table({"q": pa.array(q, pa.int64()), "query_id": pa.array(query, left.schema.field("id").type), "row": pa.array(row, pa.int64()), "vec_id": pa.array(vec, left.schema.field("id").type), "score": pa.array(score, pa.float64())})

    keys = ["list", "part", "ask"]
    return p.groupBy(*keys).cogroup(a.groupBy(*keys)).applyInArrow(scan, result)
