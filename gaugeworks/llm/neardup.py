"""Near-duplicate documents by b-bit MinHash.

1. One pass over the texts gives each document its set size, a 128-bit
   fingerprint of its shingle set, band keys (`rows` minima each) and its b-bit
   signature: the low `BITS` bits of every minimum, packed.
2. Documents with equal sets form a class; what follows sees classes only, so a
   group of exact copies, however large, costs one row a task.
3. Classes that share a band key are candidates. All pairs within a bucket are
   never made: each class is first tried with one hub, the class with the
   largest buckets in sum (in a group of near copies that is the text the
   others come from), and those that stay outside their buckets' main component
   once more with the best hub among themselves. A pair within a component needs
   no test. The others (`residual`) are found exactly: a class is split into what
   some hub has too and what lies beyond all hubs. Two classes whose hub parts
   are large enough for a link meet in their buckets, with the partner's size as
   part of the join key; any other link needs a known number of shingles beyond
   the hubs in common, so such pairs meet at a shared one of these, ordered by
   rarity and cut by position (prefix filter). So no connection is lost.
4. A candidate's similarity is estimated from the matching b-bit values,
   corrected for chance matches (2^-BITS); pairs below `threshold - MARGIN`
   (six standard deviations) go, all others are confirmed on the full sets.
5. Components by alternating large-star and small-star steps, with a written
   table after each; hot keys are split by skew joins, minima pre-aggregated.

With 32 bands of 4 a pair at similarity 0.75 is missed with probability 5e-6.

Defined cases: a null or wordless text has an empty set, no links, and its own
id as component; fewer words than `shingle` make one shingle; a row with a null
id is linked like any other, its component is the smallest id reachable (null
if none is), and its `kept` is null, as `doc_id = component_id` is; rows that
share an id are documents of their own (each gets the smallest id that its text
reaches); an empty table gives no rows; further columns are not read. Texts are
used whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import joined_by_hot_keys, materialize, released

LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
U = np.uint64
BITS, MARGIN = 4, 0.25
#: Longer words are known by a digest: sums of powers agree for some different long words.
LONG = 64
BASE = 0x9E3779B97F4A7C15 | 1
CACHED = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64. Only the first `CACHED` are kept: a long text must not leave its share in the worker."""

    def made(size: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return out[0], out[1]

    if n > CACHED:
        return made(n)
    if base not in _powers:
        _powers[base] = made(CACHED)
    up, down = _powers[base]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def shingles(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = b"\n".join((t or "").encode().translate(LOWER) for t in texts) + b"\n"  # a line break ends each text
    raw = np.frombuffer(data, np.uint8)
    gap = (raw == 32) | (raw == 10)
    edge = np.diff(np.concatenate([[1], gap.view(np.int8)]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(raw) + 1)
    total = np.concatenate([[U(0)], np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)])])
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
    for i in np.flatnonzero(end - start > LONG).tolist():
        word[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    bound = np.searchsorted(start, np.flatnonzero(raw == 10))  # words before each text's end
    joined = np.zeros(max(0, len(word) - size + 1), U)
    for k in range(size):
        joined = joined * U(0xD6E8FEB86659FD93) + word[k : k + len(joined)]
    joined = mix(joined)
    out, a = [], 0
    for b in bound.tolist():
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            h = np.array([b - a], U)
            for w in word[a:b]:
                h = h * U(0xD6E8FEB86659FD93) + w
            out.append(mix(h))
        else:
            out.append(np.zeros(0, U))
        a = b
    return out


def families(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=U) * U(2) + U(1), rng.integers(0, 1 << 63, n, dtype=U)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """sets x n; no set may be empty."""
    every, start = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    a, b = families(n)
    return np.stack([np.minimum.reduceat((every * a[k] + b[k]) >> U(32), start) for k in range(n)], 1)


def portions(texts: list, most: int = 800_000):
    part, n = [], 0
    for t in texts:
        if part and n + len(t or "") > most:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t or "") + 1
    if part:
        yield part


def prints(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    signed = lambda x: int(np.int64(np.asarray(x, U).astype(np.int64)))
    return [signed(mix(s).sum(dtype=U)) for s in sets], [signed(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)) for s in sets]


def signatures(docs: DataFrame, key: str, text: str, shingle: int, bands: int, rows: int, keep: list[str]) -> DataFrame:
    """key, `keep`, __rid, n_shingles, f1, f2, bands (keys), bits (64-bit words of the packed signature)"""
    keep = [*keep, "__rid"]

    def run(batches):
        per = 64 // BITS
        for batch in batches:
            at = 0
            for some in portions(batch.column("__text").to_pylist()):
                sets = shingles(some, shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                f1, f2 = prints(sets)
                keys, packed = [[] for _ in sets], [[] for _ in sets]
                if full:
                    low = minima([sets[i] for i in full], bands * rows)
                    k = np.zeros((len(full), bands), U) + np.arange(bands, dtype=U) * U(0x9E3779B97F4A7C15)
                    for r in range(rows):
                        k = mix(k * U(0x2545F4914F6CDD1D) + low[:, r::rows])
                    pad = -low.shape[1] % per
                    small = np.pad(low & U((1 << BITS) - 1), ((0, 0), (0, pad))).reshape(len(full), -1, per)
                    words = (small << (np.arange(per, dtype=U) * U(BITS))).sum(2, dtype=U)
                    for i, kk, ww in zip(full, k.astype(np.int64).tolist(), words.astype(np.int64).tolist()):
                        keys[i], packed[i] = kk, ww
                ids = [batch.column(c).slice(at, len(some)) for c in (key, *keep)]
                at += len(some)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([*ids, pa.array(map(len, sets), pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, longs), pa.array(packed, longs)], names=[key, *keep, "n_shingles", "f1", "f2", "bands", "bits"])

    source = docs.select(key, *keep[:-1], row_id(key, text).alias("__rid"), F.col(text).alias("__text"))
    kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in (key, *keep))
    schema = f"{kept}, n_shingles long, f1 long, f2 long, bands array<long>, bits array<long>"
    return source.mapInArrow(released(run), schema)


def row_id(key: str, text: str) -> Column:
    """128 bits of a row's id and text: of 4e10 rows no two share them by chance."""
    return F.struct(F.xxhash64(F.col(key), F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(key), F.col(text)).alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v. Returns node, root (the component's smallest node) for all nodes but the roots."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        near = both.join(low, "u")
        if large:
            return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    digest = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = None
    while (now := digest(e)) != before:
        before = now
        e = materialize(star(star(e, True), False))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def estimate(a: str, b: str, hashes: int) -> F.Column:
    """Similarity from packed signatures: the share of equal values, less what chance gives."""
    ones = sum(1 << i for i in range(0, 64, BITS))
    ones -= 1 << 64 if ones >= 1 << 63 else 0

    def differing(x, y):
        d = x.bitwiseXOR(y)
        for s in (1, 2):  # any differing bit of a value shows in its lowest one
            d = d.bitwiseOR(F.shiftrightunsigned(d, s))
        return F.bit_count(d.bitwiseAND(F.lit(ones)))

    equal = 1 - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, n: acc + n) / hashes
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def measured(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, threshold: float, hashes: int, near_only: bool = True) -> DataFrame:
    """u, v, linked, common (size of the intersection), extra (what u has and v hasn't) of the pairs (u, v) whose estimate is near enough, or of all.

    Texts travel rather than sets, which are larger and don't compress; a hub's text goes to many tasks.
    """
    small = lambda c: classes.select(F.col("vid").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
    near = materialize(pairs)
    if near_only:
        hubs = near.groupBy("v").agg(F.count("*").alias("n"))
        both = joined_by_hot_keys(near.join(small("u"), "u"), hubs, ["v"], F.col("u"), other=hubs.join(small("v"), "v").drop("n"))
        alike = (F.least("nu", "nv") >= threshold * F.greatest("nu", "nv")) & (estimate("bu", "bv", hashes) >= threshold - MARGIN)
        near = materialize(both.where(alike).select("u", "v"))
    hubs = materialize(near.groupBy("v").agg(F.count("*").alias("n")))
    named = lambda c: texts.select(F.col("vid").alias(c), F.col("text").alias(f"t{c}"))
    full = joined_by_hot_keys(near.join(named("u"), "u"), hubs, ["v"], F.col("u"), other=hubs.join(named("v"), "v").select("v", "tv"))
    percent = round(threshold * 100)

    def run(batches):
        last, y = None, None
        for batch in batches:
            at, v, of = 0, batch.column("v").to_pylist(), batch.column("tv")
            for some in portions(batch.column("tu").to_pylist()):
                linked, common, extra = [], [], []
                for i, x in enumerate(shingles(some, shingle), at):
                    if v[i] != last:
                        last, y = v[i], shingles([of[i].as_py()], shingle)[0]
                    own = np.setdiff1d(x, y, assume_unique=True)
                    both = len(x) - len(own)
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
                    common.append(both)
                    extra.append(own.tobytes())
                ids = [batch.column(c).slice(at, len(some)) for c in ("u", "v")]
                at += len(some)
                yield pa.RecordBatch.from_arrays([*ids, pa.array(linked, pa.bool_()), pa.array(common, pa.int64()), pa.array(extra, pa.binary())], names=["u", "v", "linked", "common", "extra"])

    return full.select("u", "v", "tu", "tv").mapInArrow(released(run), "u long, v long, linked boolean, common long, extra binary")


def texts_elements(rows: DataFrame, shingle: int) -> DataFrame:
    """vid, e for each shingle e of vid's `text`."""

    def run(batches):
        for batch in batches:
            at = 0
            for some in portions(batch.column("text").to_pylist()):
                sets = shingles(some, shingle)
                vid = batch.column("vid").slice(at, len(some)).to_numpy()
                at += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(vid, [len(x) for x in sets])), pa.array(np.concatenate(sets).astype(np.int64))], names=["vid", "e"])

    return rows.select("vid", "text").mapInArrow(released(run), "vid long, e long")


def elements(rows: DataFrame) -> DataFrame:
    """vid, e for each element of vid's packed set `part`."""

    def run(batches):
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("part")]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("vid").to_numpy(), [len(x) for x in parts])), pa.array(np.concatenate(parts))], names=["vid", "e"])

    return rows.select("vid", "part").mapInArrow(released(run), "vid long, e long")


def beyond_hubs(open_ids: DataFrame, delta: DataFrame, texts: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(vid, inner), (vid, e, f): how many elements of a class some hub has too; its others, if they occur again, with their number of classes.

    Two classes share at most the smaller `inner` of elements that hubs have, and all else they share is among the
    second table's rows. A class without a hub counts as one itself: it has no row in either table.
    """
    known = delta.join(open_ids, F.col("u") == F.col("vid"), "left_semi")
    whole = open_ids.join(known.select("u"), F.col("vid") == F.col("u"), "left_anti").unionByName(known.select(F.col("v").alias("vid"))).distinct()
    own = materialize(elements(known.select(F.col("u").alias("vid"), F.col("extra").alias("part"))))
    hubs = texts_elements(texts.join(whole, "vid", "left_semi"), shingle)
    stats = own.select("e", F.lit(1).alias("f"), F.lit(0).alias("hub")).unionByName(hubs.select("e", F.lit(0).alias("f"), F.lit(1).alias("hub"))).groupBy("e").agg(F.sum("f").alias("f"), F.max("hub").alias("hub")).where("f > 1 OR (f = 1 AND hub = 1)")
    again = materialize(own.join(stats, "e"))
    counted = again.groupBy("vid").agg(F.sum("hub").alias("more"))
    inner = known.select(F.col("u").alias("vid"), "common").join(counted, "vid", "left").select("vid", (F.col("common") + F.coalesce("more", F.lit(0))).alias("inner"))
    return inner, again.where("hub = 0").select("vid", "e", "f")


def residual(sized: DataFrame, outer: DataFrame, threshold: float) -> DataFrame:
    """u, v: every pair of different components that share a bucket and can be linked.

    sized: bucket, vid, root, main, n, inner. A link needs |u & v| >= share * (|u| + |v|).
    """
    share = threshold / (1 + threshold)
    step = lambda n: F.floor(F.log(n) / np.log(1.02)).cast("int")
    # the hub parts alone may do: this bounds the partner's size, and sizes are a join key
    upper = F.least(F.col("n") / threshold, F.col("inner") / share - F.col("n"))
    u = sized.where("root <> main").withColumn("upper", upper + 1e-6).where(F.col("upper") >= threshold * F.col("n") - 1e-6)
    u = u.select("bucket", F.col("vid").alias("u"), F.col("root").alias("ru"), F.col("n").alias("nu"), F.col("inner").alias("mu"), "main", F.explode(F.sequence(step(F.greatest(threshold * F.col("n") - 1e-6, F.lit(1.0))), step(F.greatest("upper", F.lit(1.0))))).alias("size"))
    v = sized.select("bucket", F.col("vid").alias("v"), F.col("root").alias("rv"), F.col("n").alias("nv"), F.col("inner").alias("mv"), step(F.col("n")).alias("size"))
    # from both sides a pair outside the main component is needed once only
    inside = u.join(v, ["bucket", "size"]).where((F.col("ru") != F.col("rv")) & ((F.col("rv") == F.col("main")) | (F.col("u") < F.col("v")) | (F.col("mv") / share - F.col("nv") + 1e-6 < F.col("nu"))) & (F.least("mu", "mv") + 1e-6 >= share * (F.col("nu") + F.col("nv"))))
    # or they don't: then enough of what lies beyond the hubs is shared, and the first shared element has the rest behind it
    of = Window.partitionBy("vid")
    ranked = outer.withColumn("left", F.count("*").over(of) - F.row_number().over(of.orderBy("f", "e")) + 1).select("vid", "e", "left")
    places = sized.groupBy("vid").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("inner").alias("inner"), F.max(F.col("root") != F.col("main")).alias("open"))
    side = materialize(ranked.join(places, "vid"))
    named = lambda c: side.select("e", F.col("vid").alias(c), F.col("root").alias(f"r{c}"), F.col("n").alias(f"n{c}"), F.col("inner").alias(f"m{c}"), F.col("left").alias(f"l{c}"), F.col("open").alias(f"o{c}"))
    needed = share * (F.col("nu") + F.col("nv")) - F.least("mu", "mv")
    fits = (F.least("nu", "nv") + 1e-6 >= threshold * F.greatest("nu", "nv")) & (needed > 0) & (F.least("lu", "lv") + 1e-6 >= needed)
    outside = named("u").where("ou").join(named("v"), "e").where((F.col("ru") != F.col("rv")) & fits & (~F.col("ov") | (F.col("u") < F.col("v"))))
    pairs = inside.select("u", "v").unionByName(outside.select("u", "v"))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def class_texts(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """vid, text of the classes in `wanted` (vid, id, rid), read again from one of their rows; once for each row that is repeated."""
    rows = docs.select(F.col(key).alias("__id"), row_id(key, text).alias("rid"), F.col(text).alias("text"))
    return rows.join(wanted.select("vid", "id", "rid"), "rid").where(F.col("id").eqNullSafe(F.col("__id"))).select("vid", "text")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.75, bands: int = 32, rows: int = 4, keep: list[str] | None = None) -> DataFrame:
    """key, `keep`, n_shingles, component_id, kept: one row for each row of `docs`."""
    return grouped(docs, key, text, shingle, threshold, bands, rows, keep).drop("__group", "__rid")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.75, bands: int = 32, rows: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Like near_duplicates, with the digest of id and text in `__rid` and the group's number in `__group` (null for rows that are in none): groups can share a component_id where ids repeat."""
    keep = keep or []
    sig = materialize(signatures(docs, key, text, shingle, bands, rows, keep))
    hashes = bands * rows
    one = F.struct(F.col(key).isNull().alias("nameless"), F.col(key).alias("id"), F.col("__rid").alias("rid"), "n_shingles", "bands", "bits")
    alike = sig.where(F.col("n_shingles") > 0).groupBy("f1", "f2").agg(F.min(one).alias("s"))
    classes = materialize(alike.select(F.monotonically_increasing_id().alias("vid"), "f1", "f2", "s.*"))
    links = linked(docs, classes, key, text, shingle, threshold, hashes)
    root = components(links)
    rooted = classes.join(root, F.col("vid") == F.col("node"), "left").select("f1", "f2", "id", F.coalesce("root", "vid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("least"))
    named = rooted.join(least, "root").select("f1", "f2", "least", "root")
    out = sig.select(key, *keep, "__rid", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    member = F.col("n_shingles") > 0
    component = F.when(member, F.col("least")).otherwise(F.col(key))
    return out.select(key, *keep, "__rid", "n_shingles", component.alias("component_id"), F.when(member, F.col("root")).alias("__group")).withColumn("kept", F.col(key) == F.col("component_id"))


def linked(docs: DataFrame, classes: DataFrame, key: str, text: str, shingle: int, threshold: float, hashes: int) -> DataFrame:
    """Confirmed pairs (u, v) of classes, enough to connect every two that are connected."""
    placed = classes.select("vid", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    placed = materialize(placed.join(shared, "bucket"))
    weight = placed.groupBy("vid").agg(F.sum("n").alias("w"))
    placed = materialize(placed.join(weight, "vid"))  # bucket, vid, n, w
    wanted = classes.join(placed.select("vid").distinct(), "vid", "left_semi")
    texts = materialize(class_texts(docs, wanted, key, text))
    if texts.count() > wanted.count():  # repeated rows
        texts = materialize(texts.dropDuplicates(["vid"]))
    wanted = wanted.select("vid", "n_shingles", "bits")
    check = lambda pairs, near_only=True: materialize(measured(pairs, wanted, texts, shingle, threshold, hashes, near_only))
    best = F.max(F.struct("w", (-F.col("vid")).alias("minus"))).alias("hub")

    def starred(rows: DataFrame) -> DataFrame:
        """u, v: each class with the best hub of its buckets."""
        hubs = rows.groupBy("bucket").agg(best)
        first = rows.join(hubs, "bucket").groupBy("vid").agg(F.max("hub").alias("hub"))
        return first.select(F.col("vid").alias("u"), (-F.col("hub.minus")).alias("v")).where("u <> v")

    def mixed(links: DataFrame) -> DataFrame:
        """Places in buckets of several components, with the bucket's main one."""
        root = components(links)
        now = placed.select("bucket", "vid", "w").join(root, F.col("vid") == F.col("node"), "left").select("bucket", "vid", "w", F.coalesce("root", "vid").alias("root"))
        main = now.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        return now.join(main.select("bucket", F.col("main.root").alias("main")), "bucket")

    first = materialize(starred(placed))
    delta = check(first)
    links = delta.where("linked").select("u", "v")
    apart = mixed(links).where("root <> main").select("bucket", "vid")
    sizes = apart.groupBy("bucket").agg(F.count("*").alias("n"))
    again = apart.join(sizes, "bucket")
    again = again.join(again.groupBy("vid").agg(F.sum("n").alias("w")), "vid")
    links = materialize(links.unionByName(check(starred(again)).where("linked").select("u", "v")))
    open_ = materialize(mixed(links))
    ids = materialize(open_.select("vid").distinct())
    if not ids.limit(1).count():
        return links
    unmeasured = first.join(ids, F.col("u") == F.col("vid"), "left_semi").join(delta.select("u"), "u", "left_anti")
    delta = delta.unionByName(check(unmeasured, near_only=False))
    inner, outer = beyond_hubs(ids, delta, texts, shingle)
    sized = open_.join(wanted.select("vid", F.col("n_shingles").alias("n")), "vid").join(inner, "vid", "left").withColumn("inner", F.coalesce("inner", "n"))
    sized = materialize(sized.select("bucket", "vid", "root", "main", "n", "inner"))
    rest = check(residual(sized, outer, threshold))
    return links.unionByName(rest.where("linked").select("u", "v"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay: one of each group, with the smallest id and among equal ids the smallest row digest."""
    found = materialize(grouped(docs, key, text, **options).select("__rid", "__group", F.col(key).eqNullSafe(F.col("component_id")).alias("first")))
    kept = found.where("first AND __group IS NOT NULL")
    # of a group that keeps several rows, all ids equal, those of one digest stay
    several = kept.groupBy("__group").agg(F.min("__rid").alias("least"), F.max("__rid").alias("last")).where("least < last")
    gone = found.where("NOT first").select("__rid")
    if several.limit(1).count():
        gone = gone.unionByName(kept.join(several, "__group").where("__rid > least").select("__rid"))
    out = docs.withColumn("__rid", row_id(key, text)).join(gone.distinct(), "__rid", "left_anti")
    again = kept.groupBy("__rid").count().where("count > 1").select("__rid")
    if again.limit(1).count():
        out = out.join(again, "__rid", "left_anti").unionByName(out.join(again, "__rid", "left_semi").dropDuplicates(["__rid"]))
    return out.select(*docs.columns)
