"""Near-duplicates, repeated passages, decontamination and the classifiers against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gaugeworks.llm import ann, decontaminate, langid, neardup, quality, registry, repeats

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_components(rows):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def copies(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base, rows = [rng.choice(vocabulary) for _ in range(120)], []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[f"x{rng.randrange(10**6)}"], [], [w[k], f"y{rng.randrange(30)}"]])
        rows.append((i * 3 % 487 + 1, "  ".join(w) if i % 2 else " ".join(w).upper()))
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows += [(5000 + i, " ".join([rng.choice(vocabulary) for _ in range(40)] + passage)) for i in range(40)]
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "ONE  two"), (9006, "one two three"), (9007, rows[3][1]), (9008, rows[3][1])]


def test_near_duplicates(spark):
    rows = copies()
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, bucket int")
    got = sorted(tuple(r) for r in neardup.near_duplicates(df).collect())
    assert got == plain_components(rows)


def families(seed=3):
    """Families of near copies that all are too far from the text they come from, some from two texts, linked through their own edits only."""
    rng = random.Random(seed)
    word = lambda: f"z{rng.randrange(10**7)}"
    rows, texts = [], [[word() for _ in range(140)] for _ in range(2)]
    for f in range(24):
        w = list(texts[f % 2])
        for k in rng.sample(range(0, 140, 6), rng.randint(3, 8)):
            w[k] = word()
        w = w[: rng.choice([100, 120, 140])]
        for _ in range(rng.randint(2, 9)):
            v = list(w)
            for k in rng.sample(range(len(v)), rng.randint(0, 3)):
                v[k] = rng.choice([word(), f"q{f}"])
            rows.append((len(rows) * 7 % 1009 + 1, " ".join(v)))
    for t in texts:
        for _ in range(25):
            v = list(t)
            for k in rng.sample(range(140), 2):
                v[k] = word()
            rows.append((len(rows) * 7 % 1009 + 1, " ".join(v)))
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_in_families(spark, seed):
    rows = families(seed)
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_components(rows)
    assert 4 < len({r[2] for r in got}) < 60


def test_near_duplicates_defined_cases(spark):
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (2, "h i j k l m n"), (2, "h i j k l m n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == {(None, 1, None): 1, (1, 1, True): 1, (2, 1, False): 1, (2, 2, True): 2}
    assert sorted((r.doc_id or 0, r.text[0]) for r in neardup.without_near_duplicates(df).collect()) == [(1, "a"), (2, "h")]
    nameless = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (None, "x y z"), (None, None), (None, "")], df.schema)
    assert {tuple(r) for r in neardup.near_duplicates(nameless).collect()} == {(None, 3, None, None), (None, 1, None, None), (None, 0, None, None)}
    assert sorted(str(r.text) for r in neardup.without_near_duplicates(nameless).collect()) == ["", "None", "a b c d e f g", "x y z"]
    assert neardup.near_duplicates(df.where("false")).count() == 0


def as_sql(rows):
    """OP8_SQL's rows for documents (doc_id, text)."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return collections.Counter(con.execute(registry.SQL["op8_near_duplicates"]).fetchall())


def test_near_duplicates_through_a_row_without_id(spark):
    """1 and 2 are alike to the row without an id, not to each other."""
    w = [f"w{i}" for i in range(104)]
    one, two = w[2:50] + ["x1"] + w[51:75] + ["x2"] + w[76:], w[2:30] + ["y1"] + w[31:90] + ["y2"] + w[91:]
    rows = [(1, " ".join(one)), (None, " ".join(w[2:])), (2, " ".join(two)), (3, "other words " * 4), (None, "other words " * 4 + "end")]
    got = collections.Counter(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == as_sql(rows) and got[2, 98, 1, False]


def test_different_long_words_are_different(spark):
    """Thue-Morse words and their complements: sums of powers modulo 2^64 cannot tell them apart."""
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = ("".join("ab"[b ^ k] for b in thue[:1024]) for k in (0, 1))
    rows = [(i, f"{a} {b} {a} {c}") for i, (a, b, c) in enumerate([(one, "p", "q"), (other, "p", "q"), (one, other, one), (other, one, other)])]
    got = collections.Counter(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == as_sql(rows) and len({r[2] for r in got}) == 4


def test_one_row_of_a_group_stays_where_its_id_repeats(spark):
    words = [f"w{i}" for i in range(80)]
    edited = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(5, 75, 10)]
    rows = [(1, t) for t in edited] + [(1, "one other text of this id " * 3)] * 2 + [(2, edited[0]), (3, None), (None, edited[1])]
    got = [(r.doc_id, r.text) for r in neardup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(t in edited for i, t in got if i == 1) == 1
    assert collections.Counter(x for x in got if x[1] not in edited or x[0] is None) == collections.Counter([(1, rows[7][1]), (3, None)])
    assert len(got) == 3


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def plain_repeats(rows, length):
    seen = collections.Counter(d[s : s + length] for d in ((t or "").encode() for _, t in rows) for s in range(len(d) - length + 1))
    out = []
    for i, t in rows:
        d = (t or "").encode()
        mask = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                mask[s : s + length] = b"\1" * length
        rest = bytes(x for x, y in zip(d, mask) if not y)
        out.append((i, len(d), sum(mask), sum(1 for k, m in enumerate(mask) if m and (k == 0 or not mask[k - 1])), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [2000, 6, 2])
def test_repeats(spark, bucket):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abc déf") for _ in range(n))
    passages = [some(rng.randint(150, 600)) for _ in range(8)]
    rows = [(i, some(rng.randint(0, 200)) + rng.choice(passages)[rng.randint(0, 60) :] + some(rng.randint(0, 90)) + rng.choice(passages) + some(20)) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "x" * 450), (203, "ab" * 300), (204, "Oneaea " * 80), (205, "Oneaea " * 81), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rid int")
    assert sorted((tuple(r) for r in repeats.without_repeats(df, bucket=bucket).collect()), key=str) == plain_repeats(rows, 200)
    assert repeats.without_repeats(df.where("false")).count() == 0


def test_repeats_of_one_very_hot_key(spark):
    """5,000 different contexts of one passage: with 130 bytes no window repeats, with 230 only a few do, beside families that share more."""
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    short, long, tails = some(130), some(230), [some(40) for _ in range(20)]
    rows = [(i, some(rng.randint(60, 90)) + short + some(90)) for i in range(3000)]
    rows += [(i, some(rng.randint(60, 90)) + long + some(90)) for i in range(3000, 5000)]
    rows += [(i, some(70) + rng.choice(tails)[rng.randint(0, 20) :] + short + rng.choice(tails) + some(70)) for i in range(5000, 5600)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bucket=50)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_repeats(rows, 200)


def test_decontamination(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    odd = spark.createDataFrame([(900, "the"), (901, None), (None, "the and"), (902, "!!"), (900, "the")], bench.schema)
    both = bench.unionByName(odd)
    items = [(str(r[0]), decontaminate.words(r[1])) for r in both.collect() if r[0] is not None]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, "")]
    expected = []
    for i, t in rows:
        ws, hit, found = decontaminate.words(t), set(), set()
        for item, w in items:
            for win in decontaminate.windows(w, 10):
                for s in range(len(ws) - len(win) + 1):
                    if tuple(ws[s : s + len(win)]) == win:
                        hit |= set(range(s, s + len(win)))
                        found.add(item)
        expected.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    df = docs.select("doc_id", "text", F_lit("x").alias("items")).unionByName(spark.createDataFrame([(-1, None, "x"), (-2, "", "x")], "doc_id long, text string, items string"))
    for block in (2 << 20, 1500):
        got = decontaminate.contamination(df, both, block_bytes=block).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(tuple, got.collect())) == sorted(expected)


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs, labels, sample=200).join(labels.select("doc_id", "quality"), "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert {r.doc_id for r in test} == {r.doc_id for r in got if held(r.doc_id)}
    assert np.mean([r.predicted == r.quality for r in test]) >= 0.95 and all(0 <= r.score <= 1 for r in got)


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, "text"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality(df, labels).collect()} == {1.0}


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.languages(docs, sample=120).collect()}
    test = [r for r in docs.collect() if held(r.doc_id) and r.lang and r.text and any(map(str.isalpha, r.text))]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in test]) >= 0.95


def test_every_language_is_learnt(spark):
    rows = [(i, f"words of language {i % 230}", f"l{i % 230}") for i in range(2300)]
    rows = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3, "doc_id", "text", "lang")
    count = collections.Counter(r["__l"] for r in rows)
    assert len(count) == 230 and max(count.values()) == 3


def test_language_without_letters(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (4, "", None), (5, "some words here", "en"), (7, "x", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.languages(df).collect()}
    assert got[1] == got[2] == got[4] == "und"
    assert {r.lang_pred for r in langid.languages(df.where("lang IS NULL")).collect()} == {"und"}


def test_pair_tables_change_nothing():
    net = langid.Network(["a", "b"])
    x = np.random.default_rng(0).integers(0, 64, (5, langid.WINDOW))
    h = np.concatenate([net.responses(x, w, t).max(1) for w, t in zip(langid.WIDTHS, net.tables)], 1) + net.shift
    assert np.allclose(langid.softmax(np.maximum(h, 0) @ net.out + net.bias), net.distributions(x), atol=1e-5)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[300:700] = x[300]  # a large group of equal vectors
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)] + [(2000, None, "s"), (2100, [0.0] * 16, "s"), (2200, [float("nan")] * 16, "s"), (2300, [1.0] * 3, "s"), (None, x[0].tolist(), "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    got = collections.defaultdict(dict)
    for r in ann.neighbours(df, block=100).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 1200, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort([np.arange(len(d)), d])[:10].tolist()
        assert sorted(found) == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-9 for v, s in found.values())
        hit += len({v for v, _ in found.values()} & set(best))
    assert hit >= 0.9 * 10 * len(got)
    assert [got[400][k][0] for k in range(1, 11)] == list(range(300, 310))
    few = ann.neighbours(df.where("vec_id < 4")).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]
    assert ann.neighbours(df.where("false")).count() == 0


def test_neighbours_of_repeated_ids_and_clashing_names(spark):
    """Three rows have the query's id: each is asked for, and the other two are candidates. Columns that the index uses inside don't matter."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (0, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", *(f"1 AS `{c}`" for c in ("id", "row", "list", "v", "q", "part", "ask", "rank", "score", "query_id")))
    got = collections.Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.neighbours(df, k=3, ratio=float("inf")).collect())
    want = collections.Counter()
    for j, (q, a) in enumerate(rows):
        if q == 0:
            near = sorted((float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), v, i) for i, (v, b) in enumerate(rows) if i != j)[:3]
            want.update((0, k + 1, v, round(d, 9)) for k, (d, v, _) in enumerate(near))
    assert got == want


def recall(got, x, every, k=10):
    found = collections.defaultdict(set)
    for r in got.collect():
        found[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, len(x), every):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += len(found[q] & set(np.argsort(d)[:k].tolist()))
    return hit / (k * len(range(0, len(x), every)))


def vectors(spark, x):
    return spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))


def test_neighbours_in_clusters_read_few_rows(spark):
    """Vectors about 300 centres, as embeddings are: the ratio prunes nearly all lists, and enough is found."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(300, 32))[rng.integers(0, 300, 40_000)] + 0.45 * rng.normal(size=(40_000, 32))).astype(np.float32)
    index = ann.Index(vectors(spark, x), every=200, sample=4000)
    assert index.share_read() < 0.2 and recall(index.search(), x, 200) >= 0.9


def test_neighbours_without_structure(spark):
    """Nothing tells the lists apart, so more of them have to be read; with all of them the search is exact."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 48)).astype(np.float32)
    df = vectors(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    assert recall(ann.neighbours(df, every=200, sample=4000), x / np.linalg.norm(x, axis=1, keepdims=True), 200) >= 0.9
    assert recall(ann.neighbours(df, every=1000, sample=2000, ratio=float("inf")), x / np.linalg.norm(x, axis=1, keepdims=True), 1000) == 1


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert collections.Counter(map(tuple, got.select(names).collect())) == collections.Counter(found.fetchall())
