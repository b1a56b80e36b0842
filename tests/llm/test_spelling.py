"""Spelling variants against brute force and SQL."""

import collections
import random
import re
import zlib

import duckdb
import pytest

from gaugeworks.llm import registry, spelling

SF = "/root/testdata/sf0.001"


def words_of(rows, least=7, every=31, often=2):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            n[run if h % every else run[:k] + run[k + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= often}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, **options):
    n = words_of(rows, **options)
    found = {}
    for w in n:
        others = [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        found[w] = (best if others and n[best] >= 10 * n[w] else None, len(others))
    root = lambda w: root(found[w][0]) if found[w][0] else w
    return {(w, f, root(w), n[w], k, n[f] if f else None) for w, (f, k) in found.items()}


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("letters, most", [("ab", 2), ("ab", 64), ("abé", 3), ("aabÿ", 5)])
def test_dense_words(spark, letters, most):
    """Words of two or three letters have near words everywhere, and blocks that are subdivided to the end."""
    r = random.Random(7)
    rows = [(k, " ".join("".join(r.choice(letters) for _ in range(r.randint(6, 10))) * 1 for _ in range(60))) for k in range(8)]
    rows += [(50 + k, " ".join([rows[0][1].split()[k]] * 15 ** (k % 3 + 1))) for k in range(6)]
    assert got(spelling.variants(docs(spark, rows), most=most)) == expected(rows)


def test_forms_lead_to_roots(spark):
    rows = [(1, "kitchens " * 3000 + "kitchins " * 200 + "kitchinz " * 12 + "bitchinz " * 2 + "citchens " * 300 + "kitchen " * 29)]
    found = {w: (f, r) for w, f, r, *_ in got(spelling.variants(docs(spark, rows), every=1 << 40))}
    assert found["kitchens"] == (None, "kitchens") and found["citchens"] == ("kitchens", "kitchens") and found["kitchen"] == ("kitchens", "kitchens")
    assert found["kitchins"] == ("kitchens", "kitchens") and found["kitchinz"] == ("kitchins", "kitchens")
    assert found["bitchinz"] == (None, "bitchinz")  # 12 is less than ten times 2


def test_defined_cases(spark):
    long = "é" * 300 + "x" * 300
    other = long[:200] + "y" + long[200:]
    rows = [(None, "Variants variants"), (1, None), (2, ""), (3, "short wörds only"), (4, f"{long} {long} {other} {other}"), (4, f"{long} {long} {other} {other}"), (5, "BÉBÉBÉB bÉbÉbÉb ×÷×÷×÷× ×÷×÷×÷×"), (6, "many words " * 300_000)]
    df = docs(spark, rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS key", "4 AS p")
    assert got(spelling.variants(df)) == expected(rows)
    assert got(spelling.variants(df.where("false"))) == set()


def test_pieces_of_a_text_cut_no_run(monkeypatch):
    text = "abcdefgh ijklmnop " * 50
    whole = sum(spelling.pieces(text.encode()), collections.Counter())
    monkeypatch.setattr(spelling, "PIECE", 5)
    assert sum(spelling.pieces(text.encode()), collections.Counter()) == whole


def test_query_against_sql_and_brute_force(spark):
    found = got(registry.op13_spelling_variants(spark, SF))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.execute(registry.SQL["op13_spelling_variants"])
    order = [[d[0] for d in rel.description].index(c) for c in ("word", "form", "root", "n", "n_near", "form_n")]
    rows = rel.fetchall()
    assert found == {tuple(r[i] for i in order) for r in rows} and len(rows) == len(found)
    assert found == expected([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])
