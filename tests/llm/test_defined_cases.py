"""Very long texts, columns whose names clash with the operators' own, repeated rows, nulls and empty tables."""

import collections

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, decontaminate, langid, neardup, pii, quality, repeats, secrets

LONG = "The same old words go round and round, 12 times a day. " * 40_000
OTHER = "\n".join(f"line {i} has {i * i} things and nothing else, or so they say." for i in range(30_000))
TEXTS = [(1, LONG), (2, None), (3, ""), (4, "Short and good. It ends here."), (4, "Short and good. It ends here."), (None, "No id, but words."), (5, OTHER), (6, "!!! $$$ &&&"), (7, "Another short line of text.")]
#: Names that the operators use inside or in their results.
CLASH = ["score", "held_out", "predicted", "lang_pred", "__text", "__held", "rid", "found", "spans", "n_words", "items", "vid", "f1", "bands", "kept", "component_id", "ids", "n_tokens", "hex", "tests", "key", "t", "g", "__t", "__rid"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, t, "en" if i != 5 else "de") for i, t in TEXTS], "doc_id long, text string, lang string")
    return rows.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 1), (6, 0), (7, 0), (None, 1), (3, None)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    items = spark.createDataFrame([("a", "round and round, 12 times a day. The same old words go"), ("b", "No id"), (None, "x"), ("c", None), ("b", "No id")], "item_id string, text string").withColumn("doc_id", F.lit(0))
    return {
        "decontaminate": lambda d: decontaminate.contamination(d, items),
        "pii": pii.personal_data,
        "repeats": repeats.without_repeats,
        "quality": lambda d: quality.quality(d, labels),
        "secrets": secrets.secrets,
        "neardup": neardup.near_duplicates,
        "language": langid.languages,
        "bpe": lambda d: bpe.encode_documents(d, ids=False),
    }


@pytest.mark.parametrize("name", ["decontaminate", "pii", "repeats", "quality", "secrets", "neardup", "language", "bpe"])
def test_every_row_has_a_result_whatever_the_table(spark, docs, name):
    run = operators(spark)[name]
    got = run(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in TEXTS)
    bare = run(docs.select("doc_id", "text", "lang")).collect()
    key = lambda r: str((r[0], *r))
    assert sorted(map(key, got)) == sorted(map(key, bare))
    twins = [r for r in got if r.doc_id == 4]
    assert twins[0] == twins[1]
    assert run(docs.where("false")).count() == 0


def test_results_of_the_long_texts(spark, docs):
    run = operators(spark)
    row = {r.doc_id: r for r in run["decontaminate"](docs).collect()}
    # every window stands in each pair of neighbouring sentences: no word of the text stays unhit but at its ends
    assert row[1].n_words == 12 * 40_000 and row[1].n_hit >= row[1].n_words - 24 and row[5].n_hit == 0
    assert {r.doc_id: r.n_removed for r in run["repeats"](docs).collect()}[1] == len(LONG)
    assert {r.doc_id: r.n_shingles for r in run["neardup"](docs).collect()}[1] == 12
    assert {r.doc_id: r.lang_pred for r in run["language"](docs).collect()}[2] == "und"
    assert {r.doc_id: r.n_tokens for r in run["bpe"](docs).collect()}[3] == 0
