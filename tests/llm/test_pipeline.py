"""The pipeline's stages on a small table with odd rows and clashing names."""

import pytest

import corpus_pipeline
from gaugeworks.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([(90001, None, None, "s", None), (90002, "", "en", None, 0), (None, "token = abcdefgh12345678 and more words here.", "en", "s", 9)], table(spark, SF, "documents").schema)
    rows = table(spark, SF, "documents").unionByName(odd)
    return rows.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("score", "kept", "found", "items", "rid", "hex", "n_tokens", "predicted"))))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns_and_clean_rows(spark, docs, name, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert 0.6 * docs.count() < out.count() <= docs.count()
    assert out.where("doc_id = 90001").count() <= 1
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_stages_on_bare_tables_repeated_rows_and_long_texts(spark):
    """doc_id and text alone; rows twice; a text of 1.6 MB: every stage gives what its operator says."""
    long = "\n".join(f"Line {i} of a long text says that {i} times {i} makes {i * i}." for i in range(25_000))
    rows = [(1, long), (2, "Seven words that stand here quite alone."), (2, "Seven words that stand here quite alone."), (3, None), (3, None), (4, ""), (5, "token = abcdefgh12345678 ends it.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    near = stages["minhash near-dedup"](spark, docs, SF)
    assert sorted((r.doc_id, len(r.text or "")) for r in near.collect()) == [(1, len(long)), (2, 40), (3, 0), (3, 0), (4, 0), (5, 33)]
    assert stages["benchmark decontamination"](spark, docs, SF).count() == len(rows)
    assert {r.text for r in stages["secret scan"](spark, docs, SF).where("doc_id = 5").collect()} == {"[SECRET] ends it."}
    tokens = stages["byte-level bpe"](spark, docs, SF)
    assert tokens.columns[0] == "doc_id" and "lang" not in tokens.columns and tokens.count() == len(rows)
    assert stages["quality classifier"](spark, docs, SF).columns == docs.columns


def test_secrets_go(spark, docs):
    out = dict(corpus_pipeline.STAGES)["secret scan"](spark, docs, SF)
    row = out.where("doc_id IS NULL").first()
    assert row.text == "[SECRET] and more words here." and row.n_chars == len(row.text) and row.hex == 5
    assert out.where("doc_id = 90001").first().text is None


def test_tokens(spark, docs):
    out = dict(corpus_pipeline.STAGES)["byte-level bpe"](spark, docs, SF)
    assert out.count() == docs.count() and out.where("doc_id = 90002").first().n_tokens == 0


def test_run_against_plain_loops(spark):
    """run() on whole tables, step by step in plain Python; the classifier's scores and the random spans are the operators' own."""
    import hashlib

    import public_tokenizers as P
    import tiktoken
    from test_documents import plain_components

    from gaugeworks.llm import bpe, decontaminate, quality, secrets

    docs, labels, bench = (table(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()
    scores = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    kept = {i: r.text for i, r in rows.items() if scores[i] >= 0.5}
    kept = {i: kept[i] for i, _, _, first in plain_components(list(kept.items())) if first}
    windows = {w for r in bench.collect() for w in decontaminate.windows(decontaminate.words(r.text), 10)}

    def clean(text):
        ws = decontaminate.words(text)
        return not any(tuple(ws[s : s + len(w)]) == w for w in windows for s in range(len(ws) - len(w) + 1))

    kept = {i: t for i, t in kept.items() if clean(t)}
    assert 0.3 * len(rows) < len(kept) < len(rows) - 10
    found = {r.doc_id: r.found for r in secrets.secrets(docs.where(docs.doc_id.isin(*kept))).collect()}
    public, expected = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={}), set()
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    for i, text in kept.items():
        out, at = "", 0
        for s in found[i]:
            if s.start >= at:
                out += text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        out += text[at:]
        ids = public.encode_ordinary(out)
        said = " ".join(map(str, ids))
        expected.add((i, rows[i].lang, rows[i].source, len(ids), said, digest(said.encode()), digest(out.encode())))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
