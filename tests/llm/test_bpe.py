"""Byte-level BPE against the public encoder, and its tables after appends and edits."""

import random

import public_tokenizers as P
import pytest
import tiktoken

from gaugeworks.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.TextEncoder(ranks, P.PATTERN, memo_size=500)


@pytest.fixture(scope="module")
def public(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts(encoder, public):
    rng, letters = random.Random(1), "ab ccé\n\t  ß🙂1'sTHE the ing\x1c\x85\xa0　 .,!#日本12 \r\n'lld"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = encoder.encode(s)
        assert ids == public.encode_ordinary(s)
        assert encoder.decode(ids) == s.encode()


def test_batches_of_texts(encoder, public):
    """Memos of two generations, texts of one batch, white space of all kinds at all places."""
    rng, letters = random.Random(5), ["a", "the", "ing", " ", " ", " ", "\n", "\t", "\x85", "é", ".", "!!", "日本", "12", "\x00", "'s"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + ["", " ", "\n", " a", "a ", "a\n b", "a \nb", "a\n\n\nb c", "\n a", "x" * 5000 + " y.z" * 3, "a.\n" * 3000]
    for k in range(0, len(texts), 37):
        for t, (ids, raw) in zip(texts[k : k + 37], encoder.encode_texts(texts[k : k + 37])):
            assert [int(i) for i in ids.split(" ") if i] == public.encode_ordinary(t) and raw == t.encode()


def test_long_pretoken(encoder, public):
    s = "".join(random.Random(2).choice("theinga") for _ in range(20_000))
    assert encoder.encode(s) == public.encode_ordinary(s)


def test_appends_and_edits(encoder):
    rng, pairs = random.Random(3), encoder.pairs
    some = lambda letters, n: bytes(rng.choice(letters) for _ in range(rng.randint(0, n)))
    for _ in range(400):
        data = some(b"theingan er", 400)
        table = pairs.extend(data, [])
        assert pairs.extend(data + b"thing", list(table)) == pairs.extend(data + b"thing", [])
        i = rng.randint(0, len(data))
        j = rng.randint(i, len(data))
        new = some(b"theing", 9)
        out, edited = pairs.edit(data, table, i, j, new)
        assert out == data[:i] + new + data[j:] and edited == pairs.extend(out, [])


def test_rows(spark, public):
    rows = [(1, "the thing", "x"), (2, None, "y"), (3, "", "z"), (1, "the thing", "x"), (None, "word " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(df, ids=False).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, len(public.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert bpe.encode_documents(df.where("false")).count() == 0
    assert {r.ids for r in bpe.encode_documents(df.drop("ids")).where("doc_id IS NULL").collect()} == {" ".join(map(str, public.encode_ordinary("word " * 5000)))}
