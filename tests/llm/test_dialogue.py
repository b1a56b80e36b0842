"""Conversation repair against every possible edit, and the query against SQL."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import dialogue, registry

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_repair(rows):
    """(cost, audit, repaired rows) by trying all edits, with two insertions at most at each place."""
    inserts = [c for k in range(3) for c in itertools.product(("user", "assistant"), repeat=k)]
    best = None
    ways = []
    for (role, text), fault in zip(rows, faults(rows)):
        must, cut = fault in ("blank", "duplicate"), fault == "truncated"
        ways.append([(3, "D", None)] + ([] if must else [(cut, "K", (role, text)), (2 + cut, "R", ("user", text)), (2 + cut, "R", ("assistant", text))]))
    for edits in itertools.product(*ways):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(e[0] for e in edits) + 2 * sum(map(len, added))
            if best and cost > best[0]:
                continue
            out, audit = [], ""
            for k, more in enumerate(added):
                out += [(r, "") for r in more]
                audit += "I" * len(more)
                if k < len(rows):
                    audit += edits[k][1]
                    if edits[k][2]:
                        out.append(edits[k][2])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def results(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_small_conversations_against_all_edits(spark):
    r = random.Random(3)
    said = {}
    for conv in range(120):
        size = r.choice([0, 1, 2, 2, 3, 3]) if conv % 10 else 3
        said[conv] = [(r.choice(["user", "user", "assistant", "assistant", "system", "tool", "s"]), r.choice(["Yes.", "No!", "cut off", "  \n", "", "Why? \t"])) for _ in range(size)]
    rows = [(conv, turn, role, text, 1) for conv, talk in said.items() for turn, (role, text) in enumerate(talk)] + [(conv, None, "user", "x", 0) for conv in said]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    for most in (1000, 1):  # 1: every row is a segment
        got = results(dialogue.repairs(df, most))
        texts = collections.defaultdict(list)
        for row in sorted(dialogue.repaired_rows(df, most).collect()):
            assert row.place == len(texts[row.conv_id])
            texts[row.conv_id].append((row.role, row.text))
        for conv, talk in said.items():
            cost, audit, repaired = every_repair(talk)
            counts = collections.Counter(faults(talk))
            illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
            hashed = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest()
            assert got[conv] == (0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashed), talk
            assert texts[conv] == repaired


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = con.execute(registry.SQL["op12_dialogue_repair"])
    names = [d[0] for d in rel.description]
    return {r[names.index("conv_id")]: tuple(r[names.index(c)] for c in COLUMNS[1:]) for r in rel.fetchall()}


@pytest.mark.parametrize("most", [1000, 7, 1])
def test_odd_tables_against_sql(spark, most):
    """Nulls, repeated rows and turns, gaps, one conversation of a third of all rows and one row that is repeated very often."""
    r = random.Random(5)
    texts = ["Yes.", "No!", "cut off", " ", "", "Why? \t", None, "One. Two", "ends\n"]
    rows = [(r.choice([*range(40), None]), r.choice([None, *range(-2, 9)]), r.choice(["user", "assistant", "system", "tool", None, "assistant", "user"]), r.choice(texts)) for _ in range(500)]
    rows += [(77, k, "user" if k % 2 else "assistant", f"Turn {k % 150}.") for k in range(400)] + [(78, 3, "user", "Again and again.")] * 300
    df = table(spark, rows).repartition(5)
    clash = df.selectExpr("*", "1 AS who", "2 AS n", "3 AS part", "4 AS seq", "5 AS segment", "6 AS said")
    assert results(dialogue.repairs(dialogue.damaged(clash), most)) == by_sql(rows)


def test_long_texts_and_empty_tables(spark):
    rows = [(1, 0, "user", "long text. " * 200_000), (1, 1, "assistant", "x" * 2_000_000), (2, 0, "user", "Hello there."), (2, 1, "assistant", "Hello.")]
    df = table(spark, rows)
    assert results(dialogue.repairs(dialogue.damaged(df))) == by_sql(rows)
    assert dialogue.repairs(dialogue.damaged(df.where("false"))).count() == 0


def test_query_against_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(registry.op12_dialogue_repair(spark, SF)) == by_sql(rows)
