"""Repair of conversation structure by error-correcting Earley parsing.

Grammar of role initials: Talk -> nothing | Turns | s Turns; Turns -> u a | u a Turns. Productions that correct errors are
weighted: a row may be deleted (3), get the role that the grammar wants (2), and an empty row of that role may be inserted
before any row or at the end (2); a row that stays and is truncated adds 1, a blank or repeated row must go. The dotted
rules of this grammar come to four items: nothing read yet, `s` read, a `u` read that wants its `a`, a finished pair.
A chart holds, at each place between rows and for each item, the least (cost, audit) that leads from there to the end of a
completed chart; an audit is the edits' initials (D, I, K, R). The chart is filled from the last row to the first: edits that
differ at an item differ in their initial, so an audit is its first edit and a link to the item that follows, and ties of cost
are settled by one character. Reading the links from the start yields the repair.

Rows of a conversation come in order of (turn, nulls first; role; text). All rows are sorted once by ranges of (conversation, turn, ...), so a conversation
of any size is many tasks. One that lies within a task is repaired there. One that spans tasks, or has over 1000 rows
or 1 MB, is charted in segments, each for every pair of items that it can begin and end with; then the segments are joined:
from the last to the first by cost and rank only, then from the first to the last along the cheapest audits, both one segment at a time.
Rows that are alike in conversation, turn, role and text are counted before they are shuffled; the first place of each text of a
conversation is found by an aggregate, and hot texts are dealt out.

Null role or text: one space. A null conv_id is a conversation too; a null turn counts as no turn. Only `user` and `assistant` are inserted or set;
a role whose initial is none of s, u, a, or an empty one, fits nowhere. Empty table: no rows. Other columns don't matter. The audit and the sum of the
repaired text are one value a conversation, so an audit has to fit in a row; texts don't.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import joined_by_hot_keys, materialize, released

KEEP, RESET, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
BLANK = " \t\n\x0b\x0c\r"
#: Items: 0 nothing read, 1 `s` read, 2 `u` read, 3 a pair is finished. What each reads, and the item after it.
READS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that may be set or inserted at an item.
WANTS = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 40
#: At the end of a conversation: cost and insertions of each item.
END, CLOSING = (0, 4, 2, 0), ("", "II", "I", "")
ROWS, BYTES = 1000, 1 << 20


@lru_cache(1 << 16)
def filled(initial: str, must: bool, cut: bool, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int] | None, ...]]:
    """One place of the chart before a row: costs of the items, and for each the edits up to this row with the item after it."""
    ways = []
    for x in range(4):
        found = [(DELETE + after[x], "D", x)]
        if not must:
            if initial in READS[x]:
                found.append((KEEP + cut * CUT + after[READS[x][initial]], "K", READS[x][initial]))
            y = READS[x][WANTS[x]]
            found.append((RESET + cut * CUT + after[y], "R", y))
        ways.append(found)
    costs = [min(w)[0] for w in ways]
    for _ in range(4):  # insertions before the row; each costs, so they end
        costs = [min(costs[x], INSERT + costs[READS[x][WANTS[x]]]) for x in range(4)]
    links: list[tuple[str, int] | None] = []
    for x in range(4):
        y, edits = x, ""
        while costs[x] < FAR:
            row = min((edit, to) for cost, edit, to in [*ways[y], (INSERT + costs[READS[y][WANTS[y]]], "I", -1)] if cost == costs[y])
            edits += row[0]
            if row[0] != "I":
                links.append((edits, row[1]))
                break
            y = READS[y][WANTS[y]]
        else:
            links.append(None)
    return tuple(min(c, FAR) for c in costs), tuple(links)


def chart(rows: list[tuple[str, bool, bool]], end: tuple[int, ...]) -> tuple[tuple[int, ...], list]:
    """Costs of the items before the first row, and the links of every place. rows: initial, must go, truncated; end: costs of the items after the last."""
    base, now, places = 0, end, []
    for initial, must, cut in reversed(rows):
        least = min(now)
        base += least
        now, links = filled(initial, must, cut, tuple(c - least if c < FAR else FAR for c in now))
        places.append(links)
    places.reverse()
    return tuple(min(FAR, base + c) for c in now), places


def read(places: list, x: int) -> tuple[str, int]:
    """The audit from item x, and the item that it ends at."""
    edits = []
    for links in places:
        said, x = links[x]
        edits.append(said)
    return "".join(edits), x


def repaired(audit: str, x: int, roles: list[str], texts: list[str]):
    """The repaired rows (role, text), from item x on."""
    k = 0
    for edit in audit:
        if edit == "K":
            role, text, x = roles[k], texts[k], READS[x][roles[k][:1]]
        elif edit != "D":
            role, text = NAMES[WANTS[x]], "" if edit == "I" else texts[k]
            x = READS[x][WANTS[x]]
        if edit != "D":
            yield role, text
        k += edit != "I"


class Lines:
    """SHA-256 of `role:text` lines joined by a newline."""

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def add(self, rows) -> None:
        for role, text in rows:
            if self.some:
                self.hash.update(b"\n")
            self.hash.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.some = True


class Part:
    """Rows of one conversation that lie together, with what is counted over them."""

    def __init__(self, who: str, conv_id, seq: int):
        self.who, self.conv_id, self.seq, self.bytes = who, conv_id, seq, 0
        self.rows: list[tuple[str, bool, bool]] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.turns: list[int] = []  # first, last, how many
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn: int | None, role: str, text: str, repeat: bool) -> None:
        bare = text.rstrip(BLANK)
        fault = "blank" if not bare else "duplicate" if repeat else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.rows and self.rows[-1][0] + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        must = fault in ("blank", "duplicate")
        self.rows.append((initial, must, fault == "truncated"))
        self.roles.append(role)
        self.texts.append("" if must else text)
        self.bytes += 0 if must else len(text)
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = turn, self.turns[2] + 1

    def whole(self, texts: bool) -> dict:
        costs, places = chart(self.rows, END)
        audit, x = read(places, 0)
        rows, lines = list(repaired(audit + CLOSING[x], 0, self.roles, self.texts)), Lines()
        lines.add(rows)
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return {"who": self.who, "conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": costs[0], "audit": audit + CLOSING[x], "repaired_sha256": lines.hash.hexdigest(), "start": 0, "turns": [{"role": r, "text": t} for r, t in rows] if texts else None, "segment": None}

    def segment(self) -> dict:
        costs, audits = [FAR] * 16, [None] * 16
        for y in range(4):
            found, places = chart(self.rows, tuple(0 if x == y else FAR for x in range(4)))
            for x in range(4):
                if found[x] < FAR:
                    costs[4 * x + y], audits[4 * x + y] = found[x], read(places, x)[0]
        ranks = [sum(b is not None and b < a for b in audits[i - i % 4 : i - i % 4 + 4]) if a is not None else 0 for i, a in enumerate(audits)]
        seg = {"part": TaskContext.get().partitionId(), "seq": self.seq, "first": self.rows[0][0] if self.rows else None, "last": self.rows[-1][0] if self.rows else None, "turns": self.turns, "costs": costs, "ranks": ranks, "audits": audits, "roles": self.roles, "texts": self.texts}
        return {"who": self.who, "conv_id": self.conv_id, "gaps": None, **self.counts, "cost": None, "audit": None, "repaired_sha256": None, "start": None, "turns": None, "segment": seg}


SEGMENT = "struct<part:int, seq:int, first:string, last:string, turns:array<long>, costs:array<long>, ranks:array<int>, audits:array<string>, roles:array<string>, texts:array<string>>"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, start long, turns array<struct<role:string, text:string>>"


def charted(texts: bool, rows: int, size: int):
    """Results of conversations that lie within this task, segments of the others. Rows come in order: who, conv_id, turn, role, text, n, later."""

    def run(batches):
        part: Part | None = None
        begun = False  # whether a conversation ended in this task before `part`
        out: list[dict] = []
        kind = None
        for batch in batches:
            kind = kind or schema(batch.schema.field("conv_id").type)
            for row in batch.to_pylist():
                if part is None or part.who != row["who"]:
                    if part is not None:
                        out.append(part.whole(texts) if begun and not part.seq else part.segment())
                        begun = True
                    part = Part(row["who"], row["conv_id"], 0)
                for k in range(row["n"]):
                    if len(part.rows) >= rows or part.bytes >= size:
                        out.append(part.segment())
                        part = Part(part.who, part.conv_id, part.seq + 1)
                    part.add(row["turn"], row["role"], row["text"], row["later"] or k > 0)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
        if part is not None:
            out.append(part.segment())
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return run


def schema(conv_id: pa.DataType) -> pa.Schema:
    many, text, whole = pa.list_, pa.string(), pa.int64()
    seg = pa.struct([("part", pa.int32()), ("seq", pa.int32()), ("first", text), ("last", text), ("turns", many(whole)), ("costs", many(whole)), ("ranks", many(pa.int32())), ("audits", many(text)), ("roles", many(text)), ("texts", many(text))])
    return pa.schema([("who", text), ("conv_id", conv_id), *((c, whole) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", text), ("repaired_sha256", text), ("start", whole), ("turns", many(pa.struct([("role", text), ("text", text)]))), ("segment", seg)])


def decided(batches):
    """Segments from the last of a conversation to the first: the item that the cheapest way from each item ends the segment at."""
    who, togo = None, END
    for batch in batches:
        ways = []
        for row in batch.to_pylist():
            if row["who"] != who:
                who, togo = row["who"], END
            best = [min((row["costs"][4 * x + y] + togo[y], row["ranks"][4 * x + y], y) for y in range(4)) for x in range(4)]
            togo = tuple(min(FAR, b[0]) for b in best)
            ways.append([b[2] for b in best])
        yield pa.RecordBatch.from_arrays([batch.column("who"), batch.column("part"), batch.column("seq"), pa.array(ways, pa.list_(pa.int32()))], names=["who", "part", "seq", "ways"])


def joined(texts: bool):
    """Segments in order with the ways decided: one result a conversation; or, for its texts, a row for each segment."""

    def run(batches):
        now: dict | None = None
        kind, out = None, []

        def rows(found) -> None:
            found = list(found)
            now["lines"].add(found)
            if texts:
                out.append({"conv_id": now["conv_id"], "start": now["start"], "turns": [{"role": r, "text": t} for r, t in found]})
                now["start"] += len(found)

        def end() -> None:
            closing, t = CLOSING[now["x"]], now["turns"]
            rows(repaired(closing, now["x"], [], []))
            if not texts:
                gaps = t[1] - t[0] + 1 - t[2] if t else 0
                out.append({"conv_id": now["conv_id"], "gaps": gaps, **now["counts"], "cost": now["cost"] + END[now["x"]], "audit": "".join(now["audit"]) + closing, "repaired_sha256": now["lines"].hash.hexdigest()})

        for batch in batches:
            kind = kind or pa.schema([f for f in schema(batch.schema.field("conv_id").type) if f.name not in ("who", "segment")])
            for row in batch.to_pylist():
                if now is None or now["who"] != row["who"]:
                    if now is not None:
                        end()
                    now = {"who": row["who"], "conv_id": row["conv_id"], "x": 0, "cost": 0, "audit": [], "lines": Lines(), "start": 0, "turns": [], "last": None, "counts": dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)}
                seg, x = row["segment"], now["x"]
                y = row["ways"][x]
                audit = seg["audits"][4 * x + y]
                rows(repaired(audit, x, seg["roles"], seg["texts"]))
                if not texts:
                    now["audit"].append(audit)
                now["cost"] += seg["costs"][4 * x + y]
                now["x"] = y
                for c in now["counts"]:
                    now["counts"][c] += row[c]
                if seg["first"] is not None:
                    if now["last"] is not None and now["last"] + seg["first"] not in ("su", "ua", "au"):
                        now["counts"]["illegal"] += 1
                    now["last"] = seg["last"]
                if t := seg["turns"]:
                    u = now["turns"]
                    now["turns"] = [u[0], t[1], u[2] + t[2] - (u[1] == t[0])] if u else t
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out.clear()
        if now is not None:
            end()
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: how often each row stands in the damaged table. A row that is dropped stands there 0 times."""
    space = F.lit(" ")
    name = lambda c: F.coalesce(F.col(c).cast("string"), space)
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def parsed(rows: DataFrame, texts: bool, most: int, size: int) -> DataFrame:
    who = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    alike = rows.groupBy(who.alias("who"), "conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    alike = materialize(alike.withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = alike.groupBy("who", "said").agg(F.min(F.when(F.col("n") > 0, place)).alias("first"), F.count("*").alias("m"))
    met = joined_by_hot_keys(alike, materialize(firsts), ["who", "said"], F.col("turn"), "m")
    met = met.select("who", "conv_id", "turn", "role", "text", "n", F.coalesce(place > F.col("first"), F.lit(False)).alias("later"))
    order = ["who", F.col("turn").asc_nulls_first(), "role"]
    ordered = materialize(met).repartitionByRange(*order, F.left("text", F.lit(16))).sortWithinPartitions(*order, "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    done = materialize(ordered.mapInArrow(released(charted(texts, most, size)), f"who string, conv_id {kind}, {RESULT}, segment {SEGMENT}"))
    segments = done.where("segment IS NOT NULL")
    backward = segments.select("who", "segment.part", "segment.seq", "segment.costs", "segment.ranks").repartition("who").sortWithinPartitions("who", F.desc("part"), F.desc("seq"))
    ways = backward.mapInArrow(decided, "who string, part int, seq int, ways array<int>")
    forward = segments.select("*", "segment.part", "segment.seq").join(ways, ["who", "part", "seq"]).repartition("who").sortWithinPartitions("who", "part", "seq")
    rest = forward.mapInArrow(released(joined(texts)), f"conv_id {kind}, {RESULT}")
    return done.where("segment IS NULL").drop("who", "segment").unionByName(rest)


def repairs(rows: DataFrame, most: int = ROWS, size: int = BYTES) -> DataFrame:
    """One row a conversation from rows with their counts (conv_id, turn, role, text, n): faults, cost and audit of the cheapest repair, and the SHA-256 of the repaired rows.

    most, size: rows and characters of a segment.
    """
    return parsed(rows, False, most, size).drop("start", "turns")


def repaired_rows(rows: DataFrame, most: int = ROWS, size: int = BYTES) -> DataFrame:
    """conv_id, place (from 0), role, text: the repaired conversations."""
    return parsed(rows, True, most, size).select("conv_id", "start", F.posexplode("turns").alias("k", "row")).select("conv_id", (F.col("start") + F.col("k")).alias("place"), "row.role", "row.text")
