r"""Personal data: fixed patterns, and a linear-chain CRF over word shapes.

Patterns find e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone
numbers with a country code. The CRF finds further spans of these kinds in
other forms (a phone number without `+`, an address spelled with "at" and
"dot"). Its features are the shapes, short affixes and neighbours of tokens;
it is trained from a small labelled table (`labelled`: text with the spans in
{kind:...} marks; `TRAINING` by default) and decoded by Viterbi in batches.

The CRF reads the stretches of a text around its digits, at-signs and the words
"at" and "dot" in any case: `REACH` characters to either side, then on to the
next white space, merged where they meet. An e-mail span that `complete` accepts
has an "at" or "@", and the other kinds have digits, so no accepted span lies
elsewhere. A stretch is decoded in windows of `STEP` tokens with `OVER` more on
either side, and of a window the spans that begin among its own tokens count;
one that ends in the window's last tokens is decoded on from its first token until it
closes. So memory is bounded by the longest span, however long a text. A found span that overlaps a pattern's
is dropped, so the patterns' spans all stay.

Defined cases: a null text is empty and has none; texts are read whole; rows
are judged one by one, so repeated ids and rows stay; equal scores of two label
paths go to the label listed first; an empty table gives no rows; further
columns are not read, whatever their names; an empty training table leaves the
patterns alone.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import crf
from .common import released

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
REACH = 60
STEP, OVER = 400, 100
#: A span that ends in so many last tokens of a window may be cut by it.
EDGE = 10
TRIGGER = re.compile(r"[0-9@]|(?<![A-Za-z])(?:at|dot)(?![A-Za-z])", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
CUES = {"at", "dot", "tel", "phone", "call", "card", "mail"}
SUFFIXES = {"com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "co", "eu"}
LABELS = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start. A match that fails its kind's test is dropped as a whole."""
    out = []
    if "@" in text:
        # every match lies in one maximal run of the characters of an address, so runs without @ are skipped
        for run in EMAIL_RUN.finditer(text):
            if "@" in run[0]:
                out += [(0, run.start() + m.start(), run.start() + m.end()) for m in emails(run[0])]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def emails(run: str):
    """Leftmost matches in a run: the local part before an @ reaches back as far as it can, so no other start needs a try."""
    at = 0
    while (k := run.find("@", at)) >= 0:
        m = EMAIL.match(run, at) if at < k else None
        if m:
            yield m
        at = m.end() if m else k + 1


#: A small labelled table: forms that the patterns leave, forms that they find, and look-alikes.
TRAINING = [
    "call me at {phone:(415) 555-0132} after six", "phone {phone:415-555-0199} or write", "tel. {phone:020 7946 0018} today", "ring {phone:555-0142} now",
    "mobile: {phone:07700 900123}.", "fax {phone:(212) 555 0188}, office", "she said {phone:0151 496 0744} is the number", "contact {phone:030-1234567} bitte",
    "numéro {phone:01 23 45 67 89} merci", "teléfono {phone:912 345 678} gracias", "Telefon {phone:(030) 901820}", "reach us on {phone:800.555.0111}, toll free",
    "under {phone:(617) 555-0171} until noon", "or {phone:614-555-0126} in May", "was {phone:303.555.0164} then",
    "phone {phone:+1 (415) 555-0132} now", "tel {phone:+44 20 7946 0018}, please", "the {phone:+1 (206) 555-0147} is", "to {phone:+33 1 23 45 67 89}.",
    "write to {email:jane dot doe at mail dot com} soon", "mail {email:bob [at] example [dot] org} please", "{email:info (at) firma (dot) de} schreiben", "ask {email:sales at shop dot net}, thanks",
    "address {email:max.mustermann [at] mail.example.com} or", "e-mail: {email:anna_k (at) web.de}.", "then {email:reader at post dot example dot com} again",
    "or {email:joe at corp dot com} today with 12 others", "to {email:mary dot lee [at] x [dot] org}, then 3 more", "and {email:tom (at) mail dot net} was there in 2020", "the {email:team at example dot org} of 5", "via {email:kim at data dot io} or at the desk 4",
    "write {email:jane.doe@mail.com} soon", "below.{email:42@post.example.org} again", "mail to {email:a_b@x.org}, please",
    "from {ip:203.0.113.77} to", "host {ip:192.168.0.1} is up", "server {ip:198.51.100.24}, down", "at {ip:8.8.8.8}.", "| {ip:172.16.254.3} |",
    "card {card:4111 1111 1111 1111} was charged", "visa {card:4111-1111-1111-1111}, expires", "paid {card:6011000990139424} twice", "number {card:5500005555555559}.", "card {card:340000000000009} amex",
    "in 1998 and 2004 the", "on 2024-01-15 at noon", "version 2.0.1 of the", "page 12, line 7", "chapter 3.2 of 10", "costs 1,200.50 dollars", "the 15th of May", "pi is 3.14159 about", "room 404 on floor 4",
    "order 1234567 shipped", "isbn 978-3-16-148410-0 book", "from 10:30 to 11:45", "10 000 people in 120 towns", "token = \"5f1c0a7e3b9d2648c0ffee1234abcd98\" as", "a dot on the map", "meet at noon", "look at 5 pages",
    "score 3-2 at home", "lines 100-200 of it", "between 1914-1918 and", "step 1. then step 2.", "item 7: 20 kg at 30 percent", "the dot at the end", "Apache License, Version 2.0", "id 86400 of 1000000",
    "the quick brown fox jumps over the lazy dog near 12 old barns and then sleeps for the night in peace", "und der die das nicht mit einer von 7 alten zu dem im haus auf für sie ist",
    "le chat de la maison et les 3 petits dans une rue avec du pain pour le soir est", "el perro de la casa con los 4 gatos y una mesa por la noche que no es", "Released under the MIT License. Copyright 2019 the authors of it, all rights reserved by them",
    "They came late. Of these 27 were old, Some had left early and the rest went home to sleep", "Licensed under CC BY-SA 4.0. See below",
    "token = \"0badc0de7711aa55ee99cc33dd22ff6688004e1b\" once more. Later on. Nothing else", "see the house at the corner and 2 more at the lake, then look at it again", "Lyon, at the border of the plain, is 5 hours on the way",
    "| apples | 12 | pears | plums | cherries | figs |", "about 12 and 345 more the", "key=9f86d081884c7d65 end", "3 x 4 = 12", "in section 555 of law 1972", "road 66, exit 415", "sum of 555 and 0132",
]


def parse(marked: str) -> tuple[str, list[tuple[int, int, int]]]:
    text, spans, at = "", [], 0
    for m in re.finditer(r"\{(\w+):([^}]*)\}", marked):
        text += marked[at : m.start()]
        spans.append((KINDS.index(m[1]), len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + marked[at:], spans


def shape(token: str) -> str:
    if token.isdigit():
        return "9" * min(len(token), 5) + ("+" if len(token) > 12 else "")
    if token.isascii() and token.isalpha():
        return "x" if token.islower() else "X" if token.isupper() else "Xx"
    return token


def features(tokens: list[tuple[str, bool]]) -> list[list[str]]:
    """tokens: (token, whether space goes before it)"""
    shapes = ["<<", "<", *(shape(t) for t, _ in tokens), ">", ">>"]
    spaced = [s for _, s in tokens] + [True]
    cue = ["-", *("s" if t.lower() in SUFFIXES else t.lower() if t.lower() in ("at", "dot", "@", ".") else "-" for t, _ in tokens), "-"]
    out = []
    for i, (t, gap) in enumerate(tokens):
        low, s = t.lower(), shapes[i : i + 5]
        out.append([
            "s0" + s[2], "s-1" + s[1], "s+1" + s[3], "s-2" + s[0], "s+2" + s[4], f"b{s[1]}|{s[2]}", f"a{s[2]}|{s[3]}", f"t{s[1]}|{s[2]}|{s[3]}", f"w{s[0]}|{s[1]}|{s[2]}", f"v{s[2]}|{s[3]}|{s[4]}",
            f"g{gap}{spaced[i + 1]}{s[2]}", "k" + (low if low in CUES else "") + s[2], f"c{cue[i]}{cue[i + 1]}{cue[i + 2]}", f"n{min(len(t), 20)}{t.isdigit()}",
        ])
    return out


class Tagger:
    def __init__(self, weights: np.ndarray, move: np.ndarray, first: np.ndarray, known: dict[str, int]):
        self.weights, self.move, self.first, self.known = weights, move, first, known

    def spans(self, stretches: list[list[tuple[str, bool, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Spans of each stretch of tokens (token, gap, start, end), by Viterbi over all of them at once."""
        lengths = np.array([len(s) for s in stretches], np.int64)
        rows = [[self.known.get(f, len(self.known)) for f in fs] for s in stretches for fs in features([t[:2] for t in s])]
        if not rows:
            return [[] for _ in stretches]
        path = crf.viterbi(self.weights[np.array(rows)].sum(1), lengths, self.move, self.first).tolist()
        out, k = [], 0
        for s in stretches:
            found: list[list[int]] = []
            for _, _, a, b in s:
                label = path[k]
                k += 1
                if label and label % 2:  # begins
                    found.append([(label - 1) // 2, a, b])
                elif label:
                    found[-1][2] = b
            out.append([tuple(f) for f in found if complete(f[0], [t for t, _, a, b in s if f[1] <= a and b <= f[2]])])
        return out


def complete(kind: int, inside: list[str]) -> bool:
    """A found span must have its kind's parts: an at and a dot, four numbers, or the right number of digits, with the right sum for a card."""
    if kind == 0:
        low = [t.lower() for t in inside]
        return ("@" in low or "at" in low) and ("." in low or "dot" in low) and low[-1].isalnum()
    digits = "".join(t for t in inside if t.isdigit() and t.isascii())
    return {1: len(inside) == 7, 2: 13 <= len(digits) <= 19 and luhn(digits), 3: 7 <= len(digits) <= 15}[kind]


def fit(labelled: list[str], rounds: int = 150) -> Tagger | None:
    """The table is small by definition: it is the caller's list."""
    seqs, tags = [], []
    for text, spans in map(parse, labelled):
        own = tokens(text, 0, len(text))
        label = np.zeros(len(own), np.int64)
        for k, a, b in spans:
            inside = [i for i, t in enumerate(own) if t[2] >= a and t[3] <= b]
            label[inside] = 2 * k + 2
            label[inside[0]] = 2 * k + 1
        seqs.append(features([t[:2] for t in own]))
        tags.append(label)
    if not seqs:
        return None
    known = {f: i for i, f in enumerate(sorted({f for s in seqs for fs in s for f in fs}))}
    active = np.array([[known[f] for f in fs] for s in seqs for fs in s])
    n = len(LABELS)
    weights = np.zeros((len(known) + 1, n))
    barred = np.zeros((n, n), bool)
    for j in range(2, n, 2):  # I follows only B or I of its kind
        barred[:, j] = True
        barred[[j - 1, j], j] = False
    flat = active.ravel()

    def gradient(diff):
        return np.stack([np.bincount(flat, np.repeat(diff[:, s], active.shape[1]), minlength=len(weights)) for s in range(n)], 1)

    w, move, first = crf.train(lambda w: w[active].sum(1), gradient, weights, np.concatenate(tags), np.array([len(t) for t in tags]), n, rounds, 0.1, 2e-4, barred)
    first[2::2] = -1e4
    w[-1] = 0  # an unseen feature says nothing
    return Tagger(w, move, first, known)


def read_tokens(text: str, start: int, end: int):
    before = -1
    for m in TOKEN.finditer(text, start, end):
        yield m[0], m.start() != before, m.start(), m.end()
        before = m.end()


def tokens(text: str, start: int, end: int) -> list[tuple[str, bool, int, int]]:
    return [*read_tokens(text, start, end)]


def windows(text: str):
    """(tokens, first, last, end) of all stretches: the spans that begin at a token in first:last are the window's own; end: where the stretch ends, if it goes on."""
    for a, b in stretches(text):
        held, own = [], 0
        for token in read_tokens(text, a, b):
            held.append(token)
            if len(held) == own + STEP + OVER:
                yield held, own, own + STEP, b
                held, own = held[own + STEP - OVER :], OVER
        if len(held) > own:
            yield held, own, len(held), None


def closed(tagger: Tagger, text: str, held: list, span: tuple[int, int, int], end: int) -> tuple[int, int, int]:
    """A span that a window's end cuts, decoded on from its first token (and what is before it) until it closes or the stretch ends."""
    at = next(k for k, token in enumerate(held) if token[2] >= span[1])
    size = len(held)
    while True:
        size *= 2
        more = [*islice(read_tokens(text, held[max(0, at - OVER)][2], end), size)]
        found = next((f for f in tagger.spans([more])[0] if f[1] == span[1]), None)
        if found is None or found[2] < more[-EDGE][3] or len(more) < size:
            return found or span


def decoded(tagger: Tagger, texts: list[str], most: int = 20_000) -> list[list[tuple[int, int, int]]]:
    """Spans of each text, about `most` tokens at a time."""
    out: list[list] = [[] for _ in texts]
    waiting, n = [], 0

    def flush():
        for (i, (held, first, last, end)), found in zip(waiting, tagger.spans([w[0] for _, w in waiting])):
            low, high = held[first][2], held[last - 1][3]
            for kind, a, b in found:
                if low <= a < high and (not out[i] or out[i][-1][2] <= a):
                    out[i].append((kind, a, b) if end is None or b < held[-EDGE][3] else closed(tagger, texts[i], held, (kind, a, b), end))
        waiting.clear()

    for i, text in enumerate(texts):
        for window in windows(text):
            waiting.append((i, window))
            n += len(window[0])
            if n >= most:
                flush()
                n = 0
    flush()
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    merged: list[tuple[int, int]] = []
    for a, b in out:  # whole words only; no character is passed twice
        done = merged[-1][1] if merged else 0
        a, b = max(a, done), max(b, done)
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if merged and a == done:
            merged[-1] = merged[-1][0], b
        else:
            merged.append((a, b))
    return merged


def rendered(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame, labelled: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (structs of kind, start, end). Map-only."""
    tagger = docs.sparkSession.sparkContext.broadcast(fit(TRAINING if labelled is None else labelled))
    entry = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = decoded(tagger.value, texts) if tagger.value else [[] for _ in texts]
            every = []
            for own, found in zip(base, more):
                every.append(sorted([*own, *free(found, own)]))
            counts = [[sum(1 for s in own if s[0] == k) for own in base] for k in range(len(KINDS))]
            columns = [batch.column(key), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(rendered(own).encode()).hexdigest() for own in base], pa.string()), pa.array(map(rendered, every), pa.string()), pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in s] for s in every], entry)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>"
    return docs.select(key, F.col(text).alias("__text")).mapInArrow(released(run), schema)


def free(found: list, own: list) -> list:
    """Those of `found` that overlap none of `own`."""
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in own):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]
    out = []
    for k, a, b in found:
        i = bisect.bisect_right(ends, a)
        if i == len(taken) or b <= taken[i][0]:
            out.append((k, a, b))
    return out
