"""Main text of web pages, by nearest-URL page differencing.

Pages are sorted by host and URL path. A page's nearest pages are the two before and the two after it of the same host;
its text lines are aligned with those of each by a longest common subsequence. What a page shares with its neighbours is
the site's, not the article's: a line that all its neighbours share with it is deleted. A neighbour that shares half of the
text or more is a copy of the article, not another page of the site: it has no say. Where only one has a say, and an
element says where the article is, nothing is deleted by it: a common line of the articles themselves would go too often.

Differencing can't see what differs from page to page. So lines inside elements that are named as menu, header, footer,
sidebar, notice, advert, form or reader comments (by tag, role, class or id), script, style and hidden elements go too, so do
three or more lines of links only in a row outside an article; and where a page has `article` elements only lines in them
stay, else those in `main`, else those in an element named as the content, else all. A header inside an article keeps its headings.

A line is the text of a block: elements of block level end it, `br` is a space. Character references are decoded, white
space becomes one space. Only line hashes and lengths are shuffled; a page is read twice (to hash its lines, and to write
its text) and moves only to meet its list of deleted lines.

Null html: empty text. Null url or one without `://`: host and path are empty, and such pages are one host. Pages equal in id, url and html
count once as neighbours and get the same text. Nothing is cut at any length; long pages are aligned in linear memory.
Other columns of the table don't matter; those in `keep` are passed on.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugeworks.sources.usage import numbered_globally

from .common import materialize, released

# fixed values: element names and words in class names and ids
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option optgroup p pre section select summary table tbody tfoot thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Nothing follows from these names alone.
PLAIN = set("p b i em strong span ul ol li div section ol blockquote table tbody tr td th u small sup sub code pre dl dt dd font figure figcaption".split())
SCOPES = {"button", "td", "th", "caption", "object", "table"}
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROPPED = set("script style noscript template nav footer aside form dialog menu button select textarea title iframe object svg canvas audio video map head xmp noembed noframes".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMED = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer colophon copyright sidebar aside widget widgets ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored "
    "promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall social share sharing related recommended recommendations comment comments respond disqus reply replies form search pagination pager toolbar".split()
)
COMMENTS = {"comment", "comments", "respond", "disqus", "reply", "replies"}
NEGATED = {"has", "with", "no", "not", "without"}
CONTENT = {"content", "main-content", "maincontent", "article", "article-body", "article-content", "articlebody", "post-content", "post-body", "entry-content", "story", "story-body", "main", "page-content"}
#: An opening tag of the first kind ends open elements of the second kind, up to an element of the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}

OPENING = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|([!?/]))")
TAIL = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>"']|$)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(4096)
def marks(name: str, tail: str) -> tuple[bool, int]:
    """Whether an element's tag, role, class or id says that it holds no main text, and its rank as content: 3 article, 2 main, 1 named as content."""
    rank = {"article": 3, "main": 2}.get(name, 0)
    drop = name in DROPPED
    if "=" in tail or len(tail) > 6:
        for key, value in ATTRIBUTE.findall(tail):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden":
                drop = True
            elif key == "aria-hidden":
                drop |= value.lower() == "true"
            elif key == "style":
                drop |= bool(UNSEEN.search(value))
            elif key == "role":
                drop |= value.lower() in ROLES
                rank = max(rank, {"article": 3, "main": 2}.get(value.lower(), 0))
            elif key == "itemprop":
                rank = max(rank, 3 * (value.lower() == "articlebody"))
            elif name not in HEADINGS:
                for one in value.split():
                    words = {w.lower() for w in WORDS.findall(one)}
                    if not words & NEGATED:
                        drop |= bool(words & (COMMENTS if rank > 1 else NAMED))
                    rank = max(rank, one.lower() in CONTENT)
    return drop and name not in ("html", "body"), rank


def lines(page: str) -> tuple[list[str], list[bool], bool]:
    """The text lines of a page, in order, for each whether its markup lets it stay, and whether an element holds the article. One pass over the page."""
    out: list[tuple[str, int, bool]] = []  # text, rank (-1: goes), links only
    stack: list[tuple[str, tuple | None]] = []  # name; what it changes: drops, rank, a header
    opened: dict[str, int] = {}
    drops = headers = heading = anchors = 0
    ranks = [0, 0, 0, 0]
    scopes: list[tuple[int, bool]] = []  # places in the stack of paragraphs, and of what hides one from the blocks inside it
    text: list[str] = []
    linked = True

    def flush() -> None:
        nonlocal linked
        if text:
            if line := " ".join((text[0] if len(text) == 1 else "".join(text)).split()):
                rank = 3 if ranks[3] else 2 if ranks[2] else int(ranks[1] > 0)
                gone = drops or (headers and not (rank > 1 and heading))
                out.append((line, -1 if gone else rank, linked))
            text.clear()
        linked = True

    def close() -> str:
        nonlocal drops, headers, heading, anchors
        name, effect = stack.pop()
        if scopes and scopes[-1][0] == len(stack):
            scopes.pop()
        opened[name] -= 1
        if effect is None:
            return name
        drop, rank, header = effect
        drops -= drop
        headers -= header
        ranks[rank] -= rank > 0
        heading -= name in HEADINGS
        anchors -= name == "a"
        return name

    def down_to(k: int) -> None:
        while len(stack) > k:
            close()

    def said(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = entities.unescape(piece)
        text.append(piece)
        if not anchors and linked and not piece.isspace():
            linked = False

    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            said(page[at:])
            break
        m = OPENING.match(page, i)
        if m is None:  # a plain "<"
            said(page[at : i + 1])
            at = i + 1
            continue
        if i > at:
            said(page[at:i])
        comment, end, name, other = m.groups()
        if comment or other:
            stop = page.find("-->", i + 2) if comment else page.find(">", i)
            at = n if stop < 0 else stop + (3 if comment else 1)
            continue
        at, name, tail = m.end(), name.lower(), ""
        if page[at : at + 1] == ">":
            at += 1
        elif rest := TAIL.match(page, at):
            at, tail = rest.end(), rest.group()
        else:
            break  # the page ends inside the tag
        if name in BLOCKS:
            flush()
        elif name in ("br", "td", "th"):
            text.append(" ")
        if end:
            if opened.get(name):
                while close() != name:
                    pass
            continue
        if name in VOID:
            continue
        if name in RAW:
            stop = RAW_END[name].search(page, at)
            at = stop.start() if stop else n
            continue
        if name in BLOCKS and scopes and scopes[-1][1]:  # an open paragraph ends here
            down_to(scopes[-1][0])
        if name in IMPLIED:
            ends, up_to = IMPLIED[name]
            if any(opened.get(e) for e in ends):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ends or stack[k][0] in up_to)
                if stack[k][0] in ends:
                    down_to(k)
        drop, rank = marks(name, tail) if len(tail) < 256 else marks.__wrapped__(name, tail)
        if name in SCOPES or name == "p":
            scopes.append((len(stack), name == "p"))
        opened[name] = opened.get(name, 0) + 1
        if name in PLAIN and not drop and not rank:
            stack.append((name, None))
            continue
        header = name == "header"
        stack.append((name, (drop, rank, header)))
        drops += drop
        headers += header
        ranks[rank] += rank > 0
        heading += name in HEADINGS
        anchors += name == "a"
    flush()
    best = max((rank for _, rank, _ in out), default=0)
    stay = [rank == best and rank >= 0 for _, rank, _ in out]
    if best < 2:
        k = 0
        while k < len(out):  # menus: links only, line after line
            e = k
            while e < len(out) and out[e][2]:
                e += 1
            if e - k >= 3:
                stay[k:e] = [False] * (e - k)
            k = max(e, k + 1)
    return [t for t, _, _ in out], stay, best > 1


def steps(a: list[int], where: dict[int, int], m: int) -> list[int]:
    """Bit rows of the longest common subsequence of a's prefixes with all prefixes of the other side: a 0 is a step up."""
    full = (1 << m) - 1
    row, rows = full, []
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    return rows


def places(b: list[int]) -> dict[int, int]:
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    return where


def aligned(a: list[int], b: list[int], bits: int = 1 << 26) -> list[int]:
    """Indexes of a in one longest common subsequence with b. Tables of more than `bits` are halved (by the place of b where the two halves of a meet best)."""
    lo, top = 0, min(len(a), len(b))
    while lo < top and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < top - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    head, tail = list(range(lo)), list(range(len(a) - hi, len(a)))
    both = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    index = [i for i in range(lo, len(a) - hi) if a[i] in both]
    a, b = [a[i] for i in index], [x for x in b[lo : len(b) - hi] if x in both]
    if not a or not b:
        return head + tail
    if len(a) * len(b) > bits and len(a) > 1:
        mid = len(a) // 2
        up, down = last_row(a[:mid], b), last_row(a[mid:][::-1], b[::-1])
        j = int(np.argmax(up + down[::-1]))
        inner = aligned(a[:mid], b[:j], bits) + [mid + i for i in aligned(a[mid:], b[j:], bits)]
    else:
        rows = steps(a, places(b), len(b))
        i, j, inner = len(a), len(b), []
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    inner.append(i)
                    j -= 1
        inner.reverse()
    return head + [index[i] for i in inner] + tail


def last_row(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with each prefix of b."""
    full, where = (1 << len(b)) - 1, places(b)
    row = full
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
    free = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - free.astype(np.int64))))


def shared(sigs: list[int], sizes: list[int], named: bool, others: list[tuple[list[int], list[int]]], copy: float = 0.5) -> list[int]:
    """Lines to delete: those that all other pages with a say share. sizes: characters of lines that markup lets stay, else 0. named: an element holds the article."""
    votes: dict[int, int] = {}
    voters, own = 0, sum(sizes)
    for b, theirs in others:
        same = aligned(sigs, b)
        if 2 * sum(sizes[i] for i in same) >= copy * (own + sum(theirs)):
            continue
        voters += 1
        for i in same:
            votes[i] = votes.get(i, 0) + 1
    return sorted(i for i, v in votes.items() if v == voters and sizes[i]) if voters > named else []


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(known, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(known, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def row_key(*columns: str) -> Column:
    """128 bits of a row's content."""
    part = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    return F.md5(F.concat(*map(part, columns)).cast("binary"))


def hashed(batches):
    """Line hashes and lengths of each page (column __html last)."""
    for batch in batches:
        sigs, sizes, named = [], [], []
        for page in batch.column(batch.num_columns - 1):
            texts, stay, known = lines(page.as_py() or "")
            named.append(known)
            sigs.append([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in texts])
            sizes.append([len(t) * s for t, s in zip(texts, stay)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sigs, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(named, pa.bool_())], names=[*batch.schema.names[:-1], "sigs", "sizes", "named"])


def compared(batches):
    """near: a page (step 0) and the pages up to two steps away, of any host."""
    for batch in batches:
        keys, gone = [], []
        for near in batch.column(0):
            pages = {p["step"]: p for p in near.as_py()}
            me = pages.pop(0, None)
            if me is None:
                continue
            others = [(p["sigs"], p["sizes"]) for _, p in sorted(pages.items()) if p["host"] == me["host"]]
            if found := shared(me["sigs"], me["sizes"], me["named"], others):
                keys.append(me["key"])
                gone.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(gone, pa.list_(pa.int32()))], names=["__key", "__gone"])


def written_out(batches):
    """The texts: __html and __gone are the last two columns."""
    for batch in batches:
        texts = []
        for page, gone in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
            found, stay, _ = lines(page.as_py() or "")
            for i in gone.as_py() or ():
                stay[i] = False
            texts.append("\n".join(t for t, s in zip(found, stay) if s))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-2], "text", "n_chars"])


def shared_lines(pages: DataFrame) -> DataFrame:
    """__key (`row_key` of page_id, url, html) and __gone, the numbers of the lines that differencing deletes; only pages that lose lines."""
    host, path = host_and_path(F.col("url"))
    read = pages.select(row_key("page_id", "url", "html").alias("key"), host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).alias("url"), F.col("html").alias("__html"))
    one = read.mapInArrow(released(hashed), "key string, host string, path string, url string, sigs array<long>, sizes array<int>, named boolean").groupBy("key", "host", "path", "url").agg(*(F.first(c).alias(c) for c in ("sigs", "sizes", "named")))
    placed = numbered_globally(materialize(one), ["host", "path", "url", "key"], "n")
    step = F.explode(F.array(*(F.lit(k) for k in (-2, -1, 0, 1, 2)))).alias("step")
    # a page stands at its own number and at those of the pages that it is near to
    near = placed.select(step, "*").groupBy((F.col("n") - F.col("step")).alias("n")).agg(F.collect_list(F.struct("step", "key", "host", "sigs", "sizes", "named")).alias("near"))
    return near.select("near").mapInArrow(released(compared), "__key string, __gone array<int>")


def main_text(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, url, the columns in `keep`, text, n_chars: one row a page."""
    gone = materialize(shared_lines(pages))
    rows = pages.select(row_key("page_id", "url", "html").alias("__key"), "page_id", "url", *keep, F.col("html").alias("__html")).join(gone, "__key", "left").select("page_id", "url", *keep, "__html", "__gone")
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(released(written_out), schema)
