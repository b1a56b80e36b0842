"""Main text of pages: markup, alignment, differencing, and the whole query against plain loops."""

import random
import re

import pytest

from gaugeworks.llm import pagetext, registry

SF = "/root/testdata/sf0.001"


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 26, 4])
def test_alignment_is_a_longest_common_subsequence(bits):
    r = random.Random(1)
    for _ in range(800):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 14))] for _ in range(2))
        found = pagetext.aligned(a, b, bits)
        rest = iter(b)
        assert found == sorted(set(found)) and len(found) == longest(a, b) and all(any(a[i] == y for y in rest) for i in found)


@pytest.mark.parametrize("page, text", [
    ("<article><p>don't <b>x<br>y", "don't x y"),
    ("a < b &amp; c &lt;p&gt;<p>d", "a < b & c <p>\nd"),
    ("<div class=ad>x</div><p>y</p><footer>f", "y"),
    ("<p>t<ul><li><a href=a>a</a><li><a href=b>b</a><li><a href=c>c</a></ul>", "t"),
    ("<header><h1>Site</h1></header><main><article><header><h1>T</h1>by</header><p>x&nbsp;\n y</article><p>more</main>", "T\nx y"),
    ("<script>if(a<b)</script><style>p{}</style><!-- no --><title>t</title>z", "z"),
    ("<article>q</article><article class='comment'>r</article><section id='reader-comments'>s</section>", "q"),
    ("<div class='cookie-notice'>n</div><form>f</form><div role=navigation>m</div><p hidden>h</p><p style='display: none'>i</p><p class='has-sidebar'>k</p>", "k"),
    ("<p title=\"a>b\">ok<table><tr><td>1</td><td>2</td></tr><tr><td>3</table>", "ok\n1 2\n3"),
    ("<div id=content><p>in</p></div><p>out</p>", "in"),
    ("<nav>", ""), ("x <b", "x"), ("", ""),
])
def test_markup(page, text):
    lines, stay, _ = pagetext.lines(page)
    assert "\n".join(x for x, s in zip(lines, stay) if s) == text


def test_hostile_markup_takes_linear_time():
    for page in ("<p><table>" + "<i>" * 100_000 + "<div>" * 100_000 + "<li>" * 50_000, '<a "' * 200_000 + "<b ='" * 100_000, "<p>x" * 200_000, "<" * 300_000):
        pagetext.lines(page)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_lines_that_neighbours_share_go(spark):
    body = lambda k: f"<p>Welcome to the site</p><p>Story {k} begins with number {k * k}.</p><p>It ends {k}.</p><p>Read more below</p>"
    rows = [(k, f"https://h.example/a/{k:03}", body(k)) for k in range(9)] + [(100, "https://other.example/a/000", body(0))]
    got = texts(pagetext.main_text(pages(spark, rows)))
    assert all(got[k] == f"Story {k} begins with number {k * k}.\nIt ends {k}." for k in range(9))
    assert got[100].startswith("Welcome")  # the only page of its host


def test_copies_are_no_neighbours_and_not_every_neighbour_is_not_enough(spark):
    same = "<p>The very same article, word for word.</p><p>And its second line.</p>"
    rows = [(k, f"https://h.example/{k}", same) for k in range(4)]
    assert set(texts(pagetext.main_text(pages(spark, rows))).values()) == {"The very same article, word for word.\nAnd its second line."}
    licence = "<p>Under some licence.</p>"
    mixed = [(k, f"https://h.example/{k}", f"<p>Long story number {k}, told at length here.</p>" + licence * (k in (2, 3))) for k in range(6)]
    assert texts(pagetext.main_text(pages(spark, mixed)))[2].endswith("licence.")
    for tag, ends in (("article", "licence."), ("div", "here.")):
        two = [(k, f"https://h.example/{k}", f"<{tag}><p>Long story number {k}, told at length here.</p>{licence}</{tag}>") for k in range(2)]
        assert texts(pagetext.main_text(pages(spark, two)))[0].endswith(ends)


def test_defined_cases(spark):
    rows = [(1, None, None), (2, "no scheme", "<p>a</p>"), (None, "https://x/a", ""), (3, "https://x/a", "<p>twice</p>"), (3, "https://x/a", "<p>twice</p>"), (4, "HTTP://X/b", "<p>" + "long words " * 300_000)]
    df = pages(spark, rows).selectExpr("*", "1 AS n", "2 AS host", "'x' AS text", "3 AS __key", "4 AS sigs")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in pagetext.main_text(df, ("n",)).collect()), key=str)
    long = " ".join(["long words"] * 300_000)
    assert got == sorted([(1, None, "", 0), (2, "no scheme", "a", 1), (None, "https://x/a", "", 0), (3, "https://x/a", "twice", 5), (3, "https://x/a", "twice", 5), (4, "HTTP://X/b", long, len(long))], key=str)
    assert pagetext.main_text(df.where("false")).count() == 0


def plain(rows):
    """The whole operator by loops."""
    host = lambda u: re.sub(r"[A-Z]", lambda m: m.group().lower(), re.match(r"[^/?#]*", u.partition("://")[2]).group())
    path = lambda u: re.match(r"[^/?#]*([^?#]*)", u.partition("://")[2], re.S).group(1)
    order = sorted(rows, key=lambda r: (host(r[1]).encode(), path(r[1]).encode(), r[1].encode()))
    out = {}
    for k, (page_id, url, html) in enumerate(order):
        mine, stay, named = pagetext.lines(html)
        votes, voters = [0] * len(mine), 0
        for j in (k - 2, k - 1, k + 1, k + 2):
            if 0 <= j < len(order) and host(order[j][1]) == host(url):
                theirs, kept, _ = pagetext.lines(order[j][2])
                same = pagetext.aligned(mine, theirs)
                if 4 * sum(len(mine[i]) for i in same if stay[i]) < sum(len(x) for x, s in zip(mine, stay) if s) + sum(len(x) for x, s in zip(theirs, kept) if s):
                    voters += 1
                    for i in same:
                        votes[i] += 1
        out[page_id] = "\n".join(x for x, s, v in zip(mine, stay, votes) if s and not (v and v == voters > named))
    return out


def test_query_against_plain_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    found = registry.op11_page_text(spark, SF).collect()
    assert {r.page_id: r.text for r in found} == plain(rows) and all(r.n_chars == len(r.text) for r in found)
