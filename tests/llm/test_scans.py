"""Personal data, secrets and URL rules against plain loops."""

import collections
import hashlib
import itertools
import math
import random
import re

from gaugeworks.llm import pii, secrets, urlrules

EMAIL, IP, CARD, PHONE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(t):
    digits = lambda m: re.sub(r"\D", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_base_personal_data():
    rng = random.Random(3)
    for _ in range(20_000):
        s = "".join(rng.choice("a.b@@1+2 -()3.é4@c9_%0") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(s) == plain_pii(s)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    pii.base_spans("1" * 200_000 + "@" * 1000)  # linear


def test_personal_data_rows(spark):
    rows = [(1, "write a@b.co or call (212) 555-0188, in 1998"), (2, None), (3, ""), (1, "é 8.8.8.8 x")]
    got = pii.personal_data(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, found string")).collect()
    assert sorted((r.doc_id, r.n_email, r.n_ip) for r in got) == [(1, 0, 1), (1, 1, 0), (2, 0, 0), (3, 0, 0)]
    one = next(r for r in got if r.n_email)
    assert one.base_sha256 == hashlib.sha256(b"email:6:12").hexdigest() and "phone:21:35" in one.spans and one.spans.startswith("email:6:12")
    assert next(r for r in got if r.n_ip).spans == "ip:2:9"
    assert pii.personal_data(spark.createDataFrame([(1, "(212) 555-0188")], "doc_id long, text string"), labelled=[]).first().spans == ""
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string, spans string")).count() == 0


def test_addresses_far_from_digits_are_decoded(spark):
    prose = "the old house stands by the river and nobody goes there in the evening, " * 2
    forms = [t[a:b] for t, spans in map(pii.parse, pii.TRAINING) for k, a, b in spans if k == 0 and not re.search(r"[0-9]", t[a:b])]
    forms += [f.upper() for f in forms] + ["jane_dot_doe_at_mail_dot_com", "x" * 90 + "_" + "y" * 90 + " (at) " + "z" * 90 + ".example.com"]
    for form in forms:
        text = f"{prose}write to {form} soon, {prose}"
        at = text.index(form)
        assert any(a <= at and at + len(form) <= b for a, b in pii.stretches(text)), form
    said = ["address max.mustermann [at] mail.example.com or", "e-mail: anna_k (at) web.de.", "write JANE DOT DOE AT MAIL DOT COM soon"]
    found = [r.found for r in pii.personal_data(spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [[t[s.start : s.end] for s in f] for t, f in zip(said, found)] == [["max.mustermann [at] mail.example.com"], ["anna_k (at) web.de"], ["JANE DOT DOE AT MAIL DOT COM"]]
    assert pii.stretches(prose) == [] and pii.stretches(("x" * 200 + "7") * 5000) == [(0, 1_005_000)]  # linear


def test_windows_of_a_long_text_hold_every_token_once():
    rng = random.Random(6)
    text = "".join(rng.choice(["7 ", "at ", "x.y ", "@", "12-3 ", "(5) "]) for _ in range(6000))
    own = [t for held, first, last, _ in pii.windows(text) for t in held[first:last]]
    assert own == pii.tokens(text, 0, len(text)) and max(len(held) for held, _, _, _ in pii.windows(text)) <= pii.STEP + 2 * pii.OVER
    tagger = pii.fit(pii.TRAINING)
    call = "call (415) 555-0132 now, or write to anna_k (at) web.de. Then 12 more. "
    text = call * 400
    found = pii.decoded(tagger, [text, call], 3000)
    assert found[0] == [(k, a + i * len(call), b + i * len(call)) for i in range(400) for k, a, b in found[1]] and len(found[1]) == 2


def test_a_span_that_a_window_cuts_is_decoded_to_its_end():
    """An address of 60 parts behind ever more numbers: wherever windows fall, it is found as in the whole text."""
    tagger = pii.fit(pii.TRAINING)
    form = "write to anna at " + " dot ".join(["mail"] * 60) + " dot com"
    for n in (0, 350, 370, 380, 390, 395, 398, 399, 405, 450):
        text = "7 " * n + form
        [whole] = tagger.spans([pii.tokens(text, 0, len(text))])
        assert pii.decoded(tagger, [text])[0] == [tuple(x) for x in whole], n
        assert any(b == len(text) for _, _, b in whole)


def test_long_text_of_numbers_in_bounded_memory():
    import subprocess
    import sys

    code = """
import resource, sys
sys.path.insert(0, '.')
from gaugeworks.llm import pii
tagger = pii.fit(pii.TRAINING)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = '12 345 6 ' * 110_000
pii.base_spans(text)
pii.decoded(tagger, [text])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 300_000  # KB


def plain_spans(tagger, text):
    """The tagger's spans by trying all label paths of a short text."""
    own = pii.tokens(text, 0, len(text))
    emit = tagger.weights[[[tagger.known.get(f, len(tagger.known)) for f in fs] for fs in pii.features([t[:2] for t in own])]].sum(1)
    score = lambda path: tagger.first[path[0]] + sum(emit[i, k] for i, k in enumerate(path)) + sum(tagger.move[a, b] for a, b in zip(path, path[1:]))
    path = max(itertools.product(range(len(pii.LABELS)), repeat=len(own)), key=score)
    out = []
    for (_, _, a, b), k in zip(own, path):
        if k % 2:
            out.append([(k - 1) // 2, a, b])
        elif k:
            out[-1][2] = b
    return [tuple(s) for s in out if pii.complete(s[0], [t[0] for t in own if s[1] <= t[2] and t[3] <= s[2]])]


def test_crf_spans_by_trying_all_paths():
    tagger = pii.fit(pii.TRAINING)
    for text in ("tel 555-0142 now", "bob at x.org", "8.8.8", "in 1998 a", "ask 415 5550"):
        assert tagger.spans([pii.tokens(text, 0, len(text))])[0] == plain_spans(tagger, text), text


def test_addresses_of_many_tokens():
    tagger = pii.fit(pii.TRAINING)
    for form in ("jane [dot] doe [at] mail [dot] example [dot] com", "jane dot m dot doe [at] cs [dot] mail [dot] example [dot] org"):
        text = f"write {form} soon"
        assert [text[a:b] for _, a, b in tagger.spans([pii.tokens(text, 0, len(text))])[0]] == [form]


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets(spark):
    rng = random.Random(2)
    parts = ["token", "Password", "secret", "api_key", "APIKEY", "passwd", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "abc", "0123456789abcdef" * 2, "deadbeef", "é🙂", "-", "/", "hunter22", ".", "\n", "X9"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(600)] + [(-1, None), (-2, ""), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda t: hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in plain_secrets(t or "")).encode()).hexdigest()
    got = secrets.secrets(df).collect()
    assert sorted((r.doc_id, r.base_sha256) for r in got) == sorted((i, digest(t)) for i, t in rows)
    clean = {r.text for r in secrets.redacted(df.where("doc_id < 0 OR doc_id > 590")).collect()}
    assert None in clean and not any(plain_secrets(t) for t in clean if t and "AKIA" not in t and "SECRET]" not in t)


def test_random_tokens_are_found_and_names_are_not(spark):
    rng = random.Random(4)
    key = lambda n: "".join(rng.choice(secrets.ALPHABETS["base64"]) for _ in range(n))
    rows = [(i, f"a {key(40)} b Internationalization2Abcdefghijkl aaaaaaaaaaaaaaaaaaaaaaaA1 some_long_identifier_name_2024") for i in range(100)]
    got = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [s for r in got for s in r.spans.split(",") if s]
    assert len(found) >= 85 and set(found) == {"random:2:42"}


def plain_tail(z):
    x = min(max(z, -30.0), 30.0)
    return 1 / (1 + math.exp(1.5976 * x + 0.07056 * x**3))


def plain_test(token):
    """(encoding, length class, bin of the p-value) of a candidate, or None: the battery as its docstring states it."""
    if re.fullmatch("[0-9]+", token):
        return None
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        enc, own, letters = "hex", token.lower(), "0123456789abcdef"
    elif re.fullmatch("[A-Z2-7]+=*", token) and re.search("[2-7]", token):
        enc, own, letters = "base32", token.rstrip("="), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    elif re.search("[A-Za-z]", token) and (re.search("[0-9]", token) or re.search("[a-z]", token) and re.search(".[A-Z]", token)) and not re.search("[+/_-]{3}", token):
        enc, own, letters = "base64", token.replace("-", "+").replace("_", "/").replace("=", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    else:
        return None
    n, k = len(own), len(letters)
    x = n * (k * sum((own.count(c) / n) ** 2 for c in letters) - 1)
    skew = 2.0
    p = 1 - plain_tail((x - (k - 1 + (n - 1) * skew)) / math.sqrt(2 * (k - 1) + 4 * n * skew))
    v = [letters.index(c) - (k - 1) / 2 for c in own]
    changes, high = sum((a > 0) != (b > 0) for a, b in zip(v, v[1:])), sum(a > 0 for a in v)
    both = 2 * high * (n - high)
    runs = (changes - both / n) / math.sqrt(max(both * (both - n) / (n * n * (n - 1)), 1e-9))
    serial = sum(a * b for a, b in zip(v, v[1:])) / max(sum(a * a for a in v), 1e-9) * math.sqrt(n)
    if 2 * plain_tail(abs(runs)) < 1e-3 or 2 * plain_tail(abs(serial)) < 1e-3:
        p = 1
    return enc, int(math.log2(n)), math.floor(-10 * math.log10(max(p, 1e-39)))


def test_battery_and_false_discovery_control_against_plain_loops(spark):
    rng = random.Random(9)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    make = [
        lambda: some(secrets.ALPHABETS["base64"], rng.randint(20, 90)), lambda: some(secrets.ALPHABETS["base32"], rng.randint(20, 60)) + "=" * rng.randint(0, 3), lambda: some("0123456789ABCDEF", rng.randint(20, 80)),
        lambda: some("aaaeeiostrn", 30) + "X" + some("aeiotn", 9), lambda: "-".join(some("abcdefgh", 6) for _ in range(5)) + "7", lambda: "abcdefghijklmnopqrstuvwxyzABC" + some("0123456789", 2), lambda: some("0123456789", 30), lambda: "A1" * 20, lambda: some("abc", 12) + some("xyzXYZ", 18),
    ]
    rows = [(i, "é " + " | ".join(rng.choice(make)() for _ in range(rng.randint(0, 4))) + " .") for i in range(700)]
    found = [(i, m.start(), m.end(), plain_test(m[0])) for i, t in rows for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t)]
    found = [x for x in found if x[3]]
    expected = set()
    for stratum in {x[3][:2] for x in found}:
        bins = [x[3][2] for x in found if x[3][:2] == stratum]
        good = [b for b in set(bins) if len(bins) * 10 ** (-b / 10) <= 0.01 * sum(c >= b for c in bins)]
        expected |= {x[:3] for x in found if x[3][:2] == stratum and good and x[3][2] >= min(good)}
    taken = {i: plain_secrets(t) for i, t in rows}
    expected = {(i, a, b) for i, a, b in expected if not any(s < b and a < e for s, _, e in taken[i])}
    got = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, s.start, s.end) for r in got for s in r.found if s.kind == "random"} == expected and 100 < len(expected) < len(found) - 100


def test_secrets_in_a_long_text(spark):
    """Nearly linear in the matches; bytes and code points differ; overlapping spans become one marker."""
    n = 40_000
    df = spark.createDataFrame([(1, "é token = abcdefgh1234 x " * n), (2, "é secret=" + "0123456789abcdef" * 2 + "-tail é")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.secrets(df.withColumn("assign", df.doc_id).withColumn("tests", df.doc_id)).collect()}
    assert got[1].n_assign == n and got[2].n_assign == got[2].n_hex == 1
    assert {r.doc_id: r.text for r in secrets.redacted(df).collect()} == {1: "é [SECRET] x " * n, 2: "é [SECRET] é"}
    assert secrets.secrets(df.where("false")).count() == secrets.redacted(df.where("false")).count() == 0


def test_url_rules(spark):
    urls = ["https://WWW.Example.com/en/x", "http://m.example.com/en/1", "http://a.net/es/?q", "http://b.net/es", "https://casino.example.org/", "https://casinos.example.org/", "https://casino.xyz/", "nothing", None, "http://net/fr/", "http://track.example.net/public/x", "http://x.net/banner/9/ad?z", "://com/"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.verdicts(rows.select("page_id", "url")).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2][1:] == ("/es/", "net/es/", "block") and got[3][1:] == ("/es", None, "allow")
    assert got[4][2:] == (None, "allow") and got[5][3] == "allow" and got[6][3] == "block"  # an exception holds for example.org
    assert got[7] == got[8] == ("", "", None, "allow") and got[9][2] == "net/fr/" and got[10][3] == "allow" and got[11][3] == "block" and got[12][2] == "com/"


#: The pattern rules once more, written by hand; (block, regex on the URL in lower case).
BY_HAND = [
    (True, r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?adserver\..*([^a-z0-9_.%-]|$)"),
    (True, r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?ads\..*([^a-z0-9_.%-]|$)"),
    (True, r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?track\..*([^a-z0-9_.%-]|$)"),
    (True, r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?tracker\..*([^a-z0-9_.%-]|$)"),
    (True, r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?doubleclick\.net([^a-z0-9_.%-]|$)"),
    (True, r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?casino\..*([^a-z0-9_.%-]|$)"),
    (True, r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?ads-.*([^a-z0-9_.%-]|$)"),
    (True, r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?casino-.*([^a-z0-9_.%-]|$)"),
    (True, r"([^a-z0-9_.%-]|$)utm_source=feed([^a-z0-9_.%-]|$)"),
    (True, r"/banner/.*/ad([^a-z0-9_.%-]|$)"),
    (True, r"/popup/.*\.js$"),
    (True, r"([^a-z0-9_.%-]|$)utm_medium=spam([^a-z0-9_.%-]|$)"),
    (True, r"([^a-z0-9_.%-]|$)sessionid=.*([^a-z0-9_.%-]|$)tracking="),
    (True, r"/wp-login\.php([^a-z0-9_.%-]|$)"),
    (True, r"/porn/"),
    (True, r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?malware\..*([^a-z0-9_.%-]|$)download([^a-z0-9_.%-]|$)"),
    (False, r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?example\.org([^a-z0-9_.%-]|$)"),
    (False, r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?track\.example\.net([^a-z0-9_.%-]|$)public([^a-z0-9_.%-]|$)"),
]


def plain_verdict(url):
    """(host, path, rule, verdict) by loops over all rules."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda s, stops: s[: min([i for i in map(s.find, stops) if i >= 0], default=len(s))]
    host = cut(rest, "/?#")
    path, host = cut(rest[len(host) :], "?#"), host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), h + p, v) for h, p, v in urlrules.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    found = {block for block, regex in BY_HAND if re.search(regex, (url or "").lower(), re.DOTALL)}
    return host, path, None, "block" if found == {True} else "allow"


def test_patterns_against_rules_written_by_hand(spark):
    rng = random.Random(12)
    hosts = ["ads.x.org", "a.ads.io", "track.example.net", "tracker.b.fr", "casino.example.org", "x.casino.de", "malware.test", "doubleclick.net", "example.org", "Www.Example.org", "shop.de", "example.com", "b.example.com", "www.example.com", "x.net", "loads.org", "m.casino-win.example.fr", "ads-track.net"]
    parts = ["banner", "7", "ad", "ads.js", "popup", "x.js", "wp-login.php", "wp-login.phpx", "porn", "download", "public", "en", "es", "fr", "EN", "é"]
    queries = ["", "?utm_medium=spam", "?utm_source=feed", "?utm_source=feeds", "?a=1&utm_medium=spam&b", "?sessionid=4;tracking=1", "?sessionid=4&tracking=1", "#/porn/", "?q=utm_medium=spammer", "?"]
    urls = [rng.choice(["http", "https", "HTTP", "ftp"]) + "://" + rng.choice(hosts) + "".join("/" + rng.choice(parts) for _ in range(rng.randint(0, 4))) + rng.choice(["", "/"]) + rng.choice(queries) for _ in range(4000)]
    urls += [None, "", "no scheme", "://", "http://", "x" * 200_000 + "://ads.x.org/", "http://shop.de/" + "a/" * 100_000 + "porn/", "http://ads.x.org/\n"]
    rows = spark.createDataFrame([(i % 3900, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string, u string")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrules.verdicts(rows).collect())
    assert got == collections.Counter((i % 3900, *plain_verdict(u)) for i, u in enumerate(urls))
    assert sum(n for (*_, rule, verdict), n in got.items() if rule is None and verdict == "block") > 300
    assert urlrules.verdicts(rows.where("false")).count() == 0


def test_tokens_of_a_rule_are_in_every_url_it_fits():
    for rule in urlrules.compiled():
        if not rule["host"]:
            body = rule["rule"].removeprefix("@@").strip("|").replace("^", "/").replace("*", "QQ")
            url = f"http://{body}" if rule["rule"].removeprefix("@@").startswith("||") else f"http://h.org{'' if body.startswith('/') else '/'}{body}"
            assert re.search(rule["regex"], url), (rule, url)
            assert rule["tokens"] <= set(re.split("[^a-z0-9%]+", url.lower()))
