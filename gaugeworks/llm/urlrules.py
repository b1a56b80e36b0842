r"""URL filter: pattern rules indexed by their rarest literal token. Native: DataFrame functions only.

Two kinds of rules go into one index. Host rules are (host, path): they fit the
host and its subdomains where the path starts with theirs; the longest wins.
Pattern rules are in the common filter-list syntax: `*` is anything, `^` a
separator or the end, `||` the start of the host or of one of its labels, a
single `|` the very start or end, and a leading `@@` an exception. A URL that
no host rule fits is blocked if a pattern fits and no exception does.

A rule's literal tokens are the runs of [a-z0-9%] in it that separators bound
on both sides, so every URL that the rule fits has them as whole tokens. How
often they occur in all URLs is counted first (only for tokens of rules, so
what is gathered is bounded by the rule list); each rule is indexed under its
rarest one. A URL's tokens fetch candidates, and only those run their regular
expression. Rules without a token are candidates for every URL.

Defined cases: a null URL or one without `://` has an empty host and path and
no host rule; patterns still see the URL (null: none fits, so it is allowed).
Of host rules of one length that fit, the last by name wins. URLs of any length
are read whole. Rows are judged one by one, so repeated ids and rows stay; an
empty table gives no rows; other columns are not read, whatever their names. No
row is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the rule set in use: (host, path, verdict).
HOST_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
PATTERN_RULES = [
    "||adserver.*^",
    "||ads.*^",
    "||track.*^",
    "||tracker.*^",
    "||doubleclick.net^",
    "||casino.*^",
    "||ads-*^",
    "||casino-*^",
    "^utm_source=feed^",
    "/banner/*/ad^",
    "/popup/*.js|",
    "^utm_medium=spam^",
    "^sessionid=*^tracking=",
    "/wp-login.php^",
    "/porn/",
    "||malware.*^download^",
    "@@||example.org^",
    "@@||track.example.net^public^",
]
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_regex(host: str, path: str) -> str:
    """On host || path."""
    return rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"


def pattern_regex(rule: str) -> str:
    """On the URL, without regard to case."""
    body = rule.removeprefix("@@")
    start = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if body.startswith("||") else "^" if body.startswith("|") else ""
    body, end = body.lstrip("|"), ""
    if body.endswith("|"):
        body, end = body[:-1], "$"
    parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}
    return "(?is)" + start + "".join(parts.get(c) or re.escape(c) for c in body) + end


def literal_tokens(body: str, open_start: bool, open_end: bool) -> set[str]:
    """Tokens that any URL with `body` in it has whole. open_*: whether token characters may adjoin the ends."""
    edged = ("*" if open_start else "^") + body.lower() + ("*" if open_end else "^")
    return {m[1] for m in re.finditer(r"(?<=[^a-z0-9%*])([a-z0-9%]+)(?=[^a-z0-9%*])", edged)}


def compiled(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> list[dict]:
    out = [{"rule": h + p, "verdict": v, "host": True, "size": len(h + p), "regex": host_regex(h, p), "tokens": literal_tokens(h + p, False, True)} for h, p, v in host_rules]
    for rule in pattern_rules:
        body = rule.removeprefix("@@")
        tokens = literal_tokens(body.strip("|"), not body.startswith("|"), not body.endswith("|"))
        out.append({"rule": rule, "verdict": "allow" if rule.startswith("@@") else "block", "host": False, "size": len(body), "regex": pattern_regex(rule), "tokens": tokens})
    return out


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.translate(url, *LOWER), "[^a-z0-9%]+"))


def token_counts(pages: DataFrame, url: str, vocabulary: set[str]) -> dict[str, int]:
    tokens = pages.select(F.explode(url_tokens(F.col(url))).alias("token")).where(F.col("token").isin(*vocabulary))
    return {r.token: r["count"] for r in tokens.groupBy("token").count().collect()}


def rarest(rules: list[dict], counts: dict[str, int]) -> dict[str, list[dict]]:
    index: dict[str, list[dict]] = {}
    for r in rules:
        index.setdefault(min(r["tokens"], key=lambda t: (counts.get(t, 0), -len(t), t), default=""), []).append(r)
    return index


def rule_column(r: dict) -> Column:
    return F.struct(*(F.lit(r[k]).alias(k) for k in ("size", "rule", "verdict", "host", "regex")))


def verdicts(pages: DataFrame, key: str = "page_id", url: str = "url", host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """key, host, path, rule, verdict, patterns (those that fit)."""
    rules = compiled(host_rules, pattern_rules)
    vocabulary = {t for r in rules for t in r["tokens"]}
    index = rarest(rules, token_counts(pages, url, vocabulary) if vocabulary else {})
    always, index = index.pop("", []), index
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)://([^/?#]*)", 1), *LOWER)
    path = F.regexp_extract(u, r"(?s)://[^/?#]*([^?#]*)", 1)
    kind = "array<struct<size:int,rule:string,verdict:string,host:boolean,regex:string>>"
    found = F.array(*map(rule_column, always)).cast(kind)
    if index:
        by_token = F.create_map(*(x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(rule_column, rs)))))
        known = F.array(*map(F.lit, sorted(index)))
        found = F.concat(found, F.flatten(F.transform(F.array_intersect(url_tokens(u), known), lambda t: F.element_at(by_token, t))).cast(kind))
    fitting = F.filter(F.col("found"), lambda r: F.when(r["host"], F.regexp_like(F.col("place"), r["regex"])).otherwise(F.regexp_like(F.col("u"), r["regex"])))
    best = F.array_max(F.filter("fitting", lambda r: r["host"]))
    blocked = F.exists("fitting", lambda r: ~r["host"] & (r["verdict"] == "block")) & ~F.exists("fitting", lambda r: ~r["host"] & (r["verdict"] == "allow"))
    return (
        pages.select(key, u.alias("u"), host.alias("host"), path.alias("path"), found.alias("found"))
        .withColumn("place", F.concat("host", "path"))
        .withColumn("fitting", F.when(F.size("found") > 0, fitting).otherwise(F.array().cast(kind)))
        .withColumn("best", best)
        .select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), F.transform(F.filter("fitting", lambda r: ~r["host"]), lambda r: r["rule"]).alias("patterns"))
    )
