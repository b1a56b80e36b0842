r"""Secret scan: fixed patterns, and a battery of randomness tests. Native: DataFrame functions only.

Patterns find assignments, access keys and long hex runs. Beside them every run
of [A-Za-z0-9+/_=-] of `min_length` characters or more is a candidate, if an
encoding can be inferred: hex (one case), base32, or base64 (a digit, or both
cases beyond the first letter). Plain words and numbers have none. Tests, per
encoding with k symbols and token length n:

* uniformity: X = n * (k * sum((c/n)^2) - 1) against its law for text-like
  tokens, whose symbols are skewed by `text_skew` (noncentral chi-squared,
  normal approximation). Its lower tail is the p-value; a short token cannot
  reach a small one, which makes the control below length-aware.
* runs: Wald-Wolfowitz on the symbol's upper half, two-sided.
* serial correlation: lag 1, two-sided.

A token that the last two call non-random at `order_level` has p = 1. Then
Benjamini-Hochberg at `fdr` within each stratum (encoding, power-of-two length
class), over the candidates of all documents: p-values go into bins of a tenth
of a decade, whose counts (at most strata x 400 rows) give each stratum's cut.
A discovery is a span of kind `random` unless it overlaps a pattern's span.

Positions come from splitting the text at the matches and adding up lengths
(code points, and bytes for cutting texts), in blocks, so that the time is
nearly linear in the matches. Rows with matches are few; texts are read once
and never shuffled, and what the tests need is kept as a table of small rows.

Defined cases: a null text is empty; texts are read whole; repeated ids and
rows stay as rows of their own; p-values of one bin are accepted or refused
together; an empty table gives no rows; further columns are not read, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

#: Fixed patterns (Java syntax); letters of the keyword in either case.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"  # a maximal run, as [0-9a-f]+ takes it
KINDS = ("assign", "access", "hex")
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
PLACE = ("start", "end", "byte_start", "byte_end")
SPAN = f"array<struct<{','.join(f'{p}:int' for p in PLACE)}>>"
BLOCK = 256


def bound(value: Column, body) -> Column:
    """body(value), with `value` worked out once however often `body` has it."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, start: Column, step, together, make, kind: str) -> Column:
    """make(item, state before it) for each item; step(state, item) is the state after it, together(state, block) after a block.

    An array grows by one copy an item, so it is built in blocks.
    """

    def of_blocks(blocks):
        states = F.aggregate(blocks, F.struct(start.alias("s"), F.array(start).alias("all")), lambda a, b: bound(together(a["s"], b), lambda s: F.struct(s.alias("s"), F.array_append(a["all"], s).alias("all"))), lambda a: a["all"])
        none = F.array().cast(f"array<{kind}>")

        def within(block, state):
            first = F.struct(state.alias("s"), none.alias("out"))
            return F.aggregate(block, first, lambda a, x: F.struct(step(a["s"], x).alias("s"), F.array_append(a["out"], make(x, a["s"])).alias("out")), lambda a: a["out"])

        return bound(states, lambda known: F.flatten(F.transform(blocks, lambda b, i: within(b, F.get(known, i)))))

    def cut(whole):
        count = F.ceil(F.size(whole) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(whole, i * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(whole) > 0, bound(blocks, of_blocks)).otherwise(F.array().cast(f"array<{kind}>"))

    return bound(items, cut)


def located(text: Column, pattern: str) -> Column:
    """(start, end, byte_start, byte_end, match) of every match of `pattern`, leftmost and non-overlapping."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.octet_length(g).alias("gap_bytes"), F.length(m).alias("n"), F.octet_length(m).alias("bytes"), m.alias("match")))
    both = lambda c, b: F.struct(c.cast("int").alias("c"), b.cast("int").alias("b"))
    after = lambda s, x: both(s["c"] + x["gap"] + x["n"], s["b"] + x["gap_bytes"] + x["bytes"])

    def made(x, s):
        start, byte = s["c"] + x["gap"], s["b"] + x["gap_bytes"]
        return F.struct(start.alias("start"), (start + x["n"]).alias("end"), byte.alias("byte_start"), (byte + x["bytes"]).alias("byte_end"), x["match"].alias("match"))

    # after the last match there is one more gap, without a match
    matches = F.slice(pairs, 1, F.size(found))
    return running(matches, both(F.lit(0), F.lit(0)), after, lambda s, block: F.aggregate(block, s, after), made, SPAN[6:-2] + ",match:string>")


def base_spans(text: Column) -> list[Column]:
    none = F.array().cast(SPAN)
    place = lambda s: F.struct(*(s[p].alias(p) for p in PLACE))
    bare = lambda spans: F.transform(spans, place)
    assign = located(text, ASSIGN)
    long = F.filter(F.arrays_zip(assign.alias("s"), F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.length).alias("n")), lambda z: z["n"] >= 8)
    assigned = F.transform(long, lambda z: place(z["s"]))
    access = F.filter(located(text, ACCESS), lambda s: s["end"] - s["start"] >= 16)
    return [
        F.when(text.rlike(ASSIGN), assigned).otherwise(none).cast(SPAN),
        F.when(F.contains(text, F.lit("AKIA")), bare(access)).otherwise(none).cast(SPAN),
        F.when(text.rlike(HEX), bare(located(text, HEX))).otherwise(none).cast(SPAN),
    ]


def tail(z: Column) -> Column:
    """Upper tail of the standard normal, by the logistic approximation (monotone, within 2e-4)."""
    x = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
    return 1.0 / (1.0 + F.exp(1.5976 * x + 0.07056 * x * x * x))


def encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9]+$"), None)
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$") & token.rlike("[2-7]"), "base32")
        .when(token.rlike("[A-Za-z]") & (token.rlike("[0-9]") | (token.rlike("[a-z]") & token.rlike(".[A-Z]"))) & ~token.rlike("[+/_-]{3}"), "base64")
    )


def symbols(token: Column, enc: Column) -> Column:
    """The token in its encoding's own alphabet, without padding."""
    return F.when(enc == "hex", F.lower(token)).when(enc == "base32", F.rtrim(token, F.lit("="))).otherwise(F.translate(token, "-_=", "+/"))


def tested(spans: Column, text_skew: float, order_level: float) -> Column:
    """Adds encoding, length class and the p-value's bin to each candidate span."""

    def one(x):
        s, enc = x["s"], x["encoding"]
        k = F.when(enc == "hex", 16.0).when(enc == "base32", 32.0).otherwise(64.0)
        alphabet = F.when(enc == "hex", ALPHABETS["hex"]).when(enc == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
        known = F.struct(symbols(s["match"], enc).alias("token"), alphabet.alias("alphabet"), k.alias("k"))
        bin_ = bound(known, lambda t: bound(counted(t), lambda c: bound(sums(c), lambda r: F.floor(-10 * F.log10(p_value(c, r))).cast("int"))))
        size = F.floor(F.log2(F.length(symbols(s["match"], enc)).cast("double"))).cast("int")
        return F.struct(*(s[p].alias(p) for p in PLACE), enc.alias("encoding"), size.alias("size"), bin_.alias("bin"))

    def counted(t):
        token, alphabet, k = t["token"], t["alphabet"], t["k"]
        n = F.length(token)
        squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda a, c: a + F.pow((n - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2)))
        ids = F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double") - 1 - (k - 1) / 2)
        return F.struct(k.alias("k"), n.cast("double").alias("n"), squares.alias("squares"), ids.alias("centred"))

    def sums(c):
        """Changes of half, symbols of the upper half, squares and products of neighbours, in one pass."""
        zero = F.struct(F.lit(None).cast("double").alias("last"), *(F.lit(0.0).alias(x) for x in ("changes", "high", "power", "serial")))

        def step(a, v):
            changed = F.when((a["last"] > 0) != (v > 0), 1.0).otherwise(0.0)  # null at the first: no change
            return F.struct(v.alias("last"), (a["changes"] + changed).alias("changes"), (a["high"] + F.when(v > 0, 1.0).otherwise(0.0)).alias("high"), (a["power"] + v * v).alias("power"), (a["serial"] + F.coalesce(a["last"] * v, F.lit(0.0))).alias("serial"))

        return F.aggregate(c["centred"], zero, step)

    def p_value(c, r):
        k, n = c["k"], c["n"]
        x = k * c["squares"] / n - n
        mean, var = k - 1 + (n - 1) * text_skew, 2 * (k - 1) + 4 * n * text_skew
        uniform = F.lit(1.0) - tail((x - mean) / F.sqrt(var))
        both = 2 * r["high"] * (n - r["high"])
        runs = (r["changes"] - both / n) / F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        serial = r["serial"] / F.greatest(r["power"], F.lit(1e-9)) * F.sqrt(n)
        ordered = (2 * tail(F.abs(runs)) < order_level) | (2 * tail(F.abs(serial)) < order_level)
        return F.when(ordered, 1.0).otherwise(F.greatest(uniform, F.lit(1e-39)))

    inferred = F.transform(spans, lambda s: F.struct(s.alias("s"), encoding(s["match"]).alias("encoding")))
    return F.transform(F.filter(inferred, lambda x: x["encoding"].isNotNull()), one)


def cuts(candidates: DataFrame, fdr: float) -> list:
    """Smallest accepted bin of each stratum: Benjamini-Hochberg on bin counts."""
    counted = candidates.select(F.explode("tests").alias("t")).groupBy("t.encoding", "t.size", "t.bin").agg(F.count("*").alias("n")).collect()  # at most strata x 400 rows
    strata: dict = {}
    for r in counted:
        strata.setdefault((r.encoding, r["size"]), {})[r.bin] = r.n
    out = []
    for (enc, size), bins in sorted(strata.items()):
        m, above, cut = sum(bins.values()), 0, None
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if m * 10 ** (-b / 10) <= fdr * above:
                cut = b
        if cut is not None:
            out.append((enc, size, cut))
    return out


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 20, text_skew: float = 2.0, order_level: float = 1e-3, fdr: float = 0.01, keep: list[str] | None = None) -> DataFrame:
    """key, `keep`, n_assign, n_access, n_hex, base_sha256, spans (text), found (structs of kind, start, end, byte_start, byte_end)."""
    keep = keep or []
    t = F.col("__t")
    candidate = f"[A-Za-z0-9+/_=-]{{{min_length},}}"
    assign, access, hexes = base_spans(t)
    tests = F.when(t.rlike(candidate), tested(located(t, candidate), text_skew, order_level)).otherwise(F.array().cast(SPAN[:-2] + ",encoding:string,size:int,bin:int>>"))
    rows = docs.select(key, *keep, F.coalesce(F.col(text), F.lit("")).alias("__t")).select(key, *keep, assign.alias("assign"), access.alias("access"), hexes.alias("hex"), tests.alias("tests"))
    rows = materialize(rows)
    taken = cuts(rows, fdr)

    def discovered(x):
        out = F.lit(False)
        for enc, size, cut in taken:
            out = out | ((x["encoding"] == enc) & (x["size"] == size) & (x["bin"] >= cut))
        return out

    tagged = lambda spans, order, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["byte_start"].alias("byte_start"), s["byte_end"].alias("byte_end")))
    base = F.concat(*(tagged(F.col(k), i, k) for i, k in enumerate(KINDS)))
    random = F.filter("tests", lambda x: discovered(x) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return (
        rows.withColumn("base", base)
        .withColumn("found", F.array_sort(F.concat("base", tagged(random, len(KINDS), "random"))))
        .select(
            key, *keep, *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
            F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), *(s[p].alias(p) for p in PLACE))).alias("found"),
        )
    )


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", marker: str = "[SECRET]", **options) -> DataFrame:
    """`docs` with every span replaced by `marker` in its text; other columns and null texts stay."""
    # the row goes along as one column, so none of its names can clash
    found = secrets(docs.select(key, text, F.struct(*docs.columns).alias("__doc")), key, text, keep=["__doc"], **options)
    old = F.col("__doc")[text]

    def cleaned(raw):
        """Bytes are cut, since a place in a string is found by counting from its start; spans that overlap become one marker."""
        furthest = lambda s, block: F.greatest(s, F.array_max(F.transform(block, lambda x: x["byte_end"])))
        piece = lambda x, s: F.when(x["byte_start"] >= s, F.concat(F.substring(raw, s + 1, x["byte_start"] - s).cast("string"), F.lit(marker))).otherwise("")
        pieces = running(F.col("found"), F.lit(0), lambda s, x: F.greatest(s, x["byte_end"]), furthest, piece, "string")
        last = F.array_max(F.transform("found", lambda x: x["byte_end"]))
        return F.concat(F.array_join(pieces, ""), F.substring(raw, last + 1, F.octet_length(raw)).cast("string"))

    new = F.when(F.size("found") > 0, bound(old.cast("binary"), cleaned)).otherwise(old)
    return found.select(F.col("__doc").withField(text, new).alias("__doc")).select("__doc.*")
