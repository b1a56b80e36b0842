"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, decontaminate, dialogue, langid, neardup, pagetext, pii, quality, repeats, secrets, spelling, urlrules
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("found")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents")).drop("found")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.verdicts(table(spark, sf_dir, "pages")).drop("patterns")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ids=False)


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.main_text(table(spark, sf_dir, "pages"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repairs(dialogue.damaged(table(spark, sf_dir, "conversations")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
       FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
hit AS (SELECT r, i, m, item FROM dw JOIN bw USING (m, win)),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""

OP8_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_in AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM both_in JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
m AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""

#: The rules once more, each written by hand and tried on every URL.
OP7_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
p AS (SELECT page_id, u, translate(regexp_extract(u, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '(?s)://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(u, '(?is)^[a-z][a-z0-9+.-]*://([^/?#]*\.)?example\.org([^a-z0-9_.%-]|$)')
      OR regexp_matches(u, '(?is)^[a-z][a-z0-9+.-]*://([^/?#]*\.)?track\.example\.net([^a-z0-9_.%-]|$)public([^a-z0-9_.%-]|$)') THEN 'allow'
    WHEN regexp_matches(u, '(?is)^[a-z][a-z0-9+.-]*://([^/?#]*\.)?(adserver|ads|track|tracker|casino)\..*([^a-z0-9_.%-]|$)')
      OR regexp_matches(u, '(?is)^[a-z][a-z0-9+.-]*://([^/?#]*\.)?(ads|casino)-.*([^a-z0-9_.%-]|$)')
      OR regexp_matches(u, '(?is)^[a-z][a-z0-9+.-]*://([^/?#]*\.)?doubleclick\.net([^a-z0-9_.%-]|$)')
      OR regexp_matches(u, '(?is)/banner/.*/ad([^a-z0-9_.%-]|$)') OR regexp_matches(u, '(?is)/popup/.*\.js$')
      OR regexp_matches(u, '(?is)([^a-z0-9_.%-]|$)utm_medium=spam([^a-z0-9_.%-]|$)') OR regexp_matches(u, '(?is)([^a-z0-9_.%-]|$)utm_source=feed([^a-z0-9_.%-]|$)')
      OR regexp_matches(u, '(?is)([^a-z0-9_.%-]|$)sessionid=.*([^a-z0-9_.%-]|$)tracking=') OR regexp_matches(u, '(?is)/wp-login\.php([^a-z0-9_.%-]|$)') OR regexp_matches(u, '(?is)/porn/')
      OR regexp_matches(u, '(?is)^[a-z][a-z0-9+.-]*://([^/?#]*\.)?malware\..*([^a-z0-9_.%-]|$)download([^a-z0-9_.%-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, i)) AS t"


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text in UTF-8; `t` is the table of CRC_TABLE."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(length({digits}) // 2), lambda i: CAST('0x' || substr({digits}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, v: xor(c >> 8, t[xor(c, v) % 256 + 1]), 4294967295), 4294967295)"


OP13_SQL = f"""
WITH RECURSIVE tab AS MATERIALIZED ({CRC_TABLE}),
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {LOWER}), '[a-z\u00C0-\u00FF]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
h AS MATERIALIZED (SELECT run, k, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM r, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
      UNION SELECT d.word, v.word FROM d JOIN v ON d.d = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.d = v.word),
m AS (SELECT p.a AS word, count(*) AS n_near, arg_min(v.word, (-v.n, v.word)) AS best, max(v.n) AS best_n FROM p JOIN v ON v.word = p.b GROUP BY p.a),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v LEFT JOIN m USING (word)),
up(word, root) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f AS e ON e.word = up.root AND e.form IS NULL
"""



def longer(way: str, edit: str, cost: str) -> str:
    """SQL for a way (nine digits of cost, then its audit) with one more edit."""
    return f"lpad(CAST(CAST(left({way}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{edit}'"


INSERTED = f"""SELECT *, least(s3, {longer("i2", "I", "2")}) AS i3 FROM (SELECT *, least(s2, {longer("s0", "I", "2")}, {longer("s1", "I", "2")}, {longer("s3", "I", "2")}) AS i2 FROM {{0}})"""
#: Ways from the first row on, a row at a time: s0 to s3 hold the least (cost, audit) of each item.
OP12_SQL = f"""
WITH RECURSIVE tab AS MATERIALIZED ({CRC_TABLE}),
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM b)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS c FROM d),
r AS MATERIALIZED (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS must, coalesce(fault = 'truncated', false)::INT AS cut FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' END AS fault FROM o)),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
way(conv_id, i, s0, s1, s2, s3) AS (SELECT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
    SELECT w.conv_id, r.i, {longer("s0", "D", "3")},
        least({longer("s1", "D", "3")}, CASE WHEN NOT must AND c = 's' THEN {longer("s0", "K", "cut")} END),
        least({longer("i2", "D", "3")}, CASE WHEN NOT must AND c = 'u' THEN {longer("least(s0, s1, i3)", "K", "cut")} END, CASE WHEN NOT must THEN {longer("least(s0, s1, i3)", "R", "2 + cut")} END),
        least({longer("i3", "D", "3")}, CASE WHEN NOT must AND c = 'a' THEN {longer("i2", "K", "cut")} END, CASE WHEN NOT must THEN {longer("i2", "R", "2 + cut")} END)
    FROM ({INSERTED.format("way")}) w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
e AS (SELECT w.conv_id, CAST(left(least(s0, i3), 9) AS BIGINT) AS cost, substr(least(s0, i3), 10) AS audit FROM ({INSERTED.format("way")}) w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(g.n, 0)),
a AS (SELECT conv_id, k, audit[k] AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM e)),
p AS (SELECT a.*, count_if(edit <> 'I') OVER w AS i, count_if(edit <> 'D') OVER w AS j FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
q AS (SELECT p.*, r.role, r.text, r.c, max((j = 1 AND edit = 'K' AND c = 's')::INT) OVER (PARTITION BY p.conv_id) AS head FROM p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE edit <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS said FROM q GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""

QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_pii": op2_pii, "op3_neighbours": op3_neighbours, "op4_repeats": op4_repeats, "op5_quality": op5_quality, "op6_secret_scan": op6_secret_scan, "op7_url_rules": op7_url_rules, "op8_near_duplicates": op8_near_duplicates, "op9_language": op9_language, "op10_byte_bpe": op10_byte_bpe, "op11_page_text": op11_page_text, "op12_dialogue_repair": op12_dialogue_repair, "op13_spelling_variants": op13_spelling_variants}
SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op7_url_rules": OP7_SQL, "op8_near_duplicates": OP8_SQL, "op12_dialogue_repair": OP12_SQL, "op13_spelling_variants": OP13_SQL}
