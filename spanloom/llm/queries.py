"""Queries over the driver's tables, one for each operator, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import damaged, repair
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .jaccard_join import similar_documents
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .minmax_dedup import near_copies
from .mixing import mix
from .periodic_runs import periodic_runs
from .suffix_dedup import remove_repeats
from .toxicity import score_documents
from .url_filter import filter_urls
from .warc import archive_pages


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_read(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(_read(spark, sf_dir, "conversations")))


def op12_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_read(spark, sf_dir, "documents"), plant=True)


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    " 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, w[i:i + 12] AS win FROM (
    SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM iw),
dp AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dp JOIN iw USING (win)),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
  sha256(norm) AS text_sha256 FROM k
"""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = _LOW.format("regexp_extract({0}, '^[^/?#]*')")
_PATH = "regexp_extract({0}, '^[^/?#]*(/[^?#]*)?', 1)"


def _plain_path(p: str) -> str:
    """A path with its dots resolved."""
    parts = f"string_split({p}, '/')"
    kept = f"list_reduce(list_transform({parts}, lambda x: [x]), lambda a, x: CASE x[1] WHEN '..' THEN a[:greatest(len(a) - 1, 1)] WHEN '.' THEN a ELSE a || x END)"
    made = f"array_to_string({kept} || CASE WHEN {parts}[-1] IN ('.', '..') THEN [''] ELSE CAST([] AS VARCHAR[]) END, '/')"
    return f"CASE WHEN contains({p}, '/.') THEN CASE WHEN {made} = '' THEN '/' ELSE {made} END ELSE {p} END"


def _address(rest: str, scheme: str) -> str:
    """Host without the scheme's port, path without dots, and query of what follows ``://``."""
    host, query = _HOST.format(rest), rf"regexp_extract({rest}, '^[^?#]*(\?[^#]*)?', 1)"
    port = f"CASE lower({scheme}) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END"
    return f"regexp_replace({host}, {port}, '') || {_plain_path(_PATH.format(rest))} || {query}"


_SCHEME = "regexp_extract({}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"
OP5_SQL = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest, {_SCHEME.format("url")} AS scheme FROM pages),
n AS (
  SELECT page_id, html, scheme, coalesce({_HOST.format("rest")}, '') AS host, coalesce({_PATH.format("rest")}, '') AS path,
    CASE WHEN {_HOST.format("rest")} <> '' THEN {_address("rest", "scheme")} END AS node FROM p),
t AS (
  SELECT host, path, scheme, node, unnest(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1))
    || list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>;]+)', 1))) AS raw FROM n),
u AS (
  SELECT node AS a, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {_SCHEME.format("x")} ELSE scheme END AS scheme,
    CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(x, instr(x, '://') + 3)
    WHEN x LIKE '//%' THEN substr(x, 3) WHEN x LIKE '/%' THEN host || x
    ELSE host || regexp_extract(path, '^(.*/)?') || x END AS y
  FROM (SELECT *, replace(raw, '&amp;', '&') AS x FROM t WHERE raw <> '')),
e AS (
  SELECT a, b FROM (SELECT a, CASE WHEN {_HOST.format("y")} <> '' THEN {_address("y", "scheme")} END AS b FROM u) WHERE a IS NOT NULL AND a <> b),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, a AS b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a),
rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
nodes AS (SELECT DISTINCT b AS node, regexp_extract(b, '^[^/?#]*') AS host, regexp_extract(b, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM r),
nv AS (SELECT node, arg_max(v, length(rh || rp)) AS v FROM nodes, rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY node),
alias AS (SELECT r.a AS node FROM r JOIN nv ON nv.node = r.b GROUP BY r.a
  HAVING bool_or(v = 'block') AND NOT bool_or(v = 'allow')),
own AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM n), rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, n.host, n.path, rule, coalesce(v, CASE WHEN alias.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN own ON own.host = n.host AND own.path = n.path LEFT JOIN alias ON alias.node = n.node
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(l[i:i + 2], chr(10)) AS win FROM (
    SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)),
later AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM later),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS kept FROM lines ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
spans AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (prev IS NULL OR p > prev + 1) AS n_spans FROM (
    SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM gone) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)
"""


OP2_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS hex, max(page_id) OVER (PARTITION BY b) AS keep FROM p),
bits AS (
  SELECT page_id, n, keep, list_aggregate(list_transform(range(1, 41), lambda i:
    lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), 'string_agg', '') AS s FROM h),
b32 AS (
  SELECT page_id, n, keep, list_aggregate(list_transform(range(0, 32), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(list_sum(list_transform(range(1, 6), lambda k: CAST(substr(s, 5 * j + k, 1) AS INTEGER) * (1 << CAST(5 - k AS INTEGER)))) AS BIGINT) + 1, 1)),
    'string_agg', '') AS digest FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to FROM b32
"""


#: CRC-32 of an ASCII text column, byte by byte, with a table made by its rule.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tbl"


def _best(*options: str) -> str:
    """The least of some survivors, by cost, then audit; null if there is none."""
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _edit(state: str, cost: str, letter: str, row: str | None, when: str = "true") -> str:
    text = f"{state}.t" if row is None else f"CASE WHEN {state}.t = '' AND NOT contains({state}.a, 'K') AND NOT contains({state}.a, 'R') AND NOT contains({state}.a, 'I') THEN {row} ELSE {state}.t || chr(10) || {row} END"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END"


_STAY = "fault IN ('', 'truncated')"
_PAY = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
_NONE = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
_STEP = f"""SELECT conv_id, k, d0, {_best("ds", _edit("s0", _PAY, "K", "whole", f"{_STAY} AND ini = 's'"))} AS d1,
  {_best("du", *[_edit(s, _PAY, "K", "whole", f"{_STAY} AND ini = 'u'") for s in ("s0", "ss", "sa")], *[_edit(s, f"3 + {_PAY}", "R", "'user:' || text", _STAY) for s in ("s0", "ss", "sa")])} AS d2,
  {_best("da", _edit("su", _PAY, "K", "whole", f"{_STAY} AND ini = 'a'"), _edit("su", f"3 + {_PAY}", "R", "'assistant:' || text", _STAY))} AS d3
  FROM (SELECT f.*, r.fault, r.ini, r.text, r.role || ':' || r.text AS whole, r.k, {', '.join(f"{_edit(s, '4', 'D', None)} AS {d}" for s, d in (("s0", "d0"), ("ss", "ds"), ("su", "du"), ("sa", "da")))}
    FROM (SELECT conv_id, k AS was, s0, ss, su, sa FROM fold) f JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.k = f.was + 1)"""
_FILLED = f"""SELECT conv_id, k, s0, ss, su, {_best("d3", _edit("su", "3", "I", "'assistant:'"))} AS sa
  FROM (SELECT conv_id, k, d0 AS s0, d1 AS ss, {_best("d2", _edit("d0", "3", "I", "'user:'"), _edit("d1", "3", "I", "'user:'"), _edit("d3", "3", "I", "'user:'"))} AS su, d3 FROM ({{0}}))"""
OP11_SQL = rf"""
WITH RECURSIVE tb AS ({_CRC_TABLE}),
c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS x FROM conversations, tb),
c1 AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN x = 3 THEN 2 ELSE 1 END)) AS copy FROM c0 WHERE x <> 0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k, regexp_extract(text, '(?s)([^ 	-
])[ 	-
]*$', 1) AS fin, substr(role, 1, 1) AS ini FROM c1),
rows_ AS (SELECT *, CASE WHEN fin = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN fin NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY k) AS pre FROM c2),
fold AS (SELECT * FROM ({_FILLED.replace("{0}", f"SELECT DISTINCT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS d0, {_NONE} AS d1, {_NONE} AS d2, {_NONE} AS d3 FROM rows_")})
  UNION ALL SELECT * FROM ({_FILLED.replace("{0}", _STEP)})),
fin AS (SELECT conv_id, {_best("s0", "sa")} AS b FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS z FROM fold) WHERE z = 1),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (k > 1 AND pre || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM i.conv_id
"""

OP12_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOW.format("coalesce(text, '')")}, '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m, any_value(a.n + b.n) AS both_n FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * m >= 85 * (both_n - m)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""


OP13_SQL = rf"""
WITH tb AS ({_CRC_TABLE}),
d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, {_CRC.format("CAST(doc_id AS VARCHAR)")} AS h FROM d, tb),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM g), p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
e AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM p),
wd AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS x FROM e),
gr AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 16], ' ') AS gm FROM (SELECT doc_id, n, w, unnest(range(n - 15)) AS i FROM e WHERE n >= 24)),
lags AS (SELECT DISTINCT u.doc_id, v.i - u.i AS q FROM gr u JOIN gr v ON u.doc_id = v.doc_id AND u.gm = v.gm AND v.i > u.i AND 3 * (v.i - u.i) <= u.n),
same AS (SELECT l.doc_id, q, u.x FROM lags l JOIN wd u ON u.doc_id = l.doc_id JOIN wd v ON v.doc_id = l.doc_id AND v.x = u.x + q AND v.word = u.word),
st AS (SELECT doc_id, q, min(x) AS s, max(x) + 1 + q AS z FROM (SELECT *, x - row_number() OVER (PARTITION BY doc_id, q ORDER BY x) AS k FROM same) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT doc_id, s, z - s AS len, min(q) AS q FROM st GROUP BY doc_id, s, z),
ag AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed, list({{'s': s, 'len': len, 'q': q}} ORDER BY len / q DESC, s, q)[1] AS top FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS x FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS left_ FROM wd ANTI JOIN gone USING (doc_id, x) GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.len AS BIGINT) AS length, CAST(top.q AS BIGINT) AS period, CAST(1000 * top.len // top.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(left_, '')) AS collapsed_sha256
FROM e LEFT JOIN ag USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


#: The base columns of op9; labels and score of the method are not for SQL.
OP9_BASE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p(phrase, label) AS (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')),
places AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, phrase, label, unnest(range(len(w))) AS i FROM d, p) WHERE w[i + 1:i + len(phrase)] = phrase),
b AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM places GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN b USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_warc": op2_warc,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_url_filter": op5_url_filter,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_line_dedup": op7_line_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_license_scan": op9_license_scan,
        "op10_mix_sources": op10_mix_sources,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_minmax_dedup": op12_minmax_dedup,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1_SQL,
        "op2_warc": OP2_SQL,
        "op4_exact_dedup": OP4_SQL,
        "op5_url_filter": OP5_SQL,
        "op7_line_dedup": OP7_SQL,
        "op11_conversation_repair": OP11_SQL,
        "op12_minmax_dedup": OP12_SQL,
        "op13_periodic_runs": OP13_SQL,
    }
