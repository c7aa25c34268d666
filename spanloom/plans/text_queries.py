"""Texts: scalar functions, facts in outputs, graders, conversations, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import statistics as st
from ..operators import conversations as cv
from ..operators import facts as fx
from ..operators import ranking as rk
from ..operators import windows as w
from .bindings import GRAPH, MESSAGES
from .registry import query
from .window_queries import _DIMS, _dims


@query("fn_01_estimate_tokens", """WITH x AS (SELECT doc_id, text, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS units, substr(text, 1, 512) AS head FROM documents)
SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE ceil(units / CASE WHEN length(regexp_replace(head, '[A-Za-z0-9 ]', '', 'g')) >= 0.3 * length(head) THEN 3 ELSE 4 END) END AS BIGINT) AS tokens FROM x""")
def _(t):
    return t.table("documents").select("doc_id", sc.estimate_tokens(F.col("text")).alias("tokens"))


@query("fn_02_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t):
    return t.table("documents").select("doc_id", sc.content_hash(F.col("text")).alias("hash"))


@query("fn_03_normalize_prompt", MESSAGES + rf"SELECT run_id, turn, regexp_replace(trim(regexp_replace(lower(text), '{sc.BLANK}+', ' ', 'g')), '[?.!,;:]+$', '') AS prompt FROM messages")
def _(t):
    return t.messages.select("run_id", "turn", sc.normalize_prompt(F.col("text")).alias("prompt"))


@query("fn_04_parse_approval", MESSAGES + """SELECT run_id, turn, CASE WHEN contains(lower(text), 'approve') OR contains(lower(text), 'yes') OR lower(text) = 'y' THEN 'approved'
WHEN contains(lower(text), 'reject') OR contains(lower(text), 'no') OR lower(text) = 'n' THEN 'rejected' ELSE 'unclear' END AS decision FROM messages""")
def _(t):
    return t.messages.select("run_id", "turn", sc.parse_approval(F.col("text")).alias("decision"))


@query("fn_05_prompt_and_context", MESSAGES + "SELECT run_id, turn, role || chr(10) || chr(10) || text AS prompt FROM messages")
def _(t):
    return t.messages.select("run_id", "turn", F.concat("role", F.lit("\n\n"), "text").alias("prompt"))


@query("fn_07_normalize_blanks", rf"SELECT doc_id, sha256(trim(regexp_replace(text, '{sc.BLANK}+', ' ', 'g'))) AS h FROM documents")
def _(t):
    return t.table("documents").select("doc_id", F.sha2(sc.normalize_blanks(F.col("text")), 256).alias("h"))


@query("fn_08_preview", "SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE substr(text, 1, 157) || '...' END AS preview FROM documents")
def _(t):
    return t.table("documents").select("doc_id", sc.preview(F.col("text")).alias("preview"))


@query("fn_09_flat_preview", "SELECT doc_id, substr(replace(text, chr(10), ' '), 1, 120) AS preview FROM documents")
def _(t):
    return t.table("documents").select("doc_id", sc.flat_preview(F.col("text")).alias("preview"))


@query("fn_10_truncate", "SELECT page_id, sha256(CASE WHEN length(html) > 3000 THEN substr(html, 1, 3000) || chr(10) || chr(10) || '[Content truncated at 750 tokens]' ELSE html END) AS h, length(html) > 3000 AS cut FROM pages")
def _(t):
    return t.table("pages").select("page_id", sc.truncate(F.col("html"), 3000).alias("x")).select("page_id", F.sha2("x.text", 256).alias("h"), "x.cut")


@query("fn_11_truncate_with_length", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '... (' || length(text) || ' characters)' ELSE text END AS t FROM documents")
def _(t):
    return t.table("documents").select("doc_id", sc.truncate_with_length(F.col("text"), 100).alias("t"))


_MIME = "CASE " + " ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in sc.MIME.items()) + " ELSE 'text/plain' END"


@query("fn_12_mime_type", f"""WITH x AS (SELECT page_id, split_part(regexp_extract(url, '^[^?#]*'), '/', -1) AS b FROM pages),
y AS (SELECT page_id, CASE WHEN contains(b, '.') THEN lower(split_part(b, '.', -1)) END AS e FROM x) SELECT page_id, {_MIME} AS mime FROM y""")
def _(t):
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return t.table("pages").select("page_id", path.alias("path")).select("page_id", sc.mime_type(F.col("path")).alias("mime"))


@query("fn_13_base_name", "SELECT page_id, split_part(url, '/', -1) AS name FROM pages")
def _(t):
    return t.table("pages").select("page_id", sc.base_name(F.col("url")).alias("name"))


@query("fn_17_labelled_ids", MESSAGES + "SELECT run_id, turn, len(regexp_extract_all(text || ' id: a' || turn || ' id: b1', 'id:\\s*([0-9A-Za-z-]+)', 1)) AS n FROM messages")
def _(t):
    text = F.concat("text", F.lit(" id: a"), F.col("turn").cast("string"), F.lit(" id: b1"))
    return t.messages.select("run_id", "turn", F.size(sc.labelled_ids(text)).cast("long").alias("n"))


@query("fn_20_bytes_and_json", "SELECT event_id, octet_length(encode(props)) AS bytes, json_valid(props) AS valid FROM events")
def _(t):
    return t.table("events").select("event_id", F.octet_length("props").cast("long").alias("bytes"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("fn_27_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(t):
    return t.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("fn_28_context_budget", "SELECT user_id AS run_id, least(floor(sum(floor(value * 100)) * 0.4), 40000) AS budget FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("run_id").agg(F.least(F.floor(F.sum("tokens") * F.lit(0.4)).cast("double"), F.lit(40000.0)).alias("budget"))


_PLAIN = "html"
for _tag in ("head", "script", "style", "nav", "footer", "header", "aside", "noscript"):
    _PLAIN = rf"regexp_replace({_PLAIN}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_PLAIN = rf"regexp_replace(regexp_replace({_PLAIN}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_char}')"
#: A page as text, its title as a heading.
_TEXT = rf"""WITH tx AS (SELECT page_id, url, html, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g')) AS body FROM pages),
mt AS (SELECT page_id, url, html, CASE WHEN title <> '' THEN '# ' || title || chr(10) || chr(10) || body ELSE body END AS main FROM tx)
"""
#: What a server would have told: the type of the path's ending, if it has one.
_KINDS = f""", pt AS (SELECT page_id, split_part(regexp_extract(url, '^[^?#]*'), '/', -1) AS b FROM pages), ex AS (SELECT page_id, CASE WHEN contains(b, '.') THEN lower(split_part(b, '.', -1)) END AS e FROM pt),
kd AS (SELECT page_id, CASE WHEN e IS NULL THEN 'html' WHEN e = 'pdf' THEN 'pdf' WHEN {_MIME} IN ('text/plain', 'text/markdown') THEN 'text' ELSE 'html' END AS kind FROM ex)
"""


def _kind():
    path = F.regexp_extract("url", "^[^?#]*", 0)
    name = sc.base_name(path)
    header = F.when(F.lower(name).endswith(".pdf"), "application/pdf").when(F.contains(name, F.lit(".")), sc.mime_type(path))
    return sc.content_kind(header)


@query("fn_14_content_kind", _TEXT + _KINDS + "SELECT page_id, kind FROM kd")
def _(t):
    return t.table("pages").select("page_id", _kind().alias("kind"))


@query("fn_30_main_text", _TEXT + "SELECT page_id, main AS text FROM mt")
def _(t):
    """Pages as headed plain text."""
    return t.table("pages").select("page_id", sc.main_text(F.col("html")).alias("text"))


#: Fixed value: larger PDF files are refused.
_MOST_BYTES = 10 * 1024 * 1024
_INGEST = _TEXT + _KINDS + f""", ct AS (SELECT page_id, url, kind, octet_length(encode(coalesce(html, ''))) AS n, CASE kind WHEN 'html' THEN coalesce(main, '') WHEN 'text' THEN coalesce(html, '') END AS whole FROM mt JOIN kd USING (page_id)),
cu AS (SELECT page_id, url, kind, n, CASE WHEN length(whole) > 32000 THEN substr(whole, 1, 32000) || chr(10) || chr(10) || '[Content truncated at 8,000 tokens]' ELSE whole END AS text, coalesce(length(whole) > 32000, false) AS cut FROM ct)
"""


@query("src_09_page_ingestion", _INGEST + rf"""SELECT page_id, url, kind, text, cut, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE ceil((length(text) + len(regexp_extract_all(text, '[\x{{10000}}-\x{{10FFFF}}]'))) / CASE WHEN length(regexp_replace(substr(text, 1, 512), '[A-Za-z0-9 ]', '', 'g')) >= 0.3 * length(substr(text, 1, 512)) THEN 3 ELSE 4 END) END AS BIGINT) AS tokens,
CASE WHEN kind = 'pdf' AND n > {_MOST_BYTES} THEN 'PDF too large' WHEN kind = 'pdf' THEN 'no text of a PDF' WHEN length(text) = 0 THEN 'no content' END AS error FROM cu""")
def _(t):
    """Each page by its content type: HTML is extracted, plain text taken as it is, then cut and its tokens counted.
    What can't be read becomes a row with an error; a PDF is that here, as it comes without an extractor."""
    p = t.table("pages").withColumn("kind", _kind())
    whole = F.when(F.col("kind") == "html", sc.main_text(F.coalesce("html", F.lit("")))).when(F.col("kind") == "text", F.coalesce("html", F.lit("")))
    p = p.select("page_id", "url", "kind", F.octet_length(F.coalesce("html", F.lit(""))).alias("n"), sc.truncate(whole).alias("x"))
    text, pdf = F.col("x.text"), F.col("kind") == "pdf"
    error = F.when(pdf & (F.col("n") > _MOST_BYTES), "PDF too large").when(pdf, "no text of a PDF").when(F.length(text) == 0, "no content")
    return p.select(
        "page_id", "url", "kind", text.alias("text"), F.coalesce("x.cut", F.lit(False)).alias("cut"), sc.estimate_tokens(text).alias("tokens"), error.alias("error")
    )


# Facts: a benchmark item is a case, its facts are its words, eight by eight, to its end (what is left over
# goes to the last). An output of the case is a document that quotes one of its facts; all facts of the
# case are looked for in it, by the whole words of both. Every seventh fact should be absent.

_FACTS = r"""WITH fw AS (SELECT item_id AS case_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
fn AS (SELECT case_id, w, unnest(range(greatest(len(w) // 8, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS k, greatest(len(w) // 8, 1) AS ks FROM fw),
f AS (SELECT case_id, case_id * 10000 + k AS fact_id, w[k * 8 + 1:CASE WHEN k = ks - 1 THEN len(w) ELSE k * 8 + 8 END] AS words, array_to_string(w[k * 8 + 1:CASE WHEN k = ks - 1 THEN len(w) ELSE k * 8 + 8 END], ' ') AS canonical,
  1 + k % 3 AS weight, k % 7 <> 6 AS present FROM fn),
ow AS (SELECT doc_id, lang, text AS whole, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
o AS (SELECT doc_id, lang, whole, w, ' ' || array_to_string(w, ' ') || ' ' AS text FROM ow),
l AS (SELECT DISTINCT doc_id, case_id FROM o, f WHERE contains(text, ' ' || canonical || ' ')),
m AS (SELECT o.doc_id, o.lang, o.whole, o.w, o.text, f.*, contains(o.text, ' ' || canonical || ' ') AS matched FROM l JOIN o USING (doc_id) JOIN f USING (case_id)),
s AS (SELECT doc_id, CAST(sum(weight) FILTER (present) AS DOUBLE) AS wt, CAST(coalesce(sum(weight) FILTER (present AND matched), 0) AS DOUBLE) AS hit,
  CAST(sum(weight) AS DOUBLE) AS wa, CAST(coalesce(sum(weight) FILTER (matched = present), 0) AS DOUBLE) AS hita FROM m GROUP BY doc_id)
""".replace(r"\s+", sc.BLANK + "+")


def _case_facts(t):
    b = t.table("benchmark").select(F.col("item_id").alias("case_id"), fx.tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    ks = F.greatest(F.floor(F.size("w") / 8), F.lit(1)).cast("int")
    b = b.select("case_id", "w", ks.alias("ks"), F.explode(F.sequence(F.lit(0), ks - 1)).alias("k"))
    words = F.slice("w", F.col("k") * 8 + 1, F.when(F.col("k") == F.col("ks") - 1, F.size("w")).otherwise(8))
    return b.select(
        "case_id", (F.col("case_id") * 10_000 + F.col("k")).alias("fact_id"), words.alias("words"), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("canonical"),
        (1 + F.col("k") % 3).alias("weight"), (F.col("k") % 7 != 6).alias("present"),
    )


def _matches(t):
    facts = _case_facts(t)
    docs = t.table("documents")
    links = fx.quoting(docs.select(F.col("doc_id").alias("output_id"), "text"), facts.select(F.col("fact_id").alias("phrase_id"), "words"), write=t.write)
    cases = links.select(F.col("output_id").alias("doc_id"), F.floor(F.col("phrase_id") / 10_000).alias("case_id")).distinct()
    flat = F.concat(F.lit(" "), F.array_join(fx.tokens(F.col("text")), " "), F.lit(" "))
    outputs = cases.join(docs.select("doc_id", "lang", F.col("text").alias("whole"), flat.alias("text")), "doc_id")
    return fx.match_facts(outputs, facts)


@query("jn_15_fact_matching", _FACTS + "SELECT doc_id, fact_id, matched FROM m")
def _(t):
    return _matches(t).select("doc_id", "fact_id", "matched")


# Patterns over the whole corpus: of each benchmark item, three words on from its eighth as alternatives of a pattern, two
# pairs that must both be there, a plain phrase, and its number, which has no literal to be found by.
_PATTERNS = (r"""WITH bw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: regexp_full_match(x, '[a-z]{2,}')) AS w FROM benchmark),
p AS (SELECT item_id * 10 AS fact_id, [w[8] || '\s+(?:' || w[9] || '|' || w[10] || ')'] AS need FROM bw WHERE len(w) >= 12
  UNION ALL SELECT item_id * 10 + 1, [w[1] || '[^a-z]{1,3}' || w[2], w[3] || '.{1,3}' || w[4]] FROM bw WHERE len(w) >= 12
  UNION ALL SELECT item_id * 10 + 2, ['\Q' || w[5] || ' ' || w[6] || '\E'] FROM bw WHERE len(w) >= 12
  UNION ALL SELECT item_id * 10 + 3, ['[' || item_id % 10 || '][0-7]\.'] FROM bw WHERE len(w) >= 12)
SELECT doc_id AS output_id, fact_id FROM documents, p WHERE text IS NOT NULL AND len(list_filter(need, lambda x: NOT regexp_matches(text, '(?i)' || x))) = 0""").replace(r"\s+", sc.BLANK + "+")


@query("jn_15_pattern_search", _PATTERNS)
def _(t):
    """Facts by pattern, by several patterns and by words in all documents, whichever item they are of."""
    w = F.filter(fx.tokens(F.col("text")), lambda x: F.rlike(x, F.lit("^[a-z]{2,}$")))
    b = t.table("benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 12)
    at, none, no_list = lambda i: F.get("w", F.lit(i - 1)), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    blank = F.lit(sc.BLANK + "+(?:")
    kinds = [
        (none, F.concat(at(8), blank, at(9), F.lit("|"), at(10), F.lit(")")), no_list),
        (none, none, F.array(F.concat(at(1), F.lit("[^a-z]{1,3}"), at(2)), F.concat(at(3), F.lit(".{1,3}"), at(4)))),
        (F.concat(at(5), F.lit(" "), at(6)), none, no_list),
        (none, F.concat(F.lit("["), (F.col("item_id") % 10).cast("string"), F.lit(r"][0-7]\.")), no_list),
    ]
    rows = F.array(*[F.struct((F.col("item_id") * 10 + k).alias("fact_id"), c.alias("canonical"), p.alias("pattern"), r.alias("required_patterns")) for k, (c, p, r) in enumerate(kinds)])
    return fx.search(t.table("documents").select(F.col("doc_id").alias("output_id"), "text"), b.select(F.inline(rows)), t.write)


@query("agg_03_factual_score", _FACTS + "SELECT doc_id, round(coalesce(hit / nullif(wt, 0), 0), 4) AS score FROM s")
def _(t):
    return fx.factual_score(_matches(t), ["doc_id"]).select("doc_id", F.round("score", 4).alias("score"))


@query("agg_04_per_fact_score", _FACTS + "SELECT doc_id, round(coalesce(hita / nullif(wa, 0), 0), 4) AS score FROM s")
def _(t):
    return fx.per_fact_score(_matches(t), ["doc_id"]).select("doc_id", F.round("score", 4).alias("score"))


@query("agg_26_match_heatmap", _FACTS + "SELECT fact_id, " + ", ".join(f"round(avg(CASE WHEN matched THEN 1 ELSE 0 END) FILTER (lang = '{x}'), 4) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM m GROUP BY fact_id")
def _(t):
    langs = ["de", "en", "es", "fr"]
    p = _matches(t).groupBy("fact_id").pivot("lang", langs).agg(F.avg(F.col("matched").cast("int")))
    return p.select("fact_id", *[F.round(x, 4).alias(x) for x in langs])


@query("agg_29_matcher_disagreement", _FACTS + ", x AS (SELECT matched, list_has_all(w, words) AS loose FROM m) SELECT count(*) FILTER (matched AND NOT loose) AS only_strict, count(*) FILTER (loose AND NOT matched) AS only_loose, count(*) AS n FROM x")
def _(t):
    m = _matches(t).withColumn("loose", _all_words())
    return m.agg(F.count_if(F.col("matched") & ~F.col("loose")).alias("only_strict"), F.count_if(F.col("loose") & ~F.col("matched")).alias("only_loose"), F.count("*").alias("n"))


def _all_words():
    """A looser matcher: all words of the fact are there, in any order."""
    return F.size(F.array_except("words", fx.tokens(F.col("whole")))) == 0


@query("jn_19_matchers_by_fact", _FACTS + "SELECT doc_id, fact_id, matched AS strict, list_has_all(w, words) AS loose FROM m")
def _(t):
    m = _matches(t)
    strict = m.select("doc_id", "case_id", "fact_id", F.col("matched").alias("strict"))
    loose = m.select("doc_id", "case_id", "fact_id", _all_words().alias("loose"))
    return strict.join(loose, ["doc_id", "case_id", "fact_id"]).select("doc_id", "fact_id", "strict", "loose")


@query("agg_30_rescore_means", _FACTS + "SELECT round(avg(coalesce(hit / nullif(wt, 0), 0)), 4) AS factual, round(avg(coalesce(hita / nullif(wa, 0), 0)), 4) AS per_fact FROM s")
def _(t):
    """Both scores in one pass over the facts."""
    both = _matches(t).groupBy("doc_id").agg(*[x.alias(k) for k, x in fx.both_scores().items()])
    return both.agg(F.round(F.avg("factual"), 4).alias("factual"), F.round(F.avg("per_fact"), 4).alias("per_fact"))


@query("set_06_required_missing", _FACTS + "SELECT doc_id, array_to_string(list_sort(list(fact_id) FILTER (NOT matched AND present)), ',') AS missing FROM m GROUP BY doc_id")
def _(t):
    missing = F.array_sort(F.collect_list(F.when(~F.col("matched") & F.col("present"), F.col("fact_id"))))
    return _matches(t).groupBy("doc_id").agg(F.when(F.size(missing) > 0, F.array_join(missing, ",")).alias("missing"))


@query("set_07_forbidden_matched", _FACTS + "SELECT doc_id, count(*) AS n FROM m WHERE matched AND NOT present GROUP BY doc_id")
def _(t):
    return _matches(t).where("matched and not present").groupBy("doc_id").agg(F.count("*").alias("n"))


# A summary of an output stands for what a compaction wrote: every second of its lines.
_LOST = r""", sm AS (SELECT *, ' ' || array_to_string(list_filter(string_split_regex(lower(array_to_string(list_filter(string_split(whole, chr(10)), lambda x, i: i % 2 = 1), chr(10))), '\s+'), lambda x: x <> ''), ' ') || ' ' AS summary FROM m)
""".replace(r"\s+", sc.BLANK + "+")


def _lost():
    lines = F.filter(F.split("whole", "\n"), lambda _, i: i % 2 == 0)
    summary = F.concat(F.lit(" "), F.array_join(fx.tokens(F.array_join(lines, "\n")), " "), F.lit(" "))
    return F.col("matched") & ~F.contains(summary, F.col("canonical"))


@query("set_08_facts_lost", _FACTS + _LOST + "SELECT doc_id, fact_id FROM sm WHERE matched AND NOT contains(summary, ' ' || canonical || ' ')")
def _(t):
    return _matches(t).where(_lost()).select("doc_id", "fact_id")


@query("gr_02_compression_fidelity", _FACTS + _LOST + "SELECT doc_id, CASE WHEN bool_or(matched AND NOT contains(summary, ' ' || canonical || ' ')) THEN 'warn' ELSE 'pass' END AS severity FROM sm GROUP BY doc_id")
def _(t):
    return _matches(t).groupBy("doc_id").agg(F.when(F.bool_or(_lost()), "warn").otherwise("pass").alias("severity"))


@query("ga_13_output_matches_artifact", r"""WITH d AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''), ' ') || ' ' AS a FROM documents),
b AS (SELECT ' ' || array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''), ' ') || ' ' AS b FROM benchmark)
SELECT doc_id, bool_or(contains(a, b)) AS passed FROM d, b GROUP BY doc_id""".replace(r"\s+", sc.BLANK + "+"))
def _(t):
    """Documents that hold a whole benchmark item, word by word."""
    docs = t.table("documents").select(F.col("doc_id").alias("output_id"), "text")
    items = t.table("benchmark").select(F.col("item_id").alias("phrase_id"), fx.tokens(F.col("text")).alias("words"))
    good = fx.quoting(docs, items, write=t.write).select(F.col("output_id").alias("doc_id"), F.lit(True).alias("found")).distinct()
    return docs.select(F.col("output_id").alias("doc_id")).join(good, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("passed"))


# Labels stand for what humans said of an output, four dimensions from their two marks; a judge goes by plain signs of
# the text. The agent is the language of the output.
_DIMENSIONS = ("faithfulness", "completeness", "coherence", "actionability")
_CAL = """WITH hl AS (SELECT doc_id, lang AS agent, 1 + 4 * quality AS h_faithfulness, 2 + 2 * quality + toxic AS h_completeness, 5 - 3 * toxic AS h_coherence, 3 + quality - toxic AS h_actionability,
  quality = 1 AND toxic = 0 AS h_pass, CASE WHEN toxic = 1 THEN 'tone' WHEN quality = 0 THEN 'omission' ELSE 'none' END AS h_mode FROM labels JOIN documents USING (doc_id)),
jl AS (SELECT doc_id, lang AS agent, CASE WHEN length(text) > 1000 THEN 5 ELSE 2 END AS j_faithfulness, CASE WHEN length(text) > 300 THEN 4 ELSE 2 END AS j_completeness,
  CASE WHEN contains(text, '  ') THEN 2 ELSE 5 END AS j_coherence, CASE WHEN contains(text, chr(10)) THEN 4 ELSE 2 END AS j_actionability, length(text) > 300 AS j_pass,
  CASE WHEN contains(text, '  ') THEN 'tone' WHEN length(text) <= 300 THEN 'omission' ELSE 'none' END AS j_mode FROM documents),
x AS (SELECT * FROM hl JOIN jl USING (doc_id, agent))
"""


def _cal(t):
    q, x, text = F.col("quality"), F.col("toxic"), F.col("text")
    docs = t.table("documents").select("doc_id", F.col("lang").alias("agent"), "text")
    human = t.table("labels").join(docs.select("doc_id", "agent"), "doc_id").select(
        "doc_id", "agent", (1 + 4 * q).alias("h_faithfulness"), (2 + 2 * q + x).alias("h_completeness"), (5 - 3 * x).alias("h_coherence"), (3 + q - x).alias("h_actionability"),
        ((q == 1) & (x == 0)).alias("h_pass"), F.when(x == 1, "tone").when(q == 0, "omission").otherwise("none").alias("h_mode"),
    )
    gaps, length = F.contains(text, F.lit("  ")), F.length(text)
    judge = docs.select(
        "doc_id", "agent", F.when(length > 1000, 5).otherwise(2).alias("j_faithfulness"), F.when(length > 300, 4).otherwise(2).alias("j_completeness"),
        F.when(gaps, 2).otherwise(5).alias("j_coherence"), F.when(F.contains(text, F.lit("\n")), 4).otherwise(2).alias("j_actionability"), (length > 300).alias("j_pass"),
        F.when(gaps, "tone").when(length <= 300, "omission").otherwise("none").alias("j_mode"),
    )
    return human.join(judge, ["doc_id", "agent"])


@query("jn_18_human_and_judge", _CAL + "SELECT doc_id, agent, " + ", ".join(f"h_{x}, j_{x}" for x in _DIMENSIONS) + ", h_pass, j_pass, h_mode, j_mode FROM x")
def _(t):
    """A label by a human and the judge's scores of the same output, by task and agent."""
    return _cal(t).select("doc_id", "agent", *[f"{who}_{x}" for x in _DIMENSIONS for who in "hj"], "h_pass", "j_pass", "h_mode", "j_mode")


@query("src_08_label_scan", "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1")
def _(t):
    return t.table("labels").where("quality = 1").select("doc_id", "quality", "toxic")


@query("flt_09_range_checks", "SELECT count(*) FILTER (length(text) <> n_chars) AS bad_length, count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) AS bad_lang, count(*) FILTER (n_chars < 1) AS short, count(*) AS n FROM documents")
def _(t):
    return t.table("documents").agg(
        F.count_if(F.length("text") != F.col("n_chars")).alias("bad_length"), F.count_if(~F.col("lang").isin("en", "de", "fr", "es")).alias("bad_lang"),
        F.count_if(F.col("n_chars") < 1).alias("short"), F.count("*").alias("n"),
    )


@query("agg_28_calibration", _CAL + "SELECT count(*) AS total, round(avg(CASE WHEN h_pass = j_pass THEN 1 ELSE 0 END), 3) AS pass_agreement, " + ", ".join(f"round(avg(abs(h_{x} - j_{x})), 2) AS {x}" for x in _DIMENSIONS)
  + f", round(avg(({' + '.join(f'abs(h_{x} - j_{x})' for x in _DIMENSIONS)}) / 4), 2) AS mean_delta, round(coalesce(avg(CASE WHEN h_mode = j_mode THEN 1 ELSE 0 END) FILTER (h_mode <> 'none'), 1), 3) AS mode_agreement FROM x")
def _(t):
    """How a judge agrees with humans: pass or fail, each dimension, and the mode of what humans call a failure (1 if they call
    nothing one)."""
    delta = {x: F.abs(F.col(f"h_{x}") - F.col(f"j_{x}")) for x in _DIMENSIONS}
    share = lambda c: F.avg(c.cast("int"))
    same = F.when(F.col("h_mode") != "none", F.col("h_mode") == F.col("j_mode"))
    return _cal(t).agg(
        F.count("*").alias("total"), F.round(share(F.col("h_pass") == F.col("j_pass")), 3).alias("pass_agreement"), *[F.round(F.avg(x), 2).alias(k) for k, x in delta.items()],
        F.round(F.avg(sum(delta.values(), F.lit(0)) / 4), 2).alias("mean_delta"), F.round(F.coalesce(share(same), F.lit(1.0)), 3).alias("mode_agreement"),
    )


@query("agg_35_kappa", _CAL + """, rt AS (SELECT doc_id, CASE WHEN v THEN 'pass' ELSE 'fail' END AS label, count(*) AS n FROM (SELECT doc_id, unnest([h_pass, j_pass, h_faithfulness >= 4, j_coherence >= 4]) AS v FROM x) GROUP BY ALL),
it AS (SELECT doc_id, sum(n) AS r, sum(n * (n - 1)) AS same, max(n) AS most FROM rt GROUP BY doc_id),
ag AS (SELECT CAST(max(r) AS BIGINT) AS raters, count(*) AS items, sum(same) / (count(*) * max(r) * (max(r) - 1)) AS seen, count(*) FILTER (2 * most > r) / count(*) AS majority FROM it),
ch AS (SELECT sum(s * s) / (SELECT CAST(items * raters AS DOUBLE) ** 2 FROM ag) AS chance FROM (SELECT sum(n) AS s FROM rt GROUP BY label))
SELECT raters, items, round((seen - chance) / (1 - chance), 4) AS kappa, round(majority, 4) AS majority FROM ag, ch""")
def _(t):
    """Four raters' verdicts on each output: their agreement beyond chance, and how often most of them agree."""
    verdicts = F.array("h_pass", "j_pass", F.col("h_faithfulness") >= 4, F.col("j_coherence") >= 4)
    rated = _cal(t).select("doc_id", F.explode(verdicts).alias("v")).groupBy("doc_id", F.when(F.col("v"), "pass").otherwise("fail").alias("label")).agg(F.count("*").alias("n"))
    k = st.fleiss_kappa(rated, ["doc_id"])
    return k.select("raters", "items", F.round("kappa", 4).alias("kappa"), F.round("majority", 4).alias("majority"))


# Conversations.


# A turn's message holds the result of the call "run-turn", which stands for the run's task of that number.
# Pairs of messages are split at the middle; a pair with the result of a protected task stays with the
# newer ones, unless that leaves nothing to compact.
_SPLIT = _DIMS + """, messages AS (SELECT conv_id AS run_id, turn, role, text FROM conversations),
prot AS (SELECT t.run_id || '-' || t.seq AS call_id FROM scored s JOIN tasks t USING (task_id) WHERE s.hitl OR s.score >= 0.7::DOUBLE),
nm AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM messages),
pm AS (SELECT nm.*, CAST(i // 2 AS BIGINT) AS pair, CAST(n // 2 AS BIGINT) AS pairs, greatest(1, n // 4) AS middle, i % 2 = 1 AND (run_id || '-' || turn) IN (SELECT call_id FROM prot) AS hit FROM nm),
pp AS (SELECT *, bool_or(hit) OVER (PARTITION BY run_id, pair) AS kept FROM pm),
po AS (SELECT *, pair < pairs AND pair < middle AND NOT kept AS old FROM pp),
split AS (SELECT run_id, turn, text, i, pair, CASE WHEN bool_or(old) OVER (PARTITION BY run_id) THEN CASE WHEN old THEN 'older' WHEN pair < pairs THEN 'newer' ELSE 'dropped' END
  WHEN i < 2 * middle THEN 'older' ELSE 'newer' END AS side FROM po)
"""


def _split(t):
    results = t.blocks.select("run_id", "turn", F.explode("blocks").alias("b")).where("b.type = 'tool_result'").select("run_id", "turn", F.col("b.tool_use_id").alias("call_id"))
    kept = results.join(t.calls, "call_id").join(rk.protected(rk.score(_dims(t))).select("task_id"), "task_id", "left_semi")
    kept = kept.select("run_id", "turn", F.lit(True).alias("result")).distinct()
    return cv.split_messages(t.messages.join(kept, ["run_id", "turn"], "left").withColumn("protected", F.coalesce("result", F.lit(False))))


@query("win_13_midpoint_split", _SPLIT + "SELECT run_id, turn, pair, side FROM split")
def _(t):
    return _split(t).select("run_id", "turn", "pair", "side")


_PAIR_TOKENS = r"""CASE WHEN length(text) = 0 THEN 0 ELSE ceil((length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]'))) / CASE WHEN length(regexp_replace(substr(text, 1, 512), '[A-Za-z0-9 ]', '', 'g')) >= 0.3 * length(substr(text, 1, 512)) THEN 3 ELSE 4 END) END"""
#: Half of a budget of 300 tokens is for recent turns.
_RECENT = 150
_TRIGGERS = _SPLIT.replace("WITH ", "WITH RECURSIVE ", 1) + f""", mp AS (SELECT run_id, pair, kept, {_PAIR_TOKENS} AS k FROM pp),
pt AS (SELECT run_id, pair, {{'k': CAST(sum(k) AS BIGINT), 'p': bool_or(kept)}} AS x FROM mp GROUP BY run_id, pair),
fd AS (SELECT DISTINCT run_id, CAST(-1 AS BIGINT) AS pair, CAST([] AS STRUCT(k BIGINT, p BOOLEAN)[]) AS recent, CAST(NULL AS BIGINT) AS gone FROM pt
UNION ALL SELECT run_id, pair, CASE WHEN NOT hit THEN al WHEN len(stay) = half THEN al[half + 1:] ELSE stay || al[half + 1:] END, CASE WHEN hit THEN half - len(stay) * CAST(len(stay) < half AS INTEGER) END FROM (
  SELECT *, al[:half] AS older, list_filter(al[:half], lambda y: y.p) AS stay FROM (
    SELECT fd.run_id, pt.pair, list_append(recent, x) AS al, greatest(1, (len(recent) + 1) // 2) AS half, list_sum(list_transform(list_append(recent, x), lambda y: y.k)) > {_RECENT} AS hit
    FROM fd JOIN pt ON pt.run_id = fd.run_id AND pt.pair = fd.pair + 1)))
"""


def _triggers(t):
    m = _split(t).select("run_id", "pair", (F.col("protected") & (F.col("i") % 2 == 1)).alias("protected"), sc.estimate_tokens(F.col("text")).alias("tokens"))
    return w.compaction_triggers(m.groupBy("run_id", "pair").agg(F.sum("tokens").alias("tokens"), F.bool_or("protected").alias("protected")), _RECENT)


@query("win_14_compaction_trigger", _TRIGGERS + "SELECT run_id, pair, gone AS compacted FROM fd WHERE gone IS NOT NULL")
def _(t):
    return _triggers(t).select("run_id", "pair", "compacted")


@query("ga_10_compaction_count", _TRIGGERS + "SELECT run_id, count(gone) AS n, count(gone) BETWEEN 1 AND 3 AS passed FROM fd GROUP BY run_id")
def _(t):
    done = _triggers(t).groupBy("run_id").agg(F.count("*").alias("k"))
    n = F.coalesce("k", F.lit(0))
    return t.messages.select("run_id").distinct().join(done, "run_id", "left").select("run_id", n.alias("n"), n.between(1, 3).alias("passed"))


# Every turn names an artifact, every third the same one; a run's first turn is its history.
_IDS = """, tagged AS (SELECT *, md5(run_id || '/' || turn % 3) AS h FROM split), ids AS (SELECT run_id, turn, i, side, text, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM tagged)
"""


def _tagged(t):
    h = F.md5(F.concat_ws("/", F.col("run_id").cast("string"), (F.col("turn") % 3).cast("string")))
    cut = lambda a, n: F.substring(h, a, n)
    ident = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    return _split(t).withColumn("text", F.concat("text", F.lit("\noutput_artifact_id: "), ident))


@query("set_09_preserved_ids", _SPLIT + _IDS + "SELECT run_id, array_to_string(list(id ORDER BY a), ',') AS ids FROM (SELECT run_id, id, min(turn) AS a FROM ids WHERE side = 'older' OR i = 0 GROUP BY run_id, id) GROUP BY run_id")
def _(t):
    x = _tagged(t)
    old = x.where("i = 0").select("run_id", "turn", "text")
    return cv.preserved_ids(old, x.where("side = 'older'").select("run_id", "turn", "text")).select("run_id", F.array_join("ids", ",").alias("ids"))


@query("ctx_10_conversation_split", _SPLIT + _IDS + """SELECT run_id, count(*) FILTER (side = 'older') AS older, count(*) FILTER (side = 'newer') AS newer, CAST(coalesce(sum(length(text) + 57) FILTER (side = 'older'), 0) AS BIGINT) AS older_chars,
array_to_string(list_sort(list(DISTINCT id) FILTER (side = 'older')), ',') AS ids FROM ids GROUP BY run_id""")
def _(t):
    old = F.col("side") == "older"
    chars = F.coalesce(F.sum(F.when(old, F.length("text"))), F.lit(0))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(old, cv.output_ids(F.col("text")))))))
    return _tagged(t).groupBy("run_id").agg(F.count_if(old).alias("older"), F.count_if(F.col("side") == "newer").alias("newer"), chars.alias("older_chars"), F.array_join(ids, ",").alias("ids"))


@query("fn_23_flatten_messages", MESSAGES + "SELECT run_id, sha256(string_agg(CASE WHEN role = 'user' THEN text || chr(10) || 'result of ' || run_id || '-' || turn ELSE text END, chr(10) ORDER BY turn)) AS flat FROM messages GROUP BY run_id")
def _(t):
    return cv.flatten(t.blocks).select("run_id", F.sha2("flat", 256).alias("flat"))


@query("jn_22_message_to_task", GRAPH + ", messages AS (SELECT conv_id AS run_id, turn FROM conversations) SELECT m.run_id, m.turn, t.task_id FROM messages m JOIN tasks t ON t.run_id || '-' || t.seq = m.run_id || '-' || m.turn")
def _(t):
    """Through the call ids of the messages' tool results."""
    results = t.blocks.select("run_id", "turn", F.explode("blocks").alias("b")).where("b.type = 'tool_result'")
    return results.select("run_id", "turn", F.col("b.tool_use_id").alias("call_id")).join(t.calls, "call_id").select("run_id", "turn", "task_id")
