"""Documents written and read back, upserts, registered functions and declared assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import statistics as st
from ..operators import facts as fx
from ..operators import table_functions as tf
from ..sources import documents as d
from ..streaming import flows
from .bindings import EVENTS, GRAPH, MESSAGES, RESULTS
from .bindings import shared_folder as _folder
from .flow_queries import _replay
from .registry import query
from .result_queries import _SUM
from .text_queries import _FACTS, _matches
from .window_queries import _SWEPT, sweep_summary


@query("src_04_definition_documents", GRAPH + "SELECT definition_id, name, 1 AS version, CAST(len(skills) AS BIGINT) AS skills FROM (SELECT definition_id, name, [definition_id + 1, definition_id + 2] AS skills FROM definitions)")
def _(t):
    skill = lambda k: F.struct((F.col("definition_id") + k).alias("skill_id"), F.lit("never").alias("policy"))
    out = d.write_json(t.definitions.select("definition_id", "name", F.lit(1).alias("version"), F.array(skill(1), skill(2)).alias("skills")), _folder(t))
    return d.read_definitions(t.spark, out).select("definition_id", "name", "version", F.size("skills").cast("long").alias("skills"))


@query("src_05_skill_documents", GRAPH + "SELECT skill_id, name, CASE WHEN skill_id % 2 = 0 THEN '2.0' ELSE '1.0' END AS version, '' AS description, 10 AS max_iterations FROM skills")
def _(t):
    out = d.write_json(t.skills.select("skill_id", "name", F.when(F.col("skill_id") % 2 == 0, "2.0").alias("version")), _folder(t))
    return d.read_skills(t.spark, out)


@query("src_06_report_scan", RESULTS + "SELECT case_id, run, category, a, b FROM results WHERE case_id % 50 <> 0 AND case_id % 50 <> 1")
def _(t):
    """Reports of which some are cut off and some lack a required field."""
    rows = t.results.select("case_id", "run", F.when(F.col("case_id") % 50 != 1, F.col("category")).alias("category"), "a", "b")
    line = F.to_json(F.struct("*"))
    cut = F.when(rows["case_id"] % 50 == 0, F.substring(line, 1, 20)).otherwise(line)
    out = _folder(t)
    rows.select(cut.alias("value")).write.text(out)
    # Newest first is an order of rows, which a later step may use; the set of rows is what is compared.
    return d.read_reports(t.spark, out, modified=True).orderBy(F.desc("modified"), "file").drop("file", "modified")


@query("src_07_case_validation", "SELECT doc_id, concat_ws(',', CASE WHEN length(text) > 5000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'lang' END, CASE WHEN n_chars < 300 THEN 'short' END) AS errors FROM documents WHERE length(text) > 5000 OR lang <> 'en' OR n_chars < 300")
def _(t):
    rules = {"long": F.length("text") <= 5000, "lang": F.col("lang") == "en", "short": F.col("n_chars") >= 300}
    return d.validate(t.table("documents"), rules).where(F.size("errors") > 0).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query("snk_03_skill_upsert", GRAPH + """SELECT coalesce(s.skill_id, i.skill_id) AS skill_id, coalesce(CASE WHEN s.skill_id % 3 <> 0 THEN s.name END, i.name) AS name, coalesce(i.direct, s.skill_id % 2 = 0) AS direct
FROM skills s FULL JOIN (SELECT definition_id * 5 AS skill_id, name, true AS direct FROM definitions) i ON i.skill_id = s.skill_id""")
def _(t):
    old = t.skills.select("skill_id", F.when(F.col("skill_id") % 3 != 0, F.col("name")).otherwise("").alias("name"), (F.col("skill_id") % 2 == 0).alias("direct"))
    new = t.definitions.select((F.col("definition_id") * 5).alias("skill_id"), "name", F.lit(True).alias("direct"))
    return d.upsert(old, new, ["skill_id"], ["name"], ["direct"])


@query("snk_04_report_write", RESULTS + "SELECT case_id, run, category, a, b FROM results")
def _(t):
    return d.read_reports(t.spark, d.write_json(t.results.select("case_id", "run", "category", "a", "b"), _folder(t)))


_SWEPT_ALL = _SWEPT[_SWEPT.index("WITH ") + 5:]


@query("snk_05_summary_write", f"""SELECT * FROM (WITH RECURSIVE {_SWEPT_ALL} SELECT 'sweep' AS kind, config AS label, n, round(mean, 2) AS mean, round(coalesce(sd, 0), 2) AS sd, round(mean - half, 2) AS lower, round(mean + half, 2) AS upper, round(completed, 4) AS completed,
  round(tokens, 2) AS tokens, round(latency, 2) AS latency, CAST(NULL AS DOUBLE) AS factual, CAST(NULL AS DOUBLE) AS per_fact FROM sv)
UNION ALL SELECT * FROM ({RESULTS}, g AS (SELECT category, {_SUM.format(x='a')} FROM results GROUP BY category) SELECT 'multi-run', category, a_n, a_mean, a_sd, round(a_mean - a_ci, 4), round(a_mean + a_ci, 4), NULL, NULL, NULL, NULL, NULL FROM g)
UNION ALL SELECT * FROM ({_FACTS} SELECT 'rescore', CAST(doc_id AS VARCHAR), count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(any_value(coalesce(hit / nullif(wt, 0), 0)), 4), round(any_value(coalesce(hita / nullif(wa, 0), 0)), 4) FROM s JOIN m USING (doc_id) GROUP BY doc_id)""")
def _(t):
    """Summaries of runs, of a sweep and of a rescoring, each with its own fields, written as JSON to a folder of its own and
    read back into one table."""
    r = lambda c, n, to=None: F.round(c, n).alias(to or c)
    sweep = sweep_summary(t).select(F.lit("sweep").alias("kind"), F.col("config").alias("label"), "n", r("mean", 2), r("sd", 2), r("lower", 2), r("upper", 2), r("completed", 4), r("tokens", 2), r("latency", 2))
    a = t.results.groupBy(F.col("category").alias("label")).agg(*st.summary(F.col("a"), "a"))
    runs = a.select(F.lit("multi-run").alias("kind"), "label", F.col("a_n").alias("n"), F.col("a_mean").alias("mean"), F.col("a_sd").alias("sd"), r(F.col("a_mean") - F.col("a_ci"), 4, "lower"), r(F.col("a_mean") + F.col("a_ci"), 4, "upper"))
    facts = _matches(t).groupBy(F.col("doc_id").cast("string").alias("label")).agg(F.count("*").alias("n"), *[r(x, 4, k) for k, x in fx.both_scores().items()])
    rescored = facts.select(F.lit("rescore").alias("kind"), "label", "n", "factual", "per_fact")
    out = [d.write_json(x, _folder(t)) for x in (sweep, runs, rescored)]
    fields = "mean double, sd double, lower double, upper double, completed double, tokens double, latency double, factual double, per_fact double"
    return t.spark.read.schema(f"kind string, label string, n long, {fields}").json(out)


_NAME = "source || CASE lang WHEN 'en' THEN '.md' WHEN 'de' THEN '.html' WHEN 'fr' THEN '.sql' ELSE '.log' END"


@query("snk_07_output_capture", f"""SELECT name, CASE split_part(name, '.', 2) WHEN 'md' THEN 'text/markdown' WHEN 'html' THEN 'text/html' ELSE 'application/sql' END AS mime,
CAST(sum(octet_length(encode(replace(text, chr(10), ' '))) + 1) AS BIGINT) AS size, name IN ('src1.md', 'src2.html') AS promoted FROM (SELECT {_NAME} AS name, text FROM documents) WHERE name NOT LIKE '%.log' GROUP BY name""")
def _(t):
    """Outputs of all sources; two were promoted, logs are matched by no pattern."""
    out = _folder(t)
    ending = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".html").when(F.col("lang") == "fr", ".sql").otherwise(".log")
    rows = t.table("documents").select(F.concat("source", ending).alias("name"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    rows.write.partitionBy("name").text(out)
    return d.capture_files(t.spark, out, ["*.md", "*.html", "*.sql", "*.m*"], ["src1.md", "src2.html"])


@query("top_05_report_selection", RESULTS + "SELECT prefix, category, run, case_id FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY run DESC, case_id) AS k FROM results JOIN (VALUES ('syn'), ('dec'), ('')) p(prefix) ON starts_with(category, prefix)) WHERE k = 1")
def _(t):
    """For each prefix the newest report."""
    prefixes = ["syn", "dec", ""]
    got = d.select_reports(t.results.select("category", "run", "case_id"), "category", [-F.col("run"), F.col("case_id")], prefixes=prefixes)
    return got.select(F.get(F.array(*[F.lit(p) for p in prefixes]), F.col("rank") - 1).alias("prefix"), "category", "run", "case_id")


# Requests wait in order; a purchase decides the one that waits longest, unless its time is up.
_QUEUE = """WITH RECURSIVE ev AS (SELECT user_id AS run_id, event_id, epoch_ms(ts) AS ms, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events WHERE event_type IN ('{begins}', '{ends}')),
f AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(ms BIGINT, id BIGINT)[]) AS q, CAST(NULL AS STRUCT(ms BIGINT, id BIGINT)) AS gone, CAST(NULL AS BIGINT) AS by_id, CAST(NULL AS BIGINT) AS by_ms FROM ev
UNION ALL SELECT f.run_id, e.k, CASE WHEN e.kind = '{begins}' THEN list_append({q}, {{'ms': e.ms, 'id': e.event_id}}) ELSE ({q})[2:] END, CASE WHEN e.kind = '{ends}' THEN ({q})[1] END,
  CASE WHEN e.kind = '{ends}' THEN e.event_id END, CASE WHEN e.kind = '{ends}' THEN e.ms END FROM f JOIN ev e ON e.run_id = f.run_id AND e.k = f.k + 1),
done AS (SELECT run_id, gone.id AS id, gone.ms AS ms, by_id, by_ms FROM f WHERE gone IS NOT NULL),
hz AS (SELECT max(epoch_ms(ts)) AS t FROM events),
asked AS (SELECT e.run_id, e.event_id AS id, e.ms, d.by_id, d.by_ms FROM ev e LEFT JOIN done d ON d.run_id = e.run_id AND d.id = e.event_id WHERE e.kind = '{begins}')
"""
_APPROVALS = _QUEUE.format(begins="signup", ends="purchase", q="list_filter(f.q, lambda x: e.ms - x.ms <= 3600000)") + """, outcomes AS (SELECT run_id, id AS request,
  CASE WHEN by_id IS NOT NULL THEN 'resolved' WHEN (SELECT t FROM hz) - ms > 3600000 THEN 'timeout' END AS outcome FROM asked)
"""


@query("str_01_approvals", _APPROVALS + "SELECT run_id, request, outcome FROM outcomes WHERE outcome IS NOT NULL")
def _(t):
    return _replay(t, flows.all_approvals, timeout_seconds=3600)


@query("str_02_status", _APPROVALS + "SELECT run_id, request, coalesce(outcome, 'pending') AS status FROM outcomes UNION ALL SELECT user_id, -event_id, 'unknown' FROM events WHERE event_type = 'click'")
def _(t):
    """What became of each request so far: its outcome, or pending. Who asks for one that nobody made hears
    unknown, as do clicks here, that ask by a number no request has."""
    done = _replay(t, flows.all_approvals, timeout_seconds=3600)
    made = t.events.where("kind = 'signup'").select("run_id", F.col("event_id").alias("request"), F.lit(True).alias("made"))
    asked = made.drop("made").union(t.events.where("kind = 'click'").select("run_id", -F.col("event_id")))
    known = asked.join(made, ["run_id", "request"], "left").join(done, ["run_id", "request"], "left")
    return known.select("run_id", "request", F.coalesce("outcome", F.when(F.col("made"), "pending"), F.lit("unknown")).alias("status"))


_WORK = _QUEUE.format(begins="view", ends="click", q="f.q") + """SELECT run_id, id AS began, CAST(NULL AS BIGINT) AS ended, 'in progress' AS status FROM asked WHERE coalesce(by_ms, (SELECT t FROM hz)) - ms > 600000
UNION ALL SELECT run_id, id, by_id, 'completed' FROM done WHERE by_ms - ms > 600000"""


@query("str_07_slow_work", _WORK)
def _(t):
    return _replay(t, flows.all_work, slow_seconds=600)


@query("udf_01_function_registry", MESSAGES + rf"SELECT run_id, turn, sha256(regexp_replace(trim(regexp_replace(lower(text), '{sc.BLANK}+', ' ', 'g')), '[?.!,;:]+$', '')) AS key FROM messages")
def _(t):
    sc.register(t.spark)
    t.messages.createOrReplaceTempView("trace_messages")
    return t.spark.sql("SELECT run_id, turn, content_hash(normalize_prompt(text)) AS key FROM trace_messages")


@query("udf_02_aggregates", EVENTS + f"SELECT kind, {_SUM.format(x='tokens')} FROM events_ GROUP BY kind")
def _(t):
    return t.events.groupBy("kind").agg(*st.summary(F.col("tokens"), "tokens"))


@query("udf_03_table_functions", GRAPH + """, arts AS (SELECT t.run_id, count(*) AS n, count(DISTINCT a.name) AS names FROM tasks t JOIN produces p USING (task_id) JOIN artifacts a USING (artifact_id) GROUP BY t.run_id),
prov AS (SELECT t.run_id, count(*) AS n, count(DISTINCT p.artifact_id) AS names FROM produces p JOIN tasks t USING (task_id) GROUP BY t.run_id),
lin AS (SELECT t.run_id, count(DISTINCT t.task_id) AS n, count(o.op_id) AS names FROM tasks t LEFT JOIN operations o USING (task_id) GROUP BY t.run_id)
SELECT 'artifacts' AS looked, r.run_id, n, names FROM runs r JOIN arts USING (run_id) UNION ALL SELECT 'provenance', r.run_id, n, names FROM runs r JOIN prov USING (run_id) UNION ALL SELECT 'lineage', r.run_id, n, names FROM runs r JOIN lin USING (run_id)""")
def _(t):
    """The three look-ups as table functions of SQL, each joined laterally to all runs."""
    tf.register(t.spark, t.runs, t.tasks, t.operations, t.produces, t.consumes, t.artifacts)
    return t.spark.sql("""SELECT 'artifacts' AS looked, r.run_id, count(*) AS n, count(DISTINCT a.name) AS names FROM trace_runs r, LATERAL artifacts_for_run(r.run_id) a GROUP BY r.run_id
    UNION ALL SELECT 'provenance', r.run_id, count(*), count(DISTINCT p.artifact_id) FROM trace_runs r, LATERAL provenance(r.run_id) p GROUP BY r.run_id
    UNION ALL SELECT 'lineage', r.run_id, count(DISTINCT l.task_id), count(l.op_id) FROM trace_runs r, LATERAL lineage(r.run_id) l GROUP BY r.run_id""")