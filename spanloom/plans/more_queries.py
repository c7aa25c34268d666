"""Skill versions, requests, judges and graded assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import assertions as ga
from ..operators import graph as g
from ..operators import grading as gr
from .bindings import EVENTS, GRAPH, JUDGED, MESSAGES, RESULTS
from .graph_queries import _FLOW, _HAS, _USED, _used
from .registry import query

_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


@query("flt_07_well_formed_ids", GRAPH + f"""SELECT artifact_id FROM (SELECT artifact_id, CASE WHEN artifact_id % 4 = 0 THEN content_hash ELSE
substr(content_hash, 1, 8) || '-' || substr(content_hash, 9, 4) || '-' || substr(content_hash, 13, 4) || '-' || substr(content_hash, 17, 4) || '-' || substr(content_hash, 21, 12) END AS id FROM artifacts)
WHERE regexp_matches(id, '{_UUID}')""")
def _(t):
    cut = lambda a, n: F.substring("content_hash", a, n)
    made = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    x = t.artifacts.select("artifact_id", F.when(F.col("artifact_id") % 4 == 0, F.col("content_hash")).otherwise(made).alias("id"))
    return x.where(F.col("id").rlike(_UUID)).select("artifact_id")


@query("flt_13_rescore_eligibility", RESULTS + "SELECT case_id, CASE WHEN mode = 'none' THEN 'no definition' WHEN a = 0 THEN 'no output' WHEN inconclusive THEN 'inconclusive' ELSE 'ok' END AS reason FROM results")
def _(t):
    why = F.when(F.col("mode") == "none", "no definition").when(F.col("a") == 0, "no output").when(F.col("inconclusive"), "inconclusive").otherwise("ok")
    return t.results.select("case_id", why.alias("reason"))


@query("flt_14_request_validation", GRAPH + """SELECT op_id, CASE WHEN (flow = 'O') = (tokens > 25) THEN 'exactly one of id and query' WHEN op_no < 1 OR op_no > 100 THEN 'limit out of range' ELSE 'ok' END AS verdict FROM operations""")
def _(t):
    """An operation stands for a request: with an id (it produces), a query (it is long), both or neither."""
    both = (F.col("flow") == "O") == (F.col("tokens") > 25)
    v = F.when(both, "exactly one of id and query").when(~F.col("op_no").between(1, 100), "limit out of range").otherwise("ok")
    return t.operations.select("op_id", v.alias("verdict"))


_VERSIONS = GRAPH + """, v AS (SELECT name, artifact_id, (artifact_id % 3 + 1) AS major, (artifact_id % 12) AS minor FROM artifacts)
"""


@query("top_04_latest_version", _VERSIONS + "SELECT name, arg_max(major || '.' || minor, (major, minor)) AS version FROM v GROUP BY name")
def _(t):
    """Versions compare by number, so 1.10 is after 1.9."""
    version = F.concat_ws(".", (F.col("artifact_id") % 3 + 1).cast("string"), (F.col("artifact_id") % 12).cast("string"))
    v = t.artifacts.select("name", version.alias("version"))
    parts = F.transform(F.split("version", r"\."), lambda x: x.cast("int"))
    return v.groupBy("name").agg(F.max_by("version", parts).alias("version"))


@query("jn_13_skill_prompts", _VERSIONS + """, l AS (SELECT name, arg_max(artifact_id, (major, minor, artifact_id)) AS artifact_id FROM v GROUP BY name)
SELECT DISTINCT t.run_id, l.name, l.artifact_id AS prompt FROM produces p JOIN tasks t USING (task_id) JOIN artifacts a USING (artifact_id) JOIN l ON l.name = a.name""")
def _(t):
    """For each name a run made, the artifact with its latest version."""
    a = F.col("artifact_id")
    latest = t.artifacts.groupBy("name").agg(F.max_by("artifact_id", F.struct(a % 3, a % 12, a)).alias("prompt"))
    names = t.produces.join(t.tasks.select("task_id", "run_id"), "task_id").join(t.artifacts.select("artifact_id", "name"), "artifact_id")
    return names.select("run_id", "name").distinct().join(latest, "name").select("run_id", "name", "prompt")


@query("jn_21_judge_orderings", JUDGED + "SELECT case_id, a1 AS first_a, b1 AS first_b, a2 AS second_a, b2 AS second_b FROM judged")
def _(t):
    """A row for each ordering in which a judge saw the two arms, joined to the other of the same case."""
    row = lambda o: F.struct(F.lit(o).alias("ordering"), F.col(f"a{o}").alias("a"), F.col(f"b{o}").alias("b"))
    seen = t.judged.select("case_id", F.inline(F.array(row(1), row(2))))
    side = lambda o, name: seen.where(F.col("ordering") == o).select("case_id", F.col("a").alias(f"{name}_a"), F.col("b").alias(f"{name}_b"))
    return side(1, "first").join(side(2, "second"), "case_id")


# A specification of all thirteen types. A run's output is what its last operation made, its error the name of its root,
# a system message the summary of a compaction, an even supplier the skill "even".
_NO = {k: None for k in ("role", "name", "status", "op_type", "role2", "name2", "status2", "op_type2", "kind", "least", "most", "run_status", "pattern", "mode", "skill", "version")}
_SPEC = [
    {"type": "task_exists", "role": "hitl", "status": "completed"},
    {"type": "task_absent", "name": "1-URGENT", "status": "failed"},
    {"type": "task_order", "role": "subagent", "role2": "tool"},
    {"type": "task_count", "role": "tool", "least": 2, "most": 4},
    {"type": "run_status", "run_status": "completed"},
    {"type": "artifact_content", "role": "subagent", "pattern": "steel|[0-9]5$"},
    {"type": "consumes", "role": "tool", "role2": "subagent"},
    {"type": "consumes_absent", "role": "tool", "role2": "subagent"},
    {"type": "operation_count", "kind": "llm_call", "least": 10},
    {"type": "compaction_count", "least": 1, "most": 3},
    {"type": "run_error", "pattern": "urgent|high"},
    {"type": "skill_invoked", "role": "hitl", "skill": "even"},
    {"type": "run_output_matches_artifact", "role": "tool", "mode": "exact"},
    {"type": "run_output_matches_artifact", "op_type": "llm_call", "mode": "contains"},
    {"type": "task_absent", "role": "root", "op_type": "hitl_response"},
    {"type": "operation_count", "role": "nobody", "most": 0},
    {"type": "consumes_absent", "role": "nobody", "role2": "subagent"},
    {"type": "skill_invoked", "role": "nobody"},
]
_RUN_TASKS = "(SELECT count(*) FROM tasks t WHERE t.run_id = r.run_id AND {0})"
_LINKED = "EXISTS (SELECT 1 FROM links l JOIN tasks c ON c.task_id = l.consumer JOIN tasks p ON p.task_id = l.producer WHERE l.run_id = r.run_id AND c.role = '{0}' AND p.role = 'subagent')"
_HAS_OP = "EXISTS (SELECT 1 FROM operations o WHERE o.task_id = t.task_id AND o.type = '{0}')"
_SAME = "coalesce((SELECT bool_or({1}) FROM tasks t JOIN produces p USING (task_id) JOIN artifacts a USING (artifact_id) WHERE t.run_id = r.run_id AND {0}), false)"
_SEQ = "(SELECT min(seq) FROM tasks t WHERE t.run_id = r.run_id AND t.role = '{0}')"
_ASSERTED = [
    _RUN_TASKS.format("role = 'hitl' AND status = 'completed'") + " > 0",
    _RUN_TASKS.format("name = '1-URGENT' AND status = 'failed'") + " = 0",
    f"coalesce({_SEQ.format('subagent')} < {_SEQ.format('tool')}, false)",
    _RUN_TASKS.format("role = 'tool'") + " BETWEEN 2 AND 4",
    _RUN_TASKS.format("role = 'root' AND status = 'completed'") + " > 0",
    _SAME.format("t.role = 'subagent'", "regexp_matches(a.content, '(?i)steel|[0-9]5$')"),
    _LINKED.format("tool"),
    "NOT " + _LINKED.format("tool"),
    "(SELECT count(*) FROM tasks t JOIN operations o USING (task_id) WHERE t.run_id = r.run_id AND o.type = 'llm_call') >= 10",
    "(SELECT count(*) FROM conversations c WHERE c.conv_id = r.run_id AND c.role = 'system') BETWEEN 1 AND 3",
    _RUN_TASKS.format("role = 'root' AND status = 'failed' AND regexp_matches(name, '(?i)urgent|high')") + " > 0",
    _RUN_TASKS.format("role = 'hitl'") + " > 0 AND " + _RUN_TASKS.format("role = 'hitl' AND NOT EXISTS (SELECT 1 FROM operations o WHERE o.task_id = t.task_id AND o.skill_id % 2 = 0)") + " = 0",
    _SAME.format("t.role = 'tool'", "r.output = a.content"),
    _SAME.format(_HAS_OP.format("llm_call"), "contains(r.output, a.content)"),
    _RUN_TASKS.format("role = 'root' AND " + _HAS_OP.format("hitl_response")) + " = 0",
    "true",
    "true",
    "false",
]
_ASSERTIONS = GRAPH + _FLOW + """, last AS (SELECT t.run_id, arg_max(a.content, p.op_id) AS output FROM tasks t JOIN produces p USING (task_id) JOIN artifacts a USING (artifact_id) GROUP BY t.run_id),
rr AS (SELECT run_id, output FROM runs LEFT JOIN last USING (run_id)),
asserted AS (""" + " UNION ALL ".join(f"SELECT run_id, {i} AS idx, '{s['type']}' AS type, {sql} AS passed FROM rr r" for i, (s, sql) in enumerate(zip(_SPEC, _ASSERTED))) + ")\n"


def _asserted(t):
    specs = t.spark.createDataFrame([tuple((_NO | s | {"idx": i})[c.split()[0]] for c in ga.SPEC.split(", ")) for i, s in enumerate(_SPEC)], ga.SPEC)
    of = t.tasks.select("task_id", "run_id", "name", "role")
    made = t.produces.join(t.artifacts.select("artifact_id", "content"), "artifact_id")
    last = made.join(of, "task_id").groupBy("run_id").agg(F.max_by("content", "op_id").alias("output"))
    runs = t.runs.select("run_id").join(last, "run_id", "left").join(of.where("role = 'root'").select("run_id", F.col("name").alias("error")), "run_id", "left")
    invoked = t.operations.select("task_id", F.when(F.col("skill_id") % 2 == 0, "even").otherwise("odd").alias("skill"), F.lit("1.0").alias("version"))
    return ga.evaluate(specs, t.tasks, t.operations, made.select("task_id", "content"), g.consumption(t.tasks, t.produces, t.consumes), invoked, t.messages.where("role = 'system'").select("run_id"), runs)


@query("udf_04_assertion_table", _ASSERTIONS + "SELECT run_id, idx, type, passed FROM asserted")
def _(t):
    """Assertions as rows, of all types, each evaluated for every run in one pass."""
    return _asserted(t)


_GRADES = _ASSERTIONS + _USED + """, retried AS (SELECT t.run_id, count(*) AS ops, count(*) FILTER (o.status = 'succeeded') AS ok FROM tasks t JOIN operations o USING (task_id) GROUP BY t.run_id, t.task_id),
grades AS (SELECT run_id, 'graph_assertion' AS aspect, CASE WHEN passed THEN 'pass' ELSE 'fail' END AS severity FROM asserted
  UNION ALL SELECT run_id, 'skill_decomposition', CASE WHEN len(list_filter(required, lambda x: NOT list_contains(u, x))) + len(list_filter(forbidden, lambda x: list_contains(u, x))) > 0 THEN 'fail' ELSE 'pass' END FROM want
  UNION ALL SELECT run_id, 'retry_recovery', CASE WHEN ops <= 1 THEN 'pass' WHEN ok = 0 THEN 'fail' WHEN ops > 2 * ok THEN 'warn' ELSE 'pass' END FROM retried)
"""


def _grades(t):
    """All grades of a run: of its assertions, its skills and each task's retries."""
    one = _asserted(t).select("run_id", F.lit("graph_assertion").alias("aspect"), F.when(F.col("passed"), "pass").otherwise("fail").alias("severity"))
    two = _used(t).select("run_id", F.lit("skill_decomposition").alias("aspect"), gr.skill_grade(F.array_sort("u"), F.col("required"), F.col("forbidden"))["severity"].alias("severity"))
    x = t.tasks.select("run_id", "task_id").join(t.operations.groupBy("task_id").agg(F.count("*").alias("ops"), F.count_if(F.col("status") == "succeeded").alias("ok")), "task_id")
    retry = F.when(F.col("ops") <= 1, "pass").when(F.col("ok") == 0, "fail").when(F.col("ops") > 2 * F.col("ok"), "warn").otherwise("pass")
    return one.union(two).union(x.select("run_id", F.lit("retry_recovery"), retry))


@query("gr_04_assertion_grades", _GRADES + "SELECT run_id, aspect, severity, count(*) AS n FROM grades GROUP BY ALL")
def _(t):
    return _grades(t).groupBy("run_id", "aspect", "severity").agg(F.count("*").alias("n"))


@query("agg_18_severity_totals", _GRADES + "SELECT run_id, count(*) FILTER (severity = 'pass') AS pass, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'fail') AS fail FROM grades GROUP BY run_id")
def _(t):
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return _grades(t).groupBy("run_id").agg(n("pass"), n("warn"), n("fail"))


@query("agg_34_reliability", _ASSERTIONS + """, ok AS (SELECT run_id, bool_and(passed) FILTER (idx IN (2, 3)) AS structural, bool_and(passed) FILTER (idx IN (2, 3, 5)) AS whole FROM asserted GROUP BY run_id),
dp AS (SELECT run_id, max(seq) AS depth FROM tasks GROUP BY run_id)
SELECT depth, count(*) AS runs, round(count(*) FILTER (structural) / count(*), 4) AS structural, round(count(*) FILTER (whole) / count(*), 4) AS end_to_end FROM dp JOIN ok USING (run_id) GROUP BY depth""")
def _(t):
    """Of the runs of each depth, the share that passes the assertions on counts and order of tasks, and the share that passes
    those on what they made as well."""
    all_ = lambda *types: F.bool_and(F.when(F.col("type").isin(*types), F.col("passed")))
    # One assertion of each of these types is in the specification.
    ok = _asserted(t).groupBy("run_id").agg(all_("task_count", "task_order").alias("structural"), all_("task_count", "task_order", "artifact_content").alias("whole"))
    depth = t.tasks.groupBy("run_id").agg(F.max("seq").alias("depth")).join(ok, "run_id")
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 4)
    return depth.groupBy("depth").agg(F.count("*").alias("runs"), share("structural").alias("structural"), share("whole").alias("end_to_end"))


@query("fn_21_open_ranges", GRAPH + _HAS.format("count(*) >= 5"))
def _(t):
    return t.tasks.groupBy("run_id").agg(ga.in_range(F.count("*"), 5, None).alias("passed"))


@query("fn_25_budget_utilisation", EVENTS + "SELECT run_id, round(100.0 * sum(tokens) / 50000, 2) AS percent FROM events_ GROUP BY run_id")
def _(t):
    return t.events.groupBy("run_id").agg(F.round(F.lit(100.0) * F.sum("tokens") / 50_000, 2).alias("percent"))


@query("fn_26_skill_key", GRAPH + "SELECT skill_id, name || '@' || (skill_id % 4 + 1) AS key, substr(name, 1, 8) AS prefix FROM skills")
def _(t):
    return t.skills.select("skill_id", F.concat("name", F.lit("@"), (F.col("skill_id") % 4 + 1).cast("string")).alias("key"), F.substring("name", 1, 8).alias("prefix"))


@query("fn_29_details", GRAPH + "SELECT task_id, concat_ws(', ', 'role=' || role, 'name=' || name, CASE WHEN status <> 'running' THEN 'status=' || status END) AS detail FROM tasks")
def _(t):
    part = lambda k: F.concat(F.lit(f"{k}="), F.col(k))
    return t.tasks.select("task_id", F.concat_ws(", ", part("role"), part("name"), F.when(F.col("status") != "running", part("status"))).alias("detail"))


@query("fn_15_interpolate", MESSAGES + "SELECT run_id, turn, 'In ' || role || ' turn ' || turn || ' of {{who}}' AS prompt FROM messages")
def _(t):
    values = F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string"))
    return t.messages.select("run_id", "turn", sc.interpolate(F.lit("In {{role}} turn {{turn}} of {{who}}"), values).alias("prompt"))


@query("fn_18_tagged_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    text = F.concat(F.lit("so: <answer>"), "props", F.lit("</answer>."))
    return t.table("events").select("event_id", sc.tagged_json(text, "answer", "k long")["k"].alias("k"))


@query("fn_06_stringify", GRAPH + """SELECT task_id, CASE WHEN status = 'completed' THEN name ELSE '{"role":"' || role || '","seq":' || seq || '}' END AS text FROM tasks""")
def _(t):
    return t.tasks.select("task_id", F.when(F.col("status") == "completed", F.col("name")).otherwise(F.to_json(F.struct("role", "seq"))).alias("text"))


@query("prj_07_all_documents", GRAPH + "SELECT t.task_id, coalesce(p.n, 0) + coalesce(c.n, 0) AS documents FROM tasks t LEFT JOIN (SELECT task_id, count(*) AS n FROM produces GROUP BY 1) p USING (task_id) LEFT JOIN (SELECT task_id, count(*) AS n FROM consumes GROUP BY 1) c USING (task_id)")
def _(t):
    """Sources and inputs of a task as one list; its length."""
    made = t.produces.groupBy("task_id").agg(F.collect_list("artifact_id").alias("sources"))
    used = t.consumes.groupBy("task_id").agg(F.collect_list("artifact_id").alias("inputs"))
    j = t.tasks.select("task_id").join(made, "task_id", "left").join(used, "task_id", "left")
    none = F.array().cast("array<bigint>")
    return j.select("task_id", F.size(F.concat(F.coalesce("sources", none), F.coalesce("inputs", none))).cast("long").alias("documents"))
