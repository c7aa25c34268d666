"""Ordered looks at runs: windows, audits of limits and policies, and context ranking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import statistics as st
from ..operators import graph as g
from ..operators import ranking as rk
from ..operators import windows as w
from .bindings import EVENTS, GRAPH
from .registry import query

_MADE = """, made AS (SELECT t.run_id, p.op_id, a.artifact_id, a.name, a.content_hash FROM produces p JOIN tasks t USING (task_id) JOIN artifacts a USING (artifact_id))
"""


def _made(t):
    return g.artifacts_of_runs(t.tasks, t.produces, t.artifacts, "name", "content_hash").select("run_id", "op_id", "artifact_id", "name", "content_hash")


@query("win_01_emergence_order", GRAPH + "SELECT run_id, op_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq, op_no) AS INTEGER) AS pos FROM operations JOIN tasks USING (task_id)")
def _(t):
    j = t.operations.select("task_id", "op_id", "op_no").join(t.tasks.select("task_id", "run_id", "seq"), "task_id")
    return j.select("run_id", "op_id", F.row_number().over(Window.partitionBy("run_id").orderBy("seq", "op_no")).alias("pos"))


@query("win_02_next_position", GRAPH + "SELECT run_id, count(*) + 1 AS next FROM tasks GROUP BY run_id")
def _(t):
    return t.tasks.groupBy("run_id").agg((F.count("*") + 1).alias("next"))


@query("win_05_first_success", GRAPH + "SELECT task_id, arg_min(op_id, op_no) AS op_id FROM operations WHERE status = 'succeeded' GROUP BY task_id")
def _(t):
    return t.operations.where("status = 'succeeded'").groupBy("task_id").agg(F.min_by("op_id", "op_no").alias("op_id"))


@query("win_06_content_dedup", GRAPH + _MADE + "SELECT run_id, op_id, artifact_id, first_value(artifact_id) OVER (PARTITION BY run_id, content_hash ORDER BY op_id) AS canonical FROM made")
def _(t):
    return w.dedup_by_hash(_made(t), ["run_id"], "content_hash", ["op_id"], "artifact_id").select("run_id", "op_id", "artifact_id", "canonical")


@query("win_07_version_chain", GRAPH + _MADE + """, f AS (SELECT *, first_value(op_id) OVER (PARTITION BY run_id, content_hash ORDER BY op_id) AS c FROM made)
SELECT run_id, op_id, lag(op_id) OVER (PARTITION BY run_id, name ORDER BY op_id) AS supersedes FROM f WHERE op_id = c""")
def _(t):
    return w.version_chain(_made(t), ["run_id"], "name", "content_hash", ["op_id"], "op_id").select("run_id", "op_id", "supersedes")


@query("win_08_budget_crossing", EVENTS + """, s AS (SELECT *, sum(tokens) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events_)
SELECT run_id, event_id, CAST(running AS BIGINT) AS running FROM s WHERE running >= 50000 AND running - tokens < 50000""")
def _(t):
    return w.first_crossing(t.events, ["run_id"], "tokens", ["ts", "event_id"], 50_000).select("run_id", "event_id", "running")


_STREAKS = EVENTS + """, s AS (SELECT run_id, kind, CAST(sum(CASE WHEN kind = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM events_)
SELECT run_id, island, count(*) AS length FROM s WHERE kind = 'error' GROUP BY run_id, island HAVING count(*) >= 3"""


@query("win_09_circuit_breaker", _STREAKS)
def _(t):
    return w.streaks(t.events, ["run_id"], F.col("kind") == "error", ["ts", "event_id"], 3)


@query("pol_05_breaker_trips", f"SELECT run_id, count(*) AS trips FROM ({_STREAKS}) GROUP BY run_id")
def _(t):
    return w.streaks(t.events, ["run_id"], F.col("kind") == "error", ["ts", "event_id"], 3).groupBy("run_id").agg(F.count("*").alias("trips"))


_CALLS = GRAPH + """, x AS (SELECT *, count(*) FILTER (status = 'completed') OVER (PARTITION BY run_id, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tasks)
SELECT run_id, task_id, before FROM x WHERE before >= 2"""


@query("win_10_max_calls", _CALLS)
def _(t):
    return w.calls_over_limit(t.tasks, 2).select("run_id", "task_id", "before")


@query("pol_02_max_calls_per_run", f"SELECT run_id, count(*) AS violations FROM ({_CALLS}) GROUP BY run_id")
def _(t):
    return w.calls_over_limit(t.tasks, 2).groupBy("run_id").agg(F.count("*").alias("violations"))


@query("win_15_operation_limit", GRAPH + "SELECT task_id, op_id FROM operations WHERE op_no > 6")
def _(t):
    return t.operations.where("op_no > 6").select("task_id", "op_id")


@query("win_16_task_limit", GRAPH + "SELECT run_id, task_id FROM tasks WHERE seq >= 15")
def _(t):
    return t.tasks.where("seq >= 15").select("run_id", "task_id")


@query("pol_04_limits", GRAPH + """SELECT run_id, count(DISTINCT t.task_id) > 12 AS tasks_over, coalesce(max(op_no), 0) > 8 AS operations_over, coalesce(sum(tokens), 0) > 2000 AS tokens_over
FROM tasks t LEFT JOIN operations o USING (task_id) GROUP BY run_id""")
def _(t):
    j = t.tasks.select("run_id", "task_id").join(t.operations.select("task_id", "op_no", "tokens"), "task_id", "left")
    return j.groupBy("run_id").agg(
        (F.countDistinct("task_id") > 12).alias("tasks_over"),
        (F.coalesce(F.max("op_no"), F.lit(0)) > 8).alias("operations_over"),
        (F.coalesce(F.sum("tokens"), F.lit(0)) > 2000).alias("tokens_over"),
    )


@query("pol_03_hitl_approval", GRAPH + """SELECT s.run_id, s.task_id FROM tasks s WHERE s.role = 'subagent' AND NOT EXISTS
(SELECT 1 FROM tasks h WHERE h.run_id = s.run_id AND h.role = 'hitl' AND h.status = 'completed' AND h.seq < s.seq)""")
def _(t):
    """Gated tasks without an earlier completed approval in the run."""
    before = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    approved = F.coalesce(F.bool_or((F.col("role") == "hitl") & (F.col("status") == "completed")).over(before), F.lit(False))
    return t.tasks.withColumn("ok", approved).where("role = 'subagent' and not ok").select("run_id", "task_id")


@query("jn_16_later_tasks", GRAPH + "SELECT task_id, count(*) OVER (PARTITION BY run_id ORDER BY seq DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM tasks")
def _(t):
    later = Window.partitionBy("run_id").orderBy("seq").rangeBetween(1, Window.unboundedFollowing)
    return t.tasks.select("task_id", F.count("*").over(later).alias("later"))


@query("jn_23_decision_reuse", EVENTS + """, x AS (SELECT *, first_value(CASE WHEN kind = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY run_id, props ORDER BY ts, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reused FROM events_) SELECT run_id, event_id, reused FROM x WHERE kind = 'signup'""")
def _(t):
    """For a request, the run's first earlier decision on the same prompt."""
    before = Window.partitionBy("run_id", "props").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    reused = F.first(F.when(F.col("kind") == "purchase", F.col("event_id")), ignorenulls=True).over(before)
    return t.events.withColumn("reused", reused).where("kind = 'signup'").select("run_id", "event_id", "reused")


@query("snk_02_partial_update", EVENTS + """SELECT run_id, arg_max(props, (ts, event_id)) FILTER (kind = 'view') AS last_view, arg_max(tokens, (ts, event_id)) FILTER (kind = 'purchase') AS last_tokens
FROM events_ GROUP BY run_id""")
def _(t):
    """Patches fold to the latest state: each sets only the fields it has."""
    at = F.struct("ts", "event_id")
    latest = lambda c, k: F.max_by(F.when(F.col("kind") == k, F.col(c)), F.when(F.col("kind") == k, at))
    return t.events.groupBy("run_id").agg(latest("props", "view").alias("last_view"), latest("tokens", "purchase").alias("last_tokens"))


_WORTH = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in rk.TYPE_WORTH.items())
_SCORED = "recency * {recency}::DOUBLE + downstream * {downstream}::DOUBLE + artifact_type * {artifact_type}::DOUBLE + retry * {retry}::DOUBLE + skill_type * {skill_type}::DOUBLE"
_DIMS = GRAPH + f""", ct AS (SELECT run_id, task_id, seq, role FROM tasks WHERE status = 'completed' AND role <> 'root'),
c0 AS (SELECT *, max(seq) OVER (PARTITION BY run_id) AS top, count(*) OVER (PARTITION BY run_id ORDER BY seq RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM ct),
oc AS (SELECT task_id, count(*) AS ops, bool_or(type = 'hitl_response') AS human, min(op_no) FILTER (status = 'succeeded') AS first_no FROM operations GROUP BY task_id),
mk AS (SELECT run_id, artifact_id, arg_max(task_id, (seq, op_id)) AS producer FROM produces JOIN tasks USING (task_id) GROUP BY ALL),
uc AS (SELECT producer AS task_id, count(DISTINCT c.task_id) AS users FROM consumes c JOIN tasks t ON t.task_id = c.task_id JOIN mk ON mk.run_id = t.run_id AND mk.artifact_id = c.artifact_id GROUP BY producer),
wc AS (SELECT o.task_id, max(CASE a.type {_WORTH} END) AS worth FROM operations o JOIN oc ON oc.task_id = o.task_id AND oc.first_no = o.op_no JOIN artifacts a ON a.artifact_id = o.artifact_id WHERE o.flow = 'O' GROUP BY o.task_id),
dims AS (SELECT run_id, task_id, seq, role, coalesce(human, false) AS hitl, CASE WHEN top > 0 THEN seq / top ELSE 1.0::DOUBLE END AS recency,
  CASE WHEN later = 0 THEN 1.0::DOUBLE ELSE least(coalesce(users, 0), 1) * 0.5::DOUBLE + coalesce(users, 0) / later * 0.5::DOUBLE END AS downstream,
  coalesce(worth, 0.0::DOUBLE) AS artifact_type, least(coalesce(ops, 0) / 3, 1.0::DOUBLE) AS retry,
  CASE WHEN human THEN 1.0::DOUBLE WHEN role = 'subagent' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS skill_type
  FROM c0 LEFT JOIN oc USING (task_id) LEFT JOIN uc USING (task_id) LEFT JOIN wc USING (task_id)),
scored AS (SELECT *, {_SCORED.format(**rk.WEIGHTS)} AS score FROM dims)
"""
_MILLIONTHS = "CAST(floor({} * 1000000 + 0.5) AS BIGINT)"


def _dims(t):
    """Operations are numbered by a sort over all lines; what is used here and beside it reads them from a table."""
    if "stored" not in vars(t):
        t.operations = t.stored = t.write(t.operations)
    return rk.dimensions(t.tasks.withColumn("described", F.col("role") == "subagent"), t.operations, t.produces, t.artifacts, t.consumes)


def _millionths(x):
    return F.floor(x * 1_000_000 + 0.5).cast("long")


@query("win_03_recency", _DIMS + "SELECT task_id, recency FROM dims")
def _(t):
    return _dims(t).select("task_id", "recency")


@query("win_04_downstream", _DIMS + "SELECT task_id, downstream FROM dims")
def _(t):
    return _dims(t).select("task_id", "downstream")


@query("agg_39_best_artifact_type", _DIMS + "SELECT task_id, artifact_type FROM dims")
def _(t):
    return _dims(t).select("task_id", "artifact_type")


@query("agg_40_retry_signal", _DIMS + "SELECT task_id, retry FROM dims")
def _(t):
    return _dims(t).select("task_id", "retry")


@query("fn_22_type_scores", _DIMS + "SELECT task_id, artifact_type, skill_type FROM dims")
def _(t):
    return _dims(t).select("task_id", "artifact_type", "skill_type")


@query("ctx_01_score", _DIMS + f"SELECT run_id, task_id, {_MILLIONTHS.format('score')} AS score FROM scored")
def _(t):
    return rk.score(_dims(t)).select("run_id", "task_id", _millionths(F.col("score")).alias("score"))


#: Definitions' own weights; what one leaves open takes the default.
_OVERRIDES = [(0, 1.0, 0.0, 0.0, 0.0, 0.0), (1, 0.6, None, None, None, None), (2, None, 0.5, None, 0.0, None)]
_OWN = " + ".join(f"{k} * coalesce(w_{k}, {v}::DOUBLE)" for k, v in rk.WEIGHTS.items())
_OVERRIDE_SQL = ", ".join("(" + ", ".join("NULL::DOUBLE" if x is None else f"{x}::DOUBLE" if k else str(x) for k, x in enumerate(row)) + ")" for row in _OVERRIDES)


@query("ctx_02_weight_override", _DIMS + f""", own(definition_id, {', '.join(f'w_{k}' for k in rk.WEIGHTS)}) AS (VALUES {_OVERRIDE_SQL})
SELECT task_id, {_MILLIONTHS.format(f'({_OWN})')} AS score FROM dims JOIN runs USING (run_id) LEFT JOIN own USING (definition_id)""")
def _(t):
    """Weights of the run's definition, field by field, where it has any."""
    own = t.spark.createDataFrame(_OVERRIDES, "definition_id long, " + ", ".join(f"w_{k} double" for k in rk.WEIGHTS))
    j = _dims(t).join(t.runs.select("run_id", "definition_id"), "run_id").join(F.broadcast(own), "definition_id", "left")
    total = None
    for k, v in rk.WEIGHTS.items():
        part = F.col(k) * F.coalesce(f"w_{k}", F.lit(v))
        total = part if total is None else total + part
    return j.select("task_id", _millionths(total).alias("score"))


@query("ctx_03_protected", _DIMS + "SELECT run_id, task_id FROM scored WHERE hitl OR score >= 0.7::DOUBLE")
def _(t):
    return rk.protected(rk.score(_dims(t))).select("run_id", "task_id")


@query("top_06_rank_by_score", _DIMS + "SELECT run_id, task_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY score DESC, seq, task_id) AS INTEGER) AS rank FROM scored")
def _(t):
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "seq", "task_id"))
    return rk.score(_dims(t)).select("run_id", "task_id", rank.alias("rank"))


#: Tokens of a run's context. A task's tokens are those of its first succeeded operation, whose output is shown.
_BUDGET = 60
_TOKENS = """, x AS (SELECT s.*, CAST(coalesce(o.tokens, 0) AS BIGINT) AS tokens FROM scored s LEFT JOIN oc ON oc.task_id = s.task_id LEFT JOIN operations o ON o.task_id = s.task_id AND o.op_no = oc.first_no)
"""
_TIERS = "WITH RECURSIVE " + _DIMS[5:] + _TOKENS + f""", h AS (SELECT run_id, task_id, tokens, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, seq) AS k FROM x WHERE NOT hitl AND score >= 0.7::DOUBLE),
f AS (SELECT run_id, CAST(0 AS BIGINT) AS k, CAST(coalesce(sum(tokens) FILTER (hitl), 0) AS BIGINT) AS used, CAST(NULL AS BIGINT) AS task_id, false AS fits FROM x GROUP BY run_id
UNION ALL SELECT f.run_id, h.k, CASE WHEN f.used + h.tokens <= {_BUDGET} * 0.6::DOUBLE THEN f.used + h.tokens ELSE f.used END, h.task_id, f.used + h.tokens <= {_BUDGET} * 0.6::DOUBLE FROM f JOIN h ON h.run_id = f.run_id AND h.k = f.k + 1),
tiers AS (SELECT x.*, CASE WHEN hitl OR coalesce(fits, false) THEN 'full' WHEN score >= 0.3::DOUBLE THEN 'summary' ELSE 'metadata' END AS tier FROM x LEFT JOIN f ON f.task_id = x.task_id)
"""


def _with_tokens(t):
    ok = t.operations.where("status = 'succeeded'").groupBy("task_id").agg(F.min_by("tokens", "op_no").alias("tokens"))
    return rk.score(_dims(t)).join(ok, "task_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))


def _tiers(t):
    return rk.assign_tiers(_with_tokens(t), F.lit(_BUDGET))


@query("win_11_greedy_tiers", _TIERS + "SELECT run_id, task_id, tier FROM tiers")
def _(t):
    return _tiers(t).select("run_id", "task_id", "tier")


@query("ctx_04_tier_counts", _TIERS + "SELECT run_id, count(*) FILTER (tier = 'full') AS full_rows, count(*) FILTER (tier = 'summary') AS summary_rows, count(*) FILTER (tier = 'metadata') AS metadata_rows FROM tiers GROUP BY run_id")
def _(t):
    n = lambda x: F.count_if(F.col("tier") == x).alias(f"{x}_rows")
    return _tiers(t).groupBy("run_id").agg(n("full"), n("summary"), n("metadata"))


@query("ctx_05_compress_needed", _TIERS + f"SELECT run_id, CAST(coalesce(sum(tokens) FILTER (tier = 'summary'), 0) AS BIGINT) AS tokens, coalesce(sum(tokens) FILTER (tier = 'summary'), 0) > {_BUDGET} * 0.25::DOUBLE AS compress FROM tiers GROUP BY run_id")
def _(t):
    """A quarter of the budget is for summaries."""
    held = F.coalesce(F.sum(F.when(F.col("tier") == "summary", F.col("tokens"))), F.lit(0))
    return _tiers(t).groupBy("run_id").agg(held.alias("tokens"), (held > _BUDGET * 0.25).alias("compress"))


_FIRST_OK = " JOIN oc ON oc.task_id = tiers.task_id JOIN operations o ON o.task_id = tiers.task_id AND o.op_no = oc.first_no AND o.flow = 'O'"


@query("ctx_06_surfaced_artifacts", _TIERS + f"SELECT DISTINCT tiers.run_id, o.artifact_id FROM tiers{_FIRST_OK} WHERE tier <> 'metadata'")
def _(t):
    """Artifacts of the operation that is shown."""
    shown = t.operations.where("status = 'succeeded'").groupBy("task_id").agg(F.min_by(F.struct("artifact_id", "flow"), "op_no").alias("x")).where("x.flow = 'O'")
    return _tiers(t).where("tier <> 'metadata'").join(shown, "task_id").select("run_id", "x.artifact_id").distinct()


@query("ctx_07_context_index", _TIERS + "SELECT run_id, tier, list(task_id ORDER BY seq) AS tasks, count(*) AS n, CAST(sum(count(*)) FILTER (tier <> 'metadata') OVER (PARTITION BY run_id) AS BIGINT) AS in_detail FROM tiers GROUP BY run_id, tier")
def _(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "task_id"))), lambda x: x["task_id"])
    x = _tiers(t).groupBy("run_id", "tier").agg(ordered.alias("tasks"), F.count("*").alias("n"))
    detail = F.sum(F.when(F.col("tier") != "metadata", F.col("n"))).over(Window.partitionBy("run_id"))
    return x.withColumn("in_detail", detail)


_DEMOTE = ", e AS (SELECT *, {excess} AS excess, coalesce(sum(CASE WHEN tier = 'full' AND NOT hitl THEN tokens ELSE 0 END) OVER (PARTITION BY run_id ORDER BY score, seq DESC, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM {rows})\n"


@query("win_12_demotion", _DIMS + _TOKENS + ", k AS (SELECT *, CASE WHEN hitl OR score >= 0.7::DOUBLE THEN 'full' WHEN score >= 0.3::DOUBLE THEN 'summary' ELSE 'metadata' END AS tier FROM x)"
       + _DEMOTE.format(excess=f"coalesce(sum(tokens) FILTER (tier = 'full') OVER (PARTITION BY run_id), 0) - {_BUDGET} * 0.6::DOUBLE", rows="k")
       + "SELECT run_id, task_id, tier = 'full' AND NOT hitl AND freed < excess AS demoted FROM e")
def _(t):
    """Of all that scores as full, the lowest go until the rest is within the full tier's share."""
    rows = _with_tokens(t)
    was = F.when(F.col("hitl") | (F.col("score") >= rk.FULL_SCORE), "full").when(F.col("score") >= rk.SUMMARY_SCORE, "summary").otherwise("metadata")
    rows = rows.withColumn("tier", was).withColumn("was", was)
    held = F.sum(F.when(F.col("tier") == "full", F.col("tokens")).otherwise(0)).over(Window.partitionBy("run_id"))
    down = rk.demote(rows, held - _BUDGET * rk.FULL_SHARE)
    return down.select("run_id", "task_id", (F.col("tier") != F.col("was")).alias("demoted"))


@query("ctx_08_over_budget", _TIERS + _DEMOTE.format(excess=f"sum(tokens) OVER (PARTITION BY run_id) - {_BUDGET}", rows="tiers")
       + f"SELECT run_id, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) > {_BUDGET} * 0.8::DOUBLE AS check_exactly, sum(tokens) > {_BUDGET} AS over, count(*) FILTER (tier = 'full' AND NOT hitl AND freed < excess) AS demoted FROM e GROUP BY run_id")
def _(t):
    """From four fifths of the budget on the tokens are counted exactly, here as given; above it full rows are demoted."""
    rows = _tiers(t).withColumn("was", F.col("tier"))
    down = rk.demote(rows, F.sum("tokens").over(Window.partitionBy("run_id")) - _BUDGET)
    s = F.sum("tokens")
    return down.groupBy("run_id").agg(
        s.alias("tokens"), (s > _BUDGET * 0.8).alias("check_exactly"), (s > _BUDGET).alias("over"), F.count_if(F.col("tier") != F.col("was")).alias("demoted")
    )


@query("ctx_09_compaction_input", GRAPH + """SELECT run_id, string_agg(substr(content, 1, 1000), ';' ORDER BY seq, op_no) AS input FROM tasks JOIN operations o USING (task_id) JOIN artifacts a USING (artifact_id)
WHERE o.flow = 'O' AND o.status = 'succeeded' GROUP BY run_id""")
def _(t):
    done = t.operations.where("flow = 'O' and status = 'succeeded'").select("task_id", "op_no", "artifact_id")
    j = t.tasks.select("run_id", "task_id", "seq").join(done, "task_id").join(t.artifacts.select("artifact_id", F.substring("content", 1, 1000).alias("c")), "artifact_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "op_no", "c"))), lambda x: x["c"])
    return j.groupBy("run_id").agg(F.array_join(parts, ";").alias("input"))


_CONFIGS = ", ".join("('" + k + "', " + ", ".join(f"{x}::DOUBLE" for x in w.values()) + ")" for k, w in rk.SWEEP.items())
_SWEEP = _DIMS + f""", cfg(config, {', '.join(f'w_{k}' for k in rk.WEIGHTS)}) AS (VALUES {_CONFIGS}),
sw AS (SELECT config, run_id, task_id, {_MILLIONTHS.format('(' + ' + '.join(f'{k} * w_{k}' for k in rk.WEIGHTS) + ')')} AS score FROM dims, cfg)
"""


def _sweep(t):
    """Every completed task under every configuration of weights: a row's list of scores, laid out."""
    laid = F.array(*[F.struct(F.lit(k).alias("config"), _millionths(rk.weighted(w)).alias("score")) for k, w in rk.SWEEP.items()])
    return _dims(t).select("run_id", "task_id", F.inline(laid))


@query("jn_20_sweep_grid", _SWEEP + "SELECT config, task_id, score FROM sw")
def _(t):
    return _sweep(t).select("config", "task_id", "score")


_PER_RUN = _SWEEP + """, rn AS (SELECT run_id, count(*) FILTER (status <> 'completed') = 0 AS done, CAST(coalesce(sum(k), 0) AS BIGINT) AS tokens, coalesce(date_diff('day', min(a), max(z)), 0) AS latency FROM tasks
  LEFT JOIN (SELECT task_id, sum(tokens) AS k, min(o.at) AS a, max(o.at) AS z FROM operations o GROUP BY task_id) USING (task_id) GROUP BY run_id),
pr AS (SELECT config, run_id, CAST(floor(sum(score) / count(*)) AS BIGINT) AS q FROM sw GROUP BY config, run_id),
sm AS (SELECT config, count(*) AS n, sum(q) AS sq, avg(q) AS mean, stddev_samp(q) AS sd, avg(CASE WHEN done THEN 1 ELSE 0 END) AS completed, avg(tokens) AS tokens, avg(latency) AS latency FROM pr JOIN rn USING (run_id) GROUP BY config)
"""


def _per_run(t):
    """Quality of each run under each configuration, with what the run did."""
    used = t.operations.groupBy("task_id").agg(F.sum("tokens").alias("k"), F.min("at").alias("a"), F.max("at").alias("z"))
    runs = t.tasks.select("run_id", "task_id", "status").join(used, "task_id", "left").groupBy("run_id")
    runs = runs.agg((F.count_if(F.col("status") != "completed") == 0).alias("done"), F.coalesce(F.sum("k"), F.lit(0)).alias("tokens"), F.coalesce(F.datediff(F.max("z"), F.min("a")), F.lit(0)).alias("latency"))
    q = _sweep(t).groupBy("config", "run_id").agg(F.floor(F.sum("score") / F.count("*")).alias("q"))
    return q.join(runs, "run_id")


_T = ", ".join(str(x) for x in st.T_95)
_SWEPT = _PER_RUN + f""", sv AS (SELECT *, coalesce(CASE WHEN n > 1 THEN (CASE WHEN n <= 30 THEN [{_T}][n - 1]::DOUBLE ELSE 1.96::DOUBLE END) * sd / sqrt(n) END, 0) AS half FROM sm)
"""


def sweep_summary(t):
    """Quality, its interval, completion, tokens and latency of the runs under each configuration."""
    q = F.col("q")
    return _per_run(t).groupBy("config").agg(
        F.count("*").alias("n"), st.mean(q).alias("mean"), st.sd(q).alias("sd"), *st.interval(q), F.avg(F.col("done").cast("int")).alias("completed"), F.avg("tokens").alias("tokens"),
        F.avg("latency").alias("latency"),
    )


@query("agg_24_sweep_summary", _SWEPT + "SELECT config, n, round(mean, 2) AS mean, round(coalesce(sd, 0), 2) AS sd, round(mean - half, 2) AS lower, round(mean + half, 2) AS upper, round(completed, 4) AS completed, round(tokens, 2) AS tokens, round(latency, 2) AS latency FROM sv")
def _(t):
    digits = {"mean": 2, "sd": 2, "lower": 2, "upper": 2, "completed": 4, "tokens": 2, "latency": 2}
    return sweep_summary(t).select("config", "n", *[F.round(k, n).alias(k) for k, n in digits.items()])


@query("agg_25_score_matrix", _SWEEP + "SELECT task_id, " + ", ".join(f"max(score) FILTER (config = '{k}') AS \"{k}\"" for k in rk.SWEEP) + " FROM sw GROUP BY task_id")
def _(t):
    return _sweep(t).groupBy("task_id").pivot("config", list(rk.SWEEP)).agg(F.max("score"))


@query("agg_27_best_vs_default", _PER_RUN + "SELECT arg_max(config, (sq, config)) AS best, CAST(max(sq) - max(sq) FILTER (config = 'defaults') AS BIGINT) AS delta FROM sm")
def _(t):
    m = _per_run(t).groupBy("config").agg(F.sum("q").alias("s"))
    best = F.max_by("config", F.struct("s", "config"))
    return m.agg(best.alias("best"), (F.max("s") - F.max(F.when(F.col("config") == "defaults", F.col("s")))).alias("delta"))


@query("top_07_rank_configs", _PER_RUN + "SELECT config, CAST(row_number() OVER (ORDER BY sq DESC, config) AS INTEGER) AS rank FROM sm")
def _(t):
    """As all configurations score the same runs, the order of sums is that of means. Configurations are few."""
    m = _per_run(t).groupBy("config").agg(F.sum("q").alias("s"))
    return m.select("config", F.row_number().over(Window.orderBy(F.desc("s"), "config")).alias("rank"))
