"""Trace tables over the driver's star schema, as DataFrames and as the same views in DuckDB SQL.

Graph: a customer is a run, an order a task, a line item an operation, a part an artifact, a supplier
a skill and a nation a definition. Results: an order is a case, its year the run, the mean discount
and tax of its lines the scores of two arms. Events, conversations, documents and pages stand for
operation logs, messages, outputs and fetched pages.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import grading as gr
from ..operators.tables import write_table

LINE = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus",
]

ARTIFACT_TYPES = ("text", "json", "file_reference", "input_document", "hitl_decision", "skill_prompt", "skill_asset")

# Categories of cases and their default labels: purpose, realism, release gate, comparison mode. An
# order's month stands for its category.
DEFAULTS = [
    ("synthesis", "forecast", "prod-shaped", "blocker", "direct-api"),
    ("extraction", "forecast", "prod-shaped", "blocker", "direct-api"),
    ("gap-analysis", "forecast", "prod-shaped", "blocker", "direct-api"),
    ("decision-support", "forecast", "prod-shaped", "blocker", "direct-api"),
    ("dispatch", "mechanism", "synthetic", "research", "direct-api"),
    ("hitl", "mechanism", "synthetic", "research", "direct-api"),
    ("limits", "mechanism", "synthetic", "research", "direct-api"),
    ("context", "mechanism", "synthetic", "research", "direct-api"),
    ("coordination", "mechanism", "synthetic", "research", "direct-api"),
    ("steering", "mechanism", "synthetic", "research", "direct-api"),
    ("decomposition-value", "mechanism", "synthetic", "research", "flat-harness"),
    ("reliability", "mechanism", "synthetic", "research", "none"),
]
CATEGORIES = [x[0] for x in DEFAULTS]


def shared_folder(t: Tables) -> str:
    """A new folder below the one that executors share."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base and not t.spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/trace-{uuid.uuid4().hex}"


class Tables:
    """The trace tables of one folder, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def write(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` as a table in the shared folder: made once, used often, and there still when an executor is lost."""
        return write_table(df, shared_folder(self), by)

    @cached_property
    def definitions(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("definition_id"), F.col("n_name").alias("name"))

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("run_id"), F.col("c_nationkey").cast("long").alias("definition_id"), F.col("c_name").alias("name")
        )

    @cached_property
    def tasks(self) -> DataFrame:
        order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        t = self.table("orders").withColumn("seq", F.row_number().over(order) - 1)
        role = (
            F.when(F.col("seq") == 0, "root")
            .when(F.col("o_orderpriority") == "1-URGENT", "hitl")
            .when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "subagent")
            .otherwise("tool")
        )
        status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
        return t.select(
            F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("task_id"), "seq", role.alias("role"),
            F.col("o_orderpriority").alias("name"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def operations(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy(*LINE)
        o = self.table("lineitem").withColumn("op_no", F.row_number().over(order))
        status = F.when(F.col("l_returnflag") == "N", "succeeded").when(F.col("l_returnflag") == "R", "failed").otherwise("abandoned")
        kind = F.when(F.col("l_linenumber") == 7, "hitl_response").when(F.col("l_linenumber") % 3 == 0, "llm_call").otherwise("tool_call")
        return o.select(
            F.col("l_orderkey").alias("task_id"), (F.col("l_orderkey") * 1000 + F.col("op_no")).alias("op_id"), "op_no", kind.alias("type"),
            status.alias("status"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_partkey").alias("artifact_id"),
            F.col("l_suppkey").alias("skill_id"), F.col("l_linestatus").alias("flow"), F.col("l_shipdate").alias("at"),
        )

    @cached_property
    def produces(self) -> DataFrame:
        return self.operations.where("flow = 'O'").select("op_id", "task_id", "artifact_id")

    @cached_property
    def consumes(self) -> DataFrame:
        return self.operations.where("flow = 'F'").select("task_id", "artifact_id").distinct()

    @cached_property
    def artifacts(self) -> DataFrame:
        content = F.concat_ws("|", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
        kind = F.array(*[F.lit(x) for x in ARTIFACT_TYPES])
        return self.table("part").select(
            F.col("p_partkey").alias("artifact_id"), F.col("p_name").alias("name"), content.alias("content"),
            F.sha2(content, 256).alias("content_hash"), F.get(kind, (F.col("p_partkey") % 7).cast("int")).alias("type"),
        )

    @cached_property
    def skills(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("skill_id"), F.col("s_name").alias("name"))

    @cached_property
    def defaults(self) -> DataFrame:
        return self.spark.createDataFrame(DEFAULTS, "category string, purpose string, realism string, gate string, mode string")

    @cached_property
    def results(self) -> DataFrame:
        """One row per case and run: scores of both arms, in integer hundredths so that sums are exact."""
        a, b = F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long")
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("case_id"), a.alias("a"), b.alias("b"))
        lines = lines.groupBy("case_id").agg(
            F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.count("*").alias("lines"),
            (F.max(F.signum(F.col("a") - F.col("b"))) - F.min(F.signum(F.col("a") - F.col("b"))) == 2).alias("inconclusive"),
        )
        cases = self.table("orders").select(
            F.col("o_orderkey").alias("case_id"), F.year("o_orderdate").alias("run"), F.get(F.array(*map(F.lit, CATEGORIES)), F.month("o_orderdate") - 1).alias("category"),
            F.col("o_orderstatus").alias("outcome"), F.col("o_orderpriority").alias("priority"),
        )
        score = lambda s: F.floor(F.col(s) * 10 / F.col("lines") + 0.5).cast("long")
        r = cases.join(lines, "case_id").join(F.broadcast(self.defaults.select("category", F.struct(*gr.LABELS).alias("default"))), "category")
        r = r.withColumn("labels", gr.resolve(self._own_labels(), F.col("default")))
        return r.select("case_id", "run", "category", *[F.col(f"labels.{x}") for x in gr.LABELS], "labels", "outcome", "inconclusive", "lines", score("sa").alias("a"), score("sb").alias("b"))

    @staticmethod
    def _own_labels() -> Column:
        """What a case says of itself: one of many lines is a stress, one of a single line compares harnesses, one of
        high priority blocks; an order in parts is parked."""
        none = F.lit(None).cast("string")
        return F.struct(
            F.when(F.col("lines") > 5, "stress").otherwise(none).alias("purpose"), none.alias("realism"), F.when(F.col("priority") == "2-HIGH", "blocker").otherwise(none).alias("gate"),
            F.when(F.col("lines") == 1, "flat-harness").otherwise(none).alias("mode"), F.when(F.col("outcome") == "P", True).alias("parked"),
        )

    @cached_property
    def graded(self) -> DataFrame:
        """Nested cases with what both arms gave. A line is a fact, weighed by its quantity, that should be absent if
        its tax is the highest; its discount tells whether the harness found it, its tax whether the baseline did. It is a step
        too: its flag the severity, its kind the aspect."""
        x = self.operations.select("task_id", "op_no", "op_id", "type", "status", "tokens")
        order = Window.partitionBy("l_orderkey").orderBy(*LINE)
        cents = self.table("lineitem").withColumn("op_no", F.row_number().over(order)).select(
            F.col("l_orderkey").alias("task_id"), "op_no", F.round(F.col("l_discount") * 100).cast("int").alias("d"), F.round(F.col("l_tax") * 100).cast("int").alias("x")
        )
        fact = F.concat(F.lit("f"), F.col("op_no").cast("string"))
        aspect = F.when(F.col("type") == "llm_call", "skill_decomposition").when(F.col("type") == "hitl_response", "retry").otherwise("graph_assertion")
        severity = F.when(F.col("status") == "failed", "fail").when(F.col("status") == "abandoned", "warn").otherwise("pass")
        lines = x.join(cents, ["task_id", "op_no"]).select(
            F.col("task_id").alias("case_id"), "op_no", fact.alias("fact_id"), F.when(F.col("x") == 8, "absent").alias("expected"), F.col("tokens").cast("double").alias("weight"),
            (F.col("d") >= 3).alias("ha"), (F.col("x") >= 3).alias("ba"), aspect.alias("aspect"), severity.alias("severity"),
        )
        every = lines.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("op_no", "fact_id", "expected", "weight", "ha", "ba", "aspect", "severity"))).alias("l"))
        of = lambda keep, f: F.transform(F.filter("l", keep), f)
        any_ = lambda l: F.lit(True)  # noqa: E731, E741
        has = F.exists("l", lambda l: l["aspect"] == "skill_decomposition")  # noqa: E741
        r = self.results.join(every, "case_id")
        none = F.lit(None)
        criteria = F.struct(
            F.when(F.col("purpose") != "mechanism", F.lit(0.5)).alias("min_factual"),
            of(lambda l: (l["op_no"] <= 2) & l["expected"].isNull(), lambda l: l["fact_id"]).alias("required_fact_ids"),  # noqa: E741
            F.when(F.col("gate") == "blocker", F.lit(0.4)).alias("min_judge"),
            F.when(F.col("category") == "limits", True).alias("zero_failing"),
        )
        case = F.struct(
            "category", of(any_, lambda l: F.struct(l["fact_id"].alias("fact_id"), l["expected"].alias("expected"), l["weight"].alias("weight"))).alias("facts"), criteria.alias("criteria"),
            F.when(has & (F.col("lines") > 3), F.array(F.lit("research"))).alias("required_skills"), none.cast("array<string>").alias("forbidden_skills"),
            F.when(F.col("purpose") == "mechanism", F.lit(1)).alias("assertions"),
        )
        judge = lambda c: F.when(~F.col("inconclusive"), F.col(c) / 100)
        return r.select(
            "case_id", case.alias("case"), of(lambda l: l["ha"], lambda l: l["fact_id"]).alias("harness_matched"),  # noqa: E741
            F.when(F.col("lines") > 1, of(lambda l: l["ba"], lambda l: l["fact_id"])).alias("baseline_matched"), judge("a").alias("harness_judge"), judge("b").alias("baseline_judge"),  # noqa: E741
            of(any_, lambda l: F.struct(l["aspect"].alias("aspect"), l["severity"].alias("severity"))).alias("grades"),
        )

    @cached_property
    def judged(self) -> DataFrame:
        """Composites of both arms in each of two orderings: a case's odd and even lines."""
        x = self.table("lineitem").select(
            F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") % 2).alias("o"),
            F.round(F.col("l_discount") * 100).cast("long").alias("a"), F.round(F.col("l_tax") * 100).cast("long").alias("b"),
        )
        of = lambda c, o: F.floor(F.sum(F.when(F.col("o") == o, F.col(c))) * 10 / F.count_if(F.col("o") == o) + 0.5).cast("long")
        x = x.groupBy("case_id").agg(of("a", 1).alias("a1"), of("b", 1).alias("b1"), of("a", 0).alias("a2"), of("b", 0).alias("b2"))
        return x.where("a1 is not null and a2 is not null")

    @cached_property
    def calls(self) -> DataFrame:
        """Which task a call id stands for."""
        return self.tasks.select(F.concat_ws("-", F.col("run_id").cast("string"), F.col("seq").cast("string")).alias("call_id"), "task_id")

    @cached_property
    def blocks(self) -> DataFrame:
        """Messages of the user with content blocks, a text and a tool result with the id of its call; those of others have
        plain content besides."""
        call = F.concat_ws("-", F.col("run_id").cast("string"), F.col("turn").cast("string"))
        none = F.lit(None).cast("string")
        block = lambda kind, text, content, ident: F.struct(F.lit(kind).alias("type"), text.alias("text"), content.alias("content"), ident.alias("tool_use_id"))
        blocks = F.array(block("text", F.col("text"), none, none), block("tool_result", none, F.concat(F.lit("result of "), call), call))
        return self.messages.withColumn("blocks", blocks).withColumn("content", F.when(F.col("role") != "user", F.col("text")))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("run_id"), "event_id", "ts", F.col("event_type").alias("kind"),
            F.floor(F.col("value") * 100).cast("long").alias("tokens"), "props",
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("run_id"), "turn", "role", "text")


GRAPH = f"""WITH definitions AS (SELECT CAST(n_nationkey AS BIGINT) AS definition_id, n_name AS name FROM nation),
runs AS (SELECT c_custkey AS run_id, CAST(c_nationkey AS BIGINT) AS definition_id, c_name AS name FROM customer),
t0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS seq FROM orders),
tasks AS (SELECT o_custkey AS run_id, o_orderkey AS task_id, seq, CASE WHEN seq = 0 THEN 'root' WHEN o_orderpriority = '1-URGENT' THEN 'hitl'
  WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'subagent' ELSE 'tool' END AS role, o_orderpriority AS name,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS created_at FROM t0),
l0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
  l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS INTEGER) AS op_no FROM lineitem),
operations AS (SELECT l_orderkey AS task_id, l_orderkey * 1000 + op_no AS op_id, op_no,
  CASE WHEN l_linenumber = 7 THEN 'hitl_response' WHEN l_linenumber % 3 = 0 THEN 'llm_call' ELSE 'tool_call' END AS type,
  CASE l_returnflag WHEN 'N' THEN 'succeeded' WHEN 'R' THEN 'failed' ELSE 'abandoned' END AS status,
  CAST(l_quantity AS BIGINT) AS tokens, l_partkey AS artifact_id, l_suppkey AS skill_id, l_linestatus AS flow, l_shipdate AS at FROM l0),
produces AS (SELECT op_id, task_id, artifact_id FROM operations WHERE flow = 'O'),
consumes AS (SELECT DISTINCT task_id, artifact_id FROM operations WHERE flow = 'F'),
artifacts AS (SELECT p_partkey AS artifact_id, p_name AS name, concat_ws('|', p_name, p_brand, p_type, p_size) AS content,
  sha256(concat_ws('|', p_name, p_brand, p_type, p_size)) AS content_hash, {list(ARTIFACT_TYPES)}[p_partkey % 7 + 1] AS type FROM part),
skills AS (SELECT s_suppkey AS skill_id, s_name AS name FROM supplier)
"""

_VALUES = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in DEFAULTS)
RESULTS = f"""WITH defaults(category, purpose, realism, gate, mode) AS (VALUES {_VALUES}),
ln AS (SELECT l_orderkey AS case_id, CAST(round(l_discount * 100) AS BIGINT) AS a, CAST(round(l_tax * 100) AS BIGINT) AS b FROM lineitem),
lines AS (SELECT case_id, sum(a) AS sa, sum(b) AS sb, count(*) AS lines, max(sign(a - b)) - min(sign(a - b)) = 2 AS inconclusive FROM ln GROUP BY case_id),
cases AS (SELECT *, {CATEGORIES}[month(o_orderdate)] AS category FROM orders JOIN lines ON case_id = o_orderkey),
results AS (SELECT case_id, CAST(year(o_orderdate) AS INTEGER) AS run, category, CASE WHEN lines > 5 THEN 'stress' ELSE purpose END AS purpose, realism,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'blocker' ELSE gate END AS gate, CASE WHEN lines = 1 THEN 'flat-harness' ELSE mode END AS mode, o_orderstatus = 'P' AS parked, o_orderstatus AS outcome,
  inconclusive, lines, CAST(floor(sa * 10 / lines + 0.5) AS BIGINT) AS a, CAST(floor(sb * 10 / lines + 0.5) AS BIGINT) AS b FROM cases JOIN defaults USING (category))
"""

#: Facts, steps and criteria of cases, one row for each.
GRADED = RESULTS + """, gl AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
  l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS k, CAST(l_quantity AS BIGINT) AS weight, round(l_discount * 100) >= 3 AS ha, round(l_tax * 100) >= 3 AS ba, round(l_tax * 100) = 8 AS absent,
  CASE WHEN l_linenumber = 7 THEN 'retry' WHEN l_linenumber % 3 = 0 THEN 'skill_decomposition' ELSE 'graph_assertion' END AS aspect, l_returnflag = 'R' AS fails FROM lineitem),
gc AS (SELECT r.*, (SELECT bool_or(aspect = 'skill_decomposition') FROM gl WHERE gl.case_id = r.case_id) AND lines > 3 AS skills FROM results r),
bad AS (SELECT g.case_id, g.k, g.aspect FROM gl g JOIN gc c USING (case_id) WHERE g.fails AND (c.category = 'limits' OR g.aspect = 'graph_assertion' AND c.purpose = 'mechanism' OR g.aspect = 'skill_decomposition' AND c.skills)),
arms AS (SELECT case_id, k, 'harness' AS arm, ha AS hit, weight, absent FROM gl UNION ALL SELECT case_id, k, 'baseline', ba, weight, absent FROM gl),
found AS (SELECT case_id, arm, string_agg('f' || k, ', ' ORDER BY k) FILTER (k <= 2 AND NOT absent AND NOT hit) AS missing, string_agg('f' || k, ', ' ORDER BY k) FILTER (absent AND hit) AS forbidden,
  coalesce(CAST(sum(weight) FILTER (hit AND NOT absent) AS DOUBLE) / nullif(sum(weight) FILTER (NOT absent), 0), 0) AS score FROM arms GROUP BY case_id, arm),
asp AS (SELECT case_id, aspect, min(k) AS k, count(*) AS n FROM bad GROUP BY case_id, aspect),
steps AS (SELECT case_id, 'Process gate failed: ' || CAST(sum(n) AS BIGINT) || ' failing step grade(s) (' || string_agg(aspect, ', ' ORDER BY k) || ')' AS why FROM asp GROUP BY case_id),
of_both AS (SELECT c.*, f.arm, f.missing, f.forbidden, f.score, f.arm = 'harness' OR c.lines > 1 AS looked, CASE f.arm WHEN 'harness' THEN c.a ELSE c.b END / 100 AS judge, CASE f.arm WHEN 'harness' THEN why END AS gated FROM gc c JOIN found f USING (case_id) LEFT JOIN steps USING (case_id)),
said AS (SELECT case_id, arm, list_filter([
  CASE WHEN looked THEN 'Missing required facts: ' || missing END,
  CASE WHEN looked AND purpose <> 'mechanism' AND score < 0.5 THEN 'Factual score ' || format('{:.2f}', floor(score * 100 + 0.5) / 100) || ' below threshold 0.5' END,
  CASE WHEN gate = 'blocker' AND NOT inconclusive AND judge < 0.4 THEN 'Judge composite ' || format('{:.3f}', CAST(judge AS DOUBLE)) || ' below threshold 0.4' END,
  CASE WHEN looked THEN 'Forbidden facts matched: ' || forbidden END, gated], lambda x: x IS NOT NULL) AS reasons FROM of_both)
"""

EVENTS = """WITH events_ AS (SELECT user_id AS run_id, event_id, ts, event_type AS kind, CAST(floor(value * 100) AS BIGINT) AS tokens, props FROM events)
"""

MESSAGES = """WITH messages AS (SELECT conv_id AS run_id, turn, role, text FROM conversations)
"""

JUDGED = """WITH jl AS (SELECT l_orderkey AS case_id, l_linenumber % 2 AS o, CAST(round(l_discount * 100) AS BIGINT) AS a, CAST(round(l_tax * 100) AS BIGINT) AS b FROM lineitem),
judged AS (SELECT case_id, CAST(floor(sum(a) FILTER (o = 1) * 10 / count(*) FILTER (o = 1) + 0.5) AS BIGINT) AS a1, CAST(floor(sum(b) FILTER (o = 1) * 10 / count(*) FILTER (o = 1) + 0.5) AS BIGINT) AS b1,
  CAST(floor(sum(a) FILTER (o = 0) * 10 / count(*) FILTER (o = 0) + 0.5) AS BIGINT) AS a2, CAST(floor(sum(b) FILTER (o = 0) * 10 / count(*) FILTER (o = 0) + 0.5) AS BIGINT) AS b2
  FROM jl GROUP BY case_id HAVING count(*) FILTER (o = 1) > 0 AND count(*) FILTER (o = 0) > 0)
"""
