"""Look-ups of a run as table functions of SQL.

``artifacts_for_run(run)``, ``provenance(run)`` and ``lineage(run)`` can stand in a FROM clause, or behind LATERAL with a
column of the table before: then they are a join on the run, and all runs are looked up at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import graph as g

#: Name, columns and body of each; they read the views that ``register`` makes.
FUNCTIONS = {
    "artifacts_for_run": ("artifact_id BIGINT, name STRING, type STRING, task_id BIGINT, seq INT", "SELECT artifact_id, name, type, task_id, seq FROM trace_artifacts a WHERE a.run_id = run"),
    "provenance": (
        "artifact_id BIGINT, op_id BIGINT, task_id BIGINT, seq INT, definition_id BIGINT, consumed_by ARRAY<BIGINT>",
        "SELECT artifact_id, op_id, task_id, seq, definition_id, consumed_by FROM trace_provenance p WHERE p.run_id = run",
    ),
    "lineage": (
        "task_id BIGINT, seq INT, role STRING, status STRING, op_id BIGINT, op_no INT, op_status STRING, artifact_id BIGINT",
        "SELECT task_id, seq, role, status, op_id, op_no, op_status, artifact_id FROM trace_lineage l WHERE l.run_id = run",
    ),
}


def register(spark: SparkSession, runs: DataFrame, tasks: DataFrame, operations: DataFrame, produces: DataFrame, consumes: DataFrame, artifacts: DataFrame) -> None:
    """Make the three functions of the session, over views of these tables. A task without operations and an operation
    without artifacts have a row in the lineage, an artifact that no run made has no provenance by run."""
    runs.createOrReplaceTempView("trace_runs")
    g.artifacts_of_runs(tasks, produces, artifacts, "name", "type").createOrReplaceTempView("trace_artifacts")
    g.provenance(artifacts, produces, tasks, runs, consumes).createOrReplaceTempView("trace_provenance")
    ops = operations.select("task_id", "op_id", "op_no", operations["status"].alias("op_status")).join(produces.select("op_id", "artifact_id"), "op_id", "left")
    tasks.select("run_id", "task_id", "seq", "role", "status").join(ops, "task_id", "left").createOrReplaceTempView("trace_lineage")
    for name, (columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(run BIGINT) RETURNS TABLE ({columns}) RETURN {body}")
