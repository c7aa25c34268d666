"""Assertions about runs: one row per run, ``run_id, passed``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task_label() -> Column:
    return F.when(F.col("role") == "root", "root").otherwise(F.coalesce("name", "role"))


def task_is(role: str | None = None, name: str | None = None, status: str | None = None) -> Column:
    given = {"role": role, "name": name, "status": status}
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in given.items() if v is not None], F.lit(True))


def in_range(n: Column, least: int | None, most: int | None) -> Column:
    """Open ends where no limit is given."""
    out = F.lit(True)
    if least is not None:
        out = out & (n >= least)
    if most is not None:
        out = out & (n <= most)
    return out


def task_count(tasks: DataFrame, match: Column, least: int | None = None, most: int | None = None) -> DataFrame:
    return tasks.groupBy("run_id").agg(in_range(F.count_if(match), least, most).alias("passed"))


def task_order(tasks: DataFrame, first: Column, then: Column) -> DataFrame:
    """The earliest of one kind strictly before the earliest of the other; false if either is missing."""
    at = lambda m: F.min(F.when(m, F.col("seq")))
    return tasks.groupBy("run_id").agg(F.coalesce(at(first) < at(then), F.lit(False)).alias("passed"))


def run_status(tasks: DataFrame, status: str, pattern: str | None = None) -> DataFrame:
    """The root has the status and, with ``pattern``, a name (the error text) that matches."""
    ok = task_is(role="root", status=status)
    if pattern is not None:
        ok = ok & F.col("name").rlike(pattern)
    return tasks.groupBy("run_id").agg(F.bool_or(ok).alias("passed"))


def artifact_content(tasks: DataFrame, produces: DataFrame, artifacts: DataFrame, match: Column, pattern: str) -> DataFrame:
    hit = artifacts.where(F.col("content").rlike(pattern)).select("artifact_id")
    by_task = produces.join(hit, "artifact_id", "left_semi").select("task_id").distinct().withColumn("hit", F.lit(True))
    j = tasks.select("run_id", "task_id", match.alias("m")).join(by_task, "task_id", "left")
    return j.groupBy("run_id").agg(F.coalesce(F.bool_or(F.col("m") & F.col("hit")), F.lit(False)).alias("passed"))


def consumes(tasks: DataFrame, links: DataFrame, consumer: Column, producer: Column, absent: bool = False) -> DataFrame:
    """A consumer uses an artifact of a producer; ``absent``: none does, also if there is neither."""
    c = tasks.where(consumer).select(F.col("task_id").alias("consumer"))
    p = tasks.where(producer).select(F.col("task_id").alias("producer"))
    runs = links.join(c, "consumer", "left_semi").join(p, "producer", "left_semi").select("run_id").distinct()
    j = tasks.select("run_id").distinct().join(runs.withColumn("has", F.lit(True)), "run_id", "left")
    has = F.coalesce("has", F.lit(False))
    return j.select("run_id", (~has if absent else has).alias("passed"))


def operation_count(tasks: DataFrame, operations: DataFrame, kind: str, least: int | None = None, most: int | None = None) -> DataFrame:
    j = tasks.select("run_id", "task_id").join(operations.select("task_id", "type"), "task_id", "left")
    return j.groupBy("run_id").agg(in_range(F.count_if(F.col("type") == kind), least, most).alias("passed"))


def skill_invoked(tasks: DataFrame, users: DataFrame, match: Column) -> DataFrame:
    """There is a matching task, and all of them are among ``users(task_id)``."""
    m = tasks.select("run_id", "task_id", match.alias("m")).join(users.withColumn("used", F.lit(True)), "task_id", "left")
    fits = F.bool_and(F.when(F.col("m"), F.coalesce("used", F.lit(False))))
    return m.groupBy("run_id").agg(F.coalesce(fits, F.lit(False)).alias("passed"))


#: A row of a specification: ``type`` and what that type reads. A matcher is ``role, name, status, op_type`` (the task
#: has an operation of it); the second one is the later task of an order, or the producer.
SPEC = (
    "idx int, type string, role string, name string, status string, op_type string, role2 string, name2 string, status2 string, op_type2 string, "
    "kind string, least int, most int, run_status string, pattern string, mode string, skill string, version string"
)


def evaluate(specs: DataFrame, tasks: DataFrame, operations: DataFrame, made: DataFrame, links: DataFrame, invoked: DataFrame, compactions: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, idx, type, passed``: every assertion of ``specs`` (``SPEC``) for every run.

    The rows of a specification, which people write, are compiled to aggregates: one over each task's operations,
    one over what it made, and one over each run's tasks give the answers of all of them together. ``made(task_id,
    content)`` are artifacts by the task that made them, ``links(run_id, consumer, producer)`` what was consumed,
    ``invoked(task_id, skill, version)`` the skills used, ``compactions(run_id)`` a row each, and ``runs(run_id, output,
    error)``. A run without tasks has an answer too: what must be there is not, what must be absent is.

    Without a matching task, existence, order, content, consumption and skills fail, absence holds, counts are 0.
    """
    rows = specs.collect()
    unknown = {r.type for r in rows} - set(_ANSWERS)
    if unknown:
        raise ValueError(f"no assertion type {', '.join(sorted(unknown))}; there are {', '.join(sorted(_ANSWERS))}")
    n = {r.idx for r in rows}
    if len(n) < len(rows):
        raise ValueError("assertions need numbers of their own")
    of = lambda *types: [r for r in rows if r.type in types]

    ops = operations.groupBy("task_id").agg(
        F.collect_set("type").alias("types"),
        *[(F.count("*") if r.kind is None else F.count_if(F.col("type") == r.kind)).alias(f"ops{r.idx}") for r in of("operation_count")],
    )
    j = tasks.join(ops, "task_id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    if of("artifact_content", "run_output_matches_artifact"):
        owned = made.join(tasks.select("task_id", "run_id"), "task_id").join(runs.select("run_id", "output"), "run_id", "left")
        hits = [F.bool_or(F.rlike("content", F.lit("(?iu)" + r.pattern))).alias(f"hit{r.idx}") for r in of("artifact_content")]
        same = [F.bool_or((F.col("output") == F.col("content")) if r.mode == "exact" else F.contains("output", "content")).alias(f"hit{r.idx}") for r in of("run_output_matches_artifact")]
        j = j.join(owned.groupBy("task_id").agg(*hits, *same), "task_id", "left")
    if of("skill_invoked"):
        is_ = lambda r: ((F.col("skill") == r.skill) if r.skill else F.lit(True)) & ((F.col("version") == r.version) if r.version else F.lit(True))
        j = j.join(invoked.groupBy("task_id").agg(*[F.bool_or(is_(r)).alias(f"used{r.idx}") for r in of("skill_invoked")]), "task_id", "left")

    def matches(r, second: str = "") -> Column:
        found = task_is(r[f"role{second}"], r[f"name{second}"], r[f"status{second}"])
        kind = r[f"op_type{second}"]
        return found if kind is None else found & F.array_contains("types", kind)

    flow = of("consumes", "consumes_absent")
    flags = j.select("run_id", "task_id", *[matches(r).alias(f"c{r.idx}") for r in flow], *[matches(r, "2").alias(f"p{r.idx}") for r in flow])
    per_run = [x for r in rows if r.type not in ("consumes", "consumes_absent") for x in _ANSWERS[r.type](r, matches)]
    out = runs.select("run_id", "error").join(j.groupBy("run_id").agg(F.max(F.when(task_is(role="root"), F.col("status"))).alias("run_status"), *per_run), "run_id", "left")
    if flow:
        used = links.join(flags.select(F.col("task_id").alias("consumer"), *[f"c{r.idx}" for r in flow]), "consumer").join(flags.select(F.col("task_id").alias("producer"), *[f"p{r.idx}" for r in flow]), "producer")
        out = out.join(used.groupBy("run_id").agg(*[F.bool_or(F.col(f"c{r.idx}") & F.col(f"p{r.idx}")).alias(f"x{r.idx}") for r in flow]), "run_id", "left")
    if of("compaction_count"):
        out = out.join(compactions.groupBy("run_id").agg(F.count("*").alias("compactions")), "run_id", "left")
    answers = [F.struct(F.lit(r.idx).alias("idx"), F.lit(r.type).alias("type"), F.coalesce(_passed(r), F.lit(False)).alias("passed")) for r in rows]
    return out.select("run_id", F.inline(F.array(*answers)))


def _count(r, matches) -> list[Column]:
    return [F.count_if(matches(r)).alias(f"x{r.idx}")]


def _any(r, matches) -> list[Column]:
    return [F.bool_or(matches(r) & F.col(f"hit{r.idx}")).alias(f"x{r.idx}")]


#: For each type, the aggregates over a run's tasks that it needs, named x and its number.
_ANSWERS = {
    "task_exists": _count,
    "task_absent": _count,
    "task_count": _count,
    "task_order": lambda r, m: [(F.min(F.when(m(r), F.col("seq"))) < F.min(F.when(m(r, "2"), F.col("seq")))).alias(f"x{r.idx}")],
    "run_status": lambda r, m: [],
    "run_error": lambda r, m: [],
    "artifact_content": _any,
    "run_output_matches_artifact": _any,
    "consumes": lambda r, m: [],
    "consumes_absent": lambda r, m: [],
    "operation_count": lambda r, m: [F.sum(F.when(m(r), F.col(f"ops{r.idx}"))).alias(f"x{r.idx}")],
    "compaction_count": lambda r, m: [],
    "skill_invoked": lambda r, m: [F.bool_and(F.when(m(r), F.coalesce(F.col(f"used{r.idx}"), F.lit(False)))).alias(f"x{r.idx}")],
}


def _passed(r) -> Column:
    """The answer, from the aggregates of its type."""
    x = F.col(f"x{r.idx}")
    if r.type == "task_exists":
        return x > 0
    if r.type == "task_absent":
        return F.coalesce(x, F.lit(0)) == 0
    if r.type in ("task_count", "operation_count"):
        return in_range(F.coalesce(x, F.lit(0)), r.least, r.most)
    if r.type == "compaction_count":
        return in_range(F.coalesce("compactions", F.lit(0)), r.least, r.most)
    if r.type == "run_status":
        return F.col("run_status") == r.run_status
    if r.type == "run_error":
        return (F.col("run_status") == "failed") & F.rlike("error", F.lit("(?iu)" + r.pattern))
    if r.type == "consumes_absent":
        return ~F.coalesce(x, F.lit(False))
    return x
