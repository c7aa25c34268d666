"""Which completed tasks matter most to a run, and how much of each a context of limited size shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import walk

# Default weights, worth of artifact types and kinds of skill, tier thresholds and budget.
WEIGHTS = {"recency": 0.3, "downstream": 0.35, "artifact_type": 0.15, "retry": 0.1, "skill_type": 0.1}
TYPE_WORTH = {
    "hitl_decision": 1.0, "input_document": 0.9, "json": 0.8, "file_reference": 0.6, "text": 0.5, "skill_prompt": 0.0, "skill_asset": 0.0,
}
SKILL_HITL, SKILL_DESCRIBED, SKILL_OTHER = 1.0, 0.7, 0.5
RETRY_CAP = 3
FULL_SCORE, SUMMARY_SCORE = 0.7, 0.3
FULL_SHARE = 0.6

# The configurations of weights that a sweep compares.
SWEEP = {
    "defaults": WEIGHTS,
    "recency-heavy": {"recency": 0.6, "downstream": 0.15, "artifact_type": 0.1, "retry": 0.05, "skill_type": 0.1},
    "downstream-heavy": {"recency": 0.15, "downstream": 0.6, "artifact_type": 0.1, "retry": 0.05, "skill_type": 0.1},
    "equal": {"recency": 0.2, "downstream": 0.2, "artifact_type": 0.2, "retry": 0.2, "skill_type": 0.2},
    "no-downstream": {"recency": 0.5, "downstream": 0.0, "artifact_type": 0.2, "retry": 0.15, "skill_type": 0.15},
    "no-recency": {"recency": 0.0, "downstream": 0.5, "artifact_type": 0.2, "retry": 0.15, "skill_type": 0.15},
    "recency-only": {"recency": 1.0, "downstream": 0.0, "artifact_type": 0.0, "retry": 0.0, "skill_type": 0.0},
    "downstream-only": {"recency": 0.0, "downstream": 1.0, "artifact_type": 0.0, "retry": 0.0, "skill_type": 0.0},
}


def dimensions(tasks: DataFrame, operations: DataFrame, produces: DataFrame, artifacts: DataFrame, consumes: DataFrame) -> DataFrame:
    """Per completed task other than the root: recency, downstream use, best artifact type of its first
    succeeded operation, retries and kind of skill, and ``hitl``: it has an operation that a human answered.

    ``tasks`` has ``described``: its skill has a description. An artifact that several tasks of a run made is
    the last one's; every task of the run that consumes it counts.
    """
    run = Window.partitionBy("run_id")
    t = tasks.where("status = 'completed' and role <> 'root'").select("run_id", "task_id", "seq", "role", "described")
    t = t.withColumn("top", F.max("seq").over(run)).withColumn("later", F.count("*").over(run.orderBy("seq").rangeBetween(1, Window.unboundedFollowing)))
    ops = operations.groupBy("task_id").agg(
        F.count("*").alias("ops"),
        F.bool_or(F.col("type") == "hitl_response").alias("hitl"),
        F.min_by("op_id", F.when(F.col("status") == "succeeded", F.col("op_no"))).alias("first_ok"),
    )
    worth = F.create_map(*[F.lit(x) for kv in TYPE_WORTH.items() for x in kv])
    best = ops.select("task_id", F.col("first_ok").alias("op_id")).join(produces.select("op_id", "artifact_id"), "op_id")
    best = best.join(artifacts.select("artifact_id", F.try_element_at(worth, F.col("type")).alias("worth")), "artifact_id")
    best = best.groupBy("task_id").agg(F.max("worth").alias("worth"))
    of_run = tasks.select("run_id", "task_id", "seq")
    made = produces.join(of_run, "task_id").groupBy("run_id", "artifact_id").agg(F.max_by("task_id", F.struct("seq", "op_id")).alias("producer"))
    used = consumes.join(of_run.drop("seq"), "task_id").join(made, ["run_id", "artifact_id"])
    users = used.groupBy(F.col("producer").alias("task_id")).agg(F.countDistinct(used["task_id"]).alias("users"))
    j = t.join(ops, "task_id", "left").join(users, "task_id", "left").join(best, "task_id", "left")
    c, hitl = F.coalesce("users", F.lit(0)), F.coalesce("hitl", F.lit(False))
    return j.select(
        "run_id", "task_id", "seq", "role", hitl.alias("hitl"),
        F.when(F.col("top") > 0, F.col("seq") / F.col("top")).otherwise(1.0).alias("recency"),
        F.when(F.col("later") == 0, 1.0).otherwise(F.least(c, F.lit(1)) * 0.5 + c / F.col("later") * 0.5).alias("downstream"),
        F.coalesce("worth", F.lit(0.0)).alias("artifact_type"),
        F.least(F.coalesce("ops", F.lit(0)) / RETRY_CAP, F.lit(1.0)).alias("retry"),
        F.when(hitl, SKILL_HITL).when(F.col("described"), SKILL_DESCRIBED).otherwise(SKILL_OTHER).alias("skill_type"),
    )


def weighted(weights: dict[str, float]) -> Column:
    """The score: the dimensions by their weights, added in one order."""
    first, *rest = WEIGHTS
    total = F.col(first) * float(weights[first])
    for k in rest:
        total = total + F.col(k) * float(weights[k])
    return total


def score(dims: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    return dims.withColumn("score", weighted(weights))


def protected(scored: DataFrame) -> DataFrame:
    """Tasks whose messages are kept from compaction: a human answered, or the score is high."""
    return scored.where(F.col("hitl") | (F.col("score") >= FULL_SCORE))


def assign_tiers(rows: DataFrame, budget: Column) -> DataFrame:
    """``rows(run_id, task_id, seq, hitl, score, tokens)`` with ``tier``: ``full`` what a human answered, and, the
    best scores first, what scores 0.7 or more and fits into 0.6 of ``budget`` with what is full before it;
    else ``summary`` from 0.3 on, else ``metadata``. What doesn't fit is passed over, and a later, smaller one
    may still fit, so the high scores of a run are folded in order; all others need no look at the run."""
    high = ~F.col("hitl") & (F.col("score") >= FULL_SCORE)
    # What a human answered is full whatever its size: it comes first and takes its room.
    kept = rows.withColumn("room", budget * FULL_SHARE).where(F.col("hitl") | high).withColumn("asks", ~F.col("hitl"))
    kept = kept.select("run_id", "task_id", "asks", F.when(F.col("asks"), -F.col("score")).alias("rank"), "seq", F.col("tokens").cast("long").alias("tokens"), F.col("room").cast("double").alias("room"))

    def step(state: dict, row: dict) -> list[tuple]:
        if row["asks"] and state["used"] + row["tokens"] > row["room"]:
            return []
        state["used"] += row["tokens"]
        return [(row["task_id"],)] if row["asks"] else []

    full = walk(kept, ["asks", "rank", "seq", "task_id"], "run_id long, task_id long", lambda: {"used": 0}, step).select("task_id", F.lit(True).alias("fits"))
    tier = F.when(F.col("hitl") | F.col("fits"), "full").when(F.col("score") >= SUMMARY_SCORE, "summary").otherwise("metadata")
    return rows.join(full, "task_id", "left").withColumn("tier", tier).drop("fits")


def demote(rows: DataFrame, excess: Column) -> DataFrame:
    """Full rows that no human answered become summaries, the lowest scores first, until ``excess`` tokens of
    the run are freed."""
    full = (F.col("tier") == "full") & ~F.col("hitl")
    low = Window.partitionBy("run_id").orderBy("score", F.desc("seq"), "task_id").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.coalesce(F.sum(F.when(full, F.col("tokens")).otherwise(0)).over(low), F.lit(0))
    x = rows.withColumn("excess", excess).withColumn("freed", freed)
    down = full & (F.col("freed") < F.col("excess"))
    return x.withColumn("tier", F.when(down, "summary").otherwise(F.col("tier"))).drop("excess", "freed")
