"""Conversations of runs: which turns a compaction takes, and which ids outlive it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: how texts name the artifacts that a turn put out.
OUTPUT_ID = r"(?i)output_artifact_id:\s*([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"


def output_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(OUTPUT_ID), 1)


def split_messages(messages: DataFrame) -> DataFrame:
    """``messages(run_id, turn, protected, ...)`` with their number ``i`` in the run, their ``pair`` and ``side``.

    The pairs before the middle are ``older``, but for those whose second message is protected; others are
    ``newer``, and a last message without a partner is ``dropped``. If nothing is left to compact, the middle alone
    decides, so that a compaction always makes room.
    """
    run = Window.partitionBy("run_id")
    x = messages.withColumn("i", F.row_number().over(run.orderBy("turn")) - 1).withColumn("n", F.count("*").over(run))
    x = x.withColumn("pair", F.floor(F.col("i") / 2)).withColumn("pairs", F.floor(F.col("n") / 2))
    x = x.withColumn("middle", F.greatest(F.floor(F.col("pairs") / 2), F.lit(1)))
    hit = (F.col("i") % 2 == 1) & F.col("protected")
    x = x.withColumn("kept", F.bool_or(hit).over(Window.partitionBy("run_id", "pair")))
    x = x.withColumn("old", (F.col("pair") < F.col("pairs")) & (F.col("pair") < F.col("middle")) & ~F.col("kept"))
    side = F.when(F.col("old"), "older").when(F.col("pair") < F.col("pairs"), "newer").otherwise("dropped")
    plain = F.when(F.col("i") < 2 * F.col("middle"), "older").otherwise("newer")
    x = x.withColumn("side", F.when(F.bool_or("old").over(run), side).otherwise(plain))
    return x.drop("n", "pairs", "middle", "kept", "old")


def preserved_ids(history: DataFrame, compacted: DataFrame) -> DataFrame:
    """``run_id, ids``: ids that the history or the compacted turns name, the history's first, each once, in the
    order in which they come up."""
    rows = history.withColumn("part", F.lit(0)).unionByName(compacted.withColumn("part", F.lit(1)))
    rows = rows.select("run_id", "part", "turn", output_ids(F.col("text")).alias("ids")).where(F.size("ids") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("part", "turn", "ids")))
    return rows.groupBy("run_id").agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["ids"]))).alias("ids"))


def flatten(messages: DataFrame) -> DataFrame:
    """``run_id, flat``: the texts of a run's ``messages(run_id, turn, content, blocks)`` in order, line by line. A message
    is its plain ``content``, or of its ``blocks`` those with a text and, of the others, those with plain content."""
    said = F.transform("blocks", lambda b: F.coalesce(b["text"], b["content"]))
    parts = F.when(F.col("content").isNotNull(), F.array("content")).otherwise(F.array_compact(said))
    ordered = F.array_sort(F.collect_list(F.struct("turn", parts.alias("parts"))))
    return messages.groupBy("run_id").agg(F.array_join(F.flatten(F.transform(ordered, lambda m: F.coalesce(m["parts"], F.array().cast("array<string>")))), "\n").alias("flat"))
