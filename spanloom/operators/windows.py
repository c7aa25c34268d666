"""Ordered looks at tasks and operations: dedup, version chains, budgets, breakers, compactions."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedup_by_hash(rows: DataFrame, scope: list[str], content: str, order: list, ident: str) -> DataFrame:
    """Adds ``canonical``: the first id in ``scope`` with the same content."""
    w = Window.partitionBy(*scope, content).orderBy(*order)
    return rows.withColumn("canonical", F.first(ident).over(w))


def version_chain(rows: DataFrame, scope: list[str], name: str, content: str, order: list, ident: str) -> DataFrame:
    """Of rows first with their content in ``scope``: ``supersedes``, the one before with that name."""
    first = dedup_by_hash(rows, scope, content, order, ident).where(F.col(ident) == F.col("canonical"))
    w = Window.partitionBy(*scope, name).orderBy(*order)
    return first.withColumn("supersedes", F.lag(ident).over(w)).drop("canonical")


def first_crossing(rows: DataFrame, scope: list[str], amount: str, order: list, limit: float) -> DataFrame:
    """The first row at which the running sum of ``amount`` reaches ``limit``, with that sum."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = rows.withColumn("running", F.sum(amount).over(w))
    return s.where((F.col("running") >= limit) & (F.col("running") - F.col(amount) < limit))


def streaks(rows: DataFrame, scope: list[str], bad: Column, order: list, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive bad rows: ``island`` (good rows before) and ``length``."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("bad", bad).withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w))
    return marked.where("bad").groupBy(*scope, "island").agg(F.count("*").alias("length")).where(F.col("length") >= least)


def calls_over_limit(tasks: DataFrame, limit: int) -> DataFrame:
    """Tasks begun when the run had ``limit`` completed ones of that name already."""
    w = Window.partitionBy("run_id", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.count_if(F.col("status") == "completed").over(w), F.lit(0))
    return tasks.withColumn("before", done).where(F.col("before") >= limit)


def walk(rows: DataFrame, order: list[str], output: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """Rows made by ``step(state, row)`` over each run's rows in ``order``, where ``state`` is what ``start`` makes for
    each run. Spark deals the rows out by run and sorts them; a task passes over them once and holds one row and
    one state, so a run costs its length however long it is, and no run is gathered."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in output.split(", ")]
        run, state = object(), None
        for batch in batches:
            out = []
            columns = batch.schema.names
            for values in zip(*batch.to_pydict().values()):
                row = dict(zip(columns, values))
                if row["run_id"] != run:
                    run, state = row["run_id"], start()
                out += [(run, *x) for x in step(state, row)]
            cols = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_pydict({n: pa.array(list(c), pa.int64()) for n, c in zip(names, cols)})

    return rows.repartition("run_id").sortWithinPartitions("run_id", *order).mapInArrow(of, output)


def compaction_triggers(pairs: DataFrame, budget: int) -> DataFrame:
    """``run_id, pair, compacted`` for each pair of messages after which a run's recent messages exceed ``budget``
    tokens, and how many pairs are compacted then.

    ``pairs`` has ``run_id, pair, tokens`` and ``protected``. A compaction takes the older half of what is recent, one
    pair at least, but leaves protected pairs, unless that would leave nothing to compact: then they go too. What
    is left counts on, in its order.
    """

    def step(state: dict, row: dict) -> list[tuple]:
        recent = state["recent"]
        recent.append((row["tokens"], row["protected"]))
        state["held"] += row["tokens"]
        if state["held"] <= budget:
            return []
        half = [recent.popleft() for _ in range(max(1, len(recent) // 2))]
        stay = [x for x in half if x[1]]
        if len(stay) == len(half):
            stay = []
        recent.extendleft(reversed(stay))
        state["held"] -= sum(x[0] for x in half) - sum(x[0] for x in stay)
        return [(row["pair"], len(half) - len(stay))]

    rows = pairs.select("run_id", "pair", F.col("tokens").cast("long").alias("tokens"), "protected")
    return walk(rows, ["pair"], "run_id long, pair long, compacted long", lambda: {"recent": deque(), "held": 0}, step)
