"""Traversals of the trace graph for all runs at once. Nodes and edges are DataFrames; every result
is keyed by run."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import buckets as table_buckets
from .tables import write_table

#: Edges of up to so many bytes are broadcast.
BROADCAST_BYTES = 10_000_000


def artifacts_of_runs(tasks: DataFrame, produces: DataFrame, artifacts: DataFrame, *columns: str) -> DataFrame:
    """run -> task -> operation -> artifact, ids first and the artifacts' columns last."""
    ids = tasks.select("run_id", "task_id", "seq").join(produces, "task_id")
    return ids.join(artifacts.select("artifact_id", *columns), "artifact_id")


def provenance(artifacts: DataFrame, produces: DataFrame, tasks: DataFrame, runs: DataFrame, consumes: DataFrame) -> DataFrame:
    """One row per artifact and producing operation, or one without producer: operation, task, run and
    definition, and the sorted tasks of the same run that consume it."""
    owner = tasks.select("run_id", "task_id", "seq").join(runs.select("run_id", "definition_id"), "run_id")
    made = produces.join(owner, "task_id")
    users = consumes.join(tasks.select("run_id", "task_id"), "task_id").groupBy("run_id", "artifact_id")
    users = users.agg(F.array_sort(F.collect_list("task_id")).alias("consumed_by"))
    return (
        artifacts.select("artifact_id", "name")
        .join(made, "artifact_id", "left")
        .join(users, ["run_id", "artifact_id"], "left")
        .withColumn("consumed_by", F.coalesce("consumed_by", F.array().cast("array<bigint>")))
    )


def consumption(tasks: DataFrame, produces: DataFrame, consumes: DataFrame) -> DataFrame:
    """``run_id, consumer, producer, artifact_id``: tasks that consume what another task of the run made."""
    t = tasks.select("run_id", "task_id")
    made = produces.select("task_id", "artifact_id").distinct().join(t, "task_id").withColumnRenamed("task_id", "producer")
    used = consumes.join(t, "task_id").withColumnRenamed("task_id", "consumer")
    return used.join(made, ["run_id", "artifact_id"]).where("consumer <> producer").select("run_id", "consumer", "producer", "artifact_id")


# The kinds of edges that lead from a run to all that belongs to it.
RUN_EDGES = ("instantiates", "uses", "contains", "spawns", "invokes", "has_operation", "produces", "consumes", "has_input", "has_compaction")
#: Columns of an edge: its kind, and the kind and number of the nodes it leads from and to.
EDGE = ("kind", "src_kind", "src", "dst_kind", "dst")
_NODE = ["node_kind", "node"]


def write_adjacency(edges: DataFrame, folder: str, name: str, turned: bool = False, buckets: int | None = None) -> str:
    """Write ``edges`` as table ``name``, parted by the kinds of edges and nodes and bucketed by the number of the node they
    lead from, so that a search reads the kinds it has come to, shuffles what it looks up and never the edges. ``turned``
    edges lead from what they led to."""
    spark = edges.sparkSession
    e = edges.select(*EDGE)
    if turned:
        e = e.select("kind", F.col("dst_kind").alias("src_kind"), F.col("dst").alias("src"), F.col("src_kind").alias("dst_kind"), F.col("src").alias("dst"))
    n = buckets or table_buckets(edges)
    # One file for each kind and bucket, not one for each of them and each task.
    e = e.repartition(n, "src")
    e.write.partitionBy("src_kind", "dst_kind", "kind").bucketBy(n, "src").sortBy("src").option("path", f"{folder}/{name}").saveAsTable(name)
    return name


class Edges(NamedTuple):
    """Edges of one kind between two kinds of nodes, ``edges(src, dst)``. Where nodes of ``src_kind`` have a place other than
    their number, ``edges(place, src, dst)``. ``near``: the nodes that these edges lead to have the place of those they lead from."""

    kind: str
    src_kind: int
    dst_kind: int
    edges: DataFrame
    near: bool = False


def turned(e: Edges, places: dict[int, Callable[[Column], Column]]) -> Edges:
    """The edges from what they led to. Those that are near stay where they are."""
    beside = F.col("place" if "place" in e.edges.columns else "src") if e.near else places[e.dst_kind](F.col("dst")) if e.dst_kind in places else None
    place = [] if beside is None or e.dst_kind not in places else [beside.alias("place")]
    return Edges(e.kind, e.dst_kind, e.src_kind, e.edges.select(*place, F.col("dst").alias("src"), F.col("src").alias("dst")), e.near)


def reachable(adjacency: list[str], roots: DataFrame, depth: int, folder: str, kinds: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """``run_id, node_kind, node, hops``: nodes within ``depth`` hops of ``roots(run_id, node_kind, node)`` over the
    edges of the tables of ``write_adjacency``, with the least number of hops. ``kinds`` follows edges of these kinds
    only; a table of edges and one of the same turned give both directions. Its levels are written below ``folder``."""
    spark, parts = roots.sparkSession, []
    for name in adjacency:
        e = spark.table(name)
        for row in spark.sql(f"SHOW PARTITIONS {name}").collect():
            x = dict(p.split("=") for p in row[0].split("/"))
            a, b = int(x["src_kind"]), int(x["dst_kind"])
            if kinds is None or x["kind"] in kinds:
                parts.append(Edges(x["kind"], a, b, e.where((F.col("kind") == x["kind"]) & (F.col("src_kind") == a) & (F.col("dst_kind") == b)).select("src", "dst")))
    numbers = count()
    return search(parts, roots, depth, lambda df, by=None: write_table(df, f"{folder}/nodes-{next(numbers)}", by))


def search(
    parts: list[Edges], roots: DataFrame, depth: int, write: Callable[..., DataFrame], places: dict[int, Callable[[Column], Column]] | None = None, shared: tuple[int, ...] = ()
) -> DataFrame:
    """``run_id, node_kind, node, hops``: nodes within ``depth`` hops of ``roots(run_id, node_kind, node)``, with the least
    number of hops.

    Each level looks its nodes up in the edges of their kind, takes those it comes to once, drops those of earlier levels, so
    cycles end, and is written by ``write(rows, by)``. Edges are best bucketed by place, as the levels are: then none is
    dealt out again. ``places`` has the place of a node by its number for kinds that lie beside others: a step to such a kind
    over edges that are ``near`` deals nothing out at all. Kinds that lead nowhere are no levels: what comes to them is
    gathered and taken once at the end. The search ends where no kind leads on.

    ``shared`` are kinds whose nodes many runs have in common. What such a node leads to, if it leads no further, is the
    same for each of these runs: it is neither written nor dealt out for each, but looked up when the result is read.
    """
    at = lambda kind, node: places[kind](node) if places and kind in places else node
    leads = {p.src_kind for p in parts}
    start = write(roots.select("run_id", *_NODE).distinct())
    levels: list[tuple[int, int, DataFrame]] = []  # hops, kind, rows
    ends: dict[int, list[DataFrame]] = defaultdict(list)
    spread: dict[int, list[tuple[DataFrame, DataFrame]]] = defaultdict(list)
    frontier = {}
    for kind in sorted(r.node_kind for r in start.select("node_kind").distinct().collect()):
        rows = start.where(F.col("node_kind") == kind).select("run_id", "node", at(kind, F.col("node")).alias("place"))
        if kind in leads:
            frontier[kind] = rows
            levels.append((0, kind, rows))
        else:
            ends[kind].append(rows.select("run_id", "node", F.lit(0).alias("hops")))
    for hops in range(1, depth + 1):
        steps: dict[int, list[tuple[DataFrame, bool]]] = defaultdict(list)
        for p in parts:
            if p.src_kind not in frontier:
                continue
            own = "place" in p.edges.columns
            if p.src_kind in shared and p.dst_kind not in leads and not own:
                spread[p.dst_kind].append((frontier[p.src_kind].select("run_id", F.col("node").alias("hub"), F.lit(hops).alias("far")), p.edges))
                continue
            a = frontier[p.src_kind].select("run_id", F.col("node").alias("_node"), F.col("place").alias("_place"))
            e = p.edges.select(F.col("place" if own else "src").alias("_at"), "src", "dst")
            met = a.join(e, (F.col("_place") == F.col("_at")) & (F.col("_node") == F.col("src")) if own else F.col("_place") == F.col("_at"))
            place = F.col("_at") if p.near else at(p.dst_kind, F.col("dst"))
            steps[p.dst_kind].append((met.select("run_id", F.col("dst").alias("node"), place.alias("place")), p.near))
        frontier = {}
        for kind, each in sorted(steps.items()):
            if kind not in leads:
                ends[kind] += [x.select("run_id", "node", F.lit(hops).alias("hops")) for x, _ in each]
                continue
            deal = lambda x: x if kind in shared else x.repartition(table_buckets(x), "place")  # noqa: B023, E731
            rows = [(x if near else deal(x)).withColumn("fresh", F.lit(True)) for x, near in each] + [x.withColumn("fresh", F.lit(False)) for _, k, x in levels if k == kind]
            rows = reduce(DataFrame.union, rows)
            # A node is new if no earlier level has it: one aggregate instead of a distinct and a join.
            rows = rows.groupBy("place", "run_id", "node").agg(F.bool_and("fresh").alias("fresh")).where("fresh")
            rows = write(rows.select("run_id", "node", "place"), None if kind in shared else "place")
            if not rows.isEmpty():
                frontier[kind] = rows
                levels.append((hops, kind, rows))
        if not frontier:
            break
    found = [x.select("run_id", F.lit(kind).alias("node_kind"), "node", F.lit(hops).alias("hops")) for hops, kind, x in levels]
    for kind in sorted({*ends, *spread}):
        found += [x.select("run_id", F.lit(kind).alias("node_kind"), "node", "hops") for x in _ends(ends[kind], spread[kind], write)]
    return reduce(DataFrame.union, found) if found else start.select("run_id", *_NODE, F.lit(0).alias("hops"))


def _ends(own: list[DataFrame], spread: list[tuple[DataFrame, DataFrame]], write: Callable[..., DataFrame]) -> list[DataFrame]:
    """``run_id, node, hops``, each node of a run once, for a kind that leads nowhere: of ``own``, and of what the shared nodes
    of ``spread``, ``(run_id, hub, far)`` and their edges, lead to. A run with one such node gets what that leads to less what it
    has of its own; the few with several are taken with ``own``, as are nodes without a number."""
    once = lambda x: reduce(DataFrame.union, x).groupBy("run_id", "node").agg(F.min("hops").alias("hops"))
    if not spread:
        return [write(once(own))]
    hubs = reduce(DataFrame.union, [x.withColumn("k", F.lit(k)) for k, (x, _) in enumerate(spread)])
    hubs = write(hubs.withColumn("n", F.count("*").over(Window.partitionBy("run_id"))))
    lone = (F.col("n") == 1) & F.col("run_id").isNotNull()
    to = [write(e.select(F.col("src").alias("hub"), F.col("dst").alias("node")).distinct()) for _, e in spread]
    # Few edges go to the runs; of many, both sides are dealt out.
    to = [F.broadcast(x) if 32 * x.count() <= BROADCAST_BYTES else x for x in to]
    apart = own + [hubs.where(F.col("k") == k).join(x, "hub").where(~lone | F.col("node").isNull()).select("run_id", "node", F.col("far").alias("hops")) for k, x in enumerate(to)]
    again = reduce(DataFrame.union, [x.withColumn("k", F.lit(k)) for k, x in enumerate(to)]).withColumn("both", F.lit(True))
    mine = once(apart).join(hubs.where(lone).select("run_id", "k", "hub", "far"), "run_id", "left").join(again, ["k", "hub", "node"], "left")
    mine = write(mine.select("run_id", "node", F.least("hops", F.when(F.col("both"), F.col("far"))).alias("hops"), F.coalesce("both", F.lit(False)).alias("both")))
    has = mine.where("both").groupBy("run_id").agg(F.collect_list("node").alias("has"))
    # Few rows, of which many come: dealt out one by one, as adaptive execution would take them together.
    hubs = hubs.where(lone).join(has, "run_id", "left").repartition(table_buckets(hubs))
    new = F.col("has").isNull() | ~F.array_contains("has", F.col("node"))
    given = [hubs.where(F.col("k") == k).join(x.where("node is not null"), "hub").where(new).select("run_id", "node", F.col("far").alias("hops")) for k, x in enumerate(to)]
    return [mine.select("run_id", "node", "hops"), *given]


def nested_lineage(runs: DataFrame, tasks: DataFrame, operations: DataFrame, produces: DataFrame) -> DataFrame:
    """A row per run: its tasks in order, each with its operations in order, each with its artifacts."""
    arts = produces.groupBy("op_id").agg(F.array_sort(F.collect_list("artifact_id")).alias("artifacts"))
    ops = operations.select("task_id", "op_id", "op_no", "status").join(arts, "op_id", "left")
    ops = ops.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("op_no", "op_id", "status", "artifacts"))).alias("operations"))
    t = tasks.select("run_id", "task_id", "seq", "role", "status").join(ops, "task_id", "left")
    t = t.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "task_id", "role", "status", "operations"))).alias("tasks"))
    return runs.select("run_id", "definition_id").join(t, "run_id")


def lookup(found: DataFrame, limit: int = 20, at_least: int = 1, at_most: int = 100) -> DataFrame:
    """Artifacts of each run, latest task first, then by name and id; ids once; ``limit`` rows per run."""
    n = max(at_least, min(limit, at_most))
    first = Window.partitionBy("run_id", "artifact_id").orderBy(F.desc("seq"), "name")
    rank = Window.partitionBy("run_id").orderBy(F.desc("seq"), "name", "artifact_id")
    once = found.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    return once.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def matches(tasks: DataFrame, operations: DataFrame, role=None, name=None, status=None, op_type=None) -> DataFrame:
    """Tasks that meet all given conditions; ``op_type``: with an operation of that type."""
    given = {"role": role, "name": name, "status": status}
    want: list[Column] = [F.col(k) == v for k, v in given.items() if v is not None]
    found = tasks.where(reduce(lambda a, b: a & b, want)) if want else tasks
    if op_type is not None:
        found = found.join(operations.where(F.col("type") == op_type).select("task_id"), "task_id", "left_semi")
    return found


def lineage_metrics(tasks: DataFrame, operations: DataFrame) -> DataFrame:
    """Per run: distinct skills, operations, succeeded ones, whether a human was asked, input tokens of
    succeeded operations. Runs without operations count zero."""
    t = tasks.select("run_id", "task_id", "role")
    j = t.join(operations.select("task_id", "skill_id", "status", "tokens"), "task_id", "left")
    ok = F.col("status") == "succeeded"
    return j.groupBy("run_id").agg(
        F.countDistinct("skill_id").alias("skills"),
        F.count("status").alias("operations"),
        F.count_if(ok).alias("succeeded"),
        F.bool_or(F.col("role") == "hitl").alias("hitl"),
        F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)).alias("tokens"),
    )
