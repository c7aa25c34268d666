"""Scores, tiers, demotion, compaction and conversation splits on hand-written runs."""

import random
import time

from pyspark.sql import functions as F

from spanloom.operators import conversations as cv
from spanloom.operators import facts as fx
from spanloom.operators import ranking as rk
from spanloom.operators import windows as w

RECENCY = dict.fromkeys(rk.WEIGHTS, 0.0) | {"recency": 1.0}


def run_of(spark, n, uses=(), op_type="llm_call"):
    """A run of ``n`` completed tasks behind a root, each with one operation that made one text."""
    tasks = [(1, 100, 0, "root", "completed", False)] + [(1, 100 + k, k, "subagent", "completed", True) for k in range(1, n + 1)]
    tasks = spark.createDataFrame(tasks, "run_id long, task_id long, seq int, role string, status string, described boolean")
    ops = spark.createDataFrame([(100 + k, 1000 + k, 1, op_type, "succeeded") for k in range(1, n + 1)], "task_id long, op_id long, op_no int, type string, status string")
    made = ops.select("op_id", "task_id", (F.col("op_id") + 1000).alias("artifact_id"))
    artifacts = made.select("artifact_id", F.lit("text").alias("type"))
    used = spark.createDataFrame([(100 + a, 2000 + b) for a, b in uses], "task_id long, artifact_id long")
    return rk.dimensions(tasks, ops, made, artifacts, used)


def test_known_scores(spark):
    got = {r.seq: round(r.score, 3) for r in rk.score(run_of(spark, 2, [(2, 1)])).collect()}
    assert got == {2: 0.828, 1: 0.678}


def test_artifacts_are_those_of_the_first_success(spark):
    tasks = spark.createDataFrame([(1, 1, 1, "tool", "completed", False)], "run_id long, task_id long, seq int, role string, status string, described boolean")
    ops = spark.createDataFrame([(1, 1, 1, "llm_call", "failed"), (1, 2, 2, "llm_call", "succeeded"), (1, 3, 3, "llm_call", "succeeded"), (1, 4, 4, "llm_call", "failed")],
                                "task_id long, op_id long, op_no int, type string, status string")
    made = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 3)], "op_id long, task_id long, artifact_id long")
    artifacts = spark.createDataFrame([(1, "hitl_decision"), (2, "json"), (3, "input_document")], "artifact_id long, type string")
    r = rk.dimensions(tasks, ops, made, artifacts, made.select("task_id", "artifact_id").limit(0)).first()
    assert (r.artifact_type, r.retry, r.skill_type, r.recency, r.downstream, r.hitl) == (0.8, 1.0, 0.5, 1.0, 1.0, False)


def tiers(spark, rows, budget):
    df = spark.createDataFrame(rows, "run_id long, task_id long, seq int, hitl boolean, score double, tokens long")
    return {r.task_id: r.tier for r in rk.assign_tiers(df, F.lit(budget)).collect()}


def test_tiers_of_ten_tasks(spark):
    scored = rk.score(run_of(spark, 10), RECENCY).withColumn("tokens", F.lit(1).cast("long"))
    got = {r.seq: r.tier for r in rk.assign_tiers(scored, F.lit(1_000_000)).collect()}
    assert got == {k: "full" if k >= 7 else "summary" if k >= 3 else "metadata" for k in range(1, 11)}
    human = rk.score(run_of(spark, 1, op_type="hitl_response"), dict.fromkeys(rk.WEIGHTS, 0.0)).withColumn("tokens", F.lit(99).cast("long"))
    assert [r.tier for r in rk.assign_tiers(human, F.lit(1)).collect()] == ["full"]


def test_tiers_match_a_plain_walk(spark):
    r = random.Random(4)
    rows = [(run, 100 * run + k, k, r.random() < 0.15, r.choice([0.2, 0.3, 0.5, 0.7, 0.8, 0.9]), r.randrange(0, 40)) for run in range(30) for k in range(12)]
    want = {}
    for run in range(30):
        own = sorted((x for x in rows if x[0] == run), key=lambda x: (-x[4], x[2]))
        used = sum(x[5] for x in own if x[3])
        for _, task, _, human, score, tokens in own:
            if human:
                want[task] = "full"
            elif score >= 0.7 and used + tokens <= 100 * 0.6:
                want[task], used = "full", used + tokens
            else:
                want[task] = "summary" if score >= 0.3 else "metadata"
    assert tiers(spark, rows, 100) == want


def test_demotion_frees_the_lowest(spark):
    rows = [(1, 1, 1, True, 0.1, 50), (1, 2, 2, False, 0.9, 30), (1, 3, 3, False, 0.7, 10), (1, 4, 4, False, 0.8, 10), (1, 5, 5, False, 0.4, 10)]
    df = spark.createDataFrame(rows, "run_id long, task_id long, seq int, hitl boolean, score double, tokens long")
    df = df.withColumn("tier", F.when(F.col("hitl") | (F.col("score") >= 0.7), "full").otherwise("summary"))
    got = {r.task_id: r.tier for r in rk.demote(df, F.lit(15)).collect()}
    assert got == {1: "full", 2: "full", 3: "summary", 4: "summary", 5: "summary"}
    assert all(r.tier == "full" for r in rk.demote(df, F.lit(0)).where("task_id < 5").collect())


def plain_compactions(pairs, budget):
    want = []
    for run in sorted({p[0] for p in pairs}):
        recent = []
        for _, k, n, kept in sorted(p for p in pairs if p[0] == run):
            recent.append((n, kept))
            if sum(x[0] for x in recent) > budget:
                half = max(1, len(recent) // 2)
                stay = [x for x in recent[:half] if x[1]]
                stay = [] if len(stay) == half else stay
                want.append((run, k, half - len(stay)))
                recent = stay + recent[half:]
    return want


def test_compactions_count_on_from_what_is_left(spark):
    r = random.Random(6)
    pairs = [(run, k, r.randrange(0, 90), r.random() < 0.3) for run in range(30) for k in range(r.randrange(1, 25))]
    df = spark.createDataFrame(pairs, "run_id long, pair long, tokens long, protected boolean")
    want = plain_compactions(pairs, 150)
    assert sorted(map(tuple, w.compaction_triggers(df, 150).collect())) == want and len(want) > 20
    plain = {(a, b) for a, b, _ in plain_compactions([(a, b, c, False) for a, b, c, _ in pairs], 150)}
    assert plain != {(a, b) for a, b, _ in want}


def test_long_runs_cost_their_length(spark):
    pairs = spark.range(100_000).selectExpr("1 AS run_id", "id AS pair", "id % 90 AS tokens", "id % 3 = 0 AS protected")
    began = time.time()
    n = w.compaction_triggers(pairs, 150).count()
    rows = spark.range(100_000).selectExpr("1 AS run_id", "id AS task_id", "CAST(id AS INT) AS seq", "false AS hitl", "0.7 + id % 7 / 100 AS score", "id % 11 AS tokens").withColumn("score", F.col("score").cast("double"))
    full = rk.assign_tiers(rows, F.lit(500_000)).where("tier = 'full'").count()
    assert n > 10_000 and 0 < full < 100_000 and time.time() - began < 60


def test_split_keeps_protected_pairs(spark):
    messages = [(1, k, k == 1) for k in range(8)] + [(2, k, k in (1, 3)) for k in range(9)] + [(3, 0, False)] + [(4, k, False) for k in range(5)]
    df = spark.createDataFrame(messages, "run_id long, turn long, protected boolean")
    got = {(r.run_id, r.turn): r.side for r in cv.split_messages(df).collect()}
    side = lambda run, n: [got[run, k] for k in range(n)]
    assert side(1, 8) == ["newer"] * 2 + ["older"] * 2 + ["newer"] * 4
    # All older pairs are protected: the middle alone decides.
    assert side(2, 9) == ["older"] * 4 + ["newer"] * 5
    assert side(3, 1) == ["older"] and side(4, 5) == ["older"] * 2 + ["newer"] * 2 + ["dropped"]


def test_ids_keep_their_first_order(spark):
    ident = lambda c: f"{c * 8}-{c * 4}-{c * 4}-{c * 4}-{c * 12}"
    say = lambda *cs: " ".join(f"output_artifact_id: {ident(c)}" for c in cs)
    history = spark.createDataFrame([(1, 5, say("b", "a")), (2, 1, "none")], "run_id long, turn long, text string")
    old = spark.createDataFrame([(1, 2, say("c", "b")), (1, 1, say("d") + " id: x"), (2, 3, say("a").upper().replace("OUTPUT", "output"))], "run_id long, turn long, text string")
    got = {r.run_id: r.ids for r in cv.preserved_ids(history, old).collect()}
    assert got == {1: [ident(c) for c in "badc"], 2: [ident("A")]}


def test_phrases_are_quoted_whole(spark):
    r = random.Random(2)
    word = lambda: r.choice("abcdefgh")
    texts = [(i, " ".join(word() for _ in range(r.randrange(0, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, "A  B\nc")]
    phrases = [(i, [word() for _ in range(r.randrange(1, 7))]) for i in range(40)] + [(90, []), (91, ["a", "b", "c"])]
    want = {(i, p) for i, t in texts for p, ws in phrases if ws and f" {' '.join(ws)} " in f" {' '.join((t or '').lower().split())} "}
    out = spark.createDataFrame(texts, "output_id long, text string")
    for k in (5, 2):
        got = fx.quoting(out, spark.createDataFrame(phrases, "phrase_id long, words array<string>"), k)
        assert set(map(tuple, got.collect())) == want and len(want) > 50
