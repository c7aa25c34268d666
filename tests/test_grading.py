"""Suites, criteria, root causes, badges, appends and table functions on hand-made cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from spanloom.functions import statistics as st
from spanloom.operators import conversations as cv
from spanloom.operators import grading as gr
from spanloom.operators import table_functions as tf
from spanloom.sources import documents as d

LABELS = "purpose string, realism string, gate string, mode string, parked boolean"
CASE = (
    "category string, facts array<struct<fact_id: string, expected: string, weight: double>>, "
    "criteria struct<min_factual: double, required_fact_ids: array<string>, min_judge: double, zero_failing: boolean>, "
    "required_skills array<string>, forbidden_skills array<string>, assertions int"
)
OUTPUT = "matched array<string>, judge double, grades array<struct<aspect: string, severity: string>>"
FACTS = [("f1", None, 1.0), ("f2", "present", 3.0), ("bad", "absent", 1.0)]


def test_suites_follow_the_labels(spark):
    rows = [
        ("forecast", "blocker", "direct-api", False, ["prod-gate", "preprod-headroom"]), ("forecast", "research", "direct-api", False, ["preprod-headroom"]),
        ("stress", "blocker", "direct-api", False, ["preprod-headroom"]), ("mechanism", "research", "direct-api", False, ["research"]),
        ("mechanism", "research", "flat-harness", False, ["research", "decomposition-research"]), ("forecast", "blocker", "direct-api", True, []), ("diagnostic", "none", "none", False, []),
    ]
    df = spark.createDataFrame([(p, "x", g, m, k) for p, g, m, k, _ in rows], LABELS).select(gr.suites(F.struct("*")).alias("s"))
    assert [r.s for r in df.collect()] == [x[-1] for x in rows]


def test_own_labels_come_before_defaults(spark):
    df = spark.createDataFrame([(("stress", None, None, None, None), ("forecast", "prod-shaped", "blocker", "direct-api"))], f"own struct<{LABELS.replace(' string', ': string').replace(' boolean', ': boolean')}>, base struct<purpose: string, realism: string, gate: string, mode: string>")
    assert tuple(df.select(gr.resolve(F.col("own"), F.col("base")).alias("x")).first().x) == ("stress", "prod-shaped", "blocker", "direct-api", False)


def test_parked_cases_are_taken_on_purpose_only(spark):
    df = spark.createDataFrame([(1, "hitl", ("mechanism", "x", "research", "direct-api", True)), (2, "hitl", ("mechanism", "x", "research", "direct-api", False))], f"id int, category string, labels struct<{LABELS.replace(' string', ': string').replace(' boolean', ': boolean')}>")
    take = lambda **how: [r.id for r in df.where(gr.selected(F.col("id"), F.col("category"), F.col("labels"), **how)).collect()]
    assert take() == [2] and take(categories=["hitl"]) == [1, 2] and take(ids=[1]) == [1] and take(of_suites=["research"]) == [2] and take(of_suites=["research"], ids=[1]) == []


def graded(spark, criteria=(None, None, None, None), matched=("f1", "f2"), judge=None, grades=None, skills=(None, None), assertions=None, facts=FACTS):
    df = spark.createDataFrame([("x", facts, criteria, *skills, assertions, list(matched) if matched is not None else None, judge, grades)], f"{CASE}, {OUTPUT}")
    case = F.struct("category", "facts", "criteria", "required_skills", "forbidden_skills", "assertions")
    r = df.select(gr.grade(case, F.col("matched"), F.col("judge"), F.col("grades")).alias("x")).first().x
    return r.passed, r.reason


GOOD = (True, "All criteria met")


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({}, GOOD),
        ({"criteria": (None, ["f1", "f3"], None, None)}, (False, "Missing required facts: f3")),
        ({"criteria": (0.8, None, None, None), "matched": ["f2"]}, (False, "Factual score 0.75 below threshold 0.8")),
        ({"criteria": (0.75, None, None, None), "matched": ["f2"]}, GOOD),
        ({"criteria": (None, None, 0.7, None), "judge": 0.6996}, (False, "Judge composite 0.700 below threshold 0.7")),
        ({"criteria": (None, None, 0.7, None)}, GOOD),
        ({"matched": ["f1", "f2", "bad"]}, (False, "Forbidden facts matched: bad")),
        ({"criteria": (0.9, ["f1"], None, None), "matched": None}, GOOD),
        ({"grades": [("graph_assertion", "fail")]}, GOOD),
        ({"grades": [("graph_assertion", "fail"), ("graph_assertion", "fail")], "assertions": 2}, (False, "Process gate failed: 2 failing step grade(s) (graph_assertion)")),
        ({"grades": [("retry", "fail"), ("graph_assertion", "warn")], "assertions": 2}, GOOD),
        ({"grades": [("skill_decomposition", "fail")], "skills": (None, ["s"])}, (False, "Process gate failed: 1 failing step grade(s) (skill_decomposition)")),
        ({"grades": [("retry", "fail"), ("graph_assertion", "fail"), ("retry", "fail")], "criteria": (None, None, None, True)}, (False, "Process gate failed: 3 failing step grade(s) (retry, graph_assertion)")),
        (
            {"criteria": (1.0, ["f1", "f9"], 0.5, True), "matched": ["bad"], "judge": 0.1234, "grades": [("retry", "fail")]},
            (False, "Missing required facts: f1, f9; Factual score 0.00 below threshold 1; Judge composite 0.123 below threshold 0.5; Forbidden facts matched: bad; Process gate failed: 1 failing step grade(s) (retry)"),
        ),
        ({"facts": [], "matched": [], "criteria": (0.1, None, None, None)}, (False, "Factual score 0.00 below threshold 0.1")),
    ],
)
def test_criteria_and_their_order(spark, how, want):
    assert graded(spark, **how) == want


def test_the_baseline_s_steps_are_not_graded(spark):
    df = spark.createDataFrame([("x", FACTS, (None, None, None, True), None, None, None, ["f1"], 0.5, [("retry", "fail")])], f"{CASE}, {OUTPUT}")
    case = F.struct("category", "facts", "criteria", "required_skills", "forbidden_skills", "assertions")
    out = {"harness_matched": F.col("matched"), "baseline_matched": F.col("matched"), "harness_judge": F.col("judge"), "baseline_judge": F.col("judge"), "grades": F.col("grades")}
    x = df.select(gr.grade_both(case, out).alias("x")).first().x
    assert not x.harness.passed and x.baseline.passed


@pytest.mark.parametrize(
    ("used", "required", "forbidden", "want"),
    [
        (["a"], ["a", "b"], [], ("fail", "missing required skills: b; invoked: a")),
        ([], ["a"], [], ("fail", "missing required skills: a; invoked: (none)")),
        (["a", "c"], ["a"], ["c"], ("fail", "forbidden skills invoked: c; invoked: a, c")),
        (["a"], ["a"], ["c"], ("pass", "all 1 required skill(s) invoked; no forbidden skill(s) invoked")),
        (["a"], [], [], ("pass", "No skill assertions defined for this task.")),
    ],
)
def test_any_missing_or_forbidden_skill_fails(spark, used, required, forbidden, want):
    df = spark.createDataFrame([(used, required, forbidden)], "u array<string>, r array<string>, f array<string>")
    assert tuple(df.select(gr.skill_grade(F.col("u"), F.col("r"), F.col("f")).alias("x")).first().x) == want


def test_root_causes(spark):
    levels, places = ("light", "moderate", "heavy"), ("body", "skill", "tool")
    cases = {
        "healthy": lambda level, place, pos: True,
        "not propagating": lambda level, place, pos: False,
        "over-steering": lambda level, place, pos: pos or level == "light",
        "diluted directives": lambda level, place, pos: level == "heavy" or not pos,
        "body drowned out": lambda level, place, pos: place != "body",
        "descriptions underweighted": lambda level, place, pos: place == "body",
        "unclear": lambda level, place, pos: (level == "light") != (place == "body"),
    }
    rows = [(k, a, b, p, f(a, b, p)) for k, f in cases.items() for a in levels for b in places for p in (True, False)]
    rows += [("one positive", "light", "body", True, True)]
    got = {r.claim: r.cause for r in gr.root_cause(spark.createDataFrame(rows, "claim string, intensity string, location string, positive boolean, passed boolean"), ["claim"]).collect()}
    assert got == {k: k for k in cases} | {"one positive": "unclear"}


def test_badges(spark):
    df = spark.createDataFrame([(0.0009, 0.123, 1.6), (0.009, -0.0501, 0.7), (0.049, 0.05, 1.0), (0.05, -0.0004, 1.5), (1.0, None, None)], "p double, d double, r double")
    got = [tuple(r) for r in df.select(st.significance(F.col("p")), st.p_label(F.col("p")), st.delta_badge(F.col("d")), st.pressure(F.col("r"))).collect()]
    assert got == [("**", "< .001", "▲ +12.3pp", "high"), ("**", "< .01", "▼ -5.0pp", "low"), ("*", "0.049", "→ +5.0pp", None), ("", "0.050", "→ -0.0pp", None), ("", "1.000", "N/A", None)]


def test_flatten_takes_texts_and_plain_results(spark):
    rows = [(1, 1, None, [("text", "a", None, None), ("tool_use", None, None, "c1"), ("tool_result", None, "b", "c1")]), (1, 0, "plain", None), (1, 2, None, []), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "run_id int, turn int, content string, blocks array<struct<type: string, text: string, content: string, tool_use_id: string>>")
    assert {r.run_id: r.flat for r in cv.flatten(df).collect()} == {1: "plain\na\nb", 2: ""}


def test_appends_can_be_repeated(spark, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    edges = lambda rows: spark.createDataFrame(rows, "src long, dst long, batch int")
    nodes = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    d.append_edges(edges([(1, 2, 1), (1, 9, 1), (8, 2, 1)]), nodes, nodes, folder, ["batch"])
    d.append_edges(edges([(2, 1, 2)]), nodes, nodes, folder, ["batch"])
    d.append_edges(edges([(1, 2, 1), (1, 9, 1), (8, 2, 1)]), nodes, nodes, folder, ["batch"])  # once more
    got = spark.read.schema("src long, dst long, kept boolean, batch int").parquet(folder).select("src", "dst", "batch", "kept").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1, True), (1, 9, 1, False), (2, 1, 2, True), (8, 2, 1, False)]


def test_table_functions_stand_in_from_and_behind_lateral(spark):
    runs = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "run_id long, definition_id long")
    tasks = spark.createDataFrame([(1, 10, 0, "root", "completed"), (1, 11, 1, "tool", "failed"), (2, 20, 0, "root", "completed")], "run_id long, task_id long, seq int, role string, status string")
    ops = spark.createDataFrame([(10, 100, 1, "succeeded"), (20, 200, 1, "failed")], "task_id long, op_id long, op_no int, status string")
    made = spark.createDataFrame([(100, 10, 5), (200, 20, 6)], "op_id long, task_id long, artifact_id long")
    used = spark.createDataFrame([(11, 5)], "task_id long, artifact_id long")
    arts = spark.createDataFrame([(5, "five", "json"), (6, "six", "text")], "artifact_id long, name string, type string")
    tf.register(spark, runs, tasks, ops, made, used, arts)
    rows = lambda sql: sorted(map(tuple, spark.sql(sql).collect()), key=str)
    assert rows("SELECT name, task_id FROM artifacts_for_run(1)") == [("five", 10)]
    assert rows("SELECT r.run_id, p.artifact_id, p.consumed_by FROM trace_runs r, LATERAL provenance(r.run_id) p") == [(1, 5, [11]), (2, 6, [])]
    assert rows("SELECT r.run_id, l.task_id, l.op_id, l.artifact_id FROM trace_runs r, LATERAL lineage(r.run_id) l") == [(1, 10, 100, 5), (1, 11, None, None), (2, 20, 200, 6)]
    plan = spark.sql("SELECT r.run_id, a.name FROM trace_runs r, LATERAL artifacts_for_run(r.run_id) a")._jdf.queryExecution().optimizedPlan().toString()
    assert "LateralJoin" not in plan and "OuterReference" not in plan
