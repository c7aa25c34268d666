"""Grades of a case's outputs by the case's own criteria, as Columns over nested cases.

A case is a struct: ``category``, ``metadata`` (what it says itself of purpose, realism, gate, mode, and whether it
is parked), ``facts`` (array of ``fact_id, expected, weight``), ``criteria`` (``min_factual, required_fact_ids,
min_judge, zero_failing``), ``required_skills``, ``forbidden_skills`` and ``assertions`` (how many). What a case does
not say may be null. An output brings ``matched`` (the ids of the facts found in it), or null if nothing was
looked for, a judge's composite or null, and the grades of its steps, an array of ``aspect, severity``, or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("purpose", "realism", "gate", "mode")


def resolve(metadata: Column, default: Column) -> Column:
    """The case's labels: what it says itself, else its category's default; it is parked only if it says so."""
    own = [F.coalesce(metadata[x], default[x]).alias(x) for x in LABELS]
    return F.struct(*own, F.coalesce(metadata["parked"], F.lit(False)).alias("parked"))


def suites(labels: Column) -> Column:
    """Suites that a case's labels put it into, in order; a parked case is in none."""
    forecast, mechanism = labels["purpose"] == "forecast", labels["purpose"] == "mechanism"
    blocks = forecast & (labels["gate"] == "blocker")
    kinds = [
        F.when(blocks, "prod-gate"),
        F.when(forecast | (labels["purpose"] == "stress"), "preprod-headroom"),
        F.when(mechanism, "research"),
        F.when(mechanism & (labels["mode"] == "flat-harness"), "decomposition-research"),
    ]
    return F.when(labels["parked"], F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*kinds)))


def selected(case_id: Column, category: Column, labels: Column, categories: list[str] | None = None, of_suites: list[str] | None = None, ids: list | None = None) -> Column:
    """Whether a filter takes the case. Parked cases are taken only if asked for by category or id."""
    out = F.lit(True) if categories or ids else ~labels["parked"]
    if categories:
        out = out & category.isin(categories)
    if of_suites:
        out = out & F.arrays_overlap(suites(labels), F.array(*[F.lit(x) for x in of_suites]))
    if ids:
        out = out & case_id.isin(ids)
    return out


def factual(facts: Column, matched: Column) -> Column:
    """Weight of the facts found among those that should be present; 0 without any weight, null if nothing was
    looked for."""
    present = F.filter(facts, lambda f: ~f["expected"].eqNullSafe(F.lit("absent")))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, f: a + f["weight"].cast("double"))
    found = total(F.filter(present, lambda f: F.array_contains(matched, f["fact_id"])))
    return F.when(matched.isNotNull(), F.coalesce(found / F.nullif(total(present), F.lit(0.0)), F.lit(0.0)))


def gates(case: Column) -> Column:
    """Aspects of step grades whose failure fails the case: null for all of them. A case that asks for no failing
    step gates all; else its assertions and its skills gate their own aspect."""
    skills = (F.coalesce(F.size(case["required_skills"]), F.lit(0)) > 0) | (F.coalesce(F.size(case["forbidden_skills"]), F.lit(0)) > 0)
    some = F.array(F.when(F.coalesce(case["assertions"], F.lit(0)) > 0, "graph_assertion"), F.when(skills, "skill_decomposition"))
    return F.when(~F.coalesce(case["criteria"]["zero_failing"], F.lit(False)), F.array_compact(some))


def failing(case: Column, grades: Column) -> Column:
    """The failing grades of gated aspects, in order; null if no step was graded."""
    gated = gates(case)
    keep = lambda g: (g["severity"] == "fail") & (gated.isNull() | F.array_contains(gated, g["aspect"]))
    return F.filter(grades, keep)


def _fixed(x: Column, digits: int) -> Column:
    """With so many decimals, halves up."""
    return F.format_string(f"%.{digits}f", F.floor(x * 10**digits + 0.5) / 10**digits)


def _number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def grade(case: Column, matched: Column, judge: Column, grades: Column) -> Column:
    """Struct of ``passed`` and ``reason``: all criteria that fail, in order, required facts, factual score, judge,
    forbidden facts, gated steps."""
    need, score = case["criteria"], factual(case["facts"], matched)
    missing = F.array_except(F.coalesce(need["required_fact_ids"], F.array().cast("array<string>")), matched)
    forbidden = F.transform(F.filter(case["facts"], lambda f: (f["expected"] == "absent") & F.array_contains(matched, f["fact_id"])), lambda f: f["fact_id"])
    bad = failing(case, grades)
    # The texts of the reasons.
    reasons = [
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing required facts: "), F.array_join(missing, ", "))),
        F.when(score < need["min_factual"], F.concat(F.lit("Factual score "), _fixed(score, 2), F.lit(" below threshold "), _number(need["min_factual"]))),
        F.when(judge < need["min_judge"], F.concat(F.lit("Judge composite "), _fixed(judge, 3), F.lit(" below threshold "), _number(need["min_judge"]))),
        F.when(F.size(forbidden) > 0, F.concat(F.lit("Forbidden facts matched: "), F.array_join(forbidden, ", "))),
        F.when(
            F.size(bad) > 0,
            F.concat(F.lit("Process gate failed: "), F.size(bad).cast("string"), F.lit(" failing step grade(s) ("), F.array_join(F.array_distinct(F.transform(bad, lambda g: g["aspect"])), ", "), F.lit(")")),
        ),
    ]
    text = F.concat_ws("; ", *reasons)
    return F.struct((text == "").alias("passed"), F.when(text == "", "All criteria met").otherwise(text).alias("reason"))


def grade_both(case: Column, output: dict[str, Column]) -> Column:
    """Both arms by the same criteria. The steps are the harness's: no step of the baseline is graded."""
    none = F.lit(None).cast("array<struct<aspect:string,severity:string>>")
    arms = {"harness": output["grades"], "baseline": none}
    return F.struct(*[grade(case, output[f"{arm}_matched"], output[f"{arm}_judge"], steps).alias(arm) for arm, steps in arms.items()])


def skill_grade(used: Column, required: Column, forbidden: Column) -> Column:
    """Struct of ``severity`` and ``finding``: any required skill missing or forbidden one used is a fail."""
    missing, banned = F.array_except(required, used), F.array_intersect(forbidden, used)
    listed = lambda x: F.array_join(x.cast("array<string>"), ", ")
    good = F.concat_ws(
        "; ",
        F.when(F.size(required) > 0, F.concat(F.lit("all "), F.size(required).cast("string"), F.lit(" required skill(s) invoked"))),
        F.when(F.size(forbidden) > 0, "no forbidden skill(s) invoked"),
    )
    bad = F.concat_ws(
        "; ",
        F.when(F.size(missing) > 0, F.concat(F.lit("missing required skills: "), listed(missing))),
        F.when(F.size(banned) > 0, F.concat(F.lit("forbidden skills invoked: "), listed(banned))),
        F.concat(F.lit("invoked: "), F.when(F.size(used) > 0, listed(used)).otherwise("(none)")),
    )
    none = (F.size(required) == 0) & (F.size(forbidden) == 0)
    failed = (F.size(missing) > 0) | (F.size(banned) > 0)
    return F.struct(
        F.when(failed, "fail").otherwise("pass").alias("severity"),
        F.when(failed, bad).when(none, "No skill assertions defined for this task.").otherwise(good).alias("finding"),
    )


def root_cause(tests: DataFrame, by: list[str]) -> DataFrame:
    """``by, tests, cause`` from ``tests`` (``by, intensity, location, positive, passed``): what the pattern of passes over
    intensity (light, moderate, heavy, over), location (body, skill, tool) and polarity points at.

    The first pattern that fits decides. A pattern needs a test in each of the cells that it speaks of; with none of
    them, or where passes and failures don't line up, the cause is ``unclear``.
    """
    passed, level, place, positive = F.col("passed"), F.col("intensity"), F.col("location"), F.col("positive")
    described = place.isin("skill", "tool")

    def all_(cell: Column, want: bool) -> Column:
        """There are tests in the cell and all of them pass, or all fail."""
        return F.coalesce(F.bool_and(F.when(cell, passed if want else ~passed)), F.lit(False))

    strong = level.isin("moderate", "heavy")
    rules = [
        (all_(positive, True) & all_(~positive, True), "healthy"),
        (all_(F.lit(True), False), "not propagating"),
        (all_(strong & positive, True) & all_(strong & ~positive, False), "over-steering"),
        (all_((level == "light") & positive, False) & all_((level == "moderate") & positive, False) & all_((level == "heavy") & positive, True), "diluted directives"),
        (all_(place == "body", False) & all_(described, True), "body drowned out"),
        (all_(described, False), "descriptions underweighted"),
    ]
    cause = F.lit("unclear")
    for fits, name in reversed(rules):
        cause = F.when(fits, name).otherwise(cause)
    return tests.groupBy(*by).agg(F.count("*").alias("tests"), cause.alias("cause"))
