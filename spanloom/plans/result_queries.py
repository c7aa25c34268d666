"""Scores of two arms over cases and runs: summaries, tests, label axes, grades."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import statistics as st
from ..operators import grading as gr
from .bindings import GRADED, JUDGED, RESULTS
from .registry import query

_T = ", ".join(str(x) for x in st.T_95)
#: Of a group: number, mean, sd and half interval of a value, as DuckDB says them.
_SUM = """count({x}) AS {x}_n, round(coalesce(avg({x}), 0), 4) AS {x}_mean, round(coalesce(stddev_samp({x}), 0), 4) AS {x}_sd,
  round(CASE WHEN count({x}) = 0 THEN 0 WHEN count({x}) > 1 THEN (CASE WHEN count({x}) <= 30 THEN [""" + _T + """][count({x}) - 1]::DOUBLE ELSE 1.96::DOUBLE END) * stddev_samp({x}) / sqrt(count({x})) END, 4) AS {x}_ci"""
_GOOD = "NOT inconclusive"


def _good(t):
    return t.results.where("not inconclusive")


@query("prj_05_metadata_defaults", RESULTS + "SELECT case_id, purpose, realism, gate, mode, parked FROM results")
def _(t):
    return t.results.select("case_id", "labels.*")


_SUITES = """, s AS (SELECT *, CASE WHEN parked THEN [] ELSE list_filter([CASE WHEN purpose = 'forecast' AND gate = 'blocker' THEN 'prod-gate' END, CASE WHEN purpose IN ('forecast', 'stress') THEN 'preprod-headroom' END,
  CASE WHEN purpose = 'mechanism' THEN 'research' END, CASE WHEN purpose = 'mechanism' AND mode = 'flat-harness' THEN 'decomposition-research' END], lambda x: x IS NOT NULL) END AS suites FROM results)
"""


def _suites(t):
    return t.results.withColumn("suites", gr.suites(F.col("labels")))


@query("prj_06_suites", RESULTS + _SUITES + "SELECT case_id, array_to_string(suites, ',') AS suites FROM s")
def _(t):
    return _suites(t).select("case_id", F.array_join("suites", ",").alias("suites"))


@query("flt_06_case_filter", RESULTS + _SUITES + """SELECT 'suites' AS asked, case_id FROM s WHERE NOT parked AND list_has_any(suites, ['prod-gate', 'research'])
UNION ALL SELECT 'categories', case_id FROM s WHERE category IN ('hitl', 'synthesis') UNION ALL SELECT 'nothing', case_id FROM s WHERE NOT parked""")
def _(t):
    """Three filters: by suite, by category, which takes parked cases too, and none."""
    asked = {"suites": {"of_suites": ["prod-gate", "research"]}, "categories": {"categories": ["hitl", "synthesis"]}, "nothing": {}}
    taken = [F.when(gr.selected(F.col("case_id"), F.col("category"), F.col("labels"), **how), name) for name, how in asked.items()]
    return t.results.select(F.explode(F.array_compact(F.array(*taken))).alias("asked"), "case_id")


@query("flt_10_conclusive", RESULTS + f"SELECT case_id, a, b FROM results WHERE {_GOOD} AND b > 0")
def _(t):
    return _good(t).where("b > 0").select("case_id", "a", "b")


@query("jn_14_definition_fallback", RESULTS + "SELECT r.case_id, coalesce(d.gate, r.mode) AS gate FROM results r LEFT JOIN (SELECT * FROM defaults WHERE mode <> 'none') d USING (category)")
def _(t):
    current = t.defaults.where("mode <> 'none'").select("category", F.col("gate").alias("current"))
    return t.results.join(current, "category", "left").select("case_id", F.coalesce("current", "mode").alias("gate"))


@query("agg_06_mean", RESULTS + f"SELECT category, round(coalesce(avg(a) FILTER ({_GOOD}), 0), 4) AS mean FROM results GROUP BY category")
def _(t):
    return t.results.groupBy("category").agg(F.round(st.mean(F.when(~F.col("inconclusive"), F.col("a"))), 4).alias("mean"))


@query("agg_07_sd", RESULTS + "SELECT run, category, round(coalesce(stddev_samp(a), 0), 4) AS sd FROM results GROUP BY run, category")
def _(t):
    return t.results.groupBy("run", "category").agg(F.round(st.sd(F.col("a")), 4).alias("sd"))


@query("agg_08_confidence_interval", RESULTS + f"SELECT run, category, {_SUM.format(x='a')} FROM results GROUP BY run, category")
def _(t):
    return t.results.groupBy("run", "category").agg(*st.summary(F.col("a"), "a"))


_VECTORS = RESULTS + f""", v AS (SELECT run, category, CAST(sum(a) AS DOUBLE) / count(*) AS a, CAST(sum(b) AS DOUBLE) / count(*) AS b FROM results WHERE {_GOOD} GROUP BY run, category)
"""


def _vectors(t):
    return _good(t).groupBy("run", "category").agg((F.sum("a").cast("double") / F.count("*")).alias("a"), (F.sum("b").cast("double") / F.count("*")).alias("b"))


@query("agg_09_paired_test", _VECTORS + """, d AS (SELECT category, count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS s FROM v GROUP BY category),
w AS (SELECT *, m / (s / sqrt(n)) AS t, atan(abs(m / (s / sqrt(n))) / sqrt(n - 1)) AS th FROM d),
y AS (SELECT *, CASE n - 1 WHEN 2 THEN sin(th) WHEN 4 THEN sin(th) * (1 + cos(th) ** 2 / 2) WHEN 6 THEN sin(th) * (1 + cos(th) ** 2 / 2 + 3 * cos(th) ** 4 / 8)
  WHEN 5 THEN 2 / pi() * (th + sin(th) * (cos(th) + 2 * cos(th) ** 3 / 3)) WHEN 3 THEN 2 / pi() * (th + sin(th) * cos(th)) END AS inside FROM w)
SELECT category, n, round(m, 4) AS mean_diff, round(s, 4) AS sd_diff, round(t, 4) AS t, round(greatest(0, least(1, 1 - inside)), 6) AS p, 1 - inside < 0.05 AS significant FROM y""")
def _(t):
    return _vectors(t).groupBy("category").agg(*st.paired_test(F.col("a"), F.col("b")))


@query("agg_10_summary", RESULTS + f"SELECT category, {_SUM.format(x='a')}, {_SUM.format(x='b')} FROM results WHERE {_GOOD} GROUP BY category")
def _(t):
    return _good(t).groupBy("category").agg(*st.summary(F.col("a"), "a"), *st.summary(F.col("b"), "b"))


@query("agg_11_headline", RESULTS + f"""SELECT count(*) AS n, round(avg(a), 4) AS a_mean, round(avg(b), 4) AS b_mean, round(avg(a) - avg(b), 4) AS delta,
round(avg(a) FILTER ({_GOOD}), 4) AS a_conclusive, count(*) FILTER (inconclusive) AS inconclusive FROM results""")
def _(t):
    return t.results.agg(
        F.count("*").alias("n"), F.round(F.avg("a"), 4).alias("a_mean"), F.round(F.avg("b"), 4).alias("b_mean"), F.round(F.avg("a") - F.avg("b"), 4).alias("delta"),
        F.round(F.avg(F.when(~F.col("inconclusive"), F.col("a"))), 4).alias("a_conclusive"), F.count_if("inconclusive").alias("inconclusive"),
    )


@query("agg_12_label_axes", RESULTS + f"""SELECT coalesce(category, purpose, gate) AS label, CASE WHEN category IS NOT NULL THEN 'category' WHEN purpose IS NOT NULL THEN 'purpose' ELSE 'gate' END AS axis,
count(*) AS n, round(avg(a) FILTER ({_GOOD}), 4) AS a_mean, round(avg(b) FILTER ({_GOOD}), 4) AS b_mean FROM results GROUP BY GROUPING SETS ((category), (purpose), (gate))""")
def _(t):
    good = lambda c: F.round(F.avg(F.when(~F.col("inconclusive"), F.col(c))), 4).alias(f"{c}_mean")
    axes = [[F.col("category")], [F.col("purpose")], [F.col("gate")]]
    g = t.results.groupingSets(axes, "category", "purpose", "gate").agg(F.count("*").alias("n"), good("a"), good("b"))
    axis = F.when(F.col("category").isNotNull(), "category").when(F.col("purpose").isNotNull(), "purpose").otherwise("gate")
    return g.select(F.coalesce("category", "purpose", "gate").alias("label"), axis.alias("axis"), "n", "a_mean", "b_mean")


@query("agg_13_by_suite", RESULTS + _SUITES + "SELECT suite, count(*) AS n, round(avg(a), 4) AS a_mean FROM (SELECT unnest(suites) AS suite, a FROM s) GROUP BY suite")
def _(t):
    return _suites(t).select(F.explode("suites").alias("suite"), "a").groupBy("suite").agg(F.count("*").alias("n"), F.round(F.avg("a"), 4).alias("a_mean"))


@query("agg_14_pass_rate", RESULTS + "SELECT run, round(count(*) FILTER (a >= 50) / count(*), 4) AS a_rate, round(count(*) FILTER (b >= 50 AND NOT inconclusive) / nullif(count(*) FILTER (NOT inconclusive), 0), 4) AS b_rate FROM results GROUP BY run")
def _(t):
    good = F.count_if(~F.col("inconclusive"))
    return t.results.groupBy("run").agg(
        F.round(F.count_if(F.col("a") >= 50) / F.count("*"), 4).alias("a_rate"),
        F.round(F.count_if((F.col("b") >= 50) & ~F.col("inconclusive")) / F.nullif(good, F.lit(0)), 4).alias("b_rate"),
    )


_MODE = "CASE WHEN {0} < 20 THEN 'omission' WHEN {0} < 40 THEN 'shallow' ELSE 'none' END"


@query("agg_15_failure_modes", RESULTS + f"SELECT arm, mode, count(*) AS n FROM (SELECT 'a' AS arm, {_MODE.format('a')} AS mode FROM results UNION ALL SELECT 'b', {_MODE.format('b')} FROM results) GROUP BY arm, mode")
def _(t):
    x = t.results.select(F.expr("stack(2, 'a', a, 'b', b) as (arm, score)"))
    mode = F.when(F.col("score") < 20, "omission").when(F.col("score") < 40, "shallow").otherwise("none")
    return x.groupBy("arm", mode.alias("mode")).agg(F.count("*").alias("n"))


@query("agg_16_process_metrics", RESULTS + "SELECT run, round(avg(lines), 4) AS mean_lines, round(avg(CASE WHEN outcome = 'P' THEN 1 ELSE 0 END), 4) AS hitl_rate, round(avg(CASE WHEN b > 0 THEN a / b END), 4) AS ratio FROM results GROUP BY run")
def _(t):
    return t.results.groupBy("run").agg(
        F.round(F.avg("lines"), 4).alias("mean_lines"), F.round(F.avg((F.col("outcome") == "P").cast("int")), 4).alias("hitl_rate"),
        F.round(F.avg(F.when(F.col("b") > 0, F.col("a") / F.col("b"))), 4).alias("ratio"),
    )


@query("agg_19_conclusive_n", RESULTS + f"SELECT gate, count(*) FILTER ({_GOOD}) AS n FROM results GROUP BY gate")
def _(t):
    return t.results.groupBy("gate").agg(F.count_if(~F.col("inconclusive")).alias("n"))


@query("agg_20_null_rules", RESULTS + f"SELECT category, round(avg(CASE WHEN {_GOOD} THEN a END), 4) AS without, round(avg(coalesce(CASE WHEN {_GOOD} THEN a END, 0)), 4) AS as_zero FROM results GROUP BY category")
def _(t):
    x = F.when(~F.col("inconclusive"), F.col("a"))
    return t.results.groupBy("category").agg(F.round(F.avg(x), 4).alias("without"), F.round(F.avg(F.coalesce(x, F.lit(0))), 4).alias("as_zero"))


@query("agg_21_run_vectors", _VECTORS + "SELECT run, category, round(a, 4) AS a, round(b, 4) AS b FROM v")
def _(t):
    return _vectors(t).select("run", "category", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


_AXES = RESULTS + _SUITES + f""", long AS (SELECT run, axis, label, a, b FROM (SELECT run, a, b, suites, unnest([
  {{'axis': 'category', 'label': category}}, {{'axis': 'purpose', 'label': purpose}}, {{'axis': 'gate', 'label': gate}}], recursive := true) FROM s WHERE {_GOOD})
  UNION ALL SELECT run, 'suite', unnest(suites), a, b FROM s WHERE {_GOOD}),
v AS (SELECT run, axis, label, CAST(sum(a) AS DOUBLE) / count(*) AS a, CAST(sum(b) AS DOUBLE) / count(*) AS b FROM long GROUP BY ALL)
"""


@query("agg_22_multi_run_summary", _AXES + f""", d AS (SELECT axis, label, {_SUM.format(x='a')}, {_SUM.format(x='b')}, count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS s FROM v GROUP BY axis, label),
w AS (SELECT *, m / (s / sqrt(n)) AS t, atan(abs(m / (s / sqrt(n))) / sqrt(n - 1)) AS th FROM d),
y AS (SELECT *, CASE n - 1 WHEN 2 THEN sin(th) WHEN 4 THEN sin(th) * (1 + cos(th) ** 2 / 2) WHEN 6 THEN sin(th) * (1 + cos(th) ** 2 / 2 + 3 * cos(th) ** 4 / 8)
  WHEN 5 THEN 2 / pi() * (th + sin(th) * (cos(th) + 2 * cos(th) ** 3 / 3)) WHEN 3 THEN 2 / pi() * (th + sin(th) * cos(th)) END AS inside FROM w)
SELECT axis, label, a_n, a_mean, a_sd, a_ci, b_n, b_mean, b_sd, b_ci, n, round(m, 4) AS mean_diff, round(s, 4) AS sd_diff, round(t, 4) AS t, round(greatest(0, least(1, 1 - inside)), 6) AS p, 1 - inside < 0.05 AS significant FROM y""")
def _(t):
    """Both arms over the runs, and the paired test between them, for each label of each axis."""
    x = _suites(t).where("not inconclusive")
    pair = lambda axis, c: F.struct(F.lit(axis).alias("axis"), c.alias("label"))
    plain = F.array(*[pair(c, F.col(c)) for c in ("category", "purpose", "gate")])
    x = x.select("run", "a", "b", F.inline(F.concat(plain, F.transform("suites", lambda s: pair("suite", s)))))
    v = x.groupBy("run", "axis", "label").agg((F.sum("a").cast("double") / F.count("*")).alias("a"), (F.sum("b").cast("double") / F.count("*")).alias("b"))
    return v.groupBy("axis", "label").agg(*st.summary(F.col("a"), "a"), *st.summary(F.col("b"), "b"), *st.paired_test(F.col("a"), F.col("b")))


@query("agg_23_first_run_cardinality", RESULTS + "SELECT category, count(*) AS n FROM results WHERE run = (SELECT min(run) FROM results) GROUP BY category")
def _(t):
    first = t.table("orders").agg(F.min(F.year("o_orderdate")).alias("run"))
    return t.results.join(F.broadcast(first), "run").groupBy("category").agg(F.count("*").alias("n"))


@query("agg_31_pair_worst_of", RESULTS + "SELECT category, round(least(avg(CASE WHEN a >= 50 THEN 1 ELSE 0 END), avg(CASE WHEN b < 50 THEN 1 ELSE 0 END)), 4) AS worst FROM results GROUP BY category")
def _(t):
    rate = lambda c: F.avg(c.cast("int"))
    return t.results.groupBy("category").agg(F.round(F.least(rate(F.col("a") >= 50), rate(F.col("b") < 50)), 4).alias("worst"))


@query("agg_32_layer_gating", RESULTS + """SELECT category, round(avg(CASE WHEN a >= 30 THEN 1 ELSE 0 END), 4) AS layer1, round(avg(CASE WHEN a >= 30 THEN CASE WHEN b >= 30 THEN 1 ELSE 0 END END), 4) AS layer2,
round(avg(CASE WHEN a >= 30 AND b >= 30 THEN CASE WHEN lines > 3 THEN 1 ELSE 0 END END), 4) AS layer3, count(*) FILTER (a < 30) AS blocked FROM results GROUP BY category""")
def _(t):
    one, two, three = F.col("a") >= 30, F.col("b") >= 30, F.col("lines") > 3
    rate = lambda c: F.round(F.avg(c), 4)
    return t.results.groupBy("category").agg(
        rate(one.cast("int")).alias("layer1"), rate(F.when(one, two.cast("int"))).alias("layer2"),
        rate(F.when(one & two, three.cast("int"))).alias("layer3"), F.count_if(~one).alias("blocked"),
    )


@query("agg_33_dose_response", RESULTS + ", x AS (SELECT lines AS dose, sum(a) AS s, count(*) AS n FROM results GROUP BY lines) SELECT dose, round(s / n, 4) AS quality, round(s / n - lag(s / n) OVER (ORDER BY dose), 4) AS slope FROM x")
def _(t):
    x = t.results.groupBy(F.col("lines").alias("dose")).agg((F.sum("a") / F.count("*")).alias("q"))
    slope = F.col("q") - F.lag("q").over(Window.orderBy("dose"))
    return x.select("dose", F.round("q", 4).alias("quality"), F.round(slope, 4).alias("slope"))


# Each case is a steering test: its priority says how strongly it is steered, its harness where, its judge's agreement the polarity.
_STEERED = """, tests AS (SELECT category, run, CASE WHEN lines <= 2 THEN 'light' WHEN lines <= 4 THEN 'moderate' ELSE 'heavy' END AS intensity,
  CASE WHEN outcome = 'F' THEN 'body' WHEN outcome = 'O' THEN 'skill' ELSE 'tool' END AS location, NOT inconclusive AS positive, a >= 45 AS passed FROM results)
"""
_CELL = "coalesce(bool_and({1}passed) FILTER ({0}), false)"


def _cell(cell, want):
    return _CELL.format(cell, "" if want else "NOT ")


@query("agg_42_root_cause", RESULTS + _STEERED + f"""SELECT category, run, intensity AS level, count(*) AS tests, CASE WHEN {_cell('positive', True)} AND {_cell('NOT positive', True)} THEN 'healthy' WHEN {_cell('true', False)} THEN 'not propagating'
WHEN {_cell("intensity IN ('moderate', 'heavy') AND positive", True)} AND {_cell("intensity IN ('moderate', 'heavy') AND NOT positive", False)} THEN 'over-steering'
WHEN {_cell("intensity = 'light' AND positive", False)} AND {_cell("intensity = 'moderate' AND positive", False)} AND {_cell("intensity = 'heavy' AND positive", True)} THEN 'diluted directives'
WHEN {_cell("location = 'body'", False)} AND {_cell("location <> 'body'", True)} THEN 'body drowned out' WHEN {_cell("location <> 'body'", False)} THEN 'descriptions underweighted' ELSE 'unclear' END AS cause
FROM tests GROUP BY GROUPING SETS ((category, run), (category, run, intensity))""")
def _(t):
    """The cause that each category's pattern of passes points at in a run, over all intensities and for each of them."""
    level = F.when(F.col("lines") <= 2, "light").when(F.col("lines") <= 4, "moderate").otherwise("heavy")
    place = F.when(F.col("outcome") == "F", "body").when(F.col("outcome") == "O", "skill").otherwise("tool")
    tests = t.results.select("category", "run", level.alias("intensity"), place.alias("location"), (~F.col("inconclusive")).alias("positive"), (F.col("a") >= 45).alias("passed"))
    views = F.array(F.lit(None).cast("string"), F.col("intensity"))
    return gr.root_cause(tests.withColumn("level", F.explode(views)), ["category", "run", "level"])


@query("agg_05_rubric_composite", RESULTS + "SELECT case_id, floor((least(a, 90) / 90 * 0.25 + least(b, 90) / 90 * 0.25 + least(lines, 3) / 3 * 0.25 + 0.25) * 1000 + 0.5) / 1000 AS composite FROM results")
def _(t):
    parts = F.least("a", F.lit(90)) / 90 * 0.25 + F.least("b", F.lit(90)) / 90 * 0.25 + F.least("lines", F.lit(3)) / 3 * 0.25 + 0.25
    return t.results.select("case_id", (F.floor(parts * 1000 + 0.5) / 1000).alias("composite"))


@query("win_17_position_bias", JUDGED + "SELECT case_id, (a1 > b1) <> (a2 > b2) AS biased FROM judged")
def _(t):
    """The preferred arm changes with the order in which the two are shown."""
    return t.judged.select("case_id", ((F.col("a1") > F.col("b1")) != (F.col("a2") > F.col("b2"))).alias("biased"))


@query("gr_05_failing_gated", GRADED + "SELECT case_id, 'f' || k AS step, aspect FROM bad")
def _(t):
    """Failing steps of aspects that the case gates: all of them, or those that its assertions and skills name."""
    numbered = F.transform("grades", lambda g, i: F.struct(g["aspect"].alias("aspect"), g["severity"].alias("severity"), F.concat(F.lit("f"), (i + 1).cast("string")).alias("step")))
    x = t.graded.select("case_id", F.inline(gr.failing(F.col("case"), numbered)))
    return x.select("case_id", "step", "aspect")


@query("gr_06_pass_fail", GRADED + "SELECT case_id, len(reasons) = 0 AS passed, CASE WHEN len(reasons) = 0 THEN 'All criteria met' ELSE array_to_string(reasons, '; ') END AS reason FROM said WHERE arm = 'harness'")
def _(t):
    return t.graded.select("case_id", gr.grade(F.col("case"), F.col("harness_matched"), F.col("harness_judge"), F.col("grades")).alias("x")).select("case_id", "x.*")


@query("gr_07_regrade", GRADED + """, p AS (SELECT case_id, arm, len(reasons) = 0 AS passed, CASE WHEN len(reasons) = 0 THEN 'All criteria met' ELSE array_to_string(reasons, '; ') END AS reason FROM said)
SELECT h.case_id, h.passed AS harness_pass, b.passed AS baseline_pass, h.reason AS harness_reason, b.reason AS baseline_reason FROM p h JOIN p b USING (case_id) WHERE h.arm = 'harness' AND b.arm = 'baseline'""")
def _(t):
    """Both arms graded anew by the case's criteria."""
    output = {c: F.col(c) for c in ("harness_matched", "baseline_matched", "harness_judge", "baseline_judge", "grades")}
    x = t.graded.select("case_id", gr.grade_both(F.col("case"), output).alias("x"))
    return x.select("case_id", *[F.col(f"x.{arm}.{k}").alias(f"{arm}_{as_}") for k, as_ in (("passed", "pass"), ("reason", "reason")) for arm in ("harness", "baseline")])


@query("gr_08_clean_win", RESULTS + "SELECT case_id, a > b AND outcome <> 'F' AS better_but_gated FROM results")
def _(t):
    return t.results.select("case_id", ((F.col("a") > F.col("b")) & (F.col("outcome") != "F")).alias("better_but_gated"))


@query("gr_09_judge_verdict", JUDGED + f"""SELECT case_id, floor((a1 + a2) / 2 * 1000 + 0.5) / 1000 AS a, floor((b1 + b2) / 2 * 1000 + 0.5) / 1000 AS b, (a1 > b1) <> (a2 > b2) AS inconclusive,
coalesce(nullif({_MODE.format('a1')}, 'none'), {_MODE.format('a2')}) AS a_mode, coalesce(nullif({_MODE.format('b1')}, 'none'), {_MODE.format('b2')}) AS b_mode FROM judged""")
def _(t):
    """Both orderings averaged; inconclusive if they disagree; the first ordering's failure mode unless it has none."""
    mean = lambda c: F.floor((F.col(f"{c}1") + F.col(f"{c}2")) / 2 * 1000 + 0.5) / 1000
    mode = lambda c: F.when(F.col(c) < 20, "omission").when(F.col(c) < 40, "shallow").otherwise("none")
    merged = lambda c: F.coalesce(F.nullif(mode(f"{c}1"), F.lit("none")), mode(f"{c}2"))
    bias = (F.col("a1") > F.col("b1")) != (F.col("a2") > F.col("b2"))
    return t.judged.select("case_id", mean("a").alias("a"), mean("b").alias("b"), bias.alias("inconclusive"), merged("a").alias("a_mode"), merged("b").alias("b_mode"))


@query("set_05_identical_task_sets", RESULTS + """, ids AS (SELECT DISTINCT run, category || '/' || lines AS task FROM results), first AS (SELECT task FROM ids WHERE run = (SELECT min(run) FROM ids))
SELECT *, missing = 0 AND extra = 0 AS same FROM (SELECT r.run, (SELECT count(*) FROM first WHERE task NOT IN (SELECT task FROM ids i WHERE i.run = r.run)) AS missing,
  (SELECT count(*) FROM ids i WHERE i.run = r.run AND task NOT IN (SELECT task FROM first)) AS extra FROM (SELECT DISTINCT run FROM ids) r)""")
def _(t):
    """Each run's task ids against the first run's: how many it lacks, how many it has besides."""
    ids = t.results.select("run", F.concat_ws("/", "category", F.col("lines").cast("string")).alias("task")).distinct()
    first = t.results.agg(F.min("run").alias("run"))
    first = ids.join(F.broadcast(first), "run", "left_semi").select("task", F.lit(True).alias("known"))
    own = ids.join(first, "task", "left").groupBy("run").agg(F.count_if("known").alias("shared"), F.count_if(F.col("known").isNull()).alias("extra"))
    x = own.join(F.broadcast(first.agg(F.count("*").alias("all"))), F.lit(True))
    missing = F.col("all") - F.col("shared")
    return x.select("run", missing.alias("missing"), "extra", ((missing == 0) & (F.col("extra") == 0)).alias("same"))


@query("snk_06_report_tables", RESULTS + "SELECT run, case_id, category, a, b, a - b AS delta FROM results")
def _(t):
    return t.results.select("run", "case_id", "category", "a", "b", (F.col("a") - F.col("b")).alias("delta"))


@query("fn_16_round3", RESULTS + "SELECT case_id, floor(a / 7.0::DOUBLE * 1000 + 0.5) / 1000 AS r FROM results")
def _(t):
    return t.results.select("case_id", (F.floor(F.col("a") / F.lit(7.0) * 1000 + 0.5) / 1000).alias("r"))


@query("fn_19_failure_mode_merge", RESULTS + f"SELECT case_id, coalesce(nullif({_MODE.format('a')}, 'none'), {_MODE.format('b')}) AS mode FROM results")
def _(t):
    mode = lambda c: F.when(F.col(c) < 20, "omission").when(F.col(c) < 40, "shallow").otherwise("none")
    return t.results.select("case_id", F.coalesce(F.nullif(mode("a"), F.lit("none")), mode("b")).alias("mode"))


@query("fn_24_badges", _VECTORS + """, d AS (SELECT category, count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS s, avg(a) / avg(b) AS ratio FROM v GROUP BY category),
w AS (SELECT *, atan(abs(m / (s / sqrt(n))) / sqrt(n - 1)) AS th FROM d),
y AS (SELECT *, m / 100 AS x, 1 - CASE n - 1 WHEN 2 THEN sin(th) WHEN 4 THEN sin(th) * (1 + cos(th) ** 2 / 2) WHEN 6 THEN sin(th) * (1 + cos(th) ** 2 / 2 + 3 * cos(th) ** 4 / 8)
  WHEN 5 THEN 2 / pi() * (th + sin(th) * (cos(th) + 2 * cos(th) ** 3 / 3)) WHEN 3 THEN 2 / pi() * (th + sin(th) * cos(th)) END AS p FROM w)
SELECT category, CASE WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS marker, CASE WHEN p < 0.001 THEN '< .001' WHEN p < 0.01 THEN '< .01' ELSE format('{:.3f}', floor(p * 1000 + 0.5) / 1000) END AS p,
CASE WHEN x > 0.05 THEN '\u25b2' WHEN x < -0.05 THEN '\u25bc' ELSE '\u2192' END || CASE WHEN x >= 0 THEN ' +' ELSE ' -' END || format('{:.1f}', floor(abs(x) * 1000 + 0.5) / 10) || 'pp' AS delta,
CASE WHEN ratio > 1.5 THEN 'high' WHEN ratio < 0.8 THEN 'low' END AS pressure FROM y""")
def _(t):
    """How a category's difference is shown: its significance, its p-value, its size, and a note on the ratio of both arms."""
    x = _vectors(t).groupBy("category").agg(st.paired_p(F.col("a"), F.col("b")).alias("p"), (F.avg(F.col("a") - F.col("b")) / 100).alias("d"), (F.avg("a") / F.avg("b")).alias("ratio"))
    p = F.col("p")
    return x.select("category", st.significance(p).alias("marker"), st.p_label(p).alias("p"), st.delta_badge(F.col("d")).alias("delta"), st.pressure(F.col("ratio")).alias("pressure"))