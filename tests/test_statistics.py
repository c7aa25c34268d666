from pyspark.sql import functions as F

from spanloom.functions import statistics as st
from spanloom.operators import windows as w


def test_p_values_match_the_critical_values(spark):
    table = [(12.706, 1), (2.571, 5), (2.365, 7), (2.776445, 4), (2.045, 29), (0.01, 4), (0.0, 3), (50.0, 9)]
    df = spark.createDataFrame(table, "t double, df int").select("t", "df", st.t_p_value(F.col("t"), F.col("df")).alias("p"))
    got = {(r.t, r.df): r.p for r in df.collect()}
    for key in table[:5]:
        assert abs(got[key] - 0.05) < 1e-4, key
    assert abs(got[0.01, 4] - 0.9925) < 1e-4
    assert got[0.0, 3] == 1.0
    assert got[50.0, 9] < 1e-9


def test_p_falls_with_t(spark):
    df = spark.range(1, 60).selectExpr("id / 10 as t").select("t", *[st.t_p_value(F.col("t"), F.lit(d)).alias(f"p{d}") for d in (1, 2, 3, 8, 31)])
    rows = df.orderBy("t").collect()
    for c in df.columns[1:]:
        ps = [r[c] for r in rows]
        assert all(0 <= x <= 1 for x in ps) and ps == sorted(ps, reverse=True)


def test_small_samples(spark):
    rows = [("one", 3.0, 1.0), ("same", 2.0, 1.0), ("same", 3.0, 2.0), ("equal", 1.0, 1.0), ("equal", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double").groupBy("g")
    got = {r.g: r for r in df.agg(*st.paired_test(F.col("a"), F.col("b")), *st.summary(F.col("a"), "a")).collect()}
    assert got["one"].p == 1.0 and got["one"].a_sd == 0.0 and got["one"].a_ci is None
    assert got["same"].p == 0.0 and got["equal"].p == 1.0


def test_streaks_reset_on_success(spark):
    rows = [(1, i, k) for i, k in enumerate("eeexee")] + [(2, i, k) for i, k in enumerate("eexe")]
    df = spark.createDataFrame(rows, "run_id long, at int, kind string")
    got = w.streaks(df, ["run_id"], F.col("kind") == "e", ["at"], 3).collect()
    assert [(r.run_id, r.island, r.length) for r in got] == [(1, 0, 3)]


def test_p_values_of_any_degrees(spark):
    """Against the closed forms for few degrees, and values of the distribution for many."""
    from math import atan, cos, pi, sin, sqrt

    def closed(t, df):
        """The finite series in sine and cosine of the angle, term by term."""
        a = atan(abs(t) / sqrt(df))
        term, total = (cos(a), cos(a)) if df % 2 else (1.0, 1.0)
        for k in range(3 if df % 2 else 2, df - 1, 2):
            term *= cos(a) ** 2 * (k - 1) / k
            total += term
        inside = 2 * a / pi if df == 1 else 2 / pi * (a + sin(a) * total) if df % 2 else sin(a) * total
        return 1 - inside

    cases = [(t, d) for d in (1, 2, 3, 4, 9, 10, 29, 30, 1001, 10_001, 1_000_000) for t in (0.0, 0.01, 0.5, 1.2, 1.7, 1.74, 1.9, 2.5, 4.0, 12.0)]
    df = spark.createDataFrame(cases, "t double, df long").select("t", "df", st.t_p_value(F.col("t"), F.col("df")).alias("p"))
    for r in df.collect():
        assert abs(r.p - closed(r.t, r.df)) < 1e-9, r
    labels = spark.createDataFrame([(0.0004,), (0.001,), (0.0495,), (0.5,)], "p double").select(st.p_label(F.col("p")).alias("x"))
    assert [r.x for r in labels.collect()] == ["< .001", "< .01", "0.050", "0.500"]


def test_kappa_of_many_raters(spark):
    """The textbook case of ten items, fourteen raters and five labels."""
    table = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]
    rows = [(i, label, n) for i, row in enumerate(table) for label, n in enumerate(row) if n]
    got = st.fleiss_kappa(spark.createDataFrame(rows, "item int, label int, n long"), ["item"]).first()
    assert (got.raters, got.items, round(got.kappa, 3), got.majority) == (14, 10, 0.21, 0.3)
    same = st.fleiss_kappa(spark.createDataFrame([(1, 0, 3), (2, 0, 3)], "item int, label int, n long"), ["item"]).first()
    assert same.kappa == 1.0 and same.majority == 1.0
