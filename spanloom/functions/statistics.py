"""Statistics as Columns for any groupBy: summaries, intervals, the paired t-test, kappa."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two-sided 95 % critical values of Student's t for 1 to 29 degrees of freedom.
T_95 = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.16, 2.145, 2.131,
    2.12, 2.11, 2.101, 2.093, 2.086, 2.08, 2.074, 2.069, 2.064, 2.06, 2.056, 2.052, 2.048, 2.045,
]
Z_95 = 1.96
#: Terms of the continued fraction, each of two steps: it is settled to 1e-11 by then.
TERMS = 60


def mean(x: Column) -> Column:
    """0 on no values."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def sd(x: Column) -> Column:
    """Of a sample; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def t_critical(df: Column) -> Column:
    table = F.array(*[F.lit(v) for v in T_95])
    return F.when(df <= len(T_95), F.get(table, df.cast("int") - 1)).otherwise(Z_95)


def half_width(x: Column) -> Column:
    """Half the 95 % interval of the mean; null for one value, 0 for none."""
    n = F.count(x)
    return F.when(n == 0, 0.0).when(n > 1, t_critical(n - 1) * F.stddev_samp(x) / F.sqrt(n))


def summary(x: Column, name: str) -> list[Column]:
    return [
        F.count(x).alias(f"{name}_n"), F.round(mean(x), 4).alias(f"{name}_mean"), F.round(sd(x), 4).alias(f"{name}_sd"),
        F.round(half_width(x), 4).alias(f"{name}_ci"),
    ]


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    first = 1 / (1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def step(acc: Column, term: Column) -> Column:
        d, c = 1 / (1 + term * acc["d"]), 1 + term / acc["c"]
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    def both(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return step(step(acc, even), odd)

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, both)["h"]


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): by its recurrence from a + 16, where the asymptotic series is exact to 1e-12."""
    z = a + 16
    # The series in 1 / z.
    series = F.lit(1.0)
    for k, c in enumerate((-1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304), 1):
        series = series + F.lit(c) / F.pow(z, F.lit(k))
    down = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(1.0), lambda acc, k: acc * (a + k) / (a + k + 0.5))
    return down * F.sqrt(z) * series


def t_p_value(t: Column, df: Column) -> Column:
    """Two-tailed p of Student's t for any number of degrees of freedom: the regularised incomplete beta function
    of df / (df + t^2), by its continued fraction on the side where that converges fast."""
    a, t2 = df / 2, t * t
    x, y = df / (df + t2), t2 / (df + t2)
    front = F.exp(-a * F.log1p(t2 / df)) * F.sqrt(y) * _gamma_ratio(a) / math.sqrt(math.pi)
    tail = front * _fraction(a, F.lit(0.5), x) / a
    inside = front * _fraction(F.lit(0.5), a, y) / 0.5
    p = F.when(x < (a + 1) / (a + 2.5), tail).otherwise(1 - inside)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def paired_p(a: Column, b: Column) -> Column:
    """The p-value of the paired t-test, as an aggregate."""
    d = a - b
    n, m, s = F.count(d), F.avg(d), F.stddev_samp(d)
    t = m / F.when(s > 0, s / F.sqrt(n))
    return F.when(n < 2, 1.0).when(s == 0, F.when(m == 0, 1.0).otherwise(0.0)).otherwise(t_p_value(t, n - 1))


def paired_test(a: Column, b: Column, name: str = "") -> list[Column]:
    """Mean and sd of the differences, t, p and whether p < 0.05. Fewer than two pairs give p 1; no
    spread gives p 1 for no difference and 0 otherwise."""
    d = a - b
    n, m, s = F.count(d), F.avg(d), F.stddev_samp(d)
    t, p = m / F.when(s > 0, s / F.sqrt(n)), paired_p(a, b)
    return [
        n.alias(f"{name}n"), F.round(m, 4).alias(f"{name}mean_diff"), F.round(s, 4).alias(f"{name}sd_diff"),
        F.round(t, 4).alias(f"{name}t"), F.round(p, 6).alias(f"{name}p"), (p < 0.05).alias(f"{name}significant"),
    ]


def p_label(p: Column) -> Column:
    """How a p-value is written: small ones by their bound, others with three decimals."""
    return F.when(p < 0.001, "< .001").when(p < 0.01, "< .01").otherwise(F.format_string("%.3f", F.floor(p * 1000 + 0.5) / 1000))


def significance(p: Column) -> Column:
    return F.when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def delta_badge(d: Column) -> Column:
    """A difference in percentage points, signed, behind an arrow: up or down beyond five points, else level."""
    arrow = F.when(d > 0.05, "\u25b2").when(d < -0.05, "\u25bc").otherwise("\u2192")
    size = F.format_string("%.1f", F.floor(F.abs(d) * 1000 + 0.5) / 10)
    return F.when(d.isNull(), "N/A").otherwise(F.concat(arrow, F.lit(" "), F.when(d >= 0, "+").otherwise("-"), size, F.lit("pp")))


def pressure(ratio: Column) -> Column:
    """Whether tokens used against the baseline's are worth a note."""
    return F.when(ratio > 1.5, "high").when(ratio < 0.8, "low")


def interval(x: Column) -> list[Column]:
    """Lower and upper end of the 95 % interval of the mean."""
    half = F.coalesce(half_width(x), F.lit(0.0))
    return [(mean(x) - half).alias("lower"), (mean(x) + half).alias("upper")]


def fleiss_kappa(counts: DataFrame, item: list[str]) -> DataFrame:
    """``raters, items, kappa, majority`` from ``counts`` (columns ``item``, ``label, n``: how many raters gave the
    item that label): agreement beyond chance of any number of raters and labels, and the share of items on which more
    than half agree. Items with the most common number of raters count, as the measure asks for equally many;
    kappa is 1 if all ratings are the same label, null without items of two raters or more."""
    of_item = counts.groupBy(*item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"), F.max("n").alias("most"))
    sized = of_item.groupBy("r").agg(F.count("*").alias("items"), F.sum("same").alias("same"), F.count_if(2 * F.col("most") > F.col("r")).alias("major"))
    sized = sized.where("r > 1").groupBy().agg(F.max_by(F.struct("r", "items", "same", "major"), F.struct("items", "r")).alias("x")).select("x.*")
    labels = counts.join(of_item.select(*item, "r"), item).groupBy("r", "label").agg(F.sum("n").alias("n")).groupBy("r").agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"))
    x = sized.join(labels, "r")
    total = F.col("items") * F.col("r")
    chance, seen = F.col("squares") / (total * total), F.col("same") / (total * (F.col("r") - 1))
    kappa = F.when(chance == 1, 1.0).otherwise((seen - chance) / (1 - chance))
    return x.select(F.col("r").alias("raters"), "items", kappa.alias("kappa"), (F.col("major") / F.col("items")).alias("majority"))
