"""Welch's t-test of retained against churned customers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.functions.numeric import half_up

METRICS = ("order_count", "revenue", "avg_txn_value", "return_rate")


def welch_statistics(metrics: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """Per metric: sizes, means, t statistic and degrees of freedom, from one aggregate."""
    long = metrics.select(
        "is_churned",
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))
            for name in names
        ])),
    ).where(F.col("value").isNotNull())

    def side(churned: bool, label: str) -> list:
        value = F.when(F.col("is_churned") == churned, F.col("value"))
        return [
            F.count(value).alias(f"{label}_n"),
            F.avg(value).alias(f"{label}_avg"),
            F.var_samp(value).alias(f"{label}_var"),
        ]

    sides = long.groupBy("metric").agg(*side(False, "retained"), *side(True, "churned"))
    first = F.col("retained_var") / F.nullif(F.col("retained_n"), F.lit(0))
    second = F.col("churned_var") / F.nullif(F.col("churned_n"), F.lit(0))
    spread = first + second
    freedom = F.try_divide(
        spread * spread,
        F.try_divide(first * first, F.col("retained_n") - 1)
        + F.try_divide(second * second, F.col("churned_n") - 1),
    )
    t = F.try_divide(F.col("retained_avg") - F.col("churned_avg"), F.sqrt(spread))
    return sides.select(
        "metric",
        "retained_n",
        "churned_n",
        "retained_avg",
        "churned_avg",
        t.alias("t"),
        freedom.alias("df"),
    )


# Terms of the continued fraction; it has settled long before for samples of customers.
_TERMS = 500
# Steps by which the argument of the gamma ratio is raised before the series is used.
_RAISED = 10


def _log_gamma_ratio(a: Column) -> Column:
    """log(Gamma(a + 1/2) / Gamma(a)): the asymptotic series at a + 10, brought back by the recursion.

    One difference of small terms instead of two large logarithms, so it is as exact for very many degrees of freedom.
    """
    up = a + _RAISED
    series = (
        0.5 * F.log(up) - 1 / (8 * up) + 1 / (192 * F.pow(up, 3)) - 1 / (640 * F.pow(up, 5)) + 17 / (14336 * F.pow(up, 7))
    )
    for k in range(_RAISED):
        series = series + F.log((a + k) / (a + k + 0.5))
    return series


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function by Lentz's method, as a fold over its terms."""
    def off_zero(value: Column) -> Column:
        return F.when(F.abs(value) > 1e-300, value).otherwise(1e-300)

    def step(state: Column, term: Column) -> Column:
        d = 1 / off_zero(1 + term * state["d"])
        c = off_zero(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["total"] * c * d).alias("total"))

    def both(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return step(step(state, even), odd)

    first = 1 / off_zero(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("total"))
    terms = F.transform(F.sequence(F.lit(1), F.lit(_TERMS)), lambda m: m.cast("double"))
    return F.aggregate(terms, start, both, lambda state: state["total"])


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student's t with `df` degrees of freedom; NaN where either is missing.

    It is the incomplete beta function at df / (df + t^2) with parameters df/2 and 1/2.
    """
    t, df = t.cast("double"), df.cast("double")
    a, half = df / 2, F.lit(0.5)
    # What is left of 1 beside x is computed by itself: for large samples x is close to 1.
    x, rest = df / (df + t * t), t * t / (df + t * t)
    front = F.exp(_log_gamma_ratio(a) - a * F.log1p(t * t / df) + 0.5 * F.log(rest)) / math.sqrt(math.pi)
    direct = front * _fraction(x, a, half) / a
    mirrored = 1 - front * _fraction(rest, half, a) / half
    missing = t.isNull() | df.isNull() | F.isnan(t) | F.isnan(df) | (df <= 0)
    return (
        F.when(missing, F.lit(float("nan")))
        .when(rest <= 0, 1.0)
        .when(x <= 0, 0.0)
        .otherwise(F.when(x < (a + 1) / (a + 2.5), direct).otherwise(mirrored))
    )


def welch_tests(metrics: DataFrame, names: tuple[str, ...] = METRICS, level: float = 0.05) -> DataFrame:
    """The tests with p values and wording."""
    tested = welch_statistics(metrics, names).withColumn("p_value", two_sided_p(F.col("t"), F.col("df")))
    p = F.col("p_value")
    side = F.when(F.col("retained_avg") > F.col("churned_avg"), "higher").otherwise("lower")
    shown = F.when(p < 0.001, "<0.001").otherwise(F.format_string("%.4f", p))
    return tested.select(
        "metric",
        half_up(F.col("retained_avg")).alias("retained_mean"),
        half_up(F.col("churned_avg")).alias("churned_mean"),
        half_up(F.col("t"), 4).alias("t_statistic"),
        "p_value",
        (p < level).alias("significant"),
        F.concat(
            F.lit("Retained customers have "), side, F.lit(" "), F.col("metric"),
            F.lit(" (p="), shown, F.lit(")"),
        ).alias("interpretation"),
    )
