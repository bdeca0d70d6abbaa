"""Two-sample tests per (label, feature) between the before and the after side.

All distribution tests read one table of distinct values with a count per side, so raw rows are combined on the
map side and shuffled once. Every test returns ``(label, feature, test, stat, p_value, drift)`` plus its own columns.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.functions.columns import unpivot_stats
from shiftwise.functions.numeric import anderson_darling_sigma, ks_exact_p
from shiftwise.operators.ordered import index_rows, prefix_sums
from shiftwise.operators.prep import min_max_value
from shiftwise.operators.profile import bin_number, long_form
from shiftwise.session import cut_lineage

GROUP = ["label", "feature"]
EPS = 1e-10
EXACT_ROWS = 500  # of the larger side, up to which KS p-values are exact
# The names of the tests.
ALL_TESTS = [
    "kolmogorov_smirnov", "kullback_leibler", "wasserstein", "jensen_shannon", "spearman", "anderson_darling"
]


def side_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """``(label, feature, value, n_before, n_after)`` over the distinct values of both sides."""
    long = long_form(df, features, ["side", "label"])
    old = (F.col("side") == "before").cast("long")
    return long.groupBy(*GROUP, "value").agg(F.sum(old).alias("n_before"), F.sum(1 - old).alias("n_after"))


def side_cdfs(df: DataFrame, features: list[str], rows_per_slice: int | None = None) -> DataFrame:
    """``side_counts`` with running and total counts per side and the next larger value of the group."""
    return prefix_sums(
        side_counts(df, features), GROUP, ["value"],
        {"before": F.col("n_before"), "after": F.col("n_after")}, rows_per_slice, following="next_value",
    )


def kolmogorov_tail(t: Column) -> Column:
    """P(K > t) of the Kolmogorov limit distribution."""
    series = sum([(-1.0) ** (k - 1) * F.exp(-2.0 * k * k * t * t) for k in range(1, 21)], F.lit(0.0))
    return F.when(t < 0.3, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def _result(df: DataFrame, test: str, drift: Column, *extra: str) -> DataFrame:
    cols = df.columns
    return df.select(
        *GROUP,
        F.lit(test).alias("test"),
        "stat",
        (F.col("p_value") if "p_value" in cols else F.lit(None).cast("double")).alias("p_value"),
        F.coalesce(drift, F.lit(False)).alias("drift"),
        *extra,
    )


def cdf_summary(cdfs: DataFrame) -> DataFrame:
    """One pass over the distinct values: ``distance`` (KS), ``area`` (Wasserstein, raw units) and ``raw``
    (Anderson-Darling with midranks, not yet standardised) per (label, feature)."""
    n1, n2 = F.col("before_total").cast("double"), F.col("after_total").cast("double")
    gap = F.abs(F.col("before_upto") / n1 - F.col("after_upto") / n2)
    total = n1 + n2
    here = F.col("n_before") + F.col("n_after")
    at = F.col("before_upto") + F.col("after_upto") - here / 2.0
    spread = at * (total - at) - total * here / 4.0

    def part(side: str, n: Column) -> Column:
        dev = total * (F.col(f"{side}_upto") - F.col(f"n_{side}") / 2.0) - at * n
        return F.when(spread > 0, here / total * dev * dev / spread / n).otherwise(0.0)

    return cdfs.groupBy(*GROUP).agg(
        F.max(gap).alias("distance"),
        F.coalesce(F.sum(gap * (F.col("next_value") - F.col("value"))), F.lit(0.0)).alias("area"),
        (F.sum(part("before", n1) + part("after", n2)) * F.max((total - 1) / total)).alias("raw"),
        F.max("before_total").alias("n1"),
        F.max("after_total").alias("n2"),
        F.count(F.lit(1)).alias("distinct_values"),
    )


@F.pandas_udf(T.DoubleType())
def _ks_exact(n1: pd.Series, n2: pd.Series, distance: pd.Series) -> pd.Series:
    return pd.Series([ks_exact_p(int(a), int(b), float(d)) for a, b, d in zip(n1, n2, distance)], dtype=float)


def ks_test(summary: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Largest distance of the two step functions.

    The p-value is exact where no side has more than ``EXACT_ROWS`` rows, else from the limit distribution.
    """
    size = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    small = (F.greatest("n1", "n2") <= EXACT_ROWS) & (F.least("n1", "n2") > 0)
    # Only small sides reach the exact count: the others come as empty ones.
    exact = _ks_exact(*[F.when(small, F.col(c)).otherwise(0) for c in ("n1", "n2")], F.coalesce("distance", F.lit(0.0)))
    out = summary.withColumn("stat", F.col("distance")).withColumn(
        "p_value", F.when(small, exact).otherwise(kolmogorov_tail(size * F.col("stat")))
    )
    return _result(out, "kolmogorov_smirnov", F.col("p_value") < alpha)


def feature_ranges(df: DataFrame, features: list[str]) -> DataFrame:
    """Minimum and maximum of every feature on the before side: ``(feature, lo, hi)``, one row per feature."""
    wide = df.where(F.col("side") == "before").agg(
        *[g(f).alias(f"{f}__{s}") for f in features for s, g in (("lo", F.min), ("hi", F.max))]
    )
    return unpivot_stats(wide, [], features, ["lo", "hi"])


def wasserstein(summary: DataFrame, ranges: DataFrame, thr: float = 0.1) -> DataFrame:
    """T4: area between the step functions; min-max scaling is linear, so the raw area is divided by the range."""
    span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    out = summary.join(F.broadcast(ranges), "feature").withColumn(
        "stat", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("area") / span)
    )
    return _result(out, "wasserstein", F.col("stat") > thr)


def side_bins(df: DataFrame, features: list[str], bins: int = 30) -> DataFrame:
    """Densities of both sides per (label, feature, bin); edges from the class's own before rows.

    Values are min-max scaled on the whole before side. After rows outside the edges are left out.
    """
    counts = side_counts(df, features).join(F.broadcast(feature_ranges(df, features)), "feature")
    scaled = counts.select(
        *GROUP, "n_before", "n_after", min_max_value(F.col("value"), F.col("lo"), F.col("hi")).alias("v")
    )
    old = F.when(F.col("n_before") > 0, F.col("v"))
    edges = scaled.groupBy(*GROUP).agg(F.min(old).alias("a"), F.max(old).alias("b")).where("a is not null")
    hit = bin_number(F.col("v"), F.col("a"), F.col("b"), bins)
    binned = (
        scaled.join(F.broadcast(edges), GROUP)
        .groupBy(*GROUP, hit.alias("bin"))
        .agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))
        .where("bin is not null")
    )
    totals = binned.groupBy(*GROUP).agg(F.sum("n_before").alias("t_before"), F.sum("n_after").alias("t_after"))
    grid = edges.join(totals, GROUP).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("b") - F.col("a")) / bins

    def density(s: str) -> Column:
        return F.when(F.col(f"t_{s}") > 0, F.coalesce(f"n_{s}", F.lit(0)) / (F.col(f"t_{s}") * width) + EPS)

    dense = grid.join(binned, [*GROUP, "bin"], "left").select(
        *GROUP, "bin", density("before").alias("p"), density("after").alias("q")
    )
    sums = dense.groupBy(*GROUP).agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    return dense.join(sums, GROUP).select(
        *GROUP, "bin", (F.col("p") / F.col("sp")).alias("p"), (F.col("q") / F.col("sq")).alias("q")
    )


def divergences(binned: DataFrame) -> DataFrame:
    """Both divergences in one pass: ``(label, feature, kl, js)``; null when no after row is inside the edges."""
    m = (F.col("p") + F.col("q")) / 2
    js = (F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)) / 2
    return binned.groupBy(*GROUP).agg(
        F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"),
        F.when(F.sum(js) < 0, 0.0).otherwise(F.sum(js)).alias("js"),
    )


def kl_divergence(divs: DataFrame, thr: float = 0.1) -> DataFrame:
    """Sum p ln(p/q) over the bins."""
    return _result(divs.withColumn("stat", F.col("kl")), "kullback_leibler", F.col("stat") > thr)


def js_divergence(divs: DataFrame, thr: float = 0.05) -> DataFrame:
    """Squared Jensen-Shannon distance, natural logarithm."""
    return _result(divs.withColumn("stat", F.col("js")), "jensen_shannon", F.col("stat") > thr)


def spearman_paired(df: DataFrame, features: list[str], order: list[str], thr: float = 0.9) -> DataFrame:
    """T5: rank correlation of the k-th before row of a class with its k-th after row, over the shorter length.

    Pairs are counted before the ranks are joined, so repeated pairs travel once; the counted pairs are read three
    times and are materialised.
    """
    placed = index_rows(df.select("side", "label", *order, *features), order, ["side", "label"], "pos")
    is_old = F.col("side") == "before"
    met = placed.groupBy("label", "pos").agg(
        F.count(F.lit(1)).alias("_sides"),
        *[F.max(F.when(is_old, F.col(f))).alias(f"x_{f}") for f in features],
        *[F.max(F.when(~is_old, F.col(f))).alias(f"y_{f}") for f in features],
    ).where("_sides = 2")
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("feature"), F.col(f"x_{f}").alias("x"), F.col(f"y_{f}").alias("y"))
                for f in features
            ]
        )
    )
    pairs = cut_lineage(
        met.select("label", rows.alias("r")).select("label", "r.*")
        .where("x is not null and y is not null").groupBy(*GROUP, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    )

    def ranks(c: str) -> DataFrame:
        counted = pairs.groupBy(*GROUP, F.col(c)).agg(F.sum("n").alias("n"))
        r = prefix_sums(counted, GROUP, [c], {"n": F.col("n")})
        centred = F.col("n_upto") - (F.col("n") - 1) / 2.0 - (F.col("n_total") + 1) / 2.0
        return r.select(*GROUP, c, centred.alias(f"r{c}"))

    joined = pairs.join(ranks("x"), [*GROUP, "x"]).join(ranks("y"), [*GROUP, "y"])
    rho = F.sum(F.col("n") * F.col("rx") * F.col("ry")) / F.sqrt(
        F.sum(F.col("n") * F.col("rx") * F.col("rx")) * F.sum(F.col("n") * F.col("ry") * F.col("ry"))
    )
    varied = (F.sum(F.abs("rx")) > 0) & (F.sum(F.abs("ry")) > 0)
    out = joined.groupBy(*GROUP).agg(F.when(varied, rho).alias("stat"))
    return _result(out, "spearman", F.abs("stat") < thr)


# Critical values of the two-sample statistic and their levels (Scholz and Stephens 1987).
AD_LEVELS = [0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001]
AD_B0 = [0.675, 1.281, 1.645, 1.96, 2.326, 2.573, 2.807]
AD_B1 = [-0.245, 0.25, 0.678, 1.149, 1.822, 2.364, 2.615]
AD_B2 = [-0.105, -0.305, -0.362, -0.391, -0.396, -0.345, -0.154]
AD_CRITICAL = [round(x + y + z, 6) for x, y, z in zip(AD_B0, AD_B1, AD_B2)]


@F.pandas_udf(T.DoubleType())
def _ad_sigma(n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([anderson_darling_sigma(int(a), int(b)) for a, b in zip(n1, n2)])


def anderson_darling_k(summary: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Standardised statistic, p interpolated over the critical values and held in [0.001, 0.25]."""
    usable = summary.where("n1 > 0 and n2 > 0 and distinct_values > 1")
    stat = usable.withColumn("stat", (F.col("raw") - 1.0) / _ad_sigma("n1", "n2"))
    c2, c1, c0 = (float(c) for c in np.polyfit(AD_CRITICAL, np.log(AD_LEVELS), 2))
    s = F.col("stat")
    p = (
        F.when(s < AD_CRITICAL[0], AD_LEVELS[0])
        .when(s > AD_CRITICAL[-1], AD_LEVELS[-1])
        .otherwise(F.exp(c2 * s * s + c1 * s + c0))
    )
    out = stat.withColumn("p_value", p).withColumn("critical", F.array(*[F.lit(c) for c in AD_CRITICAL]))
    return _result(out, "anderson_darling", F.col("p_value") < alpha, "critical")


def run_tests(
    df: DataFrame,
    features: list[str],
    order: list[str],
    tests: list[str] | str = "all",
    alpha: float = 0.05,
    bins: int = 30,
    kl_thr: float = 0.1,
    wasserstein_thr: float = 0.1,
    js_thr: float = 0.05,
    spearman_thr: float = 0.9,
) -> DataFrame:
    """The chosen tests as one long table.

    The distribution tests share one pass over distinct values, the divergences one pass over bins; each pass is
    materialised once (a few rows per label and feature) and read by its tests.
    """
    tests = ALL_TESTS if tests == "all" else tests
    unknown = set(tests) - set(ALL_TESTS)
    if unknown or not tests:
        raise ValueError(f"unsupported tests: {sorted(unknown)}")
    summary, divs = None, None
    if {"kolmogorov_smirnov", "wasserstein", "anderson_darling"} & set(tests):
        summary = cut_lineage(cdf_summary(side_cdfs(df, features)))
    if {"kullback_leibler", "jensen_shannon"} & set(tests):
        divs = cut_lineage(divergences(side_bins(df, features, bins)))
    made = {
        "kolmogorov_smirnov": lambda: ks_test(summary, alpha),
        "kullback_leibler": lambda: kl_divergence(divs, kl_thr),
        "wasserstein": lambda: wasserstein(summary, feature_ranges(df, features), wasserstein_thr),
        "jensen_shannon": lambda: js_divergence(divs, js_thr),
        "spearman": lambda: spearman_paired(df, features, order, spearman_thr),
        "anderson_darling": lambda: anderson_darling_k(summary, alpha).drop("critical"),
    }
    out = None
    for t in tests:
        out = made[t]() if out is None else out.unionByName(made[t]())
    return out


def test_flags(results: DataFrame, drift_thr: float = 0.2) -> DataFrame:
    """T7, first half: a test drifts when the drifted share of its (label, feature) rows exceeds ``drift_thr``."""
    share = F.avg(F.col("drift").cast("double"))
    return results.groupBy("test").agg(share.alias("drifted_share"), (share > drift_thr).alias("drift"))


def test_decision(results: DataFrame, drift_thr: float = 0.2, decision_thr: float = 0.4) -> DataFrame:
    """Overall flag when the drifted share of the tests exceeds ``decision_thr``."""
    share = F.avg(F.col("drift").cast("double"))
    return test_flags(results, drift_thr).agg(
        F.count(F.lit(1)).alias("tests"), share.alias("drifted_share"), (share > decision_thr).alias("drift")
    )


