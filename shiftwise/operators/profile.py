"""Descriptive statistics, their shifts and distribution profiles.

Input: ``side, label, <features>``. Sums, moments and extremes come from one wide aggregate that combines on
the map side; order statistics come from distinct-value counts (see ``ordered``). Result tables are long:
``(label, feature, stat, ...)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.functions.columns import unpivot_stats
from shiftwise.operators.ordered import quantiles, running_counts, value_counts

EPS = 1e-10
STATS = ["mean", "std", "min", "max", "median"]


def long_form(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """``(keys, feature, value)`` without null values."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keys, F.explode(pairs).alias("_r")).select(*keys, "_r.*").where("value is not null")


def moments(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    wide = df.groupBy(*keys).agg(
        *[
            g(f).alias(f"{f}__{s}")
            for f in features
            for s, g in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
        ]
    )
    return unpivot_stats(wide, keys, features, ["n", "mean", "std", "min", "max"])


def class_stats(
    df: DataFrame, features: list[str], keys: list[str] | None = None, rows_per_slice: int | None = None
) -> DataFrame:
    """``(side, label, feature, n, mean, std, min, max, median)``."""
    keys = keys or ["side", "label"]
    medians = quantiles(
        long_form(df, features, keys), [*keys, "feature"], {"median": 0.5}, rows_per_slice=rows_per_slice
    )
    return moments(df, keys, features).join(medians, [*keys, "feature"], "left")


def _stats_long(stats: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in names])
    return stats.select("side", "label", "feature", F.explode(pairs).alias("_r")).select(
        "side", "label", "feature", "_r.*"
    )


def relative_shift(old, new):
    return (new - old) / F.abs(old + F.lit(EPS))


def stat_shift(stats: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Old and new value of every statistic with the relative shift; a class missing on a side counts as 0.

    The full outer join over sides is one pivoting aggregate over the small statistics table.
    """
    long = _stats_long(stats, names or STATS)
    is_old = F.col("side") == "before"
    both = long.groupBy("label", "feature", "stat").agg(
        F.max(F.when(is_old, F.col("value"))).alias("old"),
        F.max(F.when(~is_old, F.col("value"))).alias("new"),
        F.bool_or(is_old).alias("_in_old"),
        F.bool_or(~is_old).alias("_in_new"),
    )
    # an undefined statistic of a present class stays null (std of one row); an absent class is 0
    old = F.when(F.col("_in_old"), F.col("old")).otherwise(0.0)
    new = F.when(F.col("_in_new"), F.col("new")).otherwise(0.0)
    return both.select(
        "label", "feature", "stat", old.alias("old"), new.alias("new"), relative_shift(old, new).alias("shift")
    )


def stat_drift(shifts: DataFrame, thr: float = 0.2, two_sided: bool = False) -> DataFrame:
    """D3: ``drift`` per row; only increases flag unless ``two_sided``."""
    size = F.abs("shift") if two_sided else F.col("shift")
    return shifts.withColumn("drift", F.coalesce(size > thr, F.lit(False)))


def imbalance_shift(df: DataFrame, thr: float = 0.2, two_sided: bool = False) -> DataFrame:
    """Shift of the class proportions, in the same columns as D3."""
    counts = df.groupBy("label").agg(
        F.sum((F.col("side") == "before").cast("long")).alias("_o"),
        F.sum((F.col("side") == "after").cast("long")).alias("_n"),
    )
    everything = Window.partitionBy()  # one row per class
    old = F.col("_o") / F.sum("_o").over(everything)
    new = F.col("_n") / F.sum("_n").over(everything)
    shifts = counts.select(
        "label",
        F.lit("__class_ratio__").alias("feature"),
        F.lit("imbalance_ratio").alias("stat"),
        F.coalesce(old, F.lit(0.0)).alias("old"),
        F.coalesce(new, F.lit(0.0)).alias("new"),
    ).withColumn("shift", relative_shift(F.col("old"), F.col("new")))
    return stat_drift(shifts, thr, two_sided)


def drift_table(
    df: DataFrame,
    features: list[str],
    names: list[str] | None = None,
    thr: float = 0.2,
    two_sided: bool = False,
    with_ratio: bool = True,
) -> DataFrame:
    """D1-D4 together: one row per (label, feature, stat)."""
    table = stat_drift(stat_shift(class_stats(df, features), names), thr, two_sided)
    return table.unionByName(imbalance_shift(df, thr, two_sided)) if with_ratio else table


def stat_flags(drifts: DataFrame) -> DataFrame:
    """A statistic drifts when any (label, feature) does."""
    return drifts.groupBy("stat").agg(F.bool_or("drift").alias("drift"))


def desc_decision(drifts: DataFrame, decision_thr: float = 0.4) -> DataFrame:
    """One row with the share of drifted statistics and the overall flag."""
    share = F.avg(F.col("drift").cast("double"))
    return stat_flags(drifts).agg(
        F.count(F.lit(1)).alias("statistics"), share.alias("drifted_share"), (share > decision_thr).alias("drift")
    )


def stats_before_after(df: DataFrame, features: list[str]) -> DataFrame:
    """``(label, feature, old_median, new_median, old_mean, ...)``."""
    stats = class_stats(df, features)
    is_old = F.col("side") == "before"
    return stats.groupBy("label", "feature").agg(
        *[F.max(F.when(is_old, F.col(s))).alias(f"old_{s}") for s in ("median", "mean", "std")],
        *[F.max(F.when(~is_old, F.col(s))).alias(f"new_{s}") for s in ("median", "mean", "std")],
    )


def pct_change_table(df: DataFrame, features: list[str]) -> DataFrame:
    """``(label, feature, stat, before, after, change_pct)``."""
    wide = stats_before_after(df, features)
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("stat"), F.col(f"old_{s}").alias("before"), F.col(f"new_{s}").alias("after"))
                for s in ("median", "mean", "std")
            ]
        )
    )
    pct = F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100)
    return wide.select("label", "feature", rows.alias("r")).select("label", "feature", "r.*").withColumn(
        "change_pct", pct
    )


def class_balance(df: DataFrame) -> DataFrame:
    """``(side, label, n, share)``."""
    counts = df.groupBy("side", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("side")))


def box_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """Quartiles, mean and the outermost values within 1.5 IQR of the box.

    Whiskers are read off the distinct-value counts, so the raw rows are scanned once for them.
    """
    keys = ["side", "label", "feature"]
    long = long_form(df, features, ["side", "label"])
    quarts = quantiles(long, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    seen = value_counts(long, keys).join(quarts, keys)
    return (
        seen.groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
            (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
            F.min(F.when(F.col("value") >= F.col("q1") - 1.5 * iqr, F.col("value"))).alias("whisker_low"),
            F.max(F.when(F.col("value") <= F.col("q3") + 1.5 * iqr, F.col("value"))).alias("whisker_high"),
            F.sum(
                F.when(
                    (F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr),
                    F.col("n"),
                ).otherwise(0)
            ).alias("outliers"),
        )
        # a whisker never falls inside the box
        .withColumn("whisker_low", F.least("whisker_low", "q1"))
        .withColumn("whisker_high", F.greatest("whisker_high", "q3"))
    )


def bin_number(value, low, high, bins: int):
    """0-based bin of equal width with a closed last bin; null outside ``[low, high]``."""
    same = low == high
    lo = F.when(same, low - 0.5).otherwise(low)
    hi = F.when(same, high + 0.5).otherwise(high)
    step = (hi - lo) / bins
    guess = F.least(F.floor((value - lo) / step), F.lit(bins - 1))
    # the division may land one bin off; the edges decide
    at = (
        F.when(value < guess * step + lo, guess - 1)
        .when((value >= (guess + 1) * step + lo) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    return F.when((value >= lo) & (value <= hi), at.cast("int"))


def _bin_edges(low, high, bin_no, bins: int):
    same = low == high
    lo = F.when(same, low - 0.5).otherwise(low)
    width = F.when(same, F.lit(1.0)).otherwise(high - low) / bins
    return bin_no * width + lo, (bin_no + 1) * width + lo


def _histogram(df: DataFrame, features: list[str], group: list[str], edge_keys: list[str], bins: int) -> DataFrame:
    long = long_form(df, features, group)
    extremes = df.groupBy(*[k for k in edge_keys if k != "feature"]).agg(
        *[g(f).alias(f"{f}__{s}") for f in features for s, g in (("lo", F.min), ("hi", F.max))]
    )
    if edge_keys == ["feature"]:
        extremes = unpivot_stats(extremes, [], features, ["lo", "hi"])
    else:
        extremes = unpivot_stats(extremes, [k for k in edge_keys if k != "feature"], features, ["lo", "hi"])
    counts = (
        long.join(F.broadcast(extremes), edge_keys)
        .groupBy(*group, "feature", bin_number(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    groups = counts.select(*group, "feature").distinct().join(F.broadcast(extremes), edge_keys)
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    left, right = _bin_edges(F.col("lo"), F.col("hi"), F.col("bin"), bins)
    return grid.join(counts, [*group, "feature", "bin"], "left").select(
        *group, "feature", "bin", left.alias("bin_left"), right.alias("bin_right"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram_before_after(df: DataFrame, features: list[str], bins: int = 30) -> DataFrame:
    """Counts per side, feature and bin; edges from both sides together; empty bins kept."""
    return _histogram(df, features, ["side"], ["feature"], bins)


def class_histogram(df: DataFrame, features: list[str], bins: int = 30) -> DataFrame:
    """Counts per side, class, feature and bin with the group's own edges."""
    return _histogram(df, features, ["side", "label"], ["side", "label", "feature"], bins)


def violin_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """Extremes, quartiles, median and mean per side, class and feature."""
    q = quantiles(
        long_form(df, features, ["side", "label"]),
        ["side", "label", "feature"],
        {"q1": 0.25, "median": 0.5, "q3": 0.75},
    )
    return moments(df, ["side", "label"], features).select(
        "side", "label", "feature", "min", "max", "mean"
    ).join(q, ["side", "label", "feature"])


def ecdf(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """One step per distinct value: rows up to it and their share."""
    keys = keys or ["side"]
    r = running_counts(long_form(df, features, keys), [*keys, "feature"])
    return r.select(
        *keys, "feature", "value", "n", F.col("n_upto").alias("k"), (F.col("n_upto") / F.col("n_total")).alias("share")
    )


# Coefficients of Acklam's rational approximation of the normal quantile.
CENTRE_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
              1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRE_BOTTOM = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
                 6.680131188771972e01, -1.328068155288572e01]
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_BOTTOM = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def inverse_normal(p):
    """Standard normal quantile of a column in (0, 1); relative error below 1.2e-9."""

    def poly(x, coeffs):
        out = F.lit(coeffs[0])
        for k in coeffs[1:]:
            out = out * x + k
        return out

    def tail(q):
        t = F.sqrt(-2.0 * F.log(q))
        return poly(t, TAIL_TOP) / (poly(t, TAIL_BOTTOM) * t + 1.0)

    mid = p - 0.5
    r = mid * mid
    centre = poly(r, CENTRE_TOP) * mid / (poly(r, CENTRE_BOTTOM) * r + 1.0)
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1.0 - p)).otherwise(centre)


def qq_normal(df: DataFrame, features: list[str], chunk: int = 100_000) -> DataFrame:
    """Every sorted value with the normal quantile of its place (Filliben's medians).

    Places come from distinct-value counts. A value with many copies is handed out in chunks of places that are
    spread over the tasks before they are expanded.
    """
    r = running_counts(long_form(df, features, ["side"]), ["side", "feature"])
    chunks = r.select(
        "side", "feature", "value", F.col("n_total").cast("double").alias("_t"), "n_upto",
        F.explode(F.sequence(F.col("n_upto") - F.col("n") + 1, F.col("n_upto"), F.lit(chunk).cast("long"))).alias("_a"),
    ).repartition("side", "feature", "_a")
    rows = chunks.withColumn("place", F.explode(F.sequence("_a", F.least(F.col("_a") + chunk - 1, F.col("n_upto")))))
    place, total = F.col("place").cast("double"), F.col("_t")
    last = F.pow(F.lit(0.5), 1.0 / total)
    median = F.when(place == total, last).when(place == 1, 1.0 - last).otherwise((place - 0.3175) / (total + 0.365))
    return rows.select("side", "feature", "place", "value", inverse_normal(median).alias("theoretical"))


def qq_line(qq: DataFrame) -> DataFrame:
    """Least-squares line through a Q-Q table."""
    return qq.groupBy("side", "feature").agg(
        F.regr_slope("value", "theoretical").alias("slope"),
        F.regr_intercept("value", "theoretical").alias("intercept"),
        F.corr("value", "theoretical").alias("r"),
    )


def kde(df: DataFrame, features: list[str], points: int = 1000) -> DataFrame:
    """Gaussian density per side and feature on a grid over the joint range, Scott bandwidth.

    Every task adds its distinct values onto the grid and emits one partial density per side and feature, so no
    value-by-point rows are made and a hot group is summed by all tasks.
    """
    counts = value_counts(long_form(df, features, ["side"]), ["side", "feature"])
    spread = moments(df, ["side"], features).select("side", "feature", "n", "std", "min", "max")
    edges = spread.groupBy("feature").agg(F.min("min").alias("lo"), F.max("max").alias("hi"))
    params = spread.join(edges, "feature").select(
        "side", "feature", F.col("n").alias("total"),
        (F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"), "lo",
        ((F.col("hi") - F.col("lo")) / (points - 1)).alias("step"),
    )
    # one row per side and feature
    joined = counts.join(F.broadcast(params), ["side", "feature"]).select("side", "feature", "value", "n", "h", "lo", "step")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass: dict[tuple, np.ndarray] = {}
        grid_no = np.arange(points)
        for batch in batches:
            for key, g in batch.groupby(["side", "feature"]):
                h, lo, step = g["h"].iloc[0], g["lo"].iloc[0], g["step"].iloc[0]
                total = mass.setdefault(key, np.zeros(points))
                for at in range(0, len(g), 512):
                    v, n = g["value"].to_numpy()[at : at + 512], g["n"].to_numpy()[at : at + 512]
                    z = (lo + grid_no[None, :] * step - v[:, None]) / h
                    total += (n[:, None] * np.exp(-0.5 * z * z)).sum(axis=0)
        yield pd.DataFrame([(*k, m) for k, m in mass.items()], columns=["side", "feature", "mass"])

    partials = joined.mapInPandas(partial, "side string, feature string, mass array<double>")
    summed = partials.select("side", "feature", F.posexplode("mass").alias("point", "m")).groupBy(
        "side", "feature", "point"
    ).agg(F.sum("m").alias("mass"))
    return summed.join(F.broadcast(params), ["side", "feature"]).select(
        "side", "feature", "point", (F.col("lo") + F.col("point") * F.col("step")).alias("x"),
        (F.col("mass") / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"),
    )
