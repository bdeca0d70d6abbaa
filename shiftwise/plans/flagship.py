"""The flagship query: what moved between two slices of a labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise.operators.profile import drift_table
from shiftwise.operators.two_sample import (
    cdf_summary, divergences, feature_ranges, js_divergence, ks_test, side_bins, side_cdfs, wasserstein
)
from shiftwise.plans.inputs import LINE_FEATURES, line_sides


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (label, feature, check): shifted statistics and distribution tests with their flags."""
    df = line_sides(spark, sf_dir)
    stats = drift_table(df, LINE_FEATURES).select(
        "label", "feature", F.col("stat").alias("check"), F.col("shift").alias("value"), "drift"
    )
    summary = cdf_summary(side_cdfs(df, LINE_FEATURES))
    tests = (
        ks_test(summary)
        .unionByName(wasserstein(summary, feature_ranges(df, LINE_FEATURES)))
        .unionByName(js_divergence(divergences(side_bins(df, LINE_FEATURES))))
        .select("label", "feature", F.col("test").alias("check"), F.col("stat").alias("value"), "drift")
    )
    return stats.unionByName(tests)
