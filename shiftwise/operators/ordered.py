"""Positions, running totals, ranks and exact quantiles over groups of any size.

A plain ``Window.partitionBy(label).orderBy(value)`` sorts a whole group in one task. Labels are few, so one
group can hold a third of the table. So every group is cut into ordered slices at rows chosen by a hash of their order
key, about one in ``rows_per_slice``; every slice is scanned by its own task, and the totals of the earlier slices are
added. A small group has no such row and is one slice. The plan is the same at every size and nothing runs while it is
built: cut points are a part of it. They depend on the rows alone, so a recomputed task sees the same ones, and the
hash filter keeps their scan to the order columns.

A group has ``MAX_SLICES`` slices at most (beyond, every second, third... cut point counts), which bounds the broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.functions.columns import hash_uniform

ROWS_PER_SLICE = 250_000
MAX_SLICES = 1 << 14


def cut_points(df: DataFrame, keys: list[str], order: list[str], rows_per_slice: int | None = None) -> DataFrame:
    """``(keys, _cuts)`` for the groups with a chosen row: its order keys, sorted."""
    chosen = df.select(*keys, F.struct(*order).alias("_at")).where(hash_uniform(*order) < 1 / (rows_per_slice or ROWS_PER_SLICE))
    every = F.ceil(F.size("_cuts") / MAX_SLICES).cast("int")
    thinned = F.filter("_cuts", lambda _, i: i % every == 0)
    return chosen.groupBy(*keys).agg(F.sort_array(F.collect_set("_at")).alias("_cuts")).select(*keys, thinned.alias("_cuts"))


def with_slices(df: DataFrame, points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``_slice``, the number of the group's cut points below the row; slices of a group are ordered by ``order``."""
    at = F.struct(*order)
    # Lower bound by halving steps; the largest is the largest power of two in the number of cut points.
    steps = F.transform(F.sequence(F.floor(F.log2(F.size("_cuts"))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    below = F.aggregate(
        steps, F.lit(0), lambda place, step: place + F.when(F.coalesce(F.get("_cuts", place + step - 1) < at, F.lit(False)), step).otherwise(0)
    )
    if keys:
        out = df.join(F.broadcast(points), keys, "left")
    else:
        out = df.withColumn("_cuts", points.scalar())
    return out.withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(below))


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    weights: dict[str, Column],
    rows_per_slice: int | None = None,
    following: str | None = None,
) -> DataFrame:
    """Add ``<w>_upto`` (running sum, this row included) and ``<w>_total`` per group for every weight.

    ``order`` must be unique within a group. ``following`` names a column for the next value of ``order[0]``.
    """
    weighed = df.select("*", *[c.alias(f"_w_{w}") for w, c in weights.items()])
    sliced = with_slices(weighed, cut_points(df, keys, order, rows_per_slice), keys, order)
    inside = Window.partitionBy(*keys, "_slice")
    upto = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = sliced.select(
        *df.columns, "_slice",
        *[F.sum(f"_w_{w}").over(upto).alias(f"{w}_upto") for w in weights],
        *[F.sum(f"_w_{w}").over(inside).alias(f"{w}_total") for w in weights],
        *([F.lead(order[0]).over(inside.orderBy(*order)).alias(following)] if following else []),
    )
    # Totals of the slices of groups with cut points.
    per_slice = (
        sliced.where(F.col("_cuts").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.min(order[0]).alias("_first"), *[F.sum(f"_w_{w}").alias(f"_s_{w}") for w in weights])
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    offsets = per_slice.select(
        *keys,
        "_slice",
        F.lead("_first").over(by_slice).alias("_first_later"),
        *[
            F.sum(f"_s_{w}").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_b_{w}")
            for w in weights
        ],
        *[F.sum(f"_s_{w}").over(Window.partitionBy(*keys)).alias(f"_t_{w}") for w in weights],
    )
    return scanned.join(F.broadcast(offsets), [*keys, "_slice"], "left").select(
        *df.columns,
        *[(F.col(f"{w}_upto") + F.coalesce(f"_b_{w}", F.lit(0))).alias(f"{w}_upto") for w in weights],
        *[F.coalesce(f"_t_{w}", f"{w}_total").alias(f"{w}_total") for w in weights],
        *([F.coalesce(following, "_first_later").alias(following)] if following else []),
    )


def index_rows(
    df: DataFrame,
    order: list[str],
    keys: list[str] | None = None,
    name: str = "idx",
    rows_per_slice: int | None = None,
) -> DataFrame:
    """S3: 0-based position of every row by a unique order key, within ``keys`` if given."""
    out = prefix_sums(df, keys or [], order, {"_one": F.lit(1).cast("long")}, rows_per_slice)
    return out.withColumn(name, F.col("_one_upto") - 1).drop("_one_upto", "_one_total")


def value_counts(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Distinct values with their count: every rank statistic starts from this map-side combined table."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def running_counts(
    df: DataFrame, keys: list[str], value: str = "value", rows_per_slice: int | None = None
) -> DataFrame:
    """``(keys, value, n, n_upto, n_total)`` over the distinct values of each group."""
    return prefix_sums(value_counts(df, keys, value), keys, [value], {"n": F.col("n")}, rows_per_slice)


def average_ranks(
    df: DataFrame, keys: list[str], value: str = "value", rows_per_slice: int | None = None
) -> DataFrame:
    """``(keys, value, avg_rank)``: 1-based ranks, ties share their mean."""
    r = running_counts(df, keys, value, rows_per_slice)
    return r.select(*keys, value, (F.col("n_upto") - (F.col("n") - 1) / 2.0).alias("avg_rank"))


def quantiles(
    df: DataFrame,
    keys: list[str],
    probs: dict[str, float],
    value: str = "value",
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one output column per entry of ``probs``."""
    r = running_counts(df, keys, value, rows_per_slice)
    first, last = F.col("n_upto") - F.col("n"), F.col("n_upto")
    picks = []
    for name, p in probs.items():
        place = (F.col("n_total") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        picks += [
            F.max(F.when((first <= low) & (low < last), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((first <= high) & (high < last), F.col(value))).alias(f"_hi_{name}"),
        ]
    out = r.groupBy(*keys).agg(F.max("n_total").alias("_n"), *picks)
    cols = []
    for name, p in probs.items():
        place = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return out.select(*keys, *cols)
