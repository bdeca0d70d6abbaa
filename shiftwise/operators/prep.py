"""Windows, slices, scaling, encoding and drift injection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.functions.columns import hash_uniform
from shiftwise.operators.ordered import prefix_sums, quantiles


def select_features(available: list[str], wanted: list[str] | None) -> list[str]:
    """The wanted features that exist; all of them when none is named or none exists."""
    kept = [c for c in wanted or [] if c in available]
    return kept or list(available)


def fixed_windows(df: DataFrame, size: int, idx: str = "idx", rows: int | None = None) -> DataFrame:
    """``window_id`` of equal windows; the incomplete last window is dropped."""
    total = df.agg(F.count(F.lit(1)).alias("_n")) if rows is None else None
    windowed = df.withColumn("window_id", F.floor(F.col(idx) / size))
    if total is None:
        return windowed.where(F.col("window_id") < rows // size)
    return (
        windowed.join(F.broadcast(total), F.col("window_id") < F.floor(F.col("_n") / size), "inner").drop("_n")
    )


def check_slices(start_before: int, start_after: int, length: int, rows: int) -> None:
    if length <= 0 or min(start_before, start_after) < 0 or max(start_before, start_after) + length > rows:
        raise ValueError("slices must lie inside the table")


def before_after(
    df: DataFrame, start_before: int, start_after: int, length: int, idx: str = "idx", rows: int | None = None
) -> DataFrame:
    """Two slices by position with a ``side`` column; overlapping slices repeat their shared rows.

    One scan: a row carries the list of the sides it belongs to, which is at most two.
    """
    if rows is not None:
        check_slices(start_before, start_after, length, rows)
    at = F.col(idx)
    sides = F.array_compact(
        F.array(
            F.when((at >= start_before) & (at < start_before + length), F.lit("before")),
            F.when((at >= start_after) & (at < start_after + length), F.lit("after")),
        )
    )
    low, high = min(start_before, start_after), max(start_before, start_after) + length
    return df.where((at >= low) & (at < high)).withColumn("side", F.explode(sides))


def split_at(df: DataFrame, cond_before: Column) -> DataFrame:
    """Sides by a condition on a stored column, for tables that need no positions."""
    return df.withColumn("side", F.when(cond_before, F.lit("before")).otherwise(F.lit("after")))


def block_at(
    df: DataFrame, size: int, start: int = -1, idx: str = "idx", rows: int | None = None, seed: int = 42
) -> DataFrame:
    """``size`` rows from a start clamped into the table; -1 takes a seeded start."""
    rows = df.count() if rows is None else rows
    room = max(0, rows - size)
    if start == -1:
        start = int(df.sparkSession.range(1).select(F.floor(hash_uniform(F.lit(room), seed=seed) * room)).first()[0])
    start = max(0, min(start, room))
    return df.where((F.col(idx) >= start) & (F.col(idx) < start + size))


def _fitted_scale(df: DataFrame, features: list[str], fit: DataFrame, aggs: list[Column], expr) -> DataFrame:
    params = fit.agg(*aggs)
    out = df.join(F.broadcast(params), F.lit(True), "left")
    keep = [c for c in df.columns if c not in features]
    return out.select(*keep, *[expr(f).alias(f) for f in features])


def min_max_value(value: Column, low: Column, high: Column) -> Column:
    scale = 1.0 / F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return value * scale + (-low * scale)


def min_max_scale(df: DataFrame, features: list[str], fit: DataFrame | None = None) -> DataFrame:
    """Fit on the rows of ``fit`` (default: the before side); range 0 is taken as 1."""
    fit = df.where(F.col("side") == "before") if fit is None else fit
    aggs = [g(f).alias(f"_{n}_{f}") for f in features for n, g in (("lo", F.min), ("hi", F.max))]

    def scaled(f: str) -> Column:
        return min_max_value(F.col(f), F.col(f"_lo_{f}"), F.col(f"_hi_{f}"))

    return _fitted_scale(df, features, fit, aggs, scaled)


def standard_scale(df: DataFrame, features: list[str], fit: DataFrame | None = None) -> DataFrame:
    """Population standard deviation of the before side; 0 divides by 1."""
    fit = df.where(F.col("side") == "before") if fit is None else fit
    aggs = [g(f).alias(f"_{n}_{f}") for f in features for n, g in (("m", F.avg), ("s", F.stddev_pop))]

    def scaled(f: str) -> Column:
        sd = F.col(f"_s_{f}")
        return (F.col(f) - F.col(f"_m_{f}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)

    return _fitted_scale(df, features, fit, aggs, scaled)


def category_codes(fit: DataFrame, column: str) -> DataFrame:
    """Sorted position of every category: ``(category, code)``."""
    distinct = fit.where(F.col(column).isNotNull()).select(F.col(column).alias("category")).distinct()
    coded = prefix_sums(distinct, [], ["category"], {"code": F.lit(1)})
    return coded.select("category", (F.col("code_upto") - 1).cast("int").alias("code"))


def ordinal_encode(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """Category -> index in sorted order; unknown or missing -> -1."""
    fit = df if fit is None else fit
    out = df
    for c in columns:
        codes = category_codes(fit, c).select(F.col("category").alias(c), F.col("code").alias(f"_code_{c}"))
        out = out.join(codes, c, "left").withColumn(c, F.coalesce(f"_code_{c}", F.lit(-1))).drop(f"_code_{c}")
    return out.select(*df.columns)


def multilabel_one_hot(df: DataFrame, columns: list[str], values: list[str] | None = None) -> DataFrame:
    """One 0/1 column per distinct value of the label columns; missing values are ignored."""
    if values is None:
        found = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("v"))
        values = [r.v for r in found.where("v is not null").distinct().orderBy("v").collect()]
    present = F.array(*[F.col(c).cast("string") for c in columns])
    keep = [c for c in df.columns if c not in columns]
    flags = [F.coalesce(F.array_contains(F.array_compact(present), v), F.lit(False)) for v in values]
    return df.select(*keep, *[f.cast("int").alias(v) for f, v in zip(flags, values)])


def _entropy_of(p: Column) -> Column:
    def part(q: Column) -> Column:
        return F.when(q > 0, -q * F.log(q)).otherwise(0.0)

    return part(p) + part(1 - p)


def binary_entropy_weights(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """One row of weights: ``(1 - sum_c P(c) H(x | c)) / ln(#classes)`` for 2-valued columns, else 1."""
    per_class = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(f).alias(f"_p_{f}") for f in features],
        *[F.min(f).alias(f"_lo_{f}") for f in features],
        *[F.max(f).alias(f"_hi_{f}") for f in features],
    )
    # two-valued: every value equals the overall minimum or maximum
    edges = df.agg(*[g(f).alias(f"_{n}_{f}") for f in features for n, g in (("mn", F.min), ("mx", F.max))])
    between = df.join(F.broadcast(edges), F.lit(True), "left").agg(
        *[
            F.coalesce(
                F.bool_or((F.col(f) != F.col(f"_mn_{f}")) & (F.col(f) != F.col(f"_mx_{f}"))), F.lit(False)
            ).alias(f"_more_{f}")
            for f in features
        ],
        *[(F.max(f"_mn_{f}") != F.max(f"_mx_{f}")).alias(f"_two_{f}") for f in features],
    )
    total = per_class.agg(
        F.log(F.count(F.lit(1)).cast("double")).alias("_ln"),
        *[(F.sum(_entropy_of(F.col(f"_p_{f}")) * F.col("_n")) / F.sum("_n")).alias(f"_h_{f}") for f in features],
    )
    return total.join(F.broadcast(between), F.lit(True), "left").select(
        *[
            F.when(F.col(f"_two_{f}") & ~F.col(f"_more_{f}"), (1 - F.col(f"_h_{f}")) / F.col("_ln"))
            .otherwise(1.0)
            .alias(f)
            for f in features
        ]
    )


def binary_entropy_weight(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Multiply every 2-valued column by its weight."""
    w = binary_entropy_weights(df, features, label).select(*[F.col(f).alias(f"_w_{f}") for f in features])
    keep = [c for c in df.columns if c not in features]
    joined = df.join(F.broadcast(w), F.lit(True), "left")
    return joined.select(*keep, *[(F.col(f) * F.col(f"_w_{f}")).alias(f) for f in features])


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: str = "idx",
    train: float = 0.6,
    valid: float = 0.2,
    test: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """``part`` in train/valid/test with exact shares inside every class, in a seeded random order."""
    if not math.isclose(train + valid + test, 1.0):
        raise ValueError("train, valid and test must sum to 1")
    mixed = df.withColumn("_mix", F.xxhash64(F.lit(seed), F.col(key)))
    placed = prefix_sums(mixed, [label], ["_mix", key], {"_c": F.lit(1)})
    share = (F.col("_c_upto") - 1) / F.col("_c_total")
    part = F.when(share < train, "train").when(share < train + valid, "valid").otherwise("test")
    return placed.withColumn("part", part).drop("_mix", "_c_upto", "_c_total")


def recode_sets(column: Column, groups: dict, otherwise) -> Column:
    """Value -> code of the set it belongs to."""
    out = None
    for code, members in groups.items():
        hit = column.isin(list(members))
        out = F.when(hit, F.lit(code)) if out is None else out.when(hit, F.lit(code))
    return out.otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def recode_ranges(column: Column, limits: list[tuple[float, str]], otherwise: str) -> Column:
    """Value -> name of the first upper limit it does not exceed."""
    out = None
    for limit, name in limits:
        hit = column <= limit
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(otherwise))


# Carrier and airport groups of the airline recode.
CARRIER_GROUPS = {
    2: ("UA", "AA", "DL", "WN", "US", "CO", "B6", "AS"),
    1: ("MQ", "OH", "EV", "9E", "YV", "OO", "XE"),
}
AIRPORT_GROUPS = {
    2: ("ATL", "ORD", "DFW", "DEN", "LAX", "JFK", "SFO", "CLT", "LAS", "PHX"),
    1: ("SEA", "MIA", "IAH", "MSP", "DTW", "BOS", "PHL", "LGA", "EWR", "BWI"),
}
# Limits and names of the prior-count recode.
PRIOR_COUNT_LIMITS = [(0, "0"), (3, "1 to 3")]
PRIOR_COUNT_OTHERWISE = "More than 3"


def recode_airline(column: Column) -> Column:
    return recode_sets(column, CARRIER_GROUPS, 0)


def recode_airport(column: Column) -> Column:
    return recode_sets(column, AIRPORT_GROUPS, 0)


def cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, distinct_values)``: nulls don't count."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in columns]))
        .alias("r")
    ).select("r.*")
    return long.where("v is not null").distinct().groupBy("feature").agg(F.count("v").alias("distinct_values"))


def drop_by_cardinality(df: DataFrame, columns: list[str], n: int = 1) -> DataFrame:
    """Drop the columns that hold exactly ``n`` distinct values."""
    found = cardinalities(df, columns).where(F.col("distinct_values") == n).collect()
    return df.drop(*[r.feature for r in found])


def concept_b_share(idx: Column, position: int, width: int) -> Column:
    """Probability that a row shows the new concept; the exponent is kept within +-500."""
    v = -4.0 * (idx - position) / max(1, width)
    return 1.0 / (1.0 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), v))))


def mix_concepts(
    a: DataFrame, b: DataFrame, position: int, width: int, idx: str = "idx", seed: int = 42
) -> DataFrame:
    """At every position the row of ``a`` or of ``b``: sudden when width < 2, else a sigmoid mix.

    The choice is a function of the position, so both tables are filtered and no join is needed.
    """
    at = F.col(idx)
    new = at >= position if width < 2 else hash_uniform(at, seed=seed) < concept_b_share(at, position, width)
    return a.where(~new).unionByName(b.where(new))


def inject_label_drift(
    df: DataFrame,
    positions: list[int],
    label: str = "label",
    idx: str = "idx",
    classes: int = 2,
    duration: int = 1,
    seed: int = 42,
) -> DataFrame:
    """Shift integer labels by one class (a flip for two) after every other position.

    With ``duration`` > 1 the rows leading into a switch show the new labels with growing probability.
    """
    at, y = F.col(idx), F.col(label).cast("int")
    begun = sum([(at >= p + duration - 1).cast("int") for p in positions], F.lit(0))
    switched = begun % 2 == 1
    turned = F.when(switched, (y + 1) % classes).otherwise(y)
    for p in positions if duration > 1 else []:
        inside = (at >= p) & (at < p + duration - 1)
        share = (at - p + 1) / duration
        turned = F.when(inside & (hash_uniform(at, seed=seed) < share), (turned + 1) % classes).otherwise(turned)
    return df.withColumn(label, turned)


def weight_inversion_labels(
    df: DataFrame, features: list[str], flipped: int, position: int, idx: str = "idx", width: int = 1, seed: int = 42
) -> DataFrame:
    """label = linear score above its median; the first ``flipped`` weights change sign after the drift."""
    if flipped <= 0:
        raise ValueError("at least one weight must flip")
    plain = sum([F.col(f) for f in features], F.lit(0.0))
    turned = sum([F.col(f) * (-1.0 if i < flipped else 1.0) for i, f in enumerate(features)], F.lit(0.0))
    scored = df.withColumn("_pre", plain).withColumn("_post", turned)
    long = scored.select(
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in ("_pre", "_post")])
        ).alias("r")
    ).select("r.*")
    medians = quantiles(long, ["score"], {"m": 0.5}).groupBy().agg(
        F.max(F.when(F.col("score") == "_pre", F.col("m"))).alias("_mpre"),
        F.max(F.when(F.col("score") == "_post", F.col("m"))).alias("_mpost"),
    )
    at = F.col(idx)
    new = at >= position if width < 2 else hash_uniform(at, seed=seed) < concept_b_share(at, position, width)
    y = F.when(new, F.col("_post") > F.col("_mpost")).otherwise(F.col("_pre") > F.col("_mpre"))
    return (
        scored.join(F.broadcast(medians), F.lit(True), "left")
        .withColumn("y", y.cast("int"))
        .select(*df.columns, "y")
    )
