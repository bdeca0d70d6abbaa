"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_double(col: Column | str) -> Column:
    """Double with NaN turned into null, so that every aggregate skips it."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def vector(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def agreement(a: Column, b: Column) -> Column:
    """Number of positions at which two arrays hold the same value."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def mean_vector(col: str) -> Column:
    """Element-wise average of an array column: one vector aggregate whatever the length."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(col))))


def unpivot_stats(df, keys: list[str], features: list[str], stats: list[str]):
    """Wide ``<feature>__<stat>`` columns to rows ``(keys, feature, <stat>...)``."""
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("feature"), *[F.col(f"`{f}__{s}`").alias(s) for s in stats])
                for f in features
            ]
        )
    ).alias("_r")
    return df.select(*keys, rows).select(*keys, "_r.*")


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def hash_uniform(*cols, seed: int = 42) -> Column:
    """Repeatable number in [0, 1) per row, independent of partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))
