"""Moving frames over long ordered groups: blocks that share their border rows, one shuffle, no self join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 262_144


def moving(
    df: DataFrame,
    keys: list[str],
    behind: int,
    ahead: int,
    aggregates: dict[str, Column],
    idx: str = "idx",
    block: int | None = None,
) -> DataFrame:
    """Add ``aggregates`` evaluated over the rows ``idx - behind .. idx + ahead`` of the same keys.

    ``idx`` must be dense. A row goes to its own block and, near a border, to the neighbour that needs it, so a
    long group is spread over many tasks.
    """
    block = max(block or BLOCK_ROWS, behind, ahead, 1)
    at = F.col(idx)
    home = F.floor(at / block)
    inside = at - home * block
    places = F.array_compact(
        F.array(
            home,
            F.when((inside < ahead) & (home > 0), home - 1),
            F.when(inside >= block - behind, home + 1),
        )
    )
    copies = df.withColumn("_home", home).withColumn("_block", F.explode(places))
    frame = Window.partitionBy(*keys, "_block").orderBy(idx).rowsBetween(-behind, ahead)
    out = copies.select("*", *[c.over(frame).alias(n) for n, c in aggregates.items()])
    return out.where(F.col("_home") == F.col("_block")).drop("_home", "_block")
