"""Connected components of a table of links, as Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwise.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id in a link; the component is its smallest id.

    Alternating stars: each id hands its smallest neighbour to its larger, then to its smaller neighbours, until every link
    points to the smallest id of its component. The number of rounds grows with the logarithm of the longest path; every round
    is checkpointed. Nothing but two totals per round reaches the driver.
    """
    one_way = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    seen = None
    while True:
        both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array("a", "b")).alias("a")
        one_way = cut_lineage(large.join(least, "a").select(ends, F.col("m").alias("b")).where("a <> b").distinct())
        now = tuple(one_way.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if now == seen:
            break
        seen = now
    roots = one_way.select(F.col("b").alias("id")).distinct()
    return one_way.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
