"""Where an old and a new model disagree.

Rows carry scaled features. The explaining tree has depth 4, so at most 16 leaves and as many rules; they are plain
Python values, and applying them is one CASE WHEN over the rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.functions.columns import all_of
from shiftwise.operators.importance import Classifier
from shiftwise.operators.project import Projection


def both_predictions(old: Classifier, new: Classifier, rows: DataFrame) -> DataFrame:
    """Add ``old_label``, ``new_label`` and ``disagree``."""
    first = old.predict(rows).withColumnRenamed("predicted", "old_label").drop("predicted_no", "probability")
    second = new.predict(first).withColumnRenamed("predicted", "new_label").drop("predicted_no", "probability")
    return second.withColumn("disagree", (F.col("old_label") != F.col("new_label")).cast("int"))


def model_disagreement(predictions: DataFrame) -> DataFrame:
    """B1: one row with the rows and the share of disagreement."""
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col("old_label") != F.col("new_label")).cast("double")).alias("drift_rate"),
    )


def projection_grid(after: DataFrame, plane: Projection, grid: int = 300, margin: float = 0.1) -> DataFrame:
    """B2: ``grid x grid`` points over the after rows' bounds on the plane, with their features.

    Two sequences of ``grid`` coordinates make the points, so the size is a parameter and not data.
    """
    a, b = F.col(f"{plane.prefix}1"), F.col(f"{plane.prefix}2")
    box = plane.transform(after).agg(
        F.min(a).alias("x0"), F.max(a).alias("x1"), F.min(b).alias("y0"), F.max(b).alias("y1")
    ).first()
    wx, wy = (box.x1 - box.x0) * margin, (box.y1 - box.y0) * margin
    spark = after.sparkSession

    def line(no: Column, low: float, high: float) -> Column:
        return F.lit(low) + no * F.lit((high - low) / (grid - 1))

    points = spark.range(grid * grid).select(
        (F.col("id") % grid).cast("int").alias("gx"), F.floor(F.col("id") / grid).cast("int").alias("gy")
    )
    placed = points.select(
        "gx", "gy",
        line(F.col("gx"), box.x0 - wx, box.x1 + wx).alias(f"{plane.prefix}1"),
        line(F.col("gy"), box.y0 - wy, box.y1 + wy).alias(f"{plane.prefix}2"),
    )
    return placed.select("*", *plane.inverse_columns())


def grid_predictions(clf: Classifier, points: DataFrame) -> DataFrame:
    """Label and highest class probability per point."""
    out = clf.predict(points)
    return out.withColumn("confidence", F.array_max("probability")).drop("probability", "predicted_no")


@dataclass
class Rule:
    """A leaf of the tree as bounds ``low < x <= high`` per feature, in the units the tree saw."""

    leaf: int
    low: dict[str, float] = field(default_factory=dict)
    high: dict[str, float] = field(default_factory=dict)

    def condition(self) -> Column:
        parts = [F.col(f) > v for f, v in self.low.items()] + [F.col(f) <= v for f, v in self.high.items()]
        return all_of(parts) if parts else F.lit(True)


def disagreement_tree(predictions: DataFrame, features: list[str], depth: int = 4, leaf_share: float = 0.01, seed: int = 42):
    """A tree of depth 4 for ``disagree``, both classes weighing the same, at least 1 % of the rows per leaf.

    Returns None when every row agrees (or every row disagrees).
    """
    counts = predictions.agg(F.count(F.lit(1)).alias("n"), F.sum("disagree").alias("d")).first()
    if not counts.d or counts.d == counts.n:
        return None
    weight = F.when(F.col("disagree") == 1, counts.n / (2.0 * counts.d)).otherwise(counts.n / (2.0 * (counts.n - counts.d)))
    prepared = predictions.select(
        array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("_x"),
        F.col("disagree").cast("double").alias("_y"), weight.alias("_w"),
    )
    return DecisionTreeClassifier(
        featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=depth, seed=seed,
        minInstancesPerNode=max(1, math.ceil(leaf_share * counts.n)), maxBins=64,
    ).fit(prepared)


def tree_leaves(tree, features: list[str]) -> list[Rule]:
    """Leaves from left to right with the bounds on their path, read from the tree's printed form."""
    rules, path = [], []
    for raw in tree.toDebugString.splitlines()[1:]:
        depth = len(raw) - len(raw.lstrip())
        text = raw.strip()
        hit = re.match(r"(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+|-?Infinity)\)", text)
        if hit:
            path = [p for p in path if p[0] < depth]
            path.append((depth, features[int(hit.group(2))], hit.group(3), float(hit.group(4).replace("Infinity", "inf"))))
        elif text.startswith("Predict"):
            rule = Rule(len(rules))
            for _, f, op, v in (p for p in path if p[0] < depth):
                if op == "<=":
                    rule.high[f] = min(rule.high.get(f, math.inf), v)
                else:
                    rule.low[f] = max(rule.low.get(f, -math.inf), v)
            rules.append(rule)
    return rules


def leaf_number(rules: list[Rule]) -> Column:
    out = None
    for r in rules:
        out = F.when(r.condition(), r.leaf) if out is None else out.when(r.condition(), r.leaf)
    return out.cast("int") if out is not None else F.lit(None).cast("int")


def drift_rules(tree, predictions: DataFrame, features: list[str]) -> tuple[list[Rule], dict[int, float]]:
    """Leaves whose balanced share of disagreement exceeds one half, with that share.

    One aggregate per leaf over the rows the tree was fitted on.
    """
    rules = tree_leaves(tree, features)
    per_leaf = predictions.groupBy(leaf_number(rules).alias("leaf")).agg(
        F.sum("disagree").alias("d"), F.sum(1 - F.col("disagree")).alias("s")
    ).collect()
    d_all, s_all = sum(r.d for r in per_leaf), sum(r.s for r in per_leaf)
    share = {}
    for r in per_leaf:
        d, s = (r.d / d_all if d_all else 0.0), (r.s / s_all if s_all else 0.0)
        if d > s:
            share[r.leaf] = d / (d + s)
    return [r for r in rules if r.leaf in share], share


def unscale_bounds(scaled: DataFrame, raw: DataFrame, features: list[str], key: str = "idx") -> DataFrame:
    """B7 without a scaler: least-squares ``raw = m * scaled + c`` per feature from paired rows."""
    pair = scaled.select(key, *[F.col(f).alias(f"_s_{f}") for f in features]).join(
        raw.select(key, *[F.col(f).alias(f"_r_{f}") for f in features]), key
    )
    wide = pair.agg(
        *[F.regr_slope(F.col(f"_r_{f}"), F.col(f"_s_{f}")).alias(f"m_{f}") for f in features],
        *[F.regr_intercept(F.col(f"_r_{f}"), F.col(f"_s_{f}")).alias(f"c_{f}") for f in features],
        *[F.avg(f"_r_{f}").alias(f"a_{f}") for f in features],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.coalesce(f"m_{f}", F.lit(0.0)).alias("m"),
                F.coalesce(f"c_{f}", f"a_{f}").alias("c"),
            )
            for f in features
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def unscale_from_ranges(ranges: DataFrame) -> DataFrame:
    """B7 with a min-max scaler: ``m`` is the range and ``c`` the minimum, from ``(feature, lo, hi)``."""
    span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    return ranges.select("feature", span.alias("m"), F.col("lo").alias("c"))


def rule_text(rule: Rule, units: dict[str, tuple[float, float]], ranges: dict[str, tuple[float, float]]) -> str:
    """Bounds per feature in raw units; an open side shows the data's own minimum or maximum."""
    parts = []
    for f in dict.fromkeys([*rule.low, *rule.high]):
        m, c = units.get(f, (1.0, 0.0))
        lo, hi = ranges.get(f, (-math.inf, math.inf))
        low = max(lo, rule.low[f] * m + c) if f in rule.low else lo
        high = min(hi, rule.high[f] * m + c) if f in rule.high else hi
        left = "(-∞" if low == -math.inf else f"[{low:.2f}"
        right = "+∞)" if high == math.inf else f"{high:.2f}]"
        parts.append(f"{f} ∈ {left}, {right}")
    return ",  ".join(parts)


def rule_coverage(rules: list[Rule], rows: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """``(leaf, samples, coverage, grid_points, area, place)``, most covered first, then largest area.

    Rules are disjoint leaves, so each row gets at most one through a CASE WHEN, and counts combine on the map side.
    """
    spark = rows.sparkSession
    listed = spark.createDataFrame([(r.leaf,) for r in rules], "leaf int")

    def counted(df: DataFrame, n: str, share: str) -> DataFrame:
        total = Window.partitionBy()  # one row per rule and one for the rest
        c = df.groupBy(leaf_number(rules).alias("leaf")).agg(F.count(F.lit(1)).alias(n))
        return c.withColumn(share, F.col(n) / F.sum(n).over(total)).where("leaf is not null")

    out = listed.join(counted(rows, "samples", "coverage"), "leaf", "left")
    if grid is not None:
        out = out.join(counted(grid, "grid_points", "area"), "leaf", "left")
    else:
        out = out.withColumn("grid_points", F.lit(0).cast("long")).withColumn("area", F.lit(0.0))
    out = out.na.fill(0)
    place = F.row_number().over(Window.orderBy(F.col("coverage").desc(), F.col("area").desc(), "leaf"))
    return out.withColumn("place", place)


def drift_region_map(rules: list[Rule], places: dict[int, int], points: DataFrame) -> DataFrame:
    """0 where the models agree, else the number of the rule."""
    region = F.lit(0)
    for r in rules:
        region = F.when(r.condition(), F.lit(places[r.leaf])).otherwise(region)
    return points.withColumn("region", region.cast("int"))


def disagreement_table(
    old: Classifier, new: Classifier, rows: DataFrame, features: list[str], grid: DataFrame | None = None,
    units: dict[str, tuple[float, float]] | None = None, ranges: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """B1-B7 together: the rules where the models disagree; an empty table when they never do.

    The tree learns on the grid points when there are any, else on the rows.
    """
    schema = "rule_label string, rule string, confidence double, samples long, coverage double, area double, leaf int"
    spark = rows.sparkSession
    real = both_predictions(old, new, rows)
    rate = model_disagreement(real).first().drift_rate
    taught = both_predictions(old, new, grid) if grid is not None else real
    tree = disagreement_tree(taught, features) if rate else None
    if tree is None:
        return spark.createDataFrame([], schema)
    rules, share = drift_rules(tree, taught, features)
    if not rules:
        return spark.createDataFrame([], schema)
    text = spark.createDataFrame(
        [(r.leaf, rule_text(r, units or {}, ranges or {}), float(share[r.leaf])) for r in rules],
        "leaf int, rule string, confidence double",
    )
    return rule_coverage(rules, rows, grid).join(text, "leaf").select(
        F.format_string("Rule %d", "place").alias("rule_label"), "rule", "confidence", "samples", "coverage", "area", "leaf"
    )
