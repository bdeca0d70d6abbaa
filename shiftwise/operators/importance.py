"""Classifiers and which features drive them (F1-F8).

A fitted classifier is a Spark ML model over wide feature columns. The three importance methods score modified
rows in bulk: variants of a row are rows of one DataFrame, and the model's ``transform`` runs once over all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.functions.columns import hash_uniform
from shiftwise.operators.ordered import index_rows, quantiles
from shiftwise.operators.profile import inverse_normal, long_form
from shiftwise.session import cut_lineage

# Model presets.
PRESETS = {
    "mlp": {"Default": {"hidden": (10, 10), "max_iter": 500}, "Deep Network": {"hidden": (50, 50, 50), "max_iter": 1000}},
    "random_forest": {"Default": {"trees": 100, "depth": 30}, "Simple Forest": {"trees": 10, "depth": 5, "min_split": 5}},
}
ROW = "_row"
TARGET = "_target"


@dataclass
class Classifier:
    """A fitted model with the names behind its class numbers."""

    model: object
    features: list[str]
    classes: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``predicted`` (class name), ``predicted_no`` and ``probability array<double>``."""
        x = array_to_vector(F.array(*[F.col(f).cast("double") for f in self.features]))
        out = self.model.transform(df.withColumn("_x", x))
        names = F.array(*[F.lit(c) for c in self.classes])
        return out.select(
            *df.columns,
            F.get(names, F.col("prediction").cast("int")).alias("predicted"),
            F.col("prediction").cast("int").alias("predicted_no"),
            vector_to_array("probability").alias("probability"),
        )

    def score(self, df: DataFrame, label: str = "label") -> float:
        hit = (F.col("predicted") == F.col(label).cast("string")).cast("double")
        return float(self.predict(df).agg(F.avg(hit)).first()[0])


def fit_classifier(
    df: DataFrame, features: list[str], label: str = "label", kind: str = "mlp", params: dict | None = None, seed: int = 42
) -> Classifier:
    """a multilayer perceptron or a random forest. Spark's perceptron has no L2 term and its trees stop at depth 30."""
    if kind not in PRESETS:
        raise ValueError(f"unknown model {kind!r}")
    p = {**PRESETS[kind]["Default"], **(params or {})}
    if (p.get("depth") or 30) > 30:
        raise ValueError("trees are at most 30 deep")
    classes = [r[0] for r in df.select(F.col(label).cast("string")).distinct().orderBy(label).collect()]
    if len(classes) < 2:
        raise ValueError("need at least two classes")
    numbers = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    prepared = df.select(
        array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("_x"),
        numbers[F.col(label).cast("string")].alias("_y"),
    )
    common = {"featuresCol": "_x", "labelCol": "_y", "seed": seed}
    if kind == "mlp":
        learner = MultilayerPerceptronClassifier(
            layers=[len(features), *p["hidden"], len(classes)], maxIter=p["max_iter"], **common
        )
    else:
        learner = RandomForestClassifier(
            numTrees=p["trees"], maxDepth=p["depth"] or 30,
            minInstancesPerNode=max(1, p.get("min_split", 2) // 2), **common
        )
    prepared = prepared.persist()
    model = learner.fit(prepared)
    prepared.unpersist()
    return Classifier(model, features, classes)


def time_rows(df: DataFrame, features: list[str], include_target: bool) -> tuple[DataFrame, list[str]]:
    """F2 input: label 0 before, 1 after; with ``include_target`` the class number is one more feature ``TARGET``."""
    named = df.withColumn("time", F.when(F.col("side") == "before", "0").otherwise("1"))
    if not include_target:
        return named, list(features)
    classes = [r.label for r in df.select("label").distinct().orderBy("label").collect()]
    number = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    return named.withColumn(TARGET, number[F.col("label")]), [*features, TARGET]


def time_classifier(
    df: DataFrame, features: list[str], include_target: bool = True, kind: str = "mlp", params: dict | None = None
) -> tuple[Classifier, DataFrame]:
    """a model that tells before from after; its rows come along."""
    rows, used = time_rows(df, features, include_target)
    return fit_classifier(rows, used, "time", kind, params), rows


ROUNDS, WALKS = 6, 32


def shuffled(idx: Column, repeat: Column, n: int, seed: int) -> Column:
    """A permutation of 0..n-1 per ``repeat``, as an expression of the position.

    The position is split as ``left * wide + right`` on a grid of ``tall * wide`` cells, barely more than ``n``; Feistel rounds add
    hashes of one half to the other, which is a bijection of the grid. A position that leaves 0..n-1 walks on until it is back:
    at most as many cells are outside as the grid is tall, so for ``n`` up to a thousand ``WALKS`` walks always suffice, and beyond, more
    are needed with a chance below ``n ** -16``.
    """
    walks = F.sequence(F.lit(1), F.lit(WALKS))
    return F.aggregate(walks, _turned(idx.cast("long"), repeat, n, seed), lambda x, _: F.when(x < n, x).otherwise(_turned(x, repeat, n, seed)))


def _grid(n: int) -> tuple[int, int]:
    tall = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return tall, max(1, -(-n // tall))


def _mixed(half: Column, k: Column, repeat: Column, seed: int, m: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), repeat, k, half), F.lit(m))


def _turned(x: Column, repeat: Column, n: int, seed: int) -> Column:
    tall, wide = _grid(n)
    start = F.struct(F.floor(x / wide).cast("long").alias("l"), F.pmod(x, F.lit(wide)).cast("long").alias("r"))

    def one(acc: Column, k: Column) -> Column:
        even = k % 2 == 0
        left = F.when(even, F.pmod(acc["l"] + _mixed(acc["r"], k, repeat, seed, tall), F.lit(tall))).otherwise(acc["l"])
        right = F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + _mixed(acc["l"], k, repeat, seed, wide), F.lit(wide)))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one, lambda acc: acc["l"] * wide + acc["r"])


def with_shuffled(df: DataFrame, idx: str, repeat: str, n: int, seed: int, name: str) -> DataFrame:
    """Add ``shuffled(idx, repeat, n, seed)``: the rounds of the first turn are plain columns, which Spark compiles; only the few
    positions that it leaves outside 0..n-1 take the expression's walks."""
    tall, wide = _grid(n)
    at = F.col(idx).cast("long")
    out = df.withColumns({"_left": F.floor(at / wide).cast("long"), "_right": F.pmod(at, F.lit(wide)).cast("long")})
    for k in range(ROUNDS):
        to, by, m = ("_left", "_right", tall) if k % 2 == 0 else ("_right", "_left", wide)
        out = out.withColumn(to, F.pmod(F.col(to) + _mixed(F.col(by), F.lit(k), F.col(repeat), seed, m), F.lit(m)).cast("long"))
    out = out.withColumn(name, F.col("_left") * wide + F.col("_right"))
    walks = F.sequence(F.lit(1), F.lit(WALKS))
    back = F.aggregate(walks, F.col(name), lambda x, _: F.when(x < n, x).otherwise(_turned(x, F.col(repeat), n, seed)))
    return out.withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(back)).drop("_left", "_right")


def permutation_importance(
    clf: Classifier, rows: DataFrame, label: str, order: list[str], repeats: int = 30, seed: int = 42
) -> DataFrame:
    """``(feature, repeat, importance)`` = accuracy drop when a feature's values are shuffled.

    A shuffle is a permutation of positions (``shuffled``), any number of them at any size: every row meets its partner by an
    equi-join on the position, and all features of the partner travel at once. Input rows need a unique ``order``.
    """
    if repeats < 1:
        raise ValueError("repeats must be positive")
    kept = rows.select(*order, *clf.features, F.col(label).cast("string").alias("_y"))
    indexed = index_rows(kept.select(*dict.fromkeys([*order, *clf.features, "_y"])), order, name=ROW)
    placed = cut_lineage(indexed.select(ROW, "_y", *clf.features))
    n = placed.count()
    base = clf.predict(placed).agg(F.avg((F.col("predicted") == F.col("_y")).cast("double"))).first()[0]
    names = F.array(*[F.lit(c) for c in clf.classes])
    known = F.coalesce(F.array_position(names, F.col("_y")), F.lit(0)).cast("int")  # from 1; 0: a class the model doesn't know
    numbered = placed.select(ROW, F.when(F.col("_y").isNotNull(), known).alias("_y"), *clf.features)
    spread = numbered.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    asked = with_shuffled(spread, ROW, "repeat", n, seed, "_from").drop(ROW)
    lent = placed.select(F.col(ROW).alias("_from"), *[F.col(f).alias(f"_lent_{f}") for f in clf.features])
    met = asked.join(lent, "_from")
    variants = F.array(
        *[
            F.struct(
                F.lit(i).alias("_feature"),
                *[F.col(f"_lent_{g}" if g == f else g).cast("double").alias(g) for g in clf.features],
            )
            for i, f in enumerate(clf.features)
        ]
    )
    flat = met.select("repeat", "_y", F.explode(variants).alias("_v")).select("repeat", "_y", "_v.*")
    hit = F.avg((F.col("predicted_no") + 1 == F.col("_y")).cast("double"))
    feature = F.get(F.array(*[F.lit(f) for f in clf.features]), F.col("_feature")).alias("feature")
    return clf.predict(flat).groupBy("_feature", "repeat").agg((F.lit(base) - hit).alias("importance")).select(feature, "repeat", "importance")


def summarise(raw: DataFrame) -> DataFrame:
    """``(feature, importance_mean, importance_std)`` over repeats or explained rows; population deviation."""
    return raw.groupBy("feature").agg(
        F.avg("importance").alias("importance_mean"), F.stddev_pop("importance").alias("importance_std")
    )


def _sample(rows: DataFrame, features: list[str], order: list[str], size: int, seed: int) -> DataFrame:
    """``size`` rows in the order of a seeded hash: the explained rows and the background are samples by definition."""
    return rows.orderBy(hash_uniform(*order, seed=seed), *order).limit(size).select(
        F.concat_ws("|", *[F.col(o).cast("string") for o in order]).alias(ROW), *features
    )


def coalition_weights(d: int, budget: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions ``z (m x d)`` and the matrix that turns their values into attributions ``(d x m)``.

    Up to 2^d <= budget all coalitions enter with the exact Shapley weights; beyond, a seeded sample with the
    Shapley kernel and the additivity constraint, solved once because the design is the same for every row.
    """
    if 2**d <= budget:
        z = np.array([[(c >> j) & 1 for j in range(d)] for c in range(2**d)])
        sizes = z.sum(axis=1)
        fact = [math.factorial(i) for i in range(d + 1)]
        out = np.zeros((d, len(z)))
        for j in range(d):
            for c in range(len(z)):
                s = int(sizes[c])
                if z[c, j]:
                    out[j, c] = fact[s - 1] * fact[d - s] / fact[d]
                else:
                    out[j, c] = -fact[s] * fact[d - s - 1] / fact[d]
        return z, out
    rng = np.random.default_rng(seed)
    p = np.array([(d - 1) / (s * (d - s)) for s in range(1, d)])
    seen: dict[tuple, float] = {}
    while len(seen) < budget - 2:
        row = np.zeros(d, int)
        row[rng.choice(d, rng.choice(np.arange(1, d), p=p / p.sum()), replace=False)] = 1
        for r in (row, 1 - row):
            seen[tuple(r)] = seen.get(tuple(r), 0.0) + 1.0
    z = np.array([*seen, (0,) * d, (1,) * d])
    inner, w = z[:-2], np.array(list(seen.values()))
    # last feature eliminated by additivity: sum of attributions = f(all) - f(none)
    x = inner[:, :-1] - inner[:, -1:]
    solve = np.linalg.pinv((x * w[:, None]).T @ x) @ (x * w[:, None]).T
    m = len(z)
    target = np.zeros((m - 2, m))  # v(z) - v(0) - z_d (v(1) - v(0))
    target[:, : m - 2] = np.eye(m - 2)
    target[:, m - 2] = -1 + inner[:, -1]
    target[:, m - 1] = -inner[:, -1]
    first = solve @ target
    last = -first.sum(axis=0)
    last[m - 2] -= 1
    last[m - 1] += 1
    return z, np.vstack([first, last])


def kernel_shap(
    clf: Classifier, rows: DataFrame, order: list[str], background: int = 100, sample: int = 500,
    class_no: int = 1, budget: int = 2048, seed: int = 42,
) -> DataFrame:
    """``(row, feature, phi, importance = |phi|)`` for sampled rows.

    Coalition values are the mean prediction over the background; attributions are fixed linear combinations of them.
    """
    spark = rows.sparkSession
    z, combine = coalition_weights(len(clf.features), budget, seed)
    masks = F.broadcast(spark.createDataFrame(
        [(i, [int(v) for v in r], [float(v) for v in combine[:, i]]) for i, r in enumerate(z)],
        "_c int, _z array<int>, _w array<double>",
    ))  # at most ``budget`` coalitions
    back = _sample(rows, clf.features, order, background, seed + 1)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(ROW)) - 1  # ``background`` rows
    numbered = cut_lineage(back.select(place.alias("_n"), F.struct(*clf.features).alias("_b")))
    lenders = numbered.count()
    asked = _sample(rows, clf.features, order, sample, seed).repartition(ROW)
    spread = asked.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(len(z) - 1)))).withColumn(
        "_n", F.explode(F.sequence(F.lit(0), F.lit(lenders - 1)))
    )
    mixed = spread.join(masks, "_c").join(F.broadcast(numbered), "_n").select(
        ROW, "_c", "_w",
        *[F.when(F.col("_z")[j] == 1, F.col(f)).otherwise(F.col("_b")[f]).alias(f) for j, f in enumerate(clf.features)],
    )
    value = clf.predict(mixed).groupBy(ROW, "_c").agg(
        F.avg(F.col("probability")[class_no]).alias("_v"), F.first("_w").alias("_w")
    )
    phi = value.select(
        ROW,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), (F.col("_v") * F.col("_w")[j]).alias("part"))
                    for j, f in enumerate(clf.features)
                ]
            )
        ).alias("_r"),
    )
    return phi.groupBy(F.col(ROW).alias("row"), F.col("_r.feature").alias("feature")).agg(
        F.sum("_r.part").alias("phi")
    ).withColumn("importance", F.abs("phi"))


def _bins(rows: DataFrame, features: list[str]) -> DataFrame:
    """One row: per feature the quartile bins with their share, mean, deviation and range."""
    long = long_form(rows.withColumn("_k", F.lit(0)), features, ["_k"]).drop("_k")
    cuts = quantiles(long, ["feature"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    v = F.col("value")
    bin_no = F.when(v <= F.col("q1"), 0).when(v <= F.col("q2"), 1).when(v <= F.col("q3"), 2).otherwise(3)
    stats = long.join(F.broadcast(cuts), "feature").groupBy("feature", bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("sd"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        *[F.max(q).alias(q) for q in ("q1", "q2", "q3")],
    )
    return stats.groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("bin", "n", "mean", "sd", "lo", "hi"))).alias("bins"),
        F.sum("n").alias("total"), *[F.max(q).alias(q) for q in ("q1", "q2", "q3")],
    )


def lime_importance(
    clf: Classifier, rows: DataFrame, order: list[str], sample: int = 100, perturbations: int = 1000,
    class_no: int = 1, ridge: float = 1.0, seed: int = 42,
) -> DataFrame:
    """``(row, feature, weight, importance = |weight|)``: a weighted ridge fit around each sampled row.

    A perturbed row draws a quartile bin per feature and a value in it; the local model sees "same bin as the
    explained row". Features are matched by name exactly.
    """
    info = {r.feature: r for r in _bins(rows, clf.features).collect()}  # at most four bins per feature
    known = [f for f in clf.features if f in info]
    asked = _sample(rows, clf.features, order, sample, seed)
    spread = asked.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(perturbations - 1)))).repartition(ROW, "_p")

    def own_bin(f: str, c: Column) -> Column:
        r = info[f]
        return F.when(c <= r.q1, 0).when(c <= r.q2, 1).when(c <= r.q3, 2).otherwise(3)

    original = F.col("_p") == 0
    draws = []
    for j, f in enumerate(known):
        u = hash_uniform(F.col(ROW), F.col("_p"), F.lit(j), seed=seed)
        shares = np.cumsum([b.n / info[f].total for b in info[f].bins])
        draws.append(F.least(sum([(u >= float(s)).cast("int") for s in shares[:-1]], F.lit(0)), F.lit(len(shares) - 1)).alias(f"_bin{j}"))
    drawn = spread.select("*", *draws)

    def of_bin(j: int, f: str, what: str) -> Column:
        return F.get(F.array(*[F.lit(float(b[what])) for b in info[f].bins]), F.col(f"_bin{j}"))

    cols, same = [], []
    for j, f in enumerate(known):
        t = F.greatest(F.lit(1e-9), hash_uniform(F.col(ROW), F.col("_p"), F.lit(j), seed=seed + 1))
        value = of_bin(j, f, "mean") + of_bin(j, f, "sd") * inverse_normal(t)
        held = F.greatest(of_bin(j, f, "lo"), F.least(of_bin(j, f, "hi"), value))
        cols.append(F.when(original, F.col(f)).otherwise(held).alias(f))
        same.append(F.when(original | (of_bin(j, f, "bin").cast("int") == own_bin(f, F.col(f))), 1.0).otherwise(0.0))
    others = [F.col(f) for f in clf.features if f not in known]
    perturbed = drawn.select(ROW, *others, *cols, F.array(*same).alias("_z"))
    d = len(known)
    off = F.aggregate("_z", F.lit(0.0), lambda s, x: s + (1 - x))
    width = 0.75 * math.sqrt(d)
    scored = clf.predict(perturbed).select(
        ROW, "_z", F.sqrt(F.exp(-off / (width * width))).alias("_w"), F.col("probability")[class_no].alias("_y")
    )
    # weighted normal equations per row: (d + 1)^2 sums
    terms = [F.lit(1.0)] + [F.col("_z")[j] for j in range(d)]
    sums = scored.groupBy(ROW).agg(
        F.array(*[F.sum(F.col("_w") * a * b) for a in terms for b in terms]).alias("xx"),
        F.array(*[F.sum(F.col("_w") * a * F.col("_y")) for a in terms]).alias("xy"),
    )
    size = d + 1

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        penalty = ridge * np.eye(size)
        penalty[0, 0] = 0.0
        return pd.Series(
            [np.linalg.solve(np.array(a).reshape(size, size) + penalty, np.array(b))[1:] for a, b in zip(xx, xy)]
        )

    solved = sums.select(ROW, solve("xx", "xy").alias("_b"))
    flat = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.col("_b")[j].alias("weight")) for j, f in enumerate(known)])
    )
    return solved.select(F.col(ROW).alias("row"), flat.alias("_r")).select("row", "_r.*").withColumn(
        "importance", F.abs("weight")
    )


METHODS = ("permutation", "shap", "lime")


def feature_importance(
    clf: Classifier, rows: DataFrame, label: str, order: list[str], method: str = "permutation", **kw
) -> DataFrame:
    """Mean and deviation of the importance per feature by one of the three methods."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "permutation":
        return summarise(permutation_importance(clf, rows, label, order, **kw))
    return summarise((kernel_shap if method == "shap" else lime_importance)(clf, rows, order, **kw))


def drift_importance(
    df: DataFrame, features: list[str], order: list[str], include_target: bool = True, method: str = "permutation",
    kind: str = "mlp", params: dict | None = None, **kw,
) -> DataFrame:
    """importance for telling before from after; concept drift with the target, data drift without. No row for the target."""
    clf, rows = time_classifier(df, features, include_target, kind, params)
    found = feature_importance(clf, rows, "time", order, method, **kw)
    return found.where(F.col("feature").isin(features))


def predictive_importance_shift(
    df: DataFrame, features: list[str], order: list[str], method: str = "permutation", kind: str = "mlp",
    params: dict | None = None, **kw,
) -> DataFrame:
    """importances of a model of the before rows and of a model of the after rows, side by side."""
    out = None
    for side in ("before", "after"):
        part = df.where(F.col("side") == side)
        clf = fit_classifier(part, features, "label", kind, params)
        found = feature_importance(clf, part, "label", order, method, **kw).select(
            "feature", F.col("importance_mean").alias(f"mean_{side}"), F.col("importance_std").alias(f"std_{side}")
        )
        out = found if out is None else out.join(found, "feature", "full")
    return out.withColumn("shift", F.col("mean_after") - F.col("mean_before"))


def importance_ranking(importances: DataFrame) -> DataFrame:
    """F8: features by mean importance, one row per feature."""
    place = F.row_number().over(Window.orderBy(F.col("importance_mean").desc(), "feature"))
    return importances.withColumn("place", place).orderBy("place")
