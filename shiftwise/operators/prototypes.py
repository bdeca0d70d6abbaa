"""Selecting prototypes per window and class, and assigning rows to them.

Rows: ``(window_id, idx, label, features array<double>)``, for tree distances also ``leaves array<int>`` (leaf per
tree). Prototypes: the same columns plus ``proto_rank`` (order of selection in its class). Windows have a fixed
size, so everything grouped by window is bounded; the number of windows is what grows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.functions.columns import agreement, l2, squared_l2
from shiftwise.operators.clusters import xmeans_per_class

PROTO_SCHEMA = "window_id long, label string, proto_rank int, idx long"


def forest_leaves(
    df: DataFrame, trees: int = 100, depth: int = 8, seed: int = 42, label: str = "label", features: str = "features"
) -> DataFrame:
    """Fit one forest on all rows and add ``leaves`` (leaf per tree) and ``model_label`` (its prediction)."""
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(df)
    prepared = indexer.transform(df).withColumn("_x", array_to_vector(F.col(features)))
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="_y", leafCol="_leaf", numTrees=trees, maxDepth=depth, seed=seed
    ).fit(prepared)
    names = F.array(*[F.lit(n) for n in indexer.labels])
    scored = forest.transform(prepared)
    return scored.select(
        *df.columns,
        F.transform(vector_to_array("_leaf"), lambda v: v.cast("int")).alias("leaves"),
        F.get(names, F.col("prediction").cast("int")).alias("model_label"),
    )


def tree_similarity(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One matrix row per input row: ``others`` (ids in order) and ``similarity`` = shared leaves / trees.

    A matrix row is an array, so a window of n rows gives n rows and not n^2.
    """
    keys = keys or ["window_id", "label"]
    types = dict(rows.dtypes)

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        leaves = np.stack(pdf["leaves"].to_numpy())
        ids = pdf["idx"].to_numpy()
        out = pdf[[*keys, "idx"]].copy()
        out["others"] = [ids] * len(ids)
        out["similarity"] = [(leaves == row).mean(axis=1) for row in leaves]
        return out

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["idx long", "others array<long>", "similarity array<double>"])
    return rows.select(*keys, "idx", "leaves").groupBy(*keys).applyInPandas(matrix, schema)


def tree_distance(similarities: DataFrame) -> DataFrame:
    """1 - similarity."""
    return similarities.withColumn("distance", F.transform("similarity", lambda s: 1.0 - s)).drop("similarity")


def _distances(leaves: np.ndarray) -> np.ndarray:
    return 1.0 - (leaves[:, None, :] == leaves[None, :, :]).mean(axis=2)


class _ClassState:
    """Greedy cover of one class: distances, current nearest distance per row, chosen rows."""

    def __init__(self, ids: np.ndarray, leaves: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.distances = ids[order], _distances(leaves[order])
        self.nearest: np.ndarray | None = None
        self.chosen: list[int] = []

    def best(self) -> tuple[int, float]:
        """Row that lowers the total nearest distance most, and by how much (first: against distance 1)."""
        n = len(self.ids)
        if self.nearest is None:
            totals, current = self.distances.sum(axis=1), float(n)
        else:
            totals, current = np.minimum(self.distances, self.nearest).sum(axis=1), self.nearest.sum()
        totals = totals.copy()
        totals[self.chosen] = np.inf
        if len(self.chosen) == n:
            return -1, 0.0
        at = int(np.argmin(totals))
        return at, float(current - totals[at])

    def take(self, at: int) -> None:
        self.chosen.append(at)
        self.nearest = self.distances[at] if self.nearest is None else np.minimum(self.nearest, self.distances[at])


def _classes(pdf: pd.DataFrame) -> dict[str, _ClassState]:
    return {
        str(c): _ClassState(g["idx"].to_numpy(), np.stack(g["leaves"].to_numpy()))
        for c, g in sorted(pdf.groupby("label"), key=lambda kv: kv[0])
    }


def _chosen_rows(window_id: int, states: dict[str, _ClassState]) -> pd.DataFrame:
    rows = [(window_id, c, r, int(s.ids[at])) for c, s in states.items() for r, at in enumerate(s.chosen)]
    return pd.DataFrame(rows, columns=["window_id", "label", "proto_rank", "idx"])


def _per_window(rows: DataFrame, select: Callable[[int, pd.DataFrame], pd.DataFrame], extra: tuple = ()) -> DataFrame:
    """Run a selector on each window (bounded by the window size) and attach the chosen rows' columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return select(int(pdf["window_id"].iloc[0]), pdf)

    chosen = rows.select("window_id", "idx", "label", "leaves", *extra).groupBy("window_id").applyInPandas(run, PROTO_SCHEMA)
    kept = [c for c in ("features", "leaves") if c in rows.columns]
    return chosen.join(rows.select("window_id", "idx", *kept), ["window_id", "idx"])


def greedy_kmedoids(rows: DataFrame, k: int = 3) -> DataFrame:
    """P5: ``k`` prototypes per class, each the greatest cut of the total nearest tree distance."""

    def select(w: int, pdf: pd.DataFrame) -> pd.DataFrame:
        states = _classes(pdf)
        for s in states.values():
            for _ in range(min(k, len(s.ids))):
                s.take(s.best()[0])
        return _chosen_rows(w, states)

    return _per_window(rows, select)


def _best_class(states: dict[str, _ClassState], weighted: bool) -> tuple[str, int, float]:
    top = ("", -1, -np.inf)
    for c, s in states.items():
        at, gain = s.best()
        gain = gain / len(s.ids) if weighted else gain
        if at >= 0 and gain > top[2]:
            top = (c, at, gain)
    return top


def greedy_global(rows: DataFrame, k: int = 3, weighted: bool = False) -> DataFrame:
    """``k`` prototypes per window; each round the class with the greatest cut gets one.

    ``weighted`` (P7) divides the cut by the class size.
    """

    def select(w: int, pdf: pd.DataFrame) -> pd.DataFrame:
        states = _classes(pdf)
        for _ in range(k):
            c, at, _ = _best_class(states, weighted)
            if at < 0:
                break
            states[c].take(at)
        return _chosen_rows(w, states)

    return _per_window(rows, select)


def greedy_weighted(rows: DataFrame, k: int = 3) -> DataFrame:
    """P7."""
    return greedy_global(rows, k, weighted=True)


def greedy_supervised(rows: DataFrame, k: int = 3) -> DataFrame:
    """Each round the row whose addition makes prototype prediction most accurate; stops when none helps."""

    def select(w: int, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "idx"]).reset_index(drop=True)
        labels, ids = pdf["label"].to_numpy(), pdf["idx"].to_numpy()
        rank = np.unique(labels, return_inverse=True)[1]
        similar = 1.0 - _distances(np.stack(pdf["leaves"].to_numpy()))
        best, owner = np.zeros(len(ids)), np.full(len(ids), len(ids))
        accuracy, chosen = 0.0, []
        for _ in range(k):
            top = (accuracy, -1)
            for c in range(len(ids)):
                wins = (similar[c] > best) | ((similar[c] == best) & (best > 0) & (rank[c] < owner))
                score = (np.where(wins, rank[c], owner) == rank).mean()
                if c not in chosen and score > top[0]:
                    top = (score, c)
            accuracy, c = top
            if c < 0:
                break
            chosen.append(c)
            wins = (similar[c] > best) | ((similar[c] == best) & (best > 0) & (rank[c] < owner))
            owner, best = np.where(wins, rank[c], owner), np.maximum(best, similar[c])
        taken: dict[str, int] = {}
        out = []
        for c in chosen:
            r = taken.get(labels[c], 0)
            taken[labels[c]] = r + 1
            out.append((w, labels[c], r, int(ids[c])))
        return pd.DataFrame(out, columns=["window_id", "label", "proto_rank", "idx"])

    return _per_window(rows, select)


def _grow(states: dict[str, _ClassState], alpha: float) -> None:
    """Add prototypes until the gain settles (relative change <= alpha) or nothing is gained."""
    before = 0.0
    while True:
        c, at, gain = _best_class(states, weighted=False)
        if at < 0:
            return
        states[c].take(at)
        if gain == 0 or abs(before - gain) / gain <= alpha:
            return
        before = gain


def apete(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """P9."""

    def select(w: int, pdf: pd.DataFrame) -> pd.DataFrame:
        states = _classes(pdf)
        _grow(states, alpha)
        return _chosen_rows(w, states)

    return _per_window(rows, select)


def prototypes_per_window(rows: DataFrame, alpha: float = 0.01, few: int = 2, redo_alpha: float = 0.05) -> DataFrame:
    """P10: P9 per window; a class left with at most ``few`` prototypes is done again on its own."""

    def select(w: int, pdf: pd.DataFrame) -> pd.DataFrame:
        states = _classes(pdf)
        _grow(states, alpha)
        for c, s in states.items():
            if len(s.chosen) <= few:
                s.nearest, s.chosen = None, []
                _grow({c: s}, redo_alpha)
        return _chosen_rows(w, states)

    return _per_window(rows, select)


def nearest_to_centres(rows: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """Real row next to every centre of its class, no row twice: ``(label, proto_rank, idx)``.

    Input centres ``(label, centre_no, centre)``, at most k per class. The k nearest rows of each centre are enough
    to choose from: each task keeps k rows per centre, and k * k per class are left for the ordered choice.
    """
    listed = centres.groupBy("label").agg(F.collect_list(F.struct("centre_no", "centre")).alias("_c"))
    measured = rows.join(F.broadcast(listed), "label").select(
        "label", "idx", "features", F.explode("_c").alias("_c")
    ).select("label", "idx", F.col("_c.centre_no").alias("centre_no"),
             squared_l2(F.col("features"), F.col("_c.centre")).alias("d"))
    place = F.row_number().over(Window.partitionBy("label", "centre_no").orderBy("d", "idx"))
    near = measured.withColumn("_r", place).where(F.col("_r") <= k)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for no, g in pdf.sort_values(["centre_no", "d", "idx"]).groupby("centre_no"):
            free = g[~g["idx"].isin(used)]
            if len(free):
                used.add(free["idx"].iloc[0])
                out.append((free["label"].iloc[0], int(no), int(free["idx"].iloc[0])))
        return pd.DataFrame(out, columns=["label", "proto_rank", "idx"])

    return near.select("label", "centre_no", "idx", "d").groupBy("label").applyInPandas(
        choose, "label string, proto_rank int, idx long"
    )


def kmeans_prototypes(rows: DataFrame, size: int, k: int = 3, rounds: int = 20) -> DataFrame:
    """K-means per class over the whole table, all classes in the same jobs, then the nearest real rows."""
    fitted = xmeans_per_class(rows.withColumn("side", F.lit("all")), size, k_init=k, k_max=k, rounds=rounds)
    centres = fitted.select("label", F.explode("centres").alias("c")).select(
        "label", F.col("c.id").alias("centre_no"), F.col("c.v").alias("centre")
    )
    chosen = nearest_to_centres(rows, centres, k)
    return chosen.join(rows.drop("label"), "idx")


def proto_lists(protos: DataFrame, value: str = "features", by: str = "window_id") -> DataFrame:
    """One row per window: its prototypes in class and rank order, ``protos array<struct<label,rank,v,id>>``."""
    listed = protos.groupBy(by).agg(
        F.sort_array(
            F.collect_list(
                F.struct("label", F.col("proto_rank").alias("rank"), F.col(value).alias("v"), F.col("idx").alias("pidx"))
            )
        ).alias("_p")
    )
    return listed.select(
        by,
        F.transform(
            "_p",
            lambda p, i: F.struct(
                i.cast("int").alias("id"), p["label"].alias("label"), p["rank"].alias("rank"), p["v"].alias("v"),
                p["pidx"].alias("pidx"),
            ),
        ).alias("protos"),
    )


def nearest_l2(x: Column, protos: Column) -> Column:
    """Struct ``(d, id, label)`` of the nearest prototype, first wins."""
    return F.array_min(
        F.transform(protos, lambda p: F.struct(l2(x, p["v"]).alias("d"), p["id"].alias("id"), p["label"].alias("label")))
    )


def ranked_tree(leaves: Column, protos: Column) -> Column:
    """Prototypes as ``(m, id, label)``, ``m`` = minus the shared leaves, most similar first, first wins."""
    return F.array_sort(
        F.transform(
            protos,
            lambda p: F.struct((-agreement(leaves, p["v"])).alias("m"), p["id"].alias("id"), p["label"].alias("label")),
        )
    )


def assign_tree_prototype(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """``predicted`` class and ``proto_id`` of the most similar prototype of the row's window.

    A prototype must share at least one leaf; else the class is null and the id -1.
    """
    joined = rows.join(proto_lists(protos, "leaves"), "window_id", "left")
    best = F.get(ranked_tree(F.col("leaves"), F.col("protos")), F.lit(0))
    hit = F.col("_b")["m"] < 0
    return joined.withColumn("_b", best).select(
        *rows.columns,
        F.when(hit, F.col("_b")["label"]).alias("predicted"),
        F.when(hit, F.col("_b")["id"]).otherwise(-1).alias("proto_id"),
    )


def assign_l2_prototype(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """``predicted`` class, ``proto_id`` and ``distance`` of the nearest prototype of the row's window."""
    joined = rows.join(proto_lists(protos), "window_id", "left")
    return joined.withColumn("_b", nearest_l2(F.col("features"), F.col("protos"))).select(
        *rows.columns,
        F.col("_b")["label"].alias("predicted"),
        F.col("_b")["id"].alias("proto_id"),
        F.col("_b")["d"].alias("distance"),
    )


def prototype_score(assigned: DataFrame, truth: str = "label") -> DataFrame:
    """Accuracy of the prototype predictions per window (class accuracies weighted by class share)."""
    right = F.coalesce(F.col("predicted") == F.col(truth), F.lit(False)).cast("double")
    return assigned.groupBy("window_id").agg(F.count(F.lit(1)).alias("rows"), F.avg(right).alias("score"))
