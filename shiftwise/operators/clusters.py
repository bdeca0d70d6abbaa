"""Cluster structure per class before and after, and what changed in it.

Rows: ``(side, label, <features>)``, scaled by ``standard_scale`` on the before side. Clustering carries them as
``features array<double>``; the criteria C5-C14 read ``(side, label, cluster, <features>)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.functions.columns import squared_l2
from shiftwise.functions.numeric import assign_min_cost
from shiftwise.operators.ordered import quantiles
from shiftwise.operators.profile import long_form, moments

GROUP = ["side", "label"]
STATS = ["median", "mean", "std"]
THR_SHIFT, THR_DISAPPEAR, THR_STATS, THR_DISTANCE, THR_DECISION = 0.15, 0.5, 0.2, 0.1, 0.5
WEIGHTS = (0.4, 0.25, 0.25, 0.1)
CRITERIA = ["cluster_count", "stats", "centroid_shift", "avg_distance"]


def _centre_table(spark, centres: dict[tuple, list[np.ndarray]]) -> DataFrame:
    rows = [(s, c, [(i, [float(x) for x in v]) for i, v in enumerate(vs)]) for (s, c), vs in centres.items()]
    return spark.createDataFrame(rows, "side string, label string, centres array<struct<id:int,v:array<double>>>")


def assign_clusters(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """``cluster`` of the nearest centre of the row's side and class and ``sq_dist`` to it.

    ``centres``: one row per (side, label) with at most ``k_max`` centres, so it is broadcast.
    """
    best = F.array_min(
        F.transform("centres", lambda c: F.struct(squared_l2(F.col("features"), c["v"]).alias("d"), c["id"].alias("id")))
    )
    out = rows.join(F.broadcast(centres), GROUP).withColumn("_b", best)
    return out.select(*rows.columns, F.col("_b.id").alias("cluster"), F.col("_b.d").alias("sq_dist"))


PARTS = "g int, cluster int, half int, n long, d double, total array<double>, squares array<double>"


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _summaries(
    rows: DataFrame, groups: list[tuple], centres: dict, halves: dict | None = None
) -> dict[tuple, dict[tuple[int, int], dict]]:
    """Per group and cluster (and trial half): rows, squared distance, mean and variance; one job.

    Every task assigns its rows batch by batch and emits one partial sum per cluster, so the shuffle carries
    (tasks x clusters) short rows. ``centres`` and ``halves`` hold at most ``k_max`` vectors per group.
    """
    known = {g: np.array(centres[k]) for g, k in enumerate(groups)}
    trial = {(groups.index(k), i): np.array(v) for (k, i), v in (halves or {}).items()}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], list] = {}

        def add(key, x, d):
            part = sums.setdefault(key, [0, 0.0, np.zeros(x.shape[1]), np.zeros(x.shape[1])])
            part[0] += len(x)
            part[1] += float(d.sum())
            part[2] += x.sum(axis=0)
            part[3] += (x * x).sum(axis=0)

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy(zero_copy_only=False)
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for no in np.unique(g):
                mine = x[g == no]
                at, d = _nearest(mine, known[int(no)])
                for c in np.unique(at):
                    inside, far = mine[at == c], d[at == c]
                    if not trial:
                        add((int(no), int(c), 0), inside, far)
                    elif (int(no), int(c)) in trial:
                        half, far = _nearest(inside, trial[(int(no), int(c))])
                        for h in np.unique(half):
                            add((int(no), int(c), int(h)), inside[half == h], far[half == h])
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64()),
                pa.array([sums[k][1] for k in keys], pa.float64()),
                pa.array([sums[k][2].tolist() for k in keys], pa.list_(pa.float64())),
                pa.array([sums[k][3].tolist() for k in keys], pa.list_(pa.float64())),
            ],
            names=["g", "cluster", "half", "n", "d", "total", "squares"],
        )

    def summed(c: str) -> Column:
        return vector_to_array(Summarizer.metrics("sum").summary(array_to_vector(c))["sum"]).alias(c)

    got = rows.mapInArrow(partial, PARTS).groupBy("g", "cluster", "half").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"), summed("total"), summed("squares")
    )
    out: dict[tuple, dict[tuple[int, int], dict]] = {k: {} for k in groups}
    for r in got.collect():
        mean = np.array(r.total) / r.n
        out[groups[r.g]][(r.cluster, r.half)] = {
            "n": r.n, "d": r.d, "mean": mean, "var": np.maximum(np.array(r.squares) / r.n - mean * mean, 0.0)
        }
    return out


def _lloyd(
    rows: DataFrame, groups: list[tuple], centres: dict, rounds: int, tolerance: float
) -> tuple[dict, dict[tuple, dict[int, dict]]]:
    """Move all centres of all groups together; stops when none moves further than ``tolerance``."""
    for turn in range(rounds + 1):
        seen = {k: {c: p for (c, _), p in ps.items()} for k, ps in _summaries(rows, groups, centres).items()}
        moved = {k: [seen[k][i]["mean"] if i in seen[k] else v for i, v in enumerate(vs)] for k, vs in centres.items()}
        step = max((float(np.linalg.norm(a - b)) for k in centres for a, b in zip(moved[k], centres[k])), default=0.0)
        if step <= tolerance or turn == rounds:
            break
        centres = moved
    return centres, seen


def _two_sided(part: dict) -> list[np.ndarray]:
    """Start of a split: one deviation to either side along the widest axis."""
    axis = int(np.argmax(part["var"]))
    off = np.zeros(len(part["mean"]))
    off[axis] = math.sqrt(part["var"][axis])
    return [part["mean"] - off, part["mean"] + off]


def information_score(parts: list[dict], size: int) -> float:
    """Bayesian information criterion of a spherical Gaussian mixture (Pelleg and Moore 2000); larger is better."""
    n, k = sum(p["n"] for p in parts), len(parts)
    if n <= k:
        return -math.inf
    sigma = sum(p["d"] for p in parts) / (n - k)
    if sigma <= 0:
        return math.inf
    free = (k - 1) + size * k + 1
    score = 0.0
    for p in parts:
        m = p["n"]
        score += m * math.log(m / n) - m / 2 * math.log(2 * math.pi) - m * size / 2 * math.log(sigma) - (m - k) / 2
        score -= free / 2 * math.log(n)
    return score


def xmeans_per_class(
    rows: DataFrame, size: int, k_init: int = 2, k_max: int = 10, rounds: int = 10, tolerance: float = 1e-3
) -> DataFrame:
    """X-means for every (side, label) at once: ``(side, label, centres)``.

    The driver holds at most ``k_max`` centres per group. Every Lloyd round of all groups, and of all trial splits,
    is one job over the rows; a split stays when it raises the information score of its parent. Rows with a null or NaN
    among their features take no part.
    """
    if not 1 <= k_init <= k_max:
        raise ValueError("need 1 <= k_init <= k_max")
    spark = rows.sparkSession
    rows = rows.where(F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))))
    groups = [tuple(r) for r in rows.select(*GROUP).distinct().orderBy(*GROUP).collect()]  # classes x sides
    named = spark.createDataFrame([(*k, g) for g, k in enumerate(groups)], "side string, label string, g int")
    work = rows.join(F.broadcast(named), GROUP).select("g", "features").persist()
    centres = {k: [np.zeros(size)] for k in groups}
    centres, parts = _lloyd(work, groups, centres, 1, math.inf)
    centres = {k: [p[0]["mean"]] for k, p in parts.items()}
    while _split_widest(centres, parts, k_init):
        centres, parts = _lloyd(work, groups, centres, rounds, tolerance)
    while k_init < k_max:
        starts = {
            (k, i): _two_sided(p)
            for k, ps in parts.items() for i, p in ps.items() if p["n"] >= 3 and np.any(p["var"] > 0)
        }
        if not starts:
            break
        trial = _trial_splits(work, groups, centres, starts, rounds, tolerance)
        grown = False
        for k in groups:
            free, kept = k_max - len(centres[k]), []
            for i, v in enumerate(centres[k]):
                pair = trial.get((k, i), [])
                better = len(pair) == 2 and information_score([parts[k][i]], size) < information_score(pair, size)
                if better and free > 0:
                    kept += [p["mean"] for p in pair]
                    free -= 1
                    grown = True
                elif i in parts[k]:
                    kept.append(v)
            centres[k] = kept
        if not grown:
            break
        centres, parts = _lloyd(work, groups, centres, rounds, tolerance)
    work.unpersist()
    return _centre_table(spark, centres)


def _trial_splits(
    rows: DataFrame, groups: list[tuple], centres: dict, halves: dict, rounds: int, tolerance: float
) -> dict[tuple, list[dict]]:
    """Two-means inside every cluster, all at once."""
    for turn in range(rounds + 1):
        seen = _summaries(rows, groups, centres, halves)
        moved, step = {}, 0.0
        for (k, i), pair in halves.items():
            moved[(k, i)] = [seen[k][(i, h)]["mean"] if (i, h) in seen[k] else v for h, v in enumerate(pair)]
            step = max([step, *[float(np.linalg.norm(a - b)) for a, b in zip(moved[(k, i)], pair)]])
        if step <= tolerance or turn == rounds:
            break
        halves = moved
    return {(k, i): [seen[k][(i, h)] for h in (0, 1) if (i, h) in seen[k]] for (k, i) in halves}


def _split_widest(centres: dict, parts: dict, wanted: int) -> bool:
    """Split the widest cluster of every group below the wanted number; False when nothing was split."""
    split = False
    for k, vs in centres.items():
        able = [i for i, p in parts[k].items() if p["n"] > 1 and np.any(p["var"] > 0)]
        if len(vs) < wanted and able:
            wide = max(able, key=lambda i: (float(np.max(parts[k][i]["var"])), -i))
            centres[k] = vs[:wide] + _two_sided(parts[k][wide]) + vs[wide + 1 :]
            split = True
    return split


def match_clusters(centres: DataFrame, size: int, thr: float = THR_DISAPPEAR) -> DataFrame:
    """``(label, old_id, new_id)``: as many pairs as possible, among those the smallest total distance; an unmatched side is null.

    Pairs further apart than ``thr * sqrt(size)`` may not match. A class has at most ``k_max`` centres per side.
    """
    limit = thr * math.sqrt(size)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        label = pdf["label"].iloc[0]
        sides = {s: {c["id"]: np.array(c["v"]) for c in cs} for s, cs in zip(pdf["side"], pdf["centres"])}
        old, new = sides.get("before", {}), sides.get("after", {})
        out = []
        if old and new:
            before, after = np.array(list(old.values())), np.array(list(new.values()))
            apart = np.sqrt(((before[:, None] - after[None]) ** 2).sum(axis=2))
            allowed = apart <= limit
            # Any allowed pair is worth more than all distances together: first as many pairs as possible, then the nearest.
            worth = 1.0 + limit * (len(old) + len(new))
            pairs = assign_min_cost(np.where(allowed, apart - worth, 0.0))
            out = [(label, list(old)[r], list(new)[c]) for r, c in pairs if allowed[r, c]]
        done_old, done_new = {o for _, o, _ in out}, {n for _, _, n in out}
        out += [(label, o, None) for o in old if o not in done_old]
        out += [(label, None, n) for n in new if n not in done_new]
        return pd.DataFrame(out, columns=["label", "old_id", "new_id"]).astype({"old_id": "Int32", "new_id": "Int32"})

    return centres.groupBy("label").applyInPandas(match, "label string, old_id int, new_id int")


def global_cluster_ids(matches: DataFrame) -> DataFrame:
    """C4: ``(side, label, local_id, cluster)``: old ids follow each other class by class, appeared ones come after.

    One row per cluster; the numbering runs over that small table.
    """
    by_class = Window.orderBy("label")
    sizes = matches.groupBy("label").agg(
        F.count("old_id").alias("n_old"), F.sum((F.col("old_id").isNull()).cast("int")).alias("n_new")
    )
    earlier = by_class.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "label",
        F.coalesce(F.sum("n_old").over(earlier), F.lit(0)).alias("old_from"),
        (F.sum("n_old").over(Window.partitionBy()) + F.coalesce(F.sum("n_new").over(earlier), F.lit(0))).alias("new_from"),
    )
    place = F.row_number().over(Window.partitionBy("label", F.col("old_id").isNull()).orderBy("new_id")) - 1
    numbered = matches.withColumn("_place", place).join(offsets, "label").withColumn(
        "cluster",
        F.when(F.col("old_id").isNull(), F.col("new_from") + F.col("_place"))
        .otherwise(F.col("old_from") + F.col("old_id")).cast("int"),
    )
    old = numbered.where("old_id is not null").select(
        F.lit("before").alias("side"), "label", F.col("old_id").alias("local_id"), "cluster"
    )
    new = numbered.where("new_id is not null").select(
        F.lit("after").alias("side"), "label", F.col("new_id").alias("local_id"), "cluster"
    )
    return old.unionByName(new)


def cluster_rows(rows: DataFrame, features: list[str], **kw) -> DataFrame:
    """C1-C4 together: rows with their global ``cluster``.

    Write the result to a table (or ``cut_lineage`` it) when several criteria are to be read from it.
    """
    vectors = rows.withColumn("features", F.array(*[F.col(f).cast("double") for f in features]))
    centres = xmeans_per_class(vectors, len(features), **kw)
    ids = global_cluster_ids(match_clusters(centres, len(features))).withColumnRenamed("local_id", "_local")
    local = assign_clusters(vectors, centres).withColumnRenamed("cluster", "_local").drop("features", "sq_dist")
    return local.join(F.broadcast(ids), [*GROUP, "_local"]).drop("_local")


def cluster_centroids(clustered: DataFrame, features: list[str]) -> DataFrame:
    """``(cluster, label, before array, after array, n_before, n_after)``, null where the cluster is missing."""
    old = F.col("side") == "before"
    return clustered.groupBy("cluster").agg(
        F.max("label").alias("label"),
        F.count(F.when(old, 1)).alias("n_before"),
        F.count(F.when(~old, 1)).alias("n_after"),
        F.array(*[F.avg(F.when(old, F.col(f))) for f in features]).alias("before"),
        F.array(*[F.avg(F.when(~old, F.col(f))) for f in features]).alias("after"),
    )


def centroid_shift(centroids: DataFrame, features: list[str], thr: float = THR_SHIFT) -> DataFrame:
    """Distance the centroid moved, its change per feature, and whether the cluster appeared or disappeared."""
    gone, fresh = F.col("n_after") == 0, F.col("n_before") == 0
    state = F.when(fresh, "appeared").when(gone, "disappeared").otherwise("present")
    there = ~gone & ~fresh
    move = F.when(there, F.sqrt(squared_l2(F.col("after"), F.col("before"))))
    deltas = [F.when(there, F.col("after")[i] - F.col("before")[i]).alias(f"delta_{f}") for i, f in enumerate(features)]
    limit = thr * math.sqrt(len(features))
    return centroids.select(
        "cluster", "label", state.alias("state"), *deltas, move.alias("shift"),
        F.when(there, move > limit).otherwise(True).alias("drift"),
    )


def cluster_stats(clustered: DataFrame, features: list[str]) -> DataFrame:
    """``(cluster, side, feature, median, mean, std)`` on the scaled rows."""
    keys = ["cluster", "side"]
    medians = quantiles(long_form(clustered, features, keys), [*keys, "feature"], {"median": 0.5})
    return moments(clustered, keys, features).select(*keys, "feature", "mean", "std").join(medians, [*keys, "feature"])


def cluster_stat_shift(stats: DataFrame) -> DataFrame:
    """Relative change per statistic; null when a side lacks it; a base below 1e-10 divides by 1."""
    old = F.col("side") == "before"
    pairs = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATS])
    long = stats.select("cluster", "side", "feature", F.explode(pairs).alias("_r")).select("cluster", "side", "feature", "_r.*")
    both = long.groupBy("cluster", "feature", "stat").agg(
        F.max(F.when(old, F.col("value"))).alias("before"), F.max(F.when(~old, F.col("value"))).alias("after")
    )
    base = F.when(F.abs("before") < 1e-10, 1.0).otherwise(F.abs("before"))
    return both.withColumn("shift", (F.col("after") - F.col("before")) / base)


def cluster_stat_drift(shifts: DataFrame, thr: float = THR_STATS) -> DataFrame:
    """Absolute change above ``thr``; a missing one counts as drift."""
    return shifts.withColumn("drift", F.coalesce(F.abs("shift") > thr, F.lit(True)))


def shift_heatmap_codes(shifts: DataFrame, thr: float = THR_STATS) -> DataFrame:
    """C14: 0 within the threshold, 1 beyond, 2 missing."""
    code = F.when(F.col("shift").isNull(), 2).when(F.abs("shift") > thr, 1).otherwise(0)
    return shifts.select("cluster", "feature", "stat", code.alias("code"))


def avg_distance_shift(
    clustered: DataFrame, centroids: DataFrame, features: list[str], thr: float = THR_DISTANCE
) -> DataFrame:
    """Mean distance to the own centroid per side and its relative change; a missing side counts as drift.

    ``centroids`` has one row per cluster (at most ``k_max`` per class and side) and is broadcast.
    """
    own = F.when(F.col("side") == "before", F.col("before")).otherwise(F.col("after"))
    gaps = [F.col(f).cast("double") - own[i] for i, f in enumerate(features)]
    far = clustered.join(F.broadcast(centroids.select("cluster", "before", "after")), "cluster").select(
        "cluster", "label", "side", F.sqrt(sum([g * g for g in gaps], F.lit(0.0))).alias("_d")
    )
    old = F.col("side") == "before"
    both = far.groupBy("cluster").agg(
        F.max("label").alias("label"),
        F.avg(F.when(old, F.col("_d"))).alias("before"), F.avg(F.when(~old, F.col("_d"))).alias("after"),
    )
    shift = F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before"))
    return both.withColumn("shift", shift).withColumn("drift", F.coalesce(F.abs("shift") > thr, F.lit(True)))


def cluster_count_drift(clustered: DataFrame, thr: int = 1) -> DataFrame:
    """Ids per class and side (at most ``k_max`` each) and how many are on one side only."""
    old = F.col("side") == "before"
    sets = clustered.groupBy("label").agg(
        F.sort_array(F.collect_set(F.when(old, F.col("cluster")))).alias("before"),
        F.sort_array(F.collect_set(F.when(~old, F.col("cluster")))).alias("after"),
    )
    changed = F.size(F.array_except("before", "after")) + F.size(F.array_except("after", "before"))
    return sets.select("label", "before", "after", changed.alias("changed"), (changed >= thr).alias("drift"))


def cluster_flags(clustered: DataFrame, features: list[str]) -> DataFrame:
    """All criteria as one table ``(label, criterion, cluster, item, drift)``."""
    centroids = cluster_centroids(clustered, features)
    labels = centroids.select("cluster", "label")
    nothing = F.lit(None).cast("string")
    count = cluster_count_drift(clustered).select(
        "label", F.lit(CRITERIA[0]).alias("criterion"), F.lit(None).cast("int").alias("cluster"), nothing.alias("item"), "drift"
    )
    stats = cluster_stat_drift(cluster_stat_shift(cluster_stats(clustered, features))).join(F.broadcast(labels), "cluster")
    stats = stats.select("label", F.lit(CRITERIA[1]).alias("criterion"), "cluster",
                         F.concat_ws(" ", "feature", "stat").alias("item"), "drift")
    shift = centroid_shift(centroids, features).select(
        "label", F.lit(CRITERIA[2]).alias("criterion"), "cluster", nothing.alias("item"), "drift"
    )
    distance = avg_distance_shift(clustered, centroids, features).select(
        "label", F.lit(CRITERIA[3]).alias("criterion"), "cluster", nothing.alias("item"), "drift"
    )
    return count.unionByName(stats).unionByName(shift).unionByName(distance)


def _weight(weights: tuple) -> Column:
    total = sum(weights)
    out = F.when(F.col("criterion") == CRITERIA[0], weights[0] / total)
    for c, w in zip(CRITERIA[1:], weights[1:]):
        out = out.when(F.col("criterion") == c, w / total)
    return out


def cluster_drift_strength(flags: DataFrame, weights: tuple = WEIGHTS, thr: float = THR_DECISION) -> DataFrame:
    """C11: weighted share of true flags over the four criteria, and the decision."""
    if len(weights) != 4:
        raise ValueError("number of weights must be 4")
    shares = flags.groupBy("criterion").agg(
        (F.sum(F.col("drift").cast("int")) / (F.count(F.lit(1)) + F.lit(1e-10))).alias("share")
    )
    strength = F.sum(F.col("share") * _weight(weights))
    return shares.agg(strength.alias("strength"), (strength > thr).alias("drift"))


def class_contributions(flags: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """What each class adds to each criterion: its true flags over all flags, weighted."""
    totals = flags.groupBy("criterion").agg(F.count(F.lit(1)).alias("_n"))
    mine = flags.groupBy("criterion", "label").agg(F.sum(F.col("drift").cast("int")).alias("_t"))
    return mine.join(totals, "criterion").select(
        "label", "criterion", (F.col("_t") / F.col("_n") * _weight(weights)).alias("contribution")
    )


def cluster_report(clustered: DataFrame, features: list[str]) -> DataFrame:
    """One row per cluster: class, state, centroid on either side, centroid shift, change of mean distance."""
    centroids = cluster_centroids(clustered, features)
    moved = centroid_shift(centroids, features).select(
        "cluster", "label", "state", F.col("shift").alias("centroid_shift"), F.col("drift").alias("centroid_drifted")
    )
    far = avg_distance_shift(clustered, centroids, features).select(
        "cluster", F.col("shift").alias("distance_change"), F.col("drift").alias("distance_drifted")
    )
    sides = centroids.select(
        "cluster",
        *[F.col("before")[i].alias(f"before_{f}") for i, f in enumerate(features)],
        *[F.col("after")[i].alias(f"after_{f}") for i, f in enumerate(features)],
    )
    return moved.join(sides, "cluster").join(far, "cluster")


def cluster_assignment_report(clustered: DataFrame) -> DataFrame:
    """Cluster ids per class and side as text."""
    counted = cluster_count_drift(clustered)
    return counted.select(
        "label", F.array_join(F.transform("before", lambda x: x.cast("string")), ", ").alias("before"),
        F.array_join(F.transform("after", lambda x: x.cast("string")), ", ").alias("after"),
    )
