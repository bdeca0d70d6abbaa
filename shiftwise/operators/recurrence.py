"""Grouping windows into recurring concepts and summarising the stream.

Matrices are long tables ``(window_a, window_b, score)``, label sequences ``(window_id, concept)`` with -1 for
outliers. Window ids are dense from 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.functions.columns import l2
from shiftwise.functions.numeric import assign_min_cost
from shiftwise.operators.frames import moving
from shiftwise.operators.ordered import index_rows, prefix_sums
from shiftwise.operators.prototypes import proto_lists
from shiftwise.session import cut_lineage

PAIR = ["window_a", "window_b"]


def _check_odd(*widths: int) -> None:
    if any(w < 1 or w % 2 == 0 for w in widths):
        raise ValueError("filter widths must be odd")


def median_filter_1d(
    series: DataFrame, width: int = 3, keys: list[str] | None = None, idx: str = "idx", value: str = "value"
) -> DataFrame:
    """Running median; beyond the ends the first and last value repeat."""
    _check_odd(width)
    keys, reach = keys or [], width // 2
    seen = moving(series, keys, reach, reach, {"_v": F.collect_list(value)}, idx=idx)
    missing_left = F.greatest(F.lit(reach) - F.col(idx), F.lit(0)).cast("int")
    missing_right = (F.lit(width) - F.size("_v") - missing_left).cast("int")
    full = F.concat(
        F.array_repeat(F.get("_v", F.lit(0)), missing_left),
        F.col("_v"),
        F.array_repeat(F.element_at("_v", -1), missing_right),
    )
    middle = F.get(F.sort_array(full), F.lit(reach)).cast("double")
    return seen.withColumn(value, middle).drop("_v")


TILE = 256  # cells a side of a tile of a matrix


def median_filter_2d(matrix: DataFrame, ky: int = 3, kx: int = 3) -> DataFrame:
    """R2: median over ky x kx cells with clamped borders.

    The matrix is cut into tiles that share their border cells, so a cell travels about once and not once per neighbour.
    """
    _check_odd(ky, kx)
    ry, rx = ky // 2, kx // 2
    last = matrix.agg(F.max("window_a").alias("_na"), F.max("window_b").alias("_nb"))  # one row

    def tiles(c: str, reach: int, limit: str) -> Column:
        low, high = F.greatest(F.lit(0), F.col(c) - reach), F.least(F.col(limit), F.col(c) + reach)
        return F.sequence(F.floor(low / TILE), F.floor(high / TILE))

    placed = matrix.where("window_a is not null and window_b is not null").select(*PAIR, F.col("score").cast("double").alias("score"))
    spread = placed.join(F.broadcast(last), F.lit(True)).withColumn("_y", F.explode(tiles("window_a", ry, "_na")))
    spread = spread.withColumn("_x", F.explode(tiles("window_b", rx, "_nb")))

    def run(key, table):
        top, left = (k.as_py() * TILE for k in key)
        a, b = table["window_a"].to_numpy(), table["window_b"].to_numpy()
        score = table["score"].combine_chunks()
        valid, value = np.asarray(score.is_valid()), score.to_numpy(zero_copy_only=False)
        i0, j0 = top - ry, left - rx
        cells = np.full((TILE + 2 * ry, TILE + 2 * rx), np.nan)
        there = np.zeros(cells.shape, bool)
        cells[a[valid] - i0, b[valid] - j0], there[a[valid] - i0, b[valid] - j0] = value[valid], True
        own = np.flatnonzero((a >= top) & (a < top + TILE) & (b >= left) & (b < left + TILE))
        na, nb = table["_na"][0].as_py(), table["_nb"][0].as_py()
        out, null = np.zeros(len(own)), np.zeros(len(own), bool)
        step = max(1, 2_000_000 // (ky * kx))
        for k in range(0, len(own), step):
            at = own[k : k + step]
            i = np.clip(a[at, None] + np.repeat(np.arange(-ry, ry + 1), kx), 0, na) - i0
            j = np.clip(b[at, None] + np.tile(np.arange(-rx, rx + 1), ky), 0, nb) - j0
            # missing cells are last like NaN, and counted
            out[k : k + step] = np.sort(cells[i, j], axis=1)[:, ky * kx // 2]
            null[k : k + step] = there[i, j].sum(axis=1) <= ky * kx // 2
        return pa.table([pa.array(a[own]), pa.array(b[own]), pa.array(out, mask=null)], names=[*PAIR, "score"])

    return spread.groupBy("_y", "_x").applyInArrow(run, "window_a long, window_b long, score double")


def mutual_reachability(matrix: DataFrame, min_samples: int = 3) -> DataFrame:
    """``(window_a, window_b, score)`` for a < b: the largest of both core distances and the distance.

    The core distance of a window is its ``min_samples``-th smallest distance to another window. Core distances, one number per
    window, go to every task; the k^2 cells stay where they are.
    """
    others = matrix.where("window_a != window_b")
    place = F.row_number().over(Window.partitionBy("window_a").orderBy("score", "window_b"))
    near = others.withColumn("_r", place).where(F.col("_r") <= min_samples)
    cores = near.groupBy("window_a").agg(F.max("score").alias("core"))
    return (
        others.where("window_a < window_b")
        .join(F.broadcast(cores.withColumnRenamed("core", "_ca")), "window_a")
        .join(F.broadcast(cores.select(F.col("window_a").alias("window_b"), F.col("core").alias("_cb"))), "window_b")
        .select(*PAIR, F.greatest("score", "_ca", "_cb").alias("score"))
    )


def _find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


FOREST_EDGES = 200_000


def _smallest_forests(batches):
    """Of a task's edges those of its minimum spanning forest in the order of (score, window_a, window_b), null before, NaN behind
    all numbers; the others are in no spanning tree of the whole."""
    held: list[pa.RecordBatch] = []

    def forest() -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        score = table["score"].combine_chunks()
        a, b = table["window_a"].to_numpy(), table["window_b"].to_numpy()
        order = np.lexsort((b, a, np.nan_to_num(score.to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf, neginf=-np.inf),
                            np.asarray(score.fill_null(0.0).is_nan()), np.asarray(score.is_valid())))
        ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = ends[: len(a)].tolist(), ends[len(a) :].tolist()
        parent, kept = list(range(len(ids))), []
        for k in order.tolist():
            i, j = _find(parent, x[k]), _find(parent, y[k])
            if i != j:
                parent[i] = j
                kept.append(k)
                if len(kept) == len(ids) - 1:
                    break
        return table.take(pa.array(kept, pa.int64())).combine_chunks().to_batches()

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held[1:]) >= FOREST_EDGES:
            held = forest()
    if held:
        yield from forest()


def minimum_spanning_tree(edges: DataFrame, ids: list[int]) -> list[tuple[float, int, int]]:
    """Boruvka rounds: Spark finds the cheapest edge out of every component, the components are joined here.

    First every task leaves only the spanning forest of its own edges, which holds all that the whole tree takes from them. Of what is
    left one edge per component (at most k) reaches the driver in a round.
    """
    spark = edges.sparkSession
    parent = {i: i for i in ids}
    tree: set[tuple[float, int, int]] = set()
    kept = edges.select(*PAIR, F.col("score").cast("double").alias("score")).where("window_a is not null and window_b is not null")
    work = cut_lineage(kept.mapInArrow(_smallest_forests, "window_a long, window_b long, score double"))
    while len(tree) < len(ids) - 1:
        member = spark.createDataFrame([(i, _find(parent, i)) for i in ids], "w long, c long")
        ends = work.join(F.broadcast(member.toDF("window_a", "_x")), "window_a").join(
            F.broadcast(member.toDF("window_b", "_y")), "window_b"
        ).where("_x != _y")
        best = ends.select(
            F.explode(F.array("_x", "_y")).alias("c"), F.struct("score", "window_a", "window_b").alias("e")
        ).groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct().collect()
        if not best:
            break
        for e in sorted(best):
            a, b = _find(parent, e.window_a), _find(parent, e.window_b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                tree.add((e.score, e.window_a, e.window_b))
    return sorted(tree)


def condensed_labels(tree: list[tuple[float, int, int]], ids: list[int], min_size: int) -> dict[int, int]:
    """Clusters of the single-linkage hierarchy by excess of mass; -1 for windows in none; the root never counts."""
    n = len(ids)
    place = {w: i for i, w in enumerate(ids)}
    top = {i: i for i in range(n)}
    parent = {i: i for i in range(n)}
    left_right: dict[int, tuple[int, int, float]] = {}
    size = {i: 1 for i in range(n)}
    for d, a, b in tree:
        ra, rb = _find(parent, place[a]), _find(parent, place[b])
        node = n + len(left_right)
        left_right[node] = (top[ra], top[rb], d)
        size[node] = size[top[ra]] + size[top[rb]]
        parent[rb] = ra
        top[ra] = node
    root = n + len(left_right) - 1

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += left_right[x][:2]
        return out

    def density(d: float) -> float:
        return 1.0 / d if d > 0 else np.inf

    # condensed tree: a split counts only when both parts hold min_size windows
    clusters = [{"birth": 0.0, "parent": -1, "fell": [], "children": []}]
    todo = [(root, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            continue
        x, y, d = left_right[node]
        level = density(d)
        large = [s for s in (x, y) if size[s] >= min_size]
        for s in (x, y):
            if size[s] < min_size:
                clusters[c]["fell"] += [(w, level) for w in leaves(s)]
        if len(large) == 2:
            for s in large:
                clusters.append({"birth": level, "parent": c, "fell": [], "children": [], "size": size[s]})
                clusters[c]["children"].append(len(clusters) - 1)
                todo.append((s, len(clusters) - 1))
        elif large:
            todo.append((large[0], c))

    def gained(c: dict) -> float:
        total = sum(min(lv, 1e300) - c["birth"] for _, lv in c["fell"])
        return total + sum(clusters[k]["size"] * (min(clusters[k]["birth"], 1e300) - c["birth"]) for k in c["children"])

    value = [gained(c) for c in clusters]
    chosen = [False] * len(clusters)
    for i in range(len(clusters) - 1, 0, -1):
        below = sum(value[k] for k in clusters[i]["children"])
        if clusters[i]["children"] and below > value[i]:
            value[i] = below
        else:
            chosen[i] = True
            drop = list(clusters[i]["children"])
            while drop:
                k = drop.pop()
                chosen[k] = False
                drop += clusters[k]["children"]
    numbers: dict[int, int] = {}
    labels = {w: -1 for w in ids}
    for i, c in enumerate(clusters):
        at = i
        while at >= 0 and not chosen[at]:
            at = clusters[at]["parent"]
        if at < 0:
            continue
        for w, _ in c["fell"]:
            labels[ids[w]] = numbers.setdefault(at, len(numbers))
    # number the concepts by their first window
    order: dict[int, int] = {}
    return {w: (-1 if labels[w] < 0 else order.setdefault(labels[w], len(order))) for w in ids}


def cluster_windows(
    matrix: DataFrame, min_cluster_size: int = 3, fix_outliers: bool = True, median_width: int = 1
) -> DataFrame:
    """HDBSCAN on the distance matrix: ``(window_id, concept)``.

    Core distances, mutual reachability and the spanning tree are Spark jobs over the k^2 cells; the hierarchy
    is built from the k - 1 tree edges.
    """
    spark = matrix.sparkSession
    if median_width != 1:
        matrix = median_filter_2d(matrix, median_width, median_width)
    matrix = cut_lineage(matrix)
    ids = [r.window_a for r in matrix.select("window_a").distinct().orderBy("window_a").collect()]
    if len(ids) < 2:
        labels = {i: -1 for i in ids}
    else:
        tree = minimum_spanning_tree(mutual_reachability(matrix, min(min_cluster_size, len(ids) - 1)), ids)
        labels = condensed_labels(tree, ids, min_cluster_size)
    out = spark.createDataFrame([(i, labels[i]) for i in ids], "window_id long, concept int")
    return fix_outlier_labels(out) if fix_outliers else out


def fix_outlier_labels(labels: DataFrame) -> DataFrame:
    """A window between two equal concepts takes theirs, left to right, seeing earlier changes.

    A changed window takes the concept of its right neighbour, so that neighbour can not change any more: in a run
    of windows that all sit between equal concepts, every other one changes, starting with the first. That makes
    the left-to-right pass a frame of three rows and a running count.
    """
    frame = moving(
        labels.select("window_id", "concept"), [], 1, 1,
        {"_n": F.count("concept"), "_l": F.first("concept"), "_r": F.last("concept")}, idx="window_id",
    )
    flagged = frame.withColumn(
        "_odd",
        ((F.col("_n") == 3) & (F.col("_l") == F.col("_r")) & (F.col("_l") != -1) & (F.col("concept") != F.col("_l")))
        .cast("long"),
    )
    counted = prefix_sums(flagged, [], ["window_id"], {"_c": F.col("_odd")})
    # windows of a run share (window id - running count); the run starts at its smallest running count
    run = counted.withColumn("_run", F.col("window_id") - F.col("_c_upto"))
    starts = run.where("_odd = 1").groupBy("_run").agg(F.min("_c_upto").alias("_first"))
    turns = (F.col("_odd") == 1) & ((F.col("_c_upto") - F.col("_first")) % 2 == 0)
    return run.join(starts, "_run", "left").select(
        "window_id", F.when(turns, F.col("_l")).otherwise(F.col("concept")).cast("int").alias("concept")
    )


def drift_from_labels(labels: DataFrame) -> DataFrame:
    """Windows whose concept differs from the last known one; a leading outlier makes the first concept a drift."""
    known = index_rows(labels.where("concept != -1"), ["window_id"], name="_i")
    seen = moving(known, [], 1, 0, {"_last": F.first("concept")}, idx="_i")
    changed = (F.col("_last") != F.col("concept")) | ((F.col("_i") == 0) & (F.col("window_id") > 0))
    return seen.where(changed).select("window_id", "concept")


def concept_label_accuracy(labels: DataFrame, truth: DataFrame, outliers_included: bool = True) -> DataFrame:
    """Accuracy under the best one-to-one mapping of found to true concepts; one row.

    The confusion table has one row per (found, true) pair of concepts.
    """
    joined = labels.join(truth.select("window_id", "true_concept"), "window_id")
    confusion = joined.groupBy("concept", "true_concept").agg(F.count(F.lit(1)).alias("n"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = pdf[pdf["concept"] != -1]
        total, inside = int(pdf["n"].sum()), int(kept["n"].sum())
        if not inside:
            return pd.DataFrame({"windows": [total], "outliers": [total], "accuracy": [0.0]})
        table = kept.pivot_table(index="concept", columns="true_concept", values="n", fill_value=0).to_numpy(dtype=float)
        right = sum(table[r, c] for r, c in assign_min_cost(table.max() - table))
        accuracy = right / inside * ((inside / total) if outliers_included else 1.0)
        return pd.DataFrame({"windows": [total], "outliers": [total - inside], "accuracy": [accuracy]})

    one = confusion.withColumn("_all", F.lit(0)).groupBy("_all")
    return one.applyInPandas(score, "windows long, outliers long, accuracy double")


def threshold_sweep(
    matrix: DataFrame, truth: DataFrame, count: int = 200, step: float = 0.005, median: tuple[int, int] = (1, 1)
) -> DataFrame:
    """How well "distance below t" tells equal from different concepts, for ``count`` thresholds.

    Pairs leave out neighbouring windows; a pair without a distance decides nothing and is left out, too. Each pair counts into the first threshold that decides it, and running
    sums over the thresholds give all rates, so pairs are not multiplied by thresholds. The concepts, one number per window, go to
    every task; the pairs stay where they are.
    """
    if median != (1, 1):
        matrix = median_filter_2d(matrix, *median)
    t = truth.select("window_id", "true_concept")
    pairs = (
        matrix.where((F.col("window_b") < F.col("window_a") - 1) & F.col("score").isNotNull())
        .join(F.broadcast(t.withColumnRenamed("window_id", "window_a").withColumnRenamed("true_concept", "_ta")), "window_a")
        .join(F.broadcast(t.withColumnRenamed("window_id", "window_b").withColumnRenamed("true_concept", "_tb")), "window_b")
    )
    grid = F.array(*[F.lit(k * step) for k in range(count)])
    same = F.col("_ta") == F.col("_tb")
    up_to = F.size(F.filter(grid, lambda x: x <= F.col("score")))  # first threshold above the distance
    below = F.size(F.filter(grid, lambda x: x < F.col("score")))  # first threshold not below the distance
    counted = pairs.select(same.alias("same"), F.when(same, up_to).otherwise(below).alias("k")).groupBy("k").agg(
        F.sum(F.col("same").cast("long")).alias("s"), F.sum((~F.col("same")).cast("long")).alias("d")
    )
    ks = matrix.sparkSession.range(count + 1).select(F.col("id").cast("int").alias("k"))
    everything = Window.partitionBy()  # count + 1 rows
    so_far = everything.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s, d = F.coalesce("s", F.lit(0)), F.coalesce("d", F.lit(0))
    sums = ks.join(counted, "k", "left").select(
        "k",
        F.sum(s).over(so_far).alias("tp"),
        (F.sum(s).over(everything) - F.sum(s).over(so_far)).alias("fn"),
        (F.sum(d).over(everything) - F.sum(d).over(so_far)).alias("tn"),
        F.sum(d).over(so_far).alias("fp"),
    ).where(F.col("k") < count)

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    rates = sums.select(
        (F.col("k") * F.lit(step)).alias("threshold"),
        F.when(total > 0, (tp + tn) / total).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", ratio(2 * p * r, p + r))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest f1, the smallest threshold on a tie."""
    cols = [c for c in sweep.columns]
    top = sweep.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("_m"), F.struct(*cols).alias("row"))).alias("t"))
    return top.select("t.row.*")


def concept_segments(labels: DataFrame) -> DataFrame:
    """Runs of equal concepts with start, end and width."""
    seen = moving(labels, [], 1, 0, {"_last": F.first("concept"), "_seen": F.count("concept")}, idx="window_id")
    flagged = seen.withColumn("_new", ((F.col("_seen") == 1) | (F.col("_last") != F.col("concept"))).cast("int"))
    runs = prefix_sums(flagged, [], ["window_id"], {"_run": F.col("_new")})
    return runs.groupBy(F.col("_run_upto").alias("segment")).agg(
        F.max("concept").alias("concept"), F.min("window_id").alias("start"), F.max("window_id").alias("end"),
        F.count(F.lit(1)).alias("width"),
    )


def window_summary(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """Per window its size, prototypes, compression, class entropy (bits) and max/min class imbalance."""
    classes = rows.groupBy("window_id", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = classes.groupBy("window_id").agg(F.sum("n").alias("samples"))
    share = F.col("n") / F.col("samples")
    per_window = classes.join(sizes, "window_id").groupBy("window_id").agg(
        F.max("samples").alias("samples"), F.count(F.lit(1)).alias("classes"),
        F.sum(-share * F.log2(share)).alias("class_entropy"),
        F.when(F.count(F.lit(1)) > 1, F.max("n") / F.min("n")).alias("imbalance"),
    )
    counts = protos.groupBy("window_id").agg(F.count(F.lit(1)).alias("prototypes"))
    kept = F.coalesce("prototypes", F.lit(0))
    return per_window.join(counts, "window_id", "left").select(
        "window_id", "samples", kept.alias("prototypes"), "classes", (kept / F.col("samples") * 100).alias("compression_pct"),
        "class_entropy", "imbalance",
    )


def class_grid(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """R12 (and the per-class part of R10): rows, share and prototypes of every class in every window, zeros kept."""
    n = rows.groupBy("window_id", "label").agg(F.count(F.lit(1)).alias("n"))
    p = protos.groupBy("window_id", "label").agg(F.count(F.lit(1)).alias("prototypes"))
    labels = n.agg(F.sort_array(F.collect_set("label")).alias("_all"))  # one row: the class names
    sizes = n.groupBy("window_id").agg(F.sum("n").alias("_t"))
    grid = sizes.join(F.broadcast(labels), F.lit(True)).select("window_id", "_t", F.explode("_all").alias("label"))
    return grid.join(n, ["window_id", "label"], "left").join(p, ["window_id", "label"], "left").select(
        "window_id", "label", F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / F.col("_t") * 100).alias("share_pct"),
        F.coalesce("prototypes", F.lit(0)).alias("prototypes"),
    )


def stream_summary(rows: DataFrame, protos: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for the whole stream."""
    sizes = rows.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))
    counts = protos.groupBy("window_id").agg(F.count(F.lit(1)).alias("p"))
    per_window = sizes.join(counts, "window_id", "left").select("n", F.coalesce("p", F.lit(0)).alias("p"))
    stream = per_window.agg(
        F.count(F.lit(1)).alias("windows"), F.sum("n").alias("samples"), F.sum("p").alias("prototypes"),
        F.avg("p").alias("avg_prototypes"), F.min("p").alias("min_prototypes"), F.max("p").alias("max_prototypes"),
        F.stddev_pop("p").alias("std_prototypes"), (F.sum("p") / F.sum("n") * 100).alias("compression_pct"),
    )
    concepts = labels.agg(
        F.countDistinct(F.when(F.col("concept") != -1, F.col("concept"))).alias("concepts"),
        F.sum((F.col("concept") == -1).cast("long")).alias("outliers"),
    )
    drifts = drift_from_labels(labels).agg(F.count(F.lit(1)).alias("drifts"))
    classes = rows.agg(F.countDistinct("label").alias("classes"))
    out = stream
    for one in (concepts, drifts, classes):  # single-row tables
        out = out.join(F.broadcast(one), F.lit(True))
    return out


def closest_sample_breakdown(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """Rows nearest to each class, and there to each of its prototypes, by true class.

    Prototypes of a class at the same distance all count the row.
    """
    joined = rows.join(proto_lists(protos), "window_id")
    measured = F.transform(
        "protos", lambda p: F.struct(l2(F.col("features"), p["v"]).alias("d"), p["id"].alias("id"),
                                     p["label"].alias("label"), p["rank"].alias("rank"))
    )
    nearest = F.array_min("_m")
    hits = joined.withColumn("_m", measured).withColumn("_b", nearest).select(
        "window_id", F.col("label").alias("true_label"),
        F.explode(
            F.filter("_m", lambda m: (m["label"] == F.col("_b")["label"]) & (m["d"] == F.col("_b")["d"]))
        ).alias("_h"),
    )
    return hits.groupBy(
        "window_id", F.col("_h.label").alias("label"), F.col("_h.rank").alias("proto_rank"), "true_label"
    ).agg(F.count(F.lit(1)).alias("n"))


def prototype_feature_stats(protos: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, minimum and maximum per window, class and feature (``x1``.. without names)."""
    rows = protos.select("window_id", "label", F.posexplode("features").alias("_i", "_v"))
    name = F.concat(F.lit("x"), (F.col("_i") + 1).cast("string"))
    if names:
        name = F.get(F.array(*[F.lit(n) for n in names]), F.col("_i"))
    return rows.groupBy("window_id", "label", name.alias("feature")).agg(
        F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )


def prototype_value_range(protos: DataFrame, windows: list[int] | None = None, first: int | None = None) -> DataFrame:
    """Smallest and largest prototype value of the chosen windows, widened by 5 % of the span."""
    chosen = protos if windows is None else protos.where(F.col("window_id").isin(windows))
    chosen = chosen if first is None else chosen.where(F.col("proto_rank") < first)
    lo, hi = F.min(F.array_min("features")), F.max(F.array_max("features"))
    margin = F.lit(0.05) * (hi - lo)
    return chosen.agg((lo - margin).alias("low"), (hi + margin).alias("high"))


DIRECTION = {
    "mutual_information": "decrease", "rand_index": "decrease", "completeness": "decrease",
    "fowlkes_mallows": "decrease", "prototype_reassignment_impact": "increase", "minimal_distance": "increase",
    "centroid_displacement": "increase",
}


def race_reference(scores: DataFrame, grace: int = 20) -> DataFrame:
    """Mean and population deviation of the scores of iterations [grace // 2, grace), per class if there is one."""
    keys = ["label"] if "label" in scores.columns else []
    calm = scores.where((F.col("window_b") >= max(1, grace // 2)) & (F.col("window_b") < grace))
    return calm.groupBy(*keys).agg(F.avg("score").alias("ref_mean"), F.stddev_pop("score").alias("ref_std"))


def race_p(scores: DataFrame, grace: int = 20, const: float = 3.0, direction: str = "increase") -> DataFrame:
    """Score of each window against the one before it, compared with the reference after the grace period.

    With a ``label`` column a window drifts when any class does. Nothing is reset after a drift.
    """
    keys = ["label"] if "label" in scores.columns else []
    ref = race_reference(scores, grace)
    joined = scores.join(F.broadcast(ref), keys if keys else F.lit(True), "left")
    limit = F.col("ref_mean") + (const if direction == "increase" else -const) * F.col("ref_std")
    over = F.col("score") > limit if direction == "increase" else F.col("score") < limit
    drift = F.coalesce((F.col("window_b") >= grace) & over, F.lit(False))
    out = joined.select(F.col("window_b").alias("window_id"), *keys, "score", limit.alias("limit"), drift.alias("drift"))
    if keys:
        return out.groupBy("window_id").agg(F.max("score").alias("score"), F.bool_or("drift").alias("drift"))
    return out
