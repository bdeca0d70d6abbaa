import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftwise.operators import clusters as C
from shiftwise.operators.prep import standard_scale

SPOTS = {"low": (0.0, 0.0), "high": (10.0, 10.0), "side": (0.0, 12.0)}


def blob(rng, side, label, spot, n=80, move=(0.0, 0.0)):
    c = SPOTS[spot]
    return [(side, label, float(c[0] + move[0] + rng.normal() * 0.5), float(c[1] + move[1] + rng.normal() * 0.5)) for _ in range(n)]


@pytest.fixture()
def data(table):
    """Class a keeps two blobs, class b moves one and gains one."""
    rng = np.random.default_rng(0)
    rows = []
    for side in ("before", "after"):
        rows += blob(rng, side, "a", "low") + blob(rng, side, "a", "high")
        moved = (2.0, 0.0) if side == "after" else (0.0, 0.0)
        rows += blob(rng, side, "b", "low", move=moved) + blob(rng, side, "b", "high")
    rows += blob(rng, "after", "b", "side")
    return standard_scale(table("side string, label string, x double, y double", rows), ["x", "y"])


def vectors(df):
    return df.withColumn("features", F.array("x", "y"))


def test_xmeans_finds_the_blobs(data):
    got = {(r.side, r.label): len(r.centres) for r in C.xmeans_per_class(vectors(data), 2).collect()}
    assert got == {("before", "a"): 2, ("after", "a"): 2, ("before", "b"): 2, ("after", "b"): 3}


def test_xmeans_is_the_same_for_any_partitioning(data):
    def centres(df):
        rows = C.xmeans_per_class(vectors(df), 2).collect()
        return {(r.side, r.label): sorted(tuple(round(x, 6) for x in c.v) for c in r.centres) for r in rows}

    assert centres(data.repartition(1)) == centres(data.repartition(8))


def test_k_max_is_a_limit_and_constant_data_stays_whole(table, data):
    got = C.xmeans_per_class(vectors(data), 2, k_max=2).collect()
    assert all(len(r.centres) == 2 for r in got)
    flat = table("side string, label string, features array<double>", [("before", "a", [1.0, 1.0])] * 5)
    assert [len(r.centres) for r in C.xmeans_per_class(flat, 2).collect()] == [1]


def test_matching_and_global_ids(table):
    schema = "side string, label string, centres array<struct<id:int,v:array<double>>>"
    df = table(schema, [
        ("before", "a", [(0, [0.0, 0.0]), (1, [3.0, 3.0])]),
        ("after", "a", [(0, [3.1, 3.0]), (1, [0.0, 0.2]), (2, [-3.0, 0.0])]),
        ("before", "b", [(0, [1.0, 1.0])]),
        ("after", "b", [(0, [9.0, 9.0])]),
        ("before", "gone", [(0, [0.0, 0.0])]),
        ("after", "new", [(0, [0.0, 0.0])]),
    ])
    m = C.match_clusters(df, 2)
    got = sorted(((r.label, r.old_id, r.new_id) for r in m.collect()), key=str)
    assert got == sorted([("a", 0, 1), ("a", 1, 0), ("a", None, 2), ("b", 0, None), ("b", None, 0),
                          ("gone", 0, None), ("new", None, 0)], key=str)
    ids = {(r.side, r.label, r.local_id): r.cluster for r in C.global_cluster_ids(m).collect()}
    assert ids[("before", "a", 0)] == ids[("after", "a", 1)] == 0 and ids[("after", "a", 0)] == 1
    assert ids[("before", "b", 0)] == 2 and ids[("before", "gone", 0)] == 3
    assert ids[("after", "a", 2)] == 4 and ids[("after", "b", 0)] == 5 and ids[("after", "new", 0)] == 6


def test_moved_and_extra_blob(data):
    found = C.cluster_rows(data, ["x", "y"])
    centroids = C.cluster_centroids(found, ["x", "y"])
    shift = {r.cluster: r for r in C.centroid_shift(centroids, ["x", "y"]).collect()}
    states = sorted((r.label, r.state) for r in shift.values())
    assert states == [("a", "present"), ("a", "present"), ("b", "appeared"), ("b", "present"), ("b", "present")]
    assert [r.drift for r in shift.values() if r.label == "a"] == [False, False]
    assert sum(r.drift for r in shift.values() if r.label == "b" and r.state == "present") == 1
    count = {r.label: (r.changed, r.drift) for r in C.cluster_count_drift(found).collect()}
    assert count == {"a": (0, False), "b": (1, True)}
    flags = C.cluster_flags(found, ["x", "y"])
    strength = C.cluster_drift_strength(flags).first()
    shares = {r.criterion: r.s for r in flags.groupBy("criterion").agg(F.avg(F.col("drift").cast("int")).alias("s")).collect()}
    weights = dict(zip(C.CRITERIA, C.WEIGHTS))
    assert strength.strength == pytest.approx(sum(weights[c] * s for c, s in shares.items()))
    parts = C.class_contributions(flags).agg(F.sum("contribution")).first()[0]
    assert parts == pytest.approx(strength.strength)
    report = {r.cluster: r for r in C.cluster_report(found, ["x", "y"]).collect()}
    new = [r for r in report.values() if r.state == "appeared"][0]
    assert new.before_x is None and new.after_y is not None and new.distance_drifted
    text = {r.label: r.after for r in C.cluster_assignment_report(found).collect()}
    assert text["b"].count(",") == 2


def test_same_sides_do_not_drift(table):
    rng = np.random.default_rng(1)
    half = [(r[1:]) for r in blob(rng, "-", "a", "low") + blob(rng, "-", "a", "high")]
    df = standard_scale(table("side string, label string, x double, y double",
                              [("before", *r) for r in half] + [("after", *r) for r in half]), ["x", "y"])
    flags = C.cluster_flags(C.cluster_rows(df, ["x", "y"]), ["x", "y"])
    assert flags.where("drift").count() == 0 and not C.cluster_drift_strength(flags).first().drift
    codes = C.shift_heatmap_codes(C.cluster_stat_shift(C.cluster_stats(C.cluster_rows(df, ["x", "y"]), ["x", "y"])))
    assert codes.where("code != 0").count() == 0


def test_small_base_and_missing_side(table):
    rows = [("before", "a", 0, 0.0), ("before", "a", 0, 0.0), ("after", "a", 0, 0.5), ("after", "a", 0, 0.5), ("after", "a", 1, 3.0)]
    df = table("side string, label string, cluster int, x double", rows)
    shifts = {(r.cluster, r.stat): r for r in C.cluster_stat_drift(C.cluster_stat_shift(C.cluster_stats(df, ["x"]))).collect()}
    assert shifts[(0, "mean")].shift == 0.5 and shifts[(0, "std")].shift == 0.0 and not shifts[(0, "std")].drift
    assert shifts[(1, "mean")].shift is None and shifts[(1, "mean")].drift
    with pytest.raises(ValueError):
        C.cluster_drift_strength(C.cluster_flags(df, ["x"]), (1, 2, 3))


def test_matching_prefers_more_pairs_then_nearer_ones(spark):
    from itertools import combinations, permutations
    import random

    from shiftwise.operators.clusters import match_clusters

    rng, size, thr = random.Random(4), 2, 0.5
    limit = thr * size**0.5
    for _ in range(3):
        old = {i: [rng.random() * 2, rng.random()] for i in range(rng.randint(1, 4))}
        new = {i: [rng.random() * 2, rng.random()] for i in range(rng.randint(1, 4))}
        dist = {(a, b): ((old[a][0] - new[b][0]) ** 2 + (old[a][1] - new[b][1]) ** 2) ** 0.5 for a in old for b in new}
        best = (0, 0.0)
        for n in range(1, min(len(old), len(new)) + 1):
            for some in combinations(old, n):
                for other in permutations(new, n):
                    d = [dist[p] for p in zip(some, other)]
                    if max(d) <= limit:
                        best = min(best, (-n, sum(d)))
        rows = [("x", "before", [(i, v) for i, v in old.items()]), ("x", "after", [(i, v) for i, v in new.items()])]
        df = spark.createDataFrame(rows, "label string, side string, centres array<struct<id: int, v: array<double>>>")
        got = [(r.old_id, r.new_id) for r in match_clusters(df, size, thr).collect()]
        pairs = [p for p in got if None not in p]
        assert len(pairs) == -best[0] and abs(sum(dist[p] for p in pairs) - best[1]) < 1e-9
        assert sorted(p[0] for p in got if p[0] is not None) == sorted(old) and sorted(p[1] for p in got if p[1] is not None) == sorted(new)
