import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftwise.functions import numeric
from shiftwise.operators import recurrence as R
from shiftwise.operators import windows as W

PROTO = "window_id long, label string, proto_rank int, idx long, features array<double>"


@pytest.fixture()
def protos(table):
    return table(PROTO, [
        (0, "a", 0, 0, [0.0, 0.0]), (0, "a", 1, 1, [2.0, 0.0]), (0, "b", 0, 2, [5.0, 5.0]),
        (1, "a", 0, 10, [1.0, 1.0]), (1, "a", 1, 11, [1.0, 3.0]), (1, "a", 2, 12, [4.0, 2.0]),
    ])


@pytest.fixture()
def rows(table):
    return table("window_id long, idx long, label string, features array<double>", [
        (0, 0, "a", [0.0, 0.0]), (0, 1, "b", [5.0, 4.0]),
        (1, 10, "a", [0.0, 0.1]), (1, 11, "a", [2.0, 0.0]), (1, 12, "b", [5.0, 5.0]), (1, 13, "b", [4.0, 2.0]),
    ])


def test_pairs_cover_everything_once(spark):
    ids = spark.range(30).select(F.col("id").alias("window_id"))
    got = sorted((r.window_a, r.window_b) for r in W.window_pairs(ids, block=7).collect())
    assert got == [(a, b) for a in range(30) for b in range(a + 1, 30)]
    assert W.consecutive_pairs(ids).count() == 29


def test_displacement_and_penalties(spark, protos, rows):
    pairs = W.window_pairs(rows)
    d = np.hypot(1.0 - 2.0, 0.0 - 2.0)
    assert W.centroid_displacement(pairs, protos).first().score == pytest.approx((d + 2) / 2)
    assert W.centroid_displacement(pairs, protos, "class").first().score == pytest.approx((d + 10) / 2)


def test_minimal_distance_uses_the_larger_set(protos, rows):
    pairs = W.window_pairs(rows)
    a, b = np.array([[0, 0], [2, 0]]), np.array([[1, 1], [1, 3], [4, 2]])
    near = np.linalg.norm(a[:, None] - b[None], axis=2).min(axis=0)
    assert W.minimal_distance(pairs, protos).first().score == pytest.approx((near.sum() + 2.0) / 4)
    assert W.minimal_distance(pairs, protos, "class").first().score == pytest.approx((near.mean() + 2.0) / 2)


def test_reassignment_impact(protos, rows):
    """Accuracy with one foreign prototype added, done the long way."""
    sets = {}
    for r in protos.collect():
        sets.setdefault(r.window_id, []).append((r.label, r.proto_rank, np.array(r.features)))
    data = [(r.label, np.array(r.features)) for r in rows.where("window_id = 1").collect()]

    def accuracy(ps):
        ps = sorted(ps, key=lambda p: (p[0], p[1]))
        hits = [ps[int(np.argmin([np.linalg.norm(x - p[2]) for p in ps]))][0] == y for y, x in data]
        return np.mean(hits)

    def one_way(extra, base):
        return np.mean([abs(accuracy(base) - accuracy(base + [(p[0], 99, p[2])])) for p in extra])

    want = (one_way(sets[0], sets[1]) + one_way(sets[1], sets[0])) / 2
    assert W.reassignment_impact(W.window_pairs(rows), protos, rows).first().score == pytest.approx(want)


def cells_of(table, a, b):
    got = table("window_a long, window_b long, idx long, in_a string, in_b string",
                [(0, 1, i, str(x), str(y)) for i, (x, y) in enumerate(zip(a, b))])
    return W.contingency(got)


def test_agreement_scores(table):
    same = cells_of(table, [0, 0, 1, 1, 2, 2], [1, 1, 2, 2, 0, 0])
    for f in (W.adjusted_rand, W.adjusted_mutual_info, W.fowlkes_mallows, W.completeness):
        assert f(same).first().score == pytest.approx(1.0)
    # contingency 2 1 0 / 0 1 2, worked out by hand
    other = cells_of(table, [0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2])
    assert W.adjusted_rand(other).first().score == pytest.approx((2 - 6 * 3 / 15) / ((6 + 3) / 2 - 6 * 3 / 15))
    assert W.fowlkes_mallows(other).first().score == pytest.approx(2 / np.sqrt(18))
    hb = np.log(3)
    mi = 4 / 6 * np.log(2)  # I(a; b): only the middle group is undecided
    assert W.completeness(other).first().score == pytest.approx(mi / hb)
    # published example value for this pair of labelings
    assert W.adjusted_mutual_info(other).first().score == pytest.approx(0.2987924581, abs=1e-6)
    trivial = cells_of(table, [0, 0, 0], [4, 4, 4])
    assert W.adjusted_rand(trivial).first().score == 1.0 and W.adjusted_mutual_info(trivial).first().score == 1.0


def test_matrix_is_mirrored_with_zero_diagonal(protos, rows):
    m = {(r.window_a, r.window_b): r.score for r in W.window_distance_matrix(protos, rows).collect()}
    assert m[(0, 0)] == m[(1, 1)] == 0 and m[(0, 1)] == m[(1, 0)] > 0
    s = W.matrix_stats(W.window_distance_matrix(protos, rows)).first()
    assert s.mean == pytest.approx(m[(0, 1)] / 2) and s.std == pytest.approx(m[(0, 1)] / 2)
    for measure in W.MEASURES:
        assert W.compare(W.window_pairs(rows), protos, rows, measure=measure).count() == 1
    with pytest.raises(ValueError):
        W.compare(W.window_pairs(rows), protos, rows, measure="nothing")


def test_median_filters(table):
    v = [5.0, 1.0, 9.0, 2.0, 7.0, 7.0, 0.0]
    df = table("idx long, value double", list(enumerate(v)))
    got = [r.value for r in R.median_filter_1d(df, 5).orderBy("idx").collect()]
    pad = np.pad(v, 2, mode="edge")
    assert got == [float(np.median(pad[i : i + 5])) for i in range(7)]
    m = np.random.default_rng(0).random((5, 5))
    long = table("window_a long, window_b long, score double", [(i, j, float(m[i, j])) for i in range(5) for j in range(5)])
    out = {(r.window_a, r.window_b): r.score for r in R.median_filter_2d(long, 3, 5).collect()}
    p = np.pad(m, ((1, 1), (2, 2)), mode="edge")
    assert all(out[(i, j)] == pytest.approx(np.median(p[i : i + 3, j : j + 5])) for i in range(5) for j in range(5))
    with pytest.raises(ValueError):
        R.median_filter_1d(df, 4)


def blocks(table, concepts, near=0.1, far=5.0, seed=0):
    rng = np.random.default_rng(seed)
    n = len(concepts)
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            m[i, j] = m[j, i] = (near if concepts[i] == concepts[j] else far) * (1 + 0.2 * rng.random())
    return table("window_a long, window_b long, score double", [(i, j, float(m[i, j])) for i in range(n) for j in range(n)])


def test_recurring_concepts_are_found(table):
    # a core distance looks at three other windows, so a concept needs four
    truth = [0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0, 0]
    labels = R.cluster_windows(blocks(table, truth))
    got = [r.concept for r in labels.orderBy("window_id").collect()]
    assert got == truth
    assert [r.window_id for r in R.drift_from_labels(labels).orderBy("window_id").collect()] == [4, 8]
    known = table("window_id long, true_concept int", [(i, 1 - c) for i, c in enumerate(truth)])
    assert R.concept_label_accuracy(labels, known).first().accuracy == 1.0


def test_lonely_windows_are_outliers(table):
    got = R.cluster_windows(blocks(table, [0, 0, 0, 0, 7, 1, 1, 1, 1, 8]), fix_outliers=False)
    assert [r.concept for r in got.orderBy("window_id").collect()] == [0, 0, 0, 0, -1, 1, 1, 1, 1, -1]
    with_fix = R.cluster_windows(blocks(table, [0, 0, 0, 0, 7, 0, 0, 1, 1, 1, 1]))
    assert [r.concept for r in with_fix.orderBy("window_id").collect()][:7] == [0] * 7


def test_spanning_tree_equals_prim(table):
    rng = np.random.default_rng(3)
    n = 12
    w = rng.random((n, n))
    edges = table("window_a long, window_b long, score double", [(i, j, float(w[i, j])) for i in range(n) for j in range(i + 1, n)])
    tree = R.minimum_spanning_tree(edges, list(range(n)))
    inside, total = {0}, 0.0
    while len(inside) < n:
        d, j = min((w[min(a, b), max(a, b)], b) for a in inside for b in range(n) if b not in inside)
        inside.add(j)
        total += d
    assert len(tree) == n - 1 and sum(t[0] for t in tree) == pytest.approx(total)


@pytest.mark.parametrize("seq,want", [
    ([0, 1, 0, 1, 0], [0, 0, 0, 0, 0]),
    ([-1, 3, -1, 2, 2], [-1, 3, -1, 2, 2]),
    ([1, -1, 1, 2, 1], [1, 1, 1, 1, 1]),
    ([4], [4]),
])
def test_outlier_fix_runs_left_to_right(table, seq, want):
    df = table("window_id long, concept int", list(enumerate(seq))).repartition(3)
    assert [r.concept for r in R.fix_outlier_labels(df).orderBy("window_id").collect()] == want


def test_outlier_fix_equals_the_plain_pass(table):
    rng = np.random.default_rng(0)
    for _ in range(4):
        seq = [int(x) for x in rng.integers(-1, 2, 60)]
        want = list(seq)
        for i in range(1, len(want) - 1):
            if want[i - 1] == want[i + 1] != -1:
                want[i] = want[i - 1]
        df = table("window_id long, concept int", list(enumerate(seq)))
        assert [r.concept for r in R.fix_outlier_labels(df).orderBy("window_id").collect()] == want


def test_leading_outlier_makes_the_first_concept_a_drift(table):
    df = table("window_id long, concept int", list(enumerate([-1, 0, 0, 1, 1])))
    assert sorted(r.window_id for r in R.drift_from_labels(df).collect()) == [1, 3]
    seg = R.concept_segments(df).orderBy("segment").collect()
    assert [(r.concept, r.start, r.end, r.width) for r in seg] == [(-1, 0, 0, 1), (0, 1, 2, 2), (1, 3, 4, 2)]


def test_label_accuracy_with_outliers(table):
    labels = table("window_id long, concept int", list(enumerate([0, 0, 1, 1, -1, 2])))
    truth = table("window_id long, true_concept int", list(enumerate([5, 5, 6, 5, 5, 7])))
    assert R.concept_label_accuracy(labels, truth, False).first().accuracy == pytest.approx(4 / 5)
    assert R.concept_label_accuracy(labels, truth).first().accuracy == pytest.approx(4 / 5 * 5 / 6)


def test_threshold_sweep(table):
    concepts = [0, 0, 1, 1, 0, 1, 0]
    matrix = blocks(table, concepts, near=0.2, far=0.6)
    truth = table("window_id long, true_concept int", list(enumerate(concepts)))
    got = {round(r.threshold, 6): r for r in R.threshold_sweep(matrix, truth).collect()}
    m = {(r.window_a, r.window_b): r.score for r in matrix.collect()}
    for t in (0.0, 0.205, 0.22, 0.3, 0.7, 0.995):
        tp = fp = tn = fn = 0
        for i in range(7):
            for j in range(i - 1):
                if concepts[i] == concepts[j]:
                    tp, fn = tp + (m[i, j] < t), fn + (m[i, j] >= t)
                else:
                    tn, fp = tn + (m[i, j] > t), fp + (m[i, j] <= t)
        r = got[t]
        assert r.accuracy == pytest.approx((tp + tn) / 15)
        assert r.precision == pytest.approx(tp / (tp + fp) if tp + fp else 0) and r.recall == pytest.approx(tp / (tp + fn))
        assert r.fpr == pytest.approx(fp / (fp + tn)) and r.fnr == pytest.approx(fn / (fn + tp))
    best = R.best_threshold(R.threshold_sweep(matrix, truth)).first()
    assert best.f1 == 1.0 and best.threshold == pytest.approx(min(t for t, r in got.items() if r.f1 == 1.0))


def test_race_p(table):
    scores = [1.0, 1.2, 0.8, 1.0, 1.1, 0.9, 1.0, 5.0, 1.0]
    df = table("window_a long, window_b long, score double", [(i, i + 1, s) for i, s in enumerate(scores)])
    got = {r.window_id: r.drift for r in R.race_p(df, grace=6).collect()}
    assert [w for w, d in got.items() if d] == [8]
    ref = R.race_reference(df, 6).first()
    assert ref.ref_mean == pytest.approx(np.mean(scores[2:5])) and ref.ref_std == pytest.approx(np.std(scores[2:5]))
    down = {r.window_id: r.drift for r in R.race_p(df.withColumn("score", -F.col("score")), grace=6, direction="decrease").collect()}
    assert down == got
    by_class = df.withColumn("label", F.lit("a")).unionByName(df.withColumn("label", F.lit("b")).withColumn("score", F.lit(1.0)))
    assert {r.window_id: r.drift for r in R.race_p(by_class, grace=6).collect()} == got


def odd_windows(table, kind, windows=9, seed=4):
    """Windows of uneven size; on the grid many distances tie, far from 0 single precision can't tell them."""
    rng = np.random.default_rng(seed)
    out = []
    for w in range(windows):
        for _ in range(int(rng.integers(3, 30))):
            v = rng.normal(size=3) if kind == "real" else rng.integers(0, 3, 3) + (1e6 if kind == "far" else 0.0)
            out.append((w, len(out), "abc"[int(rng.integers(0, 3))], [float(z) for z in v]))
    rows = table("window_id long, idx long, label string, features array<double>", out)
    place = {}
    ranked = [(w, lab, place.setdefault((w, lab), []).append(1) or len(place[w, lab]) - 1, i, v) for w, i, lab, v in out]
    return rows, table(PROTO, [r for r in ranked if r[2] < 3])


@pytest.mark.parametrize("kind", ["real", "grid", "far"])
def test_scores_made_in_the_task_are_those_of_the_cells(table, kind):
    """Every assignment was shuffled for ``adjusted_rand``: 1.9 billion rows on 615,384 vectors."""
    rows, protos = odd_windows(table, kind)
    pairs = W.window_pairs(rows)
    assigned = W.assignment_pairs(pairs, protos, rows)
    key = lambda df: {(r.window_a, r.window_b): r.score for r in df.collect()}
    made = W.adjusted_rand(W.contingency(assigned))
    assert "in_a" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = key(W.adjusted_rand(W.contingency(assigned.select("*"))))
    assert len(want) == 36 and key(made) == want
    # an assignment that was changed on the way is counted as it is
    some = assigned.where("idx % 2 = 0")
    assert key(W.adjusted_rand(W.contingency(some))) != want


@pytest.mark.parametrize("kind", ["real", "grid", "far"])
def test_nearest_of_many_sets_is_that_of_the_distances(kind):
    rng = np.random.default_rng(1)
    draw = lambda n: rng.normal(size=(n, 5)) if kind == "real" else rng.integers(0, 3, (n, 5)) + (1e6 if kind == "far" else 0.0)
    points = [draw(n) for n in (4, 1, 9, 9, 200)]
    frames = [pd.DataFrame({"v": list(p), "label": ["a"] * len(p)}) for p in points]
    x = draw(3000)
    at, some = W._Sets(frames, "l2").nearest(x)
    assert some.all() and at.shape == (5, 3000)
    for found, p in zip(at, points):
        assert (found == W._far(x, p, "l2").argmin(axis=1)).all()
    x[7, 1], x[8, 2] = np.nan, 1e200  # products can't be used
    at, _ = W._Sets(frames, "l2").nearest(x)
    assert all((found == W._far(x, p, "l2").argmin(axis=1)).all() for found, p in zip(at, points))


def test_mutual_information_is_made_in_the_task(table):
    """A pair cost milliseconds of Python: tables of cells, and the expected value overlap by overlap."""
    rows, protos = odd_windows(table, "grid")
    assigned = W.assignment_pairs(W.window_pairs(rows), protos, rows)
    key = lambda df: {(r.window_a, r.window_b): r.score for r in df.collect()}
    made = W.adjusted_mutual_info(W.contingency(assigned))
    assert "in_a" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = key(W.adjusted_mutual_info(W.contingency(assigned.select("*"))))
    assert len(want) == 36 and key(made) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("a,b", [([2, 3, 5], [1, 9]), ([1] * 40, [20, 20]), ([7, 7, 286], [100, 100, 100]), ([300], [1] * 300)])
def test_expected_information_by_sizes(a, b):
    """The sum over all overlaps, each with its hypergeometric chance in whole numbers; tables of over 256 rows aren't kept."""
    n = sum(a)
    want = [sum(k / n * math.log(n * k / (x * y)) * (math.comb(y, k) * math.comb(n - y, x - k) / math.comb(n, x))
                for y in b for k in range(max(1, x + y - n), min(x, y) + 1)) for x in a]
    assert numeric.expected_by_sizes(np.array(a), np.array(b)) == pytest.approx(want, abs=1e-12)
    small = numeric._expected_terms(np.array(a), np.array(b), n, most=5)  # a few overlaps at once
    assert small == pytest.approx(numeric._expected_terms(np.array(a), np.array(b), n))


@pytest.mark.parametrize("kind", ["real", "grid", "far"])
def test_impact_of_all_sets_of_a_block(table, kind, monkeypatch):
    """Distances were computed pair by pair; now once a window, and products with all sets of the block."""
    rows, protos = odd_windows(table, kind)
    x = rows.where("window_id = 8").toPandas().sort_values("idx")
    of = {w: g.rename(columns={"features": "v"}).sort_values(["label", "proto_rank"]) for w, g in protos.toPandas().groupby("window_id")}
    v, y, own = np.stack(x["features"].to_numpy()), x["label"].to_numpy().astype(str), of[8]
    mine, label = np.stack(own["v"].to_numpy()), own["label"].to_numpy().astype(str)

    def one_way(p, names, q, others):
        """Accuracy with each of ``q`` beside all ``p``, row by row."""
        gaps = []
        for z, other in zip(q, others):
            change = 0
            for row, true in zip(v, y):
                d = [np.sqrt(((row - c) ** 2).sum()) for c in p]
                was, far = names[int(np.argmin(d))], np.sqrt(((row - z) ** 2).sum())
                now = other if far < min(d) or (far == min(d) and other < was) else was
                change += int(now == true) - int(was == true)
            gaps.append(abs(change) / len(v))
        return np.mean(gaps)

    want = []
    for w in range(8):
        p, names = np.stack(of[w]["v"].to_numpy()), of[w]["label"].to_numpy().astype(str)
        want.append((one_way(mine, label, p, names) + one_way(p, names, mine, label)) / 2)
    calls, far = [], W._far
    monkeypatch.setattr(W, "_far", lambda *a: calls.append(1) or far(*a))
    got = W._impacts(v, y, mine, label, W._Sets([of[w] for w in range(8)], "l2"))
    assert got == pytest.approx(want, abs=1e-12) and len(calls) == 1
    pairs = table("window_a long, window_b long", [(w, 8) for w in range(8)])
    score = {r.window_a: r.score for r in W.reassignment_impact(pairs, protos, rows).collect()}
    assert [score[w] for w in range(8)] == pytest.approx(want, abs=1e-12)
