import math

import numpy as np
import pytest

from shiftwise.operators import prototypes as P
from shiftwise.operators import quality as Q

ROWS = "window_id long, idx long, label string, features array<double>, leaves array<int>, model_label string"


@pytest.fixture()
def rows(table):
    """Two classes; in class a rows 0-3 share leaves, 4-5 share others; class b is one group."""
    data = [(0, i, "a", [float(i), 0.0], [1, 1, 1, 1], "a") for i in range(4)]
    data += [(0, 4, "a", [10.0, 0.0], [2, 2, 2, 2], "a"), (0, 5, "a", [11.0, 0.0], [2, 2, 2, 3], "b")]
    data += [(0, i, "b", [float(i), 50.0], [5, 5, 5, 5], "b") for i in range(6, 9)]
    return table(ROWS, data)


def picked(df):
    return sorted((r.label, r.proto_rank, r.idx) for r in df.collect())


def test_similarity_and_distance(rows):
    got = {r.idx: dict(zip(r.others, r.similarity)) for r in P.tree_similarity(rows).collect()}
    assert got[0] == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0} and got[4][5] == 0.75 and set(got[6]) == {6, 7, 8}
    far = {r.idx: dict(zip(r.others, r.distance)) for r in P.tree_distance(P.tree_similarity(rows)).collect()}
    assert far[5][4] == 0.25


def test_greedy_kmedoids(rows):
    assert picked(P.greedy_kmedoids(rows, 2)) == [("a", 0, 0), ("a", 1, 4), ("b", 0, 6), ("b", 1, 7)]


def test_greedy_global_takes_the_best_class_first(rows):
    # first gains: a covers 4 of 6 rows, b covers 3 of 3; then a's second group gains 1.75
    assert picked(P.greedy_global(rows, 1)) == [("a", 0, 0)]
    assert picked(P.greedy_global(rows, 3)) == [("a", 0, 0), ("a", 1, 4), ("b", 0, 6)]
    # by class size b gains 3/3 and comes first
    assert picked(P.greedy_weighted(rows, 1)) == [("b", 0, 6)]


def test_apete_stops_when_the_gain_settles(rows):
    # gains 4, 3, 1.75, 0.25, 0: nothing is within 5 % until the gain is 0
    assert len(picked(P.apete(rows, 0.05))) == 5
    # |0 - 4| / 4 = 1 <= 1: stops at once
    assert picked(P.apete(rows, 1.0)) == [("a", 0, 0)]
    got = picked(P.prototypes_per_window(rows, alpha=1.0))
    assert {r[0] for r in got} == {"a", "b"} and [r for r in got if r[0] == "b"][0] == ("b", 0, 6)


def test_supervised_selection_raises_accuracy(rows):
    assert picked(P.greedy_supervised(rows, 5))[:2] == [("a", 0, 0), ("a", 1, 4)]
    protos = P.greedy_supervised(rows, 5)
    assert len(protos.collect()) == 3  # nothing gained after every row is right
    assert P.prototype_score(P.assign_tree_prototype(rows, protos)).first().score == 1.0


def test_assignments(rows, table):
    protos = P.greedy_global(rows, 3)
    got = {r.idx: (r.predicted, r.proto_id) for r in P.assign_tree_prototype(rows, protos).collect()}
    assert got[2] == ("a", 0) and got[5] == ("a", 1) and got[8] == ("b", 2)
    stray = table(ROWS, [(0, 99, "a", [0.4, 0.0], [7, 7, 7, 7], "a")])
    r = P.assign_tree_prototype(stray, protos).first()
    assert (r.predicted, r.proto_id) == (None, -1)
    near = P.assign_l2_prototype(stray, protos).first()
    assert (near.predicted, near.proto_id) == ("a", 0) and near.distance == pytest.approx(0.4)


def test_first_prototype_wins_ties(table):
    protos = table("window_id long, label string, proto_rank int, idx long, features array<double>, leaves array<int>",
                   [(0, "b", 0, 1, [0.0], [1]), (0, "a", 1, 2, [2.0], [1]), (0, "a", 0, 3, [2.0], [1])])
    row = table(ROWS, [(0, 9, "a", [1.0], [1], "a")])
    assert P.assign_l2_prototype(row, protos).first().proto_id == 0
    assert P.assign_tree_prototype(row, protos).first().proto_id == 0


def test_kmeans_prototypes_are_real_rows(table):
    rng = np.random.default_rng(0)
    data = []
    for c, label in (((0, 0), "a"), ((20, 0), "a"), ((0, 20), "b"), ((20, 20), "b")):
        data += [(0, len(data) + i, label, [float(c[0] + rng.normal()), float(c[1] + rng.normal())]) for i in range(25)]
    rows = table("window_id long, idx long, label string, features array<double>", data)
    got = P.kmeans_prototypes(rows, 2, k=2).collect()
    spots = sorted((r.label, round(r.features[0] / 20), round(r.features[1] / 20)) for r in got)
    assert spots == [("a", 0, 0), ("a", 1, 0), ("b", 0, 1), ("b", 1, 1)]
    # more centres than distinct rows: no row twice
    few = P.nearest_to_centres(
        rows.where("idx < 2"),
        table("label string, centre_no int, centre array<double>", [("a", i, [0.0, 0.0]) for i in range(3)]), 3)
    assert sorted(r.idx for r in few.collect()) == [0, 1]


def test_forest_leaves(table):
    data = [(0, i, "a" if i % 2 else "b", [float(i % 2) * 4 + i * 1e-3, 1.0]) for i in range(60)]
    rows = table("window_id long, idx long, label string, features array<double>", data)
    got = P.forest_leaves(rows, trees=5, depth=3).collect()
    assert all(len(r.leaves) == 5 for r in got) and all(r.model_label == r.label for r in got)
    assert {tuple(r.leaves) for r in got if r.label == "a"} & {tuple(r.leaves) for r in got if r.label == "b"} == set()


def plain_predict(x, protos):
    best, label, who = 0, None, None
    for i, (c, leaves) in enumerate(protos):
        s = sum(a == b for a, b in zip(x, leaves))
        if s > best:
            best, label, who = s, c, i
    return label, who


def test_quality_measures(rows):
    protos = P.greedy_global(rows, 4)
    listed = sorted(protos.collect(), key=lambda r: (r.label, r.proto_rank))
    flat = [(r.label, r.leaves) for r in listed]
    data = rows.collect()
    n = len(data)
    full = np.mean([plain_predict(r.leaves, flat)[0] == r.model_label for r in data])
    assert Q.fidelity(rows, protos).first().fidelity == pytest.approx(full)
    contributions = {r.proto_id: r.contribution for r in Q.contribution(rows, protos).collect()}
    for i in range(len(flat)):
        rest = flat[:i] + flat[i + 1 :]
        without = np.mean([plain_predict(r.leaves, rest)[0] == r.model_label for r in data])
        assert contributions[i] == pytest.approx(full - without)
    assert Q.mean_contribution(Q.contribution(rows, protos)).first().contribution == pytest.approx(np.mean(list(contributions.values())))
    shares = {r.proto_id: r for r in Q.votes(rows, protos).collect()}
    for i, (c, leaves) in enumerate(flat):
        sims = [[sum(a == b for a, b in zip(r.leaves, p[1])) for p in flat] for r in data]
        mine = [r for r, s in zip(data, sims) if int(np.argmax(s)) == i]
        assert shares[i].voting_frequency == pytest.approx(len(mine) / n)
        right = np.mean([r.model_label == c for r in mine]) if mine else 0.0
        assert shares[i].consistent_votes == pytest.approx(right)
    near = {r.proto_id: r for r in Q.distribution_similarity(rows, protos).collect()}
    for i, (c, leaves) in enumerate(flat):
        sim = [(r.label, np.mean([a == b for a, b in zip(r.leaves, leaves)])) for r in data]
        assert near[i].in_distribution == pytest.approx(np.mean([s for l, s in sim if l == c]))
        assert near[i].out_distribution == pytest.approx(np.mean([s for l, s in sim if l != c]))
    hubs = {r.proto_id: r.hubness for r in Q.hubness(rows, protos).collect()}
    assert sum(v for i, v in hubs.items() if flat[i][0] == "a") == pytest.approx(1)
    ents = {r.label: r.entropy_hubness for r in Q.entropy_hubness(Q.hubness(rows, protos)).collect()}
    k = [v for i, v in hubs.items() if flat[i][0] == "a"]
    e = -sum(p * math.log2(p) for p in k if p > 0) / max(math.log2(len(k) + 1e-6), 1 + 1e-6)
    assert ents["a"] == pytest.approx(e)
