import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftwise.operators import boundary as B
from shiftwise.operators import importance as I
from shiftwise.operators import project as X

TREES = {"trees": 10, "depth": 4}


@pytest.fixture(scope="module")
def moved(spark):
    """Only x tells before from after; the label follows z."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        side = "before" if i < 200 else "after"
        z = float(rng.normal())
        rows.append((i, side, "p" if z > 0 else "n", float(rng.normal() + (3 if side == "after" else 0)), float(rng.normal()), z))
    return spark.createDataFrame(rows, "idx long, side string, label string, x double, y double, z double").cache()


@pytest.mark.parametrize("kind,params", [("mlp", {"max_iter": 60}), ("random_forest", TREES)])
def test_classifiers_fit(moved, kind, params):
    clf = I.fit_classifier(moved, ["x", "y", "z"], kind=kind, params=params)
    assert 0.9 < clf.score(moved) <= 1.0 and clf.classes == ["n", "p"]
    row = clf.predict(moved).first()
    assert sum(row.probability) == pytest.approx(1) and row.predicted == clf.classes[row.predicted_no]
    with pytest.raises(ValueError):
        I.fit_classifier(moved, ["x"], kind="nothing")
    with pytest.raises(ValueError):
        I.fit_classifier(moved, ["x"], kind="random_forest", params={"depth": 31})
    with pytest.raises(ValueError):
        I.fit_classifier(moved.where("label = 'p'"), ["x"])


@pytest.mark.parametrize("method,kw", [
    ("permutation", {"repeats": 4}), ("shap", {"background": 20, "sample": 30}), ("lime", {"sample": 20, "perturbations": 300}),
])
def test_the_driving_feature_leads(moved, method, kw):
    for include_target in (False, True):
        got = I.drift_importance(moved, ["x", "y", "z"], ["idx"], include_target, method, "random_forest", TREES, **kw)
        ranked = I.importance_ranking(got).collect()
        assert [r.feature for r in ranked][0] == "x" and len(ranked) == 3


def test_predictive_shift(moved):
    got = {r.feature: r for r in I.predictive_importance_shift(
        moved, ["x", "y", "z"], ["idx"], kind="random_forest", params=TREES, repeats=3).collect()}
    assert max(got, key=lambda f: got[f].mean_before) == max(got, key=lambda f: got[f].mean_after) == "z"


def test_shap_adds_up(moved):
    clf = I.fit_classifier(moved, ["x", "y", "z"], kind="random_forest", params=TREES)
    phi = I.kernel_shap(clf, moved, ["idx"], background=25, sample=12)
    total = {r.row: r.s for r in phi.groupBy("row").agg(F.sum("phi").alias("s")).collect()}
    scored = clf.predict(moved).select("idx", F.col("probability")[1].alias("p"))
    back = I._sample(moved, ["x", "y", "z"], ["idx"], 25, 43).select(F.col(I.ROW).cast("long").alias("idx"))
    base = scored.join(back, "idx").agg(F.avg("p")).first()[0]
    full = {str(r.idx): r.p for r in scored.collect()}
    assert len(total) == 12 and all(s == pytest.approx(full[i] - base) for i, s in total.items())


@pytest.mark.parametrize("budget", [64, 30])
def test_coalition_weights_are_exact_for_additive_games(budget):
    d, gains = 6, np.array([1.0, -2.0, 0.5, 3.0, 0.0, 4.0])
    z, combine = I.coalition_weights(d, budget)
    assert combine @ (5.0 + z @ gains) == pytest.approx(gains, abs=1e-8)


def test_box_of_disagreement(spark):
    """Two threshold models on x disagree exactly between the thresholds."""
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.random()), float(rng.random())) for i in range(2000)]
    df = spark.createDataFrame(rows, "idx long, x double, y double")
    given = df.withColumn("old_label", (F.col("x") > 0.3).cast("string")).withColumn(
        "new_label", (F.col("x") > 0.6).cast("string")
    ).withColumn("disagree", (F.col("old_label") != F.col("new_label")).cast("int"))
    rate = B.model_disagreement(given).first().drift_rate
    assert rate == pytest.approx(0.3, abs=0.04)
    tree = B.disagreement_tree(given, ["x", "y"])
    rules, share = B.drift_rules(tree, given, ["x", "y"])
    low, high = min(r.low["x"] for r in rules), max(r.high["x"] for r in rules)
    assert (low, high) == (pytest.approx(0.3, abs=0.03), pytest.approx(0.6, abs=0.03))
    assert all(0.5 < share[r.leaf] <= 1 for r in rules)
    cover = B.rule_coverage(rules, given, given.where("y < 0.5")).collect()
    assert sum(r.coverage for r in cover) == pytest.approx(rate, abs=0.06)
    assert sorted(r.place for r in cover) == list(range(1, len(rules) + 1))
    places = {r.leaf: r.place for r in cover}
    inside = B.drift_region_map(rules, places, given).where("region > 0")
    assert inside.count() == sum(r.samples for r in cover)
    # every row is in exactly the leaf the tree puts it in
    leaves = B.tree_leaves(tree, ["x", "y"])
    assert given.select(sum([l.condition().cast("int") for l in leaves], F.lit(0)).alias("n")).where("n != 1").count() == 0
    assert B.disagreement_tree(given.withColumn("disagree", F.lit(0)), ["x", "y"]) is None


def test_rule_text_and_units(table):
    rule = B.Rule(3, {"x": 0.25}, {"x": 0.5, "y": 0.1})
    text = B.rule_text(rule, {"x": (10.0, 100.0)}, {"y": (-1.0, 1.0)})
    assert text == "x ∈ [102.50, 105.00],  y ∈ [-1.00, 0.10]"
    raw = table("idx long, x double, k double", [(i, 3.0 * i + 7, 2.0) for i in range(10)])
    scaled = raw.withColumn("x", (F.col("x") - 7) / 27).withColumn("k", F.lit(0.0))
    got = {r.feature: (r.m, r.c) for r in B.unscale_bounds(scaled, raw, ["x", "k"]).collect()}
    assert got["x"] == (pytest.approx(27), pytest.approx(7)) and got["k"] == (0.0, 2.0)


def test_disagreement_of_models(moved):
    turned = moved.withColumn("label", F.when(F.col("side") == "after", F.when(F.col("z") > 1, "p").otherwise("n")).otherwise(F.col("label")))
    old = I.fit_classifier(turned.where("side = 'before'"), ["x", "y", "z"], kind="random_forest", params=TREES)
    new = I.fit_classifier(turned.where("side = 'after'"), ["x", "y", "z"], kind="random_forest", params=TREES)
    after = turned.where("side = 'after'")
    got = B.disagreement_table(old, new, after, ["x", "y", "z"]).collect()
    assert got and got[0].rule_label.startswith("Rule ") and "z ∈" in "".join(r.rule for r in got)
    assert B.disagreement_table(old, old, after, ["x", "y", "z"]).count() == 0
    plane = X.fit_pca(after, ["x", "y", "z"])
    points = B.projection_grid(after, plane, grid=12)
    assert points.count() == 144
    back = plane.transform(points.select("gx", "gy", "x", "y", "z", F.col("component_1").alias("c1")).drop("component_1"))
    assert back.agg(F.max(F.abs(F.col("component_1") - F.col("c1")))).first()[0] < 1e-9
    box = plane.transform(after).agg(F.min("component_1"), F.max("component_1")).first()
    span = points.agg(F.min("component_1"), F.max("component_1")).first()
    assert span[0] == pytest.approx(box[0] - 0.1 * (box[1] - box[0])) and span[1] == pytest.approx(box[1] + 0.1 * (box[1] - box[0]))
    assert B.grid_predictions(old, points).where("confidence between 0.5 and 1").count() == 144


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 2)) * [3, 1]
    x = base @ np.array([[1, 0.5, 0.2], [-0.3, 1, 0.7]]) + rng.normal(size=(500, 3)) * 0.1 + [5, -2, 1]
    df = spark.createDataFrame([(i, "ab"[int(v[0] > 5)], *map(float, v)) for i, v in enumerate(x)], "idx long, label string, x double, y double, z double")
    return df.cache(), x


def test_pca(cloud):
    df, x = cloud
    p = X.fit_pca(df, ["x", "y", "z"])
    got = p.transform(df).orderBy("idx").select("component_1", "component_2").toPandas().to_numpy()
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ axes[:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6) and np.allclose(got.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(X.covariance(df, ["x", "y", "z"]), np.cov(x.T), atol=1e-9)


def test_lda_separates(cloud):
    df, _ = cloud
    p = X.fit_lda(df, ["x", "y", "z"], k=1)
    r = p.transform(df).groupBy("label").agg(F.avg("component_1").alias("m"), F.stddev("component_1").alias("s")).collect()
    assert abs(r[0].m - r[1].m) > 1.5 * max(r[0].s, r[1].s)
    # within-class spread is scaled to 1
    assert np.sqrt(np.mean([q.s**2 for q in r])) == pytest.approx(1, abs=0.1)
    with pytest.raises(ValueError):
        X.fit_lda(df, ["x", "y", "z"], k=2)


def test_factor_analysis_and_ica(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=600)
    x = f[:, None] * [1.0, 2.0, -1.0] + rng.normal(size=(600, 3)) * [0.2, 1.5, 0.4] + 3
    one = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "idx long, x double, y double, z double")
    fa = X.fit_factor_analysis(one, ["x", "y", "z"], k=1).transform(one).orderBy("idx").toPandas()["component_1"]
    assert abs(np.corrcoef(fa, f)[0, 1]) > 0.97 and abs(fa.mean()) < 1e-9
    rng = np.random.default_rng(0)
    s = np.column_stack([rng.uniform(-1, 1, 800), np.sign(rng.normal(size=800)) * rng.random(800) ** 0.3])
    m = s @ np.array([[1.0, 0.6], [0.4, 1.2]])
    mixed = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(m)], "idx long, x double, y double")
    got = X.fit_fast_ica(mixed, ["x", "y"]).transform(mixed).orderBy("idx").toPandas()[["component_1", "component_2"]].to_numpy()
    c = np.abs(np.corrcoef(np.column_stack([s, got]).T)[:2, 2:])
    assert c.max(axis=1).min() > 0.95


def test_reducers_and_plane(cloud):
    df, _ = cloud
    assert X.feature_space_2d(df, ["x"], ["idx"]).columns == ["idx", "x", "y"]
    assert X.feature_space_2d(df, ["x", "y", "z"], ["idx"]).count() == 500
    with pytest.raises(ValueError):
        X.reduce_dimensions(df, ["x"], "tsne")
    with pytest.raises(ValueError):
        X.reduce_dimensions(df, ["x"], "lda")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 101, 1000, 5003])
def test_shuffles_are_permutations(spark, n):
    df = spark.range(n).crossJoin(spark.range(3).select(F.col("id").alias("r")))
    got = df.select("id", "r", I.shuffled(F.col("id"), F.col("r"), n, 7).alias("p")).toPandas()
    orders = []
    for _, g in got.groupby("r"):
        p = g.sort_values("id")["p"].to_numpy()
        assert sorted(p) == list(range(n))
        orders.append(tuple(p))
        if n > 1000:  # no shift: distances differ, neighbours part, and order is lost
            assert len(set((p - np.arange(n)) % n)) > n / 2
            assert np.mean(np.abs(np.diff(p)) < n / 10) < 0.3 and abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.1
    assert n < 17 or len(set(orders)) == 3
