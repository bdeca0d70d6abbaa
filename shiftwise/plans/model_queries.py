"""F1-F8, B1-B8, X1-X4 and D16 on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.operators import boundary, importance, project
from shiftwise.operators.prep import min_max_scale
from shiftwise.operators.two_sample import feature_ranges
from shiftwise.plans.catalog import query, rnd, rounded
from shiftwise.plans.inputs import EVENT_FEATURES, EVENT_SIDES, LINE_SIDES, VECTOR_SIZE, event_sides, line_sides, vector_windows

FEATURES = ["l_quantity", "l_discount", "l_tax"]
SMALL = {"max_iter": 20}
TREES = {"trees": 10, "depth": 5}


def _events(spark, sf):
    return min_max_scale(event_sides(spark, sf).na.drop(), EVENT_FEATURES)


@query("fit_classifier")
def _fit(spark, sf):
    rows = _events(spark, sf)
    clf = importance.fit_classifier(rows, EVENT_FEATURES, params=SMALL)
    return clf.predict(rows).groupBy("label", "predicted").agg(F.count("*").alias("n"))


@query("fit_forest")
def _fit_forest(spark, sf):
    rows = _events(spark, sf)
    clf = importance.fit_classifier(rows, EVENT_FEATURES, kind="random_forest", params=TREES)
    return clf.predict(rows).groupBy("label", "predicted").agg(F.count("*").alias("n"))


@query("time_classifier")
def _time(spark, sf):
    clf, rows = importance.time_classifier(_events(spark, sf), EVENT_FEATURES, True, "random_forest", TREES)
    return clf.predict(rows).groupBy("time", "predicted").agg(F.count("*").alias("n"))


@query("permutation_importance")
def _permutation(spark, sf):
    clf, rows = importance.time_classifier(_events(spark, sf), EVENT_FEATURES, False, "random_forest", TREES)
    return rounded(importance.permutation_importance(clf, rows, "time", ["idx"]))


@query("kernel_shap")
def _shap(spark, sf):
    clf, rows = importance.time_classifier(_events(spark, sf), EVENT_FEATURES, True, "random_forest", TREES)
    return rounded(importance.kernel_shap(clf, rows, ["idx"]))


@query("lime_importance")
def _lime(spark, sf):
    clf, rows = importance.time_classifier(_events(spark, sf), EVENT_FEATURES, True, "random_forest", TREES)
    return rounded(importance.lime_importance(clf, rows, ["idx"]))


@query("drift_importance")
def _drift(spark, sf):
    return rounded(importance.drift_importance(
        _events(spark, sf), EVENT_FEATURES, ["idx"], kind="random_forest", params=TREES))


@query("predictive_importance_shift")
def _predictive(spark, sf):
    return rounded(importance.predictive_importance_shift(
        _events(spark, sf), EVENT_FEATURES, ["idx"], kind="random_forest", params=TREES))


@query("importance_ranking", """
WITH f AS (SELECT 'value' AS feature, avg(value) AS importance_mean, stddev_pop(value) AS importance_std FROM events
           UNION ALL SELECT 'k', avg(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE)),
                            stddev_pop(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE)) FROM events)
SELECT feature, round(importance_mean, 5) + 0.0 AS importance_mean, round(importance_std, 5) + 0.0 AS importance_std,
       CAST(row_number() OVER (ORDER BY importance_mean DESC, feature) AS INTEGER) AS place FROM f""")
def _ranking(spark, sf):
    raw = event_sides(spark, sf).select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in EVENT_FEATURES])).alias("r")
    ).select("r.*")
    return rounded(importance.importance_ranking(importance.summarise(raw)), 5)


def _given_predictions(spark, sf):
    """Known predictions of two threshold models on the quantity."""
    return line_sides(spark, sf).select(
        *FEATURES,
        F.when(F.col("l_quantity") > 20, "1").otherwise("0").alias("old_label"),
        F.when(F.col("l_quantity") > 30, "1").otherwise("0").alias("new_label"),
    ).withColumn("disagree", (F.col("old_label") != F.col("new_label")).cast("int"))


@query("model_disagreement", f"""WITH {LINE_SIDES}
SELECT count(*) AS rows, {rnd('avg(CASE WHEN (l_quantity > 20) <> (l_quantity > 30) THEN 1.0 ELSE 0.0 END)', 'drift_rate')} FROM li""")
def _disagreement(spark, sf):
    return rounded(boundary.model_disagreement(_given_predictions(spark, sf)))


def _models(spark, sf):
    rows = _events(spark, sf)
    old = importance.fit_classifier(rows.where("side = 'before'"), EVENT_FEATURES, kind="random_forest", params=TREES)
    new = importance.fit_classifier(rows.where("side = 'after'"), EVENT_FEATURES, kind="random_forest", params=TREES)
    return old, new, rows.where("side = 'after'")


@query("projection_grid")
def _grid(spark, sf):
    rows = min_max_scale(line_sides(spark, sf), FEATURES)
    plane = project.fit_pca(rows.where("side = 'after'"), FEATURES)
    return rounded(boundary.projection_grid(rows.where("side = 'after'"), plane))


@query("grid_predictions")
def _grid_predictions(spark, sf):
    old, _, after = _models(spark, sf)
    plane = project.fit_pca(after, EVENT_FEATURES)
    points = boundary.projection_grid(after, plane)
    return rounded(boundary.grid_predictions(old, points))


@query("disagreement_table")
def _table(spark, sf):
    old, new, after = _models(spark, sf)
    plane = project.fit_pca(after, EVENT_FEATURES)
    points = boundary.projection_grid(after, plane)
    raw = event_sides(spark, sf).where("side = 'before'")
    units = {r.feature: (r.m, r.c) for r in boundary.unscale_from_ranges(feature_ranges(raw, EVENT_FEATURES)).collect()}
    return rounded(boundary.disagreement_table(old, new, after, EVENT_FEATURES, points, units))


@query("drift_rules", f"""WITH {LINE_SIDES}
SELECT CAST(sum(CASE WHEN l_quantity > 20 AND l_quantity <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS samples FROM li""")
def _rules(spark, sf):
    given = _given_predictions(spark, sf)
    tree = boundary.disagreement_tree(given, FEATURES)
    rules, _ = boundary.drift_rules(tree, given, FEATURES)
    return boundary.rule_coverage(rules, given).agg(F.sum("samples").alias("samples"))


KNOWN_RULES = [
    boundary.Rule(0, {"l_quantity": 10.0}, {"l_quantity": 20.0}),
    boundary.Rule(1, {"l_quantity": 20.0}, {"l_discount": 0.03}),
    boundary.Rule(2, {"l_discount": 0.03, "l_quantity": 20.0}, {"l_tax": 0.02}),
]
RULE_CASE = """CASE WHEN l_quantity > 10 AND l_quantity <= 20 THEN 0 WHEN l_quantity > 20 AND l_discount <= 0.03 THEN 1
  WHEN l_discount > 0.03 AND l_quantity > 20 AND l_tax <= 0.02 THEN 2 END"""


@query("rule_coverage", f"""WITH {LINE_SIDES},
lf AS (SELECT side, {RULE_CASE} AS leaf FROM li),
c AS (SELECT leaf, count(*) FILTER (side = 'after') AS samples, count(*) FILTER (side = 'before') AS grid_points FROM lf GROUP BY 1),
t AS (SELECT leaf, samples, samples / sum(samples) OVER () AS coverage, grid_points, grid_points / sum(grid_points) OVER () AS area FROM c)
SELECT CAST(leaf AS INTEGER) AS leaf, samples, {rnd('coverage', 'coverage')}, grid_points, {rnd('area', 'area')},
       CAST(row_number() OVER (ORDER BY coverage DESC, area DESC, leaf) AS INTEGER) AS place FROM t WHERE leaf IS NOT NULL""")
def _coverage(spark, sf):
    rows = line_sides(spark, sf)
    return rounded(boundary.rule_coverage(KNOWN_RULES, rows.where("side = 'after'"), rows.where("side = 'before'")))


@query("drift_region_map", f"""WITH {LINE_SIDES}
SELECT CASE {RULE_CASE} WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS region, count(*) AS n FROM li GROUP BY 1""")
def _region(spark, sf):
    mapped = boundary.drift_region_map(KNOWN_RULES, {0: 3, 1: 1, 2: 2}, line_sides(spark, sf))
    return mapped.groupBy("region").agg(F.count("*").alias("n"))


@query("unscale_bounds", f"""WITH {LINE_SIDES}
{' UNION ALL '.join(f"SELECT '{f}' AS feature, {rnd(f'max({f}) - min({f})', 'm', 5)}, {rnd(f'min({f})', 'c', 5)} FROM li WHERE side = 'before'" for f in FEATURES)}""")
def _unscale(spark, sf):
    return rounded(boundary.unscale_from_ranges(feature_ranges(line_sides(spark, sf), FEATURES)), 5)


@query("unscale_bounds_fitted", f"""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00')
SELECT 'value' AS feature, {rnd('hi - lo', 'm', 4)}, {rnd('lo', 'c', 4)} FROM e""")
def _unscale_fitted(spark, sf):
    raw = event_sides(spark, sf)
    return rounded(boundary.unscale_bounds(min_max_scale(raw, ["value"]), raw, ["value"]), 4)


def _vectors(spark, sf):
    return vector_windows(spark, sf).select("idx", "label", *[F.col("features")[i].alias(f"x{i + 1}") for i in range(VECTOR_SIZE)])


VECTOR_FEATURES = [f"x{i + 1}" for i in range(VECTOR_SIZE)]


def _reduced(kind: str):
    @query(kind if kind != "lda" else "lda_discriminant")
    def _run(spark, sf):
        out = project.reduce_dimensions(_vectors(spark, sf), VECTOR_FEATURES, kind, 2, "label")
        return rounded(out.select("idx", "component_1", "component_2"))


for _kind in ("pca", "lda", "fa", "ica"):
    _reduced(_kind)


@query("feature_space_2d", f"""WITH {EVENT_SIDES}
SELECT value AS x, k AS y, side, label FROM ev""")
def _space(spark, sf):
    rows = event_sides(spark, sf)
    return project.feature_space_2d(rows, EVENT_FEATURES, ["side", "label"])


@query("feature_space_pca")
def _space_pca(spark, sf):
    return rounded(project.feature_space_2d(_vectors(spark, sf), VECTOR_FEATURES, ["idx", "label"]))
