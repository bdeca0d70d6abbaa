"""C1-C14 on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.operators import clusters
from shiftwise.operators.prep import standard_scale
from shiftwise.plans.catalog import query, rnd, rounded
from shiftwise.plans.inputs import LINE_SIDES, line_sides
from shiftwise.session import cut_lineage

FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _scaled(spark, sf):
    return standard_scale(line_sides(spark, sf).select("side", "label", *FEATURES), FEATURES)


def _given(spark, sf):
    """Known clusters: two per class by quantity, one that appears in every class and one that leaves class A."""
    raw = line_sides(spark, sf).select("side", "label", *FEATURES)
    base = F.when(F.col("label") == "A", 0).when(F.col("label") == "N", 3).otherwise(6)
    after = F.col("side") == "after"
    local = (
        F.when(after & (F.col("l_discount") > 0.08), 2)
        .when(after & (F.col("label") == "A"), 0)
        .when(F.col("l_quantity") > 25, 1)
        .otherwise(0)
    )
    return standard_scale(raw.withColumn("cluster", (base + local).cast("int")), FEATURES)


GIVEN = f"""{LINE_SIDES},
ft AS (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in FEATURES)} FROM li WHERE side = 'before'),
gc AS (SELECT side, label,
              CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 3 ELSE 6 END
              + CASE WHEN side = 'after' AND l_discount > 0.08 THEN 2 WHEN side = 'after' AND label = 'A' THEN 0
                     WHEN l_quantity > 25 THEN 1 ELSE 0 END AS cluster,
              {', '.join(f'(l.{f} - m_{f}) / s_{f} AS {f}' for f in FEATURES)}
       FROM li l, ft),
ce AS (SELECT cluster, max(label) AS label, count(*) FILTER (side = 'before') AS nb, count(*) FILTER (side = 'after') AS na,
              {', '.join(f"avg({f}) FILTER (side = 'before') AS b_{f}, avg({f}) FILTER (side = 'after') AS a_{f}" for f in FEATURES)}
       FROM gc GROUP BY 1),
sh AS (SELECT *, CASE WHEN nb = 0 THEN 'appeared' WHEN na = 0 THEN 'disappeared' ELSE 'present' END AS state,
              sqrt({' + '.join(f'(a_{f} - b_{f}) * (a_{f} - b_{f})' for f in FEATURES)}) AS shift FROM ce),
sd AS (SELECT *, CASE WHEN state = 'present' THEN shift > 0.15 * sqrt(3) ELSE true END AS drift FROM sh),
cl AS ({' UNION ALL '.join(f"SELECT cluster, side, '{f}' AS feature, {f} AS value FROM gc" for f in FEATURES)}),
cs AS (SELECT cluster, side, feature, median(value) AS median, avg(value) AS mean, stddev_samp(value) AS std FROM cl GROUP BY 1, 2, 3),
cq AS ({' UNION ALL '.join(f"SELECT cluster, side, feature, '{s}' AS stat, {s} AS value FROM cs" for s in ('median', 'mean', 'std'))}),
cp AS (SELECT cluster, feature, stat, max(value) FILTER (side = 'before') AS before, max(value) FILTER (side = 'after') AS after
       FROM cq GROUP BY 1, 2, 3),
ct AS (SELECT *, (after - before) / CASE WHEN abs(before) < 1e-10 THEN 1.0 ELSE abs(before) END AS shift FROM cp),
ds AS (SELECT gc.cluster, gc.label, side, CASE WHEN side = 'before'
              THEN sqrt({' + '.join(f'({f} - b_{f}) * ({f} - b_{f})' for f in FEATURES)})
              ELSE sqrt({' + '.join(f'({f} - a_{f}) * ({f} - a_{f})' for f in FEATURES)}) END AS d
       FROM gc JOIN ce ON gc.cluster = ce.cluster),
da AS (SELECT cluster, max(label) AS label, avg(d) FILTER (side = 'before') AS before, avg(d) FILTER (side = 'after') AS after
       FROM ds GROUP BY 1),
dd AS (SELECT *, (after - before) / before AS shift, coalesce(abs((after - before) / before) > 0.1, true) AS drift FROM da),
cn AS (SELECT label, sum(CASE WHEN nb = 0 OR na = 0 THEN 1 ELSE 0 END) AS changed FROM ce GROUP BY 1),
fl AS (SELECT label, 'cluster_count' AS criterion, changed >= 1 AS drift FROM cn
       UNION ALL SELECT label, 'stats', coalesce(abs(shift) > 0.2, true) FROM ct JOIN (SELECT cluster, label FROM ce) USING (cluster)
       UNION ALL SELECT label, 'centroid_shift', drift FROM sd
       UNION ALL SELECT label, 'avg_distance', drift FROM dd)"""

WEIGHT = ("CASE criterion WHEN 'cluster_count' THEN 0.4 WHEN 'stats' THEN 0.25 WHEN 'centroid_shift' THEN 0.25 "
          "ELSE 0.1 END")


@query("xmeans_per_class")
def _xmeans(spark, sf):
    vectors = _scaled(spark, sf).withColumn("features", F.array(*FEATURES))
    centres = clusters.xmeans_per_class(vectors, len(FEATURES))
    return centres.select("side", "label", F.explode("centres").alias("c")).select(
        "side", "label", F.col("c.id").alias("cluster"), *[F.col("c.v")[i].alias(f) for i, f in enumerate(FEATURES)]
    )


def _given_centres(spark, sf):
    """Known centres: the means of the low and the high half by quantity, per side and class."""
    rows = _scaled(spark, sf)
    half = rows.groupBy("side", "label", (F.col("l_quantity") > 0).cast("int").alias("id")).agg(
        F.array(*[F.avg(f) for f in FEATURES]).alias("v")
    )
    return half.groupBy("side", "label").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("centres"))


HALVES = f"""{GIVEN},
hc AS (SELECT side, label, CASE WHEN l_quantity > 0 THEN 1 ELSE 0 END AS id, {', '.join(f'avg({f}) AS c_{f}' for f in FEATURES)}
       FROM gc GROUP BY 1, 2, 3)"""


@query("cluster_assign", f"""WITH {HALVES},
nr AS (SELECT row_number() OVER () AS n, * FROM gc),
dc AS (SELECT n, nr.side, nr.label, id, {' + '.join(f'({f} - c_{f}) * ({f} - c_{f})' for f in FEATURES)} AS d
       FROM nr JOIN hc ON nr.side = hc.side AND nr.label = hc.label),
bc AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY d, id) AS r FROM dc)
SELECT side, label, CAST(id AS INTEGER) AS cluster, count(*) AS n, {rnd('avg(sqrt(d))', 'mean_distance', 5)}
FROM bc WHERE r = 1 GROUP BY 1, 2, 3""")
def _assign(spark, sf):
    vectors = _scaled(spark, sf).withColumn("features", F.array(*FEATURES))
    got = clusters.assign_clusters(vectors, _given_centres(spark, sf))
    return rounded(
        got.groupBy("side", "label", "cluster").agg(F.count("*").alias("n"), F.avg(F.sqrt("sq_dist")).alias("mean_distance")), 5
    )


@query("match_clusters", f"""WITH {HALVES}
SELECT label, CAST(id AS INTEGER) AS old_id, CAST(id AS INTEGER) AS new_id FROM hc WHERE side = 'before'""")
def _match(spark, sf):
    return clusters.match_clusters(_given_centres(spark, sf), len(FEATURES))


@query("global_cluster_ids", f"""WITH {HALVES}
SELECT side, label, CAST(id AS INTEGER) AS local_id,
       CAST(id + CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END AS INTEGER) AS cluster FROM hc""")
def _ids(spark, sf):
    return clusters.global_cluster_ids(clusters.match_clusters(_given_centres(spark, sf), len(FEATURES)))


@query("cluster_drift_pipeline")
def _pipeline(spark, sf):
    found = cut_lineage(clusters.cluster_rows(_scaled(spark, sf), FEATURES))
    return clusters.cluster_drift_strength(clusters.cluster_flags(found, FEATURES))


@query("centroid_shift", f"""WITH {GIVEN}
SELECT CAST(cluster AS INTEGER) AS cluster, label, state, {', '.join(rnd(f'a_{f} - b_{f}', f'delta_{f}', 5) for f in FEATURES)},
       {rnd('shift', 'shift', 5)}, drift FROM sd""")
def _shift(spark, sf):
    return rounded(clusters.centroid_shift(clusters.cluster_centroids(_given(spark, sf), FEATURES), FEATURES), 5)


@query("cluster_stats", f"""WITH {GIVEN}
SELECT CAST(cluster AS INTEGER) AS cluster, side, feature, {rnd('mean', 'mean', 5)}, {rnd('std', 'std', 5)},
       {rnd('median', 'median', 5)} FROM cs""")
def _stats(spark, sf):
    return rounded(clusters.cluster_stats(_given(spark, sf), FEATURES), 5)


def _shifts(spark, sf):
    return clusters.cluster_stat_shift(clusters.cluster_stats(_given(spark, sf), FEATURES))


@query("cluster_stat_shift", f"""WITH {GIVEN}
SELECT CAST(cluster AS INTEGER) AS cluster, feature, stat, {rnd('before', 'before', 4)}, {rnd('after', 'after', 4)},
       {rnd('shift', 'shift', 4)} FROM ct""")
def _stat_shift(spark, sf):
    return rounded(_shifts(spark, sf), 4)


@query("cluster_stat_drift", f"""WITH {GIVEN}
SELECT CAST(cluster AS INTEGER) AS cluster, feature, stat, coalesce(abs(shift) > 0.2, true) AS drift FROM ct""")
def _stat_drift(spark, sf):
    return clusters.cluster_stat_drift(_shifts(spark, sf)).select("cluster", "feature", "stat", "drift")


@query("avg_distance_shift", f"""WITH {GIVEN}
SELECT CAST(cluster AS INTEGER) AS cluster, label, {rnd('before', 'before', 5)}, {rnd('after', 'after', 5)},
       {rnd('shift', 'shift', 5)}, drift FROM dd""")
def _distance(spark, sf):
    rows = _given(spark, sf)
    return rounded(clusters.avg_distance_shift(rows, clusters.cluster_centroids(rows, FEATURES), FEATURES), 5)


@query("cluster_count_drift", f"""WITH {GIVEN}
SELECT label, CAST(changed AS INTEGER) AS changed, changed >= 1 AS drift FROM cn""")
def _count(spark, sf):
    return clusters.cluster_count_drift(_given(spark, sf)).select("label", "changed", "drift")


@query("cluster_drift_strength", f"""WITH {GIVEN},
sr AS (SELECT criterion, sum(CASE WHEN drift THEN 1 ELSE 0 END) / (count(*) + 1e-10) AS share FROM fl GROUP BY 1)
SELECT {rnd(f'sum(share * {WEIGHT})', 'strength')}, sum(share * {WEIGHT}) > 0.5 AS drift FROM sr""")
def _strength(spark, sf):
    return rounded(clusters.cluster_drift_strength(clusters.cluster_flags(_given(spark, sf), FEATURES)))


@query("class_contributions", f"""WITH {GIVEN}, tt AS (SELECT criterion, count(*) AS n FROM fl GROUP BY 1),
mi AS (SELECT criterion, label, sum(CASE WHEN drift THEN 1.0 ELSE 0 END) AS t FROM fl GROUP BY 1, 2)
SELECT label, criterion, {rnd(f't / n * {WEIGHT}', 'contribution')} FROM mi JOIN tt USING (criterion)""")
def _contributions(spark, sf):
    return rounded(clusters.class_contributions(clusters.cluster_flags(_given(spark, sf), FEATURES)))


@query("cluster_report", f"""WITH {GIVEN}
SELECT CAST(sd.cluster AS INTEGER) AS cluster, sd.label, state, {rnd('sd.shift', 'centroid_shift', 5)}, sd.drift AS centroid_drifted,
       {', '.join(rnd(f'b_{f}', f'before_{f}', 5) for f in FEATURES)}, {', '.join(rnd(f'a_{f}', f'after_{f}', 5) for f in FEATURES)},
       {rnd('dd.shift', 'distance_change', 5)}, dd.drift AS distance_drifted
FROM sd JOIN dd ON sd.cluster = dd.cluster""")
def _report(spark, sf):
    return rounded(clusters.cluster_report(_given(spark, sf), FEATURES), 5)


@query("cluster_assignment_report", f"""WITH {GIVEN}
SELECT label, string_agg(CASE WHEN nb > 0 THEN CAST(cluster AS VARCHAR) END, ', ' ORDER BY cluster) AS before,
       string_agg(CASE WHEN na > 0 THEN CAST(cluster AS VARCHAR) END, ', ' ORDER BY cluster) AS after FROM ce GROUP BY label""")
def _assignment_report(spark, sf):
    return clusters.cluster_assignment_report(_given(spark, sf))


@query("shift_heatmap_codes", f"""WITH {GIVEN}
SELECT CAST(cluster AS INTEGER) AS cluster, feature, stat, CASE WHEN shift IS NULL THEN 2 WHEN abs(shift) > 0.2 THEN 1 ELSE 0 END AS code FROM ct""")
def _heatmap(spark, sf):
    return clusters.shift_heatmap_codes(_shifts(spark, sf))
