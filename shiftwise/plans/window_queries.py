"""M1-M11 and R1-R16 on the given embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.operators import recurrence, windows
from shiftwise.plans.catalog import query, rnd, rounded
from shiftwise.plans.inputs import (
    first_prototypes, l2_sql, tree_windows_sql, vector_windows, with_cell_leaves
)

BASE = tree_windows_sql()


def _rows(spark, sf, size: int = 100):
    return with_cell_leaves(vector_windows(spark, sf, size))


def _parts(spark, sf, size: int = 100):
    rows = _rows(spark, sf, size)
    return windows.window_pairs(rows), first_prototypes(rows), rows


PAIRS = """wi AS (SELECT DISTINCT window_id FROM vw),
pa AS (SELECT a.window_id AS window_a, b.window_id AS window_b FROM wi a JOIN wi b ON a.window_id < b.window_id)"""

ASSIGN = f"""{BASE}, {PAIRS},
di AS (SELECT window_a, window_b, t.idx, t.label AS y, p.window_id AS pw, p.proto_id, p.label,
              {l2_sql('t.features', 'p.features')} AS d
       FROM pa JOIN tw t ON t.window_id = window_b JOIN pr p ON p.window_id IN (window_a, window_b)),
rk AS (SELECT *, row_number() OVER (PARTITION BY window_a, window_b, idx, pw ORDER BY d, proto_id) AS r FROM di),
asg AS (SELECT window_a, window_b, idx, max(CASE WHEN pw = window_a THEN CAST(proto_id AS VARCHAR) END) AS in_a,
               max(CASE WHEN pw = window_b THEN CAST(proto_id AS VARCHAR) END) AS in_b
        FROM rk WHERE r = 1 GROUP BY 1, 2, 3),
ce AS (SELECT window_a, window_b, in_a, in_b, CAST(count(*) AS DOUBLE) AS n FROM asg GROUP BY 1, 2, 3, 4),
ma AS (SELECT window_a, window_b, in_a, sum(n) AS na FROM ce GROUP BY 1, 2, 3),
mb AS (SELECT window_a, window_b, in_b, sum(n) AS nb FROM ce GROUP BY 1, 2, 3),
pc AS (SELECT window_a, window_b, (SELECT sum(n * (n - 1) / 2) FROM ce WHERE ce.window_a = pa.window_a AND ce.window_b = pa.window_b) AS s,
              (SELECT sum(na * (na - 1) / 2) FROM ma WHERE ma.window_a = pa.window_a AND ma.window_b = pa.window_b) AS sa,
              (SELECT sum(nb * (nb - 1) / 2) FROM mb WHERE mb.window_a = pa.window_a AND mb.window_b = pa.window_b) AS sb,
              (SELECT sum(n) FROM ce WHERE ce.window_a = pa.window_a AND ce.window_b = pa.window_b) AS t FROM pa)"""


@query("assignment_pair", f"WITH {ASSIGN} SELECT * FROM asg")
def _assign(spark, sf):
    return windows.assignment_pairs(*_parts(spark, sf))


def _cells(spark, sf):
    return windows.contingency(windows.assignment_pairs(*_parts(spark, sf)))


@query("adjusted_mutual_info", f"""WITH {ASSIGN},
mi AS (SELECT window_a, window_b, sum(n / t * ln(n * t / (na * nb))) AS mi
       FROM ce JOIN ma USING (window_a, window_b, in_a) JOIN mb USING (window_a, window_b, in_b) JOIN pc USING (window_a, window_b) GROUP BY 1, 2),
ha AS (SELECT window_a, window_b, sum(-na / t * ln(na / t)) AS h FROM ma JOIN pc USING (window_a, window_b) GROUP BY 1, 2),
hb AS (SELECT window_a, window_b, sum(-nb / t * ln(nb / t)) AS h FROM mb JOIN pc USING (window_a, window_b) GROUP BY 1, 2),
mg AS (SELECT window_a, window_b, na, nb, t, unnest(range(CAST(greatest(1, na + nb - t) AS BIGINT), CAST(least(na, nb) AS BIGINT) + 1)) AS k
       FROM ma JOIN mb USING (window_a, window_b) JOIN pc USING (window_a, window_b)),
em AS (SELECT window_a, window_b, sum(k / t * ln(t * k / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(t - na + 1)
              + lgamma(t - nb + 1) - lgamma(t + 1) - lgamma(k + 1.0) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(t - na - nb + k + 1))) AS emi
       FROM mg GROUP BY 1, 2)
SELECT window_a, window_b, {rnd('(mi - emi) / ((ha.h + hb.h) / 2 - emi)', 'score')}
FROM mi JOIN em USING (window_a, window_b) JOIN ha USING (window_a, window_b) JOIN hb USING (window_a, window_b)""")
def _ami(spark, sf):
    return rounded(windows.adjusted_mutual_info(_cells(spark, sf)))


@query("adjusted_rand", f"""WITH {ASSIGN}
SELECT window_a, window_b, {rnd('(s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2))', 'score')}
FROM pc""")
def _ari(spark, sf):
    return rounded(windows.adjusted_rand(_cells(spark, sf)))


@query("fowlkes_mallows", f"WITH {ASSIGN} SELECT window_a, window_b, {rnd('s / sqrt(sa * sb)', 'score')} FROM pc")
def _fmi(spark, sf):
    return rounded(windows.fowlkes_mallows(_cells(spark, sf)))


@query("completeness", f"""WITH {ASSIGN},
h AS (SELECT window_a, window_b, sum(-nb / t * ln(nb / t)) AS hb FROM mb JOIN pc USING (window_a, window_b) GROUP BY 1, 2),
g AS (SELECT window_a, window_b, sum(-n / t * ln(n / na)) AS hc
      FROM ce JOIN ma USING (window_a, window_b, in_a) JOIN pc USING (window_a, window_b) GROUP BY 1, 2)
SELECT window_a, window_b, {rnd('1 - hc / hb', 'score')} FROM h JOIN g USING (window_a, window_b)""")
def _completeness(spark, sf):
    return rounded(windows.completeness(_cells(spark, sf)))


def displacement_sql(size: int = 100) -> str:
    """All pairs; the element-wise means come from unnested vectors."""
    return f"""{tree_windows_sql(size)}, {PAIRS},
un AS (SELECT window_id, label, generate_subscripts(features, 1) AS i, unnest(features) AS v FROM pr),
cn AS (SELECT window_id, label, i, avg(v) AS v FROM un GROUP BY 1, 2, 3),
pl AS (SELECT DISTINCT window_a, window_b, p.label FROM pa JOIN pr p ON p.window_id IN (window_a, window_b)),
cd AS (SELECT pl.window_a, pl.window_b, pl.label,
              (SELECT sqrt(sum((a.v - b.v) * (a.v - b.v))) FROM cn a JOIN cn b ON a.i = b.i AND a.label = b.label
               WHERE a.window_id = pl.window_a AND b.window_id = pl.window_b AND a.label = pl.label) AS d FROM pl),
sc AS (SELECT window_a, window_b, avg(coalesce(d, 2)) AS score FROM cd GROUP BY 1, 2),
mx AS (SELECT * FROM sc UNION ALL SELECT window_b, window_a, score FROM sc
       UNION ALL SELECT window_id, window_id, 0 FROM wi)"""


DISPLACEMENT = displacement_sql()


@query("centroid_displacement", f"WITH {DISPLACEMENT} SELECT window_a, window_b, {rnd('score', 'score')} FROM sc")
def _displacement(spark, sf):
    pairs, protos, _ = _parts(spark, sf)
    return rounded(windows.centroid_displacement(pairs, protos))


@query("class_displacement", f"""WITH {DISPLACEMENT}
SELECT window_a, window_b, label, {rnd('coalesce(d, 10)', 'score')} FROM cd""")
def _class_displacement(spark, sf):
    pairs, protos, _ = _parts(spark, sf)
    return rounded(windows.class_displacement(pairs, protos))


MINIMAL = f"""{BASE}, {PAIRS},
nn AS (SELECT pl.window_a, pl.window_b, pl.label,
              (SELECT count(*) FROM pr WHERE window_id = window_a AND pr.label = pl.label) AS na,
              (SELECT count(*) FROM pr WHERE window_id = window_b AND pr.label = pl.label) AS nb
       FROM (SELECT DISTINCT window_a, window_b, p.label FROM pa JOIN pr p ON p.window_id IN (window_a, window_b)) pl),
dd AS (SELECT nn.*, a.proto_id AS ia, b.proto_id AS ib, {l2_sql('a.features', 'b.features')} AS d
       FROM nn JOIN pr a ON a.window_id = window_a AND a.label = nn.label
       JOIN pr b ON b.window_id = window_b AND b.label = nn.label),
mn AS (SELECT window_a, window_b, label, CASE WHEN na > nb THEN ia ELSE ib END AS k, min(d) AS d FROM dd GROUP BY 1, 2, 3, 4),
ms AS (SELECT nn.window_a, nn.window_b, nn.label, greatest(na, nb) AS n, na = 0 OR nb = 0 AS missing,
              CASE WHEN na = 0 OR nb = 0 THEN greatest(na, nb) * 2.0 ELSE
                (SELECT sum(d) FROM mn WHERE mn.window_a = nn.window_a AND mn.window_b = nn.window_b AND mn.label = nn.label) END AS total
       FROM nn)"""


@query("minimal_distance", f"""WITH {MINIMAL}
SELECT window_a, window_b, {rnd('sum(total) / sum(n)', 'score')} FROM ms GROUP BY 1, 2""")
def _minimal(spark, sf):
    pairs, protos, _ = _parts(spark, sf)
    return rounded(windows.minimal_distance(pairs, protos))


@query("classwise_minimal_distance", f"""WITH {MINIMAL}
SELECT window_a, window_b, {rnd('avg(CASE WHEN missing THEN total ELSE total / n END)', 'score')} FROM ms GROUP BY 1, 2""")
def _class_minimal(spark, sf):
    pairs, protos, _ = _parts(spark, sf)
    return rounded(windows.minimal_distance(pairs, protos, "class"))


@query("reassignment_impact", f"""WITH {ASSIGN},
be AS (SELECT window_a, window_b, idx, pw, d, label FROM rk WHERE r = 1),
ca AS (SELECT c.window_a, c.window_b, c.pw, c.proto_id, c.y,
              CASE WHEN c.d < b.d OR (c.d = b.d AND c.label < b.label) THEN c.label ELSE b.label END AS now, b.label AS was
       FROM di c JOIN be b ON b.window_a = c.window_a AND b.window_b = c.window_b AND b.idx = c.idx AND b.pw <> c.pw),
ch AS (SELECT window_a, window_b, pw, proto_id,
              abs(avg(CASE WHEN now = y THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN was = y THEN 1.0 ELSE 0.0 END)) AS m
       FROM ca GROUP BY 1, 2, 3, 4),
wy AS (SELECT window_a, window_b, pw, avg(m) AS m FROM ch GROUP BY 1, 2, 3)
SELECT window_a, window_b, {rnd('sum(m) / 2', 'score')} FROM wy GROUP BY 1, 2""")
def _impact(spark, sf):
    return rounded(windows.reassignment_impact(*_parts(spark, sf)))


@query("compare_window_to_all", f"""WITH {DISPLACEMENT}
SELECT CAST(2 AS BIGINT) AS window_a, window_b, {rnd('score', 'score')} FROM mx WHERE window_a = 2""")
def _to_all(spark, sf):
    _, protos, rows = _parts(spark, sf)
    return rounded(windows.compare_window_to_all(2, protos, rows))


@query("window_distance_matrix", f"WITH {DISPLACEMENT} SELECT window_a, window_b, {rnd('score', 'score')} FROM mx")
def _matrix(spark, sf):
    return rounded(_full(spark, sf))


def _full(spark, sf, size: int = 100):
    _, protos, rows = _parts(spark, sf, size)
    return windows.window_distance_matrix(protos, rows)


@query("matrix_stats", f"""WITH {DISPLACEMENT}
SELECT {rnd('avg(score)', 'mean')}, {rnd('stddev_pop(score)', 'std')}, {rnd('max(score)', 'max')} FROM mx""")
def _stats(spark, sf):
    return rounded(windows.matrix_stats(_full(spark, sf)))


@query("median_filter_1d", """
WITH e AS (SELECT event_id AS idx, value FROM events), n AS (SELECT max(idx) AS last FROM e),
o AS (SELECT e.idx, greatest(0, least(last, e.idx + k.range)) AS src FROM e, n, range(-2, 3) k)
SELECT o.idx, median(s.value) AS value FROM o JOIN e s ON s.idx = o.src GROUP BY o.idx""")
def _median1(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("idx"), "value")
    return recurrence.median_filter_1d(events, 5)


@query("median_filter_2d", f"""WITH {DISPLACEMENT}, n AS (SELECT max(window_a) AS last FROM mx),
o AS (SELECT window_a, window_b, greatest(0, least(last, window_a + k.range)) AS i, greatest(0, least(last, window_b + l.range)) AS j
      FROM mx, n, range(-1, 2) k, range(-1, 2) l)
SELECT o.window_a, o.window_b, {rnd('median(s.score)', 'score')}
FROM o JOIN mx s ON s.window_a = o.i AND s.window_b = o.j GROUP BY 1, 2""")
def _median2(spark, sf):
    return rounded(recurrence.median_filter_2d(_full(spark, sf)))


@query("mutual_reachability", f"""WITH {displacement_sql(25)},
co AS (SELECT window_a, score, row_number() OVER (PARTITION BY window_a ORDER BY score, window_b) AS r FROM mx
       WHERE window_a <> window_b)
SELECT mx.window_a, mx.window_b, {rnd('greatest(mx.score, a.score, b.score)', 'score')}
FROM mx JOIN co a ON a.window_a = mx.window_a AND a.r = 3 JOIN co b ON b.window_a = mx.window_b AND b.r = 3
WHERE mx.window_a < mx.window_b""")
def _reach(spark, sf):
    return rounded(recurrence.mutual_reachability(_full(spark, sf, 25)))


@query("cluster_windows")
def _cluster(spark, sf):
    return recurrence.cluster_windows(_full(spark, sf, 25))


def _labels(spark, sf):
    """A given label sequence: the most frequent class of every window of 10, outliers where it is class 9."""
    rows = vector_windows(spark, sf, 10)
    counts = rows.groupBy("window_id", "label").agg(F.count("*").alias("n"))
    top = counts.groupBy("window_id").agg(F.max(F.struct("n", "label")).alias("t"))
    return top.select("window_id", (F.col("t.label").cast("int") % 3 - F.when(F.col("t.label") == "9", 1).otherwise(0)).cast("int").alias("concept"))


LABELS = """lb AS (SELECT window_id, CAST(CAST(label AS INTEGER) % 3 - CASE WHEN label = '9' THEN 1 ELSE 0 END AS INTEGER) AS concept
  FROM (SELECT window_id, label, row_number() OVER (PARTITION BY window_id ORDER BY n DESC, label DESC) AS r
        FROM (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS window_id, CAST(label AS VARCHAR) AS label, count(*) AS n
              FROM embeddings GROUP BY 1, 2)) WHERE r = 1)"""


@query("fix_outlier_labels", f"""WITH RECURSIVE {LABELS}, nx AS (SELECT *, lead(concept) OVER (ORDER BY window_id) AS nxt FROM lb),
fx AS (SELECT window_id, concept FROM nx WHERE window_id = 0
       UNION ALL SELECT nx.window_id, CASE WHEN fx.concept = nx.nxt AND fx.concept <> -1 THEN fx.concept ELSE nx.concept END
       FROM fx JOIN nx ON nx.window_id = fx.window_id + 1)
SELECT window_id, concept FROM fx""")
def _fix(spark, sf):
    return recurrence.fix_outlier_labels(_labels(spark, sf))


DRIFTS = f"""{LABELS}, kn AS (SELECT *, lag(concept) OVER (ORDER BY window_id) AS last FROM lb WHERE concept <> -1),
dr AS (SELECT window_id, concept FROM kn WHERE last <> concept OR (last IS NULL AND window_id > 0))"""


@query("drift_from_labels", f"WITH {DRIFTS} SELECT * FROM dr")
def _drifts(spark, sf):
    return recurrence.drift_from_labels(_labels(spark, sf))


def _truth(spark, sf):
    return _labels(spark, sf).select("window_id", F.floor(F.col("window_id") / 7 % 3).cast("int").alias("true_concept"))


@query("concept_label_accuracy", f"""WITH {LABELS},
j AS (SELECT concept, CAST(floor(CAST(window_id AS DOUBLE) / 7 % 3) AS INTEGER) AS truth FROM lb),
cm AS (SELECT concept, truth, count(*) AS n FROM j WHERE concept <> -1 GROUP BY 1, 2),
pm AS (SELECT a.range AS t0, b.range AS t1, c.range AS t2 FROM range(3) a, range(3) b, range(3) c
       WHERE a.range <> b.range AND a.range <> c.range AND b.range <> c.range),
sc AS (SELECT t0, t1, t2, sum(CASE WHEN (concept = 0 AND truth = t0) OR (concept = 1 AND truth = t1) OR (concept = 2 AND truth = t2) THEN n ELSE 0 END) AS hit
       FROM cm, pm GROUP BY 1, 2, 3)
SELECT (SELECT count(*) FROM j) AS windows, (SELECT count(*) FROM j WHERE concept = -1) AS outliers,
       {rnd('max(hit) * 1.0 / (SELECT count(*) FROM j)', 'accuracy')} FROM sc""")
def _accuracy(spark, sf):
    return rounded(recurrence.concept_label_accuracy(_labels(spark, sf), _truth(spark, sf)))


SWEEP = f"""{displacement_sql(25)}, th AS (SELECT range AS k, CAST(range AS DOUBLE) * CAST(0.005 AS DOUBLE) AS t FROM range(200)),
tp AS (SELECT window_a, window_b, score, (window_a // 4) % 3 = (window_b // 4) % 3 AS same FROM mx WHERE window_b < window_a - 1),
cf AS (SELECT k, t, CAST(sum(CASE WHEN same AND score < t THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
              CAST(sum(CASE WHEN same AND NOT score < t THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
              CAST(sum(CASE WHEN NOT same AND score > t THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
              CAST(sum(CASE WHEN NOT same AND NOT score > t THEN 1 ELSE 0 END) AS DOUBLE) AS fp FROM tp, th GROUP BY 1, 2),
ra AS (SELECT t AS threshold, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
              CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
              CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr,
              CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END AS fnr FROM cf),
sw AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM ra)"""
SWEEP_COLS = ", ".join(rnd(c, c) for c in ("threshold", "accuracy", "precision", "recall", "fpr", "fnr", "f1"))


def _sweep(spark, sf):
    matrix = _full(spark, sf, 25)
    truth = vector_windows(spark, sf, 25).select("window_id").distinct().withColumn(
        "true_concept", F.floor(F.col("window_id") / 4) % 3
    )
    return recurrence.threshold_sweep(matrix, truth)


@query("threshold_sweep", f"WITH {SWEEP} SELECT {SWEEP_COLS} FROM sw")
def _threshold(spark, sf):
    return rounded(_sweep(spark, sf))


@query("best_threshold", f"WITH {SWEEP} SELECT {SWEEP_COLS} FROM sw ORDER BY f1 DESC, threshold LIMIT 1")
def _best(spark, sf):
    return rounded(recurrence.best_threshold(_sweep(spark, sf)))


@query("concept_segments", f"""WITH {LABELS},
fl AS (SELECT *, CASE WHEN lag(concept) OVER (ORDER BY window_id) IS DISTINCT FROM concept THEN 1 ELSE 0 END AS new FROM lb),
sg AS (SELECT *, CAST(sum(new) OVER (ORDER BY window_id) AS BIGINT) AS segment FROM fl)
SELECT segment, max(concept) AS concept, min(window_id) AS start, max(window_id) AS "end", count(*) AS width FROM sg GROUP BY 1""")
def _segments(spark, sf):
    return recurrence.concept_segments(_labels(spark, sf))


SUMMARY = f"""{BASE},
cl AS (SELECT window_id, label, count(*) AS n FROM tw GROUP BY 1, 2),
tt AS (SELECT window_id, sum(n) AS t FROM cl GROUP BY 1),
pw AS (SELECT window_id, count(*) AS p FROM pr GROUP BY 1)"""


@query("window_summary", f"""WITH {SUMMARY}
SELECT window_id, CAST(max(t) AS BIGINT) AS samples, max(p) AS prototypes, count(*) AS classes,
       {rnd('max(p) * 100.0 / max(t)', 'compression_pct')}, {rnd('sum(-(n / t) * log2(n / t))', 'class_entropy')},
       {rnd('max(n) * 1.0 / min(n)', 'imbalance')}
FROM cl JOIN tt USING (window_id) JOIN pw USING (window_id) GROUP BY 1""")
def _summary(spark, sf):
    _, protos, rows = _parts(spark, sf)
    return rounded(recurrence.window_summary(rows, protos))


GRID = f"""{SUMMARY}, al AS (SELECT DISTINCT label FROM cl),
pc AS (SELECT window_id, label, count(*) AS prototypes FROM pr GROUP BY 1, 2)"""


@query("class_share_over_time", f"""WITH {GRID}
SELECT window_id, al.label, coalesce(n, 0) AS n, {rnd('coalesce(n, 0) * 100.0 / t', 'share_pct')}
FROM tt CROSS JOIN al LEFT JOIN cl USING (window_id, label)""")
def _share(spark, sf):
    _, protos, rows = _parts(spark, sf, 100)
    return rounded(recurrence.class_grid(rows, protos).drop("prototypes"))


@query("prototype_count_over_time", f"""WITH {GRID}
SELECT window_id, al.label, coalesce(prototypes, 0) AS prototypes FROM tt CROSS JOIN al LEFT JOIN pc USING (window_id, label)""")
def _proto_counts(spark, sf):
    _, protos, rows = _parts(spark, sf, 100)
    return recurrence.class_grid(rows, protos).select("window_id", "label", "prototypes")


@query("stream_summary", f"""WITH {tree_windows_sql(10)}, {DRIFTS},
sz AS (SELECT window_id, count(*) AS n FROM tw GROUP BY 1), pw AS (SELECT window_id, count(*) AS p FROM pr GROUP BY 1)
SELECT count(*) AS windows, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(p) AS BIGINT) AS prototypes,
       {rnd('avg(p)', 'avg_prototypes')}, min(p) AS min_prototypes, max(p) AS max_prototypes,
       {rnd('stddev_pop(p)', 'std_prototypes')}, {rnd('sum(p) * 100.0 / sum(n)', 'compression_pct')},
       (SELECT count(DISTINCT concept) FROM lb WHERE concept <> -1) AS concepts,
       (SELECT count(*) FROM lb WHERE concept = -1) AS outliers, (SELECT count(*) FROM dr) AS drifts,
       (SELECT count(DISTINCT label) FROM tw) AS classes
FROM sz JOIN pw USING (window_id)""")
def _stream(spark, sf):
    rows = _rows(spark, sf, 10)
    return rounded(recurrence.stream_summary(rows, first_prototypes(rows), _labels(spark, sf)))


@query("closest_sample_breakdown", f"""WITH {BASE},
ds AS (SELECT t.window_id, t.idx, t.label AS true_label, p.label, p.proto_rank, p.proto_id, {l2_sql('t.features', 'p.features')} AS d
       FROM tw t JOIN pr p ON t.window_id = p.window_id),
bl AS (SELECT *, row_number() OVER (PARTITION BY window_id, idx ORDER BY d, proto_id) AS r FROM ds)
SELECT window_id, label, CAST(proto_rank AS INTEGER) AS proto_rank, true_label, count(*) AS n FROM bl WHERE r = 1 GROUP BY 1, 2, 3, 4""")
def _breakdown(spark, sf):
    _, protos, rows = _parts(spark, sf)
    return recurrence.closest_sample_breakdown(rows, protos)


@query("prototype_feature_stats", f"""WITH {BASE},
un AS (SELECT window_id, label, 'x' || generate_subscripts(features, 1) AS feature, unnest(features) AS v FROM pr)
SELECT window_id, label, feature, {rnd('avg(v)', 'mean')}, {rnd('stddev_pop(v)', 'std')}, {rnd('min(v)', 'min')},
       {rnd('max(v)', 'max')} FROM un GROUP BY 1, 2, 3""")
def _feature_stats(spark, sf):
    return rounded(recurrence.prototype_feature_stats(_parts(spark, sf)[1]))


@query("prototype_value_range", f"""WITH {BASE}, un AS (SELECT unnest(features) AS v FROM pr)
SELECT {rnd('min(v) - 0.05 * (max(v) - min(v))', 'low')}, {rnd('max(v) + 0.05 * (max(v) - min(v))', 'high')} FROM un""")
def _range(spark, sf):
    return rounded(recurrence.prototype_value_range(_parts(spark, sf)[1]))


@query("race_p", f"""WITH {displacement_sql(20)},
s AS (SELECT window_b AS window_id, score FROM sc WHERE window_a = window_b - 1),
r AS (SELECT avg(score) AS m, stddev_pop(score) AS sd FROM s WHERE window_id >= 10 AND window_id < 20)
SELECT window_id, {rnd('score', 'score')}, {rnd('m + 1.5 * sd', '"limit"')}, window_id >= 20 AND score > m + 1.5 * sd AS drift
FROM s, r""")
def _race(spark, sf):
    rows = _rows(spark, sf, 20)
    scores = windows.centroid_displacement(windows.consecutive_pairs(rows), first_prototypes(rows))
    return rounded(recurrence.race_p(scores, const=1.5))


@query("race_p_by_class", f"""WITH {displacement_sql(20)},
s AS (SELECT window_b AS window_id, label, coalesce(d, 10) AS score FROM cd WHERE window_a = window_b - 1),
r AS (SELECT label, avg(score) AS m, stddev_pop(score) AS sd FROM s WHERE window_id >= 10 AND window_id < 20 GROUP BY 1)
SELECT window_id, {rnd('max(score)', 'score')}, bool_or(coalesce(window_id >= 20 AND score > m + 3 * sd, false)) AS drift
FROM s LEFT JOIN r USING (label) GROUP BY 1""")
def _race_class(spark, sf):
    rows = _rows(spark, sf, 20)
    scores = windows.class_displacement(windows.consecutive_pairs(rows), first_prototypes(rows))
    return rounded(recurrence.race_p(scores))
