"""D1-D16 on the given tables."""

from __future__ import annotations

from shiftwise.operators import profile
from shiftwise.plans.catalog import query, rnd, rounded
from shiftwise.plans.inputs import (
    EVENT_FEATURES, EVENT_SIDES, LINE_FEATURES, LINE_SIDES, event_sides, line_sides
)

CLASS_STATS = f"""{LINE_SIDES},
st AS (SELECT side, label, feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std,
              min(value) AS min, max(value) AS max, median(value) AS median
       FROM long GROUP BY side, label, feature)"""

SHIFTS = f"""{CLASS_STATS},
sl AS (SELECT side, label, feature, 'mean' AS stat, mean AS value FROM st
       UNION ALL SELECT side, label, feature, 'std', std FROM st
       UNION ALL SELECT side, label, feature, 'min', min FROM st
       UNION ALL SELECT side, label, feature, 'max', max FROM st
       UNION ALL SELECT side, label, feature, 'median', median FROM st),
pair AS (SELECT coalesce(o.label, n.label) AS label, coalesce(o.feature, n.feature) AS feature,
                coalesce(o.stat, n.stat) AS stat, coalesce(o.value, 0) AS old, coalesce(n.value, 0) AS new
         FROM (SELECT * FROM sl WHERE side = 'before') o
         FULL OUTER JOIN (SELECT * FROM sl WHERE side = 'after') n
           ON o.label = n.label AND o.feature = n.feature AND o.stat = n.stat),
share AS (SELECT label, sum(CASE WHEN side = 'before' THEN 1.0 ELSE 0 END) / (SELECT count(*) FROM li WHERE side = 'before') AS old,
                 sum(CASE WHEN side = 'after' THEN 1.0 ELSE 0 END) / (SELECT count(*) FROM li WHERE side = 'after') AS new
          FROM li GROUP BY label),
alls AS (SELECT *, (new - old) / abs(old + 1e-10) AS shift FROM pair
         UNION ALL
         SELECT label, '__class_ratio__', 'imbalance_ratio', old, new, (new - old) / abs(old + 1e-10) FROM share)"""


@query("class_stats", f"""WITH {CLASS_STATS}
SELECT side, label, feature, n, {rnd('mean', 'mean', 4)}, {rnd('std', 'std', 4)}, {rnd('min', 'min', 4)},
       {rnd('max', 'max', 4)}, {rnd('median', 'median', 4)} FROM st""")
def _class_stats(spark, sf):
    return rounded(profile.class_stats(line_sides(spark, sf), LINE_FEATURES), 4)


@query("stat_shift", f"""WITH {SHIFTS}
SELECT label, feature, stat, {rnd('old', 'old', 4)}, {rnd('new', 'new', 4)}, {rnd('shift', 'shift', 4)}
FROM alls WHERE stat <> 'imbalance_ratio'""")
def _stat_shift(spark, sf):
    stats = profile.class_stats(line_sides(spark, sf), LINE_FEATURES)
    return rounded(profile.stat_shift(stats), 4)


@query("stat_drift", f"""WITH {SHIFTS}
SELECT label, feature, stat, shift > 0.002 AS drift, abs(shift) > 0.002 AS drift_two_sided
FROM alls WHERE stat <> 'imbalance_ratio'""")
def _stat_drift(spark, sf):
    shifts = profile.stat_shift(profile.class_stats(line_sides(spark, sf), LINE_FEATURES))
    one = profile.stat_drift(shifts, 0.002)
    return profile.stat_drift(one.withColumnRenamed("drift", "one"), 0.002, two_sided=True).selectExpr(
        "label", "feature", "stat", "one AS drift", "drift AS drift_two_sided"
    )


@query("imbalance_shift", f"""WITH {SHIFTS}
SELECT label, feature, stat, {rnd('old', 'old')}, {rnd('new', 'new')}, {rnd('shift', 'shift')}, shift > 0.2 AS drift
FROM alls WHERE stat = 'imbalance_ratio'""")
def _imbalance(spark, sf):
    return rounded(profile.imbalance_shift(line_sides(spark, sf)))


@query("desc_decision", f"""WITH {SHIFTS}, f AS (SELECT stat, bool_or(shift > 0.002) AS drift FROM alls GROUP BY stat)
SELECT count(*) AS statistics, {rnd('avg(CASE WHEN drift THEN 1.0 ELSE 0.0 END)', 'drifted_share')},
       avg(CASE WHEN drift THEN 1.0 ELSE 0.0 END) > 0.4 AS drift FROM f""")
def _decision(spark, sf):
    return rounded(profile.desc_decision(profile.drift_table(line_sides(spark, sf), LINE_FEATURES, thr=0.002)))


@query("stats_before_after", f"""WITH {CLASS_STATS}
SELECT label, feature, {', '.join(
    rnd(f"max(CASE WHEN side = '{s}' THEN {c} END)", f"{o}_{c}", 4)
    for o, s in (('old', 'before'), ('new', 'after')) for c in ('median', 'mean', 'std'))}
FROM st GROUP BY label, feature""")
def _stats_ba(spark, sf):
    return rounded(profile.stats_before_after(line_sides(spark, sf), LINE_FEATURES), 4)


@query("pct_change_table", f"""WITH {SHIFTS}
SELECT label, feature, stat, {rnd('old', 'before', 4)}, {rnd('new', 'after', 4)},
       {rnd('(new - old) / old * 100', 'change_pct', 4)}
FROM pair WHERE stat IN ('median', 'mean', 'std')""")
def _pct(spark, sf):
    return rounded(profile.pct_change_table(line_sides(spark, sf), LINE_FEATURES), 4)


@query("class_balance", f"""WITH {LINE_SIDES}
SELECT side, label, count(*) AS n, {rnd('count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY side)', 'share')}
FROM li GROUP BY side, label""")
def _balance(spark, sf):
    return rounded(profile.class_balance(line_sides(spark, sf)))


@query("box_summary", f"""WITH {LINE_SIDES},
q AS (SELECT side, label, feature, count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS median,
             quantile_cont(value, 0.75) AS q3, avg(value) AS mean FROM long GROUP BY side, label, feature),
w AS (SELECT l.side, l.label, l.feature,
             min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END) AS lo,
             max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END) AS hi,
             sum(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS out
      FROM long l JOIN q ON l.side = q.side AND l.label = q.label AND l.feature = q.feature GROUP BY 1, 2, 3)
SELECT q.side, q.label, q.feature, n, {rnd('q1', 'q1', 4)}, {rnd('median', 'median', 4)}, {rnd('q3', 'q3', 4)},
       {rnd('mean', 'mean', 4)}, {rnd('least(lo, q1)', 'whisker_low', 4)},
       {rnd('greatest(hi, q3)', 'whisker_high', 4)}, CAST(out AS BIGINT) AS outliers
FROM q JOIN w ON w.side = q.side AND w.label = q.label AND w.feature = q.feature""")
def _box(spark, sf):
    return rounded(profile.box_summary(line_sides(spark, sf), LINE_FEATURES), 4)


def _histogram_sql(group: str, edge: str) -> str:
    return f"""WITH {LINE_SIDES},
e AS (SELECT {edge}, min(value) AS lo, max(value) AS hi FROM long GROUP BY {edge}),
guess AS (SELECT l.*, e.lo, e.hi, (e.hi - e.lo) / 30 AS step,
                 least(floor((value - e.lo) / ((e.hi - e.lo) / 30)), 29) AS g
          FROM long l JOIN e USING ({edge})),
hit AS (SELECT *, CASE WHEN value < g * step + lo THEN g - 1
                       WHEN value >= (g + 1) * step + lo AND g < 29 THEN g + 1 ELSE g END AS bin FROM guess),
c AS (SELECT {group}, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM hit GROUP BY {group}, bin),
grid AS (SELECT DISTINCT {group}, lo, hi, step, CAST(b.range AS INTEGER) AS bin FROM guess, range(30) b)
SELECT {group}, bin, {rnd('bin * step + lo', 'bin_left', 4)}, {rnd('(bin + 1) * step + lo', 'bin_right', 4)},
       coalesce(n, 0) AS n FROM grid LEFT JOIN c USING ({group}, bin)"""


@query("histogram_before_after", _histogram_sql("side, feature", "feature"))
def _hist(spark, sf):
    return rounded(profile.histogram_before_after(line_sides(spark, sf), LINE_FEATURES), 4)


@query("class_histogram", _histogram_sql("side, label, feature", "side, label, feature"))
def _class_hist(spark, sf):
    return rounded(profile.class_histogram(line_sides(spark, sf), LINE_FEATURES), 4)


@query("violin_summary", f"""WITH {LINE_SIDES}
SELECT side, label, feature, {rnd('min(value)', 'min', 4)}, {rnd('max(value)', 'max', 4)},
       {rnd('avg(value)', 'mean', 4)}, {rnd('quantile_cont(value, 0.25)', 'q1', 4)},
       {rnd('median(value)', 'median', 4)}, {rnd('quantile_cont(value, 0.75)', 'q3', 4)}
FROM long GROUP BY side, label, feature""")
def _violin(spark, sf):
    return rounded(profile.violin_summary(line_sides(spark, sf), LINE_FEATURES), 4)


@query("ecdf", f"""WITH {EVENT_SIDES}, d AS (SELECT side, feature, value, count(*) AS n FROM long GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY side, feature ORDER BY value) AS BIGINT) AS k,
             sum(n) OVER (PARTITION BY side, feature) AS t FROM d)
SELECT side, feature, value, n, k, {rnd('k * 1.0 / t', 'share')} FROM r""")
def _ecdf(spark, sf):
    return rounded(profile.ecdf(event_sides(spark, sf), EVENT_FEATURES), only=["share"])


def _poly(x: str, coeffs: list[float]) -> str:
    out = f"CAST({coeffs[0]!r} AS DOUBLE)"
    for c in coeffs[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def _tail(q: str) -> str:
    t = f"sqrt(-2 * ln({q}))"
    return f"{_poly(t, profile.TAIL_TOP)} / ({_poly(t, profile.TAIL_BOTTOM)} * {t} + 1)"


def _qq_sql(sides: str) -> str:
    r = "((p - 0.5) * (p - 0.5))"
    centre = f"{_poly(r, profile.CENTRE_TOP)} * (p - 0.5) / ({_poly(r, profile.CENTRE_BOTTOM)} * {r} + 1)"
    return f"""{sides},
pl AS (SELECT side, feature, value, row_number() OVER (PARTITION BY side, feature ORDER BY value) AS place,
              CAST(count(*) OVER (PARTITION BY side, feature) AS DOUBLE) AS t FROM long),
fm AS (SELECT side, feature, value, place, CASE WHEN place = t THEN pow(0.5, 1 / t) WHEN place = 1 THEN 1 - pow(0.5, 1 / t)
              ELSE (place - 0.3175) / (t + 0.365) END AS p FROM pl),
qn AS (SELECT side, feature, value, place, CASE WHEN p < 0.02425 THEN {_tail('p')} WHEN p > 1 - 0.02425 THEN -({_tail('(1 - p)')})
              ELSE {centre} END AS theoretical FROM fm)"""


@query("qq_normal", f"""WITH {_qq_sql(EVENT_SIDES)}
SELECT side, feature, place, {rnd('value', 'value', 5)}, {rnd('theoretical', 'theoretical', 5)} FROM qn""")
def _qq(spark, sf):
    return rounded(profile.qq_normal(event_sides(spark, sf), EVENT_FEATURES), 5)


@query("qq_line", f"""WITH {_qq_sql(LINE_SIDES)}
SELECT side, feature, {rnd('regr_slope(value, theoretical)', 'slope', 4)}, {rnd('regr_intercept(value, theoretical)', 'intercept', 4)},
       {rnd('corr(value, theoretical)', 'r', 4)} FROM qn GROUP BY 1, 2""")
def _qq_line(spark, sf):
    return rounded(profile.qq_line(profile.qq_normal(line_sides(spark, sf), LINE_FEATURES)), 4)


@query("kde", f"""WITH {LINE_SIDES},
d AS (SELECT side, feature, value, count(*) AS n FROM long GROUP BY 1, 2, 3),
p AS (SELECT side, feature, count(*) AS t, stddev_samp(value) * pow(count(*), -0.2) AS h FROM long GROUP BY 1, 2),
e AS (SELECT feature, min(value) AS lo, (max(value) - min(value)) / 999 AS step FROM long GROUP BY 1)
SELECT d.side, d.feature, CAST(g.range AS INTEGER) AS point, {rnd('max(lo + g.range * step)', 'x')},
       {rnd('sum(n * exp(-0.5 * pow((lo + g.range * step - value) / h, 2))) / (max(t) * max(h) * sqrt(2 * pi()))', 'density')}
FROM d JOIN p USING (side, feature) JOIN e USING (feature), range(1000) g GROUP BY d.side, d.feature, g.range""")
def _kde(spark, sf):
    return rounded(profile.kde(line_sides(spark, sf), LINE_FEATURES))
