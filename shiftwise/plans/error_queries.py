"""E1-E19 on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.operators import errors
from shiftwise.operators.prep import fixed_windows
from shiftwise.plans.catalog import query, rnd, rounded
from shiftwise.plans.detector_sql import CHAIN_SQL, DETECTOR_SQL
from shiftwise.plans.inputs import ERROR_STREAMS, error_streams, event_sides


def _indexed(spark, sf):
    return errors.indexed_errors(error_streams(spark, sf), ["event_id"])


def _given_drifts(spark, sf):
    """Known drift positions: one per 700 rows of a stream."""
    return (
        _indexed(spark, sf).where("idx % 700 = 350")
        .select("stream", F.col("idx").alias("detected_at"), F.lit(120).cast("long").alias("history"))
    )


GIVEN = f"""{ERROR_STREAMS},
gd AS (SELECT stream, idx AS detected_at, CAST(120 AS BIGINT) AS history FROM es WHERE idx % 700 = 350)"""


@query("prequential_error", """
WITH w AS (SELECT event_id AS idx, event_type AS label, CAST(floor(event_id / 500) AS BIGINT) AS window_id, value,
                  CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k FROM events
           WHERE floor(event_id / 500) < floor((SELECT count(*) FROM events) / 500)),
m AS (SELECT window_id, label, count(*) AS n, avg(value) AS mv, var_pop(value) + 1e-9 AS vv, avg(k) AS mk,
             var_pop(k) + 1e-9 AS vk FROM w GROUP BY 1, 2),
s AS (SELECT w.window_id, w.idx, w.label, m.label AS predicted,
             row_number() OVER (PARTITION BY w.idx ORDER BY ln(n) - 0.5 * (ln(vv) + (value - mv) * (value - mv) / vv)
               - 0.5 * (ln(vk) + (k - mk) * (k - mk) / vk) DESC, m.label DESC) AS r
      FROM w JOIN m ON m.window_id + 1 = w.window_id)
SELECT window_id, idx, label, predicted, CAST(predicted <> label AS INTEGER) AS error FROM s WHERE r = 1
UNION ALL SELECT window_id, idx, label, NULL, 1 FROM w WHERE window_id = 0""")
def _prequential(spark, sf):
    rows = fixed_windows(event_sides(spark, sf), 500)
    return errors.prequential_error(rows, ["value", "k"])


@query("rolling_error_rate", f"""WITH {ERROR_STREAMS},
r AS (SELECT stream, idx, avg(error) OVER w AS rate, count(*) OVER w AS c FROM es
      WINDOW w AS (PARTITION BY stream ORDER BY idx ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING))
SELECT stream, idx, {rnd('rate', 'rate')} FROM r WHERE c = 100""")
def _rolling(spark, sf):
    return rounded(errors.rolling_error_rate(_indexed(spark, sf)))


@query("running_accuracy", f"""WITH {ERROR_STREAMS}
SELECT stream, idx, {rnd('1 - avg(error) OVER (PARTITION BY stream ORDER BY idx)', 'accuracy')} FROM es""")
def _running(spark, sf):
    return rounded(errors.running_accuracy(_indexed(spark, sf)))


def _register_detector(name: str, params: dict | None = None):
    @query(f"detector_{name}", DETECTOR_SQL.get(name))
    def _detect(spark, sf):
        return errors.detect_drifts(_indexed(spark, sf), name, params)


for _name, _params in (
    ("ddm", None), ("eddm", None), ("fhddm", {"confidence_level": 0.001}), ("hddm_a", None), ("hddm_w", None),
    ("adwin", None),
):
    _register_detector(_name, _params)


@query("warning_chain", CHAIN_SQL)
def _chain(spark, sf):
    return errors.detect_drifts(_indexed(spark, sf), "hddm_a", warning_grace=20)


SLICES = f"""{GIVEN},
bk AS (SELECT gd.stream, detected_at, history, es.idx - greatest(0, detected_at - 300) AS i, error,
              greatest(0, detected_at - 300) AS start_idx, detected_at - greatest(0, detected_at - 300) AS n
       FROM gd JOIN es ON es.stream = gd.stream AND es.idx < detected_at AND es.idx >= detected_at - 300),
ah AS (SELECT gd.stream, detected_at, es.idx - detected_at AS i, error FROM gd
       JOIN es ON es.stream = gd.stream AND es.idx >= detected_at AND es.idx < detected_at + 200)"""


def _located(spark, sf, lookback: str, lookforward: str):
    return errors.locate_drifts(_given_drifts(spark, sf), _indexed(spark, sf), lookback, lookforward)


@query("drift_start_cusum", f"""WITH RECURSIVE {SLICES},
ba AS (SELECT stream, detected_at, max(history) AS history, max(start_idx) AS start_idx, least(50, n // 4) AS base,
              avg(error) FILTER (i < least(50, n // 4)) AS mean
       FROM bk GROUP BY stream, detected_at, n),
cu AS (SELECT stream, detected_at, history, start_idx, base, mean, base - 1 AS i, CAST(0 AS DOUBLE) AS c FROM ba
       UNION ALL
       SELECT cu.stream, cu.detected_at, cu.history, cu.start_idx, base, mean, cu.i + 1,
              greatest(CAST(0 AS DOUBLE), c + (CAST(error AS DOUBLE) - mean - CAST(0.1 AS DOUBLE)))
       FROM cu JOIN bk ON bk.stream = cu.stream AND bk.detected_at = cu.detected_at AND bk.i = cu.i + 1),
fo AS (SELECT stream, detected_at, max(history) AS history, max(start_idx) AS start_idx, max(base) AS base,
              min(i) FILTER (c > 1.5) AS hit FROM cu GROUP BY 1, 2)
SELECT stream, detected_at, CAST(greatest(0, least(start_idx + coalesce(hit, base), detected_at - history)) AS BIGINT) AS drift_start,
       detected_at AS drift_end FROM fo""")
def _start_cusum(spark, sf):
    return _located(spark, sf, "cusum", "none")


@query("drift_start_threshold", f"""WITH {SLICES},
bl AS (SELECT stream, detected_at, max(history) AS history, max(start_idx) AS start_idx, max(n) AS n, least(100, max(n) - 50) AS base,
              avg(error) FILTER (i < least(100, n - 50)) AS level FROM bk GROUP BY stream, detected_at),
mv AS (SELECT stream, detected_at, i, avg(error) OVER w AS rate, count(*) OVER w AS len FROM bk
       WINDOW w AS (PARTITION BY stream, detected_at ORDER BY i ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)),
hg AS (SELECT stream, detected_at, i, CASE WHEN rate > level * 1.5 THEN 1 ELSE 0 END AS high
       FROM mv JOIN bl USING (stream, detected_at) WHERE i >= base AND len >= 10),
rn AS (SELECT stream, detected_at, i, sum(high) OVER w AS s FROM hg
       WINDOW w AS (PARTITION BY stream, detected_at ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
ft AS (SELECT stream, detected_at, min(i) AS hit FROM rn WHERE s = 20 GROUP BY 1, 2)
SELECT bl.stream, bl.detected_at,
       CAST(greatest(0, least(CASE WHEN bl.detected_at < 50 THEN 0 WHEN base <= 0 THEN start_idx
            ELSE start_idx + CASE WHEN hit IS NULL THEN base ELSE greatest(0, hit - 20) END END, bl.detected_at - history)) AS BIGINT) AS drift_start,
       bl.detected_at AS drift_end FROM bl LEFT JOIN ft USING (stream, detected_at)""")
def _start_threshold(spark, sf):
    return _located(spark, sf, "threshold", "none")


@query("drift_start_gradient", f"""WITH {SLICES},
gr AS (SELECT a.stream, a.detected_at, min(a.i) AS hit FROM bk a JOIN bk b USING (stream, detected_at)
       WHERE b.i = a.i + 20 AND a.i <= a.n - 22 AND (b.error - a.error) / 20.0 > 0.01 GROUP BY 1, 2)
SELECT gd.stream, gd.detected_at,
       CAST(greatest(0, least(greatest(0, gd.detected_at - 300) + coalesce(hit, 0), gd.detected_at - history)) AS BIGINT) AS drift_start,
       gd.detected_at AS drift_end
FROM gd LEFT JOIN gr USING (stream, detected_at)""")
def _start_gradient(spark, sf):
    return _located(spark, sf, "gradient", "none")


@query("drift_start_none", f"""WITH {GIVEN}
SELECT stream, detected_at, greatest(0, detected_at - history) AS drift_start, detected_at AS drift_end FROM gd""")
def _start_none(spark, sf):
    return _located(spark, sf, "none", "none")


@query("drift_end_peak", f"""WITH {SLICES},
pk AS (SELECT stream, detected_at, avg(error) FILTER (i < 100) AS r0, avg(error) FILTER (i >= 100) AS r1, count(*) AS n
       FROM ah GROUP BY 1, 2)
SELECT gd.stream, gd.detected_at, greatest(0, gd.detected_at - history) AS drift_start,
       gd.detected_at + CASE WHEN n = 200 AND r1 >= r0 THEN 100 ELSE 0 END AS drift_end
FROM gd JOIN pk USING (stream, detected_at)""")
def _end_peak(spark, sf):
    return _located(spark, sf, "none", "peak")


@query("drift_end_recovery", f"""WITH RECURSIVE {SLICES},
hi AS (SELECT stream, detected_at, avg(error) FILTER (i < 20) AS high, count(*) AS n FROM ah GROUP BY 1, 2),
cu AS (SELECT stream, detected_at, high, CAST(19 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS c FROM hi
       UNION ALL
       SELECT cu.stream, cu.detected_at, high, cu.i + 1,
              greatest(CAST(0 AS DOUBLE), c + (high - CAST(error AS DOUBLE) - CAST(0.1 AS DOUBLE)))
       FROM cu JOIN ah ON ah.stream = cu.stream AND ah.detected_at = cu.detected_at AND ah.i = cu.i + 1),
fo AS (SELECT stream, detected_at, min(i) FILTER (c > 1.5) AS hit FROM cu GROUP BY 1, 2)
SELECT gd.stream, gd.detected_at, greatest(0, gd.detected_at - history) AS drift_start,
       gd.detected_at + CASE WHEN hi.n < 20 THEN 0 ELSE coalesce(hit, hi.n - 1) END AS drift_end
FROM gd JOIN hi USING (stream, detected_at) LEFT JOIN fo USING (stream, detected_at)""")
def _end_recovery(spark, sf):
    return _located(spark, sf, "none", "recovery")


KNOWN = f"""{GIVEN},
kd AS (SELECT stream, detected_at, greatest(0, detected_at - history) AS drift_start, detected_at + 60 AS drift_end FROM gd)"""


def _known(spark, sf):
    return _given_drifts(spark, sf).select(
        "stream", "detected_at",
        F.greatest(F.lit(0), F.col("detected_at") - F.col("history")).alias("drift_start"),
        (F.col("detected_at") + 60).alias("drift_end"),
    )


def _rate(a: str, b: str) -> str:
    return (
        f"(SELECT avg(error) FROM es WHERE es.stream = kd.stream AND es.idx >= {a} AND es.idx < {b})"
    )


@query("describe_drifts", f"""WITH {KNOWN}
SELECT stream, detected_at, drift_start, drift_end, {rnd(_rate('drift_start - 50', 'drift_start + 50'), 'rate_at_start')},
       {rnd(_rate('detected_at - 100', 'detected_at'), 'rate_at_detection')},
       {rnd(_rate('drift_end - 50', 'drift_end + 50'), 'rate_at_end')}, drift_end - drift_start AS duration FROM kd""")
def _describe(spark, sf):
    return rounded(errors.describe_drifts(_known(spark, sf), _indexed(spark, sf)))


CORRECTED = f"""{KNOWN},
ro AS (SELECT stream, idx, rate FROM (
         SELECT stream, idx, avg(error) OVER w AS rate, count(*) OVER w AS c FROM es
         WINDOW w AS (PARTITION BY stream ORDER BY idx ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)) WHERE c = 100),
la AS (SELECT stream, max(idx) AS last FROM ro GROUP BY 1),
he AS (SELECT kd.stream, detected_at, greatest(0, least(drift_start, last)) AS s, greatest(0, least(drift_end, last)) AS e
       FROM kd JOIN la USING (stream)),
pe AS (SELECT he.stream, detected_at, s, e, idx, rate,
              row_number() OVER (PARTITION BY he.stream, detected_at ORDER BY rate DESC, idx) AS r
       FROM he JOIN ro ON ro.stream = he.stream AND idx BETWEEN s AND e),
co AS (SELECT pe.stream, detected_at, s + 100 AS start, pe.idx + 100 AS "end", pe.idx - s AS duration,
              r0.rate AS start_error_rate, pe.rate AS end_error_rate, pe.rate - r0.rate AS error_rate_increase
       FROM pe JOIN ro r0 ON r0.stream = pe.stream AND r0.idx = s WHERE r = 1)"""


@query("correct_drift_end", f"""WITH {CORRECTED}
SELECT stream, detected_at, start, "end", duration, {rnd('start_error_rate', 'start_error_rate')},
       {rnd('end_error_rate', 'end_error_rate')}, {rnd('error_rate_increase', 'error_rate_increase')} FROM co""")
def _correct(spark, sf):
    return rounded(errors.correct_drift_end(_known(spark, sf), _indexed(spark, sf)))


@query("drift_summary", f"""WITH {CORRECTED},
ba AS (SELECT stream, count(*) AS rows, 1 - avg(error) AS accuracy FROM es GROUP BY 1),
fo AS (SELECT stream, count(*) AS drifts, avg(duration) AS ad, min(duration) AS nd, max(duration) AS xd,
              avg(error_rate_increase) AS ac,
              avg(CASE WHEN start_error_rate > 0 THEN error_rate_increase / start_error_rate * 100 ELSE 0 END) AS ap
       FROM co GROUP BY 1)
SELECT stream, rows, {rnd('accuracy', 'accuracy')}, coalesce(drifts, 0) AS drifts, {rnd('ad', 'avg_duration')},
       nd AS min_duration, xd AS max_duration, {rnd('ac', 'avg_rate_change')}, {rnd('ap', 'avg_change_pct')}
FROM ba LEFT JOIN fo USING (stream)""")
def _summary(spark, sf):
    indexed = _indexed(spark, sf)
    return rounded(errors.drift_summary(errors.correct_drift_end(_known(spark, sf), indexed), indexed))
