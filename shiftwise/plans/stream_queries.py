"""W1-W5 on the given tables, each stream run until its input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.operators import recurrence, windows
from shiftwise.plans.catalog import query, rnd, rounded
from shiftwise.plans.detector_sql import DETECTOR_SQL
from shiftwise.plans.inputs import ERROR_FLAG, error_flag, first_prototypes
from shiftwise.plans.window_queries import displacement_sql
from shiftwise.streaming import streams

RACE_SIZE = 20  # rows a window


def _events(spark, sf):
    raw = streams.read_events(spark, sf, "events.parquet")
    return raw.select(
        (F.col("user_id") % 5).alias("stream"), "event_id", "ts", F.col("event_type").alias("label"), "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        error_flag(F.col("event_type"), F.col("event_id")).alias("error"),
    )


@query("stream_error_drift", DETECTOR_SQL["eddm"])
def _error_drift(spark, sf):
    return streams.run_to_table(streams.stream_error_drift(_events(spark, sf), "event_id", "eddm"), "error-drift")


@query("stream_prequential_error")
def _prequential(spark, sf):
    found = streams.stream_prequential_error(_events(spark, sf), "event_id", ["value", "k"])
    return streams.run_to_table(found, "prequential")


def _plain(df):
    """Window ends as plain timestamps, for engines without time zones."""
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn(
        "window_end", F.col("window_end").cast("timestamp_ntz")
    )


PROFILE = """p AS (
  SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type AS label,
         count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median
  FROM events GROUP BY 1, 2, 3),
c AS (SELECT * FROM p WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)"""


@query("stream_window_profile", f"""WITH {PROFILE}
SELECT window_start, window_end, label, n, {rnd('mean', 'mean')}, {rnd('std', 'std')}, {rnd('min', 'min')}, {rnd('max', 'max')},
       {rnd('median', 'median')}
FROM c""")
def _profile(spark, sf):
    table = streams.run_to_table(streams.stream_window_profile(_events(spark, sf)), "profile")
    return rounded(_plain(table))


@query("stream_window_drift", f"""WITH {PROFILE},
ref AS (SELECT event_type AS label, avg(value) AS rm, stddev_samp(value) AS rs, min(value) AS rn, max(value) AS rx, count(value) AS rc,
               (max(value) - min(value)) / 30 AS step FROM events WHERE ts < TIMESTAMP '2024-01-08 00:00:00' GROUP BY 1),
g AS (SELECT date_trunc('day', ts) AS window_start, ts < TIMESTAMP '2024-01-08 00:00:00' AS calm, event_type AS label, value, rn, rx, step,
             least(floor((value - rn) / step), 29) AS g FROM events JOIN ref ON label = event_type WHERE value >= rn AND value <= rx),
h AS (SELECT *, CASE WHEN value < g * step + rn THEN g - 1 WHEN value >= (g + 1) * step + rn AND g < 29 THEN g + 1 ELSE g END AS bin FROM g),
rc AS (SELECT label, bin, count(*) AS n FROM h WHERE calm GROUP BY 1, 2),
wc AS (SELECT window_start, label, bin, count(*) AS n FROM h GROUP BY 1, 2, 3),
rt AS (SELECT label, sum(n) AS t FROM rc GROUP BY 1), wt AS (SELECT window_start, label, sum(n) AS t FROM wc GROUP BY 1, 2),
de AS (SELECT wt.window_start, wt.label, coalesce(rc.n, 0) / (rt.t * step) + 1e-10 AS p, coalesce(wc.n, 0) / (wt.t * step) + 1e-10 AS q, b.range AS bin,
              coalesce(rc.n, 0) / rt.t AS rp, coalesce(wc.n, 0) / wt.t AS wp
       FROM wt JOIN rt USING (label) JOIN ref USING (label) CROSS JOIN range(30) b
       LEFT JOIN rc ON rc.label = wt.label AND rc.bin = b.range
       LEFT JOIN wc ON wc.label = wt.label AND wc.window_start = wt.window_start AND wc.bin = b.range),
pq AS (SELECT window_start, label, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM de WINDOW w AS (PARTITION BY window_start, label)),
dv AS (SELECT window_start, label, sum(p * ln(p / q)) AS kl, sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2 AS js FROM pq GROUP BY 1, 2),
cu AS (SELECT window_start, label, abs(sum(rp - wp) OVER (PARTITION BY window_start, label ORDER BY bin)) AS gap FROM de),
ws AS (SELECT window_start, label, sum(gap) / 30 AS w FROM cu GROUP BY 1, 2),
o AS (SELECT window_start, window_end, label, n, (mean - rm) / abs(rm + 1e-10) AS ms, (std - rs) / abs(rs + 1e-10) AS ss,
             (min - rn) / abs(rn + 1e-10) AS ns, (max - rx) / abs(rx + 1e-10) AS xs, kl, js, w, rc / (SELECT sum(rc) FROM ref) AS rsh, n / sum(n) OVER (PARTITION BY window_start) AS sh
      FROM c JOIN ref USING (label) JOIN dv USING (window_start, label) JOIN ws USING (window_start, label)),
i AS (SELECT *, (sh - rsh) / abs(rsh + 1e-10) AS ish FROM o),
f AS (SELECT *, (CAST(max(ms > 0.2) OVER v AS INT) + CAST(max(ss > 0.2) OVER v AS INT) + CAST(max(ns > 0.2) OVER v AS INT)
             + CAST(max(xs > 0.2) OVER v AS INT) + CAST(max(ish > 0.2) OVER v AS INT)) / 5.0 AS share
      FROM i WINDOW v AS (PARTITION BY window_start))
SELECT window_start, window_end, label, n, {rnd('ms', 'mean_shift')}, {rnd('ss', 'std_shift')}, {rnd('ns', 'min_shift')}, {rnd('xs', 'max_shift')},
       {rnd('kl', 'kl')}, {rnd('js', 'js')}, {rnd('w', 'wasserstein')}, {rnd('ish', 'ratio_shift')}, ish > 0.2 AS imbalance_drift, w > 0.1 AS wasserstein_drift,
       {rnd('share', 'drifted_share')}, share > 0.4 AS drift, ms > 0.2 OR ss > 0.2 OR ns > 0.2 OR xs > 0.2 AS stat_drift,
       kl > 0.1 AS kl_drift, js > 0.05 AS js_drift FROM f""")
def _drift(spark, sf):
    calm = spark.read.parquet(f"{sf}/events.parquet").where("ts < timestamp_ntz'2024-01-08 00:00:00'")
    reference = streams.frozen_reference(calm.select(F.col("event_type").alias("label"), "value"))
    table = streams.run_to_table(streams.stream_window_drift(_events(spark, sf), reference), "window-drift")
    return rounded(_plain(streams.window_decisions(table, reference)))


@query("stream_rolling_error", f"""
WITH s AS (SELECT user_id % 5 AS stream, ts, {ERROR_FLAG} AS error,
                  date_trunc('hour', ts) - INTERVAL (k.range) HOUR AS window_start FROM events, range(6) k),
a AS (SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, stream, count(*) AS n, avg(error) AS rate FROM s GROUP BY 1, 2, 3)
SELECT window_start, window_end, stream, n, {rnd('rate', 'rate')} FROM a
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _rolling(spark, sf):
    return rounded(_plain(streams.run_to_table(streams.stream_rolling_error(_events(spark, sf)), "rolling")))


@query("stream_race_p", f"""WITH {displacement_sql(RACE_SIZE)},
s AS (SELECT window_b AS window_id, score FROM sc WHERE window_a = window_b - 1),
r AS (SELECT avg(score) AS m, stddev_pop(score) AS sd FROM s WHERE window_id >= 10 AND window_id < 20)
SELECT window_id, {rnd('score', 'score')}, {rnd('m + 1.5 * sd', '"limit"')}, window_id >= 20 AND score > m + 1.5 * sd AS drift FROM s, r""")
def _race(spark, sf):
    raw = streams.read_events(spark, sf, "embeddings.parquet")
    rows = raw.select(
        F.floor(F.col("vec_id") / RACE_SIZE).alias("window_id"), F.col("vec_id").alias("idx"),
        F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("features"),
    )

    def score(protos):
        return windows.centroid_displacement(windows.consecutive_pairs(protos), protos)

    race = streams.RaceStream(spark, first_prototypes, score)
    return rounded(recurrence.race_p(race.run(rows), grace=20, const=1.5))
