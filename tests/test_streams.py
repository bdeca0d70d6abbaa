import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftwise.operators import errors
from shiftwise.operators import recurrence as R
from shiftwise.operators import windows as W
from shiftwise.plans.inputs import first_prototypes
from shiftwise.streaming import streams as S


def write_parts(df, folder, parts, order):
    """Files in time order, one micro-batch each."""
    rows = df.count()
    for p in range(parts):
        part = df.where((F.col(order) >= rows * p // parts) & (F.col(order) < rows * (p + 1) // parts))
        target = os.path.join(folder, "in")
        part.coalesce(1).write.mode("append").parquet(target)


def as_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in")


@pytest.fixture()
def error_rows(table):
    rng = np.random.default_rng(0)
    xs = np.concatenate([rng.random(1200) < 0.05, rng.random(800) < 0.6]).astype(int)
    return table("k long, stream long, error int", [(i, i % 2, int(x)) for i, x in enumerate(xs)])


@pytest.mark.parametrize("detector", ["ddm", "eddm", "adwin"])
def test_streamed_detection_equals_batch(spark, error_rows, tmp_path, detector):
    write_parts(error_rows, str(tmp_path), 3, "k")
    stream = as_stream(spark, str(tmp_path), error_rows.schema)
    got = S.run_to_table(S.stream_error_drift(stream, "k", detector), "t").collect()
    batch = errors.detect_drifts(errors.indexed_errors(error_rows, ["k"]), detector).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and got


def test_online_learner_carries_over_batches(spark, table, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        label = "ab"[int(rng.random() < 0.5)]
        rows.append((i, i % 2, label, float(rng.normal(2 if label == "a" else -2))))
    df = table("k long, stream long, label string, x double", rows)
    write_parts(df, str(tmp_path), 3, "k")
    got = S.run_to_table(S.stream_prequential_error(as_stream(spark, str(tmp_path), df.schema), "k", ["x"]), "t").orderBy("k").collect()
    assert len(got) == 600 and [r.error for r in got[:2]] == [1, 1]
    want = {0: S.OnlineLogistic(1), 1: S.OnlineLogistic(1)}
    assert [r.error for r in got] == [want[s].test_then_train(np.array([x]), y) for _, s, y, x in rows]
    assert np.mean([r.error for r in got[300:]]) < 0.06


def test_rows_behind_the_watermark_are_dropped(spark, table, tmp_path):
    """Windows close by event time; a row that comes two batches after its window closed no longer counts."""
    schema = "k long, label string, value double, ts timestamp"
    at = lambda h: f"2024-01-01 {h:02d}:30:00"
    df = table("k long, label string, value double, h string", [
        (0, "a", 1.0, at(0)), (1, "a", 3.0, at(1)), (2, "a", 5.0, at(9)), (3, "a", 6.0, at(9)),
        (4, "a", 7.0, at(10)), (5, "a", 9.0, at(20)), (6, "a", 100.0, at(0)), (7, "a", 9.0, at(20)),
    ]).select("k", "label", "value", F.col("h").cast("timestamp").alias("ts"))
    write_parts(df, str(tmp_path), 4, "k")
    got = S.run_to_table(S.stream_window_profile(as_stream(spark, str(tmp_path), schema), length="4 hours"), "t")
    rows = {r.window_start.hour: (r.n, r.mean, r.median) for r in got.collect()}
    assert rows == {0: (2, 2.0, 2.0), 8: (3, 6.0, 6.0)}


def test_window_drift_flags_the_changed_label(spark, table, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(4000):
        label = "ab"[i % 2]
        up = 3.0 if (label == "a" and i >= 2000) else 0.0
        rows.append((i, label, float(10 + up + rng.normal()), 1704067200 + i * 60))
    df = table("k long, label string, value double, s long", rows).select("k", "label", "value", F.timestamp_seconds("s").alias("ts"))
    write_parts(df, str(tmp_path), 2, "k")
    ref = S.frozen_reference(df.where("k < 2000"))
    got = S.run_to_table(S.stream_window_drift(as_stream(spark, str(tmp_path), df.schema), ref, length="10 hours"), "t").collect()
    late = [r for r in got if r.window_start >= datetime.datetime(2024, 1, 2, 12)]
    assert late and all(r.stat_drift == (r.label == "a") and r.js_drift == (r.label == "a") for r in late)
    assert not any(r.stat_drift for r in got if r.window_start.day == 1)


def test_race_stream_equals_batch(spark, table, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        w = i // 20
        off = 6.0 if w >= 12 else 0.0
        rows.append((w, i, "ab"[i % 2], [float(rng.normal() + off), float(i % 2)]))
    df = table("window_id long, idx long, label string, features array<double>", rows)
    # batches that cut windows in the middle
    write_parts(df.withColumnRenamed("idx", "k"), str(tmp_path), 4, "k")
    stream = as_stream(spark, str(tmp_path), df.withColumnRenamed("idx", "k").schema).withColumnRenamed("k", "idx")

    def score(protos):
        return W.centroid_displacement(W.consecutive_pairs(protos), protos)

    got = R.race_p(S.RaceStream(spark, first_prototypes, score).run(stream), grace=10)
    want = R.race_p(score(first_prototypes(df)), grace=10)
    key = lambda d: sorted((r.window_id, round(r.score, 9), r.drift) for r in d.collect())
    assert key(got) == key(want) and 12 in [w for w, _, d in key(got) if d]


def test_rows_in_any_order_give_the_batch_race(spark, table, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i // 20, i, "ab"[i % 2], [float(rng.normal() + 6 * (i >= 240)), float(i % 2)], int(rng.integers(0, 1000))) for i in range(300)]
    df = table("window_id long, idx long, label string, features array<double>, k long", rows)
    write_parts(df, str(tmp_path), 3, "k")  # windows are spread over all three batches
    stream = as_stream(spark, str(tmp_path), df.schema).drop("k")

    def score(protos):
        return W.centroid_displacement(W.consecutive_pairs(protos), protos)

    got = S.RaceStream(spark, first_prototypes, score).run(stream)
    want = score(first_prototypes(df.drop("k")))
    key = lambda d: sorted((r.window_a, r.window_b, round(r.score, 9)) for r in d.collect())
    assert key(got) == key(want) and len(key(got)) == 14
