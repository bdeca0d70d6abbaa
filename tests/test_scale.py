import os

import pytest
from pyspark.sql import functions as F

from shiftwise.operators import importance as I
from shiftwise.operators import ordered
from shiftwise.operators import windows as W
from shiftwise.streaming import streams as S


@pytest.mark.parametrize("n", [1, 7, 90, 1001])
def test_compiled_shuffle_is_the_expression(spark, n):
    df = spark.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(5))).alias("r"))
    both = I.with_shuffled(df, "id", "r", n, 42, "fast").withColumn("slow", I.shuffled(F.col("id"), F.col("r"), n, 42)).collect()
    assert all(r.fast == r.slow for r in both)
    assert sorted(r.fast for r in both if r.r == 5) == list(range(n))


def test_a_stream_reads_a_file_or_a_folder(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/folder.parquet")
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/one")
    (part,) = [f for f in os.listdir(f"{tmp_path}/one") if f.endswith(".parquet")]
    os.link(f"{tmp_path}/one/{part}", f"{tmp_path}/file.parquet")
    for name, n in (("folder.parquet", 30), ("file.parquet", 5)):
        stream = S.read_events(spark, str(tmp_path), name)
        assert S.run_to_table(stream, "t").count() == n


def test_slices_of_one_task_are_small():
    """Slices of two million rows came to 604 MB of one task on 6 million rows."""
    assert ordered.ROWS_PER_SLICE <= 250_000


def test_vectors_travel_once_per_block(spark, table):
    """Vectors were joined to every pair: 300 windows made 44,850 pairs of two lists each."""
    rows = table("window_id long, idx long, label string, features array<double>", [(i, i, "a", [float(i)] * 16) for i in range(300)])
    pairs = W.window_pairs(rows)
    protos = rows.withColumn("proto_rank", F.lit(0))
    for made in (W.centroid_displacement(pairs, protos), W.class_minimal_distances(pairs, protos), W.assignment_pairs(pairs, protos, rows)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroups" in plan and made.count() == 300 * 299 // 2
    assert W.centroid_displacement(pairs, protos).where(F.abs(F.col("score") - 4 * (F.col("window_b") - F.col("window_a"))) > 1e-9).count() == 0


def test_learner_takes_odd_rows():
    learner = S.OnlineLogistic(2)
    assert learner.weights == []  # plain floats, no arrays
    rows = [([1.0, 2.0], "a"), ([1.5, -2.0], "b"), ([1.7e308, 0.0], "a"), ([0.0, 0.0], "c")] * 3
    assert [learner.test_then_train(x, y) for x, y in rows][:2] == [1, 1] and learner.classes == ["a", "b", "c"]
