"""Slicing a large group must not change any result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftwise.operators import ordered
from shiftwise.operators.frames import moving


@pytest.fixture()
def rows(table):
    rng = np.random.default_rng(1)
    # one hot group with many ties, two small ones
    data = [("hot", int(i), float(rng.integers(0, 40))) for i in range(3000)]
    data += [("small", i, float(i)) for i in range(7)] + [("one", 0, 5.0)]
    return table("g string, k long, value double", data).repartition(7)


def test_hot_group_is_cut(rows):
    points = ordered.cut_points(rows, ["g"], ["k"], rows_per_slice=200)
    found = {r.g: len(r._cuts) for r in points.collect()}
    assert found["hot"] > 5 and sum(found.values()) < found["hot"] + 5
    sizes = ordered.with_slices(rows, points, ["g"], ["k"]).groupBy("g", "_slice").count().collect()
    assert max(r["count"] for r in sizes) < 1400
    assert ordered.cut_points(rows, ["g"], ["k"]).collect() == []


def test_slices_are_bounded(rows, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_SLICES", 8)
    points = ordered.cut_points(rows, ["g"], ["k"], rows_per_slice=20)
    assert max(len(r._cuts) for r in points.collect()) <= 8
    test_prefix_sums(rows, 20)


def test_nothing_runs_while_a_plan_is_built(rows, spark):
    spark.sparkContext.setJobGroup("building", "plans only")
    ordered.index_rows(rows, ["g", "k"])
    ordered.quantiles(rows, ["g"], {"m": 0.5})
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("tests", "")


@pytest.mark.parametrize("per_slice", [None, 150])
def test_prefix_sums(rows, per_slice):
    got = ordered.prefix_sums(rows, ["g"], ["k"], {"v": F.col("value")}, per_slice, following="next_k").toPandas()
    for _, g in got.groupby("g"):
        g = g.sort_values("k")
        assert np.allclose(g["v_upto"], g["value"].cumsum())
        assert np.allclose(g["v_total"], g["value"].sum())
        assert g["next_k"].iloc[:-1].tolist() == g["k"].iloc[1:].tolist() and np.isnan(float(g["next_k"].iloc[-1] or "nan"))


@pytest.mark.parametrize("per_slice", [None, 100])
def test_index_rows_global(rows, per_slice):
    got = ordered.index_rows(rows, ["g", "k"], rows_per_slice=per_slice).toPandas().sort_values(["g", "k"])
    assert got["idx"].tolist() == list(range(len(got)))


@pytest.mark.parametrize("per_slice", [None, 20])
def test_quantiles(table, per_slice):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=1200), rng.integers(0, 5, 901).astype(float)
    df = table("g string, value double", [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("c", None)])
    got = {r.g: r for r in ordered.quantiles(df, ["g"], {"q1": 0.25, "m": 0.5, "q9": 0.9}, rows_per_slice=per_slice).collect()}
    assert set(got) == {"a", "b"}
    for g, v in (("a", a), ("b", b)):
        assert np.allclose([got[g].q1, got[g].m, got[g].q9], np.quantile(v, [0.25, 0.5, 0.9]))


def test_average_ranks(table):
    df = table("g int, value double", [(1, v) for v in (3.0, 1.0, 3.0, 2.0, 3.0)])
    got = {r.value: r.avg_rank for r in ordered.average_ranks(df, ["g"]).collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


@pytest.mark.parametrize("block", [None, 16])
def test_moving_frames(table, block):
    v = np.random.default_rng(3).normal(size=100)
    df = table("idx long, value double", [(i, float(x)) for i, x in enumerate(v)])
    got = moving(df, [], 3, 2, {"s": F.sum("value"), "n": F.count("value")}, block=block).toPandas().sort_values("idx")
    assert got["idx"].tolist() == list(range(100))
    assert np.allclose(got["s"], [v[max(0, i - 3) : i + 3].sum() for i in range(100)])
