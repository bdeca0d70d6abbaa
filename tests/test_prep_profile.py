import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftwise.operators import prep, profile
from shiftwise.sources.tables import DatasetRegistry, as_labelled, load_labelled, x_y_split_by_name

SCHEMA = "side string, label string, x double, y double"


def sides(table, before, after):
    rows = [("before", *r) for r in before] + [("after", *r) for r in after]
    return table(SCHEMA, rows)


BLOCK = [("a", 1.0, 10.0), ("a", 2.0, 20.0), ("a", 3.0, 60.0), ("b", 5.0, 1.0), ("b", 7.0, 2.0)]


def test_same_sides_have_no_drift(table):
    got = profile.drift_table(sides(table, BLOCK, BLOCK), ["x", "y"])
    assert got.where("drift").count() == 0
    assert got.agg(F.max(F.abs("shift"))).first()[0] == 0.0
    assert got.count() == 2 * 2 * 5 + 2


def test_shifts_are_one_sided_by_default(table):
    lower = [(c, x, y / 2) for c, x, y in BLOCK]
    df = sides(table, BLOCK, lower)
    one = profile.drift_table(df, ["x", "y"], with_ratio=False)
    both = profile.drift_table(df, ["x", "y"], two_sided=True, with_ratio=False)
    assert one.where("drift").count() == 0
    assert both.where("drift and feature = 'y'").count() == 10


def test_lost_and_new_class_count_as_zero(table):
    df = sides(table, BLOCK, [r for r in BLOCK if r[0] == "a"] + [("c", 4.0, 4.0), ("c", 4.0, 6.0)])
    got = {(r.label, r.feature, r.stat): r for r in profile.drift_table(df, ["x", "y"]).collect()}
    assert got[("b", "x", "mean")].shift == pytest.approx(-1.0) and not got[("b", "x", "mean")].drift
    assert got[("c", "x", "mean")].shift == pytest.approx(4.0 / 1e-10) and got[("c", "x", "mean")].drift
    assert got[("b", "__class_ratio__", "imbalance_ratio")].new == 0.0


def test_std_of_one_row_never_flags(table):
    df = sides(table, [("a", 1.0, 1.0)], [("a", 1.0, 2.0)])
    got = {(r.feature, r.stat): r for r in profile.drift_table(df, ["x", "y"]).collect()}
    assert got[("y", "std")].shift is None and not got[("y", "std")].drift and got[("y", "mean")].drift


def test_decision_needs_the_share_of_statistics(table):
    df = sides(table, BLOCK, [(c, x * 2, y) for c, x, y in BLOCK])
    drifts = profile.drift_table(df, ["x", "y"])
    row = profile.desc_decision(drifts).first()
    assert row.statistics == 6 and row.drifted_share == pytest.approx(5 / 6) and row.drift
    assert not profile.desc_decision(drifts, 0.9).first().drift


def test_box_and_histogram(table):
    v = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = table(SCHEMA, [("before", "a", x, 0.0) for x in v] + [("after", "a", 200.0, 0.0)])
    box = profile.box_summary(df, ["x"]).where("side = 'before'").first()
    assert (box.q1, box.median, box.q3) == (2.25, 3.5, 4.75)
    assert (box.whisker_low, box.whisker_high, box.outliers) == (1.0, 5.0, 1)
    hist = profile.histogram_before_after(df, ["x"], 10).where("side = 'before'").orderBy("bin").collect()
    assert [r.n for r in hist] == np.histogram(v, bins=10, range=(1, 200))[0].tolist()
    flat = profile.class_histogram(df, ["y"], 30).where("side = 'before'").collect()
    assert len(flat) == 30 and sum(r.n for r in flat) == 6 and min(r.bin_left for r in flat) == -0.5


def test_qq_and_inverse_normal(table):
    from statistics import NormalDist

    rng = np.random.default_rng(0)
    v = np.round(rng.normal(5, 2, 300), 1)
    df = table(SCHEMA, [("before", "a", float(x), 0.0) for x in v])
    got = profile.qq_normal(df, ["x"], chunk=3).toPandas().sort_values("place")
    assert np.allclose(got["value"], np.sort(v)) and got["place"].tolist() == list(range(1, 301))
    n = len(v)
    medians = [1 - 0.5 ** (1 / n)] + [(i - 0.3175) / (n + 0.365) for i in range(2, n)] + [0.5 ** (1 / n)]
    assert np.allclose(got["theoretical"], [NormalDist().inv_cdf(p) for p in medians], atol=1e-7)
    line = profile.qq_line(profile.qq_normal(df, ["x"])).first()
    assert line.slope == pytest.approx(v.std(), rel=0.05) and line.intercept == pytest.approx(v.mean(), rel=0.01)


def test_kde(table):
    rng = np.random.default_rng(0)
    v = {"before": rng.normal(size=400), "after": rng.normal(8, 1, 400)}
    df = table(SCHEMA, [(s, "a", float(x), 0.0) for s in v for x in v[s]])
    got = profile.kde(df, ["x"], points=400).toPandas().sort_values(["side", "point"])
    for s, x in v.items():
        one = got[got.side == s]
        h = x.std(ddof=1) * len(x) ** -0.2
        z = (one.x.to_numpy()[:, None] - x[None, :]) / h
        want = np.exp(-0.5 * z * z).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
        assert np.allclose(one.density, want) and np.trapezoid(one.density, one.x) == pytest.approx(1, abs=0.02)


def test_windows_and_slices(table):
    df = table("idx long, v int", [(i, i) for i in range(23)])
    got = prep.fixed_windows(df, 5).groupBy("window_id").count().orderBy("window_id").collect()
    assert [(r.window_id, r["count"]) for r in got] == [(0, 5), (1, 5), (2, 5), (3, 5)]
    ba = prep.before_after(df, 2, 4, 6).groupBy("side").agg(F.min("idx").alias("a"), F.max("idx").alias("b")).collect()
    assert {r.side: (r.a, r.b) for r in ba} == {"before": (2, 7), "after": (4, 9)}
    with pytest.raises(ValueError):
        prep.before_after(df, 2, 20, 6, rows=23)
    assert [r.idx for r in prep.block_at(df, 5, 100).orderBy("idx").collect()] == [18, 19, 20, 21, 22]
    a, b = (sorted(r.idx for r in prep.block_at(df, 5, -1).collect()) for _ in range(2))
    assert a == b and len(a) == 5


def test_scalers(table):
    df = sides(table, [("a", 1.0, 4.0), ("a", 3.0, 4.0)], [("a", 5.0, 6.0)])
    mm = {r.side: r for r in prep.min_max_scale(df, ["x", "y"]).where("x > 0.5 or side = 'after'").collect()}
    assert (mm["after"].x, mm["after"].y) == (2.0, 2.0)
    st = prep.standard_scale(df, ["x", "y"]).where("side = 'after'").first()
    assert (st.x, st.y) == (3.0, 2.0)


def test_encoders(table):
    df = table("id long, c string, d string", [(1, "b", "x"), (2, "a", None), (3, None, "x"), (4, "z", "b")])
    fit = df.where("id < 4")
    got = {r.id: r.c for r in prep.ordinal_encode(df, ["c"], fit).collect()}
    assert got == {1: 1, 2: 0, 3: -1, 4: -1}
    hot = prep.multilabel_one_hot(df, ["c", "d"]).orderBy("id")
    assert hot.columns == ["id", "a", "b", "x", "z"]
    assert [tuple(r)[1:] for r in hot.collect()] == [(0, 1, 1, 0), (1, 0, 0, 0), (0, 0, 1, 0), (0, 1, 0, 1)]


def test_binary_entropy_weight(table):
    rows = [("a", 1.0, 5.0, 0.0)] * 4 + [("b", 1.0, 1.0, 7.0)] * 2 + [("b", 0.0, 2.0, 7.0)] * 2
    df = table("label string, p double, q double, r double", rows)
    got = prep.binary_entropy_weights(df, ["p", "q", "r"]).first()
    half = 0.5 * math.log(2)
    assert got.p == pytest.approx((1 - half) / math.log(2)) and got.q == 1.0


def test_stratified_split_is_exact_and_repeatable(table):
    df = table("idx long, label string", [(i, "a" if i % 3 else "b") for i in range(300)])
    got = prep.stratified_split(df)
    counts = {(r.label, r.part): r["count"] for r in got.groupBy("label", "part").count().collect()}
    assert counts == {("a", "train"): 120, ("a", "valid"): 40, ("a", "test"): 40,
                      ("b", "train"): 60, ("b", "valid"): 20, ("b", "test"): 20}
    again = prep.stratified_split(df.repartition(5))
    assert got.exceptAll(again).count() == 0
    with pytest.raises(ValueError):
        prep.stratified_split(df, train=0.9)


def test_cardinality_and_recodes(table):
    df = table("a int, b int, c string", [(1, 1, "UA"), (1, 2, "YV"), (1, 3, "??")])
    assert prep.drop_by_cardinality(df, ["a", "b", "c"]).columns == ["b", "c"]
    assert prep.drop_by_cardinality(df, ["a", "b"], 3).columns == ["a", "c"]
    assert [r[0] for r in df.orderBy("b").select(prep.recode_airline(F.col("c"))).collect()] == [2, 1, 0]
    names = df.orderBy("b").select(prep.recode_ranges(F.col("b") * 2 - 2, prep.PRIOR_COUNT_LIMITS, prep.PRIOR_COUNT_OTHERWISE))
    assert [r[0] for r in names.collect()] == ["0", "1 to 3", "More than 3"]
    assert x_y_split_by_name(["a", "target", "my_target2"]) == (["a"], ["target", "my_target2"])


def test_concept_mixing(table):
    a = table("idx long, c string", [(i, "old") for i in range(2000)])
    b = a.withColumn("c", F.lit("new"))
    sudden = prep.mix_concepts(a, b, 900, 1)
    assert sudden.where("c = 'new'").agg(F.min("idx"), F.count("*")).first()[:] == (900, 1100)
    slow = prep.mix_concepts(a, b, 1000, 500)
    assert slow.count() == 2000 and slow.select("idx").distinct().count() == 2000
    share = {r.k: r.s for r in slow.groupBy(F.floor(F.col("idx") / 500).alias("k")).agg(F.avg((F.col("c") == "new").cast("int")).alias("s")).collect()}
    assert share[0] < 0.02 < share[1] < 0.5 < share[2] < 0.98 < share[3]
    for width in (1, 50, 500, 5000):
        assert prep.mix_concepts(a, b, 1000, width).count() == 2000


def test_label_drifts(table):
    df = table("idx long, label int", [(i, i % 3) for i in range(60)])
    got = prep.inject_label_drift(df, [20, 40], classes=3).orderBy("idx").collect()
    assert [r.label for r in got] == [(i % 3 + (20 <= i < 40)) % 3 for i in range(60)]
    x = table("idx long, x double, z double", [(i, float(i % 10), 0.1 * i) for i in range(100)])
    y = prep.weight_inversion_labels(x, ["x", "z"], 1, 50).orderBy("idx").collect()
    pre = np.median([r.x + r.z for r in y])
    post = np.median([-r.x + r.z for r in y])
    assert [r.y for r in y] == [int((r.x + r.z > pre) if r.idx < 50 else (-r.x + r.z > post)) for r in y]
    with pytest.raises(ValueError):
        prep.weight_inversion_labels(x, ["x", "z"], 0, 50)


def test_sources(spark, table, tmp_path):
    df = table("id long, x double, y string, cls string", [(1, float("nan"), "3", "a"), (2, 2.0, "4", "b"), (3, 1.0, "5", None)])
    path = str(tmp_path / "t.csv")
    df.write.csv(path, header=True)
    got = load_labelled(spark, path, "cls", ["x", "nope"], ["id"])
    assert got.columns == ["id", "label", "x"] and {r.id: r.x for r in got.collect()} == {1: None, 2: 2.0, 3: 1.0}
    with pytest.raises(ValueError):
        as_labelled(df, "missing")
    typed = df.withColumn("day", F.current_date()).withColumn("at", F.current_timestamp().cast("timestamp_ntz"))
    assert as_labelled(typed, "cls").columns == ["label", "id", "x"] and as_labelled(typed, "cls").count() == 3
    assert as_labelled(typed, "cls", unlabelled=False).count() == 2
    assert as_labelled(typed, "cls", ["y"]).orderBy("y").first().y == 3.0
    reg = DatasetRegistry(spark, str(tmp_path / "reg"))
    reg.save("my set", df, "cls", ["x"])
    reg.save("other", df, "y")
    assert [r.name for r in reg.list().collect()] == ["my set", "other"]
    again = DatasetRegistry(spark, str(tmp_path / "reg")).reload()
    assert again.get("my set").target_column == "cls" and again.load("my set").columns == ["label", "id", "x"][:1] + ["x"]
    again.delete("my set")
    assert DatasetRegistry(spark, str(tmp_path / "reg")).reload().get("my set") is None
    with pytest.raises(KeyError):
        again.load("my set")
