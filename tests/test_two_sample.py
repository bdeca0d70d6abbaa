import math

import numpy as np
import pytest

from shiftwise.functions.numeric import anderson_darling_sigma, assign_min_cost, expected_mutual_information, harmonic
from shiftwise.operators import two_sample as ts


def make(table, old, new, label="a"):
    rows = [("before", label, i, float(v)) for i, v in enumerate(old)]
    rows += [("after", label, i, float(v)) for i, v in enumerate(new)]
    return table("side string, label string, k long, x double", rows)


@pytest.fixture()
def shifted(table):
    rng = np.random.default_rng(0)
    old, new = rng.normal(size=400), rng.normal(0.8, 1, size=300)
    return make(table, old, new), old, new


def test_equal_sides(table):
    df = make(table, range(50), range(50))
    res = {r.test: r for r in ts.run_tests(df, ["x"], ["k"]).collect()}
    assert res["kolmogorov_smirnov"].stat == 0 and res["kolmogorov_smirnov"].p_value == 1
    assert res["wasserstein"].stat == 0 and res["jensen_shannon"].stat == pytest.approx(0)
    assert res["kullback_leibler"].stat == pytest.approx(0) and res["spearman"].stat == pytest.approx(1)
    assert not any(r.drift for r in res.values())
    assert not ts.test_decision(ts.run_tests(df, ["x"], ["k"])).first().drift


@pytest.mark.parametrize("per_slice", [None, 30])
def test_ks_and_wasserstein(shifted, per_slice):
    df, old, new = shifted
    summary = ts.cdf_summary(ts.side_cdfs(df, ["x"], per_slice))
    grid = np.sort(np.concatenate([old, new]))
    f1 = np.searchsorted(np.sort(old), grid, "right") / len(old)
    f2 = np.searchsorted(np.sort(new), grid, "right") / len(new)
    ks = ts.ks_test(summary).first()
    assert ks.stat == pytest.approx(np.abs(f1 - f2).max()) and ks.drift and ks.p_value < 1e-10
    w = ts.wasserstein(summary, ts.feature_ranges(df, ["x"])).first()
    area = (np.abs(f1 - f2)[:-1] * np.diff(grid)).sum() / (old.max() - old.min())
    assert w.stat == pytest.approx(area) and w.drift == (area > 0.1)


def test_divergences(shifted):
    df, old, new = shifted
    edges = np.histogram_bin_edges(old, 30)
    p = np.histogram(old, edges, density=True)[0] * (old.max() - old.min()) + 1e-10
    q = np.histogram(new, edges, density=True)[0] * (old.max() - old.min()) + 1e-10
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    divs = ts.divergences(ts.side_bins(df, ["x"]))
    assert ts.kl_divergence(divs).first().stat == pytest.approx((p * np.log(p / q)).sum(), rel=1e-6)
    assert ts.js_divergence(divs).first().stat == pytest.approx(((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()) / 2, rel=1e-6)


def test_after_values_outside_the_edges_give_no_flag(table):
    divs = ts.divergences(ts.side_bins(make(table, range(10), range(100, 110)), ["x"]))
    row = ts.kl_divergence(divs).first()
    assert row.stat is None and not row.drift


def test_constant_before(table):
    row = ts.js_divergence(ts.divergences(ts.side_bins(make(table, [3.0] * 5, [3.0] * 4), ["x"]))).first()
    assert row.stat == pytest.approx(0, abs=1e-9)
    assert ts.spearman_paired(make(table, [3.0] * 5, [3.0] * 4), ["x"], ["k"]).first().stat is None


def test_spearman_pairs_by_position(table):
    old, new = [1, 2, 2, 4, 9, 7], [2, 1, 5, 5, 8]
    got = ts.spearman_paired(make(table, old, new), ["x"], ["k"]).first()

    def ranks(v):
        return [sum(a < b for a in v) + (sum(a == b for a in v) + 1) / 2 for b in v]

    assert got.stat == pytest.approx(np.corrcoef(ranks(old[:5]), ranks(new))[0, 1]) and got.drift


def test_anderson_darling(table):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(size=60), 1), np.round(rng.normal(0.1, 1, size=40), 1)
    raw = ts.cdf_summary(ts.side_cdfs(make(table, a, b), ["x"])).first()
    z = np.concatenate([a, b])
    n, total = len(z), 0.0
    for sample in (a, b):
        part = 0.0
        for v in np.unique(z):
            lj = (z == v).sum()
            at = (z < v).sum() + lj / 2
            mid = (sample < v).sum() + (sample == v).sum() / 2
            part += lj / n * (n * mid - at * len(sample)) ** 2 / (at * (n - at) - n * lj / 4)
        total += part / len(sample)
    assert raw.raw == pytest.approx(total * (n - 1) / n)
    row = ts.anderson_darling_k(ts.cdf_summary(ts.side_cdfs(make(table, a, b), ["x"]))).first()
    assert row.stat == pytest.approx((raw.raw - 1) / anderson_darling_sigma(60, 40))
    assert 0.001 <= row.p_value <= 0.25 and len(row.critical) == 7
    far = ts.anderson_darling_k(ts.cdf_summary(ts.side_cdfs(make(table, a, b + 9), ["x"]))).first()
    assert far.p_value == 0.001 and far.drift


def test_only_the_shifted_feature_flags(table):
    rng = np.random.default_rng(1)
    rows = []
    for side, off in (("before", 0.0), ("after", 5.0)):
        for label in "ab":
            rows += [(side, label, i, float(rng.normal() + (off if label == "a" else 0)), float(rng.normal())) for i in range(200)]
    df = table("side string, label string, k long, x double, y double", rows)
    res = ts.run_tests(df, ["x", "y"], ["k"], ["kolmogorov_smirnov", "wasserstein"])
    assert {(r.label, r.feature) for r in res.where("drift").collect()} == {("a", "x")}
    with pytest.raises(ValueError):
        ts.run_tests(df, ["x"], ["k"], ["nothing"])


def test_numeric_helpers():
    assert harmonic(4) == pytest.approx(25 / 12)
    assert harmonic(2_000_000) == pytest.approx(math.log(2_000_000) + 0.5772156649015329 + 1 / 4_000_000)
    assert assign_min_cost(np.array([[4.0, 1, 3], [2, 0, 5], [3, 2, 2]])) == [(0, 1), (1, 0), (2, 2)]
    # all tables with margins (2, 2) x (2, 2): weights 1/6, 4/6, 1/6 for n11 = 0, 1, 2
    expected = 2 / 6 * math.log(2) + 4 / 6 * 0
    assert expected_mutual_information(np.array([2, 2]), np.array([2, 2])) == pytest.approx(expected)


def test_variance_term_is_one_formula_at_every_size():
    from shiftwise.functions.numeric import anderson_darling_sigma, scholz_stephens_g

    for n in (3, 10, 200):
        double_sum = sum(1.0 / ((n - i) * j) for i in range(1, n - 1) for j in range(i + 1, n))
        assert abs(scholz_stephens_g(n) - double_sum) < 1e-10
    for n in (1_000_000, 5_000_000):
        at = [anderson_darling_sigma(n // 2 + k, n // 2) for k in (-2, -1, 0, 1, 2)]
        assert max(at) - min(at) < 1e-6


def test_exact_ks():
    """Equal sizes against the reflection formula, unequal ones against all orders of the joint sample."""
    from itertools import combinations
    from math import comb

    from shiftwise.functions.numeric import ks_exact_p

    for n in range(5, 21):
        for k in range(1, n + 1):
            want = 2 * sum((-1) ** (i - 1) * comb(2 * n, n - i * k) for i in range(1, n // k + 1)) / comb(2 * n, n)
            assert abs(ks_exact_p(n, n, k / n) - want) < 1e-12
    assert round(ks_exact_p(10, 10, 0.7), 4) == 0.0123 and round(ks_exact_p(5, 5, 0.8), 4) == 0.0794
    for a, b in ((3, 5), (4, 6), (2, 7)):
        found = []
        for mine in combinations(range(a + b), a):
            i = np.cumsum(np.isin(np.arange(a + b), mine))
            found.append(np.abs(i / a - (np.arange(1, a + b + 1) - i) / b).max())
        for d in {round(x, 12) for x in found}:
            assert abs(ks_exact_p(a, b, d) - np.mean(np.array(found) >= d - 1e-9)) < 1e-12
    assert abs(ks_exact_p(500, 500, 0.09) - 0.0347) < 0.002 and ks_exact_p(0, 4, 0.5) == 1.0
