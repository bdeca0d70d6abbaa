import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftwise.operators import errors
from shiftwise.operators.detectors import DETECTORS, WarningChain, make_detector

PARAMS = {"fhddm": {"confidence_level": 0.001}}


def step_errors(seed=0, calm=1000, wild=500, low=0.05, high=0.6):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.random(calm) < low, rng.random(wild) < high]).astype(int)


def fold(name, xs, grace=3):
    chain = WarningChain(make_detector(name, PARAMS.get(name)), grace)
    return [hit for x in xs if (hit := chain.update(int(x)))]


@pytest.mark.parametrize("name", sorted(DETECTORS))
def test_step_is_found_once_it_happens(name):
    for seed in range(5):
        found = [at for at, _, _ in fold(name, step_errors(seed))]
        assert any(1000 <= at < 1160 for at in found), (name, seed, found)
        assert name not in ("adwin", "fhddm", "hddm_a") or not any(at < 1000 for at in found)


@pytest.mark.parametrize("name", sorted(DETECTORS))
def test_quiet_stream_has_no_drift(name):
    assert not fold(name, [0] * 3000)


def test_fhddm_needs_a_confidence():
    with pytest.raises(ValueError):
        make_detector("fhddm", {"confidence_level": None})
    with pytest.raises(ValueError):
        make_detector("nothing")


def test_ddm_by_hand():
    d = make_detector("ddm")
    for _ in range(40):
        d.update(0)
    assert not d.warning and d.level_min == 0
    d.update(1)  # any error beats a perfect record
    assert d.drift
    d.update(0)
    assert d.n == 1 and not d.drift


def test_adwin_keeps_exact_totals():
    d = make_detector("adwin", {"delta": 1e-9})
    rng = np.random.default_rng(0)
    xs = (rng.random(1000) < 0.3).astype(float)
    for x in xs:
        d.update(x)
    assert d.width == 1000 and d.total == xs.sum()
    assert d.var / d.width == pytest.approx(xs.var(), rel=1e-6)
    assert max(len(level) for level in d.rows) <= 5


class Script:
    """A detector that follows a script of w(arning), d(rift) and quiet rows."""

    def __init__(self, text):
        self.text, self.at = text, -1

    def update(self, x):
        self.at += 1
        self.warning, self.drift = self.text[self.at] == "w", self.text[self.at] == "d"


def run_script(text, grace, sample=5):
    chain = WarningChain(Script(text), grace, sample)
    return [hit for _ in text if (hit := chain.update(0))]


def test_warning_chain():
    # ten quiet rows hold 5; then w . . w d: two quiet rows bridge with grace 3
    at, history, chain = run_script("." * 10 + "w..wd", 3)[0]
    assert (at, history) == (14, 10)
    # grace 1: the chain breaks at the first quiet row and history is cut to 5 again
    assert run_script("." * 10 + "w..wd", 1)[0][:2] == (14, 7)
    # history restarts after a drift
    assert [h[:2] for h in run_script("...d..d", 3)] == [(3, 4), (6, 3)]


@pytest.fixture()
def streams(table):
    rows = []
    for s in range(3):
        rows += [(s, 10 * i, int(x)) for i, x in enumerate(step_errors(s))]
    return table("stream long, k long, error int", rows).repartition(5)


@pytest.mark.parametrize("name", ["ddm", "eddm", "hddm_w"])
def test_batch_detection_equals_the_plain_fold(streams, name):
    indexed = errors.indexed_errors(streams, ["k"], rows_per_slice=100)
    got = sorted((r.stream, r.detected_at, r.history, r.chain) for r in errors.detect_drifts(indexed, name).collect())
    want = sorted((s, *hit) for s in range(3) for hit in fold(name, step_errors(s)))
    assert got == want and got


def test_packing_keeps_order(streams):
    indexed = errors.indexed_errors(streams, ["k"])
    got = {(r.stream, r.chunk): r.bits for r in errors.packed(indexed, 400).collect()}
    for s in range(3):
        assert "".join(got[(s, c)] for c in range(4)) == "".join(map(str, step_errors(s)))


def test_rates(streams):
    indexed = errors.indexed_errors(streams, ["k"])
    got = errors.rolling_error_rate(indexed, 100, block=256).where("stream = 1").orderBy("idx").toPandas()
    xs = step_errors(1)
    assert len(got) == 1500 - 99
    assert np.allclose(got["rate"], np.convolve(xs, np.ones(100), "valid") / 100)
    acc = errors.running_accuracy(indexed).where("stream = 2").orderBy("idx").toPandas()
    assert np.allclose(acc["accuracy"], 1 - np.cumsum(step_errors(2)) / np.arange(1, 1501))


# Expected positions, worked out position by position from the method descriptions.
def want_cusum(xs, at):
    lo = max(0, at - 300)
    if at < 50:
        return 0
    seg = xs[lo:at]
    base = min(50, len(seg) // 4)
    level, c = seg[:base].mean(), 0.0
    for i in range(base, len(seg)):
        c = max(0.0, c + (seg[i] - level - 0.1))
        if c > 1.5:
            return lo + i
    return lo + base


def want_threshold(xs, at, w=100):
    if at < 50:
        return 0
    lo = max(0, at - 300)
    base = min(lo + w, at - 50)
    if base <= lo:
        return lo
    limit, run = 1.5 * xs[lo:base].mean(), 0
    for i in range(base, at):
        part = xs[i : min(i + w, at)]
        if len(part) < 10:
            continue
        run = run + 1 if part.mean() > limit else 0
        if run >= 20:
            return max(lo, i - 20)
    return base


def want_gradient(xs, at):
    if at < 50:
        return 0
    lo = max(0, at - 300)
    means = [xs[i : i + 20].mean() for i in range(lo, at - 20)]
    return lo + next((i for i, d in enumerate(np.diff(means)) if d > 0.01), 0)


def want_peak(xs, at, w=100):
    n = len(xs)
    if at + w > n:
        return at
    best, rate, i = at, xs[at : at + w].mean(), at + w
    while i + w <= min(at + 200, n) and xs[i : i + w].mean() >= rate:
        best, rate, i = i, xs[i : i + w].mean(), i + w
    return best


def want_recovery(xs, at):
    end = min(at + 200, len(xs))
    if end - at < 20:
        return at
    high, c = xs[at : at + 20].mean(), 0.0
    for i in range(at + 20, end):
        c = max(0.0, c + (high - xs[i] - 0.1))
        if c > 1.5:
            return i
    return end - 1


@pytest.mark.parametrize("start,end", [("cusum", "peak"), ("threshold", "recovery"), ("gradient", "none"), ("none", "peak")])
def test_drift_positions(streams, table, start, end):
    indexed = errors.indexed_errors(streams, ["k"])
    places = [20, 49, 50, 75, 120, 333, 1040, 1090, 1320, 1395, 1460, 1490, 1499]
    drifts = table("stream long, detected_at long, history long", [(s, p, 7) for s in range(3) for p in places])
    got = {(r.stream, r.detected_at): (r.drift_start, r.drift_end)
           for r in errors.locate_drifts(drifts, indexed, start, end).collect()}
    starts = {"cusum": want_cusum, "threshold": want_threshold, "gradient": want_gradient, "none": lambda xs, at: at - 7}
    ends = {"peak": want_peak, "recovery": want_recovery, "none": lambda xs, at: at}
    for s in range(3):
        xs = step_errors(s).astype(float)
        for p in places:
            assert got[(s, p)] == (max(0, min(starts[start](xs, p), p - 7)), ends[end](xs, p)), (s, p)


def test_start_is_never_negative(streams, table):
    indexed = errors.indexed_errors(streams, ["k"])
    drifts = table("stream long, detected_at long, history long", [(0, 30, 31)])
    assert errors.locate_drifts(drifts, indexed, "none", "none").first().drift_start == 0


def test_descriptions_and_summary(streams, table):
    indexed = errors.indexed_errors(streams, ["k"])
    known = table("stream long, detected_at long, drift_start long, drift_end long", [(0, 1040, 1005, 1140), (1, 30, 0, 30)])
    xs = {s: step_errors(s).astype(float) for s in range(3)}
    got = {r.stream: r for r in errors.describe_drifts(known, indexed).collect()}
    assert got[0].rate_at_start == pytest.approx(xs[0][955:1055].mean())
    assert got[0].rate_at_detection == pytest.approx(xs[0][940:1040].mean())
    assert got[0].rate_at_end == pytest.approx(xs[0][1090:1190].mean()) and got[0].duration == 135
    assert got[1].rate_at_start == pytest.approx(xs[1][:50].mean())
    assert got[1].rate_at_detection == pytest.approx(xs[1][:30].mean())
    fixed = {r.stream: r for r in errors.correct_drift_end(known, indexed, block=128).collect()}
    rate = np.convolve(xs[0], np.ones(100), "valid") / 100
    top = 1005 + int(np.argmax(rate[1005:1141]))
    assert (fixed[0].start, fixed[0].end, fixed[0].duration) == (1105, top + 100, top - 1005)
    assert fixed[0].error_rate_increase == pytest.approx(rate[top] - rate[1005])
    kept = {r.stream: r for r in errors.correct_drift_end(known, indexed, take_max=False).collect()}
    assert kept[0].end == 1240
    summary = {r.stream: r for r in errors.drift_summary(errors.correct_drift_end(known, indexed), indexed).collect()}
    assert summary[2].drifts == 0 and summary[2].avg_duration is None and summary[0].rows == 1500
    assert summary[0].accuracy == pytest.approx(1 - xs[0].mean()) and summary[0].max_duration == top - 1005


def test_prequential_learns_separated_classes(table):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        label = "ab"[i % 2]
        flipped = label if i < 300 else "ba"["ab".index(label)]
        rows.append((i // 100, i, flipped, float(rng.normal(3 if label == "a" else -3))))
    df = table("window_id long, idx long, label string, x double", rows)
    got = errors.prequential_error(df, ["x"]).groupBy("window_id").agg(F.avg("error").alias("e")).collect()
    rate = {r.window_id: r.e for r in got}
    assert rate[0] == 1.0 and rate[1] < 0.02 and rate[2] < 0.02 and rate[3] > 0.98


@pytest.mark.parametrize("name", sorted(DETECTORS))
def test_stretches_don_t_matter(name):
    rng = np.random.default_rng(5)
    xs = np.concatenate([rng.random(700) < p for p in (0.05, 0.4, 0.0, 0.9, 0.2)]).astype(int)
    want = fold(name, xs, grace=7)
    for size in (1, 13, 512, len(xs)):
        chain = WarningChain(make_detector(name, PARAMS.get(name)), 7)
        assert [h for at in range(0, len(xs), size) for h in chain.feed(xs[at : at + size])] == want
    assert want


def test_history_from_positions():
    """Against the definition: every row is asked for its chain by looking back."""
    rng = np.random.default_rng(6)
    for _ in range(50):
        text = "".join(rng.choice(list("....wwd"), 120))
        grace, sample = int(rng.integers(1, 6)), int(rng.integers(1, 12))
        want, last = [], -1
        for at in (i for i, c in enumerate(text) if c == "d"):
            warned = [i for i in range(last + 1, at) if text[i] == "w"]
            first = at
            if warned and at - warned[-1] <= grace:
                first = warned[-1]
                for w in reversed(warned):
                    if first - w > grace:
                        break
                    first = w
            alive = bool(warned) and at - warned[-1] < grace
            want.append((at, at - max(last, first - 1 - sample), at - first + 1 if alive else 0))
            last = at
        assert run_script(text, grace, sample) == want
