"""Drift detectors over one error stream.

A detector reads stretches of a stream as arrays: running sums and running extremes give every row's statistic at once, up to
the first detection, after which the state starts afresh. What is carried from one stretch to the next is a few numbers (FHDDM: one
window; ADWIN: its bucket list), so a stream of any length is read in bounded memory, and it doesn't matter how it is cut.
Definitions follow the published papers named at each class.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import accumulate

import numpy as np

SHORTEST, LONGEST = 256, 1 << 16  # rows looked at together: few after a detection, more while there is none


class Detector:
    """``feed`` reads rows; ``update`` reads one row and sets ``drift`` and ``warning``."""

    drift = False
    warning = False

    def start(self) -> None:
        raise NotImplementedError

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Warnings and detections as if there were no detection among the rows; the state moves to their end."""
        raise NotImplementedError

    def feed(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Warnings per row and the places of detections; the row after a detection is the first of a new state."""
        x = np.asarray(x, float)
        warned, drifts = np.zeros(len(x), bool), []
        at, size = 0, SHORTEST
        while at < len(x):
            part = x[at : at + size]
            warn, drift = self.scan(part)
            hits = np.flatnonzero(drift)
            if len(hits):
                part = part[: hits[0] + 1]
                drifts.append(at + int(hits[0]))
                self.start()
                size = SHORTEST
            else:
                size = min(2 * size, LONGEST)
            warned[at : at + len(part)] = (warn & ~drift)[: len(part)]
            at += len(part)
        return warned, drifts

    def update(self, x: float) -> None:
        warned, drifts = self.feed(np.array([x], float))
        self.drift, self.warning = bool(drifts), bool(warned[-1])


def last_lowest(values: np.ndarray, carried: float) -> np.ndarray:
    """For each row the place of the smallest value so far, of equal ones the last; -1 where that is the carried one."""
    lowest = np.minimum.accumulate(np.append(carried, values))
    return np.maximum.accumulate(np.where(values <= lowest[:-1], np.arange(len(values)), -1))


def picked(values: np.ndarray, at: np.ndarray, carried: float) -> np.ndarray:
    return np.where(at >= 0, values[at], carried)


class DDM(Detector):
    """Gama et al. 2004: error rate plus deviation against its minimum."""

    def __init__(self, warm_start: int = 30, warn: float = 2.0, out: float = 3.0):
        self.warm_start, self.warn, self.out = warm_start, warn, out
        self.start()

    def start(self) -> None:
        self.n, self.errors = 0, 0.0
        self.p_min = self.s_min = self.level_min = math.inf

    def scan(self, x):
        n = self.n + np.arange(1, len(x) + 1)
        errors = self.errors + np.cumsum(x)
        p = errors / n
        s = np.sqrt(p * (1 - p) / n)
        ready = n > self.warm_start
        at = last_lowest(np.where(ready, p + s, np.inf), self.level_min)
        at = np.where(ready, at, -1)
        p_min, s_min = picked(p, at, self.p_min), picked(s, at, self.s_min)
        drift = ready & (p + s > p_min + self.out * s_min)
        warn = ready & (p + s > p_min + self.warn * s_min)
        self.n, self.errors, self.p_min, self.s_min = int(n[-1]), float(errors[-1]), float(p_min[-1]), float(s_min[-1])
        self.level_min = self.p_min + self.s_min
        return warn, drift


class EDDM(Detector):
    """Baena-Garcia et al. 2006: distance between errors against its maximum.

    Distances are judged at errors only; in between a warning stands.
    """

    def __init__(self, warm_start: int = 30, warn: float = 0.95, out: float = 0.9):
        self.warm_start, self.warn, self.out = warm_start, warn, out
        self.start()

    def start(self) -> None:
        self.n = self.errors = self.last = 0
        self.sum = self.squares = self.best = 0.0
        self.standing = False

    def scan(self, x):
        rows = len(x)
        e = np.flatnonzero(x)
        n = self.n + 1 + e
        gaps = np.diff(n, prepend=self.last).astype(float)
        errors = self.errors + np.arange(1, len(e) + 1)
        total, squares = self.sum + np.cumsum(gaps), self.squares + np.cumsum(gaps * gaps)
        mean = total / np.maximum(errors, 1)
        level = mean + 2 * np.sqrt(np.maximum(squares / np.maximum(errors, 1) - mean * mean, 0.0))
        ready = n >= self.warm_start
        best = np.maximum.accumulate(np.append(self.best, np.where(ready, level, 0.0)))
        judged = ready & (level <= best[:-1])
        ratio = level / np.where(best[:-1] > 0, best[:-1], 1.0)
        many = errors > self.warm_start
        drift_here = judged & many & (ratio < self.out)
        warn_here = judged & many & (ratio < self.warn)
        # What was judged last stands until the next judgement.
        last = np.maximum.accumulate(np.where(judged, np.arange(len(e)), -1))
        standing = np.where(last >= 0, warn_here[last], self.standing) if len(e) else np.zeros(0, bool)
        of = np.searchsorted(e, np.arange(rows), "right") - 1
        warn = np.where(of >= 0, standing[of] if len(e) else False, self.standing)
        drift = np.zeros(rows, bool)
        drift[e] = drift_here
        self.n += rows
        if len(e):
            self.errors, self.last, self.sum, self.squares = int(errors[-1]), int(n[-1]), float(total[-1]), float(squares[-1])
            self.best, self.standing = float(best[-1]), bool(standing[-1])
        return warn, drift


class FHDDM(Detector):
    """Pesaranghader and Viktor 2016: accuracy of a sliding window against its maximum, Hoeffding bound."""

    def __init__(self, confidence_level: float, window: int = 100):
        if confidence_level is None or not 0 < confidence_level < 1:
            raise ValueError("FHDDM needs a confidence level between 0 and 1")
        self.window = window
        self.bound = math.sqrt(math.log(1 / confidence_level) / (2 * window))
        self.start()

    def start(self) -> None:
        self.seen = np.zeros(0)
        self.best = 0.0

    def scan(self, x):
        right = np.append(self.seen, x == 0)
        sums = np.append(0.0, np.cumsum(right))
        full = sums[self.window :] - sums[: len(sums) - self.window] if len(right) >= self.window else np.zeros(0)
        accuracy = np.append(np.zeros(max(0, len(x) - len(full))), full[-len(x) :] / self.window)
        best = np.maximum.accumulate(np.append(self.best, accuracy))[1:]
        drift = np.arange(len(x)) >= len(x) - len(full)
        drift &= best - accuracy > self.bound
        self.seen, self.best = right[-(self.window - 1) :] if self.window > 1 else np.zeros(0), float(best[-1])
        return np.zeros(len(x), bool), drift


class HDDM_A(Detector):
    """Frias-Blanco et al. 2015, averages: mean against the best earlier mean, one-sided."""

    def __init__(self, drift_confidence: float = 0.001, warning_confidence: float = 0.005):
        self.out, self.warn = drift_confidence, warning_confidence
        self.start()

    def start(self) -> None:
        self.n = self.n_min = 0
        self.c = self.c_min = 0.0

    def scan(self, x):
        n = self.n + np.arange(1, len(x) + 1)
        c = self.c + np.cumsum(x)
        log_term = math.log(1 / self.out) / 2
        level = c / n + np.sqrt(log_term / n)
        carried = self.c_min / self.n_min + math.sqrt(log_term / self.n_min) if self.n_min else math.inf
        at = last_lowest(level, carried)
        n_min, c_min = picked(n, at, self.n_min), picked(c, at, self.c_min)
        gap = c / n - c_min / n_min
        m = (n - n_min) / n_min / n
        later = n_min < n
        risen = [later & (gap >= np.sqrt(m / 2 * math.log(2 / level))) for level in (self.warn, self.out)]
        self.n, self.c, self.n_min, self.c_min = int(n[-1]), float(c[-1]), int(n_min[-1]), float(c_min[-1])
        return risen[0], risen[1]


class HDDM_W(Detector):
    """Frias-Blanco et al. 2015, weighted: exponentially weighted means before and after the best cut.

    The means are summed in the order of the rows, so that equal streams give equal digits.
    """

    def __init__(self, drift_confidence: float = 0.001, warning_confidence: float = 0.005, weight: float = 0.05):
        self.out, self.warn, self.weight = drift_confidence, warning_confidence, weight
        self.start()

    def start(self) -> None:
        self.all = self.before = self.after = None
        self.cut = math.inf

    def _squares(self, first: int, rows: int) -> np.ndarray:
        """Squared weights of the mean over ``first + 1`` values and of the following; they settle soon."""
        known = settled(self.weight)
        return known[np.minimum(first + np.arange(rows), len(known) - 1)]

    def _means(self, x: list[float], carried: float | None) -> np.ndarray:
        w, keep = self.weight, 1 - self.weight
        first = [] if carried is None else [carried]
        return np.array(list(accumulate(first + x, lambda a, v: w * v + keep * a)))[len(first) :]

    def scan(self, x):
        values = x.tolist()
        means = self._means(values, self.all[0] if self.all else None)
        seen = self.all[1] if self.all else 0
        squares = self._squares(seen, len(x))
        level = means + np.sqrt(squares * math.log(1 / self.out) / 2)
        lowest = np.minimum.accumulate(np.append(self.cut, level))
        cuts = np.flatnonzero(level < lowest[:-1])
        before, after = np.full((len(x), 2), np.nan), np.full((len(x), 2), np.nan)
        # Between cuts the mean before is the one at the last cut, the mean after runs on from there.
        for lo, hi in zip([-1, *cuts.tolist()], [*cuts.tolist(), len(x)]):
            if lo >= 0:
                self.before, self.after = (float(means[lo]), float(squares[lo])), None
            if hi > lo + 1 and self.before is not None:
                mean, had = self.after or (None, 0)
                run = self._means(values[lo + 1 : hi], mean)
                before[lo + 1 : hi] = self.before
                after[lo + 1 : hi] = np.stack([run, self._squares(had, len(run))], axis=1)
                self.after = (float(run[-1]), had + len(run))
        self.all, self.cut = (float(means[-1]), seen + len(x)), float(lowest[-1])
        with np.errstate(invalid="ignore"):
            risen = [after[:, 0] - before[:, 0] > np.sqrt((before[:, 1] + after[:, 1]) * math.log(1 / c) / 2) for c in (self.warn, self.out)]
        return risen[0], risen[1]


@lru_cache(16)
def settled(weight: float) -> np.ndarray:
    out = [1.0]
    while len(out) < 1 << 16:
        out.append(weight**2 + (1 - weight) ** 2 * out[-1])
        if out[-1] == out[-2]:
            break
    return np.array(out)


class ADWIN(Detector):
    """Bifet and Gavalda 2007: a window kept as exponentially growing buckets, cut where two parts differ."""

    def __init__(self, delta: float = 0.002, clock: int = 32, buckets: int = 5, min_length: int = 5, grace: int = 10):
        self.delta, self.clock, self.buckets = delta, clock, buckets
        self.min_length, self.grace = min_length, grace
        self.start()

    def start(self) -> None:
        self.ticks = self.width = 0
        self.total = self.var = 0.0
        self.rows: list[list[tuple[float, float]]] = [[]]  # level -> [(sum, variance sum)], newest first

    def feed(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        # the window itself forgets the old concept; nothing is reset
        drifts = []
        for i, v in enumerate(np.asarray(x, float).tolist()):
            self._insert(v)
            self.ticks += 1
            if self.ticks % self.clock == 0 and self._shrunk():
                drifts.append(i)
        return np.zeros(len(x), bool), drifts

    def _insert(self, x: float) -> None:
        if self.width:
            mean = self.total / self.width
            self.var += self.width * (x - mean) ** 2 / (self.width + 1)
        self.width += 1
        self.total += x
        self.rows[0].insert(0, (x, 0.0))
        level = 0
        while len(self.rows[level]) > self.buckets:
            if level + 1 == len(self.rows):
                self.rows.append([])
            (s1, v1), (s2, v2) = self.rows[level].pop(), self.rows[level].pop()
            size = 1 << level
            self.rows[level + 1].insert(0, (s1 + s2, v1 + v2 + size * (s1 / size - s2 / size) ** 2 / 2))
            level += 1

    def _drop_oldest(self) -> None:
        level = len(self.rows) - 1
        s, v = self.rows[level].pop()
        size = 1 << level
        self.width -= size
        self.total -= s
        if self.width:
            gap = s / size - self.total / self.width
            self.var = max(0.0, self.var - v - size * self.width * gap * gap / (size + self.width))
        else:
            self.var = 0.0
        while len(self.rows) > 1 and not self.rows[-1]:
            self.rows.pop()

    def _cut_found(self) -> bool:
        n0, s0 = 0, 0.0
        d = math.log(2 * math.log(self.width) / self.delta)
        spread = self.var / self.width
        for level in range(len(self.rows) - 1, -1, -1):
            for s, _ in reversed(self.rows[level]):
                n0 += 1 << level
                s0 += s
                n1 = self.width - n0
                if n1 < self.min_length + 1:
                    return False
                if n0 < self.min_length + 1:
                    continue
                m = 1 / (n0 - self.min_length + 1) + 1 / (n1 - self.min_length + 1)
                bound = math.sqrt(2 * m * spread * d) + 2 / 3 * d * m
                if abs(s0 / n0 - (self.total - s0) / n1) > bound:
                    return True
        return False

    def _shrunk(self) -> bool:
        found = False
        while self.width > self.grace and self._cut_found():
            found = True
            self._drop_oldest()
        return found


DETECTORS = {"ddm": DDM, "eddm": EDDM, "fhddm": FHDDM, "hddm_a": HDDM_A, "hddm_w": HDDM_W, "adwin": ADWIN}


def make_detector(name: str, params: dict | None = None) -> Detector:
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}")
    return DETECTORS[name](**(params or {}))


class WarningChain:
    """How far the history of a found drift reaches back, told from the positions of warnings and detections.

    A chain is a run of warnings at most ``grace`` rows apart, all after the last detection; it is alive fewer than ``grace`` rows
    after its last warning. A detection inside a chain or right after its end reaches back to ``sample`` rows before the chain's first
    warning, any other to ``sample`` rows before itself, but never beyond the detection before it.
    """

    def __init__(self, detector: Detector, grace: int = 3, sample: int = 100):
        self.detector, self.grace, self.sample = detector, grace, sample
        self.rows = 0
        self.detected = -1  # row of the last detection
        self.first = self.last = None  # first and last warning of the present chain

    def feed(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        """``(row, history, chain)`` of every detection in these rows."""
        return self.found(*self.detector.feed(x))

    def update(self, x: float) -> tuple[int, int, int] | None:
        self.detector.update(x)
        hits = self.found(np.array([self.detector.warning]), [0] if self.detector.drift else [])
        return hits[0] if hits else None

    def found(self, warned: np.ndarray, drifts: list[int]) -> list[tuple[int, int, int]]:
        warnings = np.flatnonzero(warned) + self.rows
        out = []
        for end in [*(d + self.rows for d in drifts), None]:
            upto = len(warnings) if end is None else int(np.searchsorted(warnings, end, "right"))
            self._extend(warnings[:upto])
            warnings = warnings[upto:]
            if end is None:
                break
            back = self.grace + 1 if self.last is None else end - self.last
            begin, alive = self.first if back <= self.grace else end, back < self.grace
            out.append((end, end - max(self.detected, begin - 1 - self.sample), end - begin + 1 if alive else 0))
            self.detected, self.first, self.last = end, None, None
        self.rows += len(warned)
        return out

    def _extend(self, warnings: np.ndarray) -> None:
        if not len(warnings):
            return
        gaps = np.diff(warnings, prepend=warnings[0] if self.last is None else self.last)
        breaks = np.flatnonzero(gaps > self.grace)
        if len(breaks):
            self.first = int(warnings[breaks[-1]])
        elif self.first is None:
            self.first = int(warnings[0])
        self.last = int(warnings[-1])
