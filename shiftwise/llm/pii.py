"""Personal data: rules for the certain cases, gradient-boosted trees over proposed spans for the rest.

Rules find emails, ip addresses, card and phone numbers; what they accept always stays. High-recall generators propose
further, overlapping spans (other separators, written-out "at" and "dot", every run of groups inside a number that a rule swallowed
whole and dropped). Boosted trees score them by format and context. They learn from the proposals of all documents:
one that overlaps an accepted span of its kind is positive, one that fails a test of its kind's rule which doesn't hang on the form
is negative (also every "x at y" without a dot), any other is no evidence and left out. The features leave out what the rules test (a
plus sign, an @, the check digit). Every proposal with evidence is scored once by trees that haven't seen its document (``FOLDS``); all
these scores calibrate the probabilities and give each kind the lowest threshold with the wanted precision, or none. A proposal
without evidence above its threshold that touches no accepted span is added.

The trees of all folds grow at once, a Spark job a level: tasks sum gradients by node, feature and bin over their blocks of proposals
(alike ones are counted once and weigh their number), the driver sees the sums and picks the splits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.llm.words import tidy
from shiftwise.session import work_path

KINDS = ("email", "ip", "card", "phone")  # fixed order of the contract
PRECISION = 0.99
FOLDS = 4
TASK_ROWS = 25_000  # distinct proposals of a task that grows trees
FAN = 32  # arrays that the driver adds up; more are added in tasks first
REWALKED = 8  # trees that each job walks again before the scores are stored anew
SCORE_STEPS = 1024  # log-odds are rounded to this part of one
MOST = 20 * SCORE_STEPS  # and held within 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?| at ", re.I)
BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]+$")
AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]+)*", re.I)
SWALLOWED = re.compile(r"[+0-9][ ().0-9-]*[0-9]")
PIECES = 12  # groups of a number in a row that are tried as spans
COUNTRY = re.compile(r"\+(?:[0-9]{1,3}[ -]?)?$")
NUMBER = re.compile(r"\+?\(?[0-9][0-9() .-]{5,28}[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def accepted(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the rules' spans, in order; every kind is read from left to right by itself.

    Time is linear in the text: each rule is anchored (at an ``@``, a maximal dotted or grouped number, a plus sign).
    """
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in DOTTED.finditer(text):
            at = m.start()
            parts = m[0].split(".")
            for i in range(0, len(parts) - 3, 4):  # the rule takes four parts at a time
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in four):
                    out.append((at, 1, at + size))
                at += size + 1
        for m in GROUPED.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in PLUS.finditer(text) if "+" in text else ():
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Overlapping candidate spans ``(start, kind number, end)``."""
    out = set()
    for m in AT.finditer(text):
        left = BEFORE_AT.search(text[max(0, m.start() - 64) : m.start()])
        right = AFTER_AT.match(text, m.end(), m.end() + 256)
        if left and right:
            out.add((m.start() - len(left[0]), 0, right.end()))
    if DIGIT.search(text):
        for m in DOTTED.finditer(text):
            if 1 <= m[0].count(".") <= 7:
                out.add((m.start(), 1, m.end()))
        for m in GROUPED.finditer(text):
            if 9 <= m.end() - m.start() <= 40:
                out.add((m.start(), 2, m.end()))
        for m in NUMBER.finditer(text):
            out.add((m.start(), 3, m.end()))
            for cut in re.finditer(r"(?<=[ (+.-])[0-9(]", m[0]):
                if len(digits_of(m[0][cut.start() :])) >= 7:
                    out.add((m.start() + cut.start(), 3, m.end()))
        for m in SWALLOWED.finditer(text):
            if m.end() - m.start() > 19 and " " in m[0]:
                out |= runs_inside(m[0], m.start())
    return sorted(out)


def runs_inside(number: str, at: int) -> set[tuple[int, int, int]]:
    """Runs of whole groups inside a long number that have a card's or a phone's count of digits."""
    pieces = [(g.start(), g.end(), len(digits_of(g[0]))) for g in re.finditer(r"[^ ]+", number)]
    out = set()
    for i, (start, _, _) in enumerate(pieces):
        n = 0
        for _, end, k in pieces[i : i + PIECES]:
            n += k
            if n > 19:
                break
            if (number[start] == "+" or number[start] == "(") and 9 <= n <= 15 and number[end - 1].isdigit():
                out.add((at + start, 3, at + end))
            if 12 <= n and number[start].isdigit() and number[end - 1].isdigit() and not set(number[start:end]) - set("0123456789 -"):
                out.add((at + start, 2, at + end))
    return out


FEATURES = 17
DOT = re.compile(r"[( \[]dot[) \]]", re.I)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a span; what the rules test is left out."""
    s = text[start:end].lstrip("+")
    groups = re.findall(r"[0-9]+", s)
    near = COUNTRY.sub("", text[max(0, start - 24) : start])  # a number looks alike with and without its country code
    before, after = near[-1:], text[end : end + 1]
    earlier = near.split()
    word = earlier[-1].strip(".,:;()").lower() if earlier else ""
    parts = [int(g[:6]) for g in groups[:8]]
    return [
        float(kind), len(s), sum(map(len, groups)), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(groups[-1]) if groups else 0, len(groups[0]) if groups else 0, s.count(".") + len(DOT.findall(s)), s.count("-"),
        0 if kind == 0 else s.count(" "), 0 if kind == 0 else s.count("("), max(parts, default=0), sum(c.isalpha() for c in s),
        3 if before.isalpha() else 2 if before.isdigit() else 1 if before not in ("", " ", "\n", "+", "(") else 0,
        3 if after.isalpha() else 2 if after.isdigit() else 1 if after not in ("", " ", "\n", ".", ",") else 0,
        len(word) * 4 + (2 if word.isdigit() else 1 if word.isalpha() else 0),
    ]


class Boosted:
    """Gradient-boosted trees of a fixed depth for a yes/no target; feature values are cut at quantiles."""

    def __init__(self, depth: int = 4, trees: int = 40, rate: float = 0.3, bins: int = 32):
        self.depth, self.trees, self.rate, self.bins = depth, trees, rate, bins
        self.base, self.grown, self.cuts = 0.0, [], []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def split(self, grad: np.ndarray, hess: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """``(feature, cut)`` per node of a level, and a value per node below, from sums by feature, node and bin."""
        grad, hess = grad.cumsum(axis=2), hess.cumsum(axis=2)
        nodes = grad.shape[1]
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, self.bins)
        best = np.full(nodes, 1e-9)
        for j, (g, h) in enumerate(zip(grad, hess)):
            gt, ht = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
            at = gain.argmax(axis=1)
            top = gain[np.arange(nodes), at]
            better = top > best
            best[better], feature[better], cut[better] = top[better], j, at[better]
        low = [a[feature, np.arange(nodes), cut] for a in (grad, hess)]
        g, h = (np.stack([x, a[0, :, -1] - x], axis=1).ravel() for x, a in zip(low, (grad, hess)))
        return (feature, cut), -self.rate * g / (h + 1)

    @staticmethod
    def place(inner: list, b: np.ndarray) -> np.ndarray:
        """Node of each row below the levels of ``inner``."""
        place, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for feature, cut in inner:
            place = place * 2 + (b[rows, feature[place]] > cut[place])
        return place

    @staticmethod
    def walked(trees: list, b: np.ndarray, score: np.ndarray) -> np.ndarray:
        return reduce(lambda s, t: s + t[1][Boosted.place(t[0], b)], trees, score)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds in whole steps."""
        return steps(self.walked(self.grown, self.binned(x), np.full(len(x), self.base)))


def steps(score: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(score * SCORE_STEPS), -MOST, MOST).astype(np.int64)


BLOCK = {"bins": np.uint8, "fold": np.int8, "kind": np.int8, "y": np.int8, "w": np.float64, "n": np.int64, "score": np.float64}
BLOCKS = ", ".join(f"{c} binary" for c in BLOCK)


def in_blocks(models: dict[int, Boosted], batches) -> Iterator[pa.RecordBatch]:
    """Distinct proposals as columns of numbers, a row a batch: bins and scores for each model, features in a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES)
        cols = {c: batch.column(c).to_numpy() for c in ("fold", "y", "w", "n")} | {"kind": x[:, 0]}
        cols["bins"] = np.stack([m.binned(x).T for m in models.values()])
        cols["score"] = np.repeat([m.base for m in models.values()], len(x))
        yield stored(cols)


def stored(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([cols[c].astype(t).tobytes()], pa.binary()) for c, t in BLOCK.items()], names=list(BLOCK))


def blocks(batches) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            b = {c: np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in BLOCK.items()}
            rows = len(b["fold"])
            yield b | {"bins": b["bins"].reshape(-1, FEATURES, rows), "score": b["score"].reshape(-1, rows)}


def rescored(trees: list[list], batches) -> Iterator[pa.RecordBatch]:
    """The blocks with scores by these trees of each model."""
    for b in blocks(batches):
        score = [Boosted.walked(t, x.T, s) for t, x, s in zip(trees, b["bins"], b["score"])]
        yield stored(b | {"score": np.stack(score)})


def level_sums(models: list[int], scale: list[float], cells: int, fresh: list[list], inner: list[list], batches) -> Iterator[pa.RecordBatch]:
    """Gradients and curvatures of a task by model, feature, node and bin; whole numbers, so that their sums don't hang on the order."""
    sums = np.zeros((len(models), 2, FEATURES, cells << len(inner[0])))
    for b in blocks(batches):
        for i, m in enumerate(models):
            use = b["fold"] != m
            x, y = b["bins"][i][:, use], b["y"][use]
            p = 1 / (1 + np.exp(-Boosted.walked(fresh[i], x.T, b["score"][i][use])))
            w = b["w"][use] * b["n"][use] * scale[i]
            parts = np.rint(w * (p - y)), np.rint(w * p * (1 - p))
            place = Boosted.place(inner[i], x.T) * cells
            for j in range(FEATURES):
                for k, part in enumerate(parts):
                    sums[i, k, j] += np.bincount(place + x[j], part, sums.shape[3])
    yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])


def added_up(batches) -> Iterator[pa.RecordBatch]:
    total = reduce(np.add, (np.frombuffer(s.as_buffer()) for batch in batches for s in batch.column("sums")), np.zeros(1))
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def summed(sums: DataFrame, parts: int) -> np.ndarray:
    """Sum of the arrays of ``parts`` tasks."""
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts).mapInArrow(added_up, "sums binary")
    return reduce(np.add, (np.frombuffer(r["sums"]) for r in sums.collect()))


def boost(start: DataFrame, models: dict[int, Boosted], rows: list[float], weight: list[float], parts: int) -> None:
    """Grows the trees of all models on the blocks ``start``; ``rows`` and ``weight`` are the totals each model learns from."""
    some = next(iter(models.values()))
    exact = [2.0 ** (51 - int(np.ceil(np.log2(n + 1)))) for n in rows]  # sums of whole numbers stay below 2^52
    scale = [e * n / w for e, n, w in zip(exact, rows, weight)]  # the mean weight is one
    work, fresh = start, [[] for _ in models]
    for _ in range(some.trees):
        inner: list[list] = [[] for _ in models]
        for level in range(some.depth):
            task = partial(level_sums, list(models), scale, some.bins + 1, fresh, inner)
            sums = summed(work.mapInArrow(task, "sums binary"), parts).reshape(len(models), 2, FEATURES, 1 << level, some.bins + 1)
            found = [m.split(*(s / e)) for m, s, e in zip(models.values(), sums, exact)]
            inner = [[*i, at] for i, (at, _) in zip(inner, found)]
        for m, f, i, (_, value) in zip(models.values(), fresh, inner, found):
            m.grown.append((i, value))
            f.append((i, value))
        if len(fresh[0]) == REWALKED:
            if work is not start:
                work.unpersist()
            work = start.mapInArrow(tidy(partial(rescored, [m.grown for m in models.values()])), BLOCKS).persist()
            fresh = [[] for _ in models]
    if work is not start:
        work.unpersist()


def held_out(models: list[int], trees: list[list], batches) -> Iterator[pa.RecordBatch]:
    """Number of proposals by kind, score of the trees that haven't seen them, label and weight."""
    for b in blocks(batches):
        z = np.zeros(len(b["fold"]), np.int64)
        for i, m in enumerate(models):
            own = b["fold"] == m
            z[own] = steps(Boosted.walked(trees[i], b["bins"][i][:, own].T, b["score"][i][own]))
        yield pa.RecordBatch.from_arrays([pa.array(b["kind"], pa.int32()), pa.array(z), pa.array(b["y"], pa.int32()), pa.array(b["w"]), pa.array(b["n"])], names=["kind", "z", "y", "w", "n"])


class Detector:
    """Trees and a threshold per kind; without trees only the rules hold. Thresholds are calibrated probabilities."""

    def __init__(self, trees: Boosted | None = None, thresholds: tuple[float, ...] = (2.0,) * 4, slope: float = 1.0, shift: float = 0.0, report: list[tuple] = ()):
        self.trees, self.thresholds, self.slope, self.shift = trees, thresholds, slope, shift
        self.report = report  # per kind: held-out positives, negatives, precision above the threshold, threshold

    def probability(self, x: np.ndarray) -> np.ndarray:
        return probability(self.trees.predict(x), self.slope, self.shift)

    def spans(self, texts: list[str]) -> list[tuple[list, list]]:
        """Per text the accepted spans and the added ones."""
        base = [accepted(t) for t in texts]
        extra: list[list] = [[] for _ in texts]
        if self.trees is not None and min(self.thresholds) <= 1:
            asked, rows = [], []
            for k, t in enumerate(texts):
                taken = Taken(base[k])
                for s, kind, e in proposals(t):
                    if self.thresholds[kind] <= 1 and not taken.touches(s, e) and not refuted(t, s, kind, e):
                        asked.append((k, s, kind, e))
                        rows.append(features(t, s, kind, e))
            if rows:
                p = self.probability(np.array(rows, np.float64))
                for i in np.argsort(-p, kind="stable"):
                    k, s, kind, e = asked[i]
                    if p[i] >= self.thresholds[kind] and not any(a < e and s < z for a, _, z in extra[k]):
                        extra[k].append((s, kind, e))
        return list(zip(base, map(sorted, extra)))


def probability(z: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-slope * (z / SCORE_STEPS) - shift))


class Taken:
    """Spans to test others against: starts in order, and the furthest end up to each."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [s for s, _, _ in spans]
        self.ends = list(accumulate((e for _, _, e in spans), max))

    def touches(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def refuted(text: str, start: int, kind: int, end: int) -> bool:
    """Whether a proposal that touches no accepted span fails its kind's rule by what it holds, not by its form."""
    s = text[start:end]
    if kind == 0:
        return "." not in s and not DOT.search(s)  # a host of one part
    digits = digits_of(s)
    if kind == 3:
        return not 9 <= len(digits) <= 15
    if kind == 2:
        return not (12 <= len(digits) <= 19 and luhn(digits))
    return True  # the rule has read the same number: its parts are wrong


def likely(text: str, start: int, kind: int, end: int, y: float) -> float:
    """Weight of a labelled proposal. Only numbers with a right check digit are ever asked for; of numbers that fail by it alone nine
    stand for one that passes by chance."""
    return 1 / 9 if kind == 2 and not y and 12 <= len(digits_of(text[start:end])) <= 19 else 1.0


def labelled_proposals(text: str) -> list[tuple[tuple[int, int, int], float]]:
    """Proposals for which there is evidence, and what it says; part of another kind's span is none."""
    base = accepted(text)
    of_kind, of_any = [Taken([x for x in base if x[1] == k]) for k in range(len(KINDS))], Taken(base)
    out = []
    for s, kind, e in proposals(text):
        near = of_kind[kind].touches(s, e)
        if near or not of_any.touches(s, e) and refuted(text, s, kind, e):
            out.append(((s, kind, e), float(near)))
    return out


def evidence(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(fold, y, w, x, n)``: distinct labelled proposals of all texts with fold, weight and features, and how many are alike."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.xxhash64(F.lit(5), F.struct(key)).alias("h"))

    def out(seen):
        cols = zip(*((*k, n) for k, n in seen.items()))
        kinds = pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["fold", "y", "w", "x", "n"])

    def learn(batches):
        for batch in batches:
            seen = Counter()
            for t, h in zip(batch.column("text"), batch.column("h").to_pylist()):
                value = t.as_py()
                for (s, kind, e), y in labelled_proposals(value):
                    x = tuple(map(int, features(value, s, kind, e)))
                    seen[h % FOLDS, int(y), likely(value, s, kind, e, y), x] += 1
                    if len(seen) >= 10_000:
                        yield out(seen)
                        seen.clear()
            if seen:
                yield out(seen)

    found = rows.mapInArrow(tidy(learn), "fold int, y int, w double, x array<int>, n long")
    return found.groupBy("fold", "y", "w", "x").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", precision: float = PRECISION, task_rows: int = TASK_ROWS) -> Detector:
    """Learn from every proposal of all texts for which there is evidence; totals, quantiles, sums and counts by score reach the driver."""
    path = work_path(df.sparkSession, "pii-evidence")
    evidence(df, text, key).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    totals = rows.groupBy("fold", "y", "w").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()
    folds = sorted({r["fold"] for r in totals})
    models = {m: Boosted() for m in [*folds, FOLDS]}  # the last leaves no fold out
    count, weight = [], []
    for m, model in models.items():
        of = [r for r in totals if r["fold"] != m]
        right = [r for r in of if r["y"]]
        if not 0 < len(right) < len(of):
            return Detector()
        count.append(sum(r["n"] for r in of))
        weight.append(sum(r["n"] * r["w"] for r in sorted(of)))
        share = np.clip(sum(r["n"] * r["w"] for r in sorted(right)) / weight[-1], 1e-4, 1 - 1e-4)
        model.base = float(np.log(share / (1 - share)))
    shares = [float(q) for q in np.linspace(0, 1, next(iter(models.values())).bins + 1)[1:-1]]
    at = [F.percentile(F.col("x")[j], shares, F.col("n")).alias(f"x{j}") for j in range(FEATURES)]  # a task keeps counts of distinct values only
    each = rows.withColumn("m", F.explode(F.lit(list(models)))).where("m <> fold")
    for r in each.groupBy("m").agg(*at).collect():
        models[r["m"]].cuts = [np.unique(r[f"x{j}"]) for j in range(FEATURES)]
    parts = -(-sum(r["distinct"] for r in totals) // task_rows)
    start = rows.repartition(parts).mapInArrow(tidy(partial(in_blocks, models)), BLOCKS).persist()
    boost(start, models, count, weight, parts)
    scored = start.mapInArrow(tidy(partial(held_out, folds, [models[f].grown for f in folds])), "kind int, z long, y int, w double, n long")
    got = sorted(scored.groupBy("kind", "z", "y", "w").agg(F.sum("n")).collect())
    start.unpersist()
    kind, z, y, w, n = (np.array(c) for c in zip(*got))
    slope, shift = calibrated(z / SCORE_STEPS, y, w * n)
    p = probability(z, slope, shift)
    thresholds, report = [], []
    for k in range(len(KINDS)):
        of = kind == k
        thresholds.append(lowest_threshold(p[of], y[of], precision, weight=w[of], count=n[of]))
        above = of & (p >= thresholds[-1])
        report.append((KINDS[k], int(n[of] @ y[of]), int(n[of] @ (1 - y[of])), float(np.average(y[above], weights=(w * n)[above])) if above.any() else None, thresholds[-1]))
    return Detector(models[FOLDS], tuple(thresholds), slope, shift, report)


def calibrated(z: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve over held-out log-odds, with one more right and wrong row so that it stays finite."""
    right, wrong = float(w @ y), float(w @ (1 - y))
    goal = np.where(y > 0, (right + 1) / (right + 2), 1 / (wrong + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-a * z - b))
        g = np.array([w @ ((q - goal) * z), w @ (q - goal)])
        v = w * q * (1 - q) + 1e-12
        h = np.array([[v @ (z * z) + 1e-6, v @ z], [v @ z, v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def lowest_threshold(p: np.ndarray, y: np.ndarray, precision: float, least: int = 20, weight: np.ndarray | None = None, count: np.ndarray | None = None) -> float:
    """Smallest probability, itself at least ``precision``, from which on the held-out precision (one error added) is reached; 2 if
    there is none or fewer than ``least`` rows reach it. A row may stand for a ``count`` of them."""
    w, c = (np.ones(len(p)) if a is None else a for a in (weight, count))
    order = np.argsort(-p, kind="stable")
    right, n, total = np.cumsum((c * w * y)[order]), np.cumsum(c[order]), np.cumsum((c * w)[order])
    one = max(w[y == 0], default=1.0)
    last_of_score = np.append(np.diff(p[order]) != 0, True) if len(p) else np.zeros(0, bool)
    good = np.flatnonzero(last_of_score & (right / (total + one) >= precision) & (n >= least))
    return max(precision, float(p[order][good[-1]])) if len(good) else 2.0


ADDED = ("pii_base", "pii_spans", "pii_text")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_spans(df: DataFrame, detector: Detector, text: str = "text", keep: list[str] | None = None, redact: bool = False, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """``keep`` (default: all columns) plus the first two or, with ``redact``, all three of ``added``: the rules' spans and all spans, arrays of
    (kind, start, end) in code points, end exclusive, by start and then kind; and the text where every stretch of overlapping spans is ``[KIND]``.

    A null text counts as empty (and stays null when redacted); the whole text is read, whatever its length; an empty
    table gives no rows; repeated rows are treated alike. A column of ``df`` that has one of the added names is left out, unless ``keep`` names it.
    """
    kept = [c for c in df.columns if c.lower() not in added] if keep is None else keep
    names = [f"_k{i}" for i in range(len(kept))]
    slim = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], *([] if text in kept else [F.col(text).alias("_text")]))
    read = names[kept.index(text)] if text in kept else "_text"  # a text travels once
    from shiftwise.llm.bpe import chunks

    def find(batches):
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for batch in batches:
            values = batch.column(read)
            for a, b in chunks(values, 4_000_000):
                texts = values.slice(a, b - a).to_pylist()
                found = detector.spans([t or "" for t in texts])
                cols = [batch.column(n).slice(a, b - a) for n in names]
                cols += [pa.array([named(x) for x, _ in found], kind_of), pa.array([named(sorted(x + y)) for x, y in found], kind_of)]
                if redact:
                    cols.append(pa.array([None if t is None else redacted(t, sorted(x + y)) for t, (x, y) in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    fields = [T.StructField(n, slim.schema[n].dataType) for n in names]
    fields += [T.StructField("pii_base", SPAN), T.StructField("pii_spans", SPAN)] + [T.StructField("pii_text", T.StringType())] * redact
    schema = T.StructType(fields)
    out = slim.mapInArrow(tidy(find), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], *[F.col(f.name).alias(n) for f, n in zip(fields[len(names) :], added)])


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at, n = [], 0, 0
    while n < len(spans):
        start, kind, end = spans[n]
        n += 1
        while n < len(spans) and spans[n][0] < end:
            end = max(end, spans[n][2])
            n += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_spans(docs, fit(docs), keep=["doc_id"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("pii_base"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))
