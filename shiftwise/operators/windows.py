"""Comparing windows through their prototypes.

Every measure takes a table of window pairs ``(window_a, window_b)`` and returns ``(window_a, window_b, score)``:
the same code serves one pair, one window against all, all pairs, and consecutive windows.
"""

from __future__ import annotations

import copy
import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.functions.columns import l2, mean_vector
from shiftwise.functions.numeric import expected_by_sizes, expected_mutual_information

PAIR = ["window_a", "window_b"]


def window_pairs(windows: DataFrame, block: int = 64) -> DataFrame:
    """All pairs a < b of the distinct ``window_id``.

    Windows are put into blocks; a window meets the others block by block, so the pairs are made by many tasks
    through an equi-join and no task pairs more than ``block`` x ``block`` windows.
    """
    ids = windows.select("window_id").distinct()
    top = ids.agg(F.max(F.floor(F.col("window_id") / block)).alias("_top"))  # one row
    blocked = ids.withColumn("_b", F.floor(F.col("window_id") / block)).join(F.broadcast(top), F.lit(True))
    left = blocked.select(F.col("window_id").alias("window_a"), F.col("_b").alias("_x"),
                          F.explode(F.sequence("_b", "_top")).alias("_y"))
    right = blocked.select(F.col("window_id").alias("window_b"), F.col("_b").alias("_y"),
                           F.explode(F.sequence(F.lit(0).cast("long"), "_b")).alias("_x"))
    return left.join(right, ["_x", "_y"]).where("window_a < window_b").select(*PAIR)


def consecutive_pairs(windows: DataFrame) -> DataFrame:
    """Pairs (w-1, w) of the windows that exist."""
    ids = windows.select("window_id").distinct()
    later = ids.select((F.col("window_id") - 1).alias("window_id"), F.col("window_id").alias("window_b"))
    return ids.join(later, "window_id").select(F.col("window_id").alias("window_a"), "window_b")


def centroids(protos: DataFrame) -> DataFrame:
    return protos.groupBy("window_id", "label").agg(mean_vector("features").alias("centroid"))


WIDE = 256  # windows a side of a block whose vectors meet in one task


def _in_blocks(pairs: DataFrame, vectors: DataFrame, run, schema: str) -> DataFrame:
    """Pairs and the vectors ``(window_id, label, v)`` they ask for, block by block of ``WIDE`` x ``WIDE`` windows.

    A vector travels once per block and not once per pair, so a pair costs little more than its two ids. ``run`` gets the two
    windows' numbers of every pair and, per class, the vectors of both sides (``_classes``).
    """
    keyed = pairs.where("window_a is not null and window_b is not null").select(
        *PAIR, *[F.floor(F.col(c) / WIDE).alias(k) for c, k in zip(PAIR, ("_x", "_y"))]
    )
    heads = keyed.select("_x", "_y").distinct()
    whole = vectors.select("window_id", "label", "v", F.exists("v", lambda e: e.isNull()).alias("_holes"))
    sides = [
        heads.join(whole.withColumn(k, F.floor(F.col("window_id") / WIDE)), k).select(F.col("_x").alias("_rx"), F.col("_y").alias("_ry"), F.lit(side).alias("_side"), *whole.columns)
        for side, k in enumerate(("_x", "_y"))
    ]
    met = sides[0].unionByName(sides[1])
    left = keyed.select(*PAIR, F.col("_x").alias("_lx"), F.col("_y").alias("_ly"))
    return left.groupBy("_lx", "_ly").cogroup(met.groupBy("_rx", "_ry")).applyInArrow(run, schema)


class _Vectors:
    """The vectors of one side and class in a block, in window order; ``own`` counts them per window, ``known`` tells the windows that
    have the class (a null vector is none, but its class is known)."""

    def __init__(self, table: pa.Table, windows: np.ndarray):
        ids, v = table["window_id"].to_numpy(), table["v"].combine_chunks()
        at = np.searchsorted(windows, ids)
        inside = at < len(windows)
        inside[inside] = windows[at[inside]] == ids[inside]
        self.known = np.zeros(len(windows), bool)
        self.known[at[inside]] = True
        kept = np.flatnonzero(inside & np.asarray(v.is_valid()))
        kept = kept[np.argsort(at[kept], kind="stable")]
        self.own = np.bincount(at[kept], minlength=len(windows))
        self.starts = (np.cumsum(self.own) - self.own)[self.own > 0]
        self.place = np.cumsum(self.own > 0) - 1  # of a window among those with vectors
        v = v.take(pa.array(kept))
        self.sizes = np.asarray(v.value_lengths())
        self.values, self.ends = v.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(self.sizes)
        self.sizes = np.where(np.asarray(table["_holes"].combine_chunks().take(pa.array(kept)).fill_null(False)).astype(bool), -1, self.sizes)


def _distances(a: _Vectors, b: _Vectors) -> tuple[np.ndarray, np.ndarray | None]:
    """Euclidean distances of all vectors of two sides, summed coordinate by coordinate; and which of them are null, if any."""
    if len(a.sizes) and len(b.sizes) and a.sizes[0] >= 0 and (a.sizes == a.sizes[0]).all() and (b.sizes == a.sizes[0]).all():
        return _spans(a.values.reshape(len(a.sizes), -1), b.values.reshape(len(b.sizes), -1)), None
    out, null = np.full((len(a.sizes), len(b.sizes)), np.nan), np.ones((len(a.sizes), len(b.sizes)), bool)
    for size in set(a.sizes[a.sizes >= 0]) & set(b.sizes[b.sizes >= 0]):
        i, j = np.flatnonzero(a.sizes == size), np.flatnonzero(b.sizes == size)
        x, y = (s.values[s.ends[k][:, None] - size + np.arange(size)] for s, k in ((a, i), (b, j)))
        out[np.ix_(i, j)], null[np.ix_(i, j)] = _spans(x, y), False
    return out, null


def _spans(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)))
    step = max(1, 32_768 // max(1, len(y)))
    columns = np.ascontiguousarray(y.T)
    for i in range(0, len(x), step):
        part = x[i : i + step]
        for k in range(x.shape[1]):
            gap = part[:, k, None] - columns[k]
            gap *= gap
            out[i : i + step] += gap
    return np.sqrt(out, out=out)


def _classes(pairs: pa.Table, vectors: pa.Table):
    """Numbers of the windows of every pair, and per class its name, the vectors of both sides and whether its name is null."""
    a, ia = np.unique(pairs["window_a"].to_numpy(), return_inverse=True)
    b, ib = np.unique(pairs["window_b"].to_numpy(), return_inverse=True)
    named = vectors["label"].combine_chunks().dictionary_encode()
    code, side = named.indices.fill_null(-1).to_numpy(zero_copy_only=False), vectors["_side"].to_numpy()

    def each():
        for c in sorted(set(code.tolist()), key=lambda c: (c < 0, named.dictionary[c].as_py() if c >= 0 else "")):
            mine = [vectors.filter(pa.array((code == c) & (side == s))) for s in (0, 1)]
            yield (named.dictionary[c].as_py() if c >= 0 else None), _Vectors(mine[0], a), _Vectors(mine[1], b)

    return ia, ib, each()


def _gaps(pairs: pa.Table, vectors: pa.Table, penalty: float):
    """Per class: its name, the pairs that have it on a side and their scores. A null class is like no other."""
    ia, ib, classes = _classes(pairs, vectors)
    for name, x, y in classes:
        in_a, in_b = x.known[ia], y.known[ib]
        if name is None:
            for one in (in_a, in_b):
                yield name, np.flatnonzero(one), np.full(int(one.sum()), penalty)
            continue
        some = np.flatnonzero(in_a | in_b)
        score = np.full(len(ia), penalty)
        both = np.flatnonzero((x.own > 0)[ia] & (y.own > 0)[ib])
        if len(both):
            far, null = _distances(x, y)
            i, j = x.place[ia[both]], y.place[ib[both]]
            score[both] = far[i, j] if null is None else np.where(null[i, j], penalty, far[i, j])
        yield name, some, score[some]


def _pair_rows(pairs: pa.Table, parts: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    """One table of parts ``(pair numbers, columns...)``; a single value fills its column."""
    out = []
    for at, *columns in parts:
        take = pa.array(at)
        made = [pairs[c].combine_chunks().take(take).cast(pa.int64()) for c in PAIR]
        made += [pa.array(v, t) if isinstance(v, np.ndarray) else v if isinstance(v, pa.Array) else pa.repeat(pa.scalar(v, t), len(at)) for v, (_, t) in zip(columns, fields)]
        out.append(pa.table(made, names=[*PAIR, *[n for n, _ in fields]]))
    schema = pa.schema([(c, pa.int64()) for c in PAIR] + fields)
    return pa.concat_tables(out) if out else schema.empty_table()


def _means(protos: DataFrame) -> DataFrame:
    return centroids(protos).select("window_id", F.col("label").cast("string").alias("label"), F.col("centroid").alias("v"))


def class_displacement(pairs: DataFrame, protos: DataFrame, penalty: float = 10.0) -> DataFrame:
    """M5 per class: distance of the class centroids; ``penalty`` when one window lacks the class."""

    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        parts = [(at, name, score) for name, at, score in _gaps(pairs, vectors, penalty)]
        return _pair_rows(pairs, parts, [("label", pa.string()), ("score", pa.float64())])

    found = _in_blocks(pairs, _means(protos), run, "window_a long, window_b long, label string, score double")
    return found.withColumn("label", F.col("label").cast(dict(protos.dtypes)["label"]))


def centroid_displacement(
    pairs: DataFrame, protos: DataFrame, strategy: str = "total", penalty: float | None = None
) -> DataFrame:
    """M5: mean over classes; the penalty of a missing class is 2 in total and 10 class by class."""
    penalty = penalty if penalty is not None else {"total": 2.0, "class": 10.0}[strategy]

    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        total, n = np.zeros(pairs.num_rows), np.zeros(pairs.num_rows)
        for _, at, score in _gaps(pairs, vectors, penalty):
            total[at] += score
            n[at] += 1
        at = np.flatnonzero(n)
        return _pair_rows(pairs, [(at, total[at] / n[at])], [("score", pa.float64())])

    return _in_blocks(pairs, _means(protos), run, "window_a long, window_b long, score double")


def class_minimal_distances(pairs: DataFrame, protos: DataFrame, penalty: float = 2.0) -> DataFrame:
    """``(pair, label, n, total, missing)``: nearest distances, one per prototype of the larger set."""

    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        ia, ib, classes = _classes(pairs, vectors)
        parts = []
        for name, x, y in classes:
            na, nb = x.own[ia], y.own[ib]
            if name is None:
                for known, n in ((x.known[ia], na), (y.known[ib], nb)):
                    at = np.flatnonzero(known)
                    parts.append((at, name, n[at], n[at] * penalty, True))
                continue
            in_a, in_b, n = x.known[ia], y.known[ib], np.maximum(na, nb)
            lacking, total = ~(in_a & in_b), n * penalty
            null = ~lacking & (np.minimum(na, nb) == 0) & (n > 0)
            both = np.flatnonzero((na > 0) & (nb > 0))
            if len(both):
                far, hidden = _distances(x, y)
                i, j = x.place[ia[both]], y.place[ib[both]]
                # equal sizes: one distance per prototype of the second set
                of_a = np.add.reduceat(np.fmin.reduceat(far, y.starts, axis=1), x.starts, axis=0)
                of_b = np.add.reduceat(np.fmin.reduceat(far, x.starts, axis=0), y.starts, axis=1)
                more = na[both] > nb[both]
                total[both] = np.where(more, of_a[i, j], of_b[i, j])
                if hidden is not None:
                    seen = (~hidden).astype(int)
                    no_a = np.add.reduceat(np.add.reduceat(seen, y.starts, axis=1) == 0, x.starts, axis=0, dtype=int)
                    no_b = np.add.reduceat(np.add.reduceat(seen, x.starts, axis=0) == 0, y.starts, axis=1, dtype=int)
                    null[both] = np.where(more, no_a[i, j], no_b[i, j]) > 0
            at = np.flatnonzero(in_a | in_b)
            parts.append((at, name, n[at], pa.array(total[at], pa.float64(), mask=null[at]), lacking[at]))
        return _pair_rows(pairs, parts, [("label", pa.string()), ("n", pa.int32()), ("total", pa.float64()), ("missing", pa.bool_())])

    listed = protos.select("window_id", F.col("label").cast("string").alias("label"), F.col("features").alias("v"))
    found = _in_blocks(pairs, listed, run, "window_a long, window_b long, label string, n int, total double, missing boolean")
    return found.withColumn("label", F.col("label").cast(dict(protos.dtypes)["label"]))


def minimal_distance(
    pairs: DataFrame, protos: DataFrame, strategy: str = "total", penalty: float = 2.0
) -> DataFrame:
    """M6: pooled mean of the nearest distances, or mean over classes (a missing class counts penalty x size)."""
    per_class = class_minimal_distances(pairs, protos, penalty)
    if strategy == "class":
        value = F.when(F.col("missing"), F.col("total")).otherwise(F.col("total") / F.col("n"))
        return per_class.groupBy(*PAIR).agg(F.avg(value).alias("score"))
    return per_class.groupBy(*PAIR).agg((F.sum("total") / F.sum("n")).alias("score"))


BLOCK = {"window_a": 256, "window_b": 64}  # windows a side of a block; many sets meet the rows of a window at once


def _with_partners(
    pairs: DataFrame, protos: DataFrame, rows: DataFrame, distance: str, measure, schema: str
) -> DataFrame:
    """Run ``measure(window_b, its rows, its own prototypes, the windows_a it meets, their sets)`` and return its tables.

    A group is a block of 256 x 64 windows at most, all of them bounded by the window size. Vectors travel once per block,
    so a pair costs little more than its two ids, and distances are computed inside the task.
    """
    keyed = pairs.where("window_a is not null and window_b is not null").select(
        *PAIR, *[F.floor(F.col(c) / BLOCK[c]).alias(k) for c, k in zip(PAIR, ("_x", "_y"))]
    )
    heads = keyed.select("_x", "_y").distinct()
    value = "features" if distance == "l2" else "leaves"
    placed = lambda df, k: heads.join(df.withColumn(k, F.floor(F.col("window_id") / BLOCK[dict(zip(("_x", "_y"), PAIR))[k]])), k)
    right_keys = [F.col("_x").alias("_rx"), F.col("_y").alias("_ry")]
    listed = protos.select("window_id", "label", "proto_rank", F.col(value).alias("v"))
    empty = [F.lit(None).cast(listed.schema[c].dataType).alias(c) for c in ("label", "proto_rank", "v")]
    sets = placed(listed, "_x").select(*right_keys, F.lit(0).alias("_side"), F.col("window_id").alias("window_a"),
                                       F.lit(None).cast("long").alias("window_b"), "label", "proto_rank", "v")
    own = placed(listed, "_y").select(*right_keys, F.lit(1).alias("_side"), F.lit(None).cast("long").alias("window_a"),
                                      F.col("window_id").alias("window_b"), "label", "proto_rank", "v")
    asked = keyed.select(*right_keys, F.lit(2).alias("_side"), *PAIR, *empty)
    right = sets.unionByName(own).unionByName(asked)
    left = placed(rows.select("window_id", "idx", "label", F.col(value).alias("v")), "_y").select(
        F.col("_x").alias("_lx"), F.col("_y").alias("_ly"), F.col("window_id").alias("_window"), "idx", "label", "v"
    )

    def run(x: pa.Table, r: pa.Table) -> pa.Table:
        fields = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")])
        side = r["_side"].to_numpy()
        asked = r.filter(pa.array(side == 2))
        of_a, of_b = (asked[c].to_numpy().astype(np.int64) for c in PAIR)
        protos = r.filter(pa.array(side < 2)).to_pandas().sort_values(["label", "proto_rank"])
        known = {s: {int(w): g for w, g in protos[protos["_side"] == s].groupby(c)} for s, c in ((0, "window_a"), (1, "window_b"))}
        of_window = {int(w): g.sort_values("idx") for w, g in x.to_pandas().groupby("_window")}
        partners = _Partners({a: known[0][a] for a in np.unique(of_a).tolist() if a in known[0]}, distance)
        out = []
        for b in np.unique(of_b).tolist():
            mine = of_window.get(b)
            if mine is not None:
                met, sets = partners.of(np.unique(of_a[of_b == b]))
                if len(met):
                    out.append(measure(b, mine, known[1].get(b, protos.iloc[:0]), met, sets).cast(fields))
        return pa.concat_tables(out) if out else fields.empty_table()

    return left.groupBy("_lx", "_ly").cogroup(right.groupBy("_rx", "_ry")).applyInArrow(run, schema)


def _far(x: np.ndarray, p: np.ndarray, distance: str) -> np.ndarray:
    """Rows x prototypes: Euclidean distance, or minus the number of shared leaves."""
    if distance == "l2":
        return np.sqrt(((x[:, None, :] - p[None, :, :]) ** 2).sum(axis=2))
    return -(x[:, None, :] == p[None, :, :]).sum(axis=2).astype(float)


def _apart(x: np.ndarray, i: np.ndarray, p: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows ``i`` and the prototypes ``j``, one by one, as ``_far`` computes them."""
    out, step = np.empty(len(i)), max(1, 1_000_000 // max(1, x.shape[1]))
    for k in range(0, len(i), step):
        out[k : k + step] = np.sqrt(((x[i[k : k + step]] - p[j[k : k + step]]) ** 2).sum(axis=1))
    return out


ROWS = 1024  # of a window that meet the sets at once


class _Sets:
    """The prototypes of several windows. Sets lie in falling order of size, so those with a ``k``-th prototype are the first ones.

    Products give squared distances (less the row's own square, which is the same for all); ``slack`` is beyond their rounding. Where
    it could decide, distances are computed as ``_far`` does. ``plain`` tells that products can be used; they are single-precision
    (``kind``) until too many of them leave doubt.
    """

    def __init__(self, sets: list[pd.DataFrame], distance: str):
        self.distance, self.picked = distance, slice(None)
        sizes = np.array([len(s) for s in sets])
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.points = np.concatenate([np.stack(sets[i]["v"].to_numpy()) for i in self.order])
        self.labels = np.concatenate([sets[i]["label"].to_numpy() for i in self.order])
        self.names, self.codes = np.unique(self.labels.astype(str), return_inverse=True)
        self.plain = distance == "l2"
        if self.plain:
            with np.errstate(over="ignore", invalid="ignore"):
                squares = (self.points * self.points).sum(axis=1)
            self.plain = bool((squares < 1e300).all())
        if self.plain:
            self.top = np.maximum.reduceat(squares, self.starts)
            self.places = [self.starts[: np.searchsorted(-self.sizes, -k)] + k for k in range(self.sizes[0])]
            self._lay(np.float32 if (squares < 1e20).all() else np.float64)

    def _lay(self, kind: type) -> None:
        self.kind = kind
        sided = np.column_stack([-2.0 * self.points, (self.points * self.points).sum(axis=1)]).astype(kind)
        self.sided = [sided[at] for at in self.places]

    def given(self, found: np.ndarray) -> np.ndarray:
        """Results of the picked sets, in the order in which they were given."""
        out = np.empty_like(found)
        out[self.order] = found
        return out[self.picked]

    def squares(self, x: np.ndarray) -> np.ndarray | None:
        """Squares of the rows, or none where products can't be used."""
        if not self.plain:
            return None
        with np.errstate(over="ignore", invalid="ignore"):
            x2 = (x * x).sum(axis=1)
        if not (x2 < 1e300).all():
            return None
        if self.kind is np.float32 and not (x2 < 1e20).all():
            self._lay(np.float64)
        return x2

    def slack(self, x2: np.ndarray) -> np.ndarray:
        """Twice what the rounding of two products can come to, and more; the last summand is for numbers too small for ``kind``."""
        share = 4 * (self.points.shape[1] + 4) * np.finfo(self.kind).eps
        return (share * (x2 + 2 * self.top[:, None]) + (1e-30 if self.kind is np.float32 else 0)).astype(self.kind)

    def lowest(self, x: np.ndarray, x2: np.ndarray, each=None) -> tuple[np.ndarray, np.ndarray]:
        """Sets x rows: the least product and its place in the set, the first on a tie. ``each`` sees the products of every place, and
        sees them all again where doubles are needed."""
        slack = self.slack(x2)
        sided = np.vstack([x.T, np.ones(len(x))]).astype(self.kind)
        shape = (len(self.sizes), len(x))
        near, low, high, second = (np.empty(shape, self.kind) for _ in range(4))
        second.fill(np.inf)
        less, number = np.empty(shape, bool), np.int8 if len(self.sided) < 128 else np.int32
        here, at = np.empty(shape, number), np.zeros(shape, number)
        for k, points in enumerate(self.sided):
            n = len(points)
            found = np.matmul(points, sided, out=near[:n] if k else low)
            if each is not None:
                each(k, found, slack)
            if k:
                np.less(found, low[:n], out=less[:n])
                np.maximum(found, low[:n], out=high[:n])
                np.minimum(second[:n], high[:n], out=second[:n])
                np.minimum(low[:n], found, out=low[:n])
                np.multiply(less[:n].view(np.int8), number(k), out=here[:n])
                np.maximum(at[:n], here[:n], out=at[:n])  # places rise, so the last one that was less is the highest
        np.subtract(second, low, out=second)
        s, i = np.nonzero(np.less_equal(second, slack, out=less))
        if self.kind is np.float32 and 16 * len(s) > less.size:
            self._lay(np.float64)
            return self.lowest(x, x2, each)
        for k in range(0, len(s), 100_000):
            at[s[k : k + 100_000], i[k : k + 100_000]] = self._first(x, s[k : k + 100_000], i[k : k + 100_000])
        return low, at

    def _first(self, x: np.ndarray, s: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The place of the nearest prototype of the sets ``s`` to the rows ``i``, one by one, from the distances themselves."""
        sizes = self.sizes[s]
        starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
        place = np.arange(ends[-1]) - np.repeat(starts, sizes)
        far = _apart(x, np.repeat(i, sizes), self.points, np.repeat(self.starts[s], sizes) + place)
        least = np.flatnonzero(far == np.repeat(np.minimum.reduceat(far, starts), sizes))
        return place[least[np.searchsorted(least, starts)]]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets x rows: the place of the nearest in its set, the first on a tie, and whether there is one."""
        x2 = self.squares(x)
        if x2 is None:
            far = [_far(x, part, self.distance) for part in np.split(self.points, self.starts[1:])]
            at = np.stack([f.argmin(axis=1) for f in far])
            some = np.stack([f.min(axis=1) < 0 for f in far]) if self.distance != "l2" else np.ones(at.shape, bool)
            return self.given(at), self.given(some)
        at = [self.lowest(x[k : k + ROWS], x2[k : k + ROWS])[1] for k in range(0, len(x), ROWS)]
        at = self.given(np.concatenate(at, axis=1))
        return at, np.ones(at.shape, bool)


class _Partners:
    """The sets of a block's windows_a: those that most windows_b meet are laid out once, a few are laid out when asked for."""

    def __init__(self, known: dict[int, pd.DataFrame], distance: str):
        self.known, self.distance, self.ids, self.made = known, distance, np.array(sorted(known), np.int64), None
        self.alike = len({len(v) for g in known.values() for v in g["v"] if v is not None}) < 2

    def of(self, asked: np.ndarray) -> tuple[np.ndarray, _Sets | None]:
        met = np.intersect1d(asked, self.ids, assume_unique=True)
        if not len(met):
            return met, None
        if len(met) < len(self.ids) and not (self.alike and 2 * len(met) > len(self.ids)):
            return met, _Sets([self.known[a] for a in met.tolist()], self.distance)
        if self.made is None:
            self.made = _Sets([self.known[a] for a in self.ids.tolist()], self.distance)
        some = copy.copy(self.made)
        some.picked = np.searchsorted(self.ids, met)
        return met, some


def assignment_pairs(
    pairs: DataFrame, protos: DataFrame, rows: DataFrame, assign_to: str = "prototype", distance: str = "l2"
) -> DataFrame:
    """M8: rows of the second window assigned by the prototypes of either: ``(pair, idx, in_a, in_b)``.

    Ids count the prototypes of a window in class and rank order; no shared leaf gives -1.
    """
    if assign_to not in ("prototype", "class"):
        raise ValueError(f"invalid assign_to: {assign_to}")

    def measure(b: int, x: pd.DataFrame, own: pd.DataFrame, met: np.ndarray, sets: _Sets) -> pa.Table:
        v, idx = np.stack(x["v"].to_numpy()), x["idx"].to_numpy()
        columns = [np.repeat(met, len(v)), np.full(len(met) * len(v), b), np.tile(idx, len(met))]
        texts = [_named(at, some, of, assign_to) for at, some, of in ((*sets.nearest(v), sets), _own(v, own, distance))]
        own_text = texts[1].take(pa.array(np.tile(np.arange(len(v)), len(met))))
        return pa.table([*map(pa.array, columns), texts[0], own_text], names=["window_a", "window_b", "idx", "in_a", "in_b"])

    made = _with_partners(pairs, protos, rows, distance, measure,
                          "window_a long, window_b long, idx long, in_a string, in_b string")
    if assign_to == "prototype":
        made._in_task = functools.partial(_scored_in_task, pairs, protos, rows, distance)
    return made


def _own(v: np.ndarray, own: pd.DataFrame, distance: str) -> tuple[np.ndarray, np.ndarray, _Sets | None]:
    """The nearest of a window's own prototypes, as one set."""
    if not len(own):
        return np.zeros((1, len(v)), int), np.zeros((1, len(v)), bool), None
    sets = _Sets([own], distance)
    return *sets.nearest(v), sets


def _named(at: np.ndarray, some: np.ndarray, sets: _Sets | None, assign_to: str) -> pa.Array:
    """Names of the prototypes or classes, set after set; -1 where there is none."""
    if sets is None:
        return pa.repeat(pa.scalar("-1"), at.size)
    if assign_to == "prototype":
        known, code = [str(i) for i in range(sets.sizes.max())], at
    else:
        known, code = sets.labels.tolist(), sets.given(sets.starts)[:, None] + at
    return pa.array([*known, "-1"], pa.string()).take(pa.array(np.where(some, code, len(known)).ravel()))


def _scored_in_task(pairs: DataFrame, protos: DataFrame, rows: DataFrame, distance: str, score) -> DataFrame:
    """``score(assignments in a, sets x rows; in b, rows)`` of every pair, made in the task that assigns the rows: no assignment travels."""

    def measure(b: int, x: pd.DataFrame, own: pd.DataFrame, met: np.ndarray, sets: _Sets) -> pa.Table:
        v = np.stack(x["v"].to_numpy())
        (in_a, some_a), (in_b, some_b, _) = sets.nearest(v), _own(v, own, distance)
        found = score(np.where(some_a, in_a, -1), np.where(some_b, in_b, -1)[0])
        return pa.table([pa.array(met), pa.array(np.full(len(met), b)), pa.array(found, pa.float64())], names=[*PAIR, "score"])

    return _with_partners(pairs, protos, rows, distance, measure, "window_a long, window_b long, score double")


class _Counts:
    """Contingency tables of several assignments ``a`` (sets x rows) with one ``b`` of the same rows: the sizes of the cells and of the
    groups of a with their sets, the sizes of the groups of b, and the number of rows."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.sets, self.t = a.shape
        self.of_cell, self.n = self._sizes((a + 1).astype(np.int64) * (int(b.max()) + 2) + (b + 1))
        self.of_a, self.na = self._sizes(a)
        self.nb = self._sizes(b[None, :])[1]

    @staticmethod
    def _sizes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the groups of equal codes of every line, and their lines."""
        codes = np.sort(codes, axis=1)
        new = np.ones(codes.shape, bool)
        new[:, 1:] = codes[:, 1:] != codes[:, :-1]
        at = np.flatnonzero(new)
        return at // codes.shape[1], np.diff(np.append(at, codes.size))

    def per_set(self, f) -> tuple[np.ndarray, np.ndarray, float]:
        """Sums of ``f`` of the sizes: of cells and of groups of a per set, and of groups of b."""
        return np.bincount(self.of_cell, f(self.n), self.sets), np.bincount(self.of_a, f(self.na), self.sets), float(f(self.nb).sum())


def contingency(assigned: DataFrame) -> DataFrame:
    """``(pair, in_a, in_b, n)`` plus the marginals ``na``, ``nb`` and the total ``t``.

    Assignments are dealt by pair once; counts, marginals and totals of a pair come from its own task. Where they come straight from
    ``assignment_pairs``, scores of the cells are made from counts in the task that assigns the rows (``_in_task``).
    """
    cells = assigned.select(*PAIR, "in_a", "in_b").repartition(*PAIR).groupBy(*PAIR, "in_a", "in_b").agg(F.count(F.lit(1)).alias("n"))

    def within(*keys: str) -> Column:
        return F.sum("n").over(Window.partitionBy(*PAIR, *keys))

    cells = cells.select("*", within("in_a").alias("na"), within("in_b").alias("nb"), within().alias("t"))
    if in_task := vars(assigned).get("_in_task"):
        cells._in_task = functools.partial(_counted_in_task, in_task)
    return cells


def _counted_in_task(in_task, score) -> DataFrame:
    return in_task(lambda a, b: score(_Counts(a, b)))


def _pair_counts(cells: DataFrame) -> DataFrame:
    """Pairs of rows together in both (``both``), in a, in b, and all."""

    def choose2(c: Column) -> Column:
        return c * (c - 1) / 2.0

    # a marginal appears once per cell of its row: weigh it by n / marginal
    return cells.groupBy(*PAIR).agg(
        F.sum(choose2(F.col("n"))).alias("both"),
        F.sum((F.col("na") - 1) * F.col("n") / 2.0).alias("in_a"),
        F.sum((F.col("nb") - 1) * F.col("n") / 2.0).alias("in_b"),
        choose2(F.max("t")).alias("all"),
    )


def adjusted_rand(cells: DataFrame) -> DataFrame:
    """M2; 1 when both assignments are trivial in the same way."""
    if in_task := vars(cells).get("_in_task"):
        return in_task(_rand_scores)
    expected = F.col("in_a") * F.col("in_b") / F.col("all")
    mean = (F.col("in_a") + F.col("in_b")) / 2
    score = F.when((F.col("all") == 0) | (mean == expected), 1.0).otherwise((F.col("both") - expected) / (mean - expected))
    return _pair_counts(cells).select(*PAIR, score.alias("score"))


def _rand_scores(counts: _Counts) -> np.ndarray:
    """``adjusted_rand`` of the tables of one task."""
    both, in_a, in_b = counts.per_set(lambda n: n * (n - 1) / 2.0)
    every = counts.t * (counts.t - 1) / 2.0
    with np.errstate(divide="ignore", invalid="ignore"):
        expected, mean = in_a * in_b / every, (in_a + in_b) / 2
        return np.where((every == 0) | (mean == expected), 1.0, (both - expected) / (mean - expected))


def fowlkes_mallows(cells: DataFrame) -> DataFrame:
    """M3."""
    score = F.when(F.col("both") > 0, F.sqrt(F.col("both") / F.col("in_a")) * F.sqrt(F.col("both") / F.col("in_b")))
    return _pair_counts(cells).select(*PAIR, score.otherwise(0.0).alias("score"))


def completeness(cells: DataFrame) -> DataFrame:
    """M4: 1 - H(b given a) / H(b), with a as the true classes; 1 when b has one group."""
    n, t = F.col("n"), F.col("t")
    stats = cells.groupBy(*PAIR).agg(
        F.sum(n / t * F.log(n * t / (F.col("na").cast("double") * F.col("nb")))).alias("mi"),
        F.sum(-n / t * F.log(F.col("nb") / t)).alias("hb"),
    )
    score = F.when(F.col("hb") == 0, 1.0).otherwise(F.col("mi") / F.col("hb"))
    return stats.select(*PAIR, score.alias("score"))


@F.pandas_udf(T.DoubleType())
def _ami(cells: pd.Series) -> pd.Series:
    out = []
    for entry in cells:
        seen = pd.DataFrame(list(entry))
        a, b = seen.groupby("in_a")["n"].sum().to_numpy(), seen.groupby("in_b")["n"].sum().to_numpy()
        t = a.sum()
        if len(a) == len(b) == 1 or (len(a) == len(b) == t):
            out.append(1.0)
            continue
        n, na, nb = (seen[c].to_numpy(dtype=float) for c in ("n", "na", "nb"))
        mi = float((n / t * np.log(n * t / (na * nb))).sum())
        h = [float(-(m / t * np.log(m / t)).sum()) for m in (a.astype(float), b.astype(float))]
        emi = expected_mutual_information(a, b)
        top, bottom = mi - emi, (h[0] + h[1]) / 2 - emi
        eps = np.finfo(float).eps
        bottom = min(bottom, -eps) if bottom < 0 else max(bottom, eps)
        out.append(top / bottom)
    return pd.Series(out)


def adjusted_mutual_info(cells: DataFrame) -> DataFrame:
    """M1: mutual information against its expectation, arithmetic mean of the entropies.

    A contingency table has at most (prototypes of a) x (prototypes of b) cells.
    """
    if in_task := vars(cells).get("_in_task"):
        return in_task(_ami_scores)
    listed = cells.groupBy(*PAIR).agg(F.collect_list(F.struct("in_a", "in_b", "n", "na", "nb")).alias("_c"))
    return listed.select(*PAIR, _ami("_c").alias("score"))


def _ami_scores(counts: _Counts) -> np.ndarray:
    """``adjusted_mutual_info`` of the tables of one task: entropies and expectations depend on the sizes of the groups alone."""
    t = counts.t
    cells, in_a, in_b = counts.per_set(lambda n: n * np.log(n))
    mi, ha, hb = np.log(t) + (cells - in_a - in_b) / t, np.log(t) - in_a / t, np.log(t) - in_b / t
    emi = np.bincount(counts.of_a, expected_by_sizes(counts.na, counts.nb), counts.sets)
    bottom = (ha + hb) / 2 - emi
    eps = np.finfo(float).eps
    groups, own = np.bincount(counts.of_a, minlength=counts.sets), len(counts.nb)
    alike = (groups == own) & ((own == 1) | (own == t))
    return np.where(alike, 1.0, (mi - emi) / np.where(bottom < 0, np.minimum(bottom, -eps), np.maximum(bottom, eps)))


def reassignment_impact(pairs: DataFrame, protos: DataFrame, rows: DataFrame, distance: str = "l2") -> DataFrame:
    """M7: mean absolute accuracy change when one foreign prototype is added, mean of both directions.

    A row's new class follows from its current best and the candidate's distance, so no prediction is redone.
    """

    def best(far: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = far.argmin(axis=1)
        d, label = far[np.arange(len(far)), at], label[at]
        return d, np.where(d >= 0, "", label) if distance != "l2" else label

    def one_way(y, d, label, far: np.ndarray, candidates: np.ndarray) -> float:
        wins = (far < d[:, None]) | ((far == d[:, None]) & (candidates[None, :] < label[:, None]))
        if distance != "l2":
            wins &= far < 0
        gain = (candidates[None, :] == y[:, None]).astype(int) - (label == y)[:, None].astype(int)
        return float(np.abs(np.where(wins, gain, 0).mean(axis=0)).mean())

    def one_by_one(v, y, own, own_label, sets: _Sets) -> np.ndarray:
        far_b = _far(v, own, distance)
        d_b, l_b = best(far_b, own_label)
        out = []
        for p, label in zip(np.split(sets.points, sets.starts[1:]), np.split(sets.labels, sets.starts[1:])):
            far_a = _far(v, p, distance)
            d_a, l_a = best(far_a, label)
            to_b = one_way(y, d_b, l_b.astype(str), far_a, label.astype(str))
            to_a = one_way(y, d_a, l_a.astype(str), far_b, own_label.astype(str))
            out.append((to_a + to_b) / 2)
        return sets.given(np.array(out))

    def measure(b: int, x: pd.DataFrame, own: pd.DataFrame, met: np.ndarray, sets: _Sets) -> pa.Table:
        v, y = np.stack(x["v"].to_numpy()), x["label"].to_numpy().astype(str)
        found = pa.nulls(len(met), pa.float64())
        if len(own):
            p, label = np.stack(own["v"].to_numpy()), own["label"].to_numpy()
            plain = sets.squares(v) is not None and np.isfinite(p).all()
            found = pa.array(_impacts(v, y, p, label.astype(str), sets) if plain else one_by_one(v, y, p, label, sets))
        return pa.table([pa.array(met), pa.array(np.full(len(met), b)), found], names=[*PAIR, "score"])

    return _with_partners(pairs, protos, rows, distance, measure, "window_a long, window_b long, score double")


def _impacts(x: np.ndarray, y: np.ndarray, own: np.ndarray, own_label: np.ndarray, sets: _Sets) -> np.ndarray:
    """``reassignment_impact`` of one window with all sets; labels are numbered in their order, gains are whole numbers."""
    names = np.unique(np.concatenate([sets.names, own_label, y]))
    y, mine, theirs = (np.searchsorted(names, n) for n in (y, own_label, sets.names))
    theirs = theirs[sets.codes]
    to_b, to_a = np.zeros(len(sets.points)), np.zeros((len(own), len(sets.sizes)))
    step = max(1, min(ROWS, 4_000_000 // max(1, own.size)))
    for k in range(0, len(x), step):
        _add_gains(x[k : k + step], y[k : k + step], own, mine, sets, theirs, to_b, to_a)
    one = np.add.reduceat(np.abs(to_b), sets.starts) / sets.sizes
    return sets.given((one + np.abs(to_a).mean(axis=0)) / (2 * len(x)))


def _add_gains(x, y, own, mine, sets: _Sets, theirs, to_b: np.ndarray, to_a: np.ndarray) -> None:
    """Adds the rows won or lost: to ``to_b`` by each prototype of the sets beside all own ones, to ``to_a`` (own x sets) the other way.

    Products decide; where rounding could, distances do, and a tie goes to the lower label.
    """
    x2 = sets.squares(x)
    far_b = _far(x, own, "l2")
    at_b = far_b.argmin(axis=1)
    d_b, label_b = far_b[np.arange(len(x)), at_b], mine[at_b]
    gain = (np.arange(max(theirs.max(), mine.max()) + 1)[:, None] == y).astype(np.float32) - (label_b == y)
    line, doubt, added = d_b * d_b - x2, [], np.zeros(len(to_b))

    def each(k: int, near: np.ndarray, slack: np.ndarray) -> None:
        if k == 0:
            doubt.clear()
        at = sets.places[k]
        over = near - line.astype(near.dtype)
        wins = over < 0
        added[at] = (wins.astype(np.float32) @ gain.T)[np.arange(len(at)), theirs[at]]
        close = np.flatnonzero(np.abs(over, out=over) <= slack[: len(at)])
        if len(close):
            doubt.append((at[close // len(x)], close % len(x), wins.ravel()[close]))

    low, at_a = sets.lowest(x, x2, each)
    to_b += added
    if doubt:
        j, i, won = map(np.concatenate, zip(*doubt))
        far = _apart(x, i, sets.points, j)
        now = (far < d_b[i]) | ((far == d_b[i]) & (theirs[j] < label_b[i]))
        to_b += np.bincount(j, (now.astype(float) - won) * gain[theirs[j], i], len(to_b))
    slack, at_a = sets.slack(x2), at_a + sets.starts[:, None]
    label_a = theirs[at_a]
    hit = (label_a == y).astype(np.float32)
    gains = {int(c): (y == c).astype(np.float32) - hit for c in np.unique(mine)}
    doubt = []
    for q, line in enumerate((far_b * far_b - x2[:, None]).T.astype(sets.kind)):
        over = line - low
        wins = over < 0
        to_a[q] += np.einsum("ij,ij->i", wins.astype(np.float32), gains[int(mine[q])])
        close = np.flatnonzero(np.abs(over, out=over) <= slack)
        if len(close):
            doubt.append((q, close, wins.ravel()[close]))
    if doubt:
        q = np.repeat([q for q, _, _ in doubt], [len(c) for _, c, _ in doubt])
        s, i = np.divmod(np.concatenate([c for _, c, _ in doubt]), len(x))
        far, won = _apart(x, i, sets.points, at_a[s, i]), np.concatenate([w for _, _, w in doubt])
        now = (far_b[i, q] < far) | ((far_b[i, q] == far) & (mine[q] < label_a[s, i]))
        np.add.at(to_a, (q, s), (now.astype(float) - won) * ((mine[q] == y[i]).astype(float) - hit[s, i]))


SIMILARITIES = ("mutual_information", "rand_index", "completeness", "fowlkes_mallows")
MEASURES = (*SIMILARITIES, "centroid_displacement", "minimal_distance", "prototype_reassignment_impact")


def compare(
    pairs: DataFrame,
    protos: DataFrame,
    rows: DataFrame,
    measure: str = "centroid_displacement",
    strategy: str = "total",
    distance: str = "l2",
) -> DataFrame:
    """M9: the measure for every pair of ``pairs`` (one pair, or one window against all)."""
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    if measure == "centroid_displacement":
        return centroid_displacement(pairs, protos, strategy)
    if measure == "minimal_distance":
        return minimal_distance(pairs, protos, strategy)
    if measure == "prototype_reassignment_impact":
        return reassignment_impact(pairs, protos, rows, distance)
    cells = contingency(assignment_pairs(pairs, protos, rows, "prototype", distance))
    made = {"mutual_information": adjusted_mutual_info, "rand_index": adjusted_rand,
            "completeness": completeness, "fowlkes_mallows": fowlkes_mallows}
    return made[measure](cells)


def compare_window_to_all(target: int, protos: DataFrame, rows: DataFrame, **kw) -> DataFrame:
    """M9: one row per window, the target itself included and not forced to 0."""
    pairs = rows.select("window_id").distinct().select(
        F.lit(target).cast("long").alias("window_a"), F.col("window_id").alias("window_b")
    )
    return compare(pairs, protos, rows, **kw)


def full_matrix(scores: DataFrame, windows: DataFrame) -> DataFrame:
    """Scores of a < b mirrored, with 0 on the diagonal."""
    diagonal = windows.select("window_id").distinct().select(
        F.col("window_id").alias("window_a"), F.col("window_id").alias("window_b"), F.lit(0.0).alias("score")
    )
    mirrored = scores.select(
        F.explode(
            F.array(
                F.struct(F.col("window_a"), F.col("window_b"), F.col("score")),
                F.struct(F.col("window_b").alias("window_a"), F.col("window_a").alias("window_b"), F.col("score")),
            )
        ).alias("_r")
    ).select("_r.*")
    return mirrored.unionByName(diagonal)


def window_distance_matrix(protos: DataFrame, rows: DataFrame, **kw) -> DataFrame:
    """Each pair once (rows of the second window), then mirrored."""
    return full_matrix(compare(window_pairs(rows), protos, rows, **kw), rows)


def matrix_stats(matrix: DataFrame) -> DataFrame:
    """Over all cells, the diagonal included."""
    return matrix.agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.max("score").alias("max")
    )
