"""Continuous versions of the detectors and profiles (W1-W5, and the online learner of E1).

Time comes from an event-time column. Rows behind the watermark are dropped in W2, W3 and W5; the keyed folds
(W1, online learner) take the rows of a micro-batch in ``order`` and keep one small state per key.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from operator import mul

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shiftwise.operators.detectors import WarningChain, make_detector
from shiftwise.operators.errors import GRACE, SAMPLE
from shiftwise.operators.profile import EPS, bin_number, relative_shift
from shiftwise.session import work_path


def read_events(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """The parquet file or folder ``name`` in ``folder`` as a stream; ``ts`` becomes a timestamp for watermarks.

    A stream can't start at one file, but at a pattern: the last letter as a character class matches a file and a folder alike.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in raw.columns else raw


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available into a parquet table in the shared folder and return that table."""
    spark = stream.sparkSession
    out = work_path(spark, name)
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{out}/checkpoint")
        .format("parquet")
        .trigger(availableNow=True)
        .start(f"{out}/data")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def stream_error_drift(
    errors: DataFrame, order: str, detector: str = "ddm", params: dict | None = None, warning_grace: int = GRACE,
    sample: int = SAMPLE,
) -> DataFrame:
    """``(stream, detected_at, history, chain)`` from ``(stream, <order>, error)``.

    The state of a key is the detector's counters; the rows of a key in a micro-batch are put in order first, so
    the result equals the batch fold as long as batches arrive in order.
    """
    make_detector(detector, params)
    key_type = dict(errors.dtypes)["stream"]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain = pickle.loads(state.get[0]) if state.exists else WarningChain(
            make_detector(detector, params), warning_grace, sample
        )
        rows = pd.concat(list(batches)).sort_values(order)
        found = [(key[0], *hit) for hit in chain.feed(rows["error"].to_numpy())]
        state.update((pickle.dumps(chain),))
        yield pd.DataFrame(found, columns=["stream", "detected_at", "history", "chain"])

    return errors.select("stream", order, "error").groupBy("stream").applyInPandasWithState(
        fold, f"stream {key_type}, detected_at long, history long, chain long", "chain binary", "append",
        GroupStateTimeout.NoTimeout,
    )


class OnlineLogistic:
    """Multiclass logistic regression trained one row at a time on running standardised features.

    A row is a handful of numbers: plain floats take a fraction of the time of array calls.
    """

    def __init__(self, size: int, rate: float = 0.1):
        self.size, self.rate = size, rate
        self.classes: list[str] = []
        self.weights: list[list[float]] = []
        self.n, self.mean, self.spread = 0, [0.0] * size, [0.0] * size

    def _row(self, x: list[float]) -> list[float]:
        n, z = max(1, self.n), []
        for v, m, s in zip(x, self.mean, self.spread):
            sd = math.sqrt(s / n)
            z.append((v - m) / (sd if sd > 0 else 1.0))
        z.append(1.0)
        return z

    def test_then_train(self, x: list[float], y: str) -> int:
        """1 when the prediction made before learning is wrong; the first row counts as an error."""
        z = self._row(x)
        scores = [sum(map(mul, w, z)) for w in self.weights]
        odd = not math.isfinite(sum(scores))
        best = (int(np.argmax(scores)) if odd else scores.index(max(scores))) if scores else -1
        wrong = int(best < 0 or self.classes[best] != y)
        if y not in self.classes:
            self.classes.append(y)
            self.weights.append([0.0] * (self.size + 1))
            scores.append(0.0)
        top = float(np.max(scores)) if odd else max(scores)
        p = [math.exp(s - top) for s in scores]
        total, own = sum(p), self.classes.index(y)
        for k, w in enumerate(self.weights):
            step = self.rate * (p[k] / total - (k == own))
            self.weights[k] = [a - step * b for a, b in zip(w, z)]
        self.n += 1
        for j, v in enumerate(x):
            gap = v - self.mean[j]
            self.mean[j] += gap / self.n
            self.spread[j] += gap * (v - self.mean[j])
        return wrong


def stream_prequential_error(rows: DataFrame, order: str, features: list[str], rate: float = 0.1) -> DataFrame:
    """E1 online: ``(stream, <order>, error)`` of a learner kept per key, from ``(stream, <order>, label, features)``."""
    types = dict(rows.dtypes)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        learner = pickle.loads(state.get[0]) if state.exists else OnlineLogistic(len(features), rate)
        seen = pd.concat(list(batches)).sort_values(order)
        x = seen[features].to_numpy(dtype=float)
        errors = [learner.test_then_train(v, y) for v, y in zip(np.nan_to_num(x).tolist(), seen["label"].tolist())]
        state.update((pickle.dumps(learner),))
        yield pd.DataFrame({"stream": key[0], order: seen[order], "error": errors})

    return rows.select("stream", order, "label", *features).groupBy("stream").applyInPandasWithState(
        fold, f"stream {types['stream']}, {order} {types[order]}, error int", "learner binary", "append", GroupStateTimeout.NoTimeout
    )


def _windowed(rows: DataFrame, length: str, slide: str | None = None, delay: str = "1 hour"):
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.withWatermark("ts", delay), span.alias("_w")


def _ends() -> list[Column]:
    return [F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")]


def stream_window_profile(
    rows: DataFrame, value: str = "value", length: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Count, mean, deviation, minimum, maximum and median per window and label.

    The median is exact: the state of an open window has its distinct values with their counts, which merge.
    """
    timed, span = _windowed(rows, length, delay=delay)
    return timed.groupBy(span, "label").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.percentile(value, 0.5).alias("median"),
    ).select(*_ends(), "label", "n", "mean", "std", "min", "max", "median")


def frozen_reference(rows: DataFrame, value: str = "value", bins: int = 30) -> DataFrame:
    """Static table per label: mean, deviation, extremes and the densities of ``bins`` bins (from batch rows)."""
    stats = rows.groupBy("label").agg(
        F.count(value).alias("ref_n"), F.avg(value).alias("ref_mean"), F.stddev_samp(value).alias("ref_std"),
        F.min(value).alias("ref_min"), F.max(value).alias("ref_max"),
    )
    hit = bin_number(F.col(value), F.col("ref_min"), F.col("ref_max"), bins)
    counts = rows.join(F.broadcast(stats), "label").groupBy("label").agg(
        F.array(*[F.count(F.when(hit == i, 1)) for i in range(bins)]).alias("ref_bins"), F.count(hit).alias("ref_inside")
    )
    return stats.join(counts, "label")


def stream_window_drift(
    rows: DataFrame, reference: DataFrame, value: str = "value", length: str = "1 day", delay: str = "1 hour",
    thr: float = 0.2, js_thr: float = 0.05, kl_thr: float = 0.1, wasserstein_thr: float = 0.1, bins: int = 30,
) -> DataFrame:
    """Every window and label against a frozen reference: statistic shifts, KL, JS and Wasserstein on the reference bins.

    Only the ends of a label's bins go with the rows; all bins are counted in the one streaming aggregate, and the rest of the
    reference (one row per label) meets the aggregate's result. The Wasserstein distance is the area between the two running shares
    over the bins, on the reference's range scaled to 1.
    """
    ends = reference.select("label", "ref_min", "ref_max")
    timed, span = _windowed(rows.join(F.broadcast(ends), "label"), length, delay=delay)
    timed = timed.withColumn("_hit", bin_number(F.col(value), F.col("ref_min"), F.col("ref_max"), bins))
    agg = timed.groupBy(span, "label").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.array(*[F.count(F.when(F.col("_hit") == i, 1)) for i in range(bins)]).alias("bins"),
        F.count("_hit").alias("inside"),
    ).join(F.broadcast(reference), "label")
    width = F.when(F.col("ref_min") == F.col("ref_max"), 1.0).otherwise(F.col("ref_max") - F.col("ref_min")) / bins

    def shares(c: str, inside: str) -> Column:
        # densities plus a small constant, over their sum (1 / width + bins * constant)
        return F.transform(c, lambda n: (n / (F.col(inside) * width) + EPS) / (1.0 / width + bins * EPS))

    shares_added = agg.withColumn("_p", shares("ref_bins", "ref_inside")).withColumn("_q", shares("bins", "inside"))

    def total_of(each) -> Column:
        return F.aggregate(F.zip_with("_p", "_q", each), F.lit(0.0), lambda s, x: s + x)

    kl = total_of(lambda p, q: p * F.log(p / q))
    js = total_of(lambda p, q: (p * F.log(2 * p / (p + q)) + q * F.log(2 * q / (p + q))) / 2)
    gaps = F.zip_with("ref_bins", "bins", lambda p, q: p / F.col("ref_inside") - q / F.col("inside"))
    start = F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("area"))
    run = F.aggregate(gaps, start, lambda s, g: F.struct((s["gap"] + g).alias("gap"), (s["area"] + F.abs(s["gap"] + g)).alias("area")))
    stats = ("mean", "std", "min", "max")
    shifts = [relative_shift(F.col(f"ref_{s}"), F.col(s)).alias(f"{s}_shift") for s in stats]
    out = shares_added.select(
        *_ends(), "label", "n", *shifts, kl.alias("kl"), js.alias("js"),
        F.when(F.col("inside") > 0, run["area"] / bins).alias("wasserstein"),
    )
    above = lambda c, t: F.coalesce(F.col(c) > t, F.lit(False))
    return out.withColumns({
        "stat_drift": F.greatest(*[above(f"{s}_shift", thr) for s in stats]),
        "kl_drift": above("kl", kl_thr), "js_drift": above("js", js_thr), "wasserstein_drift": above("wasserstein", wasserstein_thr),
    })


def window_decisions(found: DataFrame, reference: DataFrame, thr: float = 0.2, decision_thr: float = 0.4) -> DataFrame:
    """W3, on the finished windows of ``stream_window_drift``: adds the shift of each label's share (D4) and, per window, the share of
    drifted statistics with the overall flag (D5).

    A statistic (mean, deviation, minimum, maximum, class share) drifts in a window when it does for any label.
    """
    whole = Window.partitionBy("window_start", "window_end")
    known = reference.select("label", (F.col("ref_n") / F.sum("ref_n").over(Window.partitionBy())).alias("_ref_share"))
    shift = relative_shift(F.col("_ref_share"), F.col("n") / F.sum("n").over(whole))
    out = found.join(F.broadcast(known), "label").withColumn("ratio_shift", shift)
    flags = [F.coalesce(F.col(f"{s}_shift") > thr, F.lit(False)) for s in ("mean", "std", "min", "max", "ratio")]
    share = sum(F.max(f).over(whole).cast("int") for f in flags) / F.lit(float(len(flags)))
    return out.withColumn("imbalance_drift", flags[-1]).withColumn("drifted_share", share).drop("_ref_share").withColumn(
        "drift", F.col("drifted_share") > decision_thr
    )


def stream_rolling_error(
    errors: DataFrame, length: str = "6 hours", slide: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Error rate per key over a sliding time window, from ``(stream, ts, error)``."""
    timed, span = _windowed(errors, length, slide, delay)
    return timed.groupBy(span, "stream").agg(
        F.count("error").alias("n"), F.avg("error").alias("rate")
    ).select(*_ends(), "stream", "n", "rate")


class RaceStream:
    """Prototypes of every window go to a table; the scores of neighbouring windows follow from it.

    Rows may come in any order. Every micro-batch adds its rows to a table partitioned by window; the windows it touches are
    selected anew from all their rows, and the newest selection of a window counts. With ``keep`` windows further than that
    behind the newest one are closed: rows that come for them later are dropped. All tables are written per micro-batch id, so a
    repeated batch overwrites its own output.
    """

    def __init__(self, spark: SparkSession, select_prototypes, score_pairs, folder: str | None = None, keep: int | None = None):
        self.spark, self.select, self.score, self.keep = spark, select_prototypes, score_pairs, keep
        self.folder = folder or work_path(spark, "race")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}/b=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # nothing written yet

    def process(self, batch: DataFrame, batch_id: int) -> None:
        earlier = self._read("rows")
        if self.keep is not None and earlier is not None:
            newest = earlier.where(F.col("b") < batch_id).agg(F.max("window_id")).first()[0]
            batch = batch if newest is None else batch.where(F.col("window_id") >= newest - self.keep)
        batch.write.mode("overwrite").partitionBy("window_id").parquet(f"{self.folder}/rows/b={batch_id}")
        stored = self._read("rows")
        if stored is None or "window_id" not in stored.columns:
            return  # an empty batch writes no partition
        rows = stored.where(F.col("b") <= batch_id)
        touched = rows.where(F.col("b") == batch_id).select("window_id").distinct()
        kept = rows.join(touched, "window_id", "left_semi").select(*batch.columns)
        self.select(kept).write.mode("overwrite").parquet(f"{self.folder}/protos/b={batch_id}")

    def prototypes(self) -> DataFrame:
        """The newest prototypes of every window."""
        protos = self._read("protos")
        newest = F.max("b").over(Window.partitionBy("window_id"))
        return protos.withColumn("_newest", newest).where("b = _newest").drop("b", "_newest")

    def scores(self) -> DataFrame:
        """Scores of all neighbouring windows whose prototypes are known."""
        return self.score(self.prototypes())

    def run(self, stream: DataFrame) -> DataFrame:
        query = (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self.scores()
