"""Error streams: rolling rates, detection and the description of drifts.

An error stream is ``(stream, idx, error)`` with a dense position per stream. Everything except the detector
itself is a scan, a moving frame or a join on ``(stream, idx)``, so a stream with a third of all rows is spread
over the tasks. The detector is sequential by definition: its input is packed to one byte per row in parallel
first, and each stream is then read in order, batch by batch, with constant state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.operators.detectors import WarningChain, make_detector
from shiftwise.operators.frames import moving
from shiftwise.operators.ordered import prefix_sums

LOOKBACK, LOOKFORWARD, SAMPLE, GRACE = 300, 200, 100, 3


def indexed_errors(df: DataFrame, order: list[str], rows_per_slice: int | None = None) -> DataFrame:
    """``(stream, idx, error, errors_upto, rows)`` from ``(stream, <order>, error)``."""
    out = prefix_sums(
        df, ["stream"], order, {"errors": F.col("error").cast("long"), "_i": F.lit(1).cast("long")}, rows_per_slice
    )
    return out.select(
        "stream", (F.col("_i_upto") - 1).alias("idx"), F.col("error").cast("int").alias("error"), "errors_upto",
        F.col("_i_total").alias("rows"),
    )


def prequential_error(df: DataFrame, features: list[str]) -> DataFrame:
    """Test-then-train by blocks: a Gaussian naive Bayes of window w-1 predicts window w.

    Input ``(window_id, idx, label, <features>)``. All models come from one aggregate (class moments per window),
    so the number of windows costs no extra jobs. Rows without an earlier model count as errors.
    """
    moments = df.groupBy("window_id", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(f) for f in features]).alias("mean"),
        F.array(*[F.var_pop(f) + F.lit(1e-9) for f in features]).alias("var"),
    )
    models = moments.groupBy((F.col("window_id") + 1).alias("window_id")).agg(
        F.sort_array(F.collect_list(F.struct("label", "n", "mean", "var"))).alias("classes")
    )
    x = F.array(*[F.col(f) for f in features])

    def log_score(c: Column) -> Column:
        parts = F.zip_with(
            F.zip_with(x, c["mean"], lambda a, m: (a - m) * (a - m)),
            c["var"],
            lambda d, v: -0.5 * (F.log(v) + d / v),
        )
        return F.aggregate(parts, F.log(c["n"].cast("double")), lambda s, p: s + p)

    scored = df.join(models, "window_id", "left").withColumn(
        "_best", F.array_max(F.transform("classes", lambda c: F.struct(log_score(c).alias("s"), c["label"].alias("label"))))
    )
    wrong = (F.col("_best")["label"] != F.col("label")).cast("int")
    return scored.select("window_id", "idx", "label", F.col("_best")["label"].alias("predicted"),
                         F.coalesce(wrong, F.lit(1)).alias("error"))


def rolling_error_rate(indexed: DataFrame, n: int = SAMPLE, block: int | None = None) -> DataFrame:
    """``rate`` at a row = mean of the ``n`` errors starting there; incomplete windows are left out."""
    framed = moving(indexed.select("stream", "idx", "error"), ["stream"], 0, n - 1,
                    {"_s": F.sum("error"), "_c": F.count("error")}, block=block)
    return framed.where(F.col("_c") == n).select("stream", "idx", (F.col("_s") / F.lit(n)).alias("rate"))


def running_accuracy(indexed: DataFrame) -> DataFrame:
    """Accuracy of all rows so far."""
    return indexed.select("stream", "idx", (1 - F.col("errors_upto") / (F.col("idx") + 1)).alias("accuracy"))


PACK_ROWS = 8192


def packed(indexed: DataFrame, rows: int = PACK_ROWS) -> DataFrame:
    """``(stream, chunk, bits)``: the errors of consecutive rows as one string of 0 and 1."""
    return (
        indexed.groupBy("stream", F.floor(F.col("idx") / rows).alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("idx", "error"))).alias("_e"))
        .select("stream", "chunk", F.array_join(F.transform("_e", lambda e: e["error"].cast("string")), "").alias("bits"))
    )


def detect_drifts(
    indexed: DataFrame,
    detector: str = "ddm",
    params: dict | None = None,
    warning_grace: int = GRACE,
    sample: int = SAMPLE,
) -> DataFrame:
    """``(stream, detected_at, history, chain)``, one row per detected drift."""
    make_detector(detector, params)  # wrong names and parameters fail here, not in a task

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, chain = None, None
        for batch in batches:
            found = []
            for key, bits in zip(batch["stream"], batch["bits"]):
                if chain is None or key != stream:
                    stream, chain = key, WarningChain(make_detector(detector, params), warning_grace, sample)
                errors = np.frombuffer(bits.encode(), np.uint8) & 1  # "0" and "1" differ in the last bit
                found += [(key, *hit) for hit in chain.feed(errors)]
            yield pd.DataFrame(found, columns=["stream", "detected_at", "history", "chain"])

    key_type = indexed.schema["stream"].dataType
    schema = T.StructType(
        [T.StructField("stream", key_type)]
        + [T.StructField(c, T.LongType()) for c in ("detected_at", "history", "chain")]
    )
    ordered = packed(indexed).repartition("stream").sortWithinPartitions("stream", "chunk")
    return ordered.mapInPandas(fold, schema)


def drift_slices(drifts: DataFrame, indexed: DataFrame, back: int = LOOKBACK, ahead: int = LOOKFORWARD) -> DataFrame:
    """Add ``start_idx``, ``back`` (errors before the detection) and ``ahead`` (errors from it on) to every drift.

    Positions are spelled out per drift, so the join with the stream is on ``(stream, idx)``. The arrays hold at
    most ``back + ahead`` numbers.
    """
    at = F.col("detected_at")
    spelled = drifts.select(
        "stream", "detected_at",
        F.explode(F.sequence(F.greatest(at - back, F.lit(0)), at + ahead - 1)).alias("idx"),
    )
    errors = spelled.join(indexed.select("stream", "idx", "error", "rows"), ["stream", "idx"])

    def part(cond: Column) -> Column:
        rows = F.sort_array(F.collect_list(F.when(cond, F.struct("idx", "error"))))
        return F.transform(rows, lambda e: e["error"].cast("double"))

    cut = errors.groupBy("stream", "detected_at").agg(
        part(F.col("idx") < at).alias("back"), part(F.col("idx") >= at).alias("ahead"), F.max("rows").alias("rows")
    )
    return drifts.join(cut, ["stream", "detected_at"]).withColumn("start_idx", F.greatest(at - back, F.lit(0)))


def _total(arr: Column, first: Column, length: Column) -> Column:
    """Sum of ``length`` entries from 0-based ``first``."""
    return F.aggregate(F.slice(arr, (first + 1).cast("int"), length.cast("int")), F.lit(0.0), lambda s, x: s + x)


def _first_over(arr: Column, first: Column, step_gain, threshold: float) -> Column:
    """0-based place of the first entry from ``first`` on where the clipped running sum exceeds ``threshold``."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        total = F.when(acc["at"] >= first, F.greatest(F.lit(0.0), acc["sum"] + step_gain(x))).otherwise(0.0)
        hit = F.when((acc["found"] < 0) & (total > threshold), acc["at"]).otherwise(acc["found"])
        return F.struct(total.alias("sum"), (acc["at"] + 1).alias("at"), hit.alias("found"))

    return F.aggregate(arr, start, step)["found"]


def start_cusum(sliced: DataFrame) -> DataFrame:
    """First row where errors above an early baseline add up to 1.5 (allowance 0.1)."""
    n = F.size("back")
    base = F.least(F.lit(50), F.floor(n / 4)).cast("int")
    mean = _total(F.col("back"), F.lit(0), base) / base
    found = _first_over(F.col("back"), base, lambda x: x - mean - 0.1, 1.5)
    at = F.when(F.col("detected_at") < 50, F.lit(0)).when(n < 20, F.col("start_idx"))
    return sliced.withColumn(
        "found_start", at.otherwise(F.col("start_idx") + F.when(found >= 0, found).otherwise(base))
    )


def start_threshold(sliced: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """20 windows in a row whose rate exceeds 1.5 times the baseline of the first rows."""
    n = F.size("back")
    base = F.least(F.lit(sample), n - 50).cast("int")
    mean = _total(F.col("back"), F.lit(0), base) / base
    begin = F.struct(F.lit(0).alias("run"), F.lit(-1).alias("found"))

    def step(acc: Column, i: Column) -> Column:
        length = F.least(F.lit(sample), n - i)
        high = _total(F.col("back"), i, length) / length > mean * 1.5
        run = F.when(length < 10, acc["run"]).when(high, acc["run"] + 1).otherwise(0)
        hit = F.when((acc["found"] < 0) & (length >= 10) & (run >= 20), F.greatest(F.lit(0), i - 20)).otherwise(acc["found"])
        return F.struct(run.alias("run"), hit.alias("found"))

    found = F.aggregate(F.sequence(base, n - 1), begin, step)["found"]
    place = F.when(found >= 0, found).otherwise(base)
    at = F.when(F.col("detected_at") < 50, F.lit(0)).when(base <= 0, F.col("start_idx"))
    return sliced.withColumn("found_start", at.otherwise(F.col("start_idx") + place))


def start_gradient(sliced: DataFrame, window: int = 20, step: float = 0.01) -> DataFrame:
    """First step above ``step`` of the moving average; neighbouring averages differ by two rows only."""
    n = F.size("back")
    rises = F.filter(
        F.sequence(F.lit(0), n - window - 2),
        lambda i: (F.get("back", i + window) - F.get("back", i)) / window > step,
    )
    place = F.when(n - window < 2, 0).otherwise(F.coalesce(F.get(rises, F.lit(0)), F.lit(0)))
    return sliced.withColumn(
        "found_start", F.when(F.col("detected_at") < 50, F.lit(0)).otherwise(F.col("start_idx") + place)
    )


def start_none(sliced: DataFrame) -> DataFrame:
    """Detection minus the history of the warning chain."""
    return sliced.withColumn("found_start", F.greatest(F.lit(0), F.col("detected_at") - F.col("history")))


def end_peak(sliced: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Climb window by window until the rate falls."""
    seen = F.size("ahead")
    windows = F.floor(seen / sample).cast("int")

    def rate(k: Column) -> Column:
        return _total(F.col("ahead"), k * sample, F.lit(sample)) / sample

    begin = F.struct(F.lit(0).alias("best"), rate(F.lit(0)).alias("rate"), F.lit(False).alias("done"))

    def step(acc: Column, k: Column) -> Column:
        falls = acc["done"] | (rate(k) < acc["rate"])
        return F.struct(
            F.when(falls, acc["best"]).otherwise(k).alias("best"),
            F.when(falls, acc["rate"]).otherwise(rate(k)).alias("rate"),
            falls.alias("done"),
        )

    best = F.aggregate(F.sequence(F.lit(1), windows - 1), begin, step)["best"]
    climbed = F.when(windows < 2, 0).otherwise(best)
    return sliced.withColumn("drift_end", F.col("detected_at") + climbed * sample)


def end_recovery(sliced: DataFrame) -> DataFrame:
    """First row where errors below the 20-row level at the detection add up to 1.5; else the last row seen."""
    n = F.size("ahead")
    high = _total(F.col("ahead"), F.lit(0), F.lit(20)) / 20
    found = _first_over(F.col("ahead"), F.lit(20), lambda x: high - x - 0.1, 1.5)
    place = F.when(n < 20, 0).when(found >= 0, found).otherwise(n - 1)
    return sliced.withColumn("drift_end", F.col("detected_at") + place)


def end_none(sliced: DataFrame) -> DataFrame:
    return sliced.withColumn("drift_end", F.col("detected_at"))


STARTS = {"cusum": start_cusum, "threshold": start_threshold, "gradient": start_gradient, "none": start_none}
ENDS = {"peak": end_peak, "recovery": end_recovery, "none": end_none}


def locate_drifts(
    drifts: DataFrame, indexed: DataFrame, lookback: str = "cusum", lookforward: str = "peak", sample: int = SAMPLE
) -> DataFrame:
    """``(stream, detected_at, drift_start, drift_end)`` by the chosen methods.

    A start may only move earlier than ``detected_at - history``; positions before row 0 are held at 0.
    """
    if lookback not in STARTS or lookforward not in ENDS:
        raise ValueError("unknown lookback or lookforward method")
    sliced = drift_slices(drifts, indexed)
    begun = STARTS[lookback](sliced, sample) if lookback == "threshold" else STARTS[lookback](sliced)
    ended = ENDS[lookforward](begun, sample) if lookforward == "peak" else ENDS[lookforward](begun)
    start = F.greatest(F.lit(0), F.least(F.col("found_start"), F.col("detected_at") - F.col("history")))
    return ended.select("stream", "detected_at", start.cast("long").alias("drift_start"),
                        F.col("drift_end").cast("long").alias("drift_end"))


def mean_between(drifts: DataFrame, indexed: DataFrame, spans: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Mean error over ``[from, to)`` per drift, read off the running error count at the span's two ends."""
    sizes = indexed.groupBy("stream").agg(F.max("rows").alias("_rows"))
    known = drifts.join(sizes, "stream")
    ends = []
    for name, (a, b) in spans.items():
        first = F.greatest(F.lit(0), a).cast("long")
        stop = F.least(F.col("_rows"), b).cast("long")
        known = known.withColumn(f"_a_{name}", first).withColumn(f"_b_{name}", stop)
        for kind, place in (("lo", first - 1), ("hi", stop - 1)):
            ends.append(F.struct(F.lit(f"{name}_{kind}").alias("what"), place.alias("idx")))
    points = known.select(*drifts.columns, F.explode(F.array(*ends)).alias("_p")).select(*drifts.columns, "_p.*")
    looked = points.join(indexed.select("stream", "idx", "errors_upto"), ["stream", "idx"])
    wide = looked.groupBy("stream", "detected_at").agg(
        *[
            F.max(F.when(F.col("what") == f"{n}_{k}", F.col("errors_upto"))).alias(f"_{k}_{n}")
            for n in spans for k in ("lo", "hi")
        ]
    )
    out = known.join(wide, ["stream", "detected_at"], "left")
    rates = []
    for n in spans:
        size = F.col(f"_b_{n}") - F.col(f"_a_{n}")
        total = F.coalesce(f"_hi_{n}", F.lit(0)) - F.coalesce(f"_lo_{n}", F.lit(0))
        rates.append(F.when(size > 0, total / size).otherwise(0.0).alias(n))
    return out.select(*drifts.columns, *rates)


def describe_drifts(drifts: DataFrame, indexed: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Duration and error rates around the start, before the detection and around the end."""
    half = sample // 2
    start, at, end = F.col("drift_start"), F.col("detected_at"), F.col("drift_end")
    rated = mean_between(
        drifts, indexed,
        {
            "rate_at_start": (start - half, start + half),
            "rate_at_detection": (at - sample, at),
            "rate_at_end": (end - half, end + half),
        },
    )
    return rated.withColumn("duration", F.col("drift_end") - F.col("drift_start"))


def correct_drift_end(
    drifts: DataFrame, indexed: DataFrame, sample: int = SAMPLE, take_max: bool = True, block: int | None = None
) -> DataFrame:
    """Move the end to the first highest rolling rate between start and end.

    Positions are reported like the rolling rate is drawn: shifted by ``sample``.
    """
    rates = rolling_error_rate(indexed, sample, block)
    sizes = indexed.groupBy("stream").agg((F.max("rows") - sample).alias("_last")).where("_last >= 0")

    def held(c: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(c), F.col("_last")))

    known = drifts.join(sizes, "stream").withColumn("_s", held("drift_start")).withColumn("_e", held("drift_end"))
    spelled = known.where("_s <= _e").select("stream", "detected_at", F.explode(F.sequence("_s", "_e")).alias("idx"))
    top = (
        spelled.join(rates, ["stream", "idx"])
        .groupBy("stream", "detected_at")
        .agg(F.max(F.struct("rate", (-F.col("idx")).alias("m"))).alias("_top"))
    )
    found = known.join(top, ["stream", "detected_at"], "left")
    moved = -F.col("_top")["m"] if take_max else F.col("_e")
    ended = found.withColumn(
        "_end", F.when(F.col("_top").isNotNull(), moved).otherwise(F.col("_e"))
    ).select("stream", "detected_at", "_s", "_end")
    at_start = rates.select("stream", F.col("idx").alias("_s"), F.col("rate").alias("start_error_rate"))
    at_end = rates.select("stream", F.col("idx").alias("_end"), F.col("rate").alias("end_error_rate"))
    return ended.join(at_start, ["stream", "_s"]).join(at_end, ["stream", "_end"]).select(
        "stream", "detected_at",
        (F.col("_s") + sample).alias("start"), (F.col("_end") + sample).alias("end"),
        (F.col("_end") - F.col("_s")).alias("duration"),
        "start_error_rate", "end_error_rate",
        (F.col("end_error_rate") - F.col("start_error_rate")).alias("error_rate_increase"),
    )


def drift_summary(corrected: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per stream its size and accuracy, the number of drifts, durations and rate changes."""
    base = indexed.groupBy("stream").agg(F.count(F.lit(1)).alias("rows"), (1 - F.avg("error")).alias("accuracy"))
    change = F.when(
        F.col("start_error_rate") > 0, F.col("error_rate_increase") / F.col("start_error_rate") * 100
    ).otherwise(0.0)
    found = corrected.groupBy("stream").agg(
        F.count(F.lit(1)).alias("drifts"),
        F.avg("duration").alias("avg_duration"), F.min("duration").alias("min_duration"),
        F.max("duration").alias("max_duration"),
        F.avg("error_rate_increase").alias("avg_rate_change"), F.avg(change).alias("avg_change_pct"),
    )
    return base.join(found, "stream", "left").withColumn("drifts", F.coalesce("drifts", F.lit(0)))
