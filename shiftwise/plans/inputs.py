"""The given tables in the library's canonical shapes, and the same shapes as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftwise.functions.columns import clean_double
from shiftwise.operators.prep import split_at

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
EVENT_FEATURES = ["value", "k"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_sides(spark: SparkSession, sf_dir: str, order: bool = False) -> DataFrame:
    """Line items labelled by return flag, split by ship date."""
    raw = table(spark, sf_dir, "lineitem")
    kept = raw.select(
        F.col("l_returnflag").alias("label"),
        *[clean_double(f).alias(f) for f in LINE_FEATURES],
        *(LINE_ORDER if order else []),
        "l_shipdate",
    )
    return split_at(kept, F.expr("l_shipdate < timestamp_ntz'1998-06-01 00:00:00'")).drop("l_shipdate")


LINE_SIDES = """li AS (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' THEN 'before' ELSE 'after' END AS side,
         l_returnflag AS label, l_quantity, l_extendedprice, l_discount, l_tax,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem),
long AS (
  SELECT side, label, 'l_quantity' AS feature, l_quantity AS value FROM li
  UNION ALL SELECT side, label, 'l_extendedprice', l_extendedprice FROM li
  UNION ALL SELECT side, label, 'l_discount', l_discount FROM li
  UNION ALL SELECT side, label, 'l_tax', l_tax FROM li)"""


def event_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events labelled by their type, with the value and the number in ``props``, split by time."""
    raw = table(spark, sf_dir, "events")
    kept = raw.select(
        F.col("event_id").alias("idx"),
        F.col("event_type").alias("label"),
        clean_double("value").alias("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "ts",
    )
    return split_at(kept, F.expr("ts < timestamp_ntz'2024-01-16 00:00:00'")).drop("ts")


EVENT_SIDES = """ev AS (
  SELECT event_id AS idx, event_type AS label, value,
         CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k,
         CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'before' ELSE 'after' END AS side
  FROM events),
long AS (
  SELECT side, label, 'value' AS feature, value FROM ev
  UNION ALL SELECT side, label, 'k', k FROM ev)"""


def error_flag(raw_type, event_id):
    """Errors of the event log; in every other stretch of 3000 events clicks fail as well."""
    wild = F.floor(event_id / 3000) % 2 == 1
    return ((raw_type == "error") | (wild & (raw_type == "click"))).cast("int")


ERROR_FLAG = """CASE WHEN event_type = 'error' OR (CAST(floor(event_id / 3000) AS BIGINT) % 2 = 1 AND event_type = 'click')
              THEN 1 ELSE 0 END"""


def error_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 0/1 error stream per group of users, in event order: ``(stream, event_id, error)``."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("stream"), "event_id",
        error_flag(F.col("event_type"), F.col("event_id")).alias("error"),
    )


ERROR_STREAMS = f"""es AS (
  SELECT user_id % 5 AS stream, event_id, {ERROR_FLAG} AS error,
         row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS idx
  FROM events)"""


VECTOR_SIZE = 64
WINDOW_SIZE = 100


def vector_windows(spark: SparkSession, sf_dir: str, size: int = WINDOW_SIZE) -> DataFrame:
    """Embeddings in windows by their id: ``(window_id, idx, label, features)``."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / size).alias("window_id"),
        F.col("vec_id").alias("idx"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


VECTOR_WINDOWS = f"""vw AS (
  SELECT CAST(floor(vec_id / {WINDOW_SIZE}) AS BIGINT) AS window_id, vec_id AS idx,
         CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS features
  FROM embeddings)"""

TREES = VECTOR_SIZE // 2


def with_cell_leaves(rows: DataFrame) -> DataFrame:
    """A given leaf table: two-level trees, each splitting two coordinates at 0; together they see all coordinates."""
    return rows.withColumn(
        "leaves",
        F.transform(
            F.sequence(F.lit(0), F.lit(TREES - 1)),
            lambda t: (F.get("features", 2 * t) > 0).cast("int") + 2 * (F.get("features", 2 * t + 1) > 0).cast("int"),
        ),
    ).withColumn("model_label", F.when(F.col("features")[0] > 0, F.col("label")).otherwise("0"))


def first_prototypes(rows: DataFrame, k: int = 3) -> DataFrame:
    """Known prototypes: the first ``k`` rows of every class of every window."""
    place = F.row_number().over(Window.partitionBy("window_id", "label").orderBy("idx"))
    return rows.withColumn("proto_rank", place - 1).where(F.col("proto_rank") < k)


def tree_windows_sql(size: int = WINDOW_SIZE) -> str:
    return f"""vw AS (
  SELECT CAST(floor(vec_id / {size}) AS BIGINT) AS window_id, vec_id AS idx,
         CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS features
  FROM embeddings),
tw AS (
  SELECT *, list_transform(range({TREES}), lambda t: CAST(features[2 * t + 1] > 0 AS INTEGER)
                                                + 2 * CAST(features[2 * t + 2] > 0 AS INTEGER)) AS leaves,
         CASE WHEN features[1] > 0 THEN label ELSE '0' END AS model_label
  FROM vw),
pr AS (
  SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY label, proto_rank) - 1 AS proto_id
  FROM (SELECT *, row_number() OVER (PARTITION BY window_id, label ORDER BY idx) - 1 AS proto_rank FROM tw)
  WHERE proto_rank < 3)"""


def l2_sql(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(range(1, {VECTOR_SIZE + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"


def shared_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, {TREES + 1}), lambda i: CASE WHEN {a}[i] = {b}[i] THEN 1 ELSE 0 END))"
