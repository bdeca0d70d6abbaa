"""S1-S19 on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.operators import prep
from shiftwise.operators.ordered import index_rows
from shiftwise.plans.catalog import query, rnd, rounded
from shiftwise.plans.inputs import (
    EVENT_SIDES, LINE_FEATURES, LINE_ORDER, LINE_SIDES, event_sides, line_sides, table
)
from shiftwise.sources.tables import DatasetRegistry, as_labelled, load_labelled, x_y_split_by_name
from shiftwise.session import work_path

ORDERED = """ix AS (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS idx FROM lineitem)"""


@query("load_labelled", """
SELECT o_orderkey, o_orderstatus AS label, o_totalprice FROM orders WHERE o_orderstatus IS NOT NULL""")
def _load(spark, sf):
    return load_labelled(spark, f"{sf}/orders.parquet", "o_orderstatus", ["o_totalprice"], ["o_orderkey"])


@query("dataset_registry", """
SELECT o_orderstatus AS label, count(*) AS n, round(avg(o_totalprice), 4) + 0.0 AS mean_price
FROM orders GROUP BY o_orderstatus""")
def _registry(spark, sf):
    registry = DatasetRegistry(spark, work_path(spark, "registry"))
    registry.save("order prices", table(spark, sf, "orders"), "o_orderstatus", ["o_totalprice"])
    found = registry.load("order prices")
    return rounded(found.groupBy("label").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price")), 4)


@query("index_rows", f"WITH {ORDERED} SELECT {', '.join(LINE_ORDER)}, idx FROM ix")
def _index(spark, sf):
    return index_rows(table(spark, sf, "lineitem").select(*LINE_ORDER), LINE_ORDER)


def _indexed_lines(spark, sf):
    rows = table(spark, sf, "lineitem").select(*LINE_ORDER, *LINE_FEATURES, F.col("l_returnflag").alias("label"))
    return index_rows(rows, LINE_ORDER)


@query("fixed_windows", f"""
WITH {ORDERED}
SELECT CAST(floor(idx / 700) AS BIGINT) AS window_id, count(*) AS n, min(idx) AS first_idx,
       {rnd('avg(l_quantity)', 'mean_quantity')}
FROM ix WHERE floor(idx / 700) < floor((SELECT count(*) FROM lineitem) / 700) GROUP BY 1""")
def _windows(spark, sf):
    windowed = prep.fixed_windows(_indexed_lines(spark, sf), 700)
    return rounded(
        windowed.groupBy("window_id").agg(
            F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.avg("l_quantity").alias("mean_quantity")
        )
    )


@query("before_after", """
SELECT 'before' AS side, event_id AS idx, event_type AS label, value FROM events
WHERE event_id >= 1000 AND event_id < 5000
UNION ALL
SELECT 'after', event_id, event_type, value FROM events WHERE event_id >= 4000 AND event_id < 8000""")
def _before_after(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("idx"), F.col("event_type").alias("label"), "value")
    return prep.before_after(rows, 1000, 4000, 4000).select("side", "idx", "label", "value")


@query("select_features", "SELECT l_returnflag AS label, l_tax, l_discount FROM lineitem")
def _select(spark, sf):
    return as_labelled(table(spark, sf, "lineitem"), "l_returnflag", ["l_tax", "not_there", "l_discount"])


@query("block_at", "SELECT event_id AS idx, event_type AS label, value FROM events "
       "WHERE event_id >= greatest(0, least(9500, (SELECT count(*) FROM events) - 2000)) "
       "AND event_id < greatest(0, least(9500, (SELECT count(*) FROM events) - 2000)) + 2000")
def _block(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("idx"), F.col("event_type").alias("label"), "value")
    return prep.block_at(rows, 2000, 9500)


def _scaled_sql(expr) -> str:
    aggs = ", ".join(
        f"min({f}) AS lo_{f}, max({f}) AS hi_{f}, avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in LINE_FEATURES
    )
    cols = ", ".join(rnd(expr(f), f, 5) for f in LINE_FEATURES)
    return f"""WITH {LINE_SIDES}, fit AS (SELECT {aggs} FROM li WHERE side = 'before')
SELECT side, label, {', '.join(LINE_ORDER)}, {cols} FROM li, fit"""


@query("min_max_scale", _scaled_sql(lambda f: f"({f} - lo_{f}) / CASE WHEN hi_{f} = lo_{f} THEN 1 ELSE hi_{f} - lo_{f} END"))
def _min_max(spark, sf):
    return rounded(prep.min_max_scale(line_sides(spark, sf, order=True), LINE_FEATURES), 5)


@query("standard_scale", _scaled_sql(lambda f: f"({f} - m_{f}) / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END"))
def _standard(spark, sf):
    return rounded(prep.standard_scale(line_sides(spark, sf, order=True), LINE_FEATURES), 5)


@query("ordinal_encode", """
WITH codes AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code
               FROM (SELECT DISTINCT event_type FROM events WHERE event_id < 5000 AND event_type <> 'view'))
SELECT e.event_id, CAST(coalesce(c.code, -1) AS INTEGER) AS event_type
FROM events e LEFT JOIN codes c ON e.event_type = c.event_type""")
def _ordinal(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type")
    known = rows.where("event_id < 5000 AND event_type <> 'view'")
    return prep.ordinal_encode(rows, ["event_type"], fit=known)


@query("multilabel_one_hot", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_returnflag = 'A' OR l_linestatus = 'A' THEN 1 ELSE 0 END AS "A",
       CASE WHEN l_returnflag = 'F' OR l_linestatus = 'F' THEN 1 ELSE 0 END AS "F",
       CASE WHEN l_returnflag = 'N' OR l_linestatus = 'N' THEN 1 ELSE 0 END AS "N",
       CASE WHEN l_returnflag = 'O' OR l_linestatus = 'O' THEN 1 ELSE 0 END AS "O",
       CASE WHEN l_returnflag = 'R' OR l_linestatus = 'R' THEN 1 ELSE 0 END AS "R"
FROM lineitem""")
def _one_hot(spark, sf):
    rows = table(spark, sf, "lineitem").select(*LINE_ORDER, "l_returnflag", "l_linestatus")
    return prep.multilabel_one_hot(rows, ["l_returnflag", "l_linestatus"])


def _binary_lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        *LINE_ORDER,
        F.col("l_returnflag").alias("label"),
        (F.col("l_linestatus") == "F").cast("double").alias("shipped"),
        (F.col("l_quantity") > 40).cast("double").alias("large"),
        "l_tax",
    )


def _weight(f: str) -> str:
    return (
        f"(SELECT (1 - sum(n * (CASE WHEN p_{f} > 0 THEN -p_{f} * ln(p_{f}) ELSE 0 END + "
        f"CASE WHEN p_{f} < 1 THEN -(1 - p_{f}) * ln(1 - p_{f}) ELSE 0 END)) / sum(n)) / ln(count(*)) FROM c)"
    )


@query("binary_entropy_weight", f"""
WITH b AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS shipped_,
                  CASE WHEN l_quantity > 40 THEN 1.0 ELSE 0.0 END AS large_ FROM lineitem),
c AS (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, CAST(avg(shipped_) AS DOUBLE) AS p_shipped,
             CAST(avg(large_) AS DOUBLE) AS p_large FROM b GROUP BY 1)
SELECT {', '.join(LINE_ORDER)}, l_returnflag AS label, {rnd(f"shipped_ * {_weight('shipped')}", 'shipped')},
       {rnd(f"large_ * {_weight('large')}", 'large')}, {rnd('l_tax', 'l_tax')} FROM b""")
def _entropy_weight(spark, sf):
    return rounded(prep.binary_entropy_weight(_binary_lines(spark, sf), ["shipped", "large", "l_tax"]))


@query("stratified_split", """
WITH p AS (SELECT event_type AS label, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)
                  / CAST(count(*) OVER (PARTITION BY event_type) AS DOUBLE) AS share FROM events)
SELECT label, CASE WHEN share < CAST(0.6 AS DOUBLE) THEN 'train' WHEN share < CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE) THEN 'valid' ELSE 'test' END AS part,
       count(*) AS n FROM p GROUP BY 1, 2""")
def _split(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("idx"), F.col("event_type").alias("label"), "value")
    return prep.stratified_split(rows).groupBy("label", "part").agg(F.count("*").alias("n"))


@query("recode_categories", """
SELECT doc_id, CASE WHEN lang IN ('en') THEN 2 WHEN lang IN ('de', 'fr') THEN 1 ELSE 0 END AS lang_group,
       CASE WHEN n_chars <= 500 THEN 'short' WHEN n_chars <= 2000 THEN 'medium' ELSE 'long' END AS length_group
FROM documents""")
def _recode(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        prep.recode_sets(F.col("lang"), {2: ("en",), 1: ("de", "fr")}, 0).alias("lang_group"),
        prep.recode_ranges(F.col("n_chars"), [(500, "short"), (2000, "medium")], "long").alias("length_group"),
    )


@query("drop_by_cardinality", "SELECT l_quantity, l_tax FROM lineitem")
def _cardinality(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_tax")
    return prep.drop_by_cardinality(rows, ["l_returnflag", "l_quantity", "l_tax"], 3)


@query("x_y_split_by_name", "SELECT l_returnflag AS target_flag, l_linestatus AS target_status FROM lineitem")
def _xy(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_quantity", F.col("l_returnflag").alias("target_flag"), F.col("l_linestatus").alias("target_status")
    )
    _, y = x_y_split_by_name(rows.columns)
    return rows.select(*y)


def _concepts(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("idx"), "event_type", "value")
    return rows, rows.withColumn("value", -F.col("value"))


@query("mix_concepts_sudden", """
SELECT event_id AS idx, event_type, CASE WHEN event_id >= 4000 THEN -value ELSE value END AS value FROM events""")
def _mix_sudden(spark, sf):
    a, b = _concepts(spark, sf)
    return prep.mix_concepts(a, b, 4000, 1)


@query("mix_concepts_gradual")
def _mix_gradual(spark, sf):
    a, b = _concepts(spark, sf)
    return prep.mix_concepts(a, b, 4000, 1000)


@query("inject_label_drift", """
SELECT event_id AS idx, CAST((user_id % 3 + CASE WHEN event_id >= 2000 AND event_id < 6000 THEN 1 ELSE 0 END) % 3
       AS INTEGER) AS y FROM events""")
def _inject(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("idx"), (F.col("user_id") % 3).cast("int").alias("y"))
    return prep.inject_label_drift(rows, [2000, 6000], label="y", classes=3)


@query("weight_inversion_labels", f"""
WITH {EVENT_SIDES}, s AS (SELECT idx, value, k, value + k AS pre, -value + k AS post FROM ev),
m AS (SELECT median(pre) AS mpre, median(post) AS mpost FROM s)
SELECT idx, value, k, CAST(CASE WHEN idx >= 5000 THEN post > mpost ELSE pre > mpre END AS INTEGER) AS y FROM s, m""")
def _inversion(spark, sf):
    rows = event_sides(spark, sf).select("idx", "value", "k")
    return prep.weight_inversion_labels(rows, ["value", "k"], 1, 5000)
