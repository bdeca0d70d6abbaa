"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target / source size. The expected copies
are prefix-summed over the source's documents, largest first, one random offset is added per source, and a document is
emitted once per integer boundary its stretch crosses: floor or ceiling of the expectation, never more.

The prefix sum needs a document's position in its source. A source may hold a third of all rows, so positions come in
three steps: documents inside a (source, size class, hash bucket) bin, bins inside a class, classes inside a source. The
last two run on counts, at most ``BUCKETS`` and a few hundred rows a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def hash_fraction(*parts: Column) -> Column:
    """In [0, 1), from the first 32 bits of an MD5 sum."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def source_targets(
    totals: DataFrame, weights: tuple[int, ...], share: float, cap: float, source: str = "source",
) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``: sources by code point, null last, weigh ``weights`` in turn.

    Targets are ``min(cap * size, level * weight)``, where the level makes them add up to ``share`` of all sizes: the excess
    of capped sources goes to the others by weight until none is above. One row per source.
    """
    turn = (F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % len(weights)
    w = totals.withColumn("_w", F.element_at(F.array(*[F.lit(x) for x in weights]), (turn + 1).cast("int")).cast("long"))
    w = w.withColumn("_most", cap * F.col("source_size")).withColumn("_ratio", F.col("_most") / F.col("_w"))
    by = Window.orderBy("_ratio", F.col(source).asc_nulls_last())
    w = w.withColumns({
        "_capped": F.coalesce(F.sum("_most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_left": F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)),
        "_budget": share * F.sum("source_size").over(Window.partitionBy()),
    })
    w = w.withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_left"))
    # The first source that is not capped has the level; later rows count it as capped and come out lower.
    level = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(Window.partitionBy())
    target = F.when(level.isNull() | (F.col("_ratio") <= level), F.col("_most")).otherwise(level * F.col("_w"))
    return w.select(source, "source_size", target.alias("target"))


def _size_class() -> Column:
    """Eight classes an octave of the size, growing with it."""
    return F.expr("length(bin(_size)) * 8 + (shiftright(_size * 8, length(bin(_size)) - 1) & 7)")


def mix_sources(
    df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42,
    doc: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (default: all columns) plus ``_size, _source_size, _target, _copies`` for every row.

    The size is the number of words; a null text counts 0 words; rows with a null source form the last source; rows with a null id
    come first in their bin; repeated rows are rows of their own; a source without words gets no copies; an empty table
    gives no rows. Rows are ordered by content only, so reruns agree; the kept columns must be orderable and not have the added names.
    """
    size = word_count(F.col(text))
    key = F.coalesce(F.col(doc).cast("string"), F.lit(""))
    kept = df.columns if keep is None else keep
    names = [f"_k{i}" for i in range(len(kept))]  # clashing names don't matter inside
    given = [F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)]
    rows = df.select(*given, F.col(source).alias("_src"), size.alias("_size"), F.md5(F.concat(F.lit(f"{seed}:"), key)).alias("_mix"))
    rows = rows.withColumns({
        "_class": _size_class(),
        "_bucket": (F.conv(F.substring("_mix", 1, 8), 16, 10).cast("long") % BUCKETS).cast("int"),
    })
    at = ["_src", "_class", "_bucket"]
    slim = df.select(F.col(source).alias("_src"), size.alias("_size"), F.md5(F.concat(F.lit(f"{seed}:"), key)).alias("_mix"))
    bins = slim.withColumns({
        "_class": _size_class(),
        "_bucket": (F.conv(F.substring("_mix", 1, 8), 16, 10).cast("long") % BUCKETS).cast("int"),
    }).groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"))
    in_class = Window.partitionBy("_src", "_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_in_class", F.coalesce(F.sum("_n").over(in_class), F.lit(0)))
    classes = bins.groupBy("_src", "_class").agg(F.sum("_n").alias("_cn"), F.sum("_words").alias("_cw"))
    above = Window.partitionBy("_src").orderBy(F.col("_class").desc()).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("_above", F.coalesce(F.sum("_cn").over(above), F.lit(0)))
    totals = classes.groupBy(F.col("_src").alias("source")).agg(F.sum("_cw").alias("source_size"))
    goals = source_targets(totals, weights, share, cap).select(
        F.col("source").alias("_g"), "source_size", "target",
        hash_fraction(F.lit(f"{seed}:offset:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).alias("_offset"),
    )
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    c = classes.join(goals, classes["_src"].eqNullSafe(goals["_g"])).select(
        F.col("_src").alias("_s1"), F.col("_class").alias("_c1"), "_above", "source_size", "target", "_offset"
    )
    b = bins.join(c, F.col("_src").eqNullSafe(F.col("_s1")) & (F.col("_class") == F.col("_c1"))).select(
        F.col("_src").alias("_s2"), F.col("_class").alias("_c2"), F.col("_bucket").alias("_b2"),
        (F.col("_above") + F.col("_in_class")).alias("_before"), "source_size", "target", "_offset",
    )
    in_bin = Window.partitionBy(*at).orderBy(F.col("_size").desc(), "_mix", *names)
    placed = rows.withColumn("_place", F.row_number().over(in_bin).cast("long"))
    out = placed.join(
        b, F.col("_src").eqNullSafe(F.col("_s2")) & (F.col("_class") == F.col("_c2")) & (F.col("_bucket") == F.col("_b2"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = F.col("_before") + F.col("_place")
    copies = F.floor(rate * upto + F.col("_offset")) - F.floor(rate * (upto - 1) + F.col("_offset"))
    return out.select(
        *[F.col(n).alias(c) for c, n in zip(kept, names)], "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), copies.alias("_copies")
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it has copies, without the helper columns."""
    given = [c for c in mixed.columns if c not in ("_size", "_source_size", "_target", "_copies")]
    times = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")
    return mixed.where("_copies > 0").select(*given, times).select(*given)


def op3_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix_sources(docs, keep=["doc_id"])
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS mix
  FROM documents),
k AS (
  SELECT *, length(bin(size)) * 8 + ((size * 8 >> (length(bin(size)) - 1)) & 7) AS class,
         ('0x' || substr(mix, 1, 8))::BIGINT % 1024 AS bucket
  FROM d),
p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class DESC, bucket, size DESC, mix, doc_id) AS upto FROM k),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * (SELECT sum(size) FROM d)::DOUBLE AS budget
  FROM s),
r AS (SELECT *, most / w AS ratio FROM w),
l AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
m AS (SELECT *, max(level) FILTER (ratio > level) OVER () AS cut FROM l),
g AS (
  SELECT source, source_size, CASE WHEN cut IS NULL OR ratio <= cut THEN most ELSE cut * w END AS target,
         ('0x' || substr(md5('42:offset:' || coalesce('s' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off
  FROM m),
e AS (
  SELECT p.doc_id, p.size, g.source_size, g.target, p.upto, g.off,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate * upto + off)::BIGINT - floor(rate * (upto - 1) + off)::BIGINT) AS taken
FROM e"""
