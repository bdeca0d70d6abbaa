"""Benchmark passages inside documents, found by a prefix-filtered set join.

An item's windows are ``width`` consecutive words (an item with fewer words is one window). Seen as a set, a window holds its
shingles of ``shingle`` words (a shorter window is one shingle). A document holds a window only if it holds all its shingles, so
one of them is enough as the necessary prefix: the rarest, by how often the documents hold it. A window whose rarest shingle
occurs nowhere is dropped at once. The documents' shingles meet the prefixes; a meeting fixes where the window would start, which
must lie inside the document (position) and leave room for all its words (length); then the words themselves are compared.

Documents are never shuffled: their words are cut, hashed, met with the prefixes and compared inside one scan, and only hits leave
it. The windows are broadcast at most ``windows_a_pass`` at a time (``shingles_a_pass`` hashes in the counting scan); a larger
benchmark takes more scans. Everything is made of DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.session import work_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: between words, once A-Z are lowered
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: between words before that, which is enough to count them
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

WINDOWS_A_PASS = 100_000
SHINGLES_A_PASS = 1_000_000


def lowered(text: Column) -> Column:
    """A-Z lowered and nothing else; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), GAP), "")


def _shingles(words: Column, width: Column | int) -> Column:
    """``[(i, h)]``: hash of the ``width`` words from place ``i`` (from 1)."""
    width = F.lit(width) if isinstance(width, int) else width
    places = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice(words, i, width)).alias("h")))


def _passes(total: int, most: int) -> int:
    return max(1, -(-total // most))


def item_windows(bench: DataFrame, width: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, win, w)``: every window of every item as words ``w`` and as text ``win``; an id may be null or repeat."""
    words = bench.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    cut = words.select("item", "w", F.explode(starts).alias("i"))
    return cut.select("item", F.slice("w", F.col("i"), F.lit(width)).alias("w")).select("item", F.array_join("w", " ").alias("win"), "w").distinct()


def benchmark_hits(
    docs: DataFrame, windows: DataFrame, shingle: int = 4, ident: str = "doc_id", text: str = "text",
    windows_a_pass: int = WINDOWS_A_PASS, shingles_a_pass: int = SHINGLES_A_PASS,
) -> DataFrame:
    """``(ident, mark, start, n, win)``: each place of a document where a window of ``windows`` (``item_windows``) stands; ``start``
    counts words from 1, ``mark`` tells texts that share an id apart. Written to the shared folder.

    A null text has no words; ids may be null or repeat; rows equal in id and text give their hits once each, all alike.
    """
    spark = docs.sparkSession
    distinct = windows.select("win", "w").distinct().withColumn("width", F.least(F.size("w"), F.lit(shingle)))
    parts = distinct.select("win", "w", F.explode(_shingles(F.col("w"), F.col("width"))).alias("s")).select("win", "w", "s.i", "s.h")
    path = work_path(spark, "decontaminate-shingles")
    parts.write.parquet(path)
    parts = spark.read.parquet(path)
    widths = [r.width for r in distinct.select("width").distinct().collect()]  # at most ``shingle`` numbers
    if not widths:
        shown = docs.select(ident, F.lit(0).cast("long").alias("mark"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("win"))
        return shown.where("false")

    # The words are bound as a lambda's variable, and no filter is inferred from an outer explode: so they are cut once per text.
    cut_once = F.transform(F.array(words_of(F.col(text))), lambda w: F.struct(w.alias("words"), F.concat(*[_shingles(w, k) for k in widths]).alias("all")))
    cut = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("mark"), F.inline(cut_once))

    # How often documents hold each shingle.
    known = parts.select("h").distinct()
    n = _passes(known.count(), shingles_a_pass)
    placed = cut.select(F.explode_outer("all").alias("s")).select("s.h")
    counts = reduce(DataFrame.unionByName, [
        placed.join(F.broadcast(known.where(F.pmod("h", F.lit(n)) == p)), "h").groupBy("h").agg(F.count(F.lit(1)).alias("n_docs")) for p in range(n)
    ])
    first = F.min(F.struct("n_docs", "h", "i")).alias("p")
    # A shingle without a count stands in no document: neither does its window.
    chosen = parts.join(counts, "h", "left").groupBy("win", "w").agg(first, F.max(F.col("n_docs").isNull()).alias("absent"))
    path = work_path(spark, "decontaminate-prefixes")
    chosen.where("NOT absent").select("win", "w", "p.h", F.col("p.i").alias("at")).write.parquet(path)
    prefixes = spark.read.parquet(path)

    n = _passes(prefixes.count(), windows_a_pass)
    spread = cut.select("id", "mark", "words", F.explode_outer("all").alias("s")).select("id", "mark", "words", "s.i", "s.h")
    start = F.col("i") - F.col("at") + 1
    fits = (start >= 1) & (start + F.size("w") - 1 <= F.size("words"))
    same = F.when(fits, F.slice("words", start, F.size("w")) == F.col("w")).otherwise(False)
    hits = reduce(DataFrame.unionByName, [
        spread.join(F.broadcast(prefixes.where(F.pmod(F.xxhash64("win"), F.lit(n)) == p)), "h")
        .where(same).select(F.col("id").alias(ident), "mark", start.alias("start"), F.size("w").alias("n"), "win")
        for p in range(n)
    ])
    path = work_path(spark, "decontaminate-hits")
    hits.write.parquet(path)
    return spark.read.parquet(path)


def contamination(
    docs: DataFrame, bench: DataFrame, width: int = 10, shingle: int = 4, ident: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", **passes: int,
) -> DataFrame:
    """``(ident, n_words, n_hit, items)`` per row of ``docs``: its words, those inside any item window, and the sorted ids (as text)
    of the items with a window in it.

    Null and empty texts have no words and no hits; an item without words has no windows; an item with a null id hits words but isn't
    listed; items that share an id count as one. Repeated rows each come back. Empty tables give no rows, or rows without
    hits. Other columns, whatever their names, play no part. A document's list is as long as its distinct items at most.
    """
    windows = item_windows(bench, width, item, item_text)
    hits = benchmark_hits(docs, windows, shingle, ident, text, **passes)
    keys = [F.col(ident).alias("id"), "mark"]
    spans = hits.groupBy(*keys, "start").agg(F.max("n").alias("n"))
    end = F.col("start") + F.col("n")
    earlier = F.max(end).over(Window.partitionBy("id", "mark").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.select("id", "mark", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(earlier, F.lit(0)))).alias("new"))
    n_hit = covered.groupBy("id", "mark").agg(F.sum("new").alias("n_hit"))
    named = windows.where("item IS NOT NULL").select("item", "win")
    listed = hits.select(*keys, "win").distinct().join(named, "win").select("id", "mark", "item").distinct()
    items = listed.groupBy("id", "mark").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = n_hit.join(items, n_hit["id"].eqNullSafe(items["id"]) & (n_hit["mark"] == items["mark"]), "left").select(
        n_hit["id"].alias("_id"), n_hit["mark"].alias("_mark"), "n_hit", "items"
    )
    n_words = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), GAP_ANY_CASE), "")).cast("long")
    rows = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("mark"), n_words.alias("n_words"))
    return rows.join(found, rows["id"].eqNullSafe(found["_id"]) & (rows["mark"] == found["_mark"]), "left").select(
        rows["id"].alias(ident), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def op13_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
items AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM items) WHERE len(w) >= n),
hits AS (SELECT r, i, p.n, item FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM places) p JOIN items USING (win)),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
  FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
