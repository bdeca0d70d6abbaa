"""Two-pass external shuffle into shards.

Pass one scatters the records by a seeded hash into buckets of about ``bucket_bytes``, pass two shuffles every bucket in
memory (Spark's ``shuffle`` is a Fisher-Yates shuffle) and lays the buckets end to end. The place in that order decides the
shard and the slot, so shards differ by one row at most (law ``rows``).

``shuffle`` draws from one generator per partition. So that reruns and recomputed tasks draw alike, the buckets go to a
fixed number of partitions, and each partition handles its buckets in order, each bucket's rows sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.operators.ordered import prefix_sums
from shiftwise.session import work_path

BUCKET_BYTES = 16 << 20  # of text; a task holds a bucket a few times over


def text_bytes(c: Column) -> Column:
    return (F.coalesce(F.octet_length(c), F.lit(0)) + 1).cast("long")


def external_shuffle(df: DataFrame, keys: list[str], size: str, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``df`` plus ``_place``, their place in a random order (from 0, without gaps); a column of that name is replaced.

    ``keys`` should tell rows apart; rows equal in all of them share a bucket. Nulls are values like others; an empty table gives
    no rows. The only figures that reach the driver are the row count and the byte total.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-int(total) // bucket_bytes))
    mixed = F.xxhash64(F.lit(seed), *[F.struct(F.col(k)) for k in keys])
    rows = df.select(F.pmod(mixed, F.lit(n)).alias("_bucket"), mixed.alias("_mix"), F.struct(*df.columns).alias("_row"))
    spread = min(n, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    path = work_path(df.sparkSession, "bucket-counts")
    rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).write.parquet(path)
    counts = prefix_sums(df.sparkSession.read.parquet(path), [], ["_bucket"], {"_n": F.col("_n")})
    starts = counts.select("_bucket", (F.col("_n_upto") - F.col("_n")).alias("_start")).repartition(spread, "_bucket")
    scattered = rows.repartition(spread, "_bucket")
    filled = scattered.groupBy("_bucket").agg(F.sort_array(F.collect_list(F.struct("_mix", "_row"))).alias("_rows"))
    placed = filled.join(starts, "_bucket").sortWithinPartitions("_bucket")
    out = placed.select("_start", F.shuffle("_rows", seed).alias("_rows")).select("_start", F.posexplode("_rows").alias("_i", "_r"))
    kept = [F.col("_r._row").getField(c).alias(c) for c in df.columns if c.lower() != "_place"]
    return out.select(*kept, (F.col("_start") + F.col("_i")).alias("_place"))


def shard_rows(df: DataFrame, shards: int, keys: list[str], size: str, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Law ``rows``: the columns of ``df`` plus ``shard`` and ``slot``; row counts differ by one at most, slots run from 0. Columns of
    ``df`` with one of these names are replaced."""
    placed = external_shuffle(df, keys, size, seed, bucket_bytes)
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*[F.col(f"`{c}`") for c in kept], (F.col("_place") % shards).cast("int").alias("shard"), F.floor(F.col("_place") / shards).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; every bucket's task writes its rows, so in a file they ascend by slot within a bucket."""
    sharded.write.partitionBy("shard").mode("errorifexists").parquet(path)


def op10_shards(spark, sf_dir: str) -> DataFrame:
    """Whole documents are scattered, shuffled and written; sizes and digests are those of the shards read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = work_path(spark, "shards")
    write_shards(shard_rows(docs.withColumn("size", text_bytes(F.col("text"))), 8, ["doc_id", "text"], "size"), path)
    schema = "doc_id long, text string, size long, slot long, shard int"
    out = spark.read.schema(schema).parquet(path)
    return out.select(
        "doc_id", text_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
