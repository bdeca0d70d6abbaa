"""Vectors packed into blocks, so that searches run as matrix work on bounded pieces.

A search compares every query block with every candidate block: the query blocks are sent to each candidate block by an
equi-join on the block number. A task holds one pair of blocks at a time; nothing depends on the number of blocks. The best
rows of every pair are merged by a window that drops all but the top rows before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 8192


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector.cast("array<double>"), fine), F.lit(False))


def packed(vectors: DataFrame, ident: str, vector: str, rows_per_block: int) -> tuple[DataFrame, int]:
    """``(block, ids, flat, dims)`` with little-endian int64 ids and float64 components, and the number of blocks.

    A shorter vector of a block counts as filled up with zeros. Rows go to blocks by a hash of id and vector.
    """
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-rows.count() // rows_per_block))
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))

    def pack(key, table):
        vs = table.column("v").combine_chunks()
        dims = int(max(vs.value_lengths().to_numpy(zero_copy_only=False), default=0)) if len(vs) else 0
        lens = vs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vs.flatten().to_numpy(zero_copy_only=False)
        dense = np.zeros((len(vs), dims))
        dense[np.repeat(np.arange(len(vs)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
        ids = table.column("id").to_numpy()
        order = np.lexsort((*dense.T[::-1], ids))  # the block's order doesn't depend on how its rows arrived
        return pa.table({
            "block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
            "flat": pa.array([dense[order].astype("<f8").tobytes()], pa.binary()), "dims": pa.array([dims], pa.int32()),
        })

    return keyed.groupBy("block").applyInArrow(pack, "block int, ids binary, flat binary, dims int"), blocks


def unpack(ids: bytes, flat: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(flat, "<f8").reshape(len(i), dims)


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the larger number of columns, filled up with zeros."""
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) if x.shape[1] < d else x for x in (a, b))


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def search(
    candidates: DataFrame, queries: DataFrame, ident: str, vector: str, k: int, find: Search, score: str,
    rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = 1024,
) -> DataFrame:
    """``(query_id, rank, <ident>, score)``: the ``k`` best candidates of each query, ties to the smaller id.

    ``find(query_ids, query_rows, ids, rows)`` returns the hits of a pair of blocks as query position, row position and
    score; it leaves out a query's own id. A fourth item may hold bytes (or None) by which hits of equal score are ordered first,
    largest first.
    """
    left, n = packed(candidates, ident, vector, rows_per_block)
    right, _ = packed(queries.dropDuplicates([ident, vector]), ident, vector, queries_per_block)
    sent = right.select(
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.col("ids").alias("qids"), F.col("flat").alias("qflat"),
        F.col("dims").alias("qdims"), F.col("block").alias("qblock"),
    )

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].as_py()  # noqa: E731, B023
                qids, q = unpack(get("qids"), get("qflat"), get("qdims"))
                ids, c = unpack(get("ids"), get("flat"), get("dims"))
                at, row, value, *finer = find(qids, *widened(q, c)[:1], ids, widened(q, c)[1])
                finer = pa.array(finer[0] if finer else [None] * len(value), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[at]), pa.array(at + (get("qblock") << 20), pa.int64()), pa.array(ids[row]), pa.array(value), finer],
                    names=["query_id", "_query", ident, "score", "_finer"],
                )

    hits = left.join(sent, "block").mapInArrow(run, f"query_id long, _query long, {ident} long, score {score}, _finer binary")
    best = Window.partitionBy("query_id", "_query").orderBy(F.col("score").desc(), F.col("_finer").desc(), ident)
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", ident, "score")
