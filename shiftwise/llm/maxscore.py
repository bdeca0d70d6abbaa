"""Exact top-k search by MaxScore over integer vectors.

A dimension is a query term, a vector's component its impact. Shifted by the smallest product a term can give in a block,
impacts are not negative and each term has an upper bound. For the running k-th best score, the terms with the smallest bounds
whose sum can't reach it are non-essential: the postings of the others are traversed for all rows; then the non-essential
terms are probed, largest bound first, only for rows that can still reach the k-th best. A row is
dropped only when its best possible score is strictly below, so ties are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwise.llm import vectors

SCALE = 1024
FIRST = 256  # rows scored in full to get a first k-th best


def block_top_k(query: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray, k: int):
    """Rows that can be among the ``k`` best of a block, and their scores. ``columns`` has a row per dimension."""
    n = columns.shape[1]
    a, b = query * low, query * high
    least, bound = np.minimum(a, b), np.abs(a - b)
    rows = np.flatnonzero(allowed)
    if len(rows) <= k:
        return rows, query @ columns[:, rows]
    first = np.partition(query @ columns[:, rows[: max(FIRST, k)]], -k)[-k]
    order = np.argsort(-bound, kind="stable")
    shift = int(least.sum())
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # bound of the terms from here on
    essential = int(np.argmax(rest < first - shift)) if (rest < first - shift).any() else len(order)
    part = np.zeros(n, np.int64)
    for d in order[:essential]:
        part += query[d] * columns[d] - least[d]
    part = part[rows]
    for at in range(essential, len(order) + 1):
        if len(part) >= k:
            first = max(first, int(np.partition(part, -k)[-k]) + shift)  # what is left to add isn't negative
        alive = part + rest[at] >= first - shift
        if not alive.all():
            rows, part = rows[alive], part[alive]
        if at < len(order):
            d = order[at]
            part = part + (query[d] * columns[d, rows] - least[d])
    return rows, part + shift


LARGEST = np.iinfo(np.int64).max


def sortable(x: int) -> bytes:
    """Bytes that sort like whole numbers of any size."""
    size = x.bit_length() // 8 + 1
    body = size.to_bytes(4, "big") + abs(x).to_bytes(size, "big")
    return b"\1" + body if x >= 0 else b"\0" + bytes(255 - b for b in body)


def exact_top_k(query: np.ndarray, rows: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int):
    """The same for components whose products don't fit 64 bits: whole numbers of any size. Scores beyond a long are held at its ends, with
    bytes that sort like the number itself."""
    at = np.flatnonzero(allowed)
    whole = [int(x) for x in query]
    scores = [sum(a * int(b) for a, b in zip(whole, rows[r])) for r in at]
    best = sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]]))[:k]
    held = np.array([max(-LARGEST - 1, min(LARGEST, scores[i])) for i in best], np.int64)
    return at[best], held, [sortable(scores[i]) if not -LARGEST - 1 < scores[i] < LARGEST else None for i in best]


def top_k(df: DataFrame, ident: str, vector: str, is_query, k: int, rows_per_block: int = vectors.ROWS_PER_BLOCK) -> DataFrame:
    """``(query_id, rank, <ident>, score)`` for integer-valued vectors and their inner product.

    Rows with a null vector, null or non-finite components, or a null id take no part; a shorter vector counts as filled up
    with zeros; a query's own id is no candidate of it; repeated candidate rows are rows of their own, repeated query rows one query;
    an empty table gives no rows. Scores are exact; those beyond a long are ranked by their true value and held at its ends.
    """
    rows = df.where(vectors.usable(F.col(vector)) & F.col(ident).isNotNull()).select(ident, vector)

    def find(qids, q, ids, c):
        at, row, score, finer = [], [], [], []
        largest = np.abs(q).max(initial=0).astype(np.longdouble) * np.abs(c).sum(axis=1, dtype=np.longdouble).max(initial=0)
        if largest >= 2.0**61 or max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) >= 2.0**61:
            for i in range(len(q)):
                r, s, f = exact_top_k(q[i], c, ids != qids[i], ids, k)
                at.append(np.full(len(r), i)), row.append(r), score.append(s), finer.extend(f)
            return *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, row, score)), finer
        q, columns = q.astype(np.int64), np.ascontiguousarray(c.astype(np.int64).T)
        low, high = (columns.min(axis=1), columns.max(axis=1)) if columns.size else (np.zeros(len(columns), np.int64),) * 2
        for i in range(len(q)):
            r, s = block_top_k(q[i], columns, low, high, ids != qids[i], k)
            best = np.lexsort((ids[r], -s))[:k]
            at.append(np.full(len(best), i)), row.append(r[best]), score.append(s[best])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, row, score))

    return vectors.search(rows, rows.where(is_query), ident, vector, k, find, "long", rows_per_block)


def op7_maxscore(spark, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    whole = v.where(vectors.usable(F.col("v"))).select("vec_id", F.transform("v", lambda x: F.floor(SCALE * x).cast("double")).alias("v"))
    return top_k(whole, "vec_id", "v", F.col("vec_id") % 100 == 0, 10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
