"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

Rows are taken in bands of similar length, the longest first; a band is left out once the k-th best product found is above what its
longest row could reach. Inside a band inner products become distances: vectors are scaled so that its longest has length 1 and get
one more component that fills their length up to 1; a query has length 1 and gets 0 there. A table hashes a vector by
``floor((a.x + b) / width)`` for a few Gaussian directions ``a``. A query visits its own bucket and then perturbed buckets, which
differ from it in some hash values, by the squared distance from the query's projections to the middle of the bucket, over all tables;
perturbations that lead to no row are not generated. The first visits give the wanted share of the band's rows. Then the k-th best product
found is a distance d no better row exceeds, and every bucket is visited whose squared distance is at most the ``1 - MISS`` quantile of
what a row at distance d has: a sum of squares of ``d * normal + uniform(-width / 2, width / 2)``, whatever the vectors are. So a true
neighbour is missed by one table with a chance of at most ``MISS`` and by all with ``MISS ** tables`` (0.026). The tables'
candidates are merged and ranked by the exact product. Every row is in the index; directions and width are the same in all
blocks (fixed seed). Vectors without structure in many dimensions need a large share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwise.llm import vectors

TABLES, HASHES, WIDTH = 4, 32, 0.75
PROBE = 0.3  # rows that the first visits give, repeats among tables included, as a share of a band's rows
BAND = 2**0.25  # the longest row of a band to its shortest, at most
MISS, MISS_Z = 0.4, 0.2533  # chance that a table misses a row at the bound; the normal quantile of 1 - MISS


def directions(dims: int, tables: int, hashes: int, width: float, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dims, tables, hashes)), rng.uniform(0, width, (tables, hashes))


def grouped(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order that puts equal rows together, and where each group starts."""
    order = np.lexsort(cells.T)
    fresh = (cells[order[1:]] != cells[order[:-1]]).any(axis=1)
    return order, np.flatnonzero(np.append(True, fresh))


def lengths(x: np.ndarray) -> np.ndarray:
    """In extended precision, whose range holds the square of any double."""
    return np.sqrt((x.astype(np.longdouble) ** 2).sum(axis=1))


def bands(length: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each band, the longest rows first; a band starts at its longest row."""
    order = np.argsort(-length, kind="stable")
    falling, cut = -length[order], [0]
    while cut[-1] < len(order):
        cut.append(int(np.searchsorted(falling, falling[cut[-1]] / BAND, "right")))
    return [order[x:y] for x, y in zip(cut, cut[1:])]


def farthest(square: float, hashes: int, width: float) -> float:
    """``1 - MISS`` quantile (Wilson-Hilferty) of the squared distance to the middle of its bucket for a row at this squared distance."""
    mean = square + width**2 / 12
    spread = 3 * square**2 + square * width**2 / 2 + width**4 / 80 - mean**2
    part = 2 / 9 * spread / (2 * mean**2 * hashes)
    return hashes * mean * (1 - part + MISS_Z * part**0.5) ** 3


def nearest(
    df: DataFrame, ident: str, vector: str, is_query, k: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH,
    probe: float = PROBE, rows_per_block: int = vectors.ROWS_PER_BLOCK,
) -> DataFrame:
    """``(query_id, rank, <ident>, score)``: the ``k`` found rows with the largest inner products, in double precision.

    Rows with a null id, or a vector that is null, zero or holds null or non-finite components take no part. A shorter
    vector counts as filled up with zeros; a query's own id is no candidate; repeated candidate rows are rows of their own,
    repeated query rows one query; an empty table gives no rows. Where a block has no more than ``4 * k`` rows all are ranked.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.where(vectors.usable(F.col(vector)) & F.exists(v, lambda x: x != 0) & F.col(ident).isNotNull())
    rows = rows.select(ident, v.alias(vector))

    def find(qids, q, ids, c):
        n, dims = c.shape
        if n == 0 or len(q) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        length, asked_length = lengths(c), lengths(q)
        asked = (q / asked_length[:, None]).astype(np.float64)
        a, b = directions(dims + 1, tables, hashes, width)
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        kth = np.full(len(q), -np.inf)

        def rank(i, cand):
            cand = cand[ids[cand] != qids[i]]
            s = np.append(best[i][1], c[cand] @ q[i])
            cand = np.append(best[i][0], cand)
            top = np.argpartition(-s, k - 1)[:k] if len(s) > k else np.arange(len(s))
            top = np.flatnonzero(s >= s[top].min()) if len(s) > k else top
            top = top[np.lexsort((ids[cand[top]], -s[top]))[:k]]
            best[i] = cand[top], s[top]
            kth[i] = s[top[-1]] if len(top) == k else -np.inf

        for band in [np.arange(n)] if n <= 4 * k else bands(length):
            m, longest = len(band), length[band].max()
            reach = lambda i: (kth[i] / (asked_length[i] * longest)).astype(np.float64)  # noqa: E731, B023
            live = np.flatnonzero(~(reach(np.arange(len(q))) > 1 + 1e-9))
            if m <= 4 * k:
                for i in live:
                    rank(i, band)
                continue
            if not len(live):
                continue
            unit = (c[band] / longest).astype(np.float64)
            fill = np.sqrt(np.maximum(0.0, 1 - (unit**2).sum(axis=1)))
            own = np.hstack([unit, fill[:, None]])
            costs, sizes, starts, members, at_row = [], [], [], [], 0
            for t in range(tables):
                cells = np.floor((own @ a[:, t] + b[t]) / width)
                order, first = grouped(cells)
                middle = (cells[order[first]] + 0.5) * width
                place = asked[live] @ a[:dims, t] + b[t]
                costs.append(((place**2).sum(axis=1)[:, None] - 2 * place @ middle.T + (middle**2).sum(axis=1)).astype(np.float32))
                sizes.append(np.diff(np.append(first, m)))
                starts.append(first + at_row)
                members.append(order)
                at_row += m
            cost, size, start, member = np.hstack(costs), np.concatenate(sizes), np.concatenate(starts), np.concatenate(members)
            effort = np.minimum(size, 4 * k)  # a bucket of copies counts little: they rank alike
            wanted = max(4 * k * tables, int(np.ceil(probe * m)))
            for j, i in enumerate(live):
                near = np.argpartition(cost[j], wanted)[:wanted] if wanted < len(size) else np.arange(len(size))
                near = near[np.argsort(cost[j, near], kind="stable")]
                visit = near[np.cumsum(effort[near]) - effort[near] < wanted]
                seen = np.zeros(m, bool)
                for _ in range(2):  # the first visits, then all that the bound doesn't rule out
                    much = size[visit]
                    fresh = np.zeros(m, bool)
                    fresh[member[np.repeat(start[visit] - (np.cumsum(much) - much), much) + np.arange(much.sum())]] = True
                    rank(i, band[fresh & ~seen])
                    seen |= fresh
                    cos = float(reach(i))
                    visit = np.flatnonzero(cost[j] <= farthest(2 - 2 * min(1.0, cos), hashes, width) * (1 + 1e-5)) if cos > -1 else np.arange(len(size))
                    if cos > 1 + 1e-9 or seen.all():
                        break
        at = np.repeat(np.arange(len(q)), [len(r) for r, _ in best])
        return at, np.concatenate([r for r, _ in best]), np.concatenate([s for _, s in best])

    return vectors.search(rows, rows.where(is_query), ident, vector, k, find, "double", rows_per_block)


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(v, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)
