"""Linear projections.

All moments come from Spark; the driver only ever holds matrices of the size of the feature list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Projection:
    """``component_j = sum_i (x_i - mean_i) * weights[i][j]``."""

    features: list[str]
    mean: np.ndarray
    weights: np.ndarray
    prefix: str = "component_"

    def columns(self) -> list[Column]:
        out = []
        for j in range(self.weights.shape[1]):
            terms = [
                (F.col(f) - float(self.mean[i])) * float(self.weights[i, j]) for i, f in enumerate(self.features)
            ]
            out.append(sum(terms[1:], terms[0]).alias(f"{self.prefix}{j + 1}"))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *self.columns())

    def inverse_columns(self) -> list[Column]:
        """Features back from the components (least squares; exact on the plane of an orthonormal projection)."""
        back = np.linalg.pinv(self.weights)
        parts = [F.col(f"{self.prefix}{j + 1}") for j in range(self.weights.shape[1])]
        return [
            sum([p * float(back[j, i]) for j, p in enumerate(parts)], F.lit(float(self.mean[i]))).alias(f)
            for i, f in enumerate(self.features)
        ]


def means(df: DataFrame, features: list[str]) -> np.ndarray:
    return np.array(df.agg(*[F.avg(f).alias(f) for f in features]).first(), dtype=float)


def _pca(df: DataFrame, features: list[str], k: int):
    vectors = df.select(array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("_x"))
    return PCA(k=k, inputCol="_x", outputCol="_y").fit(vectors)


def _signed(weights: np.ndarray) -> np.ndarray:
    """The largest loading of every component points up."""
    top = np.argmax(np.abs(weights), axis=0)
    return weights * np.where(weights[top, np.arange(weights.shape[1])] < 0, -1.0, 1.0)


def covariance(df: DataFrame, features: list[str]) -> np.ndarray:
    """Sample covariance, put together again from all principal components and the total variance."""
    model = _pca(df, features, len(features))
    total = sum(df.agg(*[F.var_samp(f).alias(f) for f in features]).first())
    axes = model.pc.toArray()
    return (axes * (np.array(model.explainedVariance.toArray()) * total)) @ axes.T


def fit_pca(df: DataFrame, features: list[str], k: int = 2) -> Projection:
    """X1. Spark's PCA does not centre the rows it transforms, so the mean is kept with the weights."""
    return Projection(features, means(df, features), _signed(_pca(df, features, k).pc.toArray()))


def fit_lda(df: DataFrame, features: list[str], label: str = "label", k: int = 2) -> Projection:
    """Linear discriminant axes from the between-class scatter against the within-class scatter."""
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f) for f in features])
    rows = per_class.collect()  # one row per class
    if k > len(rows) - 1:
        raise ValueError("components must be fewer than the classes")
    n = np.array([r._n for r in rows], dtype=float)
    centres = np.array([[r[f] for f in features] for r in rows])
    overall = (n[:, None] * centres).sum(axis=0) / n.sum()
    gap = centres - overall
    total = covariance(df, features) * (n.sum() - 1)
    between = (n[:, None] * gap).T @ gap
    within = (total - between) / (n.sum() - len(rows))
    values, axes = np.linalg.eigh(within)
    keep = values > max(values.max(), 0) * 1e-12
    whiten = axes[:, keep] / np.sqrt(values[keep])
    spread, turn = np.linalg.eigh(whiten.T @ between @ whiten)
    best = np.argsort(spread)[::-1][:k]
    return Projection(features, overall, _signed(whiten @ turn[:, best]))


def fit_factor_analysis(
    df: DataFrame, features: list[str], k: int = 2, rounds: int = 1000, tolerance: float = 1e-8
) -> Projection:
    """Factors with one noise variance per feature, by EM on the covariance; scores are posterior means."""
    n = df.count()
    cov = covariance(df, features) * (n - 1) / n
    values, axes = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:k]
    loadings = axes[:, top] * np.sqrt(np.maximum(values[top], 1e-12))
    noise = np.maximum(np.diag(cov) - (loadings**2).sum(axis=1), 1e-6)

    def scores(loadings, noise):
        scaled = loadings / noise[:, None]
        return np.linalg.solve(np.eye(k) + loadings.T @ scaled, scaled.T)

    for _ in range(rounds):
        beta = scores(loadings, noise)
        moved = cov @ beta.T @ np.linalg.inv(np.eye(k) - beta @ loadings + beta @ cov @ beta.T)
        noise_new = np.maximum(np.diag(cov - moved @ beta @ cov), 1e-12)
        step = max(np.abs(moved - loadings).max(), np.abs(noise_new - noise).max())
        loadings, noise = moved, noise_new
        if step < tolerance:
            break
    return Projection(features, means(df, features), scores(loadings, noise).T)


def fit_fast_ica(
    df: DataFrame, features: list[str], k: int = 2, rounds: int = 50, tolerance: float = 1e-4, seed: int = 42
) -> Projection:
    """Independent components by the symmetric fixed point with log-cosh; one aggregate per round."""
    mean, cov = means(df, features), covariance(df, features)
    values, axes = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:k]
    whiten = _signed(axes[:, top]) / np.sqrt(np.maximum(values[top], 1e-12))
    white = Projection(features, mean, whiten, "_z").transform(df.select(*features)).select(
        *[F.col(f"_z{j + 1}") for j in range(k)]
    ).persist()

    def decorrelated(w: np.ndarray) -> np.ndarray:
        s, u = np.linalg.eigh(w @ w.T)
        return u @ np.diag(1 / np.sqrt(np.maximum(s, 1e-12))) @ u.T @ w

    turn = decorrelated(np.random.default_rng(seed).normal(size=(k, k)))
    for _ in range(rounds):
        aggs = []
        for r in range(k):
            proj = sum([F.col(f"_z{j + 1}") * float(turn[r, j]) for j in range(k)], F.lit(0.0))
            g = F.tanh(proj)
            aggs += [F.avg(g * F.col(f"_z{j + 1}")) for j in range(k)] + [F.avg(1 - g * g)]
        got = np.array(white.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first(), dtype=float).reshape(k, k + 1)
        moved = decorrelated(got[:, :k] - got[:, k:] * turn)
        step = np.max(np.abs(np.abs(np.sum(moved * turn, axis=1)) - 1))
        turn = moved
        if step < tolerance:
            break
    white.unpersist()
    return Projection(features, mean, whiten @ turn.T)


FITS = {"pca": fit_pca, "ica": fit_fast_ica, "fa": fit_factor_analysis}


def reduce_dimensions(
    df: DataFrame, features: list[str], kind: str = "pca", k: int = 2, label: str | None = None, fit: DataFrame | None = None
) -> DataFrame:
    """Add ``component_1..k``; fitted on ``fit`` (default: all rows)."""
    base = df if fit is None else fit
    if kind == "lda":
        if label is None:
            raise ValueError("LDA needs labels")
        return fit_lda(base, features, label, k).transform(df)
    if kind not in FITS:
        raise ValueError(f"unsupported reducer {kind!r}")
    return FITS[kind](base, features, k).transform(df)


def feature_space_2d(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Plot coordinates ``x, y``: the two features themselves, or two principal components of more."""
    if len(features) == 1:
        return df.select(*keep, F.col(features[0]).alias("x"), F.lit(0.0).alias("y"))
    if len(features) == 2:
        return df.select(*keep, F.col(features[0]).alias("x"), F.col(features[1]).alias("y"))
    return reduce_dimensions(df, features).select(
        *keep, F.col("component_1").alias("x"), F.col("component_2").alias("y")
    )
