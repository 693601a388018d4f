"""Feature sets, weights and supervised compression of feature vectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETURNS = [f"ret_{n}d" for n in (1, 3, 7, 14, 30, 45, 60, 90)]
CANDLES = [f"candle_{n}d_{k}" for n in (1, 3, 5) for k in ("body_to_range", "upper_wick", "lower_wick", "body_position", "direction")]
FEATURE_SETS = {"returns_raw": RETURNS, "returns_only": [c.replace("ret_", "norm_") for c in RETURNS], "returns_candle": [c.replace("ret_", "norm_") for c in RETURNS] + CANDLES}


def feature_set(name: str) -> list[str]:
    """The ordered columns of a named set; the order is part of the contract."""
    if name not in FEATURE_SETS:
        raise KeyError(f"unknown feature set {name!r}; known: {sorted(FEATURE_SETS)}")
    return FEATURE_SETS[name]


def group_weights(groups: dict[str, list[str]]) -> dict[str, float]:
    """Weights by which two groups of features contribute alike: sqrt(total / (2 size))."""
    total = sum(map(len, groups.values()))
    return {c: math.sqrt(total / (2 * len(cols))) for cols in groups.values() for c in cols}


def rank_weights(ranked: list[str], power: float) -> dict[str, float]:
    """Weights ((n - r) / n) ** power by rank, scaled to sum to n."""
    n = len(ranked)
    raw = [((n - r) / n) ** power for r in range(n)]
    return {c: w * n / sum(raw) for c, w in zip(ranked, raw)}


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 16) -> DataFrame:
    """``feature, mi``: binned mutual information with a 0/1 label, in nats (a stand-in for neighbour-based estimators).

    Bins are quantiles (approximate, one pass); the counts are one groupBy per feature over a stacked table.
    """
    cuts = df.approxQuantile(features, [i / bins for i in range(1, bins)], 0.001)
    each = [F.struct(F.lit(c).alias("feature"), sum(((F.col(c) > float(x)).cast("int") for x in cut), F.lit(0)).alias("bin")) for c, cut in zip(features, cuts)]
    long = df.where(F.col(label).isNotNull()).select(F.explode(F.array(*each)).alias("x"), F.col(label).cast("int").alias("y"))
    n = long.where("x.bin is not null").groupBy("x.feature", "x.bin", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    fx = n.groupBy("feature", "bin").agg(F.sum("n").alias("nx"))
    fy = n.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    tot = n.groupBy("feature").agg(F.sum("n").alias("nt"))
    j = n.join(fx, ["feature", "bin"]).join(fy, ["feature", "y"]).join(tot, "feature")
    return j.groupBy("feature").agg(F.sum(F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))).alias("mi"))


def fit_compression(df: DataFrame, features: list[str], label: str, size: int) -> tuple[dict[str, float], np.ndarray]:
    """Importances |cov(x, y)| / sd(x) and the projection onto the ``size`` leading directions of the weighted features.

    All moments come from one aggregate (a D x D matrix); only it reaches the driver.
    """
    d = len(features)
    if size >= d:
        raise ValueError("the compressed size must be below the number of features")
    ok = df.na.drop(subset=[*features, label])
    gram = [F.avg(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]
    row = ok.agg(*gram, *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.covar_pop(c, label).alias(f"c{i}") for i, c in enumerate(features)]).first()
    g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    mean = np.array([row[f"m{i}"] for i in range(d)])
    sd = np.sqrt(np.maximum(np.diag(g) - mean**2, 0.0))
    importance = np.abs(np.array([row[f"c{i}"] for i in range(d)])) / np.where(sd > 0, sd, 1.0)
    w = np.sqrt(importance + 1e-8)
    values, vectors = np.linalg.eigh(g * np.outer(w, w))
    top = vectors[:, np.argsort(-values)[:size]]
    top = top * np.where(top[np.abs(top).argmax(axis=0), np.arange(size)] < 0, -1.0, 1.0)
    return dict(zip(features, importance.tolist())), top


def top_features(importance: dict[str, float], n: int) -> list[str]:
    """The n most important features, equal ones by name."""
    return sorted(importance, key=lambda c: (-importance[c], c))[:n]


def project(features: list[str], matrix: np.ndarray) -> Column:
    """The compressed vector: the features times the projection."""
    return F.array(*[sum((F.col(c) * F.lit(float(matrix[i, k])) for i, c in enumerate(features)), F.lit(0.0)) for k in range(matrix.shape[1])])
