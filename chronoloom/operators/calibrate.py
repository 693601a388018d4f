"""Probability calibration and conformal bands.

Models are fitted on all rows, as counts of equal inputs: each Newton step is one aggregate over the counts,
the isotonic curve is pooled block by block where the rows lie. Only coefficients and the
pooled curve reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import staged


def _counts(rows: DataFrame, x: str, y: str) -> DataFrame:
    """``x, n, s``: every distinct input with its rows and the sum of its labels."""
    ok = rows.where(F.col(x).isNotNull() & ~F.isnan(x) & F.col(y).isNotNull())
    return staged(ok.groupBy(F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("double").alias("s")), "counts")


def logistic(counts: DataFrame, features: list[Column], ridge: float) -> np.ndarray:
    """Newton's method, one aggregate a step; the last coefficient is the unpenalised intercept."""
    k = len(features) + 1
    parts = [*features, F.lit(1.0)]
    w = np.zeros(k)
    penalty = np.full(k, ridge)
    penalty[-1] = 0.0
    for _ in range(100):
        z = sum((F.lit(float(c)) * f for c, f in zip(w, parts)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))
        gap, curve = F.col("n") * F.col("p") - F.col("s"), F.col("n") * F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-12))
        sums = [F.sum(gap * f) for f in parts] + [F.sum(curve * parts[a] * parts[b]) for a in range(k) for b in range(a, k)]
        got = [float(v or 0.0) for v in counts.withColumn("p", p).agg(*[c.alias(f"a{i}") for i, c in enumerate(sums)]).first()]
        hess, at = np.zeros((k, k)), k
        for a in range(k):
            for b in range(a, k):
                hess[a, b] = hess[b, a] = got[at]
                at += 1
        step = np.linalg.solve(hess + np.diag(penalty + 1e-12), np.array(got[:k]) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fit_platt(rows: DataFrame, x: str = "raw_prob", y: str = "y") -> tuple[float, float]:
    """Slope and intercept of a logistic curve with unit ridge penalty on the slope."""
    slope, base = logistic(_counts(rows, x, y), [F.col("x")], 1.0)
    return float(slope), float(base)


def platt(p: Column, slope: float, base: float) -> Column:
    return 1 / (1 + F.exp(-(p * slope + base)))


def fit_beta(rows: DataFrame, x: str = "raw_prob", y: str = "y") -> tuple[float, float, float]:
    """a, b, c of logit = a ln p - b ln(1 - p) + c; a negative coefficient is set to 0 and the rest refitted."""
    counts = _counts(rows, x, y)
    q = F.greatest(F.least(F.col("x"), F.lit(1 - 1e-12)), F.lit(1e-12))
    up, down = F.ln(q), -F.log1p(-q)
    a, b, c = logistic(counts, [up, down], 0.0)
    if a < 0:
        b, c = logistic(counts, [down], 0.0)
        a = 0.0
    elif b < 0:
        a, c = logistic(counts, [up], 0.0)
        b = 0.0
    return float(max(a, 0)), float(max(b, 0)), float(c)


def beta(p: Column, a: float, b: float, c: float) -> Column:
    # least and greatest skip NULL, so it is kept apart
    q = F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12)))
    return 1 / (1 + F.exp(-(a * F.ln(q) - b * F.log1p(-q) + c)))


def pooled(x: np.ndarray, n: np.ndarray, s: np.ndarray, last: np.ndarray | None = None) -> list[list[float]]:
    """Pool adjacent violators: blocks of first input, last input, count and label sum with rising means."""
    blocks: list[list[float]] = []
    for a, b, k, t in zip(x, x if last is None else last, n, s):
        blocks.append([a, b, k, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            hi = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi[1], blocks[-1][2] + hi[2], blocks[-1][3] + hi[3]]
    return blocks


def fit_isotonic(rows: DataFrame, x: str = "raw_prob", y: str = "y") -> tuple[list[float], list[float]]:
    """Knots and values of a rising curve by pooling adjacent violators.

    Ranges of inputs are pooled where they lie and the pooled blocks once more (violators may be pooled in
    any order); only blocks reach the driver, as they are the curve.
    """
    counts = _counts(rows, x, y).repartitionByRange("x").sortWithinPartitions("x")

    def run(batches):
        blocks: list[list[float]] = []
        for pdf in batches:  # sorted: pooled blocks of what came before stay first
            old = np.array(blocks, dtype=float).reshape(-1, 4)
            v = pdf["x"].to_numpy(float)
            blocks = pooled(np.append(old[:, 0], v), np.append(old[:, 2], pdf["n"]), np.append(old[:, 3], pdf["s"]), np.append(old[:, 1], v))
        yield pd.DataFrame(blocks, columns=["lo", "hi", "n", "s"], dtype=float)

    got = counts.mapInPandas(run, "lo double, hi double, n double, s double").toPandas().sort_values("lo")
    knots, values = [], []
    for lo, hi, k, t in pooled(got["lo"].to_numpy(), got["n"].to_numpy(), got["s"].to_numpy(), got["hi"].to_numpy()):
        for edge in sorted({lo, hi}):
            knots.append(float(edge))
            values.append(float(t / k))
    return knots, values


def calibrator(kind: str, rows: DataFrame, x: str = "raw_prob", y: str = "y") -> dict:
    """A fitted calibrator as plain data, ``kind`` and ``params``: "platt", "beta", "isotonic" or "none"."""
    fits = {"platt": fit_platt, "beta": fit_beta, "isotonic": fit_isotonic, "none": lambda *_: ()}
    if kind not in fits:
        raise ValueError(f"unknown calibrator {kind!r}; known: {sorted(fits)}")
    return {"kind": kind, "params": [list(v) if isinstance(v, (list, tuple)) else v for v in fits[kind](rows, x, y)]}


def apply(model: dict, p: Column) -> Column:
    """The calibrated probability."""
    return {"platt": platt, "beta": beta, "isotonic": isotonic, "none": lambda c: c}[model["kind"]](p, *model["params"])


def isotonic(p: Column, knots: list[float], values: list[float]) -> Column:
    """The rising curve at p: linear between knots, constant beyond the ends; NULL for NULL."""
    x, y = np.asarray(knots), np.asarray(values)

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series(np.interp(s.fillna(0.0).to_numpy(float), x, y), index=s.index)
        return out.astype(object).where(s.notna(), None)

    return run(p)


def fit_mixture(rows: DataFrame, members: str, target: str, rounds: int = 30, dof: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and variances of a Student-t mixture around K members by expectation maximisation over all rows.

    Each step is one pass in which every task reduces its rows to K sums; rows with a null target or members of another length than the first row's are an error.
    """
    rows = staged(rows.where(F.col(target).isNotNull()).select(F.col(members).alias("x"), F.col(target).cast("double").alias("y")), "members")
    first = rows.agg(F.max(F.size("x")), F.min(F.size("x")), F.var_pop("y")).first()
    k = first[0] or 0
    if k != (first[1] or 0):
        raise ValueError("all rows need the same number of members")
    if not k:
        return np.empty(0), np.empty(0)
    spread = rows.select(F.explode(F.transform("x", lambda v: F.col("y") - v)).alias("g")).agg(F.var_pop("g")).first()[0]
    weight, var = np.full(k, 1.0 / k), np.full(k, max(float(spread or 0.0), 1e-6))
    for _ in range(rounds):
        got = rows.mapInPandas(_expectations(weight, var, dof), "i int, n double, r double, v double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum("v").alias("v")).toPandas().sort_values("i")
        r = got["r"].to_numpy()
        weight, var = r / got["n"].to_numpy(), np.maximum(got["v"].to_numpy() / np.maximum(r, 1e-12), 1e-6)
    return weight / weight.sum(), var


def _expectations(weight: np.ndarray, var: np.ndarray, dof: float):
    def run(batches):
        n, r, v = 0.0, np.zeros(len(weight)), np.zeros(len(weight))
        for pdf in batches:
            gap2 = (pdf["y"].to_numpy(float)[:, None] - np.stack(pdf["x"].to_numpy())) ** 2
            dens = weight * (1 + gap2 / (dof * var)) ** (-(dof + 1) / 2) / np.sqrt(var)
            resp = dens / np.maximum(dens.sum(axis=1, keepdims=True), 1e-300)
            n, r, v = n + len(pdf), r + resp.sum(axis=0), v + (resp * (dof + 1) / (dof + gap2 / var) * gap2).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(len(weight)), "n": n, "r": r, "v": v})

    return run


def mixture_density(members: Column, weight: list[float], var: list[float], at: Column, dof: float = 3.0) -> Column:
    """Density of the Student-t mixture around an array of members at a point."""
    scale = math.gamma((dof + 1) / 2) / (math.gamma(dof / 2) * math.sqrt(dof * math.pi))
    fixed = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(float(v)).alias("v")) for w, v in zip(weight, var)])
    parts = F.zip_with(members, fixed, lambda m, c: c["w"] * scale / F.sqrt(c["v"]) * F.pow(1 + (at - m) ** 2 / (dof * c["v"]), F.lit(-(dof + 1) / 2)))
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)


def weighted(members: Column, weight: list[float]) -> Column:
    """Dot product of an array column with fixed weights."""
    parts = F.zip_with(members, F.array(*[F.lit(float(w)) for w in weight]), lambda a, b: a * b)
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)


def padded(labels: Column, k: int, base: float) -> Column:
    """The first k labels, filled up with the base rate."""
    return F.slice(F.concat(labels, F.array_repeat(F.lit(base), k)), 1, k)


def conformal_threshold(scores: DataFrame, by: list[str], score: str, alpha: float) -> DataFrame:
    """``by..., threshold``: the score of rank ceil((n + 1)(1 - alpha)) (the largest beyond n).

    Ranks come from counts of distinct scores, so a group's scores are never gathered in one task as raw rows.
    """
    per = scores.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by).orderBy(score)
    run = per.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    rank = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)), F.col("n"))
    return run.where(F.col("upto") >= rank).groupBy(*by).agg(F.min(score).alias("threshold"))


def conformal_band(p: Column, width: Column) -> tuple[Column, Column]:
    return F.greatest(p - width / 2, F.lit(0.0)), F.least(p + width / 2, F.lit(1.0))


def conformal_signal(low: Column, high: Column, threshold: float) -> Column:
    return F.when(low > threshold, "BUY").when(high < 1 - threshold, "SELL").otherwise("HOLD")
